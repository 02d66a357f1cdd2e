"""Tables of named runs in one folder: each stage is written once and read back, and a broken run goes on where it stopped.

A run has a row in the folder's manifest (name, settings, path, time). A stage is complete once Spark has
committed its write, which leaves its `_SUCCESS` file; a stage that a lost driver left behind lacks it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, settings string, path string, begun timestamp"


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def table_path(root: str, table: str, run: str) -> str:
    return f"{root}/{table}/scenario={run}"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each run under `root`."""
    if not exists(spark, f"{root}/manifest/_SUCCESS"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    return rows.groupBy("run").agg(F.max_by(F.struct("settings", "path", "begun"), "begun").alias("x")).select("run", "x.*")


class Stages:
    """Writer and reader of one run's tables; `made` lists the stages that this object ran."""

    def __init__(self, spark: SparkSession, root: str, run: str, settings: str, tables: Sequence[str], resume: bool = False) -> None:
        """`resume`: complete stages of this run stay, if it had the same settings; else what it left under `tables` goes."""
        self.spark, self.root, self.run, self.made = spark, root, run, []
        before = manifest(spark, root).where(F.col("run") == run).first()
        if not (resume and before and before.settings == settings):
            for t in tables:
                fs, p = _file(spark, table_path(root, t, run))
                fs.delete(p, True)
            row = spark.createDataFrame([(run, settings, root)], "run string, settings string, path string")
            row.withColumn("begun", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")

    def __call__(self, table: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, read back; `make` is only called if it isn't complete."""
        path = table_path(self.root, table, self.run)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            self.made.append(table)
            df = make()
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        return self.spark.read.parquet(path)


def load_run(spark: SparkSession, root: str, run: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a run by its name in the manifest; an unknown run, or a table that isn't complete, is an error."""
    known = {r.run: r.path for r in manifest(spark, root).select("run", "path").collect()}  # a row for each run
    if run not in known:
        raise FileNotFoundError(f"no run {run!r} under {root}; there are: {', '.join(sorted(known)) or 'none'}")
    paths = {t: table_path(known[run], t, run) for t in tables}
    if lacking := [t for t, p in paths.items() if not exists(spark, f"{p}/_SUCCESS")]:
        raise FileNotFoundError(f"run {run!r} isn't complete: {', '.join(lacking)}")
    return {t: spark.read.parquet(p) for t, p in paths.items()}
