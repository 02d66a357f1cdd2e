"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications without the setting.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only in local mode, where one machine is all there is, an absent setting is filled with a temporary
    folder; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/tidemark")
    return found


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path in the application's folder, which `clear` deletes."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back, without its lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that `cut` wrote in this application; to be called once results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
