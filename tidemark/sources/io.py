"""Readers and writers of event extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import null_tokens

#: Shapes of the texts of a time and of a day.
DATETIME, DATE = r"^\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d(\\.\\d{1,6})?$", r"^\\d{4}-\\d\\d-\\d\\d$"


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with header, all columns text, the null tokens as null; with `columns` no pass infers anything."""
    reader = spark.read.option("header", True)
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select(*[null_tokens(F.col(c)).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, tokens: Sequence[str] = ("null", "NULL", "Null", "None"), sample: float = 1.0) -> DataFrame:
    """A CSV with header and inferred types, the null tokens as null; one pass over the (sampled) file infers them.

    Tokens are made null before types are inferred: the reader knows only one null text, so the file is
    read as text lines, cleaned, and parsed from there.
    """
    text = read_text_csv(spark, path).select("*")
    clean = text.select(*[F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) for c in text.columns])
    kinds = ("bigint", "double", "timestamp_ntz")
    seen = clean.sample(sample, seed=1) if sample < 1 else clean
    fits = seen.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {k})").isNull()).alias(f"{c}|{k}") for c in clean.columns for k in kinds], *[F.count(c).alias(f"{c}|n") for c in clean.columns]).first()
    pick = lambda c: next((k for k in kinds if fits[f"{c}|n"] and not fits[f"{c}|{k}"]), None)
    return clean.select(*[F.expr(f"try_cast(`{c}` as {pick(c)})").alias(c) if pick(c) else F.col(c) for c in clean.columns])


def cast_known(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns cast by name: long, double, datetime or date; what doesn't parse is null; others stay."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}

    def cast(c: str):
        kind = types.get(c)
        if kind is None or c not in text:
            return F.col(c)
        if kind in ("datetime", "date"):
            shape = DATETIME if kind == "datetime" else DATE
            return F.expr(f"CASE WHEN `{c}` rlike '{shape}' THEN try_cast(`{c}` as timestamp_ntz) END").alias(c)
        return F.col(c).try_cast(kind).alias(c)

    return df.select(*[cast(c) for c in df.columns])


#: Column of a row of `ingest_csv` that says why it was rejected.
REASONS = "_reasons"


def parsed_time(c: Column, formats: Sequence[str]) -> Column:
    """A time without zone by the first of several formats that fits, else null.

    Texts are read as UTC, so that hours that the session's zone skips stay as they are.
    """
    at = F.coalesce(*[F.try_to_timestamp(F.concat(c, F.lit(" +0000")), F.lit(f"{f} Z")) for f in formats])
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.unix_micros(at).cast("decimal(20,0)") / 1_000_000)


def ingest_csv(spark: SparkSession, path: str, columns: Mapping[str, str | Sequence[str]], required: Sequence[str] = (), header: bool = True, tokens: Sequence[str] = ("Null", "NULL", "null")) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a CSV: typed columns, and what doesn't fit its types with the reasons, instead of an error or a silent null.

    `columns`: name -> `string`, `long`, `double`, or the formats of a time, the first that fits counts.
    A row is rejected if a text that is no null token doesn't parse (`column: text`), a required column is
    null (`column: missing`), or the line has too few or too many fields (`fields`). `rejected` has the
    file, the texts of all columns and the line (where its fields don't fit), and the array of reasons.
    Both are lazy and read the file on their own; together they hold every line once.
    """
    bad = "_line"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, bad]])
    # every column is parsed whatever a query reads of the rows, else a line of other fields isn't noticed
    text = spark.read.schema(schema).option("columnPruning", False).csv(path, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    text = text.select(*[F.when(~F.trim(c).isin(*tokens), F.col(c)).alias(c) for c in columns], bad, F.col("_metadata.file_name").alias("_file"))
    typed, reasons = {}, [F.when(F.col(bad).isNotNull(), "fields")]
    for c, kind in columns.items():
        if kind == "string":
            continue
        typed[f"_t_{c}"] = F.trim(c).try_cast(kind) if isinstance(kind, str) else parsed_time(F.trim(c), kind)
        reasons.append(F.when(F.col(c).isNotNull() & F.col(f"_t_{c}").isNull(), F.concat(F.lit(f"{c}: "), F.col(c))))
    # what a line of other fields lacks isn't told again
    reasons += [F.when(F.col(bad).isNull() & F.col(c).isNull(), f"{c}: missing") for c in required]
    every = text.withColumns(typed).withColumn(REASONS, F.array_compact(F.array(*reasons)))
    rows = every.where(F.size(REASONS) == 0).select(*[F.col(f"_t_{c}" if f"_t_{c}" in typed else c).alias(c) for c in columns])
    return rows, every.where(F.size(REASONS) > 0).select("_file", *columns, bad, REASONS)


def harmonise(frames: Sequence[DataFrame], rename: Mapping[str, str] = {}, drop: Sequence[str] = ()) -> DataFrame:
    """Files of differing columns as one table of text; missing columns are null."""
    out = None
    for f in frames:
        f = f.drop(*drop).withColumnsRenamed({k: v for k, v in rename.items() if k in f.columns})
        f = f.select(*[F.col(c).cast("string").alias(c) for c in f.columns])
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def mismatches(frames: Mapping[str, DataFrame]) -> dict[str, tuple[list[str], list[str]]]:
    """Per file: columns that others have and it lacks, and those that only it has."""
    every = set().union(*[set(f.columns) for f in frames.values()])
    return {n: (sorted(every - set(f.columns)), sorted(c for c in f.columns if all(c not in o.columns for m, o in frames.items() if m != n))) for n, f in frames.items()}


def combine_events(events: Sequence[DataFrame], encounters: DataFrame, key: str, ts: str) -> DataFrame:
    """All event tables with encounter attributes, distinct, without rows that lack key or time.

    Rows are made distinct before the attributes are joined, which gives the same rows as after it, as
    long as an encounter has one row.
    """
    all_events = harmonise_types(events)
    return all_events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct().join(encounters.distinct(), key, "left")


def split_extract(wide: DataFrame, key: str, ts: str, attributes: Sequence[str], scores: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A wide extract as an encounter table (each attribute at the latest time) and a table of scores by key and time."""
    return last_attributes(wide, key, ts, attributes), wide.select(key, ts, *scores)


def harmonise_types(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def last_attributes(wide: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: each attribute's value at the latest time."""
    return wide.groupBy(key).agg(*[F.max_by(c, ts).alias(c) for c in columns])


def write_table(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Name -> lazy table for every parquet table in a folder, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{folder}/{n}") for n in sorted(names) if not n.startswith(("_", "."))}


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            out.append(p)
    return out
