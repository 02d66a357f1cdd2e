"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut, shared_dir

__all__ = ["SPACES", "bounded_broadcast", "cut", "documents", "let", "numbered", "shared_dir", "words"]

#: White space that separates words: space and the controls 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` are few; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """`rows` with their number (from 0) within their group, in an order that starts with the group's columns."""
    # the number of a row in its partition, and the partition above it, from one sorted write
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = dealt.groupBy(*group, part.alias("_p")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(parts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n"))
    renamed = before.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_p").alias("_q"), "_from", "_before")
    same = part == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = dealt.join(bounded_broadcast(renamed, before.count()), same)
    return joined.withColumn(out, F.col("_before") + F.col("_at") - F.col("_from")).select(*rows.columns, out)
