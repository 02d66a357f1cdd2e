"""Scans along time that split long keys.

A window over a key is one task, however long the key is. Here rows are dealt by key and time bucket; each
bucket gets one row more, what the buckets before it hand on, so a window over a bucket sees all that one
over the key would. What is handed on comes from an aggregate with a row for each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.scalars import HOUR, micros


def bucket_hours(df: DataFrame, keys: Sequence[str], ts: str, rows: int = 1_000_000) -> float | None:
    """Hours of a bucket that has about `rows` rows in the longest key, or None if no key has more than that (one aggregate)."""
    span = F.max(micros(ts)) - F.min(micros(ts))
    top = df.groupBy(*keys).agg(F.count("*").alias("n"), span.alias("us")).agg(F.max_by(F.struct("n", "us"), "n").alias("x")).select("x.*").first()
    if top is None or top.n is None or top.n <= rows:
        return None
    return max(top.us or 0, HOUR) / HOUR / (top.n / rows)


def bucket_of(ts: str, hours: float) -> Column:
    return F.floor(micros(ts) / max(round(hours * HOUR), 1))


def handed_on(rows: DataFrame, keys: Sequence[str], last: Column, backward: bool = False) -> DataFrame:
    """keys, _b and `_got`: the last non-null `last` (an aggregate of a bucket) of the buckets before each (backward: after it)."""
    each = rows.groupBy(*keys, "_b").agg(last.alias("_last"))
    order = F.col("_b").desc_nulls_first() if backward else F.col("_b").asc_nulls_first()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("_got", F.last("_last", True).over(w)).drop("_last")


def with_first(rows: DataFrame, first: DataFrame) -> DataFrame:
    """`rows` and the rows of `first`, which `_f` orders before them (0, not 1) and which lack all columns but their own."""
    return rows.withColumn("_f", F.lit(1)).unionByName(first.withColumn("_f", F.lit(0)), allowMissingColumns=True)


def last_known(rows: DataFrame, keys: Sequence[str], hit: str, order: Sequence[Column], last: Column, out: str, backward: bool = False) -> DataFrame:
    """`rows` (with `_b`) with `out`: the last non-null `hit` up to each row in `order`, which must follow the buckets.

    `last` is the aggregate that picks a bucket's last hit in that order.
    """
    first = handed_on(rows, keys, last, backward).where("_got is not null").withColumnRenamed("_got", hit)
    w = Window.partitionBy(*keys, "_b").orderBy("_f", *order).rowsBetween(Window.unboundedPreceding, 0)
    return with_first(rows, first).withColumn(out, F.last(hit, True).over(w)).where("_f = 1").drop("_f")


def _borrowed(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, ahead: bool) -> DataFrame:
    """For each bucket the last `k` rows of each of the `k` buckets before it (ahead: the first of those after it), in any order; k * k rows at most."""
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*[F.col(c).asc() if ahead else F.col(c).desc() for c in order]))
    ends = rows.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
    each = ends.groupBy(*keys, "_b").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in (*keys, "_b")])).alias("_x"))
    # a row for each bucket
    w = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(*((1, k) if ahead else (-k, -1)))
    near = each.select(*keys, "_b", F.flatten(F.collect_list("_x").over(w)).alias("_x"))
    return near.select(*keys, "_b", F.explode("_x").alias("_y")).select(*keys, "_b", "_y.*")


def dealt(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], bucket: float | None, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec]:
    """`df` with `_own`, and a window in which each own row has its key's `before` rows before and `after` rows behind it, in `order`.

    With a bucket (hours) rows are dealt by key and time bucket, and each bucket borrows the rows that
    it needs of its neighbours: `own` takes those away again. `order` (ascending, nulls first) must follow
    `ts`; of rows equal in all of it any may be borrowed. Without a bucket the window is the key's.
    """
    if bucket is None:
        return df.withColumn("_own", F.lit(True)), Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_b", bucket_of(ts, bucket))
    out = rows.withColumn("_own", F.lit(True))
    for k, ahead in ((before, False), (after, True)):
        if k:
            out = out.unionByName(_borrowed(rows, keys, order, k, ahead).withColumn("_own", F.lit(False)))
    return out, Window.partitionBy(*keys, "_b").orderBy(*order)


def own(rows: DataFrame) -> DataFrame:
    """The rows of `dealt` that aren't borrowed."""
    return rows.where("_own").drop("_own", "_b")


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], value: Column, out: str, bucket: float | None = None) -> DataFrame:
    """`df` with `out`: the sum of `value` over the key's rows up to each one in `order`, which must follow `ts`; with a bucket as in `dealt`.

    Each bucket starts from the sum of those before it. Null values add nothing.
    """
    if bucket is None:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.withColumns({"_b": bucket_of(ts, bucket), "_v": value})
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    kind = sums.schema["_s"].dataType
    earlier = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*keys, "_b", F.sum("_s").over(earlier).cast(kind).alias("_v")).where("_v is not null")
    w = Window.partitionBy(*keys, "_b").orderBy("_f", *order).rowsBetween(Window.unboundedPreceding, 0)
    seen = with_first(rows.withColumn("_v", F.col("_v").cast(kind)), first)
    return seen.withColumn(out, F.sum("_v").over(w).cast(kind)).where("_f = 1").drop("_f", "_b", "_v")


def numbered_runs(df: DataFrame, keys: Sequence[str], ts: str, state: str, hours: float) -> DataFrame:
    """A row for each part of a run of equal states that lies in one bucket: keys, spell (of the whole key, from 1), state, start, end, n."""
    rows = df.select(*keys, F.col(ts).alias("_t"), F.col(state).alias("_s"), bucket_of(ts, hours).alias("_b"))
    first = handed_on(rows, keys, F.max(F.struct("_t", "_s"))).where("_got is not null").select(*keys, "_b", F.col("_got._t").alias("_t"), F.col("_got._s").alias("_s"))
    w = Window.partitionBy(*keys, "_b").orderBy("_f", "_t", "_s")
    before = F.lag("_f").over(w)
    change = (before.isNull() | ~F.col("_s").eqNullSafe(F.lag("_s").over(w)) | F.lag("_t").over(w).isNull()).cast("long")
    seen = with_first(rows, first).withColumn("_c", F.when(F.col("_f") == 1, change).otherwise(0))
    parts = seen.withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_f = 1")
    parts = parts.groupBy(*keys, "_b", "_n").agg(F.first("_s").alias("_s"), F.min("_t").alias("start"), F.max("_t").alias("end"), F.count("*").alias("n"))
    changes = parts.groupBy(*keys, "_b").agg(F.max("_n").alias("_all"))
    upto = F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_k{i}" for i in range(len(keys))]
    begin = changes.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_b").alias("_q"), upto.alias("_upto"))
    same = F.col("_b").eqNullSafe(F.col("_q"))
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return parts.join(begin, same).select(*keys, (F.col("_upto") + F.col("_n")).alias("spell"), F.col("_s").alias(state), "start", "end", "n")
