"""Running sums, ranks and exact quantiles over whole tables, without one task for all rows.

Rows are counted by value, the counts are range-partitioned and written, each partition is summed,
and the sums before a partition are its offset: only one row for each partition meets in one task.
Quantiles of large groups are selected by counting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import cut


def running(df: DataFrame, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """`df` with `out`: the sum of `value` over all rows up to each one in the (total) order.

    Writes `df` once, range-partitioned by the order; the number of partitions is Spark's.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy("_p").agg(F.sum(value).alias("_s"))
    # one row for each partition
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.sum(value).over(inside)).drop("_p", "_b")


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float], most: int = 1_000_000) -> DataFrame:
    """One row per group (null groups too) with the exact, linearly interpolated quantiles; null values don't count.

    Groups of up to `most` values are one aggregate, which holds the distinct values of a group. Larger
    ones, which one count finds, are selected from by `bracketed`.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    v = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    large = v.groupBy(*keys).count().where(F.col("count") > most)
    rest, out = v, None
    if not large.isEmpty():
        names = F.broadcast(large.select(*_other(keys)))  # at most one group in `most` rows
        rest = v.join(names, _same(keys), "left_anti")
        out = bracketed(v.join(names, _same(keys), "left_semi"), keys, qs)
    got = rest.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs.values()])).alias("_q"))
    got = got.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(qs)])
    if out is not None:  # without a key nothing is left over
        got = got.unionByName(out) if keys else out
    return got.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def _other(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"{k}x") for k in keys]


def _same(keys: Sequence[str]) -> Column:
    """Equal keys of a table and of one with the names of `_other`."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}x"))
    return out


def bracketed(v: DataFrame, keys: Sequence[str], qs: Mapping[str, float], accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles of `_v` by key, for few keys with very many values.

    An approximate quantile a little below and one a little above bracket each wanted one; a second pass
    counts what lies below the bracket and gathers the distinct values in it, a `4 / accuracy` part of
    all. A key whose bracket should miss, which the counts show, is gathered whole.
    """
    near = 2 / accuracy
    marks = [m for q in qs.values() for m in (max(0.0, q - near), min(1.0, q + near))]
    approx = F.percentile_approx("_v", F.array(*map(F.lit, marks)), accuracy)
    ends = cut(v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), approx.alias("m")))

    def counted(ends: DataFrame) -> DataFrame:
        return v.join(F.broadcast(ends.select(*_other(keys), "n", "m")), _same(keys))

    lo, hi = (lambda i: F.col("m")[2 * i]), (lambda i: F.col("m")[2 * i + 1])
    below = [F.count_if(F.col("_v") < lo(i)) for i in range(len(qs))]
    upto = [F.count_if(F.col("_v") <= hi(i)) for i in range(len(qs))]
    seen = cut(counted(ends).groupBy(*keys).agg(F.max("n").alias("n"), F.array(*below).alias("below"), F.array(*upto).alias("upto"), F.max("m").alias("m")))
    missed = F.lit(False)
    for i, q in enumerate(qs.values()):
        at = (F.col("n") - 1) * F.lit(float(q))
        missed = missed | (F.col("below")[i] > F.floor(at)) | (F.col("upto")[i] <= F.ceil(at))
    bad = ends.join(seen.where(missed).select(*_other(keys)), _same(keys), "left_semi")
    whole = F.flatten(F.array_repeat(F.array("least", "most"), len(qs)))
    fine = seen.where(~missed).select(*keys, "n", "m", "below")
    state = fine.unionByName(bad.select(*keys, "n", whole.alias("m"), F.array_repeat(F.lit(0).cast("long"), len(qs)).alias("below")))
    inside = F.array_compact(F.array(*[F.when((F.col("_v") >= lo(i)) & (F.col("_v") <= hi(i)), F.lit(i)) for i in range(len(qs))]))
    values = counted(state).select(*keys, "_v", F.explode(inside).alias("i")).groupBy(*keys, "i", "_v").agg(F.count("*").alias("c"))
    each = values.join(F.broadcast(state.select(*_other(keys), "n", "below")), _same(keys)).drop(*[f"{k}x" for k in keys])
    end = F.col("below")[F.col("i")] + F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("_v"))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    picks, mixed = [], []
    for i, (name, q) in enumerate(qs.items()):
        at = (F.col("n") - 1) * F.lit(float(q))
        holds = lambda k, i=i: F.max(F.when((F.col("i") == i) & (F.col("start") <= k) & (k < F.col("end")), F.col("_v")))
        picks += [holds(F.floor(at)).alias(f"l{i}"), holds(F.ceil(at)).alias(f"h{i}"), F.max(at - F.floor(at)).alias(f"f{i}")]
        low, high = F.col(f"l{i}"), F.col(f"h{i}")
        mixed.append(F.when(low == high, low).otherwise(low + (high - low) * F.col(f"f{i}")).alias(name))
    return each.groupBy(*keys).agg(*picks).select(*keys, *mixed)
