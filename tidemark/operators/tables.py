"""Joins, roll-ups and crosstabs over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import hours_between
from tidemark.operators.ranks import quantiles, running
from tidemark.sources.shared import cut


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def counted(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """`df`, marked for broadcast if it has at most `limit` rows when counted; beyond, Spark chooses the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(frames: Sequence[DataFrame], keys: Sequence[str], rows: int = 1_000_000) -> list[DataFrame]:
    """The tables dealt alike by their keys into as many parts as the largest has `rows` rows, so that a task's part stays as large however they grow.

    Spark joins its own parts up to a number of compressed bytes, from which rows of few distinct values
    unfold many times over. Tables of at most `rows` rows are left to it.
    """
    n = -(-max(df.count() for df in frames) // rows)
    parts = max(n, int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [df.repartition(parts, *keys) for df in frames] if n > 1 else list(frames)


def join_all(base: DataFrame, others: Sequence[DataFrame], on: Sequence[str], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(on), how), others, base)


def backbone_join(a: DataFrame, b: DataFrame, on: Sequence[str], suffix_a: str, suffix_b: str) -> DataFrame:
    """All keys of both tables, with the columns of either; clashing names get the suffixes."""
    on = list(on)
    clash = (set(a.columns) & set(b.columns)) - set(on)
    name = lambda d, s: d.select(*on, *[F.col(c).alias(c + s if c in clash else c) for c in d.columns if c not in on])
    keys = a.select(*on).union(b.select(*on)).distinct()
    return keys.join(name(a, suffix_a), on, "left").join(name(b, suffix_b), on, "left")


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts by row and fixed columns, zeros filled, with a total column and a TOTAL row."""
    cells = [F.count_if(F.col(col) == v).alias(v) for v in values]
    body = df.groupBy(F.col(row).cast("string").alias(row)).agg(*cells)
    total = df.agg(*cells).select(F.lit("TOTAL").alias(row), *values)
    return body.unionByName(total).withColumn("total", reduce(lambda x, y: x + y, [F.col(f"`{v}`") for v in values]))


def shares(df: DataFrame, row: str, col: str) -> DataFrame:
    """n and its share of the row, of the column, of all. The cells are counted and written once; each total is an aggregate of them."""
    n = cut(df.groupBy(row, col).agg(F.count("*").alias("n")))
    out = n
    for name, by in (("row_share", [row]), ("col_share", [col]), ("all_share", [])):
        total = n.groupBy(*[F.col(c).alias("_k") for c in by]).agg(F.sum("n").alias("_t"))
        same = [out[c].eqNullSafe(F.col("_k")) for c in by]
        joined = out.join(total, same[0]) if same else out.crossJoin(F.broadcast(total))  # one row
        out = joined.withColumn(name, F.col("n") / F.col("_t")).drop("_k", "_t")
    return out


def top_n_other(df: DataFrame, col: str, n: int, out: str, other: str = "Other") -> DataFrame:
    """The value, as text, if it is among the n most frequent (ties by name), else `other`."""
    top = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(n).select(F.col(col).alias("_top"))
    joined = df.join(F.broadcast(top), F.col(col) == F.col("_top"), "left")  # n rows
    return joined.withColumn(out, F.when(F.col("_top").isNotNull(), F.col(col).cast("string")).otherwise(F.lit(other))).drop("_top")


def highest(df: DataFrame, keys: Sequence[str], score: str, ts: str) -> DataFrame:
    """Highest score and the first instant at it."""
    return df.groupBy(*keys).agg(F.max(score).alias("max_score"), F.min_by(ts, F.struct(-F.col(score), F.col(ts))).alias("max_time"))


def earliest(df: DataFrame, keys: Sequence[str], score: str, ts: str) -> DataFrame:
    """Earliest instant and the highest score at it."""
    return df.groupBy(*keys).agg(F.min(ts).alias("first_time"), F.min_by(score, F.struct(F.col(ts), -F.col(score))).alias("first_score"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def pareto(df: DataFrame, col: str, share: float) -> DataFrame:
    """The most frequent values up to a running share of all rows, ties by value; null is a value, the last of its ties."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    upto = running(n, [F.desc("n"), F.col(col).asc_nulls_last()], "n", "_upto")
    total = df.agg(F.count("*").alias("_total"))
    out = upto.crossJoin(F.broadcast(total)).withColumn("running", F.col("_upto") / F.col("_total"))  # one row
    return out.where(F.col("running") <= share).select(col, "n", "running")


def trim_quantiles(df: DataFrame, col: str, q: float) -> DataFrame:
    """Rows between the q and 1 - q quantiles, bounds included."""
    b = quantiles(df, [], col, {"_lo": q, "_hi": 1 - q})
    return df.crossJoin(F.broadcast(b)).where(F.col(col).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")  # one row


def cooccurrence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """For flag pairs: rows with both, and their share of the rows with the first; one pass of conditional sums."""
    sums = df.agg(*[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{i}_{j}") for i, a in enumerate(flags) for j, b in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("n"), F.col(f"{i}_{i}").alias("base")) for i, a in enumerate(flags) for j, b in enumerate(flags)])
    return sums.select(F.explode(rows).alias("x")).select("x.a", "x.b", "x.n", F.try_divide("x.n", "x.base").alias("share"))


def join_groups(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Two tables of one row per group, joined on the group; null groups match."""
    if not by:
        return a.crossJoin(b)  # one row each
    other = b.withColumnsRenamed({c: f"_{i}_{c}" for i, c in enumerate(by)})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{i}_{c}")) for i, c in enumerate(by)])
    return a.join(other, same, how).drop(*[f"_{i}_{c}" for i, c in enumerate(by)])


def with_group(df: DataFrame, by: Sequence[str], exprs: Mapping[str, Column]) -> DataFrame:
    """`df` with aggregates of each row's group (null groups too): an aggregate and a join, so that no task holds a large group."""
    return join_groups(df, df.groupBy(*by).agg(*[e.alias(n) for n, e in exprs.items()]), by)


def summary(df: DataFrame, by: Sequence[str], col: str, qs: Sequence[float] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """n, mean, std, min, max and quantiles (p25, ...) of the values of each group."""
    base = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    return join_groups(base, quantiles(df, by, col, {f"p{round(100 * q)}": q for q in qs}), by)


def duplicates(df: DataFrame) -> DataFrame:
    """Distinct rows that occur more than once, with their count."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).where("copies > 1")


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Keys only in a, only in b, or with another value of `col` (nulls equal)."""
    keys = list(keys)
    x, y = a.select(*keys, F.col(col).alias("a_value"), F.lit(1).alias("_a")), b.select(*keys, F.col(col).alias("b_value"), F.lit(1).alias("_b"))
    j = x.join(y, keys, "full")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "changed")
    return j.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "a_value", "b_value")


def at_maximum(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """All rows that reach their key's highest score, ties too."""
    top = df.groupBy(*keys).agg(F.max(score).alias("_top"))
    return df.join(top, list(keys)).where(F.col(score) == F.col("_top")).drop("_top")


def ends(df: DataFrame, first: Sequence[Column], last: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of either order, as part head and tail."""
    part = lambda order, name: df.orderBy(*order).limit(k).withColumn("part", F.lit(name))
    return part(first, "head").unionByName(part(last, "tail"))


def sample_keys(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """All rows of k keys: those with the least digest of seed and key, so that reruns draw the same."""
    drawn = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)
    return df.join(counted(drawn), key)


def funnel(df: DataFrame, by: str, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Links between consecutive steps (name, time column) by group: rows that go on, with the median hours, and those that drop off.

    A row reaches a step if it has the times of it and of all steps before it; links without rows are left out.
    """
    reached, parts = F.col(steps[0][1]).isNotNull(), []
    for (a, x), (b, y) in zip(steps, steps[1:], strict=False):
        on = reached & F.col(y).isNotNull()
        parts += [F.when(on, F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), hours_between(x, y).alias("h"))), F.when(reached & ~on, F.struct(F.lit(a).alias("source"), F.lit(f"No {b}").alias("target"), F.lit(None).cast("double").alias("h")))]
        reached = on
    long = df.select(by, F.explode(F.array_compact(F.array(*parts))).alias("_x")).select(by, "_x.*")
    keys = [by, "source", "target"]
    return join_groups(long.groupBy(*keys).agg(F.count("*").alias("n")), quantiles(long, keys, "h", {"median_hours": 0.5}), keys)


def group_diff(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups that only one of two extracts has, with their rows: group, kind (only_a, only_b), n."""
    n = lambda d, name: d.groupBy(group).agg(F.count("*").alias(name))
    x, y = n(a, "_a"), n(b, "_b").withColumnRenamed(group, "_g")
    j = x.join(y, F.col(group).eqNullSafe(F.col("_g")), "full").where("_a is null or _b is null")
    return j.select(F.coalesce(group, "_g").alias(group), F.when(F.col("_b").isNull(), "only_a").otherwise("only_b").alias("kind"), F.coalesce("_a", "_b").alias("n"))


def column_diff(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns that only one of two extracts has, and those whose types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return {"only_a": [c for c in x if c not in y], "only_b": [c for c in y if c not in x], "retyped": [c for c in x if c in y and x[c] != y[c]]}
