"""Agreement of two label sources and tests of factors, as lazy plans; p-values are computed on the few rows of statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators.ranks import quantiles, running
from tidemark.operators.tables import counted, summary


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, exact share, upgrades (b above a), downgrades, Cohen's kappa (null if undefined)."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(F.col("b") > F.col("a"), F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(F.col("b") < F.col("a"), F.col("n")).otherwise(0)).alias("down"))
    ra = cells.groupBy("a").agg(F.sum("n").alias("na"))
    rb = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    by_chance = ra.join(rb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    x = total.crossJoin(by_chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return x.select(F.col("n").cast("long").alias("n"), po.alias("exact"), (F.col("up") / F.col("n")).alias("upgraded"), (F.col("down") / F.col("n")).alias("downgraded"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both, in either, Jaccard."""
    j = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), both.alias("both"), F.count("*").alias("either")).withColumn("jaccard", F.try_divide("both", "either"))


def chi_square(df: DataFrame, factor: str, group: str) -> DataFrame:
    """One row: chi-square, degrees of freedom, Cramer's V of a factor against a group."""
    cells = df.where(F.col(factor).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(factor).alias("f"), F.col(group).alias("g")).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("f").agg(F.sum("n").alias("rn")), cells.groupBy("g").agg(F.sum("n").alias("cn"))
    total = cells.agg(F.sum("n").alias("t"))
    # sum of n^2/(row * column) over filled cells; empty ones add nothing
    s = cells.join(rows, "f").join(cols, "g").agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("rn").cast("double") * F.col("cn"))).alias("s"))
    x = s.crossJoin(total).crossJoin(rows.agg(F.count("*").alias("r"))).crossJoin(cols.agg(F.count("*").alias("c")))  # one row each
    chi = F.col("t") * (F.col("s") - 1)
    return x.select(chi.alias("chi2"), ((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"), F.sqrt(chi / (F.col("t") * (F.least("r", "c") - 1))).alias("cramers_v"))


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x) of the chi-square distribution, by the series or continued fraction of the incomplete gamma function."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= z / k
            total += term
        return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    b, c = z + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of a 2x2 table; terms are summed outward from the likeliest one until they vanish."""
    n, r, k = a + b + c + d, a + b, a + c
    lg = math.lgamma
    const = lg(r + 1) + lg(n - r + 1) + lg(k + 1) + lg(n - k + 1) - lg(n + 1)
    log = lambda x: const - lg(x + 1) - lg(r - x + 1) - lg(k - x + 1) - lg(n - r - k + x + 1)
    lo, hi = max(0, k - (n - r)), min(r, k)
    mode = min(max((r + 1) * (k + 1) // (n + 2), lo), hi)
    at, top, p = log(a), log(mode), 0.0
    for steps in (range(mode, hi + 1), range(mode - 1, lo - 1, -1)):
        for x in steps:
            v = log(x)
            if v <= at + 1e-7:
                p += math.exp(v)
            if v < min(top, at) - 45:
                break
    return (a * d / (b * c) if b * c else math.inf), min(1.0, p)


def normal_tail(z: float) -> float:
    """Two-sided P(|Z| >= z)."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    """p of a few rows of statistics; null where there is none."""
    return pd.Series([chi_square_tail(float(a), int(b)) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(x, dof, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: normal_tail(v) if pd.notna(v) else None).astype("float64")


def factor_cells(df: DataFrame, factors: Sequence[str], group: str, by: Sequence[str] = (), top_n: int = 20) -> DataFrame:
    """by..., factor, value, group, n: one long table for all factors; values beyond the `top_n` most frequent of a factor, and nulls, are Other."""
    by = list(by)
    text = [F.col(f).cast("string").alias(f) for f in factors]
    long = df.where(F.col(group).isNotNull()).select(*by, F.col(group).alias("group"), *text).unpivot([*by, "group"], list(factors), "factor", "value")
    n = long.groupBy(*by, "factor", "value", "group").agg(F.count("*").alias("n"))
    # a row per value, not per row of df; the most frequent of each share of the values are found first, so that none is ranked whole
    rank = lambda *part: F.row_number().over(Window.partitionBy(*by, "factor", *part).orderBy(F.desc("_size"), F.col("value").asc_nulls_last()))
    size = n.groupBy(*by, "factor", "value").agg(F.sum("n").alias("_size")).withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(64)))
    some = size.withColumn("_rank", rank("_part")).where(F.col("_rank") <= top_n)
    size = some.withColumn("_rank", rank())
    keys = [*by, "factor"]
    top = size.where(F.col("_rank") <= top_n).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("value").alias("_v"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(keys)]) & (F.col("value") == F.col("_v"))
    kept = n.join(counted(top), same, "left").select(*keys, F.coalesce("_v", F.lit("Other")).alias("value"), "group", "n")
    return kept.groupBy(*by, "factor", "value", "group").agg(F.sum("n").alias("n"))


def factor_tests(df: DataFrame, factors: Sequence[str], group: str, by: Sequence[str] = (), top_n: int = 20) -> DataFrame:
    """by..., factor, chi2 (Yates-corrected for 2x2), dof, cramers_v, p for every factor against the group, in one pass over the data."""
    keys = [*by, "factor"]
    cells = factor_cells(df, factors, group, by, top_n)
    w = lambda *c: Window.partitionBy(*keys, *c)
    m = cells.withColumns({"_r": F.sum("n").over(w("value")).cast("double"), "_c": F.sum("n").over(w("group")).cast("double"), "_t": F.sum("n").over(w()).cast("double")})
    g = m.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n") / (F.col("_r") * F.col("_c"))).alias("_s"), F.first("_t").alias("_t"), F.countDistinct("value").alias("_rows"), F.countDistinct("group").alias("_cols"), F.max(F.struct("_r", "_c", "n")).alias("_x"))
    chi = F.col("_t") * (F.col("_s") - 1)
    # in a 2x2 table all four cells are as far from what is expected
    e = F.col("_x._r") * F.col("_x._c") / F.col("_t")
    off = F.greatest(F.abs(F.col("_x.n") - e) - 0.5, F.lit(0.0))
    r, c, t = F.col("_x._r"), F.col("_x._c"), F.col("_t")
    yates = off * off * t * t * t / (r * (t - r) * c * (t - c))
    least = F.least("_rows", "_cols") - 1
    g = g.withColumn("chi2", F.when(least == 0, 0.0).when((F.col("_rows") == 2) & (F.col("_cols") == 2), yates).otherwise(chi)).withColumn("dof", (F.col("_rows") - 1) * (F.col("_cols") - 1))
    g = g.withColumn("cramers_v", F.coalesce(F.sqrt(F.try_divide("chi2", F.col("_t") * least)), F.lit(0.0)))
    return g.select(*keys, "chi2", "dof", "cramers_v", F.coalesce(chi_square_p("chi2", "dof"), F.lit(1.0)).alias("p"))


def binary_factors(df: DataFrame, flags: Sequence[str], group: str, positive: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., factor, a, b, c, d (flag 1 and 0, positive group and others), test, p, odds_ratio: Fisher's where a cell is below 5, else chi-square."""
    by = list(by)
    long = df.where(F.col(group).isNotNull()).select(*by, (F.col(group) == positive).alias("_g"), *[F.coalesce(F.col(f).cast("int"), F.lit(0)).alias(f) for f in flags]).unpivot([*by, "_g"], list(flags), "factor", "_on")
    count = lambda on, g: F.count_if((F.col("_on") == on) & (F.col("_g") == g))
    cells = long.groupBy(*by, "factor").agg(count(1, True).alias("a"), count(1, False).alias("b"), count(0, True).alias("c"), count(0, False).alias("d"))

    @F.pandas_udf(DoubleType())
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for w, x, y, z in zip(*(s.astype(int) for s in (a, b, c, d)), strict=True):
            n, off = w + x + y + z, abs(w * z - x * y)
            if min(w, x, y, z) < 5:
                out.append(fisher_exact(w, x, y, z)[1])
            else:
                out.append(chi_square_tail(n * max(0.0, off - n / 2) ** 2 / ((w + x) * (y + z) * (w + y) * (x + z)), 1))
        return pd.Series(out, dtype="float64")

    small = F.least("a", "b", "c", "d") < 5
    odds = F.try_divide(F.col("a").cast("double") * F.col("d"), F.col("b").cast("double") * F.col("c"))
    return cells.withColumns({"test": F.when(small, "Fisher's exact").otherwise("Chi-square"), "p": p("a", "b", "c", "d"), "odds_ratio": odds})


# Fixed values of both functions: the limits of the words for an effect's size.
def effect_of_v(v: Column) -> Column:
    return F.when(v < 0.1, "Negligible").when(v < 0.3, "Small").when(v < 0.5, "Medium").otherwise("Large")


def effect_of_odds(o: Column) -> Column:
    size = F.abs(F.log(o))
    return F.when(o.isNull(), "N/A").when(o == 0, "Large").when(size < 0.3, "Negligible").when(size < 0.8, "Small").when(size < 1.5, "Medium").otherwise("Large")


def factor_summary(categorical: DataFrame, binary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both kinds of tests as one table: factor, type, test, p, effect, metric, interpretation, and the place by size of effect within the type."""
    c = categorical.select(*by, "factor", F.lit("Categorical").alias("type"), F.lit("Chi-square").alias("test"), "p", F.col("cramers_v").alias("effect"), F.lit("Cramer's V").alias("metric"), effect_of_v(F.col("cramers_v")).alias("interpretation"), F.col("cramers_v").alias("_size"))
    o = F.col("odds_ratio")
    b = binary.select(*by, "factor", F.lit("Binary").alias("type"), "test", "p", o.alias("effect"), F.lit("Odds Ratio").alias("metric"), effect_of_odds(o).alias("interpretation"), F.when(o > 0, F.abs(F.log(o))).otherwise(0.0).alias("_size"))
    # a row per factor
    w = Window.partitionBy(*by, "type").orderBy(F.desc("_size"), "factor")
    return c.unionByName(b).withColumn("place", F.row_number().over(w)).drop("_size")


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: n and the sum of tie-averaged ranks; plus the tie term (sum of t^3 - t).

    Ranks come from the counts of distinct values and their running sums, range by range.
    """
    v = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = v.groupBy(value).agg(F.count("*").alias("t"))
    ranks = running(counts, [F.col(value)], "t", "_upto").withColumn("rank", F.col("_upto") - F.col("t") + (F.col("t") + 1) / 2)
    per = v.groupBy(group, value).agg(F.count("*").alias("n"))
    sums = per.join(ranks, value).groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    ties = counts.agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    return sums.crossJoin(ties)  # one row


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: H corrected for ties, degrees of freedom, p."""
    r = rank_sums(df, group, value)
    x = r.agg(F.sum("n").cast("double").alias("n"), F.sum(F.pow("rank_sum", F.lit(2.0)) / F.col("n")).alias("s"), F.count("*").alias("k"), F.max("ties").alias("ties"))
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    x = x.select((h / (1 - F.col("ties") / (F.pow("n", F.lit(3.0)) - F.col("n")))).alias("h"), (F.col("k") - 1).alias("dof"))
    return x.withColumn("p", chi_square_p("h", "dof"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row for two groups: U of the first by name, z (corrected for ties and continuity) and two-sided p."""
    r = rank_sums(df, group, value)
    x = r.agg(F.min_by(F.struct("n", "rank_sum"), group).alias("a"), F.max_by("n", group).alias("m"), F.max("ties").alias("ties"))
    n, m = F.col("a.n").cast("double"), F.col("m").cast("double")
    t = n + m
    u = F.col("a.rank_sum") - n * (n + 1) / 2
    var = n * m / 12 * (t + 1 - F.col("ties") / (t * (t - 1)))
    z = F.greatest(F.abs(u - n * m / 2) - 0.5, F.lit(0.0)) / F.sqrt(var)
    return x.select(u.alias("u"), z.alias("z")).withColumn("p", normal_p("z"))


def numeric_factor(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group n, mean, std, min, max and quartiles; tests are `mann_whitney` for two groups and `kruskal_wallis` for more."""
    return summary(df.where(F.col(group).isNotNull()), [group], value, (0.25, 0.5, 0.75))


def column_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row over rows with both: n, share of equal values, correlation, mean absolute difference."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("match_rate"), F.corr(a, b).alias("correlation"), F.avg(F.abs(F.col(a) - F.col(b))).alias("difference"))


def agreement_matrix(df: DataFrame, a: str, b: str, levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Counts of b's levels (columns) for each of a's; levels that don't occur are rows of 0."""
    rows = df.sparkSession.createDataFrame([(int(v),) for v in levels], f"{a} int")
    n = df.groupBy(F.col(a).cast("int").alias(a)).agg(*[F.count_if(F.col(b) == v).alias(f"b_{v}") for v in levels])
    return rows.join(n, a, "left").na.fill(0)


def stack_runs(a: DataFrame, b: DataFrame, key: str, scores: Sequence[str], meta: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both runs' scores one below the other with the run's name, and the attributes of the key."""
    part = lambda d, n: d.select(key, *scores).withColumn("run", F.lit(n))
    return part(a, names[0]).unionByName(part(b, names[1])).join(meta.dropDuplicates([key]), key, "left")


def unique_profile(df: DataFrame, other: DataFrame, key: str, death: str, stay: str, score: str) -> DataFrame:
    """One row over the keys of df that the other lacks: n, death percentage, mean and median stay, and the counts of each score."""
    only = df.join(other.select(key).distinct(), key, "left_anti")
    n = only.agg(F.count("*").alias("n"), F.round(F.avg(death) * 100, 2).alias("death_pct"), F.round(F.avg(stay), 2).alias("mean_stay"))
    per = only.groupBy(score).agg(F.count("*").alias("_n")).agg(F.array_sort(F.collect_list(F.struct(F.col(score).alias("score"), F.col("_n").alias("n")))).alias("_s"))
    text = F.array_join(F.transform("_s", lambda x: F.concat_ws(":", x["score"].cast("string"), x["n"].cast("string"))), ",")
    return n.crossJoin(quantiles(only, [], stay, {"median_stay": 0.5})).crossJoin(per.select(text.alias("scores")))  # one row each


def factor_classes(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    """`match_class` of two labels of the form PREFIX-n: agree, or which differs how."""
    a, b = F.split_part(ours, F.lit("-"), F.lit(1)), F.split_part(theirs, F.lit("-"), F.lit(1))
    cls = F.when(F.col(ours).isNull() & F.col(theirs).isNull(), "none").when(F.col(theirs).isNull(), "only_ours").when(F.col(ours).isNull(), "only_theirs").when(F.col(ours) == F.col(theirs), "agree").when(a == b, "other_severity").otherwise("other_class")
    return df.withColumn("match_class", cls)


def compare_runs(a: DataFrame, b: DataFrame, key: str, scores: Sequence[str]) -> dict[str, DataFrame]:
    """Overlap of two runs' keys, and agreement and matrix of each score over the keys that both have."""
    out = {"overlap": overlap(a, b, key)}
    both = a.select(key, *[F.col(s).alias(f"a_{s}") for s in scores]).join(b.select(key, *[F.col(s).alias(f"b_{s}") for s in scores]), key)
    for s in scores:
        out[f"agreement_{s}"] = agreement(both, f"a_{s}", f"b_{s}")
        out[f"matrix_{s}"] = agreement_matrix(both, f"a_{s}", f"b_{s}")
    return out
