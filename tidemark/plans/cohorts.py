"""Encounter tables, cohorts, rates by factor and comparisons of labels, as lazy plans over generic columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import category, hours_between, plus_hours
from tidemark.operators.ranks import quantiles
from tidemark.operators.scan import bucket_of, last_known, running_sum
from tidemark.operators.tables import first_rows, join_groups, spread, top_n_other, with_group
from tidemark.operators.temporal import asof_join, band_join, lookback, shifted, spells
from tidemark.plans.clinical import poa, severities, stacked


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; null where the whole is 0."""
    return F.round(F.try_divide(part, whole) * 100, 1)


# -- encounters and their labels


def encounter_table(labels: Mapping[str, DataFrame], attributes: DataFrame, key: str) -> DataFrame:
    """First and highest severity of each labelled key, with its attributes."""
    return severities(stacked(labels, key), key).join(attributes, key)


def poa_by_level(firsts: DataFrame, encounters: DataFrame, key: str, level: int, first: str, constraints: Mapping[str, float]) -> DataFrame:
    """Each labelled key with a column POA_<reference> per reference time: POA-level if its first instant is within the hours after it."""
    at = firsts.groupBy(key).agg(F.min(first).alias(first))
    out = encounters.join(at, key)
    return out.withColumns({f"POA_{ref}": poa(first, ref, hours, F.lit(level)) for ref, hours in constraints.items()})


def highest_poa(firsts: DataFrame, encounters: DataFrame, key: str, levels: Mapping[int, str], reference: str, hours: float, col: str) -> DataFrame:
    """Per key the POA label of its most severe level that has an instant, in `col`.

    `firsts` has instants in a column per level (null: none), several rows a key or one. All levels are one
    aggregate and one join, without strings; of several encounters of a key the latest reference decides,
    as it makes POA if any does. Large tables are dealt so that a task's keys stay as many.
    """
    firsts, encounters = spread([firsts.select(key, *levels.values()), encounters.select(key, reference)], [key])
    at = firsts.groupBy(key).agg(*[F.min(c).alias(c) for c in levels.values()]).where(F.coalesce(*levels.values()).isNotNull())
    out = encounters.groupBy(key).agg(F.max(reference).alias(reference)).join(at, key)
    ways = [F.when(F.col(levels[n]).isNotNull(), poa(levels[n], reference, hours, F.lit(n))) for n in sorted(levels, reverse=True)]
    return out.select(key, F.coalesce(*ways).alias(col))


def first_level(encounters: DataFrame, key: str, levels: Sequence[str], reference: str, hours: float) -> DataFrame:
    """key, first_time, which level fired first (ties: the lowest), hours from the reference, POA label; keys without any level are left out."""
    out = encounters.withColumn("first_time", F.least(*levels)).where("first_time is not null")
    which = F.coalesce(*[F.when(F.col(c) == F.col("first_time"), F.lit(i + 1)) for i, c in enumerate(levels)])
    out = out.withColumn("first_level", which).withColumn("hours_to_first", hours_between(reference, "first_time"))
    return out.select(key, "first_time", "first_level", "hours_to_first", poa("first_time", reference, hours, F.col("first_level")).alias("label"))


def exclude_confounders(df: DataFrame, flags: Sequence[str], no: str = "N") -> DataFrame:
    """Rows whose registry flags all say no; a null flag excludes as well."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == no for c in flags], F.lit(True)))


def matches(df: DataFrame, ours: str, theirs: str, value: str) -> DataFrame:
    """The rows that we label `value`, as matched or mismatched by the other label (null: mismatched)."""
    hit = F.when(F.col(theirs) == value, F.lit(f"Matched {value}")).otherwise(F.lit(f"Mismatched {value}"))
    return df.where(F.col(ours) == value).withColumn("agreement_group", hit)


def discordance(df: DataFrame, ours: str, theirs: str, value: str) -> DataFrame:
    """`source` of rows with the value in either label: ours only, theirs only, both. A null in the other label leaves the row out."""
    a, b = F.col(ours), F.col(theirs)
    return df.withColumn("source", F.when((a == value) & (b == value), "both").when((a == value) & (b != value), "ours").when((b == value) & (a != value), "theirs")).where("source is not null")


def match_rates(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Per our category: matches, mismatches, total and both shares."""
    a, b = F.col(ours), F.col(theirs)
    n = df.where(a.isNotNull() & b.isNotNull()).groupBy(ours).agg(F.count_if(a == b).alias("n_matches"), F.count_if(a != b).alias("n_mismatches"), F.count("*").alias("total"))
    return n.withColumn("match_share", F.col("n_matches") / F.col("total")).withColumn("mismatch_share", F.col("n_mismatches") / F.col("total"))


def label_counts(df: DataFrame, labels: Sequence[str], strip_suffix: bool = False) -> DataFrame:
    """Long counts: category, source (which label), n; with strip_suffix severities are dropped from the categories."""
    long = long_labels(df, [], labels)
    if strip_suffix:
        long = long.withColumn("category", F.regexp_replace("category", r"-\d+", ""))
    return long.where("category is not null").groupBy("category", "source").agg(F.count("*").alias("n"))


def long_labels(df: DataFrame, keep: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per row and label column: kept columns, source, category."""
    return df.select(*keep, *labels).unpivot(list(keep), list(labels), "source", "category")


def aligned_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """`label_counts` over the union of categories, missing ones 0, with shares within the source and within the category."""
    n = label_counts(df, labels)
    wide = n.groupBy("category").agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)).alias(s) for s in labels])
    flat = wide.unpivot(["category"], list(labels), "source", "n")
    part = lambda by: F.coalesce(F.try_divide(F.col("n") * 100, F.sum("n").over(Window.partitionBy(by))), F.lit(0.0))
    return flat.withColumn("pct_of_source", part("source")).withColumn("pct_of_category", part("category"))


# -- rates by factor


def text_crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Cells "n (pct%)" of fixed columns, with the row's total, and a row Total; percentages are of the row."""
    cells = [F.count_if(F.col(col) == v).alias(v) for v in values]
    body = df.groupBy(F.col(row).cast("string").alias(row)).agg(*cells)
    both = body.unionByName(df.agg(*cells).withColumn(row, F.lit("Total")))
    total = reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values])
    show = [F.concat(F.col(f"`{v}`").cast("string"), F.lit(" ("), F.coalesce(percent(F.col(f"`{v}`"), F.col("_t")), F.lit(0.0)).cast("string"), F.lit("%)")).alias(v) for v in values]
    return both.withColumn("_t", total).select(row, *show, F.col("_t").cast("string").alias("Total"))


def factor_distribution(df: DataFrame, factor: str, label: str, top_n: int = 20) -> DataFrame:
    """factor (rare values as Other), label, n, total of the factor value, pct."""
    n = top_n_other(df, factor, top_n, "factor").groupBy("factor", label).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("factor"))).withColumn("pct", percent(F.col("n"), F.col("total")))


#: The classes of agreement of two POA labels, theirs being the reference.
AGREEMENT = {("POA", "POA"): "POA agrees", ("NPOA", "NPOA"): "NPOA agrees", ("UPOA", "POA"): "UPOA, ours POA", ("UPOA", "NPOA"): "UPOA, ours NPOA"}


def agreement_by_factor(df: DataFrame, factor: str, ours: str, theirs: str, top_n: int = 20) -> DataFrame:
    """Six classes of agreement of the prefixes (and Other), by factor: n, total, pct."""
    a, b = category(F.col(ours)), category(F.col(theirs))
    cls = reduce(lambda w, kv: w.when((b == kv[0][0]) & (a == kv[0][1]), kv[1]), AGREEMENT.items(), F.when((b == "POA") & (a != "POA"), "POA disagrees").when((b == "NPOA") & (a != "NPOA"), "NPOA disagrees"))
    return factor_distribution(df.withColumn("agreement", cls.otherwise("Other")), factor, "agreement", top_n)


def poa_rates(df: DataFrame, key: str, factor: str, ours: str, theirs: str, top_n: int = 20) -> DataFrame:
    """Per factor value: keys, and POA and NPOA counts and percentages of our label and of theirs; a key counts once, by its last label in order."""
    once = df.groupBy(key).agg(F.max_by(F.struct(factor, ours, theirs), F.struct(F.col(ours), F.col(theirs), F.col(factor))).alias("_r")).select(key, "_r.*")
    g = top_n_other(once, factor, top_n, "factor")
    cols = [F.count("*").alias("n")]
    for name, c in (("ours", ours), ("theirs", theirs)):
        p = category(F.col(c))
        known = F.count_if(p.isin("POA", "NPOA", "UPOA"))
        for v in ("POA", "NPOA"):
            cols += [F.count_if(p == v).alias(f"{name}_{v.lower()}"), percent(F.count_if(p == v), known).alias(f"{name}_{v.lower()}_pct")]
    return g.groupBy("factor").agg(*cols)


def poa_rate_cells(df: DataFrame, factor: str, labels: Sequence[str], top_n: int = 20) -> DataFrame:
    """Per factor value: keys, and for each label a cell "pct% (n=k)" of those that it calls POA."""
    g = top_n_other(df, factor, top_n, "factor")
    cells = []
    for c in labels:
        k = F.count_if(F.col(c).startswith("POA"))
        cells.append(F.concat(percent(k, F.count("*")).cast("string"), F.lit("% (n="), k.cast("string"), F.lit(")")).alias(c))
    return g.groupBy("factor").agg(F.count("*").alias("n"), *cells)


def early_late(df: DataFrame, label: str, hours: str, limit: float, order: Sequence[str]) -> DataFrame:
    """Per category of a fixed list: rows below and from the limit, their total and shares; 0 where there is none."""
    low = F.count_if(F.col(hours) < limit)
    n = df.where(F.col(hours).isNotNull()).groupBy(label).agg(low.alias("early"), F.count_if(F.col(hours) >= limit).alias("late"))
    cats = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], f"{label} string, place int")
    out = cats.join(n, label, "left").na.fill(0, ["early", "late"]).withColumn("total", F.col("early") + F.col("late"))
    share = lambda c: F.coalesce(F.try_divide(c, "total"), F.lit(0.0))
    return out.withColumn("early_share", share("early")).withColumn("late_share", share("late"))


def by_department(df: DataFrame, variable: str, target: str, values: Sequence[str], most: int = 70) -> DataFrame:
    """Counts of the target's values by attribute, over its `most` largest cells; rank 0 for intensive care, 2 for the rest, 98 and 99 for unknown ones."""
    n = df.groupBy(variable, target).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(variable).asc_nulls_last(), F.col(target).asc_nulls_last()).limit(most)
    out = n.groupBy(variable).agg(*[F.coalesce(F.sum(F.when(F.col(target) == v, F.col("n"))), F.lit(0)).alias(v) for v in values], F.sum("n").alias("total"))
    v = F.col(variable)
    rank = F.when(v.isNull(), 99).when(v == "*Unspecified", 98).when(v.rlike("(?i)(ICU|MICU|SICU|CVICU|NEURO ICU|NICU)"), 0).otherwise(2)
    return out.withColumn("rank", rank)


def missed_share(everyone: DataFrame, found: DataFrame, key: str, label: str) -> DataFrame:
    """Per label: keys that a rule missed, all keys, and the share."""
    left = everyone.join(found.select(key).distinct(), key, "left_anti").groupBy(F.col(label).alias("_m")).agg(F.count("*").alias("missed"))
    n = everyone.groupBy(label).agg(F.count("*").alias("total"))
    out = n.join(left, F.col(label).eqNullSafe(F.col("_m")), "left").drop("_m").na.fill(0, ["missed"])
    return out.withColumn("share", F.col("missed") / F.col("total"))


def death_rates(df: DataFrame, by: Sequence[str], death: str) -> DataFrame:
    """n, deaths and the percentage of deaths by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(death).alias("deaths"), F.round(F.avg(death) * 100, 1).alias("death_pct"))


def age_band(age: Column) -> Column:
    return F.when(age < 18, "Pediatric").when(age < 65, "Adult").otherwise("Elderly")


def hospital_acquired(instant: str, admitted: str, hours: float = 48) -> Column:
    """Whether the instant is later than `hours` after admission; null without either."""
    return F.col(instant) > plus_hours(admitted, hours)


def delay_cohort(lag: Column, late: float = 20, soon: float = 3) -> Column:
    return F.when(lag >= late, "delayed").when(lag <= soon, "timely").otherwise("average")


def fever_pattern(first_fever: Column, onset: Column) -> Column:
    """Whether fever came before organ failure, after it (or at once), or not at all."""
    return F.when(first_fever.isNull(), "no fever").when(first_fever < onset, "fever first").otherwise("failure first")


# -- episodes


def anchor_episodes(events: DataFrame, anchors: DataFrame, key: str, ts: str, anchor: str) -> DataFrame:
    """Events with the latest anchor at or before them (those without are left out) and an id of key and anchor."""
    hit = asof_join(events, anchors.select(key, anchor).distinct(), [key], ts, anchor, []).where(f"r_{anchor} is not null")
    return hit.withColumnRenamed(f"r_{anchor}", "episode_start").withColumn("episode_id", F.concat_ws("_", F.col(key).cast("string"), F.col("episode_start").cast("string")))


def cohort_summary(df: DataFrame, key: str, episode: str, ts: str, score: str) -> DataFrame:
    """One row: keys, episodes, events, quartiles of events per episode, median first and peak score, episodes that reach 1 and 2."""
    per = df.groupBy(episode).agg(F.count("*").alias("n"), F.min_by(score, F.struct(ts, score)).alias("first"), F.max(score).alias("peak"))
    total = df.agg(F.countDistinct(key).alias("n_keys"), F.count("*").alias("n_events"))
    eps = per.agg(F.count("*").alias("n_episodes"), F.count_if(F.col("peak") >= 1).alias("reach_1"), F.count_if(F.col("peak") >= 2).alias("reach_2"))
    q = [quantiles(per, [], "n", {"p25_events": 0.25, "median_events": 0.5, "p75_events": 0.75}), quantiles(per, [], "first", {"median_first": 0.5}), quantiles(per, [], "peak", {"median_peak": 0.5})]
    return reduce(lambda a, b: a.crossJoin(b), [total, eps, *q])  # one row each


def score_distributions(df: DataFrame, episode: str, ts: str, score: str) -> DataFrame:
    """Counts of scores over all events, of the peak and of the first score per episode: kind, score, n."""
    per = df.groupBy(episode).agg(F.max(score).alias("peak"), F.min_by(score, F.struct(ts, score)).alias("first"))
    parts = [df.select(F.lit("events").alias("kind"), F.col(score).alias("score")), per.select(F.lit("peak").alias("kind"), F.col("peak").alias("score")), per.select(F.lit("first").alias("kind"), F.col("first").alias("score"))]
    return _union(parts).groupBy("kind", "score").agg(F.count("*").alias("n"))


def flag_prevalence(df: DataFrame, episode: str, ts: str, flags: Sequence[str]) -> DataFrame:
    """Per flag: its share of all events, of first events and of episodes that ever have it."""
    whole = df.agg(*[F.avg(f).alias(f) for f in flags]).select(F.lit("events").alias("of"), *flags)
    first = first_rows(df, [episode], [F.col(ts), *[F.col(f) for f in flags]])
    first = first.agg(*[F.avg(f).alias(f) for f in flags]).select(F.lit("first").alias("of"), *flags)
    peak = df.groupBy(episode).agg(*[F.max(f).alias(f) for f in flags]).agg(*[F.avg(f).alias(f) for f in flags]).select(F.lit("peak").alias("of"), *flags)
    long = _union([whole, first, peak]).unpivot(["of"], list(flags), "flag", "share")
    return long.groupBy("flag").agg(*[F.max(F.when(F.col("of") == k, F.col("share"))).alias(k) for k in ("events", "first", "peak")])


def durations_by_state(df: DataFrame, state: str, hours: str, cap: float | None = None, censored: str | None = None) -> DataFrame:
    """Per state: n, median, quartiles and P90 of the hours up to the cap that aren't censored, and how many are."""
    cens = F.coalesce(F.col(censored), F.lit(False)) if censored else F.lit(False)
    used = df.where(~cens & (F.col(hours) <= cap if cap is not None else F.col(hours).isNotNull()))
    n = df.groupBy(state).agg(F.count_if(cens).alias("n_censored"))
    q = quantiles(used, [state], hours, {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    return join_groups(join_groups(n, used.groupBy(state).agg(F.count("*").alias("n")), [state]).na.fill(0, ["n"]), q, [state])


def spells_around(spell: DataFrame, anchors: DataFrame, key: str, state: str, states: Sequence[str], anchor: str, hours: float = 72) -> DataFrame:
    """Per key and anchor, of the spells (start, hours) of more than no length that start within ±hours: count, total, longest and shortest of each state (null if none)."""
    near = band_join(anchors.select(key, anchor).distinct(), spell.where("hours > 0"), [key], anchor, "start", hours, hours)
    cols = []
    for s in states:
        mine = F.when(F.col(state) == s, F.col("hours"))
        cols += [F.count(mine).alias(f"n_{s}"), F.coalesce(F.sum(mine), F.lit(0.0)).alias(f"total_{s}"), F.max(mine).alias(f"longest_{s}"), F.min(mine).alias(f"shortest_{s}")]
    return near.groupBy(key, anchor).agg(*cols)


def courses(df: DataFrame, keys: Sequence[str], ts: str, first: Column, last: Column, bucket: float | None = None) -> DataFrame:
    """Numbered courses of each key: every first marker starts one; its first and earliest last time, and the hours between (rows of one instant by first marker).

    With `bucket` (hours, see `scan.bucket_hours`) a long key is dealt out by time; so in the functions below.
    """
    d = df.select(*keys, ts, (~F.coalesce(first, F.lit(False))).alias("_later"), F.coalesce(last, F.lit(False)).alias("_l"))
    d = running_sum(d, keys, ts, [ts, "_later"], (~F.col("_later")).cast("int"), "course", bucket)
    out = d.groupBy(*keys, "course").agg(F.min(F.when(~F.col("_later"), F.col(ts))).alias("first_time"), F.min(F.when(F.col("_l"), F.col(ts))).alias("last_time"))
    return out.withColumn("hours", hours_between("first_time", "last_time")).where("hours is not null")


def state_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str, state: str, short: float, bucket: float | None = None) -> DataFrame:
    """Intervals with their hours, the hours to the next one, and the state with those shorter than `short` taken from the interval before (at the start: after)."""
    hours = hours_between(start, end)
    d = shifted(df, keys, start, {"_next": (start, 1)}, [end, state], bucket).withColumn("hours", hours).withColumn("gap_hours", hours_between(end, "_next"))
    d = d.withColumn("_k", F.when(F.col("hours") >= short, F.col(state)))
    # where no interval up to this one is long enough, the next that is is the key's first
    place = F.when(F.col("_k").isNotNull(), F.struct(start, end, state))
    d = with_group(d, keys, {"_first": F.min_by("_k", place)})
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(start, end, state).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_last", F.last("_k", True).over(w))
    else:
        d = last_known(d.withColumn("_b", bucket_of(start, bucket)), keys, "_k", [F.col(c) for c in (start, end, state)], F.max_by("_k", place), "_last").drop("_b")
    return d.withColumn("kept_state", F.coalesce("_last", "_first")).drop("_next", "_k", "_last", "_first")


def overlap_pattern(a_start: str, a_end: str, b_start: str, b_end: str) -> Column:
    """How two overlapping intervals lie: which contains the other, or which starts first; null if they don't overlap."""
    a, z, b, y = (F.col(c) for c in (a_start, a_end, b_start, b_end))
    how = F.when((a <= b) & (z >= y), "a_contains_b").when((b <= a) & (y >= z), "b_contains_a").when((a < b) & (z < y), "a_first_b_last").when((b < a) & (y < z), "b_first_a_last")
    return F.when((a < y) & (b < z), how)


def combined_states(segments: DataFrame, keys: Sequence[str], start: str, end: str, a: str, b: str, bucket: float | None = None) -> DataFrame:
    """Episodes of equal combined state of adjacent segments: keys, episode, state, start, end, hours (summed over the segments)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    s = segments.withColumn("state", F.concat(F.lit(f"{a}="), text(a), F.lit(f"|{b}="), text(b)))
    s = shifted(s, keys, start, {"_p": ("state", -1)}, bucket=bucket).withColumn("_c", (~F.col("state").eqNullSafe(F.col("_p"))).cast("int"))
    s = running_sum(s, keys, start, [start], F.col("_c"), "episode", bucket)
    return s.groupBy(*keys, "episode").agg(F.first("state").alias("state"), F.min(start).alias("start"), F.max(end).alias("end"), F.sum(hours_between(start, end)).alias("hours"))


def state_time(episodes: DataFrame) -> DataFrame:
    """Per state: episodes, total, mean and median hours."""
    n = episodes.groupBy("state").agg(F.count("*").alias("n"), F.sum("hours").alias("total_hours"), F.avg("hours").alias("mean_hours"))
    return join_groups(n, quantiles(episodes, ["state"], "hours", {"median_hours": 0.5}), ["state"])


def state_transitions(episodes: DataFrame, keys: Sequence[str], bucket: float | None = None) -> DataFrame:
    """state, next_state, n, total and mean hours in the source before the change."""
    t = shifted(episodes, keys, "start", {"next_state": ("state", 1)}, ["episode"], bucket).where("next_state is not null and next_state <> state")
    return t.groupBy("state", "next_state").agg(F.count("*").alias("n"), F.sum("hours").alias("total_hours"), F.avg("hours").alias("mean_hours"))


# -- severity


def due_to(pairs: Sequence[tuple[str, str]]) -> Column:
    """Names of the flags that are 1, comma-joined in the given order; flags as (name, column)."""
    return F.concat_ws(",", *[F.when(F.col(c) == 1, F.lit(n)) for n, c in pairs])


def escalation(first: DataFrame, key: str, instant: str, tables: Mapping[str, tuple[DataFrame, str]], ts: str, days: float = 14) -> DataFrame:
    """Per key and first instant: for each (name, (table, flag)) the first time of a flag above 0 within `days` from the instant, or null."""
    out = first.select(key, instant).distinct()
    for name, (df, flag) in tables.items():
        on = df.where(F.col(flag) > 0).select(key, F.col(ts).alias("_t")).distinct()
        hit = band_join(first.select(key, instant).distinct(), on, [key], instant, "_t", 0, 24 * days).groupBy(key, instant).agg(F.min("_t").alias(f"{name}_time"))
        out = out.join(hit, [key, instant], "left")
    return out


def chained_shock(infect: DataFrame, organ: DataFrame, shock: DataFrame, key: str, infect_dt: str, ts: str, organ_hours: float = 48, before: float = 6, after: float = 24) -> DataFrame:
    """Older chain: organ failure within ±hours of infection, then shock from `before` to `after` hours around it; per key the first by (shock, organ, infection) and the least of the three times."""
    one = band_join(infect.select(key, infect_dt).distinct(), organ.select(key, F.col(ts).alias("organ_time")).distinct(), [key], infect_dt, "organ_time", organ_hours, organ_hours)
    two = band_join(one, shock.select(key, F.col(ts).alias("shock_time")).distinct(), [key], "organ_time", "shock_time", before, after)
    first = two.groupBy(key).agg(F.min(F.struct("shock_time", "organ_time", infect_dt)).alias("p")).select(key, "p.*")
    return first.withColumn("earliest", F.least("shock_time", "organ_time", infect_dt))


def criteria_at(anchors: DataFrame, events: DataFrame, key: str, at: str, ts: str, group: str, value: str, criteria: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Anchors with a 0/1 flag per criterion (an event of its group within its hours before), their sum and whether it is 2 or more; `events` holds abnormal ones only."""
    t = anchors.select(key, F.col(at).alias(ts)).distinct()
    n = lookback(t, events, key, ts, group, value, {f"{c}_flag": (g, "count", h) for c, (g, h) in criteria.items()})
    flags = [f"{c}_flag" for c in criteria]
    n = n.withColumns({f: (F.col(f) > 0).cast("int") for f in flags}).withColumn("criteria", sum((F.col(f) for f in flags), F.lit(0)))
    return n.withColumn("positive", (F.col("criteria") >= 2).cast("int")).withColumnRenamed(ts, at)


# -- rows


def drill_down(df: DataFrame, key: str, value, ts: str, center: str | None = None, back: float = 0, ahead: float = 0) -> DataFrame:
    """The rows of one key, by time; with a center only those from `back` hours before it to `ahead` hours after it."""
    out = df.where(F.col(key) == value)
    if center is not None:
        mid = F.lit(center).cast("timestamp_ntz")
        gap = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{center}', `{ts}`)") / 3_600_000_000
        out = out.where(mid.isNotNull() & gap.between(-back, ahead))
    return out.orderBy(ts)


def conflicts(values: DataFrame, features: DataFrame, keys: Sequence[str], value: str, feature: str) -> DataFrame:
    """Rows whose raw value and feature differ at the same key and instant."""
    return values.select(*keys, value).join(features.select(*keys, feature), list(keys)).where(F.col(value) != F.col(feature))


def value_changes(before: DataFrame, after: DataFrame, row: str, group: str, value: str) -> DataFrame:
    """Per group: rows with a value before and none after, joined by row id, and all its values before."""
    j = before.select(row, group, F.col(value).alias("_a")).join(after.select(row, F.col(value).alias("_b")), row)
    return j.groupBy(group).agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("nulled"), F.count("_a").alias("values"))


def outer_all(frames: Sequence[DataFrame], on: Sequence[str], defaults: Mapping[str, object] = {}) -> DataFrame:
    """Full outer join of all frames on shared keys, nulls of the named columns filled."""
    out = reduce(lambda a, b: a.join(b, list(on), "full"), frames)
    return out.na.fill(dict(defaults)) if defaults else out


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


#: Event classes of the timeline, as (group names, kinds, (group, text) pairs).
EVENT_CLASSES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    "suspected_infection": (("Code Sepsis Page", "Blood Culture Order", "Lactate"), ("IV Antibiotics",), (("Suspected Infection", "Yes"),)),
    "sirs_events": (("WBC", "Temperature", "Pulse", "Respirations"), (), ()),
    "organ_dysf": (("Creatinine", "Bilirubin", "Platelets", "Lactate", "INR", "APTT", "Vent on Documentation", "Vent off Documentation", "Arterial Blood Pressure Mean", "eGFR", "O2 Delivery High-Flow Nasal Cannula", "O2 Delivery Mechanical Ventilation", "Glascow Coma Score"), (), ()),
    "septic_shock": (("Lactate", "Systolic Blood Pressure", "Norepinephrine", "Vasopressin", "Epinephrine", "Phenylephrine"), (), ()),
}


def timeline(events: DataFrame, key: str, ts: str, group: str, kind: str, text: str, classes: Mapping = EVENT_CLASSES) -> DataFrame:
    """Distinct (key, time, class) of all events that belong to a class; one pass, an event may belong to several."""
    hits = []
    for name, (groups, kinds, pairs) in classes.items():
        cond = F.col(group).isin(*groups)
        for k in kinds:
            cond = cond | (F.col(kind) == k)
        for g, t in pairs:
            cond = cond | ((F.col(group) == g) & (F.col(text) == t))
        hits.append(F.when(cond, F.lit(name)))
    return events.select(key, ts, F.explode(F.array_compact(F.array(*hits))).alias("event_class")).distinct()


#: Classifiers of event names, each as (all of, none of), patterns over the lower-cased name.
CLASSIFIERS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "culture_positive": (("result", "culture|bcid", "staph|strep|coli|klebsiella|pseudomonas|enterococcus|candida|aspergillus|bacteroides|clostridium|serratia|proteus|acinetobacter|citrobacter|enterobacter|detected|positive"), "contamina"),
    "culture_order": (("order", "culture", "procedure"), None),
    "antibiotic_iv": (("__antibiotics$", r"\biv\b|intravenous|infusion|injection|push|piggy back"), "dialysis|heparin|lock solution|chemo|rubicin|epoch|intravitreal|intrapleural|alteplase|activase"),
    "incision": (("procedure", "incision|debrid"), None),
    "drain": (("procedure", "drain"), None),
    "vasopressor": (("norepinephrine|levophed|vasopressin|vasostrict|phenylephrine|neo-synephrine|dopamine|epinephrine|adrenaline|giapreza|angiotensin",), r"push dose|bolus|\b10 mg\b|\b1 mg\b|__other"),
    "fungal": (("candida|aspergillus|cryptococcus|histoplasma|blastomyces|coccidioides|pneumocystis",), "candidate|prophylaxis|screening|history of|exposure to"),
    "mimic": (("cancer|pulmonary embolism|metast|neoplasm|tumor|malignan|lysis|neuroleptic|rhabdomyolysis|hypercalcemia",), None),
    "noise": ((r"history|screening|risk|anxiety|pain|candidate|encounter|suspected|prophylaxis|benign|uncertain|elevated|psa|abnormal|fatigue|\bhx\b|\bh/o\b|\bs/p\b",), None),
    "sepsis_after_all": (("septic|peritonitis|empyema|abscess|infection.*(dialysis|graft|catheter)|(dialysis|graft|catheter).*infection",), None),
}


def classify(name: Column, classifiers: Mapping[str, tuple[tuple[str, ...], str | None]] = CLASSIFIERS) -> dict[str, Column]:
    """A 0/1 column for each classifier of an event's full name (kind__name__group); a null name is in none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = {}
    for k, (every, none) in classifiers.items():
        hit = reduce(lambda a, b: a & b, [low.rlike(p) for p in every])
        out[k] = (hit & ~low.rlike(none) if none else hit).cast("int")
    return out


def instant_spells(df: DataFrame, keys: Sequence[str], ts: str, score: str) -> DataFrame:
    """Spells of the highest score of each instant."""
    top = df.groupBy(*keys, ts).agg(F.max(score).alias(score))
    return spells(top, keys, ts, score)
