"""Joins, windows and spells over (key, time, value) tables.

As-of and look-back operators are one union and one window over the key instead of an inequality
join: a single shuffle and sort serves any number of features.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import HOUR, micros
from tidemark.operators.ranks import quantiles
from tidemark.operators.scan import bucket_of, dealt, last_known, numbered_runs, own, running_sum


def _us(hours: float) -> int:
    return round(hours * HOUR)


def _whole(keys: Sequence[str]) -> Column:
    """Whether no key of a row is null; a join never matches null keys."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, take: Sequence[str], forward: bool = False, hours: float | None = None, bucket: float | None = None) -> DataFrame:
    """Each left row with the nearest right row of its keys at or before (forward: after) its time.

    Equal times match. Ties on the right go to the last (forward: first) by (time, taken columns).
    Beyond `hours`, and for a null key or time, the taken columns and `rt` are null. Either direction
    is one pass: rows are ordered toward the left row, so the window only looks back. With `bucket`
    (hours, see `scan.bucket_hours`) a long key is dealt out by time and no window spans it.
    """
    keys, n = list(keys), [f"r_{c}" for c in take]
    body = F.struct(F.col(rt).alias("t"), *[F.col(c).alias(f"r_{c}") for c in take])
    # left rows with a null key have no partner; they are dealt out by time instead of meeting in one group
    lone = F.when(~_whole(keys), F.xxhash64(lt))
    l = left.select(*keys, lone.alias("_lone"), F.col(lt).alias("_t"), F.lit(True).alias("_left"), F.struct(*left.columns).alias("_row"))
    r = right.where(F.col(rt).isNotNull() & _whole(keys)).select(*keys, F.lit(None).cast("long").alias("_lone"), F.col(rt).alias("_t"), F.lit(False).alias("_left"), body.alias("_hit"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = [F.col("_t").desc_nulls_first(), F.col("_left"), F.col("_hit").desc()] if forward else [F.col("_t"), F.col("_left"), F.col("_hit")]
    if bucket is None:
        w = Window.partitionBy(*keys, "_lone").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_near", F.last("_hit", True).over(w)).where("_left")
    else:
        last = F.min("_hit") if forward else F.max("_hit")
        out = last_known(both.withColumn("_b", bucket_of("_t", bucket)), [*keys, "_lone"], "_hit", order, last, "_near", forward).where("_left")
    if hours is not None:
        gap = F.abs(F.expr("timestampdiff(MICROSECOND, _near.t, _t)"))
        out = out.withColumn("_near", F.when(gap <= _us(hours), F.col("_near")))
    return out.select("_row.*", F.col("_near.t").alias(f"r_{rt}"), *[F.col(f"_near.{c}") for c in n])


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, before: float, after: float, bucket: bool = True) -> DataFrame:
    """Pairs with right time in [left - before, left + after] hours, both bounds included.

    Left rows go to the (two at most) time buckets they touch, so that a long key is joined bucket by
    bucket, not every row with every other; without `bucket` the key alone is joined on.
    """
    l, r = left.alias("l"), right.alias("r")
    span = F.expr(f"timestampdiff(MICROSECOND, l.`{lt}`, r.`{rt}`)").between(-_us(before), _us(after))
    same = None
    for k in keys:
        c = F.col(f"l.{k}") == F.col(f"r.{k}")
        same = c if same is None else same & c
    if bucket:
        width = max(_us(before + after), HOUR)
        lo, hi = F.floor((micros(lt) - _us(before)) / width), F.floor((micros(lt) + _us(after)) / width)
        l = left.withColumn("_b", F.explode(F.sequence(lo, hi))).alias("l")
        r = right.withColumn("_b", F.floor(micros(rt) / width)).alias("r")
        same = same & (F.col("l._b") == F.col("r._b"))
    joined = l.join(r, same & span)
    return joined.select(*[f"l.{c}" for c in left.columns], *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def lookback(timeline: DataFrame, events: DataFrame, key: str, ts: str, group: str, value: str, features: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """The timeline with one column per feature: name -> (group, aggregate, hours), over [t - hours, t].

    Aggregates: max, min, mean, sum, count, first, last. `last` is the largest value of the latest
    instant, `first` the smallest of the earliest; that instant counts even if its value is null. Events
    of a null key match nothing. Rows are dealt by key and buckets of four times the longest look-back,
    an event to each bucket (two at most) that looks back to it, so no window spans a long key.
    """
    if not features:
        return timeline.select(key, ts).distinct()
    far = max(_us(hours) for _, _, hours in features.values())
    of = lambda c: F.floor(c / max(4 * far, HOUR))
    t = timeline.select(key, ts).distinct().withColumn("_base", F.lit(True)).withColumn("_us", micros(ts)).withColumn("_b", of(F.col("_us")))
    groups = sorted({g for g, _, _ in features.values()})
    e = events.select(key, ts, group, value).where(F.col(ts).isNotNull() & F.col(key).isNotNull() & F.col(group).isin(*groups)).withColumn("_us", micros(ts))
    e = e.withColumn("_b", F.explode(F.sequence(of(F.col("_us")), of(F.col("_us") + far))))
    both = t.unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy("_us")
    # the latest event so far grows with the rows, whatever the hours: its age is tested after
    sofar = w.rangeBetween(Window.unboundedPreceding, 0)
    latest = {g: f"_last{i}" for i, g in enumerate(sorted({g for g, how, _ in features.values() if how == "last"}))}
    both = both.withColumns({c: F.max(F.when(F.col(group) == g, F.struct("_us", value))).over(sofar) for g, c in latest.items()})
    cols = {}
    for name, (g, how, hours) in features.items():
        over = w.rangeBetween(-_us(hours), 0)
        hit = F.when(F.col(group) == g, F.col(value))
        if how == "last":
            cols[name] = F.when(F.col(latest[g])["_us"] >= F.col("_us") - _us(hours), F.col(latest[g])[value])
        elif how == "first":
            cols[name] = F.min(F.when(F.col(group) == g, F.struct("_us", value))).over(over)[value]
        else:
            cols[name] = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count}[how](hit).over(over)
    return both.withColumns(cols).where("_base").select(key, ts, *features)


def _with_carried(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, tie: Sequence[str], backward: bool, bucket: float | None) -> DataFrame:
    """`df` with `out`: `_carried`, in one window over the key or, with `bucket`, one over each time bucket."""
    if bucket is None:
        return df.withColumn(out, _carried(keys, ts, value, tie, backward))
    hit = F.when(F.col(value).isNotNull(), F.struct(micros(ts).alias("t"), F.col(value).alias("v")))
    rows = df.withColumns({"_hit": hit, "_b": bucket_of(ts, bucket)})
    # of a bucket's values the last one: the largest (backward: smallest) by time, tie and value; nulls go first either way
    place = F.when(F.col(value).isNotNull(), F.struct(*[x for c in (ts, *tie) for x in (F.col(c).isNull().alias(f"n_{c}") if backward else F.col(c).isNotNull().alias(f"n_{c}"), F.col(c))], F.col(value)))
    last = (F.min_by if backward else F.max_by)("_hit", place)
    return last_known(rows, keys, "_hit", _fill_order(ts, value, tie, backward), last, out, backward).drop("_hit", "_b")


def _fill_order(ts: str, value: str, tie: Sequence[str], backward: bool) -> list[Column]:
    # within one instant values come before nulls, which are filled from them
    if backward:
        return [*[F.col(c).desc_nulls_first() for c in (ts, *tie)], F.col(value).desc_nulls_last()]
    return [*[F.col(c) for c in (ts, *tie)], F.col(value).asc_nulls_last()]


def _carried(keys: Sequence[str], ts: str, value: str, tie: Sequence[str], backward: bool) -> Column:
    """(t, v) of the last non-null value up to each row, rows taken by (time, tie, value); backward: from the end."""
    hit = F.when(F.col(value).isNotNull(), F.struct(micros(ts).alias("t"), F.col(value).alias("v")))
    w = Window.partitionBy(*keys).orderBy(*_fill_order(ts, value, tie, backward))
    return F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_forward(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, hours: float | Column | None = None, backward: bool = False, tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """The last non-null value at or before each row (backward: next at or after), not older than `hours`.

    `hours` may be a column: a limit for each row, beyond which (or where it is null) nothing is carried.
    Rows of one instant are taken by `tie`, then by value, nulls last. `bucket` as in `asof_join`.
    """
    df = _with_carried(df, keys, ts, value, "_near", tie, backward, bucket)
    age = F.abs(micros(ts) - F.col("_near.t"))
    if hours is None:
        fresh = F.lit(True)
    else:
        fresh = age <= (hours * HOUR if isinstance(hours, Column) else _us(hours))
    return df.withColumn(out, F.when(fresh, F.col("_near.v"))).drop("_near")


def fill_expiring(df: DataFrame, keys: Sequence[str], group: str, ts: str, value: str, out: str, limits: Mapping[str, float], tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """Each null value from the last one of its key and group, while that is not older than the group's limit.

    A group without a limit keeps its own values and is not filled.
    """
    limit = F.lit(None).cast("double")
    for g, hours in limits.items():
        limit = F.when(F.col(group) == g, F.lit(float(hours))).otherwise(limit)
    filled = fill_forward(df, [*keys, group], ts, value, "_x", limit, tie=tie, bucket=bucket)
    return filled.withColumn(out, F.coalesce("_x", value)).drop("_x")


def fill_nearest(df: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, hours: float, tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """Null values from the nearer of the values before and after within `hours`; the earlier one on a tie."""
    df = _with_carried(_with_carried(df, keys, ts, value, "_p", tie, False, bucket), keys, ts, value, "_n", tie, True, bucket)
    back, ahead = micros(ts) - F.col("_p.t"), F.col("_n.t") - micros(ts)
    far = F.lit(2**62)
    best = F.when(F.coalesce(back, far) <= F.coalesce(ahead, far), F.when(back <= _us(hours), F.col("_p.v"))).otherwise(F.when(ahead <= _us(hours), F.col("_n.v")))
    return df.withColumn(out, best).drop("_p", "_n")


def rolling(df: DataFrame, keys: Sequence[str], ts: str, exprs: Mapping[str, Column], before: float, after: float = 0, left_closed: bool = False) -> DataFrame:
    """Aggregates over [t - before, t + after] hours; left_closed leaves the current instant out.

    Rows are dealt by key and buckets of four times the window, each to the buckets (two at most) whose
    rows may look at it, so no window spans a long key. Rows without a time see each other.
    """
    end = _us(after) - (1 if left_closed else 0)
    of = lambda c: F.floor(c / max(4 * _us(before + after), HOUR))
    us = df.withColumn("_us", micros(ts))
    buckets = F.sequence(of(F.col("_us") - _us(after)), of(F.col("_us") + _us(before)))
    dealt = us.withColumn("_b", F.explode(F.when(F.col("_us").isNull(), F.array(F.lit(None).cast("long"))).otherwise(buckets)))
    w = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-_us(before), end)
    return dealt.withColumns({n: e.over(w) for n, e in exprs.items()}).where(of(F.col("_us")).eqNullSafe(F.col("_b"))).drop("_us", "_b")


def spells(df: DataFrame, keys: Sequence[str], ts: str, state: str, bucket: float | None = None) -> DataFrame:
    """Runs of equal state: keys, spell (from 1), state, start, end, n, hours. Rows of one instant are ordered by state; `bucket` as in `asof_join`."""
    if bucket is not None:
        parts = numbered_runs(df, keys, ts, state, bucket)
        out = parts.groupBy(*keys, "spell").agg(F.first(state).alias(state), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        return out.withColumn("hours", (micros("end") - micros("start")) / HOUR)
    w = Window.partitionBy(*keys).orderBy(ts, state)
    change = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(ts).over(w).isNull()).cast("int")
    run = df.withColumn("_c", change).withColumn("spell", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy(*keys, "spell").agg(F.first(state).alias(state), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    return out.withColumn("hours", (micros("end") - micros("start")) / HOUR)


def bridged_spells(df: DataFrame, keys: Sequence[str], ts: str, state: str, hours: float, bucket: float | None = None) -> DataFrame:
    """Spells after those shorter than `hours` between two equal states take the state around them. `bucket` as in `asof_join`."""
    s, w = dealt(spells(df, keys, ts, state, bucket), keys, "start", ["spell"], bucket, 1, 1)
    before, after = F.lag(state).over(w), F.lead(state).over(w)
    s = own(s.withColumn("_new", F.when((F.col("hours") < hours) & (before == after), before).otherwise(F.col(state))))
    s, w = dealt(s, keys, "start", ["spell"], bucket, 1)
    s = own(s.withColumn("_c", (~F.col("_new").eqNullSafe(F.lag("_new").over(w)) | F.lag("spell").over(w).isNull()).cast("int")))
    s = running_sum(s, keys, "start", ["spell"], F.col("_c"), "_s", bucket)
    out = s.groupBy(*keys, F.col("_s").alias("spell")).agg(F.first("_new").alias(state), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return out.withColumn("hours", (micros("end") - micros("start")) / HOUR)


def run_durations(df: DataFrame, keys: Sequence[str], ts: str, state: str, bucket: float | None = None) -> DataFrame:
    """Spells whose end is the first row of the next one; the last one is censored at its last row. `bucket` as in `asof_join`."""
    s = spells(df, keys, ts, state, bucket)
    if bucket is None:
        s = s.withColumn("_next", F.lead("start").over(Window.partitionBy(*keys).orderBy("spell")))
    else:  # each spell and the start of the one after it meet under its number
        after = s.select(*keys, (F.col("spell") - 1).alias("spell"), F.col("start").alias("_next"))
        each = [F.max(c).alias(c) for c in (state, "start", "end", "n", "hours", "_next")]
        s = s.unionByName(after, allowMissingColumns=True).groupBy(*keys, "spell").agg(*each).where("spell > 0")
    s = s.withColumn("censored", F.col("_next").isNull()).withColumn("end", F.coalesce("_next", "end"))
    return s.withColumn("hours", (micros("end") - micros("start")) / HOUR).drop("_next")


def episodes(df: DataFrame, keys: Sequence[str], ts: str, on: Column, off: Column, bucket: float | None = None) -> DataFrame:
    """ON to next OFF, the first of repeated ONs; an unclosed one is INCOMPLETE; OFF alone is dropped. `bucket` as in `asof_join`."""
    m = df.select(*keys, ts, F.when(on, F.lit("1")).when(off, F.lit("0")).alias("_m")).where("_m is not null")
    m, w = dealt(m, keys, ts, [ts, "_m"], bucket, 1)
    turn = own(m.withColumn("_p", F.lag("_m").over(w))).where("_p is null or _p <> _m").drop("_p")
    turn, w = dealt(turn, keys, ts, [ts, "_m"], bucket, 0, 1)
    out = own(turn.withColumn("end", F.lead(ts).over(w))).where("_m = '1'")
    return out.select(*keys, F.col(ts).alias("start"), "end", F.when(F.col("end").isNull(), "INCOMPLETE").otherwise("COMPLETE").alias("status"))


def shifted(df: DataFrame, keys: Sequence[str], ts: str, columns: Mapping[str, tuple[str, int]], tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """`df` with name -> (column, steps): the column's value that many rows on (negative: back) along each key, null past its ends.

    Rows of one instant are taken by `tie`, which should settle their order. `bucket` as in `asof_join`.
    """
    steps = [n for _, n in columns.values()]
    rows, w = dealt(df, keys, ts, [ts, *tie], bucket, max([0, *[-n for n in steps]]), max([0, *steps]))
    return own(rows.withColumns({name: F.lead(c, n).over(w) for name, (c, n) in columns.items()}))


def sojourns(df: DataFrame, keys: Sequence[str], ts: str, state: str, bucket: float | None = None) -> DataFrame:
    """State and hours to the next event; times of 0 or below are dropped. `bucket` as in `asof_join`."""
    out = shifted(df.select(*keys, ts, state), keys, ts, {"_n": (ts, 1)}, [state], bucket).withColumn("hours", (micros("_n") - micros(ts)) / HOUR)
    return out.where("hours > 0").select(*keys, ts, state, "hours")


def transitions(df: DataFrame, keys: Sequence[str], ts: str, state: str, loops: bool = False, bucket: float | None = None) -> DataFrame:
    """from_state, to_state, n, share of the row; self loops only if asked for. `bucket` as in `asof_join`."""
    t = shifted(df.select(*keys, ts, state), keys, ts, {"to_state": (state, 1)}, [state], bucket)
    t = t.select(F.col(state).alias("from_state"), "to_state").where("from_state is not null and to_state is not null")
    n = (t if loops else t.where("from_state <> to_state")).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def path_edges(df: DataFrame, keys: Sequence[str], ts: str, state: str, min_count: int = 1, normalise: bool = False, bucket: float | None = None) -> DataFrame:
    """Numbered steps of each key's path of changes: step, from_state, to_state, n, and with `normalise` the share of the step. `bucket` as in `asof_join`."""
    changed = shifted(df.select(*keys, ts, state), keys, ts, {"_p": (state, -1)}, [state], bucket).where(f"_p is null or _p <> `{state}`").drop("_p")
    step = running_sum(changed, keys, ts, [ts, state], F.lit(1), "step", bucket).withColumn("step", F.col("step").cast("int"))
    step = shifted(step, keys, ts, {"to_state": (state, 1)}, [state], bucket).where("to_state is not null")
    n = step.groupBy("step", F.col(state).alias("from_state"), "to_state").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("step"))) if normalise else n


def values_at(df: DataFrame, keys: Sequence[str], ts: str, start: str, value: str, offsets: Sequence[float]) -> DataFrame:
    """keys, offset, value: the last value carried to each offset (hours after start); one aggregate, rows are not multiplied."""
    h = df.where(micros(ts) >= micros(start)).withColumn("_h", micros(ts) - micros(start))
    last = h.groupBy(*keys).agg(*[F.max(F.when(F.col("_h") <= _us(o), F.struct("_h", value))).alias(f"_{i}") for i, o in enumerate(offsets)])
    each = F.array(*[F.struct(F.lit(float(o)).alias("offset"), F.col(f"_{i}").isNotNull().alias("any"), F.col(f"_{i}.{value}").alias(value)) for i, o in enumerate(offsets)])
    return last.select(*keys, F.explode(each).alias("_x")).where("_x.any").select(*keys, "_x.offset", f"_x.{value}")


def trajectory(df: DataFrame, keys: Sequence[str], ts: str, start: str, value: str, offsets: Sequence[float]) -> DataFrame:
    """For each offset (hours after start): n, median, p25, p75 of the last value carried to it."""
    at = values_at(df, keys, ts, start, value, offsets)
    q = quantiles(at, ["offset"], value, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    return at.groupBy("offset").agg(F.count(value).alias("n")).join(q, "offset", "left")


def state_shares(df: DataFrame, keys: Sequence[str], ts: str, start: str, state: str, offsets: Sequence[float]) -> DataFrame:
    """For each offset and state: n keys in it, and their share of the offset."""
    n = values_at(df, keys, ts, start, state, offsets).groupBy("offset", state).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("offset")))


def interval_lookup(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, take: Sequence[str], bucket: float | None = None) -> DataFrame:
    """The taken columns of the interval [start, end] (open if end is null) that began last at or before the point. `bucket` as in `asof_join`."""
    hit = asof_join(points, intervals, keys, ts, start, [end, *take], bucket=bucket)
    inside = F.col(f"r_{start}").isNotNull() & (F.col(f"r_{end}").isNull() | (F.col(ts) <= F.col(f"r_{end}")))
    return hit.select(*points.columns, *[F.when(inside, F.col(f"r_{c}")).alias(c) for c in take])


def segment(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str, state: str, bucket: float | None = None) -> DataFrame:
    """Both interval sets cut at the boundaries of either: keys, start, end, a_state, b_state. `bucket` as in `asof_join`."""
    bounds = None
    for d in (a, b):
        for c in (start, end):
            x = d.select(*keys, F.col(c).alias("seg_start")).where("seg_start is not null")
            bounds = x if bounds is None else bounds.union(x)
    segs = shifted(bounds.distinct(), keys, "seg_start", {"seg_end": ("seg_start", 1)}, bucket=bucket).where("seg_end is not null")
    out = segs
    for d, name in ((a, "a_state"), (b, "b_state")):
        hit = asof_join(out, d, keys, "seg_start", start, [end, state], bucket=bucket)
        inside = F.col(f"r_{start}").isNotNull() & (F.col(f"r_{end}").isNull() | (F.col("seg_start") < F.col(f"r_{end}")))
        out = hit.select(*out.columns, F.when(inside, F.col(f"r_{state}")).alias(name))
    return out


def thin(df: DataFrame, keys: Sequence[str], ts: str, hours: float, tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """Rows at least `hours` after the row before; of one instant the first by `tie` may stay. `bucket` as in `asof_join`."""
    return shifted(df, keys, ts, {"_p": (ts, -1)}, tie, bucket).where(F.col("_p").isNull() | (micros(ts) - micros("_p") >= _us(hours))).drop("_p")


def level_gaps(df: DataFrame, keys: Sequence[str], ts: str, level: str) -> DataFrame:
    """First time of each level and hours since the level before it."""
    first = df.groupBy(*keys, level).agg(F.min(ts).alias("first_time"))
    w = Window.partitionBy(*keys).orderBy(level)
    return first.withColumn("_p", F.lag("first_time").over(w)).withColumn("gap_hours", (micros("first_time") - micros("_p")) / HOUR).drop("_p")
