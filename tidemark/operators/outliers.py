"""Cleaning of measured values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import HOUR, micros
from tidemark.operators.scan import dealt, own
from tidemark.operators.sliding import median_of_others, near_in_time, sliding_deviation, sliding_median, windows
from tidemark.operators.tables import counted


def bounded(group: str, value: str, bounds: Mapping[str, tuple[float, float]]) -> Column:
    """The value, or null where it lies outside its group's bounds (which are kept themselves)."""
    out = F.col(value)
    for g, (lo, hi) in bounds.items():
        out = F.when((F.col(group) == g) & ((F.col(value) < lo) | (F.col(value) > hi)), None).otherwise(out)
    return out


#: Fixed value: minutes added to every step, so that one within an instant has a velocity too.
EPSILON = 1e-6


def velocity_flags(df: DataFrame, keys: Sequence[str], ts: str, value: str, per_minute: float, step: float, valid_minutes: float, tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """`too_fast` and `too_far` against the value before (rows of one instant by `tie`, then value), if that is recent enough.

    A step within an instant is recent. Its velocity is over `EPSILON` minutes; a velocity of 1 / `EPSILON`
    or more is none, so such a step is too fast only if it is below 1. With `bucket` (hours, see
    `scan.bucket_hours`) a long key is dealt out by time, as in `context` and `neighbours`.
    """
    df, w = dealt(df, keys, ts, [ts, *tie, value], bucket, 1)
    minutes = (micros(ts) - F.lag(micros(ts)).over(w)) / 60e6
    delta = F.abs(F.col(value) - F.lag(value).over(w))
    df = own(df.withColumn("_m", minutes).withColumn("_d", delta))
    recent = F.col("_m") <= valid_minutes
    speed = F.col("_d") / (F.col("_m") + EPSILON)
    fast = recent & (speed > per_minute) & (speed < 1 / EPSILON)
    return df.withColumn("too_fast", F.coalesce(fast, F.lit(False))).withColumn("too_far", F.coalesce(recent & (F.col("_d") > step), F.lit(False))).drop("_m", "_d")


def robust_z(df: DataFrame, keys: Sequence[str], ts: str, value: str, before: float, after: float, scale: float = 1.4826) -> DataFrame:
    """`med`, `mad` and `robust_z`: (v - rolling median) / (scale * rolling median deviation); 0 where that deviation is 0.

    Windows are (t - before, t + after] hours: the start doesn't belong to them.
    """
    reach = round(before * HOUR), round(after * HOUR)

    def run(us: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = windows(us, *reach, open_start=True)
        med = sliding_median(v, lo, hi)
        return {"med": med, "mad": scale * sliding_median(np.abs(v - med), lo, hi)}

    # the deviations of a window come from medians of windows that reach as far again
    out = near_in_time(df, keys, ts, value, 2 * max(before, after), run, [T.StructField(c, T.DoubleType()) for c in ("med", "mad")])
    return out.withColumn("robust_z", F.when(F.col("mad") == 0, 0.0).otherwise((F.col(value) - F.col("med")) / F.col("mad")))


def _z(df: DataFrame, keys: Sequence[str], ts: str, value: str, back: float) -> DataFrame:
    """`z` by the columns `_hours` (of the window, constant for a key) and `_floor` of each row."""
    shift = round(back * HOUR)

    def run(us: np.ndarray, v: np.ndarray, hours: np.ndarray, floor: np.ndarray) -> dict[str, np.ndarray]:
        width = np.rint(hours * HOUR).astype(np.int64)
        med = sliding_median(v, *windows(us, shift, width - shift, open_start=True))
        sd = sliding_deviation(v, *windows(us, width, 0, open_end=True))
        return {"z": (v - med) / np.fmax(sd, floor)}

    reach = F.greatest(F.lit(float(back)), F.col("_hours"))
    return near_in_time(df, keys, ts, value, reach, run, [T.StructField("z", T.DoubleType())], ["_hours", "_floor"]).drop("_hours", "_floor")


def rolling_z(df: DataFrame, keys: Sequence[str], ts: str, value: str, window: float, floor: float, back: float = 2) -> DataFrame:
    """z against the median of (t - back, t - back + window] hours and the deviation (at least `floor`) of [t - window, t).

    Without two readings in the latter the deviation is `floor`.
    """
    return _z(df.withColumns({"_hours": F.lit(float(window)), "_floor": F.lit(float(floor))}), keys, ts, value, back)


def rolling_z_by_group(df: DataFrame, keys: Sequence[str], ts: str, value: str, group: str, settings: DataFrame | Mapping[str, tuple[float, float, float]], back: float = 2) -> DataFrame:
    """`z` and `outlier` (|z| above the limit) by the settings of each row's group: hours of the window, floor of the deviation, limit.

    `settings` is a mapping, or a table with one row for each group: the group's column, hours, floor,
    limit. One pass serves all groups, however many; groups without settings are left out.
    """
    if not isinstance(settings, DataFrame):
        rows = [(g, float(h), float(f), float(x)) for g, (h, f, x) in settings.items()]
        settings = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_g", df.schema[group].dataType), *[T.StructField(c, T.DoubleType()) for c in ("hours", "floor", "limit")]]))
    else:
        settings = settings.withColumnRenamed(group, "_g")
    own = settings.select("_g", F.col("hours").cast("double").alias("_hours"), F.col("floor").cast("double").alias("_floor"), F.col("limit").cast("double").alias("_limit"))
    joined = df.join(counted(own), F.col(group) == F.col("_g")).drop("_g")
    z = _z(joined, [*keys, group], ts, value, back)
    return z.withColumn("outlier", F.coalesce(F.abs("z") > F.col("_limit"), F.lit(False))).drop("_limit")


def mad_outliers(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: float = 8, least_rows: int = 5, least_near: int = 2, limit: float = 3.0, floor: float = 0.01, scale: float = 1.4826) -> DataFrame:
    """`outlier`: |v - median| / max(scale * MAD, floor) above the limit, over the rows within ±hours but this one.

    Keys with fewer than `least_rows` readings, and rows with fewer than `least_near` neighbours, have none.
    """
    reach = round(hours * HOUR)

    def run(us: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        med, mad = median_of_others(v, *windows(us, reach, reach), least_near)
        with np.errstate(invalid="ignore"):
            return {"outlier": np.abs(v - med) / np.fmax(scale * mad, floor) > limit}

    # a row for each key with enough readings; what a key has too few of doesn't pass through the windows
    names = [f"_k{i}" for i in range(len(keys))]
    many = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).count().where(F.col("count") >= least_rows).select(*names, F.lit(True).alias("_many"))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    both = df.join(many, same, "left").drop(*names)
    out = near_in_time(both.where("_many").drop("_many"), keys, ts, value, hours, run, [T.StructField("outlier", T.BooleanType())])
    return out.unionByName(both.where("_many is null").drop("_many"), allowMissingColumns=True).withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def split_outliers(df: DataFrame, keys: Sequence[str], ts: str, value: str, **options: float) -> tuple[DataFrame, DataFrame]:
    """The rows that `mad_outliers` leaves, and those that it flags."""
    flagged = mad_outliers(df, keys, ts, value, **options)
    return flagged.where("not outlier").drop("outlier"), flagged.where("outlier").drop("outlier")


def context(df: DataFrame, keys: Sequence[str], ts: str, value: str, rows: int = 3, tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """Means of the `rows` values before and after each row (of one instant by `tie`, then value), and their difference."""
    df, w = dealt(df, keys, ts, [ts, *tie, value], bucket, rows, rows)
    df = df.withColumn("mean_before", F.avg(value).over(w.rowsBetween(-rows, -1))).withColumn("mean_after", F.avg(value).over(w.rowsBetween(1, rows)))
    return own(df).withColumn("asymmetry", F.col("mean_after") - F.col("mean_before"))


def neighbours(df: DataFrame, keys: Sequence[str], ts: str, value: str, rows: int, tie: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """Columns prev_i and next_i (i from 0, the row itself) with the values of the rows around each one."""
    df, w = dealt(df, keys, ts, [ts, *tie, value], bucket, rows - 1, rows - 1)
    return own(df.withColumns({f"{n}_{i}": f(value, i).over(w) for i in range(rows) for n, f in (("prev", F.lag), ("next", F.lead))}))


def against_bounds(df: DataFrame, bounds: DataFrame, group: str, value: str, low: str, high: str) -> DataFrame:
    """Rows of the groups in `bounds` (one row per group) with `outside`: whether the value is out of its group's bounds.

    A null value is within none and outside of none: null.
    """
    out = (F.col(value) < F.col(low)) | (F.col(value) > F.col(high))
    return df.join(counted(bounds), group).withColumn("outside", out)
