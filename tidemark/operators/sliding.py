"""Order statistics of sliding windows over readings, many keys at a time.

Rows are dealt by key and time bucket, each bucket with the readings around it, sorted, and streamed
through Arrow batches: whole buckets of many keys are worked on at once, as arrays, so neither a row nor
a bucket costs a Python call. `Ranked` answers the k-th smallest value of any window in log(n) array
steps, however wide the window is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import HOUR, micros

#: Rows that are worked on at once, if no bucket is larger.
ROWS = 65_536


class Ranked:
    """Values by rank, one stable split a bit: level by level, how many of the first i go to the lower half."""

    def __init__(self, x: np.ndarray) -> None:
        order = np.argsort(x, kind="stable")  # nan last
        self.sorted, self.rank = x[order], np.empty(len(x), np.int64)
        self.rank[order] = np.arange(len(x))
        self.known = np.r_[0, np.cumsum(x == x)]
        self.levels = []
        now = self.rank
        for bit in reversed(range(max(1, (len(x) - 1).bit_length()))):
            high = (now >> bit & 1).astype(bool)
            low = np.r_[0, np.cumsum(~high)]
            self.levels.append((bit, low, low[-1]))
            now = np.r_[now[~high], now[high]]

    def pick(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of x[lo:hi]; each window must have that many."""
        out = np.zeros(len(k), np.int64)
        for bit, low, lows in self.levels:
            a, b = low[lo], low[hi]
            up = k >= b - a
            out |= up.astype(np.int64) << bit
            k = np.where(up, k - (b - a), k)
            lo, hi = np.where(up, lows + lo - a, a), np.where(up, lows + hi - b, b)
        return self.sorted[out]

    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of x[lo:hi] come before a rank."""
        out = np.zeros(len(rank), np.int64)
        for bit, low, lows in self.levels:
            a, b = low[lo], low[hi]
            up = (rank >> bit & 1).astype(bool)
            out += np.where(up, b - a, 0)
            lo, hi = np.where(up, lows + lo - a, a), np.where(up, lows + hi - b, b)
        return out


def sliding_median(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Median of x[lo:hi]; nan is left out, an empty window gives nan."""
    r, out = Ranked(x), np.full(len(lo), np.nan)
    n = r.known[hi] - r.known[lo]
    some = np.flatnonzero(n)
    lo, hi, n = lo[some], hi[some], n[some]
    out[some] = (r.pick(lo, hi, (n - 1) // 2) + r.pick(lo, hi, n // 2)) / 2
    return out


def median_of_others(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(median, median absolute deviation from it) of x[lo:hi] without x[i]; nan where that is nan or fewer than `least` are left.

    The others in order are the window in order without the own place. Deviations grow from the middle
    to both sides, so the k-th of them is found by halving how many of them lie on the left.
    """
    r = Ranked(x)
    med, mad = np.full(len(x), np.nan), np.full(len(x), np.nan)
    some = np.flatnonzero((x == x) & (r.known[hi] - r.known[lo] - 1 >= max(least, 1)))
    lo, hi = lo[some], hi[some]
    n, own = r.known[hi] - r.known[lo] - 1, r.below(lo, hi, r.rank[some])
    value = lambda k: r.pick(lo, hi, k + (k >= own))
    left = n // 2
    middle = (value((n - 1) // 2) + value(left)) / 2

    def deviation(k: np.ndarray) -> np.ndarray:
        low = lambda j: middle - value(np.clip(left - 1 - j, 0, n - 1))
        high = lambda j: value(np.clip(left + j, 0, n - 1)) - middle
        a, b = np.maximum(0, k + 1 - (n - left)), np.minimum(left, k + 1)
        while (a < b).any():
            mid = (a + b) // 2
            more = (a < b) & (low(mid) < high(k - mid))
            a, b = np.where(more, mid + 1, a), np.where(more | (a >= b), b, mid)
        return np.maximum(np.where(a > 0, low(a - 1), -np.inf), np.where(k >= a, high(k - a), -np.inf))

    med[some], mad[some] = middle, (deviation((n - 1) // 2) + deviation(left)) / 2
    return med, mad


def sliding_deviation(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sample standard deviation of x[lo:hi], nan left out; nan below two values."""
    known = x == x
    y = np.where(known, x - (x[known].mean() if known.any() else 0), 0).astype(np.longdouble)
    sums = [np.r_[0, np.cumsum(v)] for v in (known.astype(np.longdouble), y, y * y)]
    n, s, q = (v[hi] - v[lo] for v in sums)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1)).astype(float)
    return np.where(n >= 2, out, np.nan)


def windows(us: np.ndarray, before: np.ndarray | int, after: np.ndarray | int, open_start: bool = False, open_end: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First row of each row's window of time, and the row after its last."""
    return np.searchsorted(us, us - before, "right" if open_start else "left"), np.searchsorted(us, us + after, "left" if open_end else "right")


def _starts(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Rows (after the first) that differ from the one before in any of the columns; two nulls don't."""
    n = table.num_rows
    out = np.zeros(max(0, n - 1), bool)
    for c in columns:
        col = table[c].combine_chunks()
        a, b = col.slice(0, n - 1), col.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out |= pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


def near_in_time(df: DataFrame, keys: Sequence[str], ts: str, value: str, reach: float | Column, run: Callable[..., dict[str, np.ndarray]], fields: Sequence[T.StructField], extra: Sequence[str] = ()) -> DataFrame:
    """Every row with `fields`, computed by `run` from the times (in microseconds, ascending), values and `extra` columns around it.

    `run` gets the rows of many keys in one call, with times shifted so that no two keys are within reach
    of each other. A key's rows are dealt out by buckets of time, with those within `reach` hours (a
    number, or a column that is constant for a key) of a bucket beside its own, so that a long key is
    many tasks; a task holds the readings of `ROWS` or of one bucket of a few `reach`, whichever is more.
    A null value is nan to `run`, and nan from it is null; rows without a time get nulls.
    """
    keys, columns, fields = list(keys), list(df.columns), list(fields)
    far = F.round(reach * HOUR).cast("long") if isinstance(reach, Column) else F.lit(round(reach * HOUR))
    known = df.where(F.col(ts).isNotNull()).withColumns({"_us": micros(ts), "_far": far})
    of = lambda c: F.floor(c / F.greatest(4 * F.col("_far"), F.lit(HOUR)))
    dealt = known.withColumn("_b", F.explode(F.sequence(of(F.col("_us") - F.col("_far")), of(F.col("_us") + F.col("_far"))))).withColumn("_own", of(F.col("_us")) == F.col("_b"))

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.r_[0, _starts(table, [*keys, "_b"])]
        us, size = table["_us"].to_numpy(), np.diff(np.r_[starts, table.num_rows])
        base = us - np.repeat(us[starts], size)
        span = int(base.max()) + 2 * int(pc.max(table["_far"]).as_py()) + 2
        if len(starts) > 1 and len(starts) * span > 2**62:
            half = int(starts[len(starts) // 2])
            yield from solve(table.slice(0, half))
            yield from solve(table.slice(half))
            return
        out = run(np.repeat(np.arange(len(starts)), size) * span + base, table[value].cast(pa.float64()).to_numpy(), *[table[c].to_numpy() for c in extra])
        own = table["_own"]
        table = table.select(columns)
        for f in fields:
            table = table.append_column(f.name, pa.array(out[f.name], from_pandas=True))
        yield from table.filter(own).to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, whole = None, 0, 0  # rows up to `whole` are complete buckets
        parts: list[pa.Table] = []
        for batch in batches:
            new = pa.Table.from_batches([batch])
            if not new.num_rows:
                continue
            edge = new if held is None else pa.concat_tables([held.slice(held.num_rows - 1), new])
            starts = _starts(edge, [*keys, "_b"])
            if len(starts):
                whole = rows + int(starts[-1]) - (held is not None)
            held = new
            parts.append(new)
            rows += new.num_rows
            if rows >= ROWS and whole:
                table = pa.concat_tables(parts)
                yield from solve(table.slice(0, whole))
                rest = table.slice(whole)
                parts, rows, whole, held = [rest], rest.num_rows, 0, rest
        if rows:
            yield from solve(pa.concat_tables(parts))

    schema = T.StructType([*df.schema.fields, *fields])
    got = dealt.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", "_us").mapInArrow(stream, schema)
    return got.unionByName(df.where(F.col(ts).isNull()), allowMissingColumns=True)
