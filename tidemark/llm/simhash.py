"""SimHash near-duplicates by anchor-point covering.

Every distinct 64-bit fingerprint goes to the anchors of a covering code: the 64 bits are dealt into
m blocks and a block is covered by its majority bit, so an anchor is an m-bit word. Two fingerprints
that differ in at most t bits have a point between them within ceil(t/2) bits of both; the anchor of
that point is within the covering radius plus the threshold of both, and both are sent to it. So each
is sent to the anchors of the points within ceil(t/2) bits only, a part of those within radius plus
threshold, and fingerprints need only be compared within an anchor. m follows the number of fingerprints. Anchors
with more members than `most` are refined: their members go to the anchors of the 64-block code
(every point is an anchor, radius 0), where an anchor can hold 65 fingerprints at most for t <= 2.

Nulls and odd inputs: a null or empty text has no shingle and fingerprint 0, linked like any other;
equal fingerprints are always linked; a null doc_id is kept as a row, counts as larger than all
others in its component; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut
from .components import components

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Members of an anchor that are compared in one task.
MOST = 4096


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < n else map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False))
    h = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, h): the signed 64-bit fingerprint of each whole text, and a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_signed(fingerprint(x.as_py())) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(fp, pa.int64()), b["h"]], names=["doc_id", "fp", "h"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, fp long, h long")


def _blocks(m: int) -> list[tuple[int, int]]:
    """(first bit, length) of m blocks that make up 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def anchors(fp: np.ndarray, m: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of fp, anchor): the anchors of all points within `radius` bits of each fingerprint."""
    fp = fp.view(np.uint64)
    home, cost = np.zeros(len(fp), np.uint64), np.empty((m, len(fp)), np.int16)
    for k, (at, n) in enumerate(_blocks(m)):
        ones = np.bitwise_count((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int16)
        bit = 2 * ones > n
        home |= bit.astype(np.uint64) << np.uint64(k)
        cost[k] = np.where(bit, ones - n // 2, n // 2 + 1 - ones)  # flips that turn the majority
    rows, keys, spent = np.arange(len(fp)), home, np.zeros(len(fp), np.int16)
    out, level = [(rows, keys)], [(rows, keys, spent, np.full(len(fp), -1, np.int16))]
    for _ in range(radius):
        more = []
        for rows, keys, spent, last in level:
            for k in range(m):
                now = spent + cost[k][rows]
                ok = (now <= radius) & (last < k)
                if ok.any():
                    more.append((rows[ok], keys[ok] ^ np.uint64(1 << k), now[ok], np.full(int(ok.sum()), k, np.int16)))
        level = more
        out += [(r, k) for r, k, _, _ in more]
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out]).view(np.int64)


def _to_anchors(fps: DataFrame, m: int, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy()
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                rows, keys = anchors(part, m, radius)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def _forest(fp: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the fingerprints of one anchor as all links within t bits do."""
    n, left, right = len(fp), [], []
    for i in range(0, n, 256):
        near = np.bitwise_count(fp[i : i + 256, None] ^ fp[None, :]) <= t
        a, b = np.nonzero(near)
        ok = a + i < b
        left.append(a[ok] + i)
        right.append(b[ok])
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def _compare(sent: DataFrame, t: int, parts: int) -> DataFrame:
    """Edges (a, b) among the fingerprints that share an anchor; sorted runs of one anchor at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            out_a, out_b = [], []
            for s, e in zip(ends[:-1], ends[1:], strict=False):
                if e - s > 1:
                    g = np.unique(f[s:e].view(np.uint64))
                    x, y = _forest(g, t)
                    out_a.append(g[x])
                    out_b.append(g[y])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).view(np.int64)) for o in (out_a, out_b)], names=["a", "b"])

        for b in batches:
            held.append((b["anchor"].to_numpy(), b["fp"].to_numpy()))
            k, f = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            whole = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0  # the last anchor may go on
            if whole:
                yield from emit(k[:whole], f[:whole])
            held = [(k[whole:], f[whole:])]
        if held and len(held[0][0]):
            yield from emit(*held[0])

    return sent.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "a long, b long").distinct()


def links(fps: DataFrame, threshold: int = THRESHOLD, most: int = MOST) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of `fp` within `threshold` bits."""
    only = cut(fps.select("fp").where("fp is not null").distinct())
    n = only.count()
    m = max(8, min(32, math.ceil(math.log2(max(n, 1) / 16 + 1))))
    radius = math.ceil(threshold / 2)
    parts = max(int(only.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (m + 1) // 2_000_000)
    sent = cut(_to_anchors(only, m, radius))
    crowded = sent.groupBy("anchor").count().where(F.col("count") > most).select("anchor")
    crowded = cut(crowded)
    few = _compare(sent.join(crowded, "anchor", "left_anti"), threshold, parts)
    if crowded.isEmpty():
        return few
    rest = sent.join(crowded, "anchor", "left_semi").select("fp").distinct()
    return few.union(_compare(_to_anchors(rest, 64, radius), threshold, parts)).distinct()


def _classed(first: DataFrame, prints: DataFrame, threshold: int) -> DataFrame:
    """`first` (a row per fingerprint) with `c`, the component of its fingerprint."""
    comp = components(links(prints, threshold))
    return first.join(comp, first["fp"] == comp["node"], "left").withColumn("c", F.coalesce("component", "fp")).drop("node", "component")


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = cut(fingerprints(docs))
    joined = _classed(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), prints, threshold)
    lows = joined.groupBy("c").agg(F.min("low").alias("component_id"))
    # one row per distinct fingerprint; the join with the documents is on fp, and hot fingerprints
    # are left to Spark's skew handling of joins
    of = cut(joined.join(lows, "c").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    return groups(docs, threshold).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group, columns unchanged: that of the smallest doc_id (null: the largest of all).

    Of several rows with that doc_id in the group the one with the least hash of its text stays; of rows
    equal in both the one with the least hash of the whole row.
    """
    prints = cut(fingerprints(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    best = _classed(prints.groupBy("fp").agg(F.min(place).alias("k")), prints, threshold).groupBy("c").agg(F.min("k").alias("k"))
    stay = cut(best.select(F.col("k.id").alias("_id"), F.col("k.h").alias("_h")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    kept = rows.join(stay, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_h")))
    turn = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.xxhash64("_doc")))
    return kept.withColumn("_turn", turn).where("_turn = 1").select("_doc.*")
