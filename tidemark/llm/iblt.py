"""Document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs (lines; long ones in runs of about 48 bytes that end with a word) are digested to
64 bits, equal paragraphs told apart by their turn. A sketch holds, for each of its cells, the count,
the sum of digests and the sum of their checks, all modulo the word size; every digest goes to three
cells. Two sketches subtract cell by cell; cells that hold one digest are peeled until none is left,
which recovers the differing digests of both sides. If some remain, larger sketches are made.
Likeness is shared over all paragraphs.

The document after each one comes from one range-partitioned, sorted pass: buckets of doc_id are cut
at quantiles (an id that fills several is split by text hash), and the first document of each bucket is
sent to the bucket before it as well.

Nulls and odd inputs: a null text is empty; two empty texts have likeness 1; null doc_ids come first
in the order; repeated doc_ids are ordered by a hash of the text; the document after the last is the
first, which is the document itself if it is alone; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

CELLS, GROW = 24, 8
#: Bytes of text in a bucket of the order, and how many buckets there are at most.
BUCKET_BYTES, BUCKETS = 8_000_000, 10_000
_PART = re.compile(rb"[^\n]{1,48}[^\s]*")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def digests(text: str) -> np.ndarray:
    found = _PART.findall(text.encode("utf-8", "surrogatepass"))
    if len(set(found)) == len(found):
        return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    turn: dict[bytes, int] = {}
    out = np.empty(len(found), np.uint64)
    for i, x in enumerate(found):
        turn[x] = k = turn.get(x, -1) + 1
        out[i] = xxh64_intdigest(x, k)
    return out


def _hash(d: np.ndarray, by: np.uint64) -> np.ndarray:
    x = d * by
    x ^= x >> np.uint64(29)
    x *= by
    return x ^ (x >> np.uint64(32))


class Sketches:
    """Sketches of many texts of `m` cells each, flat in one array a field."""

    def __init__(self, n: int, m: int, salt: int = 0) -> None:
        self.n, self.m, self.salt = n, m // 3 * 3, np.uint64(2 * salt + 1)
        self.count = np.zeros(n * self.m, np.int64)
        self.key = np.zeros(n * self.m, np.uint64)
        self.check = np.zeros(n * self.m, np.uint64)

    def add(self, doc: np.ndarray, d: np.ndarray, sign: np.ndarray | int) -> None:
        third = np.uint64(self.m // 3)
        s = np.broadcast_to(np.asarray(sign, np.int64), d.shape)
        key, check = d * s.view(np.uint64) if s.flags.c_contiguous else d * s.astype(np.uint64), _hash(d, _CHECK) * s.astype(np.uint64)
        for j, by in enumerate(_MIX):
            at = doc * self.m + j * int(third) + (_hash(d ^ self.salt, by) % third).astype(np.int64)
            np.add.at(self.count, at, s)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.m)
        out.n, out.salt = self.n, self.salt
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests only on the left and only on the right of each difference, and whether all came out."""
        left, right = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for _ in range(10_000):
            at = np.flatnonzero(np.abs(self.count) == 1)
            s = self.count[at]
            d = self.key[at] * s.astype(np.uint64)
            ok = _hash(d, _CHECK) * s.astype(np.uint64) == self.check[at]
            at, s, d = at[ok], s[ok], d[ok]
            if not len(at):
                break
            doc = at // self.m
            _, one = np.unique(np.stack([doc.astype(np.uint64), d]), axis=1, return_index=True) if len(at) > 1 else (None, np.array([0]))
            doc, s, d = doc[one], s[one], d[one]
            np.add.at(left, doc, s > 0)
            np.add.at(right, doc, s < 0)
            self.add(doc, d, -s)
        full = lambda x: (x.reshape(self.n, self.m) == 0).all(1)
        return left, right, full(self.count) & full(self.key)

    def text(self, i: int) -> str:
        at = slice(i * self.m, (i + 1) * self.m)
        return np.concatenate([self.count[at].astype("<i4").view(np.uint8), self.key[at].view(np.uint8), self.check[at].astype("<u4").view(np.uint8)]).tobytes().hex()


def _flat(parts: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, digest) of the chosen texts, numbered anew."""
    sizes = [len(parts[i]) for i in of]
    return np.repeat(np.arange(len(of)), sizes), (np.concatenate([parts[i] for i in of]) if len(of) else np.empty(0, np.uint64))


def build(parts: list[np.ndarray], of: np.ndarray, m: int, salt: int = 0) -> Sketches:
    s = Sketches(len(of), m, salt)
    s.add(*_flat(parts, of), 1)
    return s


def likeness(a: list[np.ndarray], b: list[np.ndarray], sa: Sketches, sb: Sketches) -> np.ndarray:
    """Likeness of texts pair by pair from their sketches, made anew and larger where peeling fails."""
    n = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    left, right, ok = sa.minus(sb).peel()
    m, salt = CELLS, 0
    while len(rest := np.flatnonzero(~ok)):
        m, salt = min(m * GROW, 6 * int(n[rest].sum(1).max()) + CELLS), salt + 1
        for i in range(0, len(rest), max(1, 2_000_000 // m)):
            some = rest[i : i + max(1, 2_000_000 // m)]
            x, y, good = build(a, some, m, salt).minus(build(b, some, m, salt)).peel()
            left[some], right[some], ok[some] = x, y, good
    shared = n[:, 0] - left
    union = shared + left + right
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with `_b` (bucket of the order of doc_id and text hash), `_o`, `_h` (order) and `_f` (1: only looked ahead to)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_o"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1), BUCKETS)
    cuts = rows.agg(F.percentile_approx("_o", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    edges, times = np.unique(np.array(cuts or [0], np.int64), return_counts=True)
    # an id that fills several buckets has as many of its own, by text hash; what else lies up to the next edge has one
    own = np.r_[0, np.where(times > 1, times, 0)]
    start = np.r_[0, np.cumsum(own + 1)]

    @F.pandas_udf(T.IntegerType())
    def bucket(o: pd.Series, h: pd.Series) -> pd.Series:
        v = o.to_numpy()
        i = np.searchsorted(edges, v, "right")
        hot = (own[i] > 0) & (edges[np.maximum(i, 1) - 1] == v)
        part = (((h.to_numpy() >> 32) + 2**31) * own[i]) >> 32
        return pd.Series((start[i] + np.where(hot, part, own[i])).astype(np.int32))

    placed = rows.withColumn("_b", bucket("_o", "_h"))
    # the place of one row for each bucket comes to the driver
    firsts = sorted((r._b, r.p.o, r.p.h) for r in placed.groupBy("_b").agg(F.min(F.struct(F.col("_o").alias("o"), F.col("_h").alias("h"))).alias("p")).collect())
    ahead = [(o, h, firsts[i - 1][0]) for i, (_, o, h) in enumerate(firsts)]
    look = F.broadcast(spark.createDataFrame(ahead, "_o long, _h long, _b int"))
    more = rows.join(look, ["_o", "_h"]).groupBy("_o", "_h", "_b").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    names = ("_o", "_h", "doc_id", "text", "_b")
    return placed.select(*names, F.lit(0).alias("_f")).union(more.select(*names, F.lit(1).alias("_f"))), int(start[-1])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    if docs.isEmpty():
        return docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))])
    rows, parts = _bucketed(docs)

    def judge(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
        every = np.arange(len(texts))
        a, b, c = ([digests(t) for t in x] for x in (texts, edited, nexts))
        sa, sb, sc = (build(x, every, CELLS) for x in (a, b, c))
        near = likeness(a, b, sa, sb), likeness(a, c, sa, sc)
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array([sa.text(i) for i in every], pa.string()), pa.array([sb.text(i) for i in every], pa.string()), pa.array(near[0]), pa.array(near[1])],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text) that waits for its next
        ids: list = []
        texts: list[str] = []
        nexts: list[str] = []
        for b in batches:
            for o, f, i, t in zip(b["_b"].to_pylist(), b["_f"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                if held and held[0] == o:
                    ids.append(held[1])
                    texts.append(held[2])
                    nexts.append(t)
                held = None if f else (o, i, t)
                if len(texts) >= 256:
                    yield judge(ids, texts, nexts)
                    ids, texts, nexts = [], [], []
        if texts:
            yield judge(ids, texts, nexts)

    dealt = rows.repartitionById(parts, "_b").sortWithinPartitions("_b", "_f", "_o", "_h")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("_b", "_f", "doc_id", "text").mapInArrow(run, kind)
