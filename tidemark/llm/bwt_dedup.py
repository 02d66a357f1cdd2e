"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte that lies in a string of `LENGTH` bytes which also starts earlier in the corpus goes.

1. *Cut.* Consecutive windows of LENGTH bytes that share the place of their minimizer (the least hash of
   the GRAM-byte strings inside, the first of equals) make one stretch; equal windows have equal
   minimizers, so equal windows lie in stretches of one minimizer, never in the same stretch. Stretches are dealt by minimizer,
   packed as arrays; copies within a batch are pre-aggregated, so that a hot one is sent once a batch.
2. *Whole copies.* Of equal stretches all but the first go entirely; only first ones go on, so that a
   passage with many copies is transformed once.
3. *Partial copies.* First stretches that share a minimizer but aren't equal are fetched as text. A
   window can only repeat if its first and its last GRAM bytes both do; runs of such windows are dealt
   into shards by their order, each shard gets its transform, and the transforms are merged. The merged
   order alone tells which windows repeat.

A minimizer of more than `HOT` different stretches isn't brought to one task: its windows are dealt one
by one, by their first and last GRAM bytes, equal ones of a batch as one.

The transform reads SYMBOL bytes at a time: a stretch is SYMBOL strings, one a phase, over the
alphabet of its SYMBOL-byte strings. Merging refines one interleave vector: a pass takes the symbols
before the suffixes in the interleave's order, and a stable sort of them is the interleave by one
symbol more. The passes also split blocks of suffixes that agree so far, so after LENGTH / SYMBOL of
them blocks are the repeated intervals with a common prefix of LENGTH bytes; no suffix of a shard is
sorted again.

Nulls and odd inputs: a null text is empty; texts below LENGTH bytes keep all. Rows of one doc_id, or
of none (first of all), are documents of their own in the order of a hash of their texts, so the first
of equal passages stays among them too; rows equal in id and text are one place, of which every copy
keeps the same bytes. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut, numbered

LENGTH, GRAM, SYMBOL = 100, 32, 20
SPAN = LENGTH - GRAM + 1
#: Stretches in a shard, and bytes of input for each bucket of stretches.
SHARD, BUCKET_BYTES = 2_048, 4_000_000
#: Different stretches of one minimizer that are brought together; more are dealt by window.
HOT = 4_096
_C = [np.uint64(c) for c in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0xBF58476D1CE4E5B9)]
#: Place of a stretch: minimizer, hash of its bytes, document, first window, windows.
PLACE = np.dtype([("mini", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): the number that orders documents, the doc_id itself unless ids repeat or lack.

    Only then rows are numbered in the order of (doc_id, hash of the text), which needs the texts' hashes.
    """
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("place", F.col("doc_id").cast("long"))
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    number = cut(numbered(keyed.select("doc_id", "tie").distinct(), [], ["doc_id", "tie"], "place"))
    renamed = number.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "place")
    return keyed.join(renamed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("doc_id", "text", "place")


def _hashes(b: bytes, size: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` (a multiple of 4, at least 8) bytes in b."""
    n = len(b) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    word = lambda o: np.ndarray((n,), "<u8", buffer=b, offset=o, strides=(1,))
    h = np.full(n, size, np.uint64)
    for k, o in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        h ^= word(o) * _C[k % 4]
        h ^= h >> np.uint64(29)
        h *= _C[4]
    return h ^ (h >> np.uint64(32))


def stretches(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of windows that share a place of a minimizer."""
    h = _hashes(b, GRAM)
    if len(h) < SPAN:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
    low, s = h, 1
    while 2 * s <= SPAN:
        low = np.minimum(low[:-s], low[s:])
        s *= 2
    if s < SPAN:
        low = np.minimum(low[: len(h) - SPAN + 1], low[SPAN - s :])
    # a window after one that starts with its minimizer has another place of it, if not another one
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])])
    return low[first], first, np.diff(np.r_[first, len(low)])


def _cut(docs: DataFrame, buckets: int) -> DataFrame:
    """kind 0: packed places for a bucket; kind 1: windows [a, b) of `doc` that certainly repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, text in zip(batch["place"].to_pylist(), batch["text"].to_pylist(), strict=True):
                b = (text or "").encode("utf-8", "surrogatepass")
                if len(b) < LENGTH:
                    continue
                mini, at, n = stretches(b)
                p = np.empty(len(mini), PLACE)
                p["mini"], p["doc"], p["at"], p["n"] = mini, doc, at, n
                p["hash"] = [xxh3_64_intdigest(b[i : i + k + LENGTH - 1]) for i, k in zip(at.tolist(), n.tolist(), strict=True)]
                found.append(p)
            if not found:
                continue
            p = np.concatenate(found)
            first, again = _firsts(p)
            yield _repeats(p[again])
            p = p[first]
            to = (p["mini"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            p, to = p[order], to[order]
            ends = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
            packed = [p[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            n = len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(to[ends[:-1]]), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array(packed, pa.binary())], names=["kind", "doc", "a", "b", "packed"])

    return docs.select("place", "text").mapInArrow(run, "kind int, doc long, a long, b long, packed binary")


def _firsts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first place of each stretch, and of those that come truly later."""
    order = np.lexsort((p["at"], p["doc"], p["hash"], p["mini"]))
    q = p[order]
    new = np.r_[True, (q["mini"][1:] != q["mini"][:-1]) | (q["hash"][1:] != q["hash"][:-1])] if len(q) else np.empty(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else np.empty(0, np.int64)
    tie = (q["doc"] == q["doc"][head]) & (q["at"] == q["at"][head])
    return order[new], order[~tie]


def _repeats(p: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 1 for places all of whose windows repeat, runs of one document joined."""
    p = p[np.lexsort((p["at"], p["doc"]))]
    a, b, doc = p["at"].astype(np.int64), p["at"].astype(np.int64) + p["n"], p["doc"]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > b[:-1])] if len(p) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    last = np.r_[starts[1:] - 1, len(p) - 1] if len(p) else starts
    n = len(starts)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(doc[starts]), pa.array(a[starts]), pa.array(b[last]), pa.array([None] * n, pa.binary())], names=["kind", "doc", "a", "b", "packed"])


def _resolve(packed: DataFrame, parts: int) -> DataFrame:
    """Whole copies (kind 1) and, as kind 2 (3: of a hot minimizer), first stretches that share a minimizer with others: a = first window, b = windows, packed = minimizer."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        p = np.concatenate([np.frombuffer(x, PLACE) for x in blobs])
        first, again = _firsts(p)
        yield _repeats(p[again])
        q = p[first]  # in order of minimizer
        _, of, many = np.unique(q["mini"], return_inverse=True, return_counts=True)
        many = many[of]
        q, kind = q[many > 1], np.where(many > HOT, 3, 2).astype(np.int32)[many > 1]
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(q["doc"]), pa.array(q["at"].astype(np.int64)), pa.array(q["n"].astype(np.int64)), pa.array([x.tobytes() for x in q["mini"]], pa.binary())], names=["kind", "doc", "a", "b", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for k, x in zip(b["doc"].to_pylist(), b["packed"].to_pylist(), strict=True):
                if held and k != bucket:
                    yield from solve(held)
                    held = []
                bucket = k
                held.append(x)
        if held:
            yield from solve(held)

    return packed.select("doc", "packed").repartition(parts, "doc").sortWithinPartitions("doc").mapInArrow(run, "kind int, doc long, a long, b long, packed binary")


class Shard:
    """Transform of a few stretches: suffixes in order, and the symbol before each of them."""

    def __init__(self, strings: list[np.ndarray], where: np.ndarray) -> None:
        """strings: symbols (above 0) of each stretch by byte; where: number of each byte's suffix, flat."""
        before, keys, names = [], [], []
        at = 0
        for s in strings:
            n = len(s)
            padded = np.r_[s, np.zeros(LENGTH + SYMBOL, s.dtype)]
            idx = np.arange(n + SYMBOL)  # the last SYMBOL are empty suffixes, one a phase
            keys.append(np.stack([padded[idx + k * SYMBOL] * (idx + k * SYMBOL < n) for k in range(LENGTH // SYMBOL)]))
            before.append(np.r_[np.zeros(SYMBOL, s.dtype), s])
            names.append(np.r_[where[at : at + n], np.full(SYMBOL, -1)])
            at += n
        k = np.concatenate(keys, 1)
        order = np.lexsort(k[::-1])
        empty = k[0][order] == 0
        self.order = np.r_[order[empty], order[~empty]]
        self.before = np.concatenate(before)[self.order]
        self.names = np.concatenate(names)[self.order]
        self.empty = int(empty.sum())


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """(name, block) of the suffixes in merged order; suffixes of one block share LENGTH bytes."""
    z = np.repeat(np.arange(len(shards)), [len(s.before) for s in shards])
    ends = np.repeat(np.arange(len(shards)), [s.empty for s in shards])
    block = np.zeros(len(z), np.int64)
    spots = None
    for _ in range(LENGTH // SYMBOL):
        before = np.empty(len(z), shards[0].before.dtype)
        for k, s in enumerate(shards):
            before[z == k] = s.before
        order = np.argsort(before, kind="stable")
        order = order[np.searchsorted(before[order], 1) :]  # where a string begins nothing comes before
        symbol, old = before[order], block[order]
        z = np.r_[ends, z[order]]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])] if len(order) else np.empty(0, bool)
        block = np.r_[np.arange(len(ends)), len(ends) + np.cumsum(new) - 1]
    names = np.empty(len(z), np.int64)
    for k, s in enumerate(shards):
        names[z == k] = s.names
    return names, block


def partial(texts: list[bytes], docs: np.ndarray, ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, window) of each window in `texts` that equals one which starts earlier."""
    # a window can only repeat if both its ends do
    grams = [_hashes(t, GRAM) for t in texts]
    _, inverse, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    again = np.split(n[inverse] > 1, np.cumsum([len(g) for g in grams])[:-1])
    h = [g[: 1 - SPAN] & g[SPAN - 1 :] for g in again]
    flat = many = np.concatenate(h)
    lens = np.array([len(x) for x in h])
    of = np.repeat(np.arange(len(texts)), lens)
    local = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    pieces, names, start, owner = [], [], [], []
    pos = np.flatnonzero(many)
    if not len(pos):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    brk = np.flatnonzero(np.r_[True, (of[pos][1:] != of[pos][:-1]) | (pos[1:] != pos[:-1] + 1), True])
    for s, e in zip(brk[:-1], brk[1:], strict=True):
        i, a, b = of[pos[s]], local[pos[s]], local[pos[e - 1]]
        pieces.append(texts[i][a : b + LENGTH])
        start.append(a)
        owner.append(i)
    symbols = [_hashes(t, SYMBOL) for t in pieces]
    alphabet, rank = np.unique(np.concatenate(symbols), return_inverse=True)
    rank = (rank + 1).astype(np.int32)
    sizes = np.array([len(x) for x in symbols])
    offset = np.r_[0, np.cumsum(sizes)]
    key_doc = np.repeat(docs[owner], sizes)
    key_at = np.repeat(ats[owner] + np.array(start), sizes) + np.arange(offset[-1]) - np.repeat(offset[:-1], sizes)
    strings = [rank[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]
    shards = [Shard(strings[i : i + SHARD], np.arange(offset[i], offset[min(i + SHARD, len(strings))])) for i in range(0, len(strings), SHARD)]
    name, block = merge(shards)
    ok = name >= 0
    name, block = name[ok], block[ok]
    tail = np.repeat(offset[:-1] + sizes - (LENGTH - SYMBOL), sizes)  # windows start before it
    ok = name < tail[name]
    name, block = name[ok], block[ok]
    order = np.lexsort((key_at[name], key_doc[name], block))
    name, block = name[order], block[order]
    new = np.r_[True, block[1:] != block[:-1]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (key_doc[name] != key_doc[name[head]]) | (key_at[name] != key_at[name[head]])
    return key_doc[name[later]], key_at[name[later]]


def _partial(rows: DataFrame, parts: int) -> DataFrame:
    """Repeating windows among stretches (mini, doc, at, body), a few minimizers at a time; rows without a body are repeats already."""

    def solve(held: list) -> Iterator[pa.RecordBatch]:
        doc, at = partial([x[3] for x in held], np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64))
        p = np.empty(len(doc), PLACE)
        p["doc"], p["at"], p["n"] = doc, at, 1
        yield _repeats(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for b in batches:
            known = b.filter(pc.is_null(b["body"]))
            if known.num_rows:
                p = np.empty(known.num_rows, PLACE)
                p["doc"], p["at"], p["n"] = known["doc"].to_numpy(), known["at"].to_numpy(), known["n"].to_numpy()
                yield _repeats(p)
            b = b.filter(pc.is_valid(b["body"]))
            for row in zip(*(b[c].to_pylist() for c in ("mini", "doc", "at", "body")), strict=True):
                if len(held) >= 4 * SHARD and row[0] != held[-1][0]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    dealt = rows.repartition(parts, "mini").sortWithinPartitions("mini")
    return dealt.mapInArrow(run, "kind int, doc long, a long, b long, packed binary")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, runs): for each place of `docs` (as `places` gives them) the windows [a, b) that repeat, as an array of (a, b)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, size // BUCKET_BYTES + 1)
    dealt = cut(_cut(docs, buckets))
    solved = cut(_resolve(dealt.where("kind = 0"), buckets))
    lists = solved.where("kind in (2, 3)").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "packed", (F.col("kind") == 3).alias("hot"))).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, first = [], {}
            for doc, text, want in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["want"].to_pylist(), strict=True):
                b = text.encode("utf-8", "surrogatepass")
                for w in want:
                    if not w["hot"]:
                        out.append((int.from_bytes(w["packed"], "little", signed=True), doc, w["a"], b[w["a"] : w["a"] + w["b"] + LENGTH - 1], 1))
                        continue
                    for at in range(w["a"], w["a"] + w["b"]):  # equal windows of a batch go on as the first of them
                        body = b[at : at + LENGTH]
                        low = first.setdefault(body, (doc, at))
                        if (doc, at) < low:
                            first[body], low = (doc, at), (doc, at)
            rows = [(doc, at, body, 1, xxh3_64_intdigest(body[:GRAM] + body[-GRAM:]) - (1 << 63)) for body, (doc, at) in first.items()]
            for doc, text, want in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["want"].to_pylist(), strict=True):
                b = text.encode("utf-8", "surrogatepass") if any(w["hot"] for w in want) else b""
                again = [at for w in want if w["hot"] for at in range(w["a"], w["a"] + w["b"]) if first[b[at : at + LENGTH]] != (doc, at)]
                for _, run in groupby(enumerate(again), lambda x: x[1] - x[0]):
                    run = [at for _, at in run]
                    rows.append((doc, run[0], None, len(run), doc))
            out += [(key, doc, at, body, n) for doc, at, body, n, key in rows]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["mini", "doc", "at", "body", "n"])

    bodies = docs.select("place", "text").join(lists, F.col("place") == F.col("doc")).select("doc", "text", "want").mapInArrow(fetch, "mini long, doc long, at long, body binary, n int")
    more = _partial(bodies, shuffle)
    runs = dealt.where("kind = 1").select("doc", "a", "b").union(solved.where("kind = 1").select("doc", "a", "b")).union(more.select("doc", "a", "b"))
    return cut(runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept text (as bytes) of each document."""
    placed = places(docs)
    found = repeated(placed)
    both = placed.join(found, F.col("place") == F.col("doc"), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                b = (text or "").encode("utf-8", "surrogatepass")
                kept, at, gone, spans, end = [], 0, 0, 0, -1
                for r in runs or ():
                    lo, hi = r["a"], min(r["b"] + LENGTH - 1, len(b))  # windows [a, b) cover these bytes
                    if lo > end:
                        kept.append(b[at:lo])
                        spans += 1
                        gone += max(0, hi - lo)
                    else:
                        gone += max(0, hi - end)
                    end = max(end, hi)
                    at = end
                rest = b"".join([*kept, b[at:]])
                out.append((doc, len(b), gone, spans, hashlib.sha256(rest).hexdigest(), rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
