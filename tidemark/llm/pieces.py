"""SentencePiece encoding and decoding with a public BPE vocabulary, giant documents by a max-plus scan.

The vocabulary is a byte-pair one, so the right segmentation isn't the best-scored path but the one
that the merges give. It still has the property that a scan needs: a run of pieces is the encoding
of a stretch exactly if each stretch of it encodes to itself, so pieces that lie across the cuts of
a text decide what is between them. In the max-plus semiring a stretch weighs 0 if it encodes to
itself and minus infinity if not, and one path through a document is finite.

* A document of at most `GIANT` code points is one chunk and is encoded in place. Pieces hold a
  space at their start only, so runs from space to space are encoded once and remembered (bounded).
* A giant document is cut every `CHUNK` code points, without regard to words. The states at a cut
  are the pieces that can lie across it. Each chunk yields the matrix from its left states to its
  right ones; matrices are multiplied in blocks of `BLOCK` chunks, blocks within a document, and the
  states that the finite path takes are handed back; every chunk is then encoded on its own.

Nulls and odd inputs: null and empty texts have no ids and decode to the empty text; repeated rows
give repeated rows; a null doc_id is kept; empty tables give empty results. A text that holds the
character U+2581 itself decodes to one with spaces there, as in any SentencePiece model; `exact` is
false then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GIANT, CHUNK, BLOCK = 32_768, 8_192, 64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_UNIT = re.compile(r" +[^ ]*")
#: Code points of remembered runs in a worker, beyond which the memory starts anew, and of the longest one.
_REMEMBER, _LONGEST = 4_000_000, 64


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        byte = [self.sp.is_byte(i) for i in range(len(pieces))]
        plain = [not b and not self.sp.is_control(i) and not self.sp.is_unknown(i) for i, b in enumerate(byte)]
        self.bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() if ok else b"" for p, b, ok in zip(pieces, byte, plain, strict=True)]
        self.byte = byte
        self.ids = {p.replace("▁", " "): i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok}
        self.longest = max(map(len, self.ids))
        self.space = {" ": (self.ids[" "],)}  # a lone space at the end has no text to be the prefix of
        self.seen: dict[str, tuple[int, ...]] = dict(self.space)
        self.held = 0

    def units(self, spaced: str) -> list[tuple[int, ...]]:
        """Ids of a text that starts with a space (the dummy prefix), run by run."""
        runs = _UNIT.findall(spaced)
        new = [u for u in set(runs) if u not in self.seen]
        if not new:
            return [self.seen[u] for u in runs]
        found = dict(zip(new, map(tuple, self.sp.encode([u[1:] for u in new], num_threads=1)), strict=True))
        out = [found[u] if u in found else self.seen[u] for u in runs]
        if self.held > _REMEMBER:
            self.seen, self.held = dict(self.space), 0
        short = {u: ids for u, ids in found.items() if len(u) <= _LONGEST}
        self.seen |= short
        self.held += sum(map(len, short))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.units(" " + text))) if text else []

    def raw(self, part: str) -> list[int]:
        """Ids of a stretch from the midst of a text, without a prefix of its own."""
        if part.startswith(" "):
            return self.encode(part[1:]) if len(part) > 1 else [self.ids[" "]]
        at = part.find(" ")
        head, tail = (part, "") if at < 0 else (part[:at], part[at:])
        # nothing joins with a line feed, so what follows it is encoded as if it stood alone
        return self.sp.encode("\n" + head)[2:] + (list(chain.from_iterable(self.units(tail))) if tail else [])

    def decode(self, ids) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def ends(self, ids: list[int], part: str) -> list[int]:
        """Where each piece ends; a character spelled in bytes counts as one piece."""
        out, at, k = [], 0, 0
        while k < len(ids):
            if self.byte[ids[k]]:
                k += len(part[at].encode("utf-8", "surrogatepass"))
                at += 1
            else:
                at += len(self.bytes[ids[k]].decode())
                k += 1
            out.append(at)
        return out

    def across(self, w: str, p: int) -> list[tuple[int, int]]:
        """(start, end) of each piece that can hold the character at p."""
        found = []
        for i in range(max(0, p - self.longest + 1), p + 1):
            for j in range(p + 1, min(len(w), i + self.longest) + 1):
                if j == i + 1 or w[i:j].replace("▁", " ") in self.ids:
                    found.append((i, j))
        return found

    def matrix(self, w: str, p: int, q: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
        """Left states, right states and max-plus matrix of the chunk [p, q) of window w."""
        left = [(0, 0)] if first else self.across(w, p)
        right = [(len(w), len(w))] if last else self.across(w, q)
        cuts = [m.start() for m in re.finditer(r"(?<=[^ ▁])[ ▁]", w)]
        inner = [x for x in cuts if p < x <= q]

        def fits(i: int, j: int, a=None, b=None) -> bool:
            ends = self.ends(self.raw(w[i:j]), w[i:j])
            return (a is None or ends[0] == a[1] - a[0]) and (b is None or (ends[-2] if len(ends) > 1 else 0) == b[0] - i)

        if inner:
            u1, u2 = inner[0], inner[-1]
            rows = [first or fits(a[0], u1, a=a) for a in left]
            cols = [last or fits(u2, b[1], b=b) for b in right]
            ok = np.logical_and.outer(rows, cols)
        else:
            ok = np.array([[fits(a[0], b[1], None if first else a, None if last else b) if a[0] < b[1] else True for b in right] for a in left])
        return left, right, np.where(ok, 0.0, -np.inf)


@cache
def codec(model: str) -> Codec:
    return Codec(model)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the max-plus semiring."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def path(mats: list[np.ndarray], start: int, end: int) -> list[int]:
    """The states before, between and after `mats` on the best path from `start` to `end`."""
    ahead = [np.where(np.arange(mats[0].shape[0]) == start, 0.0, -np.inf)]
    for m in mats:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    at, out = end, [end]
    for m, v in zip(reversed(mats), reversed(ahead[:-1]), strict=True):
        at = int(np.argmax(v + m[:, at]))
        out.append(at)
    return out[::-1]


def _unpack(cells, rows) -> np.ndarray:
    return np.asarray(cells, float).reshape(int(rows), -1)


def encode_giants(texts: DataFrame, model: str = MODEL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(a, h, ids, n_chunks) of distinct texts, keyed by two hashes a and h, by the chunked scan."""

    def context() -> int:
        """Code points of context around a chunk: more than the longest piece."""
        return max(32, codec(model).longest + 1)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text cut in one pass, a few chunks at a time."""
        pad = context()
        for b in batches:
            for r in b.itertuples():
                s = " " + r.text
                n = -(-len(s) // chunk)
                for i in range(0, n, block):
                    ks = range(i, min(i + block, n))
                    yield pd.DataFrame({"a": r.a, "h": r.h, "n": n, "k": ks, "w": [s[max(0, k * chunk - pad) : (k + 1) * chunk + pad] for k in ks]})

    parts = texts.select("a", "h", "text").mapInPandas(split, "a long, h long, n int, k int, w string").repartition("a", "h", "k")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, pad = codec(model), context()
        for b in batches:
            out = []
            for r in b.itertuples():
                p = 0 if r.k == 0 else pad
                last = r.k == r.n - 1
                left, right, m = c.matrix(r.w, p, min(p + chunk, len(r.w)), r.k == 0, last)
                out.append((r.a, r.h, r.n, r.k, r.w, sum(left, ()), sum(right, ()), len(left), m.ravel()))
            yield pd.DataFrame(out, columns=["a", "h", "n", "k", "w", "l", "r", "rows", "m"])

    measured = cut(parts.mapInPandas(measure, "a long, h long, n int, k int, w string, l array<int>, r array<int>, rows int, m array<double>"))
    key = F.floor(F.col("k") / block).cast("int").alias("block")
    mats = measured.select("a", "h", "k", "rows", "m", key)

    def multiply(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        out = None
        for cells, rows in zip(g.m, g.rows, strict=True):
            m = _unpack(cells, rows)
            out = m if out is None else times(out, m)
        return pd.DataFrame({"a": g.a[:1], "h": g.h[:1], "block": g.block[:1], "rows": [out.shape[0]], "m": [out.ravel()]})

    blocks = mats.groupBy("a", "h", "block").applyInPandas(multiply, "a long, h long, block int, rows int, m array<double>")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        at = path([_unpack(c, r) for c, r in zip(g.m, g.rows, strict=True)], 0, 0)
        return pd.DataFrame({"a": g.a, "h": g.h, "block": g.block, "s": at[:-1], "e": at[1:]})

    ends = blocks.groupBy("a", "h").applyInPandas(walk, "a long, h long, block int, s int, e int")

    def resolve(key, g: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        at = path([_unpack(c, r) for c, r in zip(g.m, g.rows, strict=True)], int(e.s.iloc[0]), int(e.e.iloc[0]))
        return pd.DataFrame({"a": g.a, "h": g.h, "k": g.k, "i": at[:-1], "j": at[1:]})

    keys = ("a", "h", "block")
    taken = mats.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInPandas(resolve, "a long, h long, k int, i int, j int")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for b in batches:
            out = []
            for r in b.itertuples():
                a, z = r.l[2 * r.i], r.r[2 * r.j + 1]
                part = r.w[a:z]
                ids = c.raw(part)
                if r.k < r.n - 1:  # the piece across the right cut is the next chunk's
                    size = z - r.r[2 * r.j]
                    spelled = len(part[-1].encode("utf-8", "surrogatepass")) if size == 1 and c.byte[ids[-1]] else 1
                    ids = ids[:-spelled]
                out.append((r.a, r.h, r.k, ids))
            yield pd.DataFrame(out, columns=["a", "h", "k", "ids"])

    joined = measured.join(taken, ["a", "h", "k"]).select("a", "h", "n", "k", "w", "l", "r", "i", "j")
    traced = joined.mapInPandas(trace, "a long, h long, k int, ids array<int>")
    sorted_ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    return traced.groupBy("a", "h").agg(sorted_ids.alias("ids"), F.count("*").cast("int").alias("n_chunks"))


def encode(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, n_chunks, exact) of every whole text; exact: the ids decode to the text.

    `model` must be a path that every executor has; the setting spark.tidemark.pieces goes before its default.
    """
    if model == MODEL:
        model = docs.sparkSession.conf.get("spark.tidemark.pieces", MODEL)
    text = F.coalesce("text", F.lit(""))
    flat = docs.select("doc_id", text.alias("text"), F.length(text).alias("_n"))
    kind = "doc_id long, ids array<int>, n_chunks int, exact boolean"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = b["text"].to_pylist()
            rows = [c.encode(x) for x in texts]
            exact = [c.decode(i) == x for i, x in zip(rows, texts, strict=True)]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(np.ones(len(rows), np.int32)), pa.array(exact, pa.bool_())], names=["doc_id", "ids", "n_chunks", "exact"])

    small = flat.where(F.col("_n") <= giant).select("doc_id", "text").mapInArrow(plain, kind)
    giants = cut(flat.where(F.col("_n") > giant).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("a")))
    if giants.isEmpty():
        return small
    big = cut(giants.groupBy("a", "h").agg(F.first("text").alias("text")))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for b in batches:
            yield pd.DataFrame({"a": b.a, "h": b.h, "ids": b.ids, "n_chunks": b.n_chunks, "exact": [c.decode(i) == x for i, x in zip(b.ids, b.text, strict=True)]})

    both = big.join(encode_giants(big, model, chunk), ["a", "h"]).select("a", "h", "text", "ids", "n_chunks")
    checked = both.mapInPandas(verify, "a long, h long, ids array<int>, n_chunks int, exact boolean")
    return small.union(giants.select("doc_id", "a", "h").join(checked, ["a", "h"]).select("doc_id", "ids", "n_chunks", "exact"))


def decode(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array([c.decode(x.as_py() or ()) for x in b["ids"]], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
