"""Maximal periodic runs of words by recompression.

The words of a batch of texts become one run-length grammar: blocks of one symbol are replaced by a
symbol each, then pairs of a left and a right symbol, in turn, until no symbol of a text occurs twice.
Equal stretches get equal symbols wherever they stand, so how far two places agree, forward or
backward, is answered by climbing the levels while both agree and stepping down where they differ.

A run of period q agrees with itself q words on over at least `max(q, LEAST - q)` places in a row, so
one of them lies on a grid of that width. Every grid point of every q whose words agree is extended
both ways by the grammar; extensions that are long enough are the runs. Grids are harmonic: n words
have about n ln(n) points. An interval found under several periods has the least of them.

A text lies in one task, as its row does; there is no shuffle. Texts are taken `BYTES` at a time.

Nulls and odd inputs: a null text has no words; a null doc_id has no hash and its words stay as they
are; fewer than `LEAST` words hold no run; repeated rows give equal results; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words that a run has at least.
LEAST = 12
#: Text taken at once, and grid points looked at at once.
BYTES, POINTS = 2_000_000, 1 << 21
_ODD = 0x9E3779B97F4A7C15

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Level:
    """A string of the grammar: its symbols, and the place of each one's first part in the string below."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None = None, below: int = 0, block: bool = False) -> None:
        self.symbols, self.block = symbols, block
        if first is not None:
            self.first = np.r_[first, below]
            head = np.zeros(below, np.int64)
            head[first] = 1
            self.owner = np.cumsum(head) - 1


def _blocks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Symbols after block compression and the place of each block; None if no two neighbours are equal."""
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    first = np.flatnonzero(np.r_[True, ~same])
    size, out = np.diff(np.r_[first, len(s)]), s[first].copy()
    long = size > 1
    _, name = np.unique(out[long] * (len(s) + 1) + size[long], return_inverse=True)
    out[long] = s.max() + 1 + name
    return out, first


def _side(s: np.ndarray, turn: int) -> np.ndarray:
    """Whether each place starts a pair, by a split of the symbols into left and right ones."""
    best = None
    for shift in (None, *range(int(s.max()).bit_length())):
        if shift is None:
            left = ((s.astype(np.uint64) * np.uint64((_ODD * (2 * turn + 1)) % 2**64)) >> np.uint64(63)) == 0
        else:  # neighbours differ in some bit, so one of these splits has a pair
            left = (s >> shift) & 1 == 0
        for side in (left, ~left):
            pair = side[:-1] & ~side[1:]
            if best is None or pair.sum() > best.sum():
                best = pair
        if best.any():
            return best
    return best


def _pairs(s: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after pair compression (no two neighbours are equal) and the place of each one."""
    pair = np.r_[_side(s, turn), False]
    first = np.flatnonzero(np.r_[True, ~pair[:-1]])
    out, joined = s[first].copy(), pair[first]
    at = first[joined]
    _, name = np.unique(s[at] * (int(s.max()) + 1) + s[at + 1], return_inverse=True)
    out[joined] = s.max() + 1 + name
    return out, first


def _renamed(s: np.ndarray) -> tuple[np.ndarray, bool]:
    """Symbols numbered from 0, and whether any occurs twice."""
    values, name = np.unique(s, return_inverse=True)
    return name.astype(np.int64), len(values) < len(s)


class Grammar:
    """Levels over a string whose first and last symbol occur once."""

    def __init__(self, symbols: np.ndarray) -> None:
        s, more = _renamed(symbols)
        self.levels = [Level(s)]
        turn = 0
        while more:
            found = _blocks(s)
            block = found is not None
            out, first = found if block else _pairs(s, turn)
            turn += not block
            below = len(s)
            s, more = _renamed(out)
            self.levels.append(Level(s, first, below, block))

    def agree(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from each place of x and the other one of y on; `back`: up to and with them."""
        step = -1 if back else 1
        begin, out = x, np.zeros(len(x), np.int64)
        at, x, y = np.arange(len(x)), x.copy(), y.copy()
        stopped: list[list[tuple]] = [[] for _ in self.levels]

        def stop(level: int, which: np.ndarray) -> None:
            nonlocal at, x, y
            if which.any():
                stopped[level].append((at[which], x[which], y[which]))
                at, x, y = at[~which], x[~which], y[~which]

        for k, level in enumerate(self.levels):
            stop(k, level.symbols[x] != level.symbols[y])
            if not len(at):
                break
            up = self.levels[k + 1]
            ox, oy = up.owner[x], up.owner[y]
            # places of the own symbol above that are still ahead, the present one included
            rx, ry = (x - up.first[ox] + 1, y - up.first[oy] + 1) if back else (up.first[ox + 1] - x, up.first[oy + 1] - y)
            whole = (rx == up.first[ox + 1] - up.first[ox]) & (ry == up.first[oy + 1] - up.first[oy])
            move = np.where(whole, 0, np.minimum(rx, ry) if up.block else 1)
            x, y = x + step * move, y + step * move
            if up.block:
                stop(k, ~whole & (rx != ry))
            x, y = up.owner[x], up.owner[y]
        at, x, y = (np.empty(0, np.int64),) * 3
        for k in range(len(self.levels) - 1, -1, -1):
            parts = [(at, x, y), *stopped[k]]
            at, x, y = (np.concatenate([p[i] for p in parts]) for i in range(3))
            if k and len(at):
                level, s = self.levels[k], self.levels[k - 1].symbols
                size = np.minimum(level.first[x + 1] - level.first[x], level.first[y + 1] - level.first[y]) if level.block else 1
                x, y = (level.first[x + 1] - 1, level.first[y + 1] - 1) if back else (level.first[x], level.first[y])
                move = step * np.where(s[x] == s[y], size, 0)
                x, y = x + move, y + move
        out[at] = step * (x - begin[at])
        return out


def _grid(lens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid points of texts of `lens` words that begin at `starts`, some at a time."""
    most = np.where(lens >= LEAST, lens // 2, 0)
    text = np.repeat(np.arange(len(lens)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    width = np.maximum(period, LEAST - period)
    count = (lens[text] - period + width - 1) // width
    ends = np.cumsum(count)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + POINTS, "right")))
        n = count[lo:hi]
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(starts[text[lo:hi]], n) + turn * np.repeat(width[lo:hi], n), np.repeat(period[lo:hi], n)
        lo = hi


def find_runs(words: np.ndarray, lens: np.ndarray) -> Runs:
    """(text, start, length, period) of all runs, by text, start and period; `words` has the words of all texts as numbers."""
    none = (np.empty(0, np.int64),) * 4
    if not len(words) or lens.max() < LEAST:
        return none
    text = np.repeat(np.arange(len(lens)), lens)
    starts = np.cumsum(lens) - lens
    size = int(words.max()) + 1
    # words of different texts are different symbols, and both ends have one of their own
    symbols = np.r_[-1, text * size + words, len(lens) * size]
    grammar = Grammar(symbols)
    found = []
    for place, period in _grid(lens, starts + 1):
        hit = symbols[place] == symbols[place + period]
        place, period = place[hit], period[hit]
        ahead = grammar.agree(place, place + period)
        behind = grammar.agree(place - 1, place + period - 1, True)
        wide = ahead + behind >= np.maximum(period, LEAST - period)
        found.append(np.stack([place - behind - 1, ahead + behind + period, period])[:, wide])
    start, length, period = np.concatenate(found, 1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.empty(0, bool)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = text[start] if len(start) else start
    return of, start - starts[of], length, period


def changed(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each word of a document becomes, where its hash says that it repeats itself; else None."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(dictionary, words as its indices, number of words of each text)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    flat, of = parts.flatten(), pc.list_parent_indices(parts)
    some = pc.not_equal(pc.binary_length(flat), 0)
    lens = np.bincount(pc.filter(of, some).to_numpy(), minlength=len(texts)).astype(np.int64)
    coded = pc.filter(flat, some).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), lens


def _report(ids: list, texts: pa.Array) -> pa.RecordBatch:
    names, words, lens = _split(texts)
    starts = np.cumsum(lens) - lens
    for k, doc in enumerate(ids):
        to = changed(doc, int(lens[k]))
        if to is not None:
            words[starts[k] : starts[k] + lens[k]] = words[starts[k] + to]
    text, start, length, period = find_runs(words, lens)
    # words after the first period of some run
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts[text] + start + period, 1)
    np.add.at(cover, starts[text] + start + length, -1)
    keep = np.cumsum(cover[:-1]) == 0
    kept = np.bincount(np.repeat(np.arange(len(lens)), lens)[keep], minlength=len(lens))
    left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), names.take(pa.array(words[keep])))
    joined = pc.binary_join(left, " ")
    at = np.searchsorted(text, np.arange(len(ids) + 1))
    rows = []
    for k, doc in enumerate(ids):
        one = list(zip(*(x[at[k] : at[k + 1]].tolist() for x in (start, length, period)), strict=True))
        best = min(one, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in one).encode()).hexdigest()
        rows.append((doc, len(one), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha, hashlib.sha256(joined[k].as_buffer()).hexdigest()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run, digests of all runs and of the words that they leave.

    Documents that their hash chooses are made to repeat themselves first (`changed`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"]
            upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BYTES, "right")))
                yield _report(ids[lo:hi], texts.slice(lo, hi - lo))
                lo = hi

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
