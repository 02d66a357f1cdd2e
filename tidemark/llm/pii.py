"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network finds what they miss: it is trained in numpy on windows
cut from at most `DOCS` distinct texts (the lowest by their hash): windows of the base spans, the same
windows with a span rewritten as the patterns don't read it (phones without a plus, cards and addresses
with other separators, `name at host dot org`), with a span spoilt (a failing check digit, a part above
255, too few digits, a date), and windows of plain numbers. Of each kind `KEPT` windows at most (the
lowest by hash) are fitted, and `PLAIN` without a span.

A span that it may add holds a digit or an at sign (`_fits`), so it reads the surroundings of every digit,
`@` and word `at`, and goes on to either side for as long as its tags reach the end of what it has read:
no other place can be part of a span. Windows over a stretch overlap, each character takes its tag scores
from the window in whose middle it lies, and a stretch is decoded as a whole. Spans that it adds keep clear
of the base ones and end at word edges; an address starts with the word before its at sign.

Nulls and odd inputs: a null text is empty; without any base span in the sample the patterns alone
decide; repeated rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: What every added span holds one of, and how far it is read to either side at first: digits, and further for at signs.
_SIGN = re.compile(r"[0-9]|(@|(?<![A-Za-z])at(?![A-Za-z]))")
#: Where windows without a span are cut for the training.
_LOOK = re.compile(r"[0-9]|@|(?<![A-Za-z])(?:at|dot)(?![A-Za-z])")

DOCS, WINDOW, STRIDE, AROUND, FURTHER = 20_000, 64, 32, 16, 40
HIDDEN, EMBED, EPOCHS, BATCH, RATE, KEPT, PLAIN = 24, 12, 6, 64, 0.012, 1_500, 2_400
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def _luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by start, then kind."""
    if not _HINT.search(text):
        return []
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        i = at
        while i > free and _LOCAL.match(text[i - 1]):
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append(("email", i, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Joined surroundings of all signs of a span."""
    out: list[list[int]] = []
    for m in _SIGN.finditer(text):
        by = FURTHER if m[1] else AROUND
        lo, hi = max(0, m.start() - by), min(len(text), m.end() + by)
        while out and lo <= out[-1][1]:  # a wide surrounding may reach back
            a, b = out.pop()
            lo, hi = min(a, lo), max(b, hi)
        out.append([lo, hi])
    return [(a, b) for a, b in out]


def _code(c: str) -> int:
    """Printable ASCII by itself, white space, other letters and the rest in one class each."""
    return ord(c) - 31 if "!" <= c <= "~" else 0 if c.isspace() else 96 if c.isalpha() else 97


_TABLE = np.array([_code(chr(i)) for i in range(0x10000)], np.int64)


def _codes(s: str) -> np.ndarray:
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(points, 0xFFFF)]
    for i in np.nonzero(points > 0xFFFF)[0]:
        out[i] = _code(chr(points[i]))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _tanh(x: np.ndarray, z: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """tanh of x in its place within 0.0013, as a ratio of polynomials, which costs a third; z, p and q are room of its size."""
    np.minimum(x, np.float32(3.6), out=x)
    np.maximum(x, np.float32(-3.6), out=x)
    np.multiply(x, x, out=z)
    np.multiply(z, np.float32(15), out=q)
    q += np.float32(420)
    q *= z
    q += np.float32(945)
    np.add(z, np.float32(105), out=p)
    p *= z
    p += np.float32(945)
    x *= p
    x /= q


class Net:
    """Embedding, two LSTMs (one from each end, run side by side), tag scores and CRF transitions."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"e": g(98, EMBED) * np.float32(4), "x": g(2, EMBED, 4 * HIDDEN), "h": g(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 4 * HIDDEN), np.float32), "o": g(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, HIDDEN : 2 * HIDDEN] = 1

    def _run(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Hidden states (n, steps, 2 * HIDDEN), and what `_back` needs (time first)."""
        x = self.p["e"][codes].transpose(1, 0, 2)
        xs = np.stack([x, x[::-1]], 1)  # step, direction, row
        steps, _, n, _ = xs.shape
        z = np.matmul(xs, self.p["x"]) + self.p["b"][:, None]
        hs, cs = np.zeros((steps + 1, 2, n, HIDDEN), np.float32), np.zeros((steps + 1, 2, n, HIDDEN), np.float32)
        gates, us, ths = np.empty((steps, 2, n, 3 * HIDDEN), np.float32), np.empty((steps, 2, n, HIDDEN), np.float32), np.empty((steps, 2, n, HIDDEN), np.float32)
        for t in range(steps):
            a = z[t] + np.matmul(hs[t], self.p["h"])
            gates[t], us[t] = _sigmoid(a[..., : 3 * HIDDEN]), np.tanh(a[..., 3 * HIDDEN :])
            cs[t + 1] = gates[t, ..., HIDDEN : 2 * HIDDEN] * cs[t] + gates[t, ..., :HIDDEN] * us[t]
            ths[t] = np.tanh(cs[t + 1])
            hs[t + 1] = gates[t, ..., 2 * HIDDEN :] * ths[t]
        both = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], 2)
        return both.transpose(1, 0, 2), (xs, hs, cs, gates, us, ths)

    def _back(self, dout: np.ndarray, kept: tuple, codes: np.ndarray, grad: dict) -> None:
        xs, hs, cs, gates, us, ths = kept
        d = dout.transpose(1, 0, 2)
        dhs = np.stack([d[..., :HIDDEN], d[::-1, :, HIDDEN:]], 1)
        da = np.empty((*gates.shape[:3], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros(hs.shape[1:], np.float32)
        for t in reversed(range(len(gates))):
            i, f, o = (gates[t, ..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            dh = dh + dhs[t]
            dc = dc + dh * o * (1 - ths[t] ** 2)
            da[t] = np.concatenate([dc * us[t] * i * (1 - i), dc * cs[t] * f * (1 - f), dh * ths[t] * o * (1 - o), dc * i * (1 - us[t] ** 2)], 2)
            dh, dc = np.matmul(da[t], self.p["h"].transpose(0, 2, 1)), dc * f
        by = lambda v: v.transpose(1, 0, 2, 3).reshape(2, -1, v.shape[3])
        grad["x"] = np.matmul(by(xs).transpose(0, 2, 1), by(da))
        grad["h"] = np.matmul(by(hs[:-1]).transpose(0, 2, 1), by(da))
        grad["b"] = da.sum((0, 2))
        dx = np.matmul(da, self.p["x"].transpose(0, 2, 1))
        np.add.at(grad["e"], codes, (dx[:, 0] + dx[::-1, 1]).transpose(1, 0, 2))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Tag scores (n, steps, TAGS), near those of `_run` (`_tanh`), without what only the training needs; rows lie last in all arrays."""
        n, steps = codes.shape
        # one product a step: rows of h, of the embedding, and of ones; sigmoids are tanh of the half
        w = np.concatenate([self.p["h"], self.p["x"], self.p["b"][:, None]], 1).transpose(0, 2, 1).copy()
        w[:, : 3 * HIDDEN] *= np.float32(0.5)
        o = self.p["o"].reshape(2, HIDDEN, TAGS).transpose(0, 2, 1).copy()
        x = np.take(self.p["e"].T, codes.T, 1)  # embedding, step, row
        both, c = np.zeros((2, HIDDEN + EMBED + 1, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
        both[:, -1] = 1
        a, tmp, s = np.empty((2, 4 * HIDDEN, n), np.float32), np.empty_like(c), np.empty((2, TAGS, n), np.float32)
        room, less = [np.empty_like(a) for _ in range(3)], [np.empty_like(c) for _ in range(3)]
        out = np.empty((steps, TAGS, n), np.float32)
        out[:] = self.p["c"][:, None]
        h, gates = both[:, :HIDDEN], a[:, : 3 * HIDDEN]
        i, f, g, u = (a[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        for t in range(steps):
            both[0, HIDDEN:-1], both[1, HIDDEN:-1] = x[:, t], x[:, steps - 1 - t]
            np.matmul(w, both, out=a)
            _tanh(a, *room)
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            np.multiply(f, c, out=c)
            np.multiply(i, u, out=tmp)
            np.add(c, tmp, out=c)
            tmp[:] = c
            _tanh(tmp, *less)
            np.multiply(g, tmp, out=h)
            np.matmul(o, h, out=s)
            out[t] += s[0]
            out[steps - 1 - t] += s[1]
        return out.transpose(2, 0, 1)

    def loss_grad(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood per row, and the gradient of its sum."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, kept = self._run(codes)
        s, tr = h @ self.p["o"] + self.p["c"], np.exp(self.p["t"])
        n, steps = codes.shape
        top = s.max(2)
        es = np.exp(s - top[:, :, None])
        on = mask[:, :, None]
        # sums over all paths up to and from each step, scaled to one; a masked step passes them on
        ahead, back, scale = np.empty((steps, n, TAGS), np.float32), np.ones((steps, n, TAGS), np.float32), np.ones((steps, n), np.float32)
        for t in range(steps):
            a = es[:, t] * (ahead[t - 1] @ tr) if t else es[:, 0]
            total = a.sum(1)
            scale[t] = np.where(mask[:, t], total, 1)
            ahead[t] = np.where(on[:, t], a / total[:, None], ahead[t - 1] if t else a)
        for t in reversed(range(1, steps)):
            back[t - 1] = np.where(on[:, t], (es[:, t] * back[t] / scale[t][:, None]) @ tr.T, back[t])
        rows, at = np.nonzero(mask)
        ds = (ahead * back).transpose(1, 0, 2) * on
        ds[rows, at, tags[rows, at]] -= 1
        into = es.transpose(1, 0, 2)[1:] * back[1:] / scale[1:, :, None] * mask.T[1:, :, None]
        grad["t"] = tr * (ahead[:-1].reshape(-1, TAGS).T @ into.reshape(-1, TAGS))
        later = at > 0
        rows, at = rows[later], at[later]
        np.subtract.at(grad["t"], (tags[rows, at - 1], tags[rows, at]), 1)
        gold = (np.take_along_axis(s, tags[:, :, None], 2)[:, :, 0] * mask).sum() + self.p["t"][tags[rows, at - 1], tags[rows, at]].sum()
        z = np.log(scale).sum() + (top * mask).sum()
        grad["o"] = h.reshape(-1, h.shape[2]).T @ ds.reshape(-1, TAGS)
        grad["c"] = ds.sum((0, 1))
        self._back(ds @ self.p["o"].T, kept, codes, grad)
        return float(z - gold) / n, grad

    def train(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray, seed: int = 11) -> Net:
        """Adam over shuffled batches; the rate warms up and then falls, gradients are clipped by their norm."""
        r = np.random.default_rng(seed)
        m, v = ({x: np.zeros_like(y) for x, y in self.p.items()} for _ in range(2))
        k, steps = 0, EPOCHS * -(-len(codes) // BATCH)
        for _ in range(EPOCHS):
            order = r.permutation(len(codes))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                _, g = self.loss_grad(codes[some], tags[some], mask[some])
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values())) / len(some)
                rate = RATE * (1 - 0.95 * k / steps) * min(1, (k + 1) / 30)
                k += 1
                for x in self.p:
                    gx = g[x] * np.float32(min(1, 1 / max(norm, 1e-9)) / len(some))
                    m[x] = 0.9 * m[x] + 0.1 * gx
                    v[x] = 0.999 * v[x] + 0.001 * gx**2
                    self.p[x] -= (rate * (m[x] / (1 - 0.9**k)) / (np.sqrt(v[x] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
        return self

    def best(self, s: np.ndarray) -> list[int]:
        """Tags of the best path through the scores of one stretch, in which a span goes on only as its own kind."""
        step, start = self.p["t"].astype(np.float64).copy(), s[0].astype(np.float64).copy()
        for k in range(2, TAGS, 2):
            step[[x for x in range(TAGS) if x not in (k - 1, k)], k] = -1e9
            start[k] = -1e9
        a, back = start, []
        for row in s[1:]:
            c = a[:, None] + step
            back.append(c.argmax(0))
            a = c.max(0) + row
        out = [int(a.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def paths(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """`best` of several stretches side by side, each as a whole; fastest if they are about as long."""
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        lens = np.array([len(many[i]) for i in order])
        n, last = len(many), int(lens[0])
        a, out = np.zeros((last, TAGS, n), np.float32), np.zeros((last, n), np.int8)
        for j, i in enumerate(order):
            a[: lens[j], :, j] = many[i]
        step = self.p["t"].copy()
        for k in range(2, TAGS, 2):
            step[[x for x in range(TAGS) if x not in (k - 1, k)], k] = -1e9
        free = [0, *range(1, TAGS, 2)]
        start, on, go = step[:, free, None], step[range(1, TAGS, 2), range(2, TAGS, 2), None], step[range(2, TAGS, 2), range(2, TAGS, 2), None]
        a[0, 2::2] = -1e9
        live = [int(x) for x in np.searchsorted(-lens, -np.arange(last + 1))]  # stretches longer than t
        for t in range(1, last):
            before, now = a[t - 1, :, : live[t]], a[t, :, : live[t]]
            now[free] += (before[:, None] + start).max(0)
            now[2::2] += np.maximum(before[1::2] + on, before[2::2] + go)
            now -= now[0].copy()  # sums stay small
        tag, step = np.zeros(n, np.int64), step.T.copy()
        for t in reversed(range(last)):
            if live[t] > live[t + 1]:
                tag[live[t + 1] : live[t]] = a[t, :, live[t + 1] : live[t]].argmax(0)
            out[t, : live[t]] = tag[: live[t]]
            if t:
                tag[: live[t]] = (a[t - 1, :, : live[t]].T + step[tag[: live[t]]]).argmax(1)
        found: list[np.ndarray] = [out[:0, 0]] * n
        for j, i in enumerate(order):
            found[i] = out[: lens[j], j]
        return found


def _tags(n: int, spans: list[tuple[str, int, int]], lo: int) -> np.ndarray:
    t = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        a, b = a - lo, b - lo
        if a < n and b > 0:
            t[max(a, 0) : min(b, n)] = k + 1
            if a >= 0:
                t[a] = k
    return t


def _example(text: str, spans: list[tuple[str, int, int]], mid: int) -> tuple[str, np.ndarray]:
    lo = max(0, mid - WINDOW // 2)
    part = text[lo : lo + WINDOW]
    return part, _tags(len(part), spans, lo)


def _number(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(str(r.randint(0, 9)) for _ in range(n - 1))


def _address(s: str, words: list[str], r: random.Random) -> tuple[str, str]:
    """Local part and host: those of s, or some made of words."""
    if not words or r.random() < 0.2:
        local, host = s.split("@", 1)
        return local, host
    a, b, c = (r.choice(words).lower() for _ in range(3))
    local = r.choice(["{a}", "{a}.{b}", "{a}_{b}", "{i}.{b}", "{a}{n}", "{i}_{b}", "{a}.{i}", "{a}-{b}{n}"]).format(a=a, b=b, i=a[0], n=r.randint(1, 999))
    return local, c + r.choice(["", "", "-" + a, "." + b]) + "." + r.choice(["com", "org", "net", "de", "fr", "es", "edu", "info", "co.uk"])


def rewritten(kind: str, s: str, r: random.Random, words: list[str]) -> str:
    """A value of the kind, like the span s, in a form that the patterns don't read."""
    if kind == "email":
        local, host = _address(s, words, r)
        at = r.choice([" at ", "(at)", " (at) ", "[at]", " [at] ", " @ "])
        dot = r.choice([" dot ", "(dot)", "[dot]", " [dot] ", "."]) if at != " at " else r.choice([" dot ", " dot ", "."])
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return r.choice(["[.]", " . ", "(.)", " dot "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = _number(r, 15)
        d += next(c for c in "0123456789" if _luhn(d + c))
        return r.choice([".", "/", "_", " - ", "  "]).join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
    form = r.choice(["({a}) {b}-{c}", "({a}){b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "{a}/{b}-{c}", "00{n} {a} {b} {c}", "{a}{b}{c}"])
    return form.format(a=a, b=b, c=c, n=r.randint(1, 99))


def spoilt(kind: str, s: str, r: random.Random, words: list[str]) -> str:
    """Something like a value of the kind that is none."""
    if kind == "email":
        local, host = _address(s, words, r)
        return r.choice([f"{local} at {host.split('.')[0]}", f"{local} dot {host.split('.')[0]}", f"{local} @ {r.randint(1, 99)}", f"look at the {local}"])
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        parts[r.randint(0, 3)] = str(r.randint(256, 999))
        return r.choice([".".join(parts), ".".join(parts[:3]), " . ".join(parts), f"{parts[0]}.{parts[1]}"])
    if kind == "card":
        d = _number(r, 15)
        d += next(c for c in "0123456789" if not _luhn(d + c))
        return r.choice(["", " ", ".", "-", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))
    y, m, d = r.randint(1900, 2099), r.randint(1, 12), r.randint(1, 28)
    return r.choice([f"{y}-{m:02}-{d:02} {r.randint(0, 23):02}:{r.randint(0, 59):02}", f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{_number(r, 3)}-{_number(r, 4)}", f"{_number(r, 3)},{_number(r, 3)},{_number(r, 3)}.{r.randint(10, 99)}", _number(r, r.randint(4, 9)), f"{y}-{y + 1}", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 30)}"])


def examples(text: str) -> list[tuple[int, str, np.ndarray]]:
    """(kind or -1, window, tags) of the base spans of a text, rewritten and spoilt ones, and plain numbers and signs."""
    spans, out = base(text), []
    taken = np.zeros(len(text) + 1, bool)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out.append((k, *_example(text, spans, (a + b) // 2)))
        taken[max(0, a - 8) : b + 8] = True
        r = random.Random(f"{a} {text[max(0, a - 20) : b + 20]}")
        words = [w for w in re.findall("[A-Za-z]{2,12}", text[max(0, a - 400) : a]) if w.isascii()]
        for make, times in ((rewritten, 12), (spoilt, 6)):
            for _ in range(times):
                value, at = make(kind, text[a:b], r, words), min(a, 40)
                made = text[a - at : a] + value + text[b : b + 40]
                held = [x for x in base(made) if x[2] <= at or x[1] >= at + len(value)]
                if make is rewritten:
                    held.append((kind, at, at + len(value)))
                mid = at + (len(value) // 2 if len(value) < WINDOW else r.randint(0, len(value)))
                out.append((k if make is rewritten else -1, *_example(made, held, mid)))
    for m in _LOOK.finditer(text):
        if not taken[m.start()]:
            part, tags = _example(text, spans, m.start())
            out.append((-1, part, tags))
            taken[max(0, m.start() - WINDOW // 2) : m.start() + WINDOW // 2] = True
    return out


def _sample(docs: DataFrame) -> DataFrame:
    """The `DOCS` distinct texts with a digit, an `@` or a `dot` whose hashes are lowest.

    A threshold on the hash leaves about twice as many before any text moves, so that no task reads more
    than that, however many partitions or copies there are.
    """
    hinted = docs.where(F.col("text").rlike("[0-9@]|dot")).select(F.xxhash64("text").alias("h"), "text")
    n = hinted.agg(F.approx_count_distinct("h")).first()[0]
    if n > 2 * DOCS:
        hinted = hinted.where(F.col("h") < int((2 * DOCS / n - 0.5) * 2**64))
    low = cut(hinted.groupBy("h").agg(F.min("text").alias("text")))
    last = low.select("h").orderBy("h").limit(DOCS).agg(F.max("h")).first()[0]
    return low.where(F.col("h") <= F.lit(last).cast("long"))


def fit(docs: DataFrame) -> dict | None:
    """Weights of the network; None if the sample has no base span."""

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, w, t.tolist()) for x in b.text for k, w, t in examples(x)]
            yield pd.DataFrame(rows, columns=["k", "w", "t"])

    made = cut(_sample(docs).mapInPandas(cuts, "k int, w string, t array<int>"))
    # short strings, KEPT of each kind and PLAIN without one at most
    low = lambda k, n: made.where(F.col("k") == k).dropDuplicates(["w"]).orderBy(F.xxhash64("w"), "w").limit(n).collect()
    some = [r for k in range(-1, len(KINDS)) for r in low(k, PLAIN if k < 0 else KEPT)]
    if not any(any(r.t) for r in some):
        return None
    codes, tags, mask = np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW), bool)
    for i, r in enumerate(some):
        codes[i, : len(r.w)], tags[i, : len(r.t)], mask[i, : len(r.w)] = _codes(r.w), r.t, True
    return Net().train(codes, tags, mask).p


def _starts(n: int, lo: int, hi: int) -> list[int]:
    """Where windows over [lo, hi) of a text of n characters start: one around a short stretch, overlapping ones along a long one."""
    if hi - lo <= WINDOW - 16:
        at = [lo - (WINDOW - (hi - lo)) // 2]
    else:
        at = list(range(lo - 8, hi - WINDOW + 8 + STRIDE, STRIDE))
    return sorted({max(0, min(x, n - WINDOW)) for x in at})


def tagged(net: Net, parts: list[tuple[str, int, int]]) -> list[np.ndarray]:
    """Tags of each stretch (text, lo, hi): overlapping windows are scored together, then reconciled and decoded."""
    cut = [(i, at) for i, (text, lo, hi) in enumerate(parts) for at in _starts(len(text), lo, hi)]
    scored = []
    for k in range(0, len(cut), 1024):
        codes = np.zeros((min(1024, len(cut) - k), WINDOW), np.int64)
        for j, (i, at) in enumerate(cut[k : k + 1024]):
            c = _codes(parts[i][0][at : at + WINDOW])
            codes[j, : len(c)] = c
        scored.append(net.scores(codes))
    flat = np.concatenate(scored) if scored else np.zeros((0, WINDOW, TAGS))
    whole = [np.zeros((hi - lo, TAGS), np.float32) for _, lo, hi in parts]
    edge = [np.full(hi - lo, -1) for _, lo, hi in parts]
    mid = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for (i, at), s in zip(cut, flat, strict=True):
        _, lo, hi = parts[i]
        a, b = max(at, lo), min(at + WINDOW, hi)
        better = mid[a - at : b - at] > edge[i][a - lo : b - lo]
        whole[i][a - lo : b - lo][better] = s[a - at : b - at][better]
        edge[i][a - lo : b - lo][better] = mid[a - at : b - at][better]
    return net.paths(whole) if whole else []


_AT = re.compile(r"@|(?<![A-Za-z])at(?![A-Za-z])")
_OPEN = re.compile(r"(\.|[ (\[]dot)$")
_WORD = re.compile(r"[\])]?(?: ?[A-Za-z]+)?")
_DOT = re.compile(r"\.|(?<![A-Za-z])dot(?![A-Za-z])")


def _fits(kind: str, s: str) -> bool:
    """Whether a string holds what its kind needs."""
    d = _digits(s)
    if kind == "email":
        at = _AT.search(s)
        return bool(at and at.start() > 0 and (dot := _DOT.search(s, at.end())) and dot.end() < len(s))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(d) <= 19 and _luhn(d) if kind == "card" else 10 <= len(d) <= 15


def _address_edges(text: str, a: int, b: int) -> tuple[int, int]:
    """The edges of an address that was found roughly at [a, b): the word before its last at sign, and the end of the word after its last dot."""
    ats = list(_AT.finditer(text, a, b))
    if not ats:
        return a, b
    a = ats[-1].start()
    while a and text[a - 1] in " ([":
        a -= 1
    while a and _LOCAL.match(text[a - 1]):
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    if _OPEN.search(text, a, b):  # cut off behind a dot
        b = _WORD.match(text, b).end()
    return a, b


def added(text: str, found: list[tuple[str, int, int]], lo: int, tags: np.ndarray | list[int]) -> list[tuple[str, int, int]]:
    """Spans of one stretch that the tags add to the base ones."""
    out, j, n = [], 0, len(tags)
    for k in np.flatnonzero(tags).tolist():
        if k < j:
            continue
        kind, j = (int(tags[k]) - 1) // 2, k + 1
        while j < n and tags[j] == 2 + 2 * kind:
            j += 1
        a, b = lo + k, lo + j
        while b > a and not text[b - 1].isalnum():
            b -= 1
        name = KINDS[kind]
        if name == "email":
            a, b = _address_edges(text, a, b)
        whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if whole and _fits(name, text[a:b]) and not any(a < y and x < b for _, x, y in found):
            out.append((name, a, b))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def _shared(where: list[tuple[int, int, int]], chars: int = 1_000_000) -> Iterator[list[tuple[int, int, int]]]:
    """The stretches by length, in turns of about `chars` characters, whose scores are held at once."""
    some: list[tuple[int, int, int]] = []
    for w in sorted(where, key=lambda w: w[2] - w[1]):
        if some and (len(some) + 1) * (w[2] - w[1]) > chars:
            yield some
            some = []
        some.append(w)
    if some:
        yield some


def read(net: Net, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text that the network adds: stretches whose tags reach an end of theirs are read again, twice as far, until none does."""
    out: list[set] = [set() for _ in texts]
    todo = [(i, lo, hi) for i, t in enumerate(texts) for lo, hi in stretches(t)]
    while todo:
        again = set()
        for some in _shared(todo):
            for (i, lo, hi), tags in zip(some, tagged(net, [(texts[i], lo, hi) for i, lo, hi in some]), strict=True):
                n, by = len(texts[i]), max(FURTHER, hi - lo)
                if (tags[0] and lo) or (tags[-1] and hi < n):
                    again.add((i, max(0, lo - by) if tags[0] else lo, min(n, hi + by) if tags[-1] else hi))
                else:
                    out[i].update(added(texts[i], bases[i], lo, tags))
        todo = sorted(again)
    return [sorted(x) for x in out]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, all spans of every whole text."""
    weights = fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net()
        if weights:
            net.p = weights
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            bases = [base(t) for t in texts]
            spans = [list(s) for s in bases]
            if weights:
                for x, more in zip(spans, read(net, texts, bases), strict=True):
                    x += more
            counts = [pa.array([sum(s[0] == k for s in x) for x in bases], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in bases]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), *counts, pa.array(sha, pa.string()), pa.array([_joined(s) for s in spans], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")
