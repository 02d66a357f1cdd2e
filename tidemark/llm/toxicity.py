"""Toxicity by weak supervision.

Voters are lexicon words, word stems and patterns; one that doesn't fire abstains. Labels choose the
stems and give the voters' first accuracies, as pseudo-counts. A row's own label reaches its posterior
only as one count among those of all labelled rows: rows of equal votes have equal posteriors, whatever
their labels, and rows without a label take part alike. A generative label model (EM) estimates how often each voter
fires on either class and how voters depend on each other: a spanning tree joins those that share most
given the class, and a vote counts by how likely it is on either class, given what the voter above it
in the tree did; a row without any vote has the evidence of its silence. The posteriors of all fitted rows train a logistic classifier on words, stems and
patterns, which scores all documents.

At most `ROWS` labelled and `MORE` other training documents (the lowest by a hash of doc_id) are fitted;
all else covers all rows. Labels, language, source and doc_id are never inputs of a score.

Nulls and odd inputs: null and empty texts get the score of a text without words; null labels and
labels without a document are ignored; without any usable label every score is 0; of training rows that
share a doc_id the least text is fitted; repeated rows get equal scores; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bounds of the fitted sample (labelled, other), of the features, of the stems that vote.
ROWS, MORE, FEATURES, VOTERS = 20_000, 5_000, 1_200, 150
#: Fixed word list: insults in common use.
LEXICON = "idiot moron stupid dumb loser pathetic worthless disgusting trash scum clown fool jerk ugly hate kill shut filthy vermin garbage".split()
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (3, 4, 5, 6, 7)
#: Log odds, less two standard errors, that a stem needs to vote.
SURE = 1.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def tokens(text: str | None) -> set[str]:
    """Words, and stems of words marked with `~`, of a whole text."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "~" for w in words for n in _STEMS if len(w) > n}


def patterns(text: str | None) -> list[float]:
    """Shouting, exclamation and second person, each 0 or 1."""
    t = text or ""
    upper = sum(map(str.isupper, t))
    low = t.lower()
    return [float(upper > 0.3 * len(t)), float(t.count("!") * 40 > len(t) > 0), float(" you " in low), float(bool(re.search(r"\byou(?:'re| are) (?:an? )?", low)))]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the fitted rows, one per doc_id: at most `ROWS` labelled ones and `MORE` with a null label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = ~held_out(F.col("doc_id"))
    low = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & train).distinct()
    other = ids.join(known, "doc_id", "left_anti")
    pick = low(known.where(train).join(ids, "doc_id", "left_semi"), ROWS).union(low(other, MORE).withColumn("toxic", F.lit(None).cast("int")))
    hit = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")  # pick has ROWS + MORE rows at most
    return hit.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("text", "toxic")


def _frequent(sample: DataFrame) -> list[tuple[str, float]]:
    """The tokens that set the classes apart most, with their log odds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, neg = Counter(), Counter()
        n1 = n0 = 0
        for b in batches:
            for text, y in zip(b.text, b.toxic, strict=True):
                (pos if y else neg).update(tokens(text))
                n1, n0 = n1 + bool(y), n0 + (not y)
        rows = [(k, pos[k], neg[k]) for k in pos.keys() | neg.keys()] + [("", n1, n0)]
        yield pd.DataFrame(rows, columns=["token", "p", "n"])

    counted = sample.where("toxic is not null").mapInPandas(count, "token string, p long, n long").groupBy("token").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    counted = counted.persist()
    total = counted.where("token = ''").first()
    if not total or not total.p:
        counted.unpersist()
        return []
    odds = F.log(((F.col("p") + 0.5) / (total.p + 1)) / ((F.col("n") + 0.5) / (total.n + 1)))
    # log odds, less two standard errors: rare tokens must be purer
    sure = odds - 2 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    top = counted.where("token <> '' and p >= 4").withColumn("sure", sure).where("sure > 0").orderBy(F.desc("sure"), "token").limit(FEATURES).select("token", "sure").collect()
    counted.unpersist()
    return [(r.token, r.sure) for r in top]


def pick_voters(fires: np.ndarray, y: np.ndarray, sure: np.ndarray, most: int) -> list[int]:
    """Columns of `fires` (labelled rows x stems) that vote: surest first, those that add to rows already covered count half each time."""
    toxic = fires[y > 0]
    cover, left, out = np.zeros(len(toxic)), sure >= SURE, []
    for _ in range(most):
        gain = np.where(left, (0.5**cover @ toxic) * sure, 0)
        k = int(np.argmax(gain)) if len(gain) else 0
        if not len(gain) or gain[k] <= 0:
            break
        out.append(k)
        left[k] = False
        cover += toxic[:, k]
    return out


def pair_counts(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """[a, b, i, j]: weight of the rows where voter i says a and voter j says b."""
    on, both = weight @ votes, (votes * weight[:, None]).T @ votes
    n10, n01 = on[:, None] - both, on[None, :] - both
    return np.array([[weight.sum() - n10 - n01 - both, n01], [n10, both]])


def dependencies(classes: list[np.ndarray]) -> np.ndarray:
    """Parent of each voter (-1: none) in the spanning tree of greatest mutual information given the class."""
    info = 0.0
    for c in classes:
        p = (c + 0.5) / (c + 0.5).sum((0, 1))
        info = info + c.sum((0, 1)) * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum((0, 1))
    n = len(info)
    parent, best, via, done, at = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.zeros(n, bool), 0
    for _ in range(n - 1):
        done[at] = True
        better = ~done & (info[at] > best)
        best[better], via[better] = info[at][better], at
        at = int(np.argmax(np.where(done, -np.inf, best)))
        parent[at] = via[at]
    return parent


def evidence(votes: np.ndarray, toxic: np.ndarray, clean: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Log odds that the cast votes of each row add up to, each given what its parent in the tree did."""
    own = np.arange(votes.shape[1])
    up, root = np.where(parent < 0, own, parent), parent < 0

    def fires(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(a voter fires) where its parent is silent, and where it fires."""
        alone = (c[1, 1, own, own] + 0.5) / (c[1, 1, own, own] + c[0, 0, own, own] + 1)
        given = (c[:, 1, up, own] + 0.5) / (c[:, 0, up, own] + c[:, 1, up, own] + 1)
        return np.where(root, alone, given[0]), np.where(root, alone, given[1])

    (t0, t1), (c0, c1) = fires(toxic), fires(clean)
    above = votes[:, up] * ~root
    return (votes * (1 - above)) @ np.log(t0 / c0) + (votes * above) @ np.log(t1 / c1)


def _posterior(said: np.ndarray, silent: np.ndarray, quiet: float, share: float) -> np.ndarray:
    """Logistic of `said`, moved so that all rows' mean is `share`; rows without a vote have `quiet`."""
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    lo, hi = -60.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        p = np.where(silent, sigmoid(quiet), sigmoid(said + mid))
        lo, hi = (mid, hi) if p.mean() < share else (lo, mid)
    return p


def label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior P(toxic) of rows x voters (0/1); y: 1, 0, or -1 for rows without a label.

    Labels enter as pseudo-counts of the voters' accuracies and as the share of toxic rows only. Single
    voters abstain, but the silence of all of them is evidence of its own.
    """
    known = [pair_counts(votes[y >= 0], (y[y >= 0] == k).astype(float)) for k in (0, 1)]
    share = float(np.clip((y == 1).sum() / max(1, (y >= 0).sum()), 0.001, 0.5))
    silent = ~votes.any(1)
    mute = [np.array([((y == k) & silent).sum(), (y == k).sum()], float) for k in (0, 1)]
    (clean, toxic), (still, hush) = known, mute
    post = None
    for _ in range(rounds):
        quiet = math.log(share / (1 - share)) + math.log((hush[0] + 0.5) / (hush[1] + 1)) - math.log((still[0] + 0.5) / (still[1] + 1))
        new = _posterior(evidence(votes, toxic, clean, dependencies([clean, toxic])), silent, quiet, share)
        if post is not None and np.abs(new - post).max() < 1e-3:
            return new
        post = new
        clean, toxic = (k + pair_counts(votes, w) for k, w in zip(known, (1 - post, post), strict=True))
        still, hush = (k + np.array([w[silent].sum(), w.sum()]) for k, w in zip(mute, (1 - post, post), strict=True))
    return post


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 500) -> np.ndarray:
    """Weights by accelerated gradient steps; x is dense rows x features, its last column the bias."""
    n, d = x.shape
    w = np.zeros(d, np.float32)
    v, keep, y = w.copy(), np.full(d, l2, np.float32), y.astype(np.float32)
    keep[-1] = 0
    step = np.float32(4.0 / (np.einsum("ij,ij->i", x, x).mean() + 1e-9))
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        nxt = v - step * ((p - y) @ x / np.float32(n) + keep * v)
        v = nxt + np.float32((k - 1) / (k + 2)) * (nxt - w)
        w = nxt
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float], float] | None:
    """Token weights, pattern weights and bias; None without labels of toxic rows."""
    sample = cut(_sample(docs, labels))
    top = _frequent(sample)
    if not top:
        return None
    names = list(dict.fromkeys([*LEXICON, *(t for t, _ in top)]))
    at, sure = {t: i for i, t in enumerate(names)}, dict(top)

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"on": [sorted(at[t] for t in tokens(x) if t in at) for x in b.text], "more": [patterns(x) for x in b.text], "toxic": b.toxic.fillna(-1).astype(int)})

    # at most ROWS + MORE rows of the numbers of the features that fire, in a fixed order
    rows = sorted(sample.mapInPandas(fire, "on array<int>, more array<double>, toxic int").collect(), key=lambda r: (r.on, r.more, r.toxic))
    y = np.array([r.toxic for r in rows])
    x = np.zeros((len(rows), len(names) + len(rows[0].more) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r.on] = 1
        x[i, len(names) : -1] = r.more
    stems = list(range(len(LEXICON), len(names)))
    chosen = pick_voters(x[y >= 0][:, stems], y[y >= 0], np.array([sure[names[i]] for i in stems]), VOTERS)
    voters = [*range(len(LEXICON)), *(stems[k] for k in chosen), *range(len(names), x.shape[1] - 1)]
    w = logistic(x, label_model(x[:, voters].astype(float), y))
    weights = {t: float(w[i]) for t, i in at.items() if abs(w[i]) > 1e-6}
    return weights, [float(v) for v in w[len(names) : -1]], float(w[-1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            if model:
                weights, more, bias = model
                get = weights.get
                for i, text in enumerate(b["text"].to_pylist()):
                    z = bias + math.fsum(get(t, 0.0) for t in sorted(tokens(text) & weights.keys())) + sum(a * c for a, c in zip(more, patterns(text), strict=True))
                    out[i] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(out)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
