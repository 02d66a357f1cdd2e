"""The operators of the pipeline against brute force, and on odd input."""

import math
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from tidemark.llm import line_dedup, mixing, pieces, quality, queries, simhash
from tidemark.llm.common import documents

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SMALL).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def _base(text):
    w = WORD.findall(text or "")
    n, hit = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(docs, rows, odd, empty):
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(rows[r.doc_id].text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)
    got = quality.judge(odd)
    assert got.count() == odd.count() and got.where("kept is null or base_failed is null").count() == 0
    assert quality.keep(odd).columns == odd.columns and quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0


def test_quality_hosts(spark):
    good, bad = " ".join(f"a{i}" for i in range(40)), "too short"
    rows = [(i, good if i % 40 else bad, "en", f"h{i % 5}", 1) for i in range(400)] + [(1000 + i, bad if i % 20 else good, "en", "junk", 1) for i in range(200)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert not any(r.kept for r in out if r.doc_id >= 1000) and all(r.kept for r in out if r.doc_id < 1000 and not r.base_failed)


def test_mixing(docs, rows, odd, empty):
    got = mixing.taken(docs).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in mixing.taken(docs).collect()) == sorted((r.doc_id, r["size"], r.taken) for r in got)
    size, taken, target = defaultdict(int), Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r.doc_id].text)) and 0 <= r.taken <= 2 * r["size"]
        s = rows[r.doc_id].source
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, want, open_ = 1.5 * sum(size.values()), {}, set(names)
    while True:
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            want |= share
            break
        want |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    for s in names:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    out = mixing.taken(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 2 * r["size"] for r in out)
    n = sum(r.copies for r in out)
    mixed = mixing.repeat_documents(odd)
    assert mixed.count() == n and mixed.columns == odd.columns
    assert mixing.taken(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0


def test_mixing_is_repeatable(spark):
    """Rows equal in id and text but not in other columns, over three partitionings, with many equal rows."""
    rows = [(1, "same words here", "en", "s", 3, f"x{i}") for i in range(50)] + [(i, f"w{i} " * (1 + i % 7), "en", "st"[i % 2], 4, "y") for i in range(2, 200)]
    rows += [(None, "z z", "en", None, 2, f"n{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    got = [Counter(map(str, mixing.repeat_documents(df.repartition(k, "extra")).collect())) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len([r for r in got[0] if "same words here" in r]) == 1
    per = [sorted(map(str, mixing.taken(df.repartition(k, "extra")).collect())) for k in (1, 3)]
    assert per[0] == per[1] and len(per[0]) == len(rows)
    equal = mixing.taken(df).where("doc_id = 1").collect()
    assert len(equal) == 50 and {r.copies for r in equal} <= {0, 1, 2} and max(r.copies for r in equal) - min(r.copies for r in equal) <= 1
    assert sum(got[0].values()) == sum(r.copies for r in mixing.taken(df).collect())
    many = mixing.mix(mixing.sizes(spark.range(100_000).selectExpr("7L doc_id", "'a b c' text", "'s' source"))).collect()
    assert [(r.rows, r.copies) for r in many] == [(100_000, 150_000)]


def test_mixing_multipliers(docs):
    sized = mixing.sizes(docs)
    out = mixing.multipliers(sized, mixing.targets(sized)).collect()
    by = defaultdict(list)
    for r in sized.collect():
        by[r.source].append(r["size"])
    for r in out:
        got = sum(n * min(2.0, math.exp(min(50, r.lam * n / r["mean"]))) for n in by[r.source])
        assert got == pytest.approx(r.target, rel=1e-4)


def _print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows, odd, empty):
    want = {i: _print(r.text) for i, r in rows.items()}
    comp = _components(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    for r in simhash.near_duplicates(docs).collect():
        assert int(r.fingerprint, 16) == want[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == comp[r.doc_id]
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.keep_one(odd).columns == odd.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_simhash_links(spark):
    import random

    rng, fps = random.Random(5), set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            fps.add(y)
    comp = _components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for most in (4096, 3):  # 3: nearly every anchor is refined
        got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, most=most).collect()]
        linked = set(map(frozenset, got))
        assert _components(fps, lambda a, b, e=linked: frozenset((a, b)) in e) == comp


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_distance(spark, t):
    import random

    rng, pairs = random.Random(t), []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, t + 2)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        pairs.append((a, "".join(b)))
    out = spark.createDataFrame(pairs, "a string, b string").withColumn("ok", line_dedup.edit_within(F.col("a"), F.col("b"), t)).collect()
    for r in out:
        assert r.ok == (_distance(r.a, r.b) <= t), (r.a, r.b)


@pytest.mark.parametrize("t", [1, 2])
def test_line_pairs_of_crowded_segments(spark, t):
    import random

    rng, lines = random.Random(5), {"the same long first half of all lines, " * 2 + "x" * k for k in range(6)}
    for _ in range(60):
        x = "the same long first half of all lines " + "".join(rng.choice("ab") for _ in range(8)) + " and an end"
        k = rng.randint(0, len(x) - 1)
        lines |= {x, x[:k] + rng.choice(["", "z", x[k] + "y"]) + x[k + 1 :]}
    df = spark.createDataFrame([(i, f"{x}\n{x}") for i, x in enumerate(sorted(lines))], "doc_id long, text string")
    hashes = {r.h: r.line for r in line_dedup._lines(df, 20).collect()}
    want = {frozenset((a, b)) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= t and _distance(a, b) <= t}
    for most in (20, 10_000):
        got = [frozenset((hashes[r.a], hashes[r.b])) for r in line_dedup.near_pairs(df, t, 20, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("t", [1, 2])
def test_line_dedup(spark, odd, empty, t):
    import random

    rng, lines = random.Random(3), []
    for _ in range(25):
        x = "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 30)))
        lines.append(x)
        for _ in range(4):
            k = rng.randint(0, len(x) - 1)
            x = x[:k] + rng.choice(["", "z", x[k] + "y"]) + x[k + 1 :]
            lines.append(x)
    rng.shuffle(lines)
    texts = {i: "\n".join([*lines[5 * i : 5 * i + 5], "short", *lines[3 * i : 3 * i + 2]]) for i in range(25)}
    df = spark.createDataFrame([(i, x) for i, x in texts.items()], "doc_id long, text string")
    distinct = {x for y in texts.values() for x in y.split("\n") if len(x) >= 20}
    comp = _components(distinct, lambda a, b: abs(len(a) - len(b)) <= t and _distance(a, b) <= t)
    seen, want = set(), {}
    for i, text in texts.items():
        stay = []
        for x in text.split("\n"):
            if x not in comp or comp[x] not in seen:
                stay.append(x)
                seen.add(comp.get(x))
        want[i] = "\n".join(stay)
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df, t).collect()}
    assert got == want
    assert line_dedup.report(odd).count() == odd.count() and line_dedup.drop_lines(odd).columns == odd.columns
    assert line_dedup.report(empty).count() == 0 and line_dedup.drop_lines(empty).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """Rows of one doc_id or of none are documents of their own: nothing that is told once goes."""
    a, b, c = (f"{x} is a line of more than twenty characters" for x in ("first", "second thing", "a third of them"))
    rows = [(1, a), (5, a), (5, b), (None, f"{c}\n{b}"), (None, f"x\n{a}\n{a} 2"), (None, "only here and nowhere else at all"), (9, f"{c}\n{c}"), (9, f"{c}\n{c}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text) for r in line_dedup.drop_lines(df, short=True).collect()]
    kept = Counter(x for _, t in out for x in t.split("\n") if x)
    # one of each line, though `a 2` may go as a near copy; rows without an id come first
    assert all(kept[x] == 1 for x in (a, b, c, "only here and nowhere else at all", "x")) and len(out) == len(rows)
    assert Counter(d for d, _ in out) == Counter(d for d, _ in rows) and (5, "") in out and out.count((9, "")) == 2
    many = "\n".join(["the same line of more than twenty"] * 30_000 + [f"line {i} of its own kind, told once" for i in range(0, 3_000_000, 100_003)])
    got = line_dedup.report(spark.createDataFrame([(1, many)], "doc_id long, text string"), short=True).collect()
    assert got[0].n_exact == 29_999


def test_short_lines(spark, tmp_path):
    texts = ["short\n\n \nother", "short\nshor\n\n \nthird", "short\nother\n" + "a line of more than twenty", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = documents(spark, str(tmp_path))
    kept = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, str(tmp_path)).collect()}
    assert kept == {0: texts[0], 1: "shor\n\n \nthird", 2: "a line of more than twenty", 3: None}
    got = {r.doc_id: (r.n_exact, r.n_near) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (0, 0)}


def test_sentencepiece(docs, rows, odd, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for giant, chunk in ((pieces.GIANT, pieces.CHUNK), (200, 64)):  # the second cuts nearly every text
        out = pieces.encode(docs.where("doc_id < 60"), giant=giant, chunk=chunk).collect()
        assert len(out) == 60
        for r in out:
            assert r.ids == sp.encode(rows[r.doc_id].text) and r.exact, r.doc_id
    assert max(r.n_chunks for r in out) > 64
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert back == {i: r.text for i, r in rows.items()}
    for chunk in (48, pieces.CHUNK):
        out = pieces.encode(odd, giant=60, chunk=chunk).collect()
        assert len(out) == odd.count()
        assert Counter(tuple(r.ids) for r in out) == Counter(tuple(sp.encode(r.text or "")) for r in odd.collect())
    assert pieces.encode(empty).count() == 0
