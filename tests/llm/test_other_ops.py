"""Toxicity, suffix dedup, url filter, sketches and PII against brute force, and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import bwt_dedup, iblt, pii, toxicity, url_filter

KIND = "doc_id long, text string"


@pytest.mark.parametrize("hot", [4_096, 3])
def test_suffix_dedup(spark, odd, empty, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)  # 3: most minimizers are dealt by window
    rng = random.Random(4)
    shared = ["".join(rng.choice("abc é") for _ in range(130)) for _ in range(6)]
    texts = ["".join(rng.choice([*shared, "x" * 150, *[s[: rng.randint(1, 130)] for s in shared]]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(rest).hexdigest())
    got = bwt_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), KIND).repartition(4)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert bwt_dedup.dedup(odd).count() == odd.count() and bwt_dedup.dedup(empty).count() == 0


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    """Rows of one doc_id or of none, in the order of their texts' hashes: one of equal passages stays, rows equal in both are one."""
    rng = random.Random(7)
    x, y, z = ("".join(rng.choice("abcdef é") for _ in range(250)) for _ in range(3))
    rows = [(1, x), (5, x), (5, y), (5, z + x[:120]), (5, y), (None, z), (None, "n" + y[:130]), (7, y + z), (8, None), (None, None)]

    def key(r):
        tie = xxh64_intdigest(r[1].encode(), 42)
        return (r[0] is not None, r[0] or 0, tie - (1 << 64) * (tie >> 63))

    seen, want = set(), []
    for r in sorted({r for r in rows if r[1]}, key=key):
        b = r[1].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want += [(r[0], bytes(c for c, g in zip(b, gone, strict=True) if not g))] * rows.count(r)
    got = bwt_dedup.dedup(spark.createDataFrame(rows, KIND).repartition(4)).collect()
    assert sorted(map(str, ((r.doc_id, bytes(r.kept)) for r in got))) == sorted(map(str, [*want, (8, b""), (None, b"")]))


def test_merge_of_many_shards(monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SHARD", 2)
    rng = random.Random(9)
    base = bytes(rng.choice(b"ab") for _ in range(140))
    texts = [base[rng.randint(0, 40) :] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(11)]
    texts = [t for t in texts if len(t) >= 100]
    doc, at = bwt_dedup.partial(texts, np.arange(len(texts)), np.zeros(len(texts), np.int64))
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                want.add((i, k))
            seen.add(t[k : k + 100])
    assert set(zip(doc.tolist(), at.tolist(), strict=True)) == want


def test_merge_decides(monkeypatch):
    """Windows whose both ends repeat but whose midst differs stay; without the merged order they would go."""
    head, tail = b"h" * 16 + b"the same first bytes" * 2, b"and the same last bytes, every time alike" + b"t" * 9
    texts = [head + bytes([97 + i]) * 10 + tail for i in range(8)] + [head + b"a" * 10 + tail]
    assert all(len(t) >= 100 for t in texts)
    doc, at = bwt_dedup.partial(texts, np.arange(9), np.zeros(9, np.int64))
    assert set(doc.tolist()) == {8} and sorted(at.tolist()) == list(range(len(texts[0]) - 99))
    monkeypatch.setattr(bwt_dedup, "merge", lambda shards: (np.concatenate([s.names for s in shards]), np.zeros(sum(len(s.names) for s in shards), np.int64)))
    assert len(bwt_dedup.partial(texts, np.arange(9), np.zeros(9, np.int64))[0]) > len(doc)


def test_sketches(spark, odd, empty):
    texts = {i: "\n".join(f"line {i} {k} " + "w" * (k % 7) for k in range(5 * i)) for i in range(30)}
    texts[30] = texts[7]
    rows = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(list(texts.items()), KIND).repartition(3)).collect()}
    for i, t in texts.items():
        after = texts[(i + 1) % len(texts)]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = (set(iblt.digests(x).tolist()) for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
    assert rows[30].fingerprint == rows[7].fingerprint
    many = [(5, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(100, 140)] + [(None, "n1"), (None, "n2")]
    df = spark.createDataFrame(many, KIND).repartition(3)
    order = [r.text for r in df.selectExpr("*", "xxhash64(text) AS h").orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    got = {(r.doc_id, r.edited_sha256) for r in iblt.fingerprints(df).collect()}
    cut = lambda t: t[: len(t) - len(t) // 4] + after[t][: len(t) // 4]
    assert got == {(i, hashlib.sha256(cut(t).encode()).hexdigest()) for i, t in many}
    assert iblt.fingerprints(odd).count() == odd.count() and iblt.fingerprints(empty).count() == 0


def test_url_filter(spark):
    urls = ["https://A.x.Example.com/de/1?q#f", "http://b.net/1", "http://example.net/en/4", "http://net", "nothing", None, "ftp://k.org/fr/5", "http://k.org/bad/7", "http://k.org/bad/7"] + [f"http://k.org/bad/{i}" for i in range(100, 140)] + [f"http://k.org/good/{i}" for i in range(200, 240)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(100, 140)] + [(i, 1, 0) for i in range(200, 240)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(out) == len(urls)
    assert [(out[i].host, out[i].path, out[i].rule) for i in range(7)] == [("a.x.example.com", "/de/1", "example.com/de/"), ("b.net", "/1", "net/"), ("example.net", "/en/4", "example.net/en/"), ("net", "", None), ("", "", None), ("", "", None), ("k.org", "/fr/5", "org/fr/")]
    assert [out[i].verdict for i in (0, 1, 2, 6)] == ["block", "block", "allow", "allow"]
    assert out[7].verdict == out[8].verdict == out[20].verdict == "block" and out[60].verdict == "allow"
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_base_spans():
    text = "mail a.b%c@x-y.co.uk, x@y no; ip 1.2.3.4 999.1.1.1; card 4111 1111 1111 1111 tel +1 (988) 555-2485; 4111111111111112"
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    got = pii.base(text)
    assert [(a, b) for k, a, b in got if k == "email"] == [m.span() for m in email.finditer(text)]
    assert [(k, text[a:b]) for k, a, b in got if k != "email"] == [("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (988) 555-2485")]
    assert pii.base("") == [] and pii.base("q" * 100_000) == []


def test_pii(spark, odd, empty):
    rows = [(i, f"some words +1 ({200 + i}) 555-{1000 + i} and n{i}@mail.example.com here") for i in range(60)] + [(99, "call (988) 555-2485 now"), (100, None)]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, KIND)).collect()}
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base(t or ""))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(out[i].spans.split(","))
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0


def test_pii_sample(spark, monkeypatch):
    monkeypatch.setattr(pii, "DOCS", 50)
    docs = spark.createDataFrame([(i, f"text {max(300, i)} @") for i in range(1000)], KIND)
    want = sorted(r.h for r in docs.selectExpr("xxhash64(text) AS h").distinct().collect())[:50]
    assert sorted(r.h for r in pii._sample(docs).collect()) == want


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["tree", "river", "stone", "cloud", "idiot" if i % 4 == 0 else "lamp"]) for _ in range(30))) for i in range(400)]
    df = spark.createDataFrame(docs, KIND)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.score(df, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.score(odd, labels).count() == odd.count()
    assert toxicity.score(empty, labels).count() == 0 and {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}


def test_toxicity_counts_of_any_partitioning(spark):
    rng = random.Random(6)
    rows = [(" ".join(["idiot"] * (i % 8 == 0) + rng.sample(["tree", "river", "stone", "cloud", "lamp"], 3)), int(i % 8 == 0)) for i in range(160)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    want = toxicity._frequent(df.coalesce(1))
    assert {t for t, _ in want} == {"idiot", "idi~", "idio~"}
    assert toxicity._frequent(df.repartition(40)) == want
