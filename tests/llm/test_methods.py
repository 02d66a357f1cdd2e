"""The methods of the operators against brute force, and tests that fail if a method is taken out."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from test_pipeline_ops import _base, _components, _distance, _print

import corpus_pipeline
from tidemark.llm import mixing, pieces, pii, toxicity, url_filter
from tidemark.llm.common import documents

SMALL = "/root/testdata/sf0.001"


# -- toxicity


def _votes():
    rng = random.Random(8)
    y = [int(rng.random() < 0.3) for _ in range(240)]
    rows = []
    for t in y:
        a = int(rng.random() < (0.7 if t else 0.05))
        rows.append([a, int(a and rng.random() < 0.9), int(rng.random() < (0.5 if t else 0.1)), int(rng.random() < (0.4 if t else 0.02)), int(rng.random() < 0.3)])
    return np.array(rows, float), np.array([t if i % 3 else -1 for i, t in enumerate(y)])


def _brute_model(votes, y, rounds=30):
    """The label model with plain loops over rows and pairs."""
    n, m = votes.shape
    known = [i for i in range(n) if y[i] >= 0]
    share = sum(y[i] == 1 for i in known) / len(known)
    labels = {c: {i: float(y[i] == c) for i in known} for c in (0, 1)}

    def count(c, post):
        weight = dict.fromkeys(range(n), 0.0)
        for i in known:
            weight[i] += labels[c][i]
        if post is not None:
            for i in range(n):
                weight[i] += post[i] if c else 1 - post[i]
        return lambda i, a, j, b: sum(w for r, w in weight.items() if votes[r][i] == a and votes[r][j] == b)

    post = None
    for _ in range(rounds):
        counts = [count(c, post) for c in (0, 1)]
        tables = [{(i, j): [[f(i, a, j, b) for b in (0, 1)] for a in (0, 1)] for i in range(m) for j in range(m)} for f in counts]
        info = {}
        for i in range(m):
            for j in range(m):
                total = 0.0
                for t in tables:
                    cell = t[i, j]
                    whole, size = sum(map(sum, cell)) + 2, sum(map(sum, cell))
                    p = [[(v + 0.5) / whole for v in row] for row in cell]
                    total += size * sum(p[a][b] * math.log(p[a][b] / (sum(p[a]) * (p[0][b] + p[1][b]))) for a in (0, 1) for b in (0, 1))
                info[i, j] = total
        parent, done = {0: None}, [0]
        while len(done) < m:
            i, j = max(((i, j) for i in done for j in range(m) if j not in done), key=lambda e: info[e])
            parent[j] = i
            done.append(j)
        z = []
        for r in range(n):
            s = 0.0
            for i in range(m):
                if votes[r][i]:
                    rate = []
                    for t in tables:
                        if parent[i] is None:
                            on, off = t[i, i][1][1], t[i, i][0][0]
                        else:
                            up = int(votes[r][parent[i]])
                            on, off = t[parent[i], i][up][1], t[parent[i], i][up][0]
                        rate.append((on + 0.5) / (on + off + 1))
                    s += math.log(rate[1] / rate[0])
            z.append(s)
        silent = [not any(votes[r]) for r in range(n)]
        mute = []
        for c in (0, 1):
            w = {i: labels[c].get(i, 0.0) + (0 if post is None else post[i] if c else 1 - post[i]) for i in range(n)}
            mute.append((sum(v for i, v in w.items() if silent[i]) + 0.5) / (sum(w.values()) + 1))
        quiet = math.log(share / (1 - share)) + math.log(mute[1]) - math.log(mute[0])
        lo, hi = -60.0, 60.0
        for _ in range(60):
            mid = (lo + hi) / 2
            new = [1 / (1 + math.exp(-max(-30, min(30, quiet if q else v + mid)))) for v, q in zip(z, silent, strict=True)]
            lo, hi = (mid, hi) if sum(new) / n < share else (lo, mid)
        if post is not None and max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-3:
            return new
        post = new
    return post


def test_label_model():
    votes, y = _votes()
    got = toxicity.label_model(votes, y)
    assert got == pytest.approx(_brute_model(votes, y), abs=1e-6)
    # the label of a row is no evidence for it: rows of equal votes have equal posteriors, labelled or not
    by = defaultdict(set)
    for row, p in zip(votes.tolist(), got, strict=True):
        by[tuple(row)].add(round(float(p), 9))
    assert all(len(v) == 1 for v in by.values())
    same = ((got > 0.5) == (y == 1))[y >= 0]
    assert not same.all() and same.mean() > 0.8
    # voters that depend on each other count less than independent ones
    twice = np.hstack([votes, votes[:, :1]])
    assert toxicity.label_model(twice, y) == pytest.approx(got, abs=0.05)


def test_toxicity_learns_from_unlabelled(spark):
    """Words that only ever occur with insults in rows without a label get weight: taking the label model out loses them."""
    rng = random.Random(1)
    words = ["tree", "river", "stone", "cloud", "lamp", "road"]
    text = lambda bad: " ".join(rng.sample(words, 4) + (["idiot", "moron"] if bad else []))
    docs = [(i, text(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    few = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 600, 3)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.score(df, few).collect()}
    assert sum(out[i] == int(i % 5 == 0) for i in range(600)) >= 590
    # a row whose own label is wrong is scored by its votes
    wrong = spark.createDataFrame([(i, 1, int(i % 5 == 0 and i % 120 > 0)) for i in range(0, 600, 3)], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.predicted for r in toxicity.score(df, wrong).collect()}
    assert all(again[i] for i in range(0, 600, 120))


# -- url filter


def _shape(seg):
    if re.match(r"^[0-9]+(\.[a-z0-9]+)?$", seg):
        return re.sub("^[0-9]+", "*", seg)
    return "*" if re.match("^[0-9a-f-]{8,}$", seg) and re.search("[0-9]", seg) else seg


def _brute_tree(urls, good):
    """(template, rejected) of each url by plain recursion over each host's tree."""
    u = url_filter
    paths = defaultdict(dict)
    for url in urls:
        host = re.match("[^/]*", url.split("://")[1])[0]
        segs = [_shape(s) for s in url.split("://")[1][len(host) :].split("/") if s]
        if len(segs) > u.LEVELS:
            segs = segs[: u.LEVELS] + ["/".join(segs[u.LEVELS :])]
        paths[host][url] = segs
    rate = lambda n, g: g / n if n else None
    template = {}
    for host, of in paths.items():
        now = {url: () for url in of}
        for k in range(max(map(len, of.values()))):
            kids = defaultdict(Counter)
            for url, segs in of.items():
                if len(segs) > k:
                    kids[now[url]][segs[k]] += 1
            for url, segs in of.items():
                if len(segs) > k:
                    c = kids[now[url]]
                    rare = len(c) > u.CHILDREN and c[segs[k]] < u.SHARE * sum(c.values())
                    template[url] = ("*" if rare else segs[k],)
            now = {url: now[url] + (template[url] if len(segs) > k else ()) for url, segs in of.items()}
        template |= now
    out = {}
    label = {url: good.get(int(m[1])) if (m := re.search(r"([0-9]{1,18})[^0-9/]*/?$", url)) else None for url in urls}
    every = [v for v in label.values() if v is not None]
    total = (sum(every) + 1) / (len(every) + 2)
    for host, of in paths.items():
        node = defaultdict(lambda: [0, 0])
        for url in of:
            if label[url] is not None:
                node[template[url]][0] += 1
                node[template[url]][1] += label[url]
            else:
                node[template[url]]
        merged = {t: t for t in node}
        for k in reversed(range(max(map(len, node), default=0))):
            cur = defaultdict(lambda: [0, 0])
            for t, (n, g) in node.items():
                cur[merged[t]][0] += n
                cur[merged[t]][1] += g
            groups = defaultdict(list)
            for t in cur:
                if len(t) > k:
                    groups[(*t[:k], "~", *t[k + 1 :])].append(t)
            move = {}
            for mask, ts in groups.items():
                if len(ts) > 1:
                    p = rate(sum(cur[t][0] for t in ts), sum(cur[t][1] for t in ts))
                    for t in ts:
                        n, g = cur[t]
                        if not n or not abs(g / n - p) > u.Z * math.sqrt(p * (1 - p) / n):
                            move[t] = mask
            merged = {t: move.get(m, m) for t, m in merged.items()}
        hn, hg = sum(n for n, _ in node.values()), sum(g for _, g in node.values())
        base = (hg + u.STRENGTH * total) / (hn + u.STRENGTH)
        pool = defaultdict(lambda: [0, 0])
        for t, (n, g) in node.items():
            pool[merged[t]][0] += n
            pool[merged[t]][1] += g
        for url in of:
            n, g = pool[merged[template[url]]]
            out[url] = ("/" + "/".join(merged[template[url]]), (g + u.STRENGTH * base) / (n + u.STRENGTH) < u.FLOOR * total)
    return out


def test_url_tree(spark):
    rng, urls, good = random.Random(12), set(), {}
    for i in range(900):
        host = rng.choice(["a.org", "b.com", "c.com"])
        kind = rng.choice(["news/{y}", "blog/{w}", "shop/{w}/item", "tag/{w}", "deep/" + "/".join("xyzxyzxyzxyzxyzxyz") + "/{w}"])
        p = kind.format(y=rng.randint(1, 4), w="".join(rng.choice("pqrs") for _ in range(rng.randint(1, 3))))
        urls.add(f"http://{host}/{p}/{i}")
        if rng.random() < 0.7:
            good[i] = int(rng.random() < (0.1 if host == "c.com" and kind.startswith(("blog", "tag")) else 0.85))
    pages = spark.createDataFrame([(i, u, "", 1, 2) for i, u in enumerate(sorted(urls))], "page_id long, url string, html string, good int, template int")
    labels = spark.createDataFrame([(i, v, 0) for i, v in good.items()], "doc_id long, quality int, toxic int")
    want = _brute_tree(sorted(urls), good)
    got = url_filter.judge(pages, labels).collect()
    by_url = dict(enumerate(sorted(urls)))
    assert len(got) == len(urls)
    for r in got:
        t, rejected = want[by_url[r.page_id]]
        assert r.template == t
        if r.rule is None:
            assert (r.verdict == "block") == rejected
    blocked = [by_url[r.page_id] for r in got if r.verdict == "block"]
    assert blocked and all("//c.com/" in u for u in blocked)  # without the tree nothing is blocked
    long = spark.createDataFrame([(0, "http://h.org/" + "/".join(map(str, range(3_000))), ""), (1, "x" * 50_000, ""), (2, None, "")], "page_id long, url string, html string")
    assert url_filter.judge(long, labels).count() == 3


# -- personal data


def _brute_base(text):
    """The base spans by the patterns of the contract as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in double) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def test_base_spans_of_all_documents(spark):
    for d in (SMALL, "/root/testdata/sf0.01"):
        for r in documents(spark, d).select("text").collect():
            assert pii.base(r.text or "") == _brute_base(r.text or "")


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_pii_reads_every_place():
    """What it adds is what it adds if it reads the whole texts; the paths of many texts are those of each alone."""
    r, rng = np.random.default_rng(3), random.Random(3)
    net = pii.Net()
    net.p["t"] = r.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    codes = r.integers(0, 98, (5, 70))
    assert np.abs(net.scores(codes) - (net._run(codes)[0] @ net.p["o"])).max() < 0.02
    many = [3 * r.standard_normal((n, pii.TAGS)).astype(np.float32) for n in (1, 40, 7, 40, 300, 2)]
    assert [p.tolist() for p in net.paths(many)] == [net.best(s) for s in many]
    # a network that takes every letter, sign and digit for part of an address: a word at and a point far from it
    net = pii.Net()
    net.p = {k: 0 * v for k, v in net.p.items()}
    net.p["c"][:3] = 0, 1, 2
    texts = [f"{_prose(rng, n)} jo at {'hostname' * k}.org {_prose(rng, n)}" for n, k in ((2, 1), (20, 1), (40, 9), (40, 90))] + [_prose(rng, 50), "", "at", "é😀 at x.org"]
    whole = [pii.added(t, [], 0, pii.tagged(net, [(t, 0, len(t))])[0]) if t else [] for t in texts]
    assert pii.read(net, texts, [[] for _ in texts]) == whole and [len(x) for x in whole] == [1, 1, 1, 1, 0, 0, 0, 1]


def test_pii_finds_what_patterns_miss(spark):
    rng = random.Random(21)
    names = ["anna.k", "rob_lee", "mia77", "t.stone", "nils-b", "eva"]
    made = {
        "email": lambda: f"{rng.choice(names)}@{_prose(rng, 1)}.{rng.choice(['com', 'org', 'net'])}", "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": lambda: next(s for s in (f"{rng.randint(4 * 10**15, 5 * 10**15 - 1)}" for _ in range(999)) if pii._luhn(s)), "phone": lambda: f"+{rng.randint(1, 99)} ({rng.randint(200, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
    }
    docs = [(i, f"{_prose(rng, 30)} {made[k]()} {_prose(rng, 20)} {rng.randint(1, 99999)} {_prose(rng, 9)}") for i, k in enumerate(list(made) * 120)]
    net = pii.Net()
    net.p = pii.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    hit, miss, wrong = Counter(), Counter(), 0
    for i in range(240):
        kind = pii.KINDS[i % 4]
        value = pii.rewritten(kind, made[kind](), rng, _prose(rng, 9).split())
        head = _prose(rng, 12) + " "
        text = f"{head}{value} {_prose(rng, 12)} {rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {_prose(rng, 5)}"
        found = pii.base(text)
        parts = pii.stretches(text)
        extra = [s for (lo, hi), t in zip(parts, pii.tagged(net, [(text, lo, hi) for lo, hi in parts]), strict=True) for s in pii.added(text, found, lo, t)]
        want = (kind, len(head), len(head) + len(value))
        (hit if want in extra + found else miss)[kind] += 1
        wrong += sum(s != want for s in extra)
    got = sum(hit.values())
    assert got >= 0.9 * 240, (hit, miss)
    assert got >= 0.9 * (got + wrong), (hit, miss, wrong)

    def other(kind, v):
        """Forms that the training never makes: how far the network carries."""
        if kind == "email":
            a, (b, c) = v.split("@")[0], v.split("@")[1].split(".")
            return rng.choice([f"{a} AT {b} DOT {c}", f"{a} {{at}} {b} {{dot}} {c}", f"{a}<at>{b}.{c}", f"{a} @{b}.{c}", f"{a}@ {b}.{c}", f"{a} (at) {b} (dot) {c}"])
        if kind == "ip":
            return v.replace(".", rng.choice(["_", "[dot]", ", ", "-", " (dot) "]))
        if kind == "card":
            return rng.choice([":", "|", " – ", "·", ", "]).join(v[i : i + 4] for i in range(0, 16, 4))
        d = "".join(c for c in v if c.isdigit())[-10:]
        return rng.choice([f"{d[:3]}·{d[3:6]}·{d[6:]}", f"(0049) {d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}_{d[3:6]}_{d[6:]}", f"[{d[:3]}] {d[3:6]} {d[6:]}", f"{d[:2]} {d[2:4]} {d[4:6]} {d[6:8]} {d[8:]}"])

    hit, wrong = Counter(), 0
    for i in range(240):
        kind = pii.KINDS[i % 4]
        head, value = _prose(rng, 12) + " ", other(kind, made[kind]())
        text = f"{head}{value} {_prose(rng, 12)} {rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {_prose(rng, 5)}"
        parts, found = pii.stretches(text), pii.base(text)
        extra = [s for (lo, hi), t in zip(parts, pii.tagged(net, [(text, lo, hi) for lo, hi in parts]), strict=True) for s in pii.added(text, found, lo, t)]
        want = (kind, len(head), len(head) + len(value))
        hit[kind] += want in extra + found
        wrong += sum(s != want for s in extra)
    assert sum(hit.values()) >= 0.4 * 240 and wrong <= 24, (hit, wrong)


def test_gradient():
    net = pii.Net()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    codes, tags, mask = r.integers(0, 98, (3, 9)), r.integers(0, pii.TAGS, (3, 9)), np.ones((3, 9), bool)
    mask[1, 6:] = False
    grad = net.loss_grad(codes, tags, mask)[1]
    for k, v in net.p.items():
        at = tuple(r.integers(0, s) for s in v.shape) if k != "e" else (codes[0, 2], 3)
        old, two = v[at], []
        for step in (0.01, -0.01):
            v[at] = old + step
            two.append(net.loss_grad(codes, tags, mask)[0])
        v[at] = old
        assert 3 * (two[0] - two[1]) / 0.02 == pytest.approx(grad[k][at], abs=2e-3)


# -- SentencePiece


def test_giant_split_is_linear(spark):
    import time

    def took(n):
        df = spark.range(1).selectExpr("1L AS doc_id", f"repeat('some words and others ', {n // 22}) AS text")
        began = time.time()
        assert pieces.encode(df).selectExpr("exact").first().exact
        return time.time() - began

    took(100_000)
    assert took(4_000_000) < 12 * took(1_000_000) + 5


# -- pipeline


def _brute_lines(texts):
    """Line dedup of {doc_id: text} at one edit, short lines as exact copies."""
    distinct = {x for t in texts.values() for x in (t or "").split("\n") if len(x) >= 20}
    by_length, comp_edges = defaultdict(list), set()
    for x in distinct:
        by_length[len(x)].append(x)
    deleted = defaultdict(set)  # equal after one deletion: within one substitution, or an insertion apart
    for x in distinct:
        for k in range(len(x)):
            deleted[x[:k] + x[k + 1 :]].add(x)
    for short, group in deleted.items():
        members = sorted(group | ({short} & distinct))
        comp_edges |= {(a, b) for i, a in enumerate(members) for b in members[i + 1 :] if abs(len(a) - len(b)) <= 1 and _distance(a, b) <= 1}
    linked = {frozenset(e) for e in comp_edges}
    touched = {x for e in comp_edges for x in e}
    comp = _components(touched, lambda a, b: frozenset((a, b)) in linked)
    seen, out = set(), {}
    for i in sorted(texts):
        if texts[i] is None:
            out[i] = None
            continue
        stay = []
        for x in texts[i].split("\n"):
            if len(x) < 20 and not re.search(r"[^\x20\x09-\x0D]", x):
                stay.append(x)
                continue
            key = comp.get(x, x)
            if key not in seen:
                stay.append(x)
                seen.add(key)
        out[i] = "\n".join(stay)
    return out


def test_pipeline(spark):
    docs = documents(spark, SMALL)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, SMALL).collect()}
    failed = {i for i, r in rows.items() if (b := _base(r.text))[0] < 20 or 100 * b[4] > 30 * b[0]}
    assert not failed & kept.keys() and all(kept[i] == rows[i].text for i in kept)
    assert len(kept) >= 0.9 * (len(rows) - len(failed))  # few hosts are rejected
    lined = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs.where(docs.doc_id.isin(*kept)), SMALL).collect()}
    assert lined == _brute_lines(kept)
    df = spark.createDataFrame([(i, t, rows[i].lang, rows[i].source, len(t)) for i, t in lined.items()], docs.schema)
    single = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, df, SMALL).collect()}
    print_of = {i: _print(t) for i, t in lined.items()}
    comp = _components(print_of, lambda a, b: (print_of[a] ^ print_of[b]).bit_count() <= 2)
    assert single == {i: lined[i] for i in set(comp.values())}
    df = df.where(df.doc_id.isin(*single))
    mixed = Counter(r.doc_id for r in corpus_pipeline.mix(spark, df, SMALL).collect())
    copies = {r.doc_id: r.copies for r in mixing.taken(df).collect()}
    assert mixed == Counter({i: n for i, n in copies.items() if n}) and max(mixed.values()) <= 2
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = Counter((i, tuple(sp.encode(single[i]))) for i, n in mixed.items() for _ in range(n))
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SMALL).collect()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing to target weights", "sentencepiece"]


def test_pipeline_odd(spark, odd, empty, tmp_path):
    for name, df in (("odd", odd), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "ids", "n_chunks", "exact"] and out.count() <= 2 * df.count()
    clash = odd.selectExpr("*", "1 AS _drop", "2 AS _id", "3 AS _doc", "4 AS copies", "5 AS fp", "6 AS c", "7 AS _h")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, clash, "")
        assert out.columns == clash.columns, k
        assert out.count() <= 2 * clash.count()


def test_one_of_each_group(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, "y y y y"), (7, "b"), (7, "c")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == Counter({(1, "x"): 1, (None, "y y y y"): 1, (7, "b"): 1, (7, "c"): 1})
