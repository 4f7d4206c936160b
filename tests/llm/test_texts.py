"""Text operators against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rangeloom.llm import debruijn, setsketch
from rangeloom.llm.debruijn import repeated_passages
from rangeloom.llm.minhash import jaccard_links, near_duplicates
from rangeloom.llm.quality import quality_rules
from rangeloom.llm.textkit import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, chunk string, h string"


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeats, and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = words(30), words(200)
    out = [None, "", "   ", "one", "Two words", "a b \x1cc\td\ne\rf\x0bg\x0ch", "\n\n", "x" * 50_000, " ".join(words(20_000))]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(" ".join(words(rng.randint(5, 150))))
        elif kind == 1:
            copy = list(base)
            for _ in range(rng.randint(0, 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice((" ", "\n")).join(copy))
        elif kind == 2:
            out.append(" ".join(words(20) + passage[: rng.randint(10, 30)] + words(20)))
        elif kind == 3:
            out.append(out[rng.randrange(2, len(out))])
        elif kind == 4:
            out.append("\n".join(rng.choice(("Line A b", "line c", " ", "d | e #1 & <f>")) for _ in range(30)))
        else:
            out.append(" ".join(words(6) * rng.randint(1, 8)))
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i * 3, out[k]) for i, k in enumerate(order)]


def frame(spark, docs):
    """With clashing names of other columns."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in docs], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def test_scan_equals_regex():
    texts = [t for _, t in corpus(4)]
    scan = Texts(pa.array(texts))
    for i, t in enumerate(texts):
        got = [scan.buf[a:b].tobytes().decode() for a, b in zip(scan.start[scan.w0[i] : scan.w0[i + 1]], scan.end[scan.w0[i] : scan.w0[i + 1]], strict=True)]
        assert got == words_of(t)
    flat = [w for t in texts for w in words_of(t)]
    assert len(set(flat)) == len(set(scan.hash.tolist()))
    sliced = Texts(pa.array(texts).slice(3, 5))
    assert sliced.n_words.tolist() == [len(words_of(t)) for t in texts[3:8]]


def near_model(docs, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in docs:
        w = words_of((t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize("k, percent, seed", [(4, 80, 1), (5, 80, 2)])
def test_near_duplicates(spark, k, percent, seed):
    docs = corpus(seed)
    got = rows(near_duplicates(frame(spark, docs), shingle=k, percent=percent))
    assert got == near_model(docs, k, percent)


def test_near_duplicates_in_large_clusters(spark, monkeypatch):
    from rangeloom.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 7)
    docs = corpus(8, 120)
    assert rows(near_duplicates(frame(spark, docs), shingle=4, percent=80)) == near_model(docs, 4, 80)


def test_near_duplicates_edges(spark):
    text = "a b c d e f g"
    docs = frame(spark, [(5, text), (5, text), (None, text), (2, None), (9, text + " ")])
    assert sorted(rows(near_duplicates(docs)), key=str) == sorted([(5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False), (None, 3, None, True), (2, 0, 2, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 700).astype(np.uint64) for _ in range(2))
    for shared in (0, 200, 500, 690):
        one, two = a, np.concatenate([a[:shared], b[: 700 - shared]])
        k = setsketch.sketches(np.concatenate([one, two]), np.repeat([0, 1], 700), 2, m=4096)
        union = np.unique(np.concatenate([one, two]))
        merged = setsketch.sketches(union, np.zeros(len(union), dtype=np.int64), 1, m=4096)
        assert (np.maximum(k[0], k[1]) == merged[0]).all()
        size = np.array([700.0])
        assert abs(setsketch.estimate(k[:1], k[1:], size, size)[0] - shared / (1400 - shared)) < 0.04


def test_jaccard_links_exact():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 40))), dtype=np.uint64) for _ in range(30)]
    got = jaccard_links(sets, sets, np.ones((30, 30), dtype=bool), 40)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            x_, y_ = set(x.tolist()), set(y.tolist())
            assert got[i, j] == (100 * len(x_ & y_) >= 40 * len(x_ | y_))


def passages_model(docs, k):
    first = {}
    for i, t in sorted(docs):
        w = words_of(t)
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = []
    for i, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("k, most, full", [(13, 4 << 20, False), (13, 2000, False), (4, 500, False), (13, 2000, True), (4, 500, True)])
def test_repeated_passages(spark, monkeypatch, k, most, full):
    monkeypatch.setattr(debruijn, "SLICE_MOST", most)
    docs = corpus(3, 90)
    got = repeated_passages(frame(spark, docs), k=k, full=full)
    model = passages_model(docs, k)
    assert rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256")) == model
    if full:
        words = {i: words_of(t) for i, t in docs}
        removed = {i: n for i, _, n, _ in model}
        for r in got.collect():
            assert words_of(r.text) == [w for j, w in enumerate(words[r.doc_id]) if not any(s.start <= j < s.start + s.length for s in r.spans)]
            assert len(words_of(r.text)) == r.n_words - removed[r.doc_id]
            for s in r.spans:  # the source coordinates hold the same words, in a document before
                assert s.source_id < r.doc_id and words[r.doc_id][s.start : s.start + s.length] == words[s.source_id][s.source_start : s.source_start + s.length]


def test_repeated_passages_follow_sql(spark):
    import duckdb

    docs = [*corpus(5, 60), (None, "n " * 40), (None, " ".join(f"v{i}" for i in range(20))), (900, " ".join(f"v{i}" for i in range(30)))]
    got = rows(repeated_passages(frame(spark, docs)))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}))
    want = con.execute(debruijn.ORACLE).fetchall()
    assert got == sorted(want, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def test_paths_are_compacted(spark):
    """A path goes on while document and source both advance; where the source branches a span ends."""
    w = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(w[:30])), (2, " ".join(w[30:])), (3, " ".join(w)), (4, " ".join([*w[:20], "x", *w[40:]]))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_passages(frame(spark, docs), full=True).collect()}
    assert got[1] == got[2] == []
    assert got[3] == [(0, 30, 1, 0), (30, 30, 2, 0)]  # edges over the middle are new
    assert got[4] == [(0, 20, 1, 0), (21, 20, 2, 10)]


def test_unverified_spans_remove_nothing():
    words = " ".join(f"w{i}" for i in range(20))
    span = pa.array([[{"start": 2, "length": 13, "check": 1, "source_id": 1, "source_start": 0}]], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("check", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([words]), span], names=["id", "text", "spans"])
    out = next(debruijn._settle(True, ())(iter([batch]))).to_pylist()[0]
    assert out["n_removed"] == 0 and out["spans"] == [] and out["text"] == words


def test_repeated_passages_text_and_spans(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = [(1, long), (2, "start " + " ".join(f"w{i}" for i in range(10, 30)) + "\n\nend here"), (3, "w1 w2")]
    got = {r.doc_id: r for r in repeated_passages(frame(spark, docs), full=True).collect()}
    assert got[2].text == "start end here" and got[1].text == long and got[3].text == "w1 w2"
    assert [tuple(s) for s in got[2].spans] == [(1, 20, 1, 10)] and got[1].spans == []


def test_repeated_passages_edges(spark):
    long = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [(1, long), (1, long), (None, long), (None, long), (4, None)])
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in repeated_passages(docs).collect()), key=str)
    assert got == sorted([(1, 20, 0), (1, 20, 0), (None, 20, 20), (None, 20, 20), (4, 0, 0)], key=str)
    lone = frame(spark, [(None, long), (None, long)])
    assert [r.n_removed for r in repeated_passages(lone).collect()] == [0, 0]
    assert repeated_passages(docs.limit(0)).count() == 0


def quality_model(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    cover = [False] * len(w)
    for j in range(len(w) - 7):
        if c[tuple(w[j : j + 8])] > 1:
            cover[j : j + 8] = [True] * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(cover), len(w) < 20 or 100 * sum(cover) > 30 * len(w)


def test_quality_base(spark):
    docs = corpus(6, 80)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = rows(quality_rules(frame(spark, docs), labels).drop("score", "threshold"))
    assert got == sorted((i, *(m := quality_model(t)), not m[-1]) for i, t in docs)
    assert quality_rules(frame(spark, docs).limit(0), labels).count() == 0


def test_quality_ratio(spark):
    rng = random.Random(7)
    good = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    bad = ["".join(rng.choice("UVWXYZ#") for _ in range(5)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(bad if i % 10 == 0 else good) for _ in range(rng.randint(60, 200)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, docs), labels).collect()}
    assert sum(got[i] for i in got if i % 10) >= 0.98 * 360 and not any(got[i] for i in got if i % 10 == 0)


def test_components(spark):
    from rangeloom.llm.components import connected, forest

    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    assert dict(rows(connected(spark.createDataFrame(edges, "a long, b long"), "a", "b"))) == want
    for seed in range(5):
        links = np.random.default_rng(seed).random((40, 30)) < 0.03
        i, j = forest(links)
        assert links[i, j].all() and len(i) <= 70
        both = []
        for pairs in (zip(*np.nonzero(links), strict=True), zip(i, j, strict=True)):
            p = list(range(70))
            for a, b in pairs:
                a, b = int(a), int(b) + 40
                p = [p[a] if x == p[b] else x for x in p]
            both.append(Counter(tuple(x == y for y in p) for x in p))
        assert both[0] == both[1]


def test_mixing_follows_sql(spark):
    import duckdb

    from rangeloom.llm import mixing

    docs = [(i, f"t{i}", "en", "abc"[min(2, i % 7)], i, "x", "y", "z") for i in range(500)] + [(1000 + i, "r", "en", None, 1, "x", "y", "z") for i in range(2)]
    df = spark.createDataFrame(docs, SCHEMA)
    con = duckdb.connect()
    documents = df.toPandas()
    con.register("documents", documents)
    got = sorted((r.doc_id, r.copy_no) for r in mixing.mix_sources(df).collect())
    assert got == sorted((a, b) for a, b in con.sql(mixing.ORACLE).select("doc_id, copy_no").fetchall())
    assert mixing.mix_sources(df).columns == [*df.columns, "copy_no"]
    again = mixing.mix_sources(df.withColumn("copy_no", F.lit("old")))
    assert again.count() == len(got)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    one = mixing.mix_sources(df, weights={"a": 1.0}, rows=30_000)
    n = one.count()
    assert {r.source for r in one.select("source").distinct().collect()} == {"a"} and abs(n - 30_000) < 800
    odd = spark.createDataFrame([(None, "x", None), (None, None, "s"), (4, "y", "s"), (4, "y", "s")], "doc_id long, text string, source string")
    assert mixing.mix_sources(odd, rows=40).count() > 0


def test_poisson_counts(spark):
    from rangeloom.llm import mixing

    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "'s' as source")
    for mean in (0.5, 3.0, 50.0):
        c = [r["count"] for r in mixing.mix_sources(df, rows=4000 * mean).groupBy("doc_id").count().collect()]
        c += [0] * (4000 - len(c))
        assert abs(np.mean(c) - mean) < 5 * (mean / 4000) ** 0.5 and abs(np.var(c) / mean - 1) < 0.15
