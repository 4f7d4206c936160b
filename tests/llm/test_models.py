"""Operators held against SQL twins and plain models of their whole result, and what odd input does to them."""

import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_texts import corpus, frame, near_model, words_of

from rangeloom.llm import linkgraph, minhash, packing, quality, queries, store, toxicity
from rangeloom.llm.components import connected
from rangeloom.llm.minhash import near_duplicates
from rangeloom.llm.multiindex import near_vectors
from rangeloom.llm.quality import quality_rules

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def run_hash(values):
    """The hash of a run of numbers as ``textkit`` defines it, in plain integers."""
    total = 0
    for i, v in enumerate(values):
        total += v * pow(0xD6E8FEB86659FD93, i, 1 << 64)
    return mix(total + len(values) * 0x9E3779B97F4A7C15 & MASK)


def word_hash(word):
    return run_hash([mix((b + 1) * 0x9E3779B97F4A7C15 + 11 & MASK) for b in word.encode()])


def test_quality_equals_plain_counts(spark):
    """Score, threshold and verdict of every document, recomputed with dictionaries."""
    rng = random.Random(4)
    good = ["".join(rng.choice("abcdefé") for _ in range(4)) for _ in range(60)]
    bad = ["".join(rng.choice("UVWX#") for _ in range(5)) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(bad if i % 7 == 0 else good) for _ in range(rng.randint(25, 60)))) for i in range(120)] + [(500, None), (501, "one"), (502, "")]
    labels = [(i, int(i % 7 != 0)) for i in range(90)]
    df = quality_rules(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int"), bits=10)
    hashes = {r.id: r.h for r in spark.range(600).select("id", F.xxhash64("id").alias("h")).collect()}
    trusted = [i for i, q in labels if q]
    fit, held = ([i for i in trusted if (hashes[i] >> 7) % 2 == part] for part in (0, 1))
    slots = {}
    for i, t in docs:
        w = [word_hash(x) for x in words_of(t)]
        slots[i] = [h >> 54 for h in w] + [run_hash(p) >> 54 for p in zip(w, w[1:], strict=False)]
    raw, target = Counter(s for x in slots.values() for s in x), Counter(s for i in fit for s in slots[i])
    n_raw, n_target = sum(raw.values()) + 1024, sum(target.values()) + 1024
    ratio = [np.log((target[s] + 1) / n_target) - np.log((raw[s] + 1) / n_raw) for s in range(1024)]
    score = {i: sum(ratio[s] for s in x) / max(len(x), 1) for i, x in slots.items()}
    got = {r.doc_id: r for r in df.collect()}
    level = [score[i] for i in held if not got[i].base_failed]
    low, middle = np.quantile(level, 0.001), np.quantile(level, 0.5)
    threshold = low - 0.5 * (middle - low)
    assert len(got) == len(docs)
    for i, _ in docs:
        assert got[i].score == pytest.approx(score[i], abs=1e-9) and got[i].threshold == pytest.approx(threshold, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and score[i] >= threshold)
    assert not any(got[i].kept for i in range(0, 120, 7)) and sum(r.kept for r in got.values()) > 90


def test_quality_uses_every_trusted_row(spark, monkeypatch):
    """More rows labelled good than 20,000: score and threshold recomputed over all of them, whichever way their ids reach the counts."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(4)) for _ in range(40)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=24))) for i in range(24_000)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (24_001, None)]  # a repeated row counts twice, a null id is no trusted one
    labels = spark.createDataFrame([(i, 1) for i in range(23_000)] + [(None, 1), (23_500, 0)], "doc_id long, quality int")
    part = {r.id: (r.h >> 7) % 2 for r in spark.range(23_000).select("id", F.xxhash64("id").alias("h")).collect()}
    words = {w: word_hash(w) for w in vocabulary}
    pairs = {(a, b): run_hash([x, y]) >> 54 for a, x in words.items() for b, y in words.items()}
    slots = []
    for i, t in docs:
        w = words_of(t)
        slots.append((i, np.array([words[x] >> 54 for x in w] + [pairs[p] for p in zip(w, w[1:], strict=False)], dtype=np.int64)))
    raw = np.bincount(np.concatenate([x for _, x in slots]), minlength=1024)
    target = np.bincount(np.concatenate([x for i, x in slots if part.get(i) == 0]), minlength=1024)
    ratio = np.log((target + 1) / (target.sum() + 1024)) - np.log((raw + 1) / (raw.sum() + 1024))
    score = [(i, ratio[x].mean() if len(x) else 0.0) for i, x in slots]
    low, middle = np.quantile([s for i, s in score if part.get(i) == 1], [0.001, 0.5])
    assert sum(p == 0 for p in part.values()) > 10_000 < sum(p == 1 for p in part.values())
    for ids, scores in ((quality.TRUSTED_IDS, quality.SCORES), (100, 1000)):
        monkeypatch.setattr(quality, "TRUSTED_IDS", ids)
        monkeypatch.setattr(quality, "SCORES", scores)
        got = quality_rules(frame(spark, docs), labels, bits=10).select("doc_id", "score", "threshold", "base_failed", "kept").collect()
        assert len(got) == len(docs)
        assert [r.threshold for r in got[:1]] == [pytest.approx(low - 0.5 * (middle - low), abs=1e-9)]
        assert all(r.kept == (not r.base_failed and r.score >= r.threshold) for r in got)
        order = lambda x: (x[0] is None, x[0] or 0)
        np.testing.assert_allclose([s for _, s in sorted(((r.doc_id, r.score) for r in got), key=order)], [s for _, s in sorted(score, key=order)], atol=1e-9)


@pytest.mark.parametrize("kind", ["spread", "ties", "clusters", "one"])
def test_quantiles_are_exact(spark, monkeypatch, kind):
    rng = random.Random(kind)
    values = {"spread": [rng.gauss(0, 1) for _ in range(3000)], "ties": [rng.choice([-0.5, 0.0, 0.25]) for _ in range(3000)], "clusters": [rng.choice([0, 1e9]) + rng.random() * 1e-3 for _ in range(3000)] + [-1e12], "one": [0.3]}[kind]
    df = spark.createDataFrame([(x,) for x in values], "score double")
    shares = [0.001, 0.5, 1.0]
    for most in (1 << 18, 10):
        monkeypatch.setattr(quality, "SCORES", most)
        assert quality.quantiles(df, shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)


def linked_pages(seed=5, n=400):
    """Pages of hosts that link to each other, to themselves and to hosts without pages."""
    rng = random.Random(seed)
    hosts = [f"{a}.{b}" for a in "abcdefgh" for b in ("com", "net", "org", "info")]
    out = []
    for i in range(n):
        links = "".join(f'<a class=x href={q}{s}//{rng.choice([*hosts, "else.where"]).upper()}/p?q={q}>x</a>' for q, s in rng.choices([('"', "https:"), ("'", "http:"), ("", "HTTP:"), ('"', "")], k=rng.randint(0, 4)))
        out.append((i, f"http://{rng.choice(hosts)}/{rng.choice(('en', 'de', 'es', 'fr'))}/{i}", f"<p>{links}<a href='/in'>y</a>"))
    return [*out, (n, None, "<a href='//a.com'>"), (n + 1, "nothing", None)]


def test_url_query_follows_sql_over_links(spark, tmp_path):
    """The registered query over a table whose hosts do link: rules, both propagations, verdicts."""
    pages = linked_pages()
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = rows(queries.QUERIES["op5_host_trust"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({linkgraph.ORACLE})").fetchall()
    assert got == sorted(want)
    by_host = {(h, v) for _, h, _, rule, v in got if rule is None}
    assert {v for _, v in by_host} == {"allow", "block"}
    # Without the links some hosts are judged differently: the propagation decides.
    plain = rows(linkgraph.judge_urls(spark.createDataFrame([(i, u, None) for i, u, _ in pages], "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict"))
    assert plain != got


def test_blocks_by_size(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ITEMS", 900)
    docs = corpus(9, 90)
    assert rows(near_duplicates(frame(spark, docs), shingle=4, percent=80)) == near_model(docs, 4, 80)


def test_texts_that_share_an_id_are_one_document(spark):
    one, two, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    docs = frame(spark, [(3, one), (5, one + " x"), (5, two), (7, two + " x"), (8, other), (1, other + " y z"), (7, None)])
    got = rows(near_duplicates(docs, shingle=4).select("doc_id", "component_id", "kept"))
    assert got == [(1, 1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 7, True), (8, 1, False)]


def test_components_of_a_hub(spark):
    edges = [(1, i) for i in range(2, 900)] + [(i, i + 1000) for i in range(800, 900)] + [(5000, 5001), (5001, 5002), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 1 for i in [*range(1, 900), *range(1800, 1900)]) and {got[i] for i in (5000, 5001, 5002)} == {5000} and len(got) == 899 + 100 + 3


def test_vectors_of_any_length(spark):
    """Components far beyond what squares can hold; the norm doesn't matter to a cosine."""
    data = [(1, [1e-170, 2e-170]), (2, [1e200, 2e200]), (3, [3.0, 6.0]), (4, [2.0, -1.0]), (5, [5e-324, 0.0]), (6, [1.0, 0.0]), (7, [1.7e308, 1.7e308])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (3, 1)}


def test_recall_on_planted_links(spark):
    """Queries are the rows whose id is divisible by 20, held against all rows by brute force."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 2400, 4):
        aside = rng.standard_normal(32)
        aside -= (aside @ x[i]) * x[i]
        level = rng.uniform(0.9, 0.96)
        x[i + 1] = level * x[i] + (1 - level**2) ** 0.5 * aside / np.linalg.norm(aside)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors(df, per_cell=16, query_rows=128).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = y @ y.T >= 0.9
    np.fill_diagonal(links, False)
    asked = range(0, 2400, 20)
    true = sum(int(links[i].sum()) for i in asked)
    found = sum(got[i] for i in asked)
    assert true >= 115 and all(got[i] <= links[i].sum() for i in range(2400)) and found >= 0.99 * true


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    real = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda doc, h, n, *a, **b: seen.append((n, len(h))) or real(doc, h, n, *a, **b))
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(300)) + (" vile" if i % 3 else ""), "x", "y") for i in range(60)], "doc_id long, text string, h string, id string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs, labels, {"poor": "quality = 0", "toxic": "toxic = 1"}, sample_bytes=40_000)
    assert out.count() == 60 and len(seen) == 1 and 10 <= seen[0][0] < 30 and seen[0][1] * 8 <= 40_000


def test_other_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="word"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.ensure_checkpoint_dir(Session())


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("kind", ["empty", "nulls", "ties"])
def test_stages_take_odd_tables(spark, tmp_path, kind):
    """Empty tables, rows of nulls, repeated rows and columns of clashing names: each stage gives a defined result."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"w{i}" for i in range(40))
    data = {"empty": [], "nulls": [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, "s", 0)], "ties": [(1, text, "en", "s", len(text))] * 3 + [(2, text, "en", "s", len(text))]}[kind]
    docs = spark.createDataFrame(data, EMPTY).withColumns({c: F.lit("z") for c in ("row_key", "id", "copy_no", "chunk", "key", "h")})
    want = {"empty": (0, 0, 0), "nulls": (0, 3, 3), "ties": (4, 3, 3)}[kind]
    stages = dict(corpus_pipeline.STAGES)
    got = tuple(stages[name](spark, docs, str(tmp_path)) for name in ("quality_rules", "near_dedup", "substring_dedup"))
    assert tuple(df.count() for df in got) == want and all(df.columns == list(corpus_pipeline.COLUMNS) for df in got)
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and (mixed.count() == 0) == (kind == "empty")
    packed = stages["packing"](spark, docs, str(tmp_path))
    assert packed.count() >= len(data) and (kind != "empty" or packed.count() == 0)


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_with_or_without_broadcast(spark, monkeypatch, broadcast):
    """The same rows come out whichever way the rates reach them."""
    from rangeloom.llm import mixing

    docs = frame(spark, corpus(11, 60)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("doc_id"))))
    want = rows(mixing.mix_sources(docs).select("doc_id", "copy_no"))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10_000 if broadcast else 0)
    assert rows(mixing.mix_sources(docs).select("doc_id", "copy_no")) == want and len(want) > 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_whole_run_of_the_pipeline(spark):
    """run()'s rows recomputed stage by stage with plain models: near-duplicates, passages, draws, and the tokenizer's ids of every document."""
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from test_texts import passages_model
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = quality_rules(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").select("doc_id")  # held against a model above
    given = {r.doc_id: r for r in docs.join(kept, "doc_id").collect()}
    near = [(i, given[i].text) for i, _, _, k in near_model([(i, r.text) for i, r in given.items()], 5, 80) if k]
    texts = {}
    spans = {i: gone for i, _, gone, _ in passages_model(near, 13)}
    first = {}
    for i, t in sorted(near):
        w = words_of(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in near:
        w = words_of(t)
        gone = {x for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        assert len(gone) == spans[i]
        if len(gone) < len(w) or not w:
            texts[i] = t if not gone else None, [x for j, x in enumerate(w) if j not in gone]
    counts = Counter(given[i].source or "" for i in texts)
    total, share = sum(counts.values()), {s: n**0.7 for s, n in counts.items()}
    copies = {}
    for i in texts:
        source = given[i].source or ""
        mean = share[source] * total / sum(share.values()) / counts[source]
        u = int(hashlib.md5(f"{i}:17:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, np.exp(-mean)
        c = p
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        copies[i] = n
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, folder).collect()
    by_sequence = {}
    found = Counter()
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        found[r.doc_id] += r.length
    for i, (_, left) in texts.items():
        ids = tokenizer.encode(" ".join(left), add_special_tokens=False).ids + [1]
        assert found[i] == copies[i] * len(ids), i
        data = np.array(ids, dtype="<u4").tobytes()
        for r in pieces:
            if r.doc_id == i:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)])
    assert set(found) == {i for i, n in copies.items() if n}
    for rows_ in by_sequence.values():
        rows_.sort(key=lambda r: r.offset)
        assert rows_[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(rows_, rows_[1:], strict=False)) and rows_[-1].offset + rows_[-1].length <= 2048
