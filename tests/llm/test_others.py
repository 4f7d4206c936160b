"""Packing, toxicity, pages, urls, vectors, WARC and the pipeline."""

import base64
import gzip
import hashlib
import html
import html.parser
import io
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from rangeloom.llm import html_tree, linkgraph, markup, packing, warc
from rangeloom.llm.multiindex import Grid, near_vectors
from rangeloom.llm.textkit import Texts
from rangeloom.llm.toxicity import best_cut, classify, fit_chain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


ODD = ["it's o'clock <|endoftext|>ab<|startoftext|>", "a b\tc\r\nd", "ẞİx—!y", "é.—!", "12ab3,4.5", "\x01 a", "Σas ΑΣ.", "áb é.", "x'S don'T 'll", "", " ", "a" * 9000, "Hello, WORLD! no. end", "№ ½ x²", "a-b_c//d", "日本語 テスト。次", "\U0001f600a\U0001f600 b"]


def test_ids_equal_the_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    encoder = packing.Encoder(tokenizer, most=50)
    rng = random.Random(1)
    mixed = ["".join(rng.choice("abZ.,'!<|> \n\té—9é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for texts in (ODD, mixed, ODD):
        scan = Texts(pa.array(texts))
        ids, per_word = encoder.ids(scan)
        ends = np.concatenate([[0], np.cumsum(per_word)])[scan.w0]
        for i, s in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        window = rng.choice((4, 8, 16))
        place = [0]
        while len(place) < rng.randint(2, 14):
            place.append(place[-1] + rng.randint(1, window))
        penalty = [rng.choice((0, 2, 5)) for _ in place]
        best = [0.0]
        for j in range(1, len(place)):
            cost = lambda i: best[i] + (0 if (n := place[j] - place[i]) & (n - 1) == 0 else window - n)  # noqa: E731, B023
            best.append(penalty[j] + min(cost(i) for i in range(j) if place[j] - place[i] <= window))
        cuts = packing.choose_cuts(np.array(place), np.array(penalty), window)
        got = sum(penalty[b] + (0 if (n := place[b] - place[a]) & (n - 1) == 0 else window - n) for a, b in zip(cuts, cuts[1:], strict=False))
        assert cuts[0] == 0 and cuts[-1] == len(place) - 1 and got == best[-1]


def test_packing(spark, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    rng = random.Random(2)
    texts = [*ODD, None, None, *(" ".join(rng.choice(("alpha", "beta.", "gamma\n", "delta")) for _ in range(rng.randint(0, 3000))) for _ in range(40))]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, offset string").repartition(3)
    got = packing.pack(docs, tokenizer).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            ids = want[i][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want[i]) and r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
    assert packing.pack(docs.limit(0), tokenizer).count() == 0


def test_toxicity_chain(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    data = []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        w += ["###junk"] * bad + [rng.choice(("nasty", "Vile,"))] * toxic
        rng.shuffle(w)
        data.append((i, " ".join(w), int(not bad), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in data] + [(None, None, "x"), (5000, "", "x")], "doc_id long, text string, p0 string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data[:600]] + [(None, 1, 1), (7000, None, None)], "doc_id long, quality int, toxic int")
    chain = {"poor": "quality = 0", "toxic": "toxic = 1"}
    got = {r.doc_id: r for r in classify(docs, labels, chain).collect()}
    assert len(got) == 902 and not got[5000].is_toxic and not got[None].is_toxic
    held = data[600:]
    assert np.mean([got[i].is_toxic == bool(x) for i, _, _, x in held]) > 0.98
    assert not any(r.is_toxic for r in classify(docs, labels.limit(0), chain).collect())
    assert classify(docs.limit(0), labels, chain).count() == 0


def test_chain_uses_unseen_probabilities():
    rng = np.random.default_rng(1)
    n = 400
    first = (rng.random(n) < 0.4).astype(float)
    doc, h = np.nonzero(np.column_stack([first, rng.random((n, 20)) < 0.3]))
    models, unseen = fit_chain(doc, h.astype(np.uint64), n, [first, first])
    assert models[1].dense.shape == (1,) and models[1].dense[0] > 0
    assert ((unseen[0] > best_cut(unseen[0], first)) == first.astype(bool)).mean() > 0.95


def test_pages(spark):
    page = """<html><head><title>T</title><script>if (a < b) {"</p>"}</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie notice"><p>We use cookies on this site, please accept them all now.</p></div>
    <article><h1>Head&amp;line</h1><p>First  <b>para</b>graph &eacute; of the article,<br>with a break and some more words in it.<p>Second one 1 &lt; 2, which is a sentence of usual length here.</article>
    <section class="comments"><article class="comment"><p>I am a reader and I disagree with all of this text, really.</p></article></section><footer>&copy; 2020 Someone</footer></body></html>"""
    want = "Head&line\n\nFirst paragraph é of the article, with a break and some more words in it.\n\nSecond one 1 < 2, which is a sentence of usual length here."
    df = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (None, "u", "", "c"), (1, "u", page, "c"), (4, "u", "<div " * 5 + "<p>" * 3000 + "<", "c")], "page_id long, url string, html string, text string")
    got = html_tree.extract_main_text(df).collect()
    assert [r.text for r in got if r.page_id == 1] == [want, want] and [r.n_chars for r in got if r.page_id == 1] == [len(want)] * 2
    assert [r.text for r in got if r.page_id in (2, None)] == ["", ""] and len(got) == 5
    assert html_tree.extract_main_text(df.limit(0)).count() == 0


BROKEN = {
    "unclosed": "<div>" * 20000 + "</q1>" * 20000, "quotes": '<a x="' * 20000, "odd quotes": '<a x="' * 20001 + ">", "names": "<a" * 20000 + '">', "spaces": "<a " * 20000, "titles": "<title>" * 20000,
    "cells": "<table><td><table>" + "<x>" * 20000 + "<td></td>" * 20000, "declarations": "<!" * 50000, "comments": "<!--" * 50000, "scripts": "<script" * 20000, "signs": "<" * 200000, "mixed": "<a '\">" * 30000,
    "class": "<p class" + " " * 50000 + "class" * 5000 + ">x", "digits": "<p>&#" + "9" * 100000 + ";", "heads": "<head>" * 20000, "charsets": "&" * 100000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_take_linear_time(kind):
    """No page crashes a task or takes more than 2 seconds a MB."""
    model = html_tree.Model.fit(html_tree.labelled_pages(40))
    page = BROKEN[kind] * (1 + 400_000 // len(BROKEN[kind]))
    start = time.time()
    html_tree.main_text(page, model)
    warc.derive(warc.response(1, "u", page))
    assert time.time() - start < 4 * len(page) / 1e6 + 0.2


def test_labels_of_other_kinds_are_no_labels():
    model = html_tree.Model.fit(html_tree.labelled_pages(100))
    for label in ('data-label="Unit price"', "data-label='x'", 'data-label=""', "data-label"):
        assert html_tree.main_text(f"<article><p {label}>{'A sentence of the text. ' * 9}</p></article>", model) == ("A sentence of the text. " * 9).strip()


def test_references_of_any_length():
    for text in ("&#65;&#x41;&#00000000000065;&#x0000000041;", "a&amp;#00000000065;", "&lt&notin;&bogus;&", "&#x110000;&#0;"):
        assert markup.unescape(text) == html.unescape(text)
    assert markup.unescape("&#" + "9" * 5000 + ";x&#x" + "f" * 90) == "\ufffdx\ufffd"


class Reader(html.parser.HTMLParser):
    """The standard library's parser as a second opinion on plain text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN and not self.hidden:
            self.hidden.append(tag)
        if tag not in warc.INLINE:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[0] == tag:
            self.hidden.pop()
        if tag not in warc.INLINE:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_derivatives_equal_another_parsers(spark):
    """Whole query on a small table, held against the standard library's HTML parser and recomputed digests."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    given = {r.page_id: r for r in pages.collect()}
    got = warc.build_derivatives(pages).collect()
    assert len(got) == 2 * len(given)
    for r in got:
        page = given[r.page_id]
        reader = Reader()
        reader.feed(page.html or "")
        reader.close()
        lines = (" ".join(x.split()) for x in "".join(reader.out).split("\n"))
        payload = (page.html or "").encode()
        assert r.target_uri == page.url and r.content_length == len(r.block.encode())
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        if r.record_type == "conversion":
            assert r.block == "\n".join(x for x in lines if x)


def test_bodies_are_decoded():
    text = "<p>Grüße</p>"
    def block(body, *headers):
        return {"block": b"\r\n".join([b"HTTP/1.1 200 OK", *headers, b"", body]), "record_id": "<r>", "target_uri": "u", "date": "d", "page_id": 1, "payload_digest": None}

    def derived(body, *headers):
        meta, conversion = warc.derive(block(body, *headers))
        return conversion["block"].decode(), meta["block"].decode()

    plain = text.encode()
    chunked = b"".join(b"%x;n=1\r\n%s\r\n" % (len(plain[i : i + 5]), plain[i : i + 5]) for i in range(0, len(plain), 5)) + b"0\r\n\r\n"
    assert derived(chunked, b"Transfer-Encoding: chunked")[0] == derived(plain)[0] == "Grüße"
    assert derived(gzip.compress(plain), b"Content-Encoding: gzip")[0] == derived(zlib.compress(plain), b"Content-Encoding: deflate")[0] == derived(zlib.compress(plain)[2:-4], b"Content-Encoding: deflate")[0] == "Grüße"
    assert derived(gzip.compress(plain), b"Content-Encoding: br") == ("", derived(gzip.compress(plain), b"Content-Encoding: br")[1]) and "unread-content-encoding: br" in derived(plain, b"Content-Encoding: br")[1]
    assert derived(text.encode("latin-1"), b"Content-Type: text/html; charset=ISO-8859-1")[0] == "Grüße"
    for odd in (b"undefined", b"idna", b"punycode", b"hex", b"none-such", b"unicode_escape"):
        assert derived(plain, b"Content-Type: text/html; charset=" + odd)[0] == "Grüße"
    lines = derived(plain, b"Set-Cookie: a=1", b"Set-Cookie: b=2", b"X: 1", b"  2")[1].splitlines()
    assert lines[-3:] == ["source-set-cookie: a=1", "source-set-cookie: b=2", "source-x: 1 2"]
    kept = warc.derive(block(plain, b"Set-Cookie: a=1", b"Set-Cookie: b=2"))[0]["headers"]
    assert kept[-2:] == [("WARC-Source-Set-Cookie", "a=1"), ("WARC-Source-Set-Cookie", "b=2")]


def test_marginals_are_exact():
    model = html_tree.Model.fit(html_tree.labelled_pages(60))
    nodes = html_tree.parse(html_tree.labelled_pages(3, seed=5)[0])[:11]
    weights = [model.potential(x) for x in nodes]
    total, content = 0.0, [0.0] * len(nodes)
    for code in range(1 << len(nodes)):
        y = [(code >> i) & 1 for i in range(len(nodes))]
        p = float(np.prod([weights[i][y[i]] for i in range(len(nodes))]) * np.prod([model.edge[html_tree.holder(nodes[x.parent])][y[x.parent]][y[i]] for i, x in enumerate(nodes) if i]))
        total += p
        content = [c + p * v for c, v in zip(content, y, strict=True)]
    assert np.allclose(model.marginals(nodes), [c / total for c in content])


def test_held_out_layouts():
    model = html_tree.Model.fit(html_tree.labelled_pages())
    good = n = 0
    for page in html_tree.labelled_pages(80, seed=99):
        nodes = html_tree.parse(page, labelled=True)
        label = []
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            label.append(int(node.given == "content") if node.given else label[node.parent] if node.parent >= 0 else 0)
            if node.length:
                n += 1
                good += (p > 0.5) == label[-1]
    assert good / n > 0.98


def test_urls(spark):
    urls = ["http://A.Example.com/en/7?x", "https://b.example.com/en/8#y", "http://x.net/de/1", "http://example.net/de/85", "http://notexample.net/de/85", "http://com/en/", "http://xcom/en/1", "x.org/es/", None, "", "http://u.org", "ftp://U.org?/es/", "http://u.org/es/1/://b"]
    pages = spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(urls)] + [(None, urls[0], "<a href='//t.com/'>", "c")], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in linkgraph.judge_urls(pages).collect()}
    assert [got[i].rule for i in range(13)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "net/de/", "com/en/", None, None, None, None, None, None, "org/es/"]
    assert (got[0].host, got[0].path, got[11].host, got[11].path, got[7].host, got[8].path) == ("a.example.com", "/en/7", "u.org", "", "", "")
    assert got[10].verdict == "block" and got[6].verdict == "allow" and got[None].verdict == "allow"
    assert linkgraph.judge_urls(pages.limit(0)).count() == 0


def test_link_graph_equals_a_matrix(spark):
    rng = random.Random(3)
    hosts = [f"h{i}.{t}" for i in range(14) for t in ("org",)] + ["good.net", "bad.org"]
    links = {(a, b) for a in hosts for b in rng.sample(hosts, 3) if a != b} - {("h0.org", b) for b in hosts}
    pages = [(i, f"http://{a}/x", f'<p><a class="k" href="https://{b.upper()}/p?q">x</a><a href="/in">y</a>') for i, (a, b) in enumerate(sorted(links))]
    pages += [(900, "http://good.net/de/1", None), (901, "http://bad.org/es/1", None), (902, "http://h0.org/", None)]
    n, at = len(hosts), {h: i for i, h in enumerate(hosts)}

    def rank(m, seed):
        out = m.sum(axis=1, keepdims=True)
        share = np.divide(m, out, where=out > 0, out=np.zeros_like(m))
        s = np.zeros(n)
        s[at[seed]] = 1
        r = s.copy()
        for _ in range(15):
            got = r @ share
            r = (1 - 0.85 * got.sum()) * s + 0.85 * got
        return r

    m = np.zeros((n, n))
    for a, b in links:
        m[at[a], at[b]] += 1
    trust, distrust = rank(m, "good.net"), rank(m.T, "bad.org")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in linkgraph.judge_urls(df).collect():
        if r.rule is None:
            assert r.verdict == ("block" if distrust[at[r.host]] > trust[at[r.host]] else "allow"), r.host


def vectors(n=260, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for i in range(0, n, 3):
        x[i] = x[i // 9] + rng.normal(size=16) * rng.choice([0, 0.02, 0.15, 0.3])
    return x.astype(np.float32)


def test_vectors(spark, monkeypatch):
    from rangeloom.llm import multiindex

    monkeypatch.setattr(multiindex, "BLOCK", 9)
    x = vectors()
    data = [(i * 2, [float(v) for v in r], "c") for i, r in enumerate(x)]
    odd = [(5001, None, "c"), (5003, [0.0] * 16, "c"), (5005, [float("nan")] * 16, "c"), (5007, [float("inf")] + [1.0] * 15, "c"), (5009, [], "c"), (5011, [None] + [1.0] * 15, "c"), (None, data[0][1], "c")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, rep string")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = y @ y.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in near_vectors(df, per_cell=16).collect()}
    found = sum(got[2 * i].n_links for i in range(len(x)))
    assert found >= 0.97 * links.sum() and all(got[2 * i].n_links <= links[i].sum() for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd[:-1])
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    for i in range(len(x)):
        assert got[2 * i].kept == (got[2 * i].component_id == 2 * i)
        if got[2 * i].n_links:
            assert got[2 * i].component_id <= min(2 * j for j in [i, *np.flatnonzero(links[i])]) or found < links.sum()
    assert near_vectors(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "c") for i in (4, 2, 9)], "vec_id long, embedding array<float>, rep string")
    assert rows(near_vectors(same)) == [(2, 2, 2, True), (4, 2, 2, False), (9, 2, 2, False)]


def test_sparse_links_are_found(spark):
    """Few planted pairs near the least cosine, none among the sample queries."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.standard_normal((100, 64))
    aside -= (aside * x[:100]).sum(axis=1, keepdims=True) * x[:100]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x = np.concatenate([x, 0.905 * x[:100] + (1 - 0.905**2) ** 0.5 * aside])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_vectors(df, query_rows=64, per_cell=16).collect()}
    assert sum(got[i].n_links + got[3000 + i].n_links for i in range(100)) >= 198
    assert sum(r.n_links for r in got.values()) <= 200


def test_traversal_is_nearest_first():
    x = vectors(120, 4).astype(np.float64)
    grid = Grid(x, 5)
    one, two = grid.distances(x)
    every = (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)
    for visits in (1, 4, 11, 25):
        seen = grid.traversal(x, visits)
        assert np.allclose(np.take_along_axis(every, seen, axis=1), np.sort(every, axis=1)[:, :visits])
    assert (grid.traversal(x, 1)[:, 0] == grid.cell(x)).all()


def test_warc_round_trip(spark, tmp_path):
    page = "<html><head><title>A &amp; b</title></head><body><p>One <b>t</b>wo</p><a href='/x?a&amp;b'>L</a><script>no</script></body></html>"
    source = [(1, "http://a.b/é", page), (2, None, None), (None, "http://c", ""), (1, "http://a.b/é", page)]
    pages = spark.createDataFrame(source, "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 8 and {r.record_type for r in made} == {"metadata", "conversion"}
    response = warc.response(1, "http://a.b/é", page)
    mine = {r.record_type: r for r in made if r.page_id == 1}
    assert {r.refers_to for r in mine.values()} == {response["record_id"]} and {r.payload_digest for r in mine.values()} == {response["payload_digest"]}
    assert bytes(mine["conversion"].block) == b"One two\nL"
    assert mine["metadata"].block.decode().splitlines()[:2] == ["title: A & b", "outlink: /x?a&b"]
    assert [tuple(h) for h in mine["conversion"].headers] == [("WARC-Refers-To-Target-URI", "http://a.b/é"), ("WARC-Refers-To-Date", warc.DATE), ("WARC-Source-Content-Type", "text/html; charset=utf-8")]
    records = [response, *(r.asDict() for r in made)]
    (tmp_path / "a.warc").write_bytes(b"".join(warc.to_bytes(r) for r in records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(warc.to_bytes(r, compress=True) for r in records))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    key = lambda r: (r["record_id"], r["record_type"], bytes(r["block"]), r["refers_to"] or "", r["target_uri"] or "", r["block_digest"])
    assert sorted(map(key, got)) == sorted(map(key, records * 2))
    for r in got:
        assert warc.digest(bytes(r.block)) == r.block_digest
    whole = warc.build_derivatives(pages).collect()
    crc = {(r["record_id"]): zlib.crc32(warc.to_bytes(r)) for r in records[1:]}
    assert len(whole) == 8 and all(crc[r.record_id] == r.record_crc32 for r in whole)
    assert {(r.record_id, r.block) for r in whole} == {(r["record_id"], bytes(r["block"]).decode()) for r in records[1:]}
    read = lambda data: list(warc.parse(io.BufferedReader(io.BytesIO(data))))
    assert len(read(gzip.compress(warc.to_bytes(response)))) == 1
    for cut in (warc.to_bytes(response)[:-40], warc.to_bytes(response, compress=True)[:-40]):
        (half,) = read(cut)
        assert half["headers"][-1] == ("WARC-Truncated", "unspecified") and response["block"].startswith(half["block"]) and half["record_id"] == response["record_id"]
    assert read(warc.to_bytes(response).replace(b"Content-Length: ", b"Content-Length: x"))[0]["headers"][-1][0] == "WARC-Truncated" and read(b"") == read(b"no") == []
    folded = warc.to_bytes(response).replace(b"WARC-Date", b"X-Note: one\r\n two\r\nX-Note: three\r\nWARC-Date")
    assert read(folded)[0]["headers"] == [("X-Note", "one two"), ("X-Note", "three")]
    assert warc.build_derivatives(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark, tokenizer):
    import corpus_pipeline
    from test_texts import near_model, passages_model

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    stages = dict(corpus_pipeline.STAGES)
    given = stages["quality_rules"](spark, docs, DATA).toPandas()
    df = spark.createDataFrame(given, docs.schema)
    kept = stages["near_dedup"](spark, df, DATA).toPandas()
    want = {i for i, _, _, k in near_model(list(zip(given.doc_id.tolist(), given.text.tolist(), strict=True)), 5, 80) if k}
    assert set(kept.doc_id) == want
    df = spark.createDataFrame(kept, docs.schema)
    cut = stages["substring_dedup"](spark, df, DATA).toPandas()
    model = {i: (n, gone, sha) for i, n, gone, sha in passages_model(list(zip(kept.doc_id.tolist(), kept.text.tolist(), strict=True)), 13)}
    assert set(cut.doc_id) == {i for i, (n, gone, _) in model.items() if n == 0 or gone < n}
    import hashlib
    import re

    for i, text in zip(cut.doc_id, cut.text, strict=True):
        assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).encode()).hexdigest() == model[i][2]
    assert all(n == len(t) for n, t, i in zip(cut.n_chars, cut.text, cut.doc_id, strict=True) if model[i][1])
    mixed = stages["mixing"](spark, spark.createDataFrame(cut, docs.schema), DATA)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def _docs(spark, items):
    return spark.createDataFrame([(i, t, "en", f"s{n}", len(t) if t is not None else None) for n, (i, t) in enumerate(items)], "doc_id long, text string, lang string, source string, n_chars long")


def _words(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_stages_keep_rows_without_id(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = _docs(spark, [(1, _words(1, 40)), (None, _words(2, 40)), (None, "short"), (3, "short"), (3, _words(3, 40)), (None, None)])
    got = stages["quality_rules"](spark, docs, str(tmp_path))
    assert rows(got.select("source")) == [("s0",), ("s1",), ("s4",)]
    docs = _docs(spark, [(1, _words(1, 40)), (None, _words(1, 20) + " " + _words(2, 5)), (None, _words(1, 40)), (None, None)])
    got = {r.source: r for r in stages["substring_dedup"](spark, docs, str(tmp_path)).collect()}
    assert set(got) == {"s0", "s1", "s3"} and got["s1"].text == _words(2, 5) and got["s1"].n_chars == len(_words(2, 5)) and got["s3"].text is None


def test_quality_stage_trusts_every_labelled_row(spark, tmp_path):
    """A kind of text that only labelled rows beyond the first 20,000 by hash have is trusted text too."""
    import corpus_pipeline

    rng = random.Random(12)
    plain, other, junk = ([f"{kind}{i}" for i in range(40)] for kind in ("plain", "other", "junk"))
    order = [r.id for r in spark.range(23_000).withColumn("h", F.xxhash64("id")).orderBy("h", "id").collect()]
    kinds = {i: plain if n < 20_000 else other for n, i in enumerate(order)} | {i: other if i < 23_100 else junk for i in range(23_000, 23_200)}
    docs = _docs(spark, [(i, " ".join(rng.choices(words, k=24))) for i, words in kinds.items()])
    spark.createDataFrame([(i, 1) for i in order], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert kept == {i for i, words in kinds.items() if words is not junk}


def test_stages_keep_texts_that_share_an_id(spark, tmp_path):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = _docs(spark, [(3, _words(1, 60)), (5, _words(1, 60) + " end"), (5, _words(2, 60)), (5, _words(2, 60)), (9, _words(2, 60) + " end")])
    got = stages["near_dedup"](spark, docs, str(tmp_path))
    assert rows(got.select("source")) == [("s0",), ("s2",), ("s3",)]
    docs = _docs(spark, [(3, _words(1, 40)), (5, _words(1, 20) + " " + _words(2, 5)), (5, _words(3, 30)), (5, _words(1, 40))])
    got = {r.source: r.text for r in stages["substring_dedup"](spark, docs, str(tmp_path)).collect()}
    assert got == {"s0": _words(1, 40), "s1": _words(2, 5), "s2": _words(3, 30)}
