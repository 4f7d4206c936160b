"""MinHash near-dedup with SetSketch registers.

Classes of equal shingle sets come first, so copies cost one row each. Each class' registers are banded; the members of
a bucket meet its smallest class, the hub, and all buckets of a hub form one cluster: two classes that share a bucket
share a cluster. Inside a cluster, pairs are estimated by joint likelihood and the candidates confirmed on whole sets
with blocked 0/1 matrix products; only spanning forests of the links leave a block. Large clusters are cut into blocks
by hash: everything is first held against the hub, and only what doesn't link with it meets all other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .components import connected, forest
from .store import cut
from .textkit import Texts, U, group_starts, mix, release, run_hashes, slices

#: Classes in a block, about, and shingles of theirs.
BLOCK, ITEMS = 192, 400_000
#: Standard deviations of the estimate below the threshold at which a pair is still confirmed.
SLACK = 6.0


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct ``k``-word shingles, ordered by text and hash; a shorter text's words are one shingle."""
    _, doc, h = texts.windows(k)
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < k))
    if len(short):
        whole = run_hashes(texts.hash, texts.w0[short], texts.w0[short + 1])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, whole])
    order = np.lexsort((h, doc)) if len(h) < 2048 else _order(doc, h)
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def _order(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.argsort(h)
    return order[np.argsort(doc[order], kind="stable")]


def _sums(h: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Two independent sums over each set, equal for equal sets."""
    sums = []
    for part in (mix(h), mix(h ^ U(0xA0761D6478BD642F))):
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(part, out=total[1:])
        sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
    return sums


def _sketch_rows(shingle: int) -> callable:
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"), lower=True)
            doc, h = shingle_sets(texts, shingle)
            cuts = np.searchsorted(doc, np.arange(texts.n + 1))
            registers = setsketch.sketches(h, doc, texts.n)
            sums = _sums(h, cuts)
            width = registers.shape[1] * 2
            blob = pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer((np.arange(texts.n + 1) * width).astype(np.int32)), pa.py_buffer(registers.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(cuts)), pa.array(sums[0]), pa.array(sums[1]), blob], schema=schema)

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = setsketch.band_keys(_registers(batch.column("sketch")))
            rep, n = (np.repeat(batch.column(c).to_numpy(), keys.shape[1]) for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep), pa.array(n)], names=["key", "rep", "n"])


def _registers(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _set_rows(shingle: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text"), lower=True)
            doc, h = shingle_sets(texts, shingle)
            cuts = np.searchsorted(doc, np.arange(texts.n + 1))
            sets = pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x) for x in _sums(h, cuts)), sets], names=["rep", "f1", "f2", "items"])

    return run


def jaccard_links(a: list[np.ndarray], b: list[np.ndarray], may: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of ``may`` have 100 * |a & b| >= percent * |a | b|; exact counts from 0/1 products over slices of the items."""
    out = np.zeros(may.shape, dtype=bool)
    use_a, use_b = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(use_a):
        return out
    sets = [a[i] for i in use_a] + [b[j] for j in use_b]
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(items)
    items, owner = items[order], owner[order]
    starts = group_starts(items)
    number = np.zeros(len(items), dtype=np.int64)
    number[starts] = 1
    number = np.cumsum(number) - 1
    often = np.diff(np.append(starts, len(items))) > 1
    number, owner = number[often[number]], owner[often[number]]
    starts = group_starts(number)
    column = np.zeros(len(number), dtype=np.int64)
    column[starts] = 1
    column = np.cumsum(column) - 1
    shared = np.zeros((len(use_a), len(use_b)))
    width = 8192
    at = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for lo, hi in zip(at, at[1:], strict=False):
        if hi > lo:
            dense = np.zeros((len(sets), width), dtype=np.float32)
            dense[owner[lo:hi], column[lo:hi] % width] = 1
            shared += dense[: len(use_a)] @ dense[len(use_a) :].T
    union = sizes[: len(use_a), None] + sizes[None, len(use_a) :] - shared
    out[np.ix_(use_a, use_b)] = 100 * shared >= percent * union
    return out & may


def _link_unit(percent: int) -> callable:
    """Edges (a spanning forest of the links) of one unit: side 0 against side 1, or against itself where there is no side 1."""
    level = percent / 100
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        ids = table.column("rep").to_numpy()
        registers = _registers(table.column("sketch"))
        blobs = table.column("items").to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs]
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        least = level - SLACK * (level * (1 - level) / registers.shape[1]) ** 0.5
        may = np.zeros((len(left), len(right)), dtype=bool)
        for i, x in enumerate(left):
            fit = np.minimum(sizes[x], sizes[right]) >= level * np.maximum(sizes[x], sizes[right])
            at = np.flatnonzero(fit & (ids[right] != ids[x]))
            if len(at):
                y = right[at]
                may[i, at] = setsketch.estimate(np.broadcast_to(registers[x], (len(y), registers.shape[1])), registers[y], np.full(len(y), sizes[x]), sizes[y]) >= least
        links = jaccard_links([sets[x] for x in left], [sets[y] for y in right], may, percent)
        i, j = forest(links)
        del sets, blobs, registers
        if len(sizes) > BLOCK // 2:
            release()
        return pa.table([pa.array(ids[left[i]]), pa.array(ids[right[j]])], schema=schema)

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: near-duplicate groups of texts by word-shingle Jaccard similarity.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text of fewer than ``shingle`` words is one shingle,
    an empty or null text has none and links with nothing. Texts link at 100 * intersection >= ``percent`` * union,
    confirmed on the full sets. ``component_id`` is the smallest id reachable by links; ``kept`` marks that row. Rows
    that repeat an id and text are all kept with it (they are one document); rows that share an id but not the text are one
    document too, which links with whatever one of its texts links with. Rows of null id get their count, a null
    component and are kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = cut(rows.mapInArrow(_sketch_rows(shingle), "id long, n long, f1 long, f2 long, sketch binary"))
    classes = cut(sketched.filter("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch")))
    bands = classes.select("rep", "n", "sketch").mapInArrow(_band_rows, "key long, rep long, n long")
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(bands.join(hubs, "key").groupBy("hub", "rep").agg(F.max("n").alias("n")))
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = rows.join(wanted, "id").mapInArrow(_set_rows(shingle), "rep long, f1 long, f2 long, items binary").dropDuplicates(["rep", "f1", "f2"])
    sets = cut(sets.join(classes.select("rep", "f1", "f2", "sketch"), ["rep", "f1", "f2"]).select("rep", "sketch", "items"))
    # Counts are cut off before they are joined: a join of two plain exchanges is one that Spark can split where a hub is frequent.
    counts = cut(members.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / ITEMS)).cast("long").alias("blocks")))
    placed = members.join(counts, "hub")
    placed = cut(placed.withColumn("block", F.pmod(F.xxhash64("rep", "hub"), "blocks")))
    link = _link_unit(percent)
    edge = "a long, b long"

    def linked(units: DataFrame) -> DataFrame:
        return units.join(sets, "rep").groupBy("hub", "x", "y").applyInArrow(link, edge)

    small = placed.filter("blocks = 1").select("hub", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("side"), "rep")
    large = placed.filter("blocks > 1")
    star = large.select("hub", F.lit(-1).cast("long").alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"), "rep")
    star = star.unionByName(star.select("hub", "x", "y", F.lit(0).alias("side"), F.col("hub").alias("rep")).distinct())
    first = cut(linked(small.unionByName(star)))
    # What did not link with its hub meets every block of the cluster.
    near = first.select(F.col("a").alias("hub"), F.col("b").alias("rep")).distinct()
    out = cut(large.filter("rep <> hub").join(near, ["hub", "rep"], "left_anti").select("hub", "rep", "n"))
    out = out.join(cut(out.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / ITEMS)).cast("long").alias("parts"))), "hub")
    out = cut(out.withColumn("x", F.pmod(F.xxhash64("rep", "hub", F.lit(1)), "parts")).select("hub", "x", "rep"))
    meets = out.select("hub", "x").distinct().join(large.select("hub", F.col("block").alias("y")).distinct(), "hub")
    left = meets.join(out, ["hub", "x"]).select("hub", "x", "y", F.lit(0).alias("side"), "rep")
    right = meets.join(large.select("hub", F.col("block").alias("y"), "rep"), ["hub", "y"]).select("hub", "x", "y", F.lit(1).alias("side"), "rep")
    second = linked(left.unionByName(right))
    groups = connected(first.unionByName(second), "a", "b").select(F.col("node").alias("rep"), "component")
    found = classes.select("n", "f1", "f2", "rep").join(groups, "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    named = sketched.filter("n > 0 and id is not null").select("id", "n", "f1", "f2").join(found, ["n", "f1", "f2"])
    rest = sketched.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return named.select("id", "n", "component").unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def oracle(shingle: int = 4, percent: int = 80) -> str:
    """DuckDB's twin of the query by definition: sets, pairs by shared shingles, components by closure."""
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w FROM documents),
parts AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - {shingle - 1}, 1) + 1) END) AS place FROM texts),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, place, place + {shingle - 1}), ' ') AS s FROM parts),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= {percent} * (x.n + y.n - c.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id, least(doc_id, coalesce(min(b), doc_id)) = doc_id AS kept
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON a = doc_id GROUP BY doc_id
"""


ORACLE = oracle()
