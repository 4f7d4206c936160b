"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut in halves, each with its own codebook (k-means on a bounded sample); a pair of codes is a cell of
the product grid and every vector is filed in one. A multi-sequence traversal visits cells in ascending distance to the
vector, as many as a sample of queries needs for the target recall, of its links by brute force and of made-up partners at the
least cosine that links. Pairs met in a visited cell are verified in double precision. A vector is sent once to each region
of cells that it visits. Equal vectors are one class of the index; regions with many members are cut in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected, forest
from .store import cut

#: Classes in a block of members of a region, about; visitors in a block; visitors that meet a cell's members at a time.
BLOCK, GUESTS, SLICE = 3072, 12288, 2048
#: Made-up partners per sample query.
PARTNERS = 8


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as unit rows of ``width`` doubles, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    # By powers of two, which change no digit: squares of very small or large components stay in range.
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0.0, keepdims=True))[1])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Codewords of ``x`` by Lloyd's rounds from a random start; codes that lose all points keep their place."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (np.square(codes).sum(axis=1)[None, :] - 2 * x @ codes.T).argmin(axis=1)
        for j in range(len(codes)):
            if (near == j).any():
                codes[j] = x[near == j].mean(axis=0)
    return codes


class Grid:
    """Two codebooks; cell (i, j) has number i * size + j."""

    def __init__(self, sample: np.ndarray, size: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], size, seed=5), kmeans(sample[:, self.half :], size, seed=6)]
        self.size = len(self.books[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return tuple(np.maximum(np.square(p).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2 * p @ b.T, 0) for p, b in zip(parts, self.books, strict=True))

    def cell(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return one.argmin(axis=1) * self.size + two.argmin(axis=1)

    def region(self, cells: np.ndarray, span: int) -> np.ndarray:
        """Cells of one first code and ``span`` neighbouring second ones are a region."""
        return cells // self.size * -(-self.size // span) + cells % self.size // span

    def visits_to(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many visits a row takes to see a cell for certain: the cells no farther than it, ties included."""
        out = np.zeros(len(x), dtype=np.int64)
        for at in range(0, len(x), 1024):
            one, two = self.distances(x[at : at + 1024])
            for k, c in enumerate(cells[at : at + 1024]):
                i, j = divmod(int(c), self.size)
                out[at + k] = np.searchsorted(np.sort(two[k]), one[k, i] + two[k, j] - one[k] + 1e-12, side="right").sum()
        return out

    def traversal(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` cells nearest to each row, nearest first (rows, visits).

        The multi-sequence order: with both codebooks sorted by distance, the pair of ranks (a, b) comes after all
        (a', b') with a' <= a and b' <= b, so only pairs with (a + 1) * (b + 1) <= visits can be among the first.
        """
        one, two = self.distances(x)
        first, second = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        a, b = np.meshgrid(np.arange(first.shape[1]), np.arange(second.shape[1]), indexing="ij")
        may = (a + 1) * (b + 1) <= visits
        a, b = a[may], b[may]
        i, j = first[:, a], second[:, b]
        sums = np.take_along_axis(one, i, axis=1) + np.take_along_axis(two, j, axis=1)
        best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(i, best, axis=1) * self.size + np.take_along_axis(j, best, axis=1)


def _rank_rows(grid: Grid, reps: np.ndarray, queries: np.ndarray, width: int, level: float) -> callable:
    """How many visits of the sample queries their true links (never a query with itself) take: (visits, links) per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _vectors(part.column("embedding"), width)
                q, y = np.nonzero((queries @ x.T >= level) & (reps[:, None] != part.column("rep").to_numpy()[None, :]))
                pairs, links = np.unique(np.stack([q, grid.cell(x)[y]], axis=1), axis=0, return_counts=True)
                for k, count in zip(grid.visits_to(queries[pairs[:, 0]], pairs[:, 1]), links, strict=True):
                    held[int(k)] = held.get(int(k), 0) + int(count)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], names=["visits", "links"])

    return run


def partner_visits(grid: Grid, queries: np.ndarray, level: float, seed: int = 7) -> np.ndarray:
    """The visits that find made-up partners at cosine ``level`` exactly, the hardest links there are, from either side."""
    rng = np.random.default_rng(seed)
    x = np.repeat(queries, PARTNERS, axis=0)
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    y = level * x + max(0.0, 1 - level * level) ** 0.5 * aside
    return np.minimum(grid.visits_to(x, grid.cell(y)), grid.visits_to(y, grid.cell(x)))


def _places(grid: Grid, x: np.ndarray, visits: int, span: int) -> tuple[np.ndarray, ...]:
    """(seen cells by region, places in them where a row's next region begins, their regions, own cells, own regions)."""
    seen = grid.traversal(x, visits)
    region = grid.region(seen, span)
    order = np.argsort(region, axis=1, kind="stable")
    seen, region = np.take_along_axis(seen, order, axis=1), np.take_along_axis(region, order, axis=1)
    new = np.ones(region.shape, dtype=bool)
    new[:, 1:] = region[:, 1:] != region[:, :-1]
    begin = np.flatnonzero(new)
    home = grid.cell(x)
    return seen, begin, region.ravel()[begin], home, grid.region(home, span)


def _count_rows(grid: Grid, visits: int, span: int, width: int) -> callable:
    """(region, side, rows) of what ``_file_rows`` files, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                _, _, visited, _, own = _places(grid, _vectors(batch.column("embedding").slice(at, 2048), width), visits, span)
                for side, regions in enumerate((visited, own)):
                    region, n = np.unique(regions, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(np.full(len(region), side, dtype=np.int32)), pa.array(n)], names=["region", "side", "rows"])

    return run


def _file_rows(grid: Grid, visits: int, span: int, width: int) -> callable:
    """Each class once for the region of its own cell (side 1, with all cells it visits) and once for each region it visits (side 0, with the cells there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _vectors(part.column("embedding"), width)
                seen, begin, visited, home, own = _places(grid, x, visits, span)
                n, k = seen.shape
                rows = np.concatenate([begin // k, np.arange(n)])
                side = np.concatenate([np.zeros(len(begin), dtype=np.int32), np.ones(n, dtype=np.int32)])
                path = pa.ListArray.from_arrays(pa.array(np.concatenate([begin, n * k + np.arange(n + 1) * k]).astype(np.int32)), pa.array(np.tile(seen.ravel(), 2).astype(np.int32)))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([visited, own])), pa.array(side), part.column("rep").take(take), part.column("mult").take(take), pa.array(home[rows]), path, part.column("embedding").take(take)], names=["region", "side", "rep", "mult", "home", "path", "embedding"])

    return run


def _unit(width: int, level: float) -> callable:
    """Verified links of a block of a region's visitors (side 0) with a block of its members (side 1), cell by cell.

    A visitor counts what it finds; a member counts the visitors whose own cell it does not visit itself, as it can't find
    them. Rows: (a, b null, links of a) and a spanning forest per cell and slice of visitors (a, b, null).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        v, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(v) or not len(m):
            return schema.empty_table()
        x = _vectors(table.column("embedding"), width)
        rep, mult, home = (table.column(c).to_numpy() for c in ("rep", "mult", "home"))
        path = table.column("path").chunk(0)
        at, cells = path.offsets.to_numpy().astype(np.int64), path.values.to_numpy()
        size = np.diff(at)
        visitor = np.repeat(v, size[v])
        cell = cells[np.arange(len(visitor)) - np.repeat(np.cumsum(size[v]) - size[v], size[v]) + np.repeat(at[v], size[v])]
        order = np.argsort(cell, kind="stable")
        visitor, cell = visitor[order], cell[order]
        m = m[np.argsort(home[m], kind="stable")]
        begin = np.flatnonzero(np.append(True, home[m][1:] != home[m][:-1]))
        found, missed, pairs = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64), []
        for lo, hi in zip(begin, np.append(begin[1:], len(m)), strict=True):
            y = m[lo:hi]
            guests = visitor[slice(*np.searchsorted(cell, [home[y[0]], home[y[0]] + 1]))]
            for cut_at in range(0, len(guests), SLICE):
                g = guests[cut_at : cut_at + SLICE]
                links = (x[g] @ x[y].T >= level) & (rep[g][:, None] != rep[y][None, :])
                g, links = g[links.any(axis=1)], links[links.any(axis=1)]
                if not len(g):
                    continue
                own, number = np.unique(home[g], return_inverse=True)
                paths = cells[at[y][:, None] + np.arange(size[y[0]])]
                blind = ~np.stack([(paths == c).any(axis=1) for c in own])  # cells of visitors that members don't visit
                found[g] += links @ mult[y]
                missed[y] += (links & blind[number]).T @ mult[g]
                i, j = forest(links)
                pairs.append((rep[g[i]], rep[y[j]]))
        one, two = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64) for k in (0, 1))
        a = np.concatenate([rep[found > 0], rep[missed > 0], one])
        none = int((found > 0).sum() + (missed > 0).sum())
        b = pa.array(np.concatenate([np.zeros(none, dtype=np.int64), two]), mask=np.arange(len(a)) < none)
        count = pa.array(np.concatenate([found[found > 0], missed[missed > 0], np.zeros(len(one), dtype=np.int64)]), mask=np.arange(len(a)) >= none)
        return pa.table([pa.array(a.astype(np.int64)), b, count], schema=schema)

    return run


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", level: float = 0.9, sample_rows: int = 8192, query_rows: int = 512, recall: float = 1.0, per_cell: int = 64) -> DataFrame:
    """(id, n_links, component_id, kept) per row: links of cosine >= ``level`` in double precision and their components.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable, ``kept`` marks that
    row. Codebooks are fitted on at most ``sample_rows`` classes of least hash; every row is indexed. The cells visited are
    as many as give ``recall`` of the true links of ``query_rows`` sample queries against all other rows and, as these may
    have few or only close ones, of made-up partners of the queries at cosine ``level`` exactly; and as many again.
    Null, zero and non-finite vectors link with nothing; vectors of different lengths are compared as if padded with
    zeros. Rows of null id link with nothing, have a null component and are kept. Rows that repeat an id count as
    separate rows of one node. An empty table gives no rows; other columns are ignored.
    """
    spark = table.sparkSession
    kind = "array<float>" if dict(table.dtypes)[vector_col] == "array<float>" else "array<double>"  # widened where it is compared
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("embedding"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = cut(rows.withColumn("embedding", F.when(sound & F.col("id").isNotNull(), F.col("embedding"))).withColumn("h", F.xxhash64("embedding")))
    classes = rows.filter("embedding is not null").groupBy("embedding", "h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    classes = cut(classes)
    n, width = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    width += width % 2
    if n > 1:
        sample = classes.orderBy(F.xxhash64("h"), "rep").limit(sample_rows).select("rep", "embedding").toArrow()  # bounded by sample_rows
        points = _vectors(sample.column("embedding"), width)
        grid = Grid(points, max(2, min(1024, int((n / per_cell) ** 0.5))))
        queries = points[:query_rows]
        needs = classes.select("rep", "embedding").mapInArrow(_rank_rows(grid, sample.column("rep").to_numpy()[:query_rows], queries, width, level), "visits long, links long").groupBy("visits").agg(F.sum("links").alias("links"))
        needs = needs.toPandas().sort_values("visits")  # at most as many as cells
        visits = int(np.quantile(partner_visits(grid, queries, level), min(1.0, recall), method="higher"))
        if len(needs):
            share = needs["links"].cumsum() / needs["links"].sum()
            visits = max(visits, int(needs["visits"][share >= min(1.0, recall)].min()))
        visits = min(len(grid.books[0]) * grid.size, 2 * visits)
        span = max(1, BLOCK // per_cell)
        filed = classes.select("rep", "mult", "embedding").mapInArrow(_file_rows(grid, visits, span, width), f"region long, side int, rep long, mult long, home long, path array<int>, embedding {kind}")
        sizes = classes.select("embedding").mapInArrow(_count_rows(grid, visits, span, width), "region long, side int, rows long").groupBy("region").agg(*[F.ceil(F.sum(F.when(F.col("side") == side, F.col("rows"))) / most).cast("int").alias(c) for side, most, c in ((0, GUESTS, "v"), (1, BLOCK, "m"))])
        sizes = cut(sizes.filter("v is not null and m is not null"))
        placed = filed.join(sizes, "region")
        mine = F.pmod(F.xxhash64("rep", "region"), F.when(F.col("side") == 0, F.col("v")).otherwise(F.col("m"))).cast("int")
        facing = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("m")).otherwise(F.col("v")) - 1))
        placed = placed.withColumn("mine", mine).withColumn("facing", facing)
        placed = placed.withColumn("x", F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("facing"))).withColumn("y", F.when(F.col("side") == 0, F.col("facing")).otherwise(F.col("mine")))
        found = cut(placed.select("region", "x", "y", "side", "rep", "mult", "home", "path", "embedding").groupBy("region", "x", "y").applyInArrow(_unit(width, level), "a long, b long, links long"))
        counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
        groups = connected(found.filter("b is not null"), "a", "b").select(F.col("node").alias("rep"), "component")
    else:
        counts = spark.createDataFrame([], "rep long, links long")
        groups = spark.createDataFrame([], "rep long, component long")
    known = classes.join(counts, "rep", "left").join(groups, "rep", "left").select("embedding", "h", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    valid = rows.filter("embedding is not null").join(known, ["h", "embedding"]).select("id", "links", "component")
    rest = rows.filter("embedding is null").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return valid.unionByName(rest).select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


#: DuckDB's twin of the query by definition: every pair, components by closure.
ORACLE = """
WITH RECURSIVE sound AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
edges AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, least(vec_id, coalesce(l.b, vec_id)) = vec_id AS kept FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
