"""Gaps, islands and neighbours against hand-made cases and plain models."""

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rangeloom.operators import gaps
from rangeloom.operators import neighbours
from rangeloom.operators.neighbours import Layout, bounds_of, ordinal, running, with_next
from rangeloom.plans import catalogue

RANGES = "partition_id long, min_id long, max_id long"


def frame(spark, pairs):
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(pairs)], RANGES)


@pytest.mark.parametrize(
    "pairs, want",
    [([], []), ([(1, 1000)], []), ([(1, 1000), (1001, 2000)], []), ([(1, 1000), (1501, 2500)], [(1001, 1500)]), ([(1, 1500), (1200, 2500), (3000, 4000)], [(2501, 2999)]), ([(1, 1000), (5001, 6000)], [(1001, 5000)])],
)
def test_gaps(spark, pairs, want):
    assert rows(gaps.gaps_adjacent(frame(spark, pairs))) == want
    assert rows(gaps.gaps_covered(frame(spark, pairs))) == want


def test_nested_ranges(spark):
    df = frame(spark, [(1, 100), (10, 20), (50, 60), (201, 300)])
    assert rows(gaps.gaps_adjacent(df)) == [(21, 49), (61, 200)]
    assert rows(gaps.gaps_covered(df)) == [(101, 200)]


def test_split(spark):
    ids = spark.range(1, 4001).toDF("id")

    def split(start, end, pid):
        return rows(gaps.split_gaps(spark.createDataFrame([(start, end)], "start_id long, end_id long"), ids, "id", size=1000, next_id=pid))

    assert split(1001, 1500, 10) == [(10, 1001, 1500)]
    assert split(1001, 3500, 20) == [(20, 1001, 2000), (21, 2001, 3000), (22, 3001, 3500)]


def test_split_leaves_out_tiles_without_data(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(1, 501), *range(800, 1201), *range(1500, 2001), *range(3000, 3501)]], "id long")
    ranges = frame(spark, [(1, 500), (1000, 1200), (2500, 3000)])
    got = rows(gaps.split_gaps(gaps.gaps_adjacent(ranges), ids, "id", size=1000, next_id=4))
    assert [(a, b) for _, a, b in got] == [(501, 999), (1201, 2200)]


@pytest.mark.parametrize("top, a, b, want", [(1500, 1000, 2000, True), (500, 1000, 2000, False)])
def test_has_data(spark, top, a, b, want):
    ids = spark.range(1, top + 1).toDF("id")
    got = gaps.has_data(spark.createDataFrame([(a, b)], "min_id long, max_id long"), ids, "id", size=1001)
    assert (got.count() == 1) is want


def test_has_data_start_does_not_count(spark):
    ids = spark.createDataFrame([(10,)], "id long")
    tile = spark.createDataFrame([(10, 19)], "min_id long, max_id long")
    assert gaps.has_data(tile, ids, "id", size=10).count() == 0
    assert gaps.has_data(tile, ids, "id", size=10, start_exclusive=False).count() == 1


NEIGHBOURS = [
    (2001, 3000, 999, 2, 3), (500, 800, 999, None, None), (-100, -1, 999, None, 1), (7001, 8000, 999, 5, None), (3001, 4000, 3, 2, 4), (-100, 0, 999, None, 1),
    (1500, 2500, 999, None, 3), (1800, 2500, 999, None, 3), (900, 1500, 999, None, None), (500, 1200, 999, None, None), (1100, 1900, 999, None, None), (1800, 3200, 999, None, None),
]


def test_neighbours(spark):
    ranges = frame(spark, [(1, 1000), (1001, 2000), (3001, 4000), (4001, 5000), (6001, 7000)])
    probes = spark.createDataFrame([(i, s, a, b) for i, (a, b, s, _, _) in enumerate(NEIGHBOURS)], "probe_id long, self_id long, min_id long, max_id long")
    got = {r.probe_id: (r.prev_id, r.next_id) for r in gaps.adjacent_ranges(probes, ranges).collect()}
    assert got == {i: (p, n) for i, (_, _, _, p, n) in enumerate(NEIGHBOURS)}


def test_random_sets_against_models(spark):
    rng = random.Random(3)
    pairs = sorted({(a, a + rng.randint(0, 60)) for a in rng.sample(range(2000), 60)})
    df = frame(spark, pairs)
    covered = {x for a, b in pairs for x in range(a, b + 1)}
    inside = [x for x in range(pairs[0][0], pairs[-1][0]) if x not in covered]
    got = [x for a, b in rows(gaps.gaps_covered(df)) for x in range(a, b + 1)]
    assert got == inside
    found = rows(gaps.islands(spark.createDataFrame([(x,) for x in covered], "id long"), "id"))
    assert sorted(x for a, b, n in found for x in range(a, b + 1)) == sorted(covered) and all(n == b - a + 1 for a, b, n in found)
    assert all(b[0] > a[1] + 1 for a, b in zip(found, found[1:], strict=False))
    probes = [(i, 1000 + i, a, a + rng.randint(0, 40)) for i, a in enumerate(rng.sample(range(2100), 40))]
    got = {r[0]: (r[1], r[2]) for r in rows(gaps.adjacent_ranges(spark.createDataFrame(probes, "probe_id long, self_id long, min_id long, max_id long"), df).select("probe_id", "prev_id", "next_id"))}
    for i, _, mn, mx in probes:
        before = max(((b, k + 1) for k, (a, b) in enumerate(pairs) if b < mn), default=(0, None))[1]
        after = min(((a, k + 1) for k, (a, b) in enumerate(pairs) if a > mx), default=(0, None))[1]
        want = (None if any(a <= mn <= b for a, b in pairs) else before, None if any(a <= mx <= b for a, b in pairs) else after)
        assert got[i] == want


def test_buckets_do_not_matter(spark):
    keys = random.Random(5).sample(range(10_000), 300)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    ordered = sorted(keys)
    for bounds in (Layout(0, 9999, 1), Layout(0, 9999, 3), Layout(0, 9999, 50), Layout(0, 9999, 4096), Layout(0, 9999, 4, (17, 18, 5000)), None):
        assert rows(with_next(df, "k", {"n": "k"}, bounds=bounds).select("k", "n")) == sorted(zip(ordered, [*ordered[1:], None], strict=True))
        assert rows(ordinal(df, "k", "i", bounds=bounds).select("k", "i")) == [(k, i + 1) for i, k in enumerate(ordered)]
        sums, total = [], 0
        for k in ordered:
            total += k % 7
            sums.append((k, total))
        assert rows(running(df, "k", "v", {"s": ("sum", "v")}, bounds=bounds).select("k", "s")) == sums


def test_outliers_and_clusters_stay_apart(spark, monkeypatch):
    """One far id and dense clusters: no bucket gets much more than its share, and the neighbours are right."""
    monkeypatch.setattr(neighbours, "SMALL", 0)
    rng = random.Random(3)
    keys = sorted({*(rng.randrange(2000) for _ in range(3000)), *(10**12 + rng.randrange(900) for _ in range(800)), 2**60, -(2**62)})
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    layout = bounds_of(df, "k")
    sizes = df.select(layout.bucket(F.col("k")).alias("b"), "k").collect()
    assert all(layout.of(r.k) == r.b for r in sizes)
    counts = Counter(r.b for r in sizes)
    assert layout.cuts and max(counts.values()) <= 4 * len(keys) / layout.buckets + 2
    assert rows(with_next(df, "k", {"n": "k"}).select("k", "n")) == sorted(zip(keys, [*keys[1:], None], strict=True))
    assert rows(ordinal(df, "k", "i").select("k", "i")) == [(k, i + 1) for i, k in enumerate(keys)]
    found = rows(gaps.islands(df, "k"))
    assert sum(n for *_, n in found) == len(keys) and found[0] == (-(2**62), -(2**62), 1) and found[-1] == (2**60, 2**60, 1)
    assert bounds_of(df.filter("k between 0 and 1999"), "k").cuts is None  # even keys need no cuts


def test_wide_gaps_and_ranges_cost_nothing(spark):
    """A gap of 10**15 ids in tiles of 10, a range over nearly everything, a plan of more tiles than one array holds."""
    wide = spark.createDataFrame([(5, 10**15), (10**15 + 7, 10**15 + 60)], "start_id long, end_id long")
    ids = spark.createDataFrame([(x,) for x in (1, 5, 6, 7, 24, 25, 26, 10**14, 10**15, 10**15 + 3, 10**15 + 20, 10**15 + 61)], "k long")
    got = rows(gaps.split_gaps(wide, ids, "k", size=10, next_id=100))
    tile = (10**14 - 5) // 10 * 10 + 5
    want = [(5, 14), (15, 24), (25, 34), (tile, tile + 9), (10**15 - 5, 10**15 - 5 + 9), (10**15 + 17, 10**15 + 26)]
    want = [(100 + i, a, min(b, 10**15) if a < 10**15 else b) for i, (a, b) in enumerate(x for x in want if x[0] != 10**14)]
    assert got == want
    rng = random.Random(4)
    one, two = ([(i, a, a + rng.choice((0, 3, 40, 900, 10**6))) for i, a in enumerate(rng.sample(range(5000), 60))] for _ in range(2))
    one.append((99, -(10**14), 10**14))
    schema = "partition_id long, min_id long, max_id long"
    got = rows(gaps.overlaps(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), size=16))
    assert got == sorted((i, j) for i, a, b in one for j, c, d in two if a <= d and c <= b)
    assert gaps.overlaps(spark.createDataFrame([], schema), spark.createDataFrame([], schema), size=16).count() == 0


def test_prefix(spark):
    assert rows(gaps.contiguous_prefix(frame(spark, [(1, 10), (11, 20), (21, 30), (41, 50)]))) == [(20,)]
    assert rows(gaps.contiguous_prefix(frame(spark, [(1, 10), (11, 20), (21, 30)]))) == [(20,)]
    assert rows(gaps.contiguous_prefix(frame(spark, []))) == [(0,)]


def test_every_order_is_a_range_and_a_probe(spark, tmp_path):
    """No order is left out of the inputs; neighbours against a plain model."""
    rng = random.Random(6)
    orders = [(i, rng.randrange(400)) for i in range(301) if rng.random() < 0.8]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    ranges = [(i, i * 50, i * 50 + 1 + c % 190) for i, c in orders]
    assert rows(catalogue.every_order(spark, str(tmp_path))) == ranges
    want = []
    for pid, low, high in ranges:
        others = [r for r in ranges if r[0] != pid]
        before = None if any(a <= low <= b for _, a, b in others) else max(((b, p) for p, a, b in others if b < low), default=(0, None))[1]
        after = None if any(a <= high <= b for _, a, b in others) else min(((a, p) for p, a, b in others if a > high), default=(0, None))[1]
        want.append((pid, before, after))
    assert {(r.probe_id, r.prev_id, r.next_id) for r in catalogue.adjacent_every_order(spark, str(tmp_path)).collect()} == set(want)
    covered = {x for _, a, b in ranges for x in range(a, b + 1)}
    missed = {x for r in catalogue.gaps_covered_every_order(spark, str(tmp_path)).collect() for x in range(r.start_id, r.end_id + 1)}
    assert missed == set(range(min(covered), max(a for _, a, _ in ranges))) - covered
