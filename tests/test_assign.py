"""Ring, trial orders, reclaim, breaker, metrics, streams."""

import hashlib
import math
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rangeloom.functions.hashing import fnv1a32, seeded_shuffle, try_count
from rangeloom.operators import assign, breaker, metrics, process
from rangeloom.streaming import ledger as streams

T0 = datetime(2024, 1, 31)


def h32(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)


def names(spark, n):
    return spark.createDataFrame([(f"worker{i}",) for i in range(1, n + 1)], "worker_id string")


@pytest.mark.parametrize("n, ids", [(1, 20), (3, 300), (4, 1000)])
def test_ring_equals_a_plain_one(spark, n, ids):
    points = sorted((h32(k), f"worker{w}") for w in range(1, n + 1) for i in range(50) for k in (f"worker{w}:{i}", f"{i}:worker{w}"))
    want = {i: next((w for h, w in points if h >= h32(str(i))), points[0][1]) for i in range(1, ids + 1)}
    parts = spark.range(1, ids + 1).toDF("partition_id")
    got = assign.prefer(parts, assign.ring(names(spark, n)))
    assert {r.partition_id: r.worker_id for r in got.collect()} == want
    q = assign.quality(assign.distribution(names(spark, n), got)).first()
    assert q.total == ids and q.worker_count == n
    if n == 3:
        assert q.variance == pytest.approx(2.0) and q.score == pytest.approx(98.596, abs=1e-3)


def test_ring_without_workers(spark):
    got = assign.prefer(spark.range(3).toDF("partition_id"), assign.ring(names(spark, 0)))
    assert [r.worker_id for r in got.collect()] == [None] * 3


def test_small_functions(spark):
    df = spark.createDataFrame([(n,) for n in (3, 8, 20, 100, 200, 10, 50)], "n long")
    assert [r[0] for r in df.select(try_count(F.col("n"))).collect()] == [3, 6, 10, 20, 20, 8, 25]
    df = spark.createDataFrame([("worker-1",), ("",), ("é",)], "s string")
    assert [r[0] for r in df.select(fnv1a32(F.col("s"))).collect()][:2] == [1945711149, 2166136261]
    df = spark.createDataFrame([(list(range(1, 11)), 1945711149)], "a array<long>, s long")
    assert df.select(seeded_shuffle(F.col("a"), F.lit(5), F.col("s"))).first()[0] == [2, 10, 4, 7, 3]
    assert df.select(seeded_shuffle(F.col("a"), F.lit(10), F.col("s"))).first()[0] == list(range(1, 11))


RECLAIM = [("claimed", "worker-2", 130, 130, True), ("claimed", "worker-2", 60, 60, False), ("claimed", "worker-1", 130, 130, False), ("running", "worker-2", 0, 310, True), ("running", "worker-2", 400, 100, False), ("running", "worker-1", 0, 310, False), ("pending", "", 900, 900, False), ("completed", "worker-2", 900, 900, False)]


def test_reclaim(spark):
    ago = lambda s: T0 - timedelta(seconds=s)
    df = spark.createDataFrame([(i, s, w, ago(u), ago(h)) for i, (s, w, u, h, _) in enumerate(RECLAIM)], "partition_id long, status string, worker_id string, updated_at timestamp_ntz, last_heartbeat timestamp_ntz")
    now = F.expr("timestamp_ntz'2024-01-31 00:00:00'")
    got = {r[0]: r[1] for r in df.select("partition_id", assign.reclaimable("worker-1", now, 60)).collect()}
    assert got == {i: r[-1] for i, r in enumerate(RECLAIM)}
    assert rows(assign.oldest_reclaim(df, "worker-1", now, 60)) == [("claimed", 0), ("running", 3)]
    beats = df.select("worker_id", F.col("last_heartbeat").alias("ts"))
    assert rows(assign.alive(beats, now, 180).select("worker_id")) == [("worker-1",), ("worker-2",)]
    pol = spark.createDataFrame([(25, True), (20, True), (25, False), (10, True), (5, False), (3, True)], "n int, r boolean")
    assert [r[0] for r in pol.select(assign.policy(F.col("n"), F.col("r"))).collect()] == ["ring", "ring", "random", "random", "random", "direct"]


def test_breaker_states():
    b = breaker.Breaker()
    assert b.feed("attempt", 0, 0.0)
    for p in (1, 1, 2):
        b.feed("failure", p, 1.0)
    assert (b.state, b.consecutive) == ("closed", 2)
    b.feed("failure", 3, 2.0)
    assert (b.state, b.trips) == ("open", 1)
    assert not b.feed("attempt", 0, 32.0)  # not yet: exactly the time limit
    assert b.feed("attempt", 0, 32.1) and b.state == "half-open"
    assert b.feed("attempt", 0, 32.2) and not b.feed("attempt", 0, 32.3)
    b.feed("failure", 3, 33.0)
    assert (b.state, b.trips) == ("open", 1)
    assert b.feed("attempt", 0, 64.0)
    b.feed("success", 9, 65.0)
    assert (b.state, b.failed, b.consecutive) == ("closed", {}, 0)
    for p in (1, 2, 3):
        b.feed("failure", p, 70.0)
    assert b.state == "open" and b.feed("attempt", 0, 371.0) and b.state == "closed"  # all failures too old


def events(n=200, seed=2):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice((0.5, 2.0, 20.0))
        out.append((f"w{rng.randint(0, 2)}", i, t, rng.choice(("attempt", "success", "failure", "failure")), rng.randint(0, 9)))
    return out


def test_batch_and_stream_breakers_agree(spark, tmp_path):
    schema = "worker_id string, seq long, ts double, kind string, partition_id long"
    data = events()
    df = spark.createDataFrame(data, schema)
    want = rows(breaker.automaton(df))
    model, plain = {}, []
    for w, seq, t, kind, p in data:
        b = model.setdefault(w, breaker.Breaker())
        ok = b.feed(kind, p, t)
        plain.append((w, seq, kind, p, ok, b.state, b.consecutive, len(b.failed), b.trips))
    assert want == sorted(plain)
    for part in range(4):
        spark.createDataFrame(data[part * 50 : part * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streams.breaker(stream).writeStream.format("memory").queryName("breaker_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(rows(spark.table("breaker_out"))) == len(want)


def test_stream_upkeep_and_counts(spark, tmp_path):
    schema = "partition_id long, status string, ts timestamp_ntz, seq long"
    data = [(i % 5, s, T0 + timedelta(minutes=i), i) for i, s in enumerate(["pending", "claimed", "running", "completed"] * 6)]
    for part in range(3):
        spark.createDataFrame(data[part * 8 : part * 8 + 8], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={part}"))
    folder, path = str(tmp_path / "in" / "*"), str(tmp_path / "ledger")
    q = streams.upkeep(streams.read_events(spark, folder, schema, files=1), path, "partition_id", ["ts", "seq"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for p, s, t, _ in data:
        last[p] = s
    assert {r.partition_id: r.status for r in streams.current(spark, path).collect()} == last
    q = streams.status_counts(streams.read_events(spark, folder, schema)).writeStream.outputMode("complete").format("memory").queryName("counts_out").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("counts_out")) == [(s, 6) for s in ("claimed", "completed", "pending", "running")]


def test_upkeep_merges_now_and_then(spark, tmp_path):
    """A batch writes its own rows only; every few batches a new base takes the place of the older folders."""
    schema = "partition_id long, status string, ts timestamp_ntz, seq long"
    rng = random.Random(2)
    data = [(rng.randrange(30), rng.choice("abc"), T0 + timedelta(minutes=rng.randrange(500)), i) for i in range(90)]
    for part in range(9):
        spark.createDataFrame(data[part * 10 : part * 10 + 10], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={part}"))
    path = tmp_path / "ledger"
    q = streams.upkeep(streams.read_events(spark, str(tmp_path / "in" / "*"), schema, files=1), str(path), "partition_id", ["ts", "seq"], str(tmp_path / "cp"), merge_every=3).trigger(availableNow=True).start()
    q.awaitTermination(180)
    last = {}
    for row in sorted(data, key=lambda r: (r[2], r[3])):
        last[row[0]] = row[1]
    assert {r.partition_id: r.status for r in streams.current(spark, str(path)).collect()} == last
    names = sorted(p.name for p in path.iterdir() if "=" in p.name)
    assert names == [f"base={3:012d}", f"base={6:012d}", *(f"batch={i:012d}" for i in range(4, 9))]
    assert spark.read.parquet(str(path / f"batch={8:012d}")).count() <= 10
    assert streams.current(spark, str(tmp_path / "none")) is None


def test_liveness_of_a_stream(spark, tmp_path):
    """A worker is alive at its first beat and gone when event time has passed its last beat by the limit; a beat renews."""
    beats = [[("a", 0), ("b", 10)], [("a", 100), ("b", 60)], [("a", 350)], [("a", 351), ("c", 352)], [("c", 353)]]
    for i, part in enumerate(beats):
        spark.createDataFrame([(w, T0 + timedelta(seconds=s)) for w, s in part], "worker_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"d={i}"))
        os.utime(next((tmp_path / "in" / f"d={i}").glob("part-*")), (1000 + i, 1000 + i))
    stream = streams.read_events(spark, str(tmp_path / "in" / "*"), "worker_id string, ts timestamp", files=1)
    q = streams.liveness(stream, 180).writeStream.outputMode("append").format("memory").queryName("alive_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [(r.worker_id, r.alive) for r in spark.table("alive_out").collect()]
    assert sorted(got) == [("a", True), ("b", False), ("b", True), ("c", True)]


@pytest.mark.parametrize("n", [0, 3, 7, 30])
def test_pick_follows_the_policies(spark, n):
    """Ring from 20 pending ranges on, seeded shuffle from 5, in order below, then the oldest stale range of another worker."""
    now = F.lit(T0).cast("timestamp")
    day = timedelta(days=1)
    data = [(i, "pending", "", T0, T0) for i in range(1, n + 1)]
    data += [(100, "claimed", "w1", T0 - 3 * day, T0 - day), (101, "claimed", "w2", T0 - 2 * day, T0 - day), (102, "claimed", "w3", T0, T0), (103, "running", "w2", T0 - 9 * day, T0 - 8 * day), (104, "completed", "w2", T0 - 9 * day, T0 - 8 * day)]
    ledger = spark.createDataFrame(data, "partition_id long, status string, worker_id string, updated_at timestamp, last_heartbeat timestamp")
    names = spark.createDataFrame([(f"w{i}",) for i in (1, 2, 3)], "worker_id string")
    got = {r.worker_id: (r.policy, r.partition_id, r.outcome) for r in assign.pick(ledger, names, now, 3600).collect()}
    if n == 0:
        assert got == {"w1": ("claimed", 101, "acquired"), "w2": ("claimed", 100, "acquired"), "w3": ("claimed", 100, "conflict")}
        idle = assign.pick(ledger.filter("partition_id in (102, 103)"), names, now, 3600).collect()
        assert {r.worker_id: (r.policy, r.partition_id) for r in idle} == {"w1": ("running", 103), "w2": ("none", None), "w3": ("running", 103)}
        return
    pending = ledger.filter("status = 'pending'").select("partition_id")
    if n < 5:
        want = {w: ("direct", 1) for w in got}
    elif n < 20:
        want = {r.worker_id: ("random", r.tries[0]) for r in assign.trial_orders(names, pending).collect()}
    else:
        want = {r.worker_id: ("ring", r.p) for r in assign.prefer(pending, assign.ring(names)).groupBy("worker_id").agg(F.min("partition_id").alias("p")).collect()}
        assert len(want) == 3
    assert {w: v[:2] for w, v in got.items()} == want
    for w, (_, p, outcome) in got.items():
        assert outcome == ("acquired" if w == min(x for x in got if got[x][1] == p) else "conflict")


def test_metric_buckets():
    """Fixed values of the histograms."""
    assert metrics.ASSIGNMENT_BUCKETS == (0.001, 0.01, 0.1, 0.5, 1, 2, 5, 10) and metrics.TASK_BUCKETS == (*metrics.ASSIGNMENT_BUCKETS, 30, 60)


def test_metrics(spark):
    rng = random.Random(1)
    values = [rng.expovariate(1.0) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    h = rows(metrics.histogram(df, "v", metrics.TASK_BUCKETS))
    assert h == sorted((b, sum(v <= b for v in values)) for b in (*metrics.TASK_BUCKETS, math.inf))
    q = metrics.quantile(metrics.histogram(df, "v", metrics.TASK_BUCKETS), 0.95).first().value
    assert 1.0 < q <= 5.0
    assert metrics.quantile(metrics.histogram(df.withColumn("v", F.lit(1e9)), "v", (1.0, 2.0)), 0.5).first().value == 2.0


def test_processing(spark):
    ranges = spark.createDataFrame([(1, 1, 10, "w", None), (2, 11, 20, "w", {"x": "y"})], "partition_id long, min_id long, max_id long, worker_id string, options map<string,string>")
    items = spark.createDataFrame([(i % 15,) for i in range(60)], "k long")
    assert rows(process.count_items(ranges, items, "k", size=10).select("partition_id", "n_items")) == [(1, 40), (2, 16)]

    def work(low, high, options):
        if options["partition_id"] == 2:
            raise RuntimeError("no " + options["x"])
        return high - low

    assert rows(process.run_processor(ranges, work)) == [(1, "w", "completed", 9, None), (2, "w", "failed", 0, "no y")]


def test_slow_ranges_are_interrupted(spark):
    def work(low, high, options):
        time.sleep(30 if low > 10 else 0)
        return high - low

    ranges = spark.createDataFrame([(1, 1, 10, "w", None), (2, 11, 20, "w", None)], "partition_id long, min_id long, max_id long, worker_id string, options map<string,string>")
    start = time.time()
    assert rows(process.run_processor(ranges, work, seconds=0.5)) == [(1, "w", "completed", 9, None), (2, "w", "failed", 0, "timed out after 0.5 s")]
    assert time.time() - start < 25


def test_trial_orders_shuffle_all_pending_ids(spark):
    """More than 1,000 pending ids against a plain Fisher-Yates."""
    who = spark.createDataFrame([("worker-1",), ("worker-2",)], "worker_id string")
    seeds = {r[0]: r[1] for r in who.select("worker_id", fnv1a32(F.col("worker_id"))).collect()}
    for n, k in ((0, 0), (3, 3), (12, 6), (2500, 20)):
        want = {}
        for w, r in seeds.items():
            a = [3 * i for i in range(n)]
            for i in range(n - 1, 0, -1) if n > k else ():
                r = (r * 1103515245 + 12345) % (1 << 32)
                a[i], a[r % (i + 1)] = a[r % (i + 1)], a[i]
            want[w] = a[:k]
        pending = spark.range(n).select((F.col("id") * 3).alias("partition_id"))
        assert {r.worker_id: r.tries for r in assign.trial_orders(who, pending).collect()} == want


def test_streamed_failures_are_counted_exactly(spark, tmp_path):
    failed = [("worker-1", i % 3000, "failure", T0 + timedelta(seconds=i % 600)) for i in range(4000)] + [("worker-2", 1, "failure", T0), ("worker-2", 2, "attempt", T0)]
    schema = "worker_id string, partition_id long, kind string, ts timestamp"
    spark.createDataFrame(failed, schema).write.parquet(str(tmp_path / "in"))
    counts = streams.failed_in_window(streams.read_events(spark, str(tmp_path / "in"), schema), "1 hour", "1 hour", "1 minute")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("failed_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    assert rows(spark.table("failed_out").select("worker_id", "n_failed")) == [("worker-1", 3000), ("worker-2", 1)]
