"""Filters, statistics, transitions, archive."""

import os
from collections import namedtuple
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rangeloom.operators import archive, ledger, transitions
from rangeloom.plans import catalogue
from rangeloom.sources import tables

DATA = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 31)
SCHEMA = "partition_id long, min_id long, max_id long, worker_id string, last_heartbeat timestamp_ntz, status string, updated_at timestamp_ntz, version long, error string, created_at timestamp_ntz"


def now():
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")


def frame(spark, items):
    """items: (id, status, worker, age in seconds)"""
    data = [(i, i * 100 + 1, i * 100 + 100, w, T0 - timedelta(seconds=age), s, T0 - timedelta(seconds=age), 1, None, T0 - timedelta(days=1)) for i, s, w, age in items]
    return spark.createDataFrame(data, SCHEMA)


ITEMS = [(1, "pending", "", 0), (2, "running", "worker1", 600), (3, "completed", "worker2", 0), (4, "running", "worker2", 900)]


def ids(df):
    return [r.partition_id for r in df.orderBy("partition_id").collect()]


@pytest.mark.parametrize(
    "options, want",
    [
        ({"statuses": ("pending", "running")}, [1, 2, 4]), ({"stale_seconds": 300}, [2, 4]), ({"stale_seconds": 300, "exclude_worker": "worker2"}, [2]),
        ({"statuses": ("running",), "stale_seconds": 300, "exclude_worker": "worker2"}, [2]), ({}, [1, 2, 3, 4]), ({"statuses": ("nonexistent",)}, []), ({"stale_seconds": 0}, []),
        ({"stale_seconds": -3600}, []), ({"stale_seconds": 3.6e6}, []), ({"stale_seconds": 0, "mode": "simple"}, [1, 2, 3, 4]), ({"min_id": 2, "max_id": 3}, [2, 3]),
        ({"exclude_ids": (1, 3)}, [2, 4]), ({"limit": 2}, [1, 2]), ({"exclude_ids": tuple(range(3, 5000))}, [1, 2]),
    ],
)
def test_filters(spark, options, want):
    assert ids(ledger.query(frame(spark, ITEMS), ledger.Filters(**options), now())) == want


def test_stats(spark):
    active = spark.createDataFrame([(1001, "pending", 5000), (1002, "claimed", 10000), (1003, "running", 15000)], "partition_id long, status string, max_id long")
    done = spark.createDataFrame([(2001, "completed", 20000), (2002, "failed", 25000)], "partition_id long, status string, max_id long")
    s = ledger.stats(active.unionByName(done)).first()
    assert (s.total, s.pending, s.claimed, s.running, s.completed, s.failed, s.max_partition_id, s.last_allocated_id) == (5, 1, 1, 1, 1, 1, 2002, 25000)
    assert ledger.stats(active.limit(0)).first().completion_rate == 0.0
    odd = spark.createDataFrame([(1, "odd", 5)], "partition_id long, status string, max_id long")
    assert (ledger.stats(odd).first().total, ledger.stats(odd).first().pending) == (1, 0)


def test_lookup_prefers_the_active_tier(spark):
    a, b = frame(spark, [(1, "running", "w", 0)]), frame(spark, [(1, "completed", "w", 0), (2, "completed", "w", 0)])
    assert rows(ledger.lookup([a, b], [1, 2, 3, -1]).select("partition_id", "status", "tier")) == [(1, "running", 0), (2, "completed", 1)]


def test_acquire_has_one_winner(spark):
    requests = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "worker1"), (4, 4, "c"), (5, 3, "c"), (6, 9, "c")], "request_id long, partition_id long, worker_id string")
    got = {r.request_id: r.outcome for r in transitions.acquire(frame(spark, ITEMS), requests, now()).collect()}
    assert got == {1: "claimed", 2: "denied", 3: "renewed", 4: "preempted", 5: "denied", 6: "denied"}
    got = {r.request_id: r.outcome for r in transitions.acquire(frame(spark, ITEMS), requests, now(), preempt=False).collect()}
    assert got[4] == "denied"


def test_release_modes(spark):
    items = [(1, "running", "w", 0), (2, "failed", "w", 0), (3, "completed", "w", 0)]
    requests = spark.createDataFrame([(1, "w"), (2, "w"), (3, "w"), (1, "x")], "partition_id long, worker_id string")
    hash_, simple = ({r.partition_id: (r.status, r.worker_id) for r in transitions.release(frame(spark, items), requests, mode=m).collect()} for m in ("hash", "simple"))
    assert hash_ == {1: ("pending", ""), 2: ("failed", "w"), 3: ("completed", "w")}
    assert simple[2] == ("failed", "")


def test_create_modes(spark):
    old = frame(spark, [(1, "pending", "", 0), (2, "pending", "", 0)])
    wanted = spark.createDataFrame([(1, 101, 200), (2, 201, 999), (3, 301, 400)], "partition_id long, min_id long, max_id long")
    assert rows(transitions.create_if_absent(old, wanted).select("partition_id", "outcome")) == [(1, "exists"), (2, "conflict"), (3, "created")]
    assert rows(transitions.create_if_absent(old, wanted, mode="simple").select("partition_id", "min_id", "outcome")) == [(1, 101, "exists"), (3, 301, "created"), (4, 201, "created")]


def test_retry_needs_positive_ids(spark):
    rows_ = frame(spark, [(1, "failed", "w", 0), (2, "failed", "w", 0)])
    assert ids(transitions.retry_failed(rows_, [2])) == [2]
    assert ids(transitions.retry_failed(rows_)) == [1, 2]
    with pytest.raises(ValueError):
        transitions.retry_failed(rows_, [0])


def test_compression_plan(spark):
    done = spark.range(1, 161).toDF("partition_id")
    plan = archive.compression_plan(done, threshold=100, batch=50)
    assert plan.groupBy("batch_no").count().orderBy("batch_no").collect() == [(1, 50), (2, 50)]
    s = archive.archive_stats(done, plan, batch=50).first()
    assert tuple(s) == (60, 2, 100, 160, True)
    assert archive.compression_plan(done, threshold=160, batch=50).count() == 0


def test_codec_round_trip(spark):
    rows_ = frame(spark, [(i, s, w, i) for i, (s, w) in enumerate([("completed", "a"), ("failed", "b"), ("running", ""), ("completed", "gone")], 1)])
    rows_ = rows_.withColumn("error", F.when(F.col("status") == "failed", "été"))
    codes = spark.createDataFrame([("a", 1), ("b", 2)], "worker_id string, code long")
    every = codes.unionByName(spark.createDataFrame([("gone", 9)], "worker_id string, code long"))
    blobs = archive.compress(rows_, rows_.select("partition_id", F.lit(1).alias("batch_no")), every)
    got = rows(archive.decompress(blobs, codes).select("partition_id", "min_id", "max_id", "worker_id", "status", "error"))
    assert got[:3] == [(1, 101, 200, "a", "completed", None), (2, 201, 300, "b", "failed", "été"), (3, 301, 400, "", "running", None)]
    assert got[3][3] == "unknown_worker_9"
    with pytest.raises(Exception, match="worker without a code: gone"):
        archive.compress(rows_, rows_.select("partition_id", F.lit(1).alias("batch_no")), codes).collect()
    broken = blobs.withColumn("compressed_data", F.lit(b"nothing"))
    with pytest.raises(Exception, match="batch 1 can't be read"):
        archive.decompress(broken, codes).collect()
    assert archive.decompress(broken, codes, skip_unreadable=True).count() == 0
    assert [tuple(r) for r in archive.integrity(broken.unionByName(blobs)).collect()] == [(1, 4, 0, False, "unreadable"), (1, 4, 4, True, None)]
    assert rows(archive.search(blobs, [2, 4, 77], codes).select("partition_id")) == [(2,), (4,)]
    assert archive.search(blobs, [5, 0], codes).count() == archive.search(broken, [2], codes).count() == 0


Row = namedtuple("Row", "partition_id min_id max_id code status_code updated created error")


def test_codec_bytes():
    """Golden bytes: little-endian, the width counts both ends."""
    row = Row(4970, 4969001, 4970000, 3, 3, 1800, 0, "né")
    golden = bytes.fromhex("6a130000" "29d24b0000000000" "e8030000" "0300" "03" "08070000" "00000000" "0300" "6ec3a9")
    assert archive.encode_row(row) == golden and len(golden) == 29 + 3
    assert archive.decode_rows(golden * 2) == [(4970, 4969001, 4970000, 3, "completed", 1800, 0, "né")] * 2
    assert archive.decode_rows(archive.encode_row(row._replace(error=None, code=65535, max_id=4969001))) == [(4970, 4969001, 4969001, 65535, "completed", 1800, 0, None)]
    for wrong in ({"partition_id": 2**32 + 5}, {"code": 70000}, {"code": -1}, {"max_id": 2**33 + 4969001}, {"max_id": 4968000}, {"min_id": -1}):
        with pytest.raises(ValueError, match="doesn't fit"):
            archive.encode_row(row._replace(**wrong))
    for cut in (golden[:-1], golden[:10]):
        with pytest.raises(archive._UNREADABLE):
            archive.decode_rows(cut)


def test_json_scan_leaves_bad_rows_out(spark):
    lines = tables.to_json(frame(spark, ITEMS)).unionByName(spark.createDataFrame([("{oops",), (None,)], "value string"))
    assert ids(tables.ledger_from_json(lines)) == [1, 2, 3, 4]
    one = spark.createDataFrame([('{"7": {"partition_id": 7, "status": "pending"}, "8": {"partition_id": 8}}',)], "value string")
    assert ids(tables.ledger_from_json_map(one)) == [7, 8]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows_ = frame(spark, ITEMS)
    tables.append(rows_, path)
    tables.insert_new(spark, frame(spark, [(4, "pending", "", 0), (5, "pending", "", 0)]), path)
    assert ids(spark.read.parquet(path)) == [1, 2, 3, 4, 5]
    done = rows_.filter("status = 'completed'").withColumn("options", F.lit(None).cast("map<string,string>"))
    tables.archive(done, str(tmp_path / "archive"))
    tables.archive(done, str(tmp_path / "archive"), "compressed")
    assert tables.read_archive(spark, str(tmp_path / "archive")).count() == 2
    assert tables.read_archive(spark, str(tmp_path / "archive"), "compressed").count() == 1
    keys = spark.createDataFrame([("p:a_1",), ("p:ab1",), ("q:a_1",)], "key string")
    assert rows(tables.keys_like(keys, "a_?", "p:")) == [("a_1",)]
    assert tables.queue_head(spark.createDataFrame([("x", 2.0), ("y", 1.0)], "item string, score double"), 1).first().item == "y"
    assert tables.queue_head(keys.withColumn("score", F.lit(1)), 0, tie="key").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_order_and_customer_asks(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    made = catalogue.create_every_order_hash(spark, DATA)
    assert rows(made.select("partition_id")) == rows(read("orders").select("o_orderkey"))
    asked = catalogue.acquire_every_customer(spark, DATA)
    assert rows(asked.select("request_id")) == rows(read("customer").select("c_custkey"))
    assert {r[0] for r in asked.select("partition_id").collect()} >= {r[0] for r in read("events").select("user_id").collect()}


def test_long_errors_keep_their_batch(spark):
    rows_ = frame(spark, [(1, "failed", "a", 1), (2, "failed", "a", 2)])
    rows_ = rows_.withColumn("error", F.when(F.col("partition_id") == 1, F.concat(F.lit("x"), F.repeat(F.lit("日"), 30000))).otherwise("short"))
    codes = spark.createDataFrame([("a", 1)], "worker_id string, code long")
    blobs = archive.compress(rows_, rows_.select("partition_id", F.lit(1).alias("batch_no")), codes)
    assert rows(archive.decompress(blobs, codes).select("partition_id", "error")) == [(1, "x" + "日" * 21844), (2, "short")]
