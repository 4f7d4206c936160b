"""The ledger kept from streams: latest rows, counters, liveness, failure windows and the circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.breaker import OUT, Breaker
from ..operators.ledger import latest


def read_events(spark: SparkSession, folder: str, schema: str, *, files: int = 10) -> DataFrame:
    """A stream of event files; ``ts`` becomes a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def upkeep(events: DataFrame, path: str, key: str, order: list[str], checkpoint: str, *, merge_every: int = 20):
    """A running query that keeps ``path`` at the latest event per key.

    A micro-batch writes only its own latest rows, in a folder named by its number, so a batch run again writes the same.
    Every ``merge_every`` batches all rows are merged into a new base, and what the base before it made needless goes;
    ``current`` reads the newest base and the batches after it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            spark.createDataFrame([(key, ",".join(order))], "key string, ordering string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")
        if number and number % merge_every == 0:
            current(spark, path, upto=number).write.mode("overwrite").parquet(f"{path}/base={number:012d}")
            kept = [n for n, _ in _folders(spark, path, "base") if n < number]
            for kind in ("base", "batch") if kept else ():
                for n, old in _folders(spark, path, kind):
                    if n < kept[-1] or (kind == "batch" and n == kept[-1]):
                        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _folders(spark: SparkSession, path: str, kind: str) -> list[tuple[int, object]]:
    """The finished folders of a kind, by number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(((int(p.getName().partition("=")[2]), p) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), key=lambda x: x[0])


def current(spark: SparkSession, path: str, *, upto: int | None = None) -> DataFrame | None:
    """The latest row per key of what was written, up to the batch of a number if given; None if there is nothing."""
    bases = [x for x in _folders(spark, path, "base") if upto is None or x[0] < upto]
    after = bases[-1][0] if bases else -1
    parts = [*bases[-1:], *(x for x in _folders(spark, path, "batch") if x[0] > after and (upto is None or x[0] <= upto))]
    if not parts:
        return None
    key, order = spark.read.parquet(f"{path}/layout").first()
    frames = [spark.read.parquet(str(p.toString())) for _, p in parts]
    rows = frames[0]
    for other in frames[1:]:
        rows = rows.unionByName(other)
    return latest(rows, key, order.split(","))


def status_counts(events: DataFrame) -> DataFrame:
    """Running counts per status, for update or complete mode."""
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def failed_in_window(events: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """(window, worker_id, n_failed): partitions failed per sliding window, events later than ``late`` left out; exact, the state holds the distinct partitions of each open window and worker."""
    return events.filter("kind = 'failure'").withWatermark("ts", late).groupBy(F.window("ts", length, slide), "worker_id").agg(F.size(F.collect_set("partition_id")).cast("long").alias("n_failed"))


def liveness(beats: DataFrame, seconds: int = 180) -> DataFrame:
    """(worker_id, alive, at): true at a worker's first beat, false once none came for ``seconds`` of event time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], False, last + seconds)], columns=["worker_id", "alive", "at"])
            return
        fresh = not state.exists
        last = max([state.get[0] if state.exists else 0.0, *(f["ts"].max().timestamp() for f in frames)])
        state.update((last,))
        state.setTimeoutTimestamp(int(max(last + seconds, state.getCurrentWatermarkMs() / 1000 + 0.001) * 1000))
        if fresh:
            yield pd.DataFrame([(key[0], True, last)], columns=["worker_id", "alive", "at"])

    return beats.withWatermark("ts", "0 seconds").groupBy("worker_id").applyInPandasWithState(run, "worker_id string, alive boolean, at double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def breaker(events: DataFrame) -> DataFrame:
    """The circuit breaker's state after each event of a stream (ts in seconds), kept per worker between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker()
        if state.exists:
            b.state, b.consecutive, b.half_open, b.since, b.trips, ids, times = state.get
            b.failed = dict(zip(ids, times, strict=True))
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples(index=False):
            allowed = b.feed(r.kind, r.partition_id, r.ts)
            out.append((key[0], r.seq, r.kind, r.partition_id, allowed, b.state, b.consecutive, len(b.failed), b.trips))
        state.update((b.state, b.consecutive, b.half_open, b.since, b.trips, list(b.failed), list(b.failed.values())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    kept = "state string, consecutive int, half_open int, since double, trips int, ids array<long>, times array<double>"
    return events.groupBy("worker_id").applyInPandasWithState(run, OUT, kept, "append", GroupStateTimeout.NoTimeout)
