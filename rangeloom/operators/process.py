"""Work on the items of ranges."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items_in_ranges(ranges: DataFrame, items: DataFrame, key: str, *, size: int) -> DataFrame:
    """Items with the range (at most ``size`` wide) that holds their key: an equi-join on cells of that width, filtered to the bounds."""
    tiles = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("min_id") / size), F.floor(F.col("max_id") / size))))
    cells = items.withColumn("__cell", F.floor(F.col(key) / size))
    return cells.join(tiles, "__cell").filter(F.col(key).between(F.col("min_id"), F.col("max_id"))).drop("__cell")


def count_items(ranges: DataFrame, items: DataFrame, key: str, *, size: int) -> DataFrame:
    """``ranges`` with ``n_items``. Items are counted by key before they meet ranges, so a frequent key is one row."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    found = items_in_ranges(ranges, counts, key, size=size).groupBy("partition_id").agg(F.sum("__n").alias("n_items"))
    return ranges.join(found, "partition_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


class _Late(Exception):
    pass


def run_processor(ranges: DataFrame, process: Callable[[int, int, dict], int], *, seconds: float | None = None) -> DataFrame:
    """(partition_id, worker_id, status, n_items, error): what ``process(min_id, max_id, options)`` returned for each range, or its error.

    ``options`` always have partition_id and worker_id. A range that takes longer than ``seconds`` (half a lease, say) is
    interrupted and fails. ``transitions.release`` gives the ranges back.
    """

    def late(*_) -> None:
        raise _Late(f"timed out after {seconds:g} s")

    def limited(low: int, high: int, options: dict) -> int:
        if not seconds:
            return int(process(low, high, options))
        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return int(process(low, high, options))
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                options = dict(row.options or {}) | {"partition_id": row.partition_id, "worker_id": row.worker_id}
                try:
                    out.append((row.partition_id, row.worker_id, "completed", limited(row.min_id, row.max_id, options), None))
                except Exception as e:  # a user's code may raise anything; the range carries it
                    out.append((row.partition_id, row.worker_id, "failed", 0, str(e)))
            yield pd.DataFrame(out, columns=["partition_id", "worker_id", "status", "n_items", "error"])

    return ranges.select("partition_id", "min_id", "max_id", "worker_id", "options").mapInPandas(run, "partition_id long, worker_id string, status string, n_items long, error string")
