"""Planning of contiguous id ranges over a keyed table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_SIZE, look_ahead

BACK_PRESSURE = 1000
STEP = 1 << 16
#: How far to look where a source can't tell the size of its ranges.
FALLBACK_LOOK_AHEAD = 10_000


@dataclass(frozen=True)
class RangeSource:
    """A table whose ids are to be processed: the frame, its key and the size of a range (0: the default; None: unknown)."""

    frame: DataFrame
    key: str
    size: int | None = 0

    def ids(self) -> DataFrame:
        return self.frame.select(F.col(self.key).cast("long").alias("id")).na.drop().distinct()

    def partition_size(self) -> int:
        return self.size if self.size and self.size > 0 else DEFAULT_SIZE

    def next_max_id(self, start: int, count: int) -> DataFrame:
        """(next_max_id): the ``count``-th existing id above ``start``; the last one if there are fewer; ``start`` if none.

        The first ``count`` ids come from a distributed top-k, so only they meet in one task.
        """
        head = self.ids().filter(F.col("id") > start).orderBy("id").limit(count)
        return head.agg(F.coalesce(F.max("id"), F.lit(start)).cast("long").alias("next_max_id"))


def next_range(source: RangeSource, start: int, workers: int, multiple: int) -> DataFrame:
    """(next_max_id): the end of the next processing range: the source asked as far ahead as ranges, workers and the multiple say, or 10,000 ids where its size is unknown (None)."""
    if source.size is None:
        return source.next_max_id(start, FALLBACK_LOOK_AHEAD)
    sizes = source.frame.sparkSession.range(1).select(look_ahead(F.lit(source.partition_size()), F.lit(workers), F.lit(multiple)).alias("n"))
    return source.next_max_id(start, sizes.first()["n"])


def plan_ranges(bounds: DataFrame, size: int) -> DataFrame:
    """(partition_id, min_id, max_id) for each row (last_id, next_id, max_partition_id): tiles of ``size`` over last_id + 1 .. next_id, one at least, the last one ending at next_id.

    Tiles come in two steps, so that no array holds more than ``STEP`` of them or, on the first one, of such steps.
    """
    size = size if size > 0 else DEFAULT_SIZE
    n = F.greatest(F.lit(1).cast("long"), F.expr(f"(next_id - last_id + {size - 1}) div {size}"))
    rows = bounds.select("*", n.alias("n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STEP).cast("long"))).alias("low"))
    rows = rows.select("*", F.explode(F.sequence("low", F.least(F.col("low") + STEP, F.col("n")) - 1)).alias("i"))
    top = F.when(F.col("i") == F.col("n") - 1, F.col("next_id")).otherwise(F.col("last_id") + (F.col("i") + 1) * size)
    return rows.select((F.col("max_partition_id") + 1 + F.col("i")).alias("partition_id"), (F.col("last_id") + F.col("i") * size + 1).alias("min_id"), top.alias("max_id"))


def may_allocate(stats: DataFrame, threshold: int = BACK_PRESSURE) -> DataFrame:
    """(waiting, allocate): whether pending and claimed ranges leave room for new ones."""
    waiting = F.col("pending") + F.col("claimed")
    return stats.select(waiting.alias("waiting"), (waiting < threshold).alias("allocate"))


def allocate(spark: SparkSession, ledger: DataFrame, source: RangeSource, look: int, *, threshold: int = BACK_PRESSURE) -> DataFrame:
    """The ranges to create next: none under back-pressure, else a plan up to the next id, or gap fillers where nothing is left above."""
    from .gaps import gaps_adjacent, split_gaps
    from .ledger import stats

    empty = spark.createDataFrame([], "partition_id long, min_id long, max_id long")
    row = stats(ledger).first()
    if row["pending"] + row["claimed"] >= threshold:
        return empty
    last, pid, size = row["last_allocated_id"], row["max_partition_id"], source.partition_size()
    following = source.next_max_id(last, look).first()[0]
    if following > last:
        return plan_ranges(spark.createDataFrame([(last, following, pid)], "last_id long, next_id long, max_partition_id long"), size)
    return split_gaps(gaps_adjacent(ledger), source.frame, source.key, size=size, next_id=pid + 1)
