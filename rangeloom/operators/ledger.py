"""The ledger: one row per range, derived from a log of events, queried, counted and changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import STATUSES, rate

#: Above so many excluded ids an anti-join takes the place of NOT IN.
INLINE_IDS = 1000


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order of some columns. A max per key combines before the shuffle, so frequent keys cost no more."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")
    return events.groupBy(key).agg(last).select(key, "__last.*")


@dataclass(frozen=True)
class Filters:
    """A conjunction; what is None or empty doesn't filter. ``mode`` tells what a stale limit of 0 or less means: nothing passes ("hash") or it is ignored ("simple")."""

    statuses: tuple[str, ...] = ()
    stale_seconds: float | None = None
    exclude_worker: str = ""
    limit: int = 0
    exclude_ids: tuple[int, ...] = ()
    min_id: int | None = None
    max_id: int | None = None
    include_archived: bool = False
    mode: str = "hash"

    def predicate(self, now: Column) -> Column:
        keep = F.lit(True)
        if self.statuses:
            keep = keep & F.col("status").isin(*self.statuses)
        if self.stale_seconds is not None:
            if self.stale_seconds > 0:
                keep = keep & (F.col("updated_at") < now - F.expr(f"make_dt_interval(0, 0, 0, {self.stale_seconds})"))
                if self.exclude_worker:
                    keep = keep & (F.col("worker_id") != self.exclude_worker)
            elif self.mode == "hash":
                keep = F.lit(False)
        if self.min_id is not None:
            keep = keep & (F.col("partition_id") >= self.min_id)
        if self.max_id is not None:
            keep = keep & (F.col("partition_id") <= self.max_id)
        return keep


def query(active: DataFrame, filters: Filters, now: Column, archive: DataFrame | None = None) -> DataFrame:
    """Rows that pass ``filters``; with a limit, those of smallest partition id."""
    rows = active.unionByName(archive) if filters.include_archived and filters.mode == "hash" and archive is not None else active
    rows = rows.filter(filters.predicate(now))
    if len(filters.exclude_ids) > INLINE_IDS:
        ids = rows.sparkSession.createDataFrame([(i,) for i in filters.exclude_ids], "partition_id long")
        rows = rows.join(ids, "partition_id", "left_anti")
    elif filters.exclude_ids:
        rows = rows.filter(~F.col("partition_id").isin(*filters.exclude_ids))
    return rows.orderBy("partition_id").limit(filters.limit) if filters.limit > 0 else rows


def lookup(tiers: list[DataFrame], ids: list[int]) -> DataFrame:
    """Rows of some ids from the first tier that has them."""
    found = [t.filter(F.col("partition_id").isin(*[i for i in ids if i > 0])).withColumn("tier", F.lit(n)) for n, t in enumerate(tiers)]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    rest = [c for c in rows.columns if c not in ("partition_id", "tier")]
    return rows.groupBy("partition_id").agg(F.min_by(F.struct(*rest), "tier").alias("row"), F.min("tier").alias("tier")).select("partition_id", "row.*", "tier")


def stats(rows: DataFrame) -> DataFrame:
    """One row: counts by status, rates, largest partition and data ids; unknown statuses count in the total only, no rows give zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], zero(F.max("partition_id")).alias("max_partition_id"), zero(F.max("max_id")).alias("last_allocated_id"))
    return out.withColumns({"completion_rate": rate(F.col("completed"), F.col("total")), "failure_rate": rate(F.col("failed"), F.col("total"))})


def stats_deltas(transitions: DataFrame) -> DataFrame:
    """(status, n) from transitions (old_status null for new rows, new_status null for deleted ones): counters kept by +1 and -1."""
    up = transitions.filter("new_status is not null").select(F.col("new_status").alias("status"), F.lit(1).alias("d"))
    down = transitions.filter("old_status is not null").select(F.col("old_status").alias("status"), F.lit(-1).alias("d"))
    return up.unionByName(down).groupBy("status").agg(F.sum("d").alias("n"))


def metadata_counts(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows per group with how many completed and failed: the range, worker and hour layers."""
    return rows.groupBy(by.alias(name)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def worker_speed(events: DataFrame) -> DataFrame:
    """(worker_id, items, seconds, per_second, success) of finished work (worker_id, items, seconds, ok)."""
    out = events.groupBy("worker_id").agg(F.sum("items").alias("items"), F.sum("seconds").alias("seconds"), (F.count_if("ok") / F.count(F.lit(1))).alias("success"))
    return out.select("worker_id", "items", "seconds", F.when(F.col("seconds") > 0, F.col("items") / F.col("seconds")).alias("per_second"), "success")


def holder_at(events: DataFrame, times: DataFrame, key: str, owner: str) -> DataFrame:
    """``times`` (key, ts ...) with ``owner``: who held a key at a time by its log (key, owner, ts, seq), null before the first holder; a change counts from its own time on."""
    by = Window.partitionBy(key).orderBy("ts", "__turn", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in times.columns if c not in (key, "ts")]
    log = events.select(key, "ts", F.lit(0).alias("__turn"), F.col("seq").cast("long").alias("__seq"), F.struct(F.col(owner).alias("o")).alias("__o"), *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in rest])
    asked = times.select(key, "ts", F.lit(1).alias("__turn"), F.lit(0).cast("long").alias("__seq"), F.lit(None).cast(log.schema["__o"].dataType).alias("__o"), *rest)
    return log.unionByName(asked).withColumn("__held", F.last("__o", ignorenulls=True).over(by)).filter("__turn = 1").select(key, "ts", *rest, F.col("__held.o").alias(owner))


def owner_spans(events: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner, since, until): who held a key from when to when (null: still), from a log (ts, seq) of its holders.

    A key's log is ordered in one window; keys are locks or ranges, each with its own short log.
    """
    by = Window.partitionBy(key).orderBy("ts", "seq")
    changes = events.withColumn("__before", F.lag(owner).over(by)).filter(~F.col(owner).eqNullSafe(F.col("__before")))
    return changes.select(key, owner, F.col("ts").alias("since"), F.lead("ts").over(by).alias("until"))
