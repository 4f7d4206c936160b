"""Changes of ledger rows as functions of frames: what the rows are afterwards, or what becomes of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import merge_options
from .assign import preemptable
from .neighbours import ordinal

ACTIVE = ("claimed", "running")


def create_if_absent(ledger: DataFrame, requests: DataFrame, *, mode: str = "hash") -> DataFrame:
    """(partition_id, min_id, max_id, outcome) per request: "created", "exists" (same bounds) or, for other bounds, "conflict" ("hash") or a new id after the largest ("simple")."""
    old = ledger.select("partition_id", F.col("min_id").alias("old_min"), F.col("max_id").alias("old_max"))
    rows = requests.select("partition_id", "min_id", "max_id").join(old, "partition_id", "left")
    same = (F.col("old_min") == F.col("min_id")) & (F.col("old_max") == F.col("max_id"))
    rows = rows.select("partition_id", "min_id", "max_id", F.when(F.col("old_min").isNull(), "created").when(same, "exists").otherwise("conflict").alias("outcome"))
    if mode == "hash":
        return rows
    top = ledger.select("partition_id").unionByName(requests.select("partition_id")).agg(F.coalesce(F.max("partition_id"), F.lit(0))).first()[0]
    moved = ordinal(rows.filter("outcome = 'conflict'").drop("outcome").withColumnRenamed("partition_id", "asked_id"), "asked_id", "partition_id", first=top + 1)
    return rows.filter("outcome <> 'conflict'").unionByName(moved.select("partition_id", "min_id", "max_id", F.lit("created").alias("outcome")))


def batches(rows: DataFrame, size: int = 50) -> DataFrame:
    """Rows with ``batch_no`` from 1, in the order of partition ids."""
    placed = ordinal(rows, "partition_id", "__place")
    return placed.withColumn("batch_no", F.expr(f"(__place + {size - 1}) div {size}")).drop("__place")


def acquire(ledger: DataFrame, requests: DataFrame, now: Column, *, preempt: bool = True, force: bool = False) -> DataFrame:
    """(request_id, partition_id, worker_id, outcome) for requests (request_id, partition_id, worker_id): renewed, claimed, preempted or denied; one new owner per range, the smallest request first."""
    state = ledger.select("partition_id", F.col("worker_id").alias("owner"), "status", "last_heartbeat")
    rows = requests.join(state, "partition_id", "left")
    mine = (F.col("owner") == F.col("worker_id")) & F.col("status").isin(*ACTIVE)
    free = (F.col("status") == "pending") & (F.col("owner") == "")
    stale = (preemptable(now) if preempt else F.lit(False)) | F.lit(force)
    want = F.when(mine, "renewed").when(free, "claimed").when(stale & F.col("status").isNotNull(), "preempted").otherwise("denied")
    rows = rows.withColumn("want", F.coalesce(want, F.lit("denied")))
    winners = rows.filter("want in ('claimed', 'preempted')").groupBy("partition_id").agg(F.min("request_id").alias("winner"))
    rows = rows.join(winners, "partition_id", "left")
    outcome = F.when(F.col("want").isin("claimed", "preempted") & (F.col("request_id") != F.col("winner")), "denied").otherwise(F.col("want"))
    return rows.select("request_id", "partition_id", "worker_id", outcome.alias("outcome"))


def release(ledger: DataFrame, requests: DataFrame, *, mode: str = "hash") -> DataFrame:
    """Rows that owners (partition_id, worker_id) release: completed ones stay, failed ones keep their status and, in "hash" mode, their owner; others become pending."""
    rows = ledger.join(requests.select("partition_id", F.col("worker_id").alias("asker")), "partition_id").filter("asker = worker_id")
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    owner = F.when(done | (failed if mode == "hash" else F.lit(False)), F.col("worker_id")).otherwise(F.lit(""))
    return rows.select("partition_id", F.when(done | failed, F.col("status")).otherwise("pending").alias("status"), owner.alias("worker_id"), F.when(done, F.col("last_heartbeat")).alias("last_heartbeat"))


def retry_failed(ledger: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Failed rows (of some ids, which must be positive, or all) as pending ones without owner or error."""
    if ids and min(ids) <= 0:
        raise ValueError("partition ids must be positive")
    rows = ledger.filter("status = 'failed'")
    rows = rows.filter(F.col("partition_id").isin(*ids)) if ids else rows
    return rows.withColumns({"status": F.lit("pending"), "worker_id": F.lit(""), "error": F.lit(None).cast("string"), "version": F.col("version") + 1})


def compare_and_set(current: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """(partition_id, outcome, version) of updates (partition_id, expected, status, worker_id): absent and 0 expected creates, an equal version is replaced by the next, else "stale"."""
    rows = updates.join(current.select("partition_id", F.col("version").alias("have")), "partition_id", "left")
    outcome = F.when(F.col("have").isNull() & (F.col("expected") == 0), "created").when(F.col("have") == F.col("expected"), "updated").otherwise("stale")
    return rows.select("partition_id", outcome.alias("outcome"), F.when(outcome != "stale", F.col("expected") + 1).otherwise(F.col("have")).alias("version"))


def apply_updates(current: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """The ledger after versioned updates (partition_id, expected, status, error, options) of existing rows: those of a matching version take effect."""
    u = updates.select("partition_id", *[F.col(c).alias(f"__{c}") for c in ("expected", "status", "error", "options")])
    rows = current.join(u, "partition_id", "left")
    hit = F.coalesce(F.col("__expected") == F.col("version"), F.lit(False))
    return rows.withColumns(
        {
            "status": F.when(hit, F.col("__status")).otherwise(F.col("status")),
            "error": F.when(hit & (F.col("__status") == "failed"), F.col("__error")).otherwise(F.col("error")),
            "options": F.when(hit, merge_options(F.col("options"), F.col("__options"))).otherwise(F.col("options")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
            "last_heartbeat": F.when(hit & F.col("__status").isin(*ACTIVE), now).otherwise(F.col("last_heartbeat")),
            "version": F.col("version") + hit.cast("long"),
        }
    ).select(*current.columns)


def update_status(active: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, archived, outcomes) after owners' requests (partition_id, worker_id, status, options), one per range.

    Only the owner may change a status: outcomes are "updated", "archived" (completed ranges leave the active tier with
    their version as it was; the archive is to be written before the active tier), "denied" or "missing". A failed range
    takes its error from the options, an active status renews the heartbeat, options are merged.
    """
    asked = requests.select("partition_id", *[F.col(c).alias(f"__{c}") for c in ("worker_id", "status", "options")])
    rows = active.join(asked, "partition_id", "left")
    hit = F.coalesce((F.col("__worker_id") == F.col("worker_id")) & (F.col("__worker_id") != ""), F.lit(False))
    done = hit & (F.col("__status") == "completed")
    rows = rows.select(
        "partition_id", hit.alias("__hit"), done.alias("__done"),
        *[
            {
                "status": F.when(hit, F.col("__status")).otherwise(F.col("status")),
                "error": F.when(hit & (F.col("__status") == "failed"), F.coalesce(F.try_element_at("__options", F.lit("error")), "error")).otherwise(F.col("error")),
                "options": F.when(hit, merge_options(F.col("options"), F.col("__options"))).otherwise(F.col("options")),
                "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
                "last_heartbeat": F.when(hit & F.col("__status").isin(*ACTIVE), now).otherwise(F.col("last_heartbeat")),
                "version": F.col("version") + (hit & ~done).cast("long"),
            }.get(c, F.col(c)).alias(c)
            for c in active.columns if c != "partition_id"
        ],
    )
    state = active.select("partition_id", F.col("worker_id").alias("owner"))
    known = requests.join(state, "partition_id", "left")
    outcome = F.when(F.col("owner").isNull(), "missing").when((F.col("owner") != F.col("worker_id")) | (F.col("worker_id") == ""), "denied").when(F.col("status") == "completed", "archived").otherwise("updated")
    return rows.filter(~F.col("__done")).select(*active.columns), rows.filter("__done").select(*active.columns), known.select("partition_id", "worker_id", outcome.alias("outcome"))


def maintain(ledger: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """(partition_id, worker_id, outcome, last_heartbeat, version) of requests (partition_id, worker_id) to keep a range: "renewed" with a new heartbeat and version, "idle" where the range is not claimed or running, "denied" to others than its owner, "missing"."""
    state = ledger.select("partition_id", F.col("worker_id").alias("owner"), "status", "last_heartbeat", "version")
    rows = requests.select("partition_id", "worker_id").join(state, "partition_id", "left")
    outcome = F.when(F.col("owner").isNull(), "missing").when((F.col("owner") != F.col("worker_id")) | (F.col("worker_id") == ""), "denied").when(F.col("status").isin(*ACTIVE), "renewed").otherwise("idle")
    renewed = outcome == "renewed"
    return rows.select("partition_id", "worker_id", outcome.alias("outcome"), F.when(renewed, now).otherwise(F.col("last_heartbeat")).alias("last_heartbeat"), (F.col("version") + renewed.cast("long")).alias("version"))


_SAVED = ("min_id", "max_id", "worker_id", "last_heartbeat", "status", "updated_at", "version", "error", "created_at")


def update(current: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """(partition_id, outcome and the row afterwards) of whole-row updates, one per range, each with its ``mode``.

    "force" saves the row as given ("saved"; version 0 becomes 1, missing times are ``now``). "expected" and "auto" replace a row
    of the version given in ``expected`` or in the row itself, "upsert" one of any version ("updated": version + 1, times renewed); a
    range that doesn't exist is created pending without owner by "upsert" and by "expected" of 0 ("created"). All else is "stale" or, without a row,
    "missing" and leaves what there is.
    """
    have = current.select("partition_id", *[F.col(c).alias(f"__{c}") for c in _SAVED])
    rows = updates.join(have, "partition_id", "left")
    known, mode = F.col("__version").isNotNull(), F.col("mode")
    given = F.when(mode == "expected", F.col("expected")).when(mode == "upsert", F.col("__version")).otherwise(F.col("version"))
    creates = ~known & ((mode == "upsert") | ((mode == "expected") & (F.col("expected") == 0)))
    outcome = F.when(mode == "force", "saved").when(creates, "created").when(~known, "missing").when(given == F.col("__version"), "updated").otherwise("stale")
    rows = rows.withColumn("outcome", outcome)

    def after(name: str) -> Column:
        new, old = F.col(name), F.col(f"__{name}")
        created = {"worker_id": F.lit(""), "last_heartbeat": F.lit(None), "status": F.lit("pending"), "updated_at": now, "version": F.lit(1), "error": F.lit(None), "created_at": now}.get(name, new)
        saved = {"updated_at": F.coalesce("updated_at", now), "created_at": F.coalesce("created_at", "updated_at", now), "version": F.when(F.col("version") == 0, 1).otherwise(F.col("version"))}.get(name, new)
        updated = {"updated_at": now, "last_heartbeat": F.when(F.col("status").isin(*ACTIVE), now).otherwise(new), "version": old + 1}.get(name, new)
        return F.when(F.col("outcome") == "saved", saved).when(F.col("outcome") == "created", created).when(F.col("outcome") == "updated", updated).otherwise(old).cast(current.schema[name].dataType).alias(name)

    return rows.select("partition_id", "outcome", *[after(c) for c in _SAVED])


def save(current: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """The ledger after rows were saved over it, whatever their versions."""
    saved = update(current, rows.select("partition_id", *_SAVED, F.lit("force").alias("mode"), F.lit(0).alias("expected")), now).select("partition_id", *_SAVED)
    return current.select("partition_id", *_SAVED).join(saved.select("partition_id"), "partition_id", "left_anti").unionByName(saved)


def delete(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    return ledger.join(ids.select("partition_id"), "partition_id", "left_anti")
