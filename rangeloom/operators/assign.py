"""Who takes which range: consistent hashing, reclaim of stale leases, seeded trial orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import SPAN, fnv1a32, hash32, shuffle_places, try_count
from .neighbours import ordinal

VIRTUAL = 50
RING_POLICY, RANDOM_POLICY = 20, 5
#: Slots of the hash space up to which the ring's slot table is broadcast.
BROADCAST_SLOTS = 1 << 18


def ring(workers: DataFrame, virtual: int = VIRTUAL) -> DataFrame:
    """(h, worker_id): ``virtual`` x 2 points per worker on the circle of unsigned 32-bit hashes."""
    points = workers.select("worker_id", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    points = points.select("worker_id", F.explode(F.array(F.concat_ws(":", "worker_id", F.col("i").cast("string")), F.concat_ws(":", F.col("i").cast("string"), "worker_id"))).alias("key"))
    return points.select(hash32(F.col("key")).alias("h"), "worker_id").groupBy("h").agg(F.max("worker_id").alias("worker_id"))


def prefer(parts: DataFrame, points: DataFrame, *, id_col: str = "partition_id") -> DataFrame:
    """``parts`` with ``worker_id``: that of the first ring point at or after the hash of the id, around the end to the first.

    The circle is cut in slots; each slot knows its points and the first point behind it, so the lookup is an equi-join on
    the slot, whatever the numbers of ranges and points. No points: null.
    """
    n = max(1, points.count())
    slots = 1 << max(1, (n - 1).bit_length())
    width = SPAN // slots
    held = points.groupBy(F.floor(F.col("h") / width).alias("slot")).agg(F.sort_array(F.collect_list(F.struct("h", "worker_id"))).alias("points"))
    table = points.sparkSession.range(slots).withColumnRenamed("id", "slot").join(held, "slot", "left")
    # Slots are as many as ring points, the window runs over them alone.
    behind = F.last(F.get("points", F.lit(0)), ignorenulls=True).over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1))
    around = F.last(F.get("points", F.lit(0)), ignorenulls=True).over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = table.select("slot", "points", behind["worker_id"].alias("behind"), around["worker_id"].alias("around"))
    if slots <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    given = parts.withColumn("__h", hash32(F.col(id_col).cast("string")))
    given = given.withColumn("slot", F.floor(F.col("__h") / width)).join(table, "slot")
    inside = F.get(F.filter("points", lambda p: p["h"] >= F.col("__h")), F.lit(0))["worker_id"]
    return given.select(*[c for c in parts.columns if c != "worker_id"], F.coalesce(inside, "behind", "around").alias("worker_id"))


def distribution(workers: DataFrame, assigned: DataFrame) -> DataFrame:
    """(worker_id, n): ranges per worker, workers without any included."""
    counts = assigned.groupBy("worker_id").agg(F.count(F.lit(1)).alias("n"))
    return workers.join(counts, "worker_id", "left").select("worker_id", F.coalesce("n", F.lit(0)).alias("n"))


def quality(counts: DataFrame) -> DataFrame:
    """(worker_count, total, variance, score): population variance of the counts, score 100 * exp(-deviation / mean) within 0 to 100."""
    out = counts.agg(F.count(F.lit(1)).alias("worker_count"), F.sum("n").alias("total"), F.var_pop("n").alias("variance"), F.avg("n").alias("mean"))
    score = F.when(F.col("variance") == 0, F.lit(100.0)).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * F.exp(-F.sqrt("variance") / F.col("mean")))))
    return out.select("worker_count", "total", "variance", score.alias("score"))


def moved(before: DataFrame, after: DataFrame, id_col: str = "partition_id") -> DataFrame:
    """Ranges that two assignments give to different workers."""
    old, new = before.select(id_col, F.col("worker_id").alias("old_worker")), after.select(id_col, F.col("worker_id").alias("new_worker"))
    return old.join(new, id_col).filter("old_worker <> new_worker")


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): "added" or "removed"."""
    added, gone = new.select(key).join(old, key, "left_anti"), old.select(key).join(new, key, "left_anti")
    return added.withColumn("change", F.lit("added")).unionByName(gone.withColumn("change", F.lit("removed")))


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(same): whether two tables hold the same keys."""
    return set_changes(a.select(key).distinct(), b.select(key).distinct(), key).agg((F.count(F.lit(1)) == 0).alias("same"))


def alive(beats: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """(worker_id, last_beat) of workers heard of less than ``seconds`` ago."""
    return beats.groupBy("worker_id").agg(F.max("ts").alias("last_beat")).filter(F.col("last_beat") > now - F.expr(f"make_dt_interval(0, 0, 0, {seconds})"))


def _ago(now: Column, seconds: float) -> Column:
    return now - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")


def reclaimable(me: str, now: Column, expiry: float) -> Column:
    """Claimed ranges of others without an update for twice the expiry, running ones without a heartbeat for five times."""
    other = F.col("worker_id") != me
    claimed = (F.col("status") == "claimed") & (F.col("updated_at") < _ago(now, 2 * expiry)) & other
    going = (F.col("status") == "running") & (F.col("last_heartbeat") < _ago(now, 5 * expiry)) & other
    return F.coalesce(claimed | going, F.lit(False))


def preemptable(now: Column, seconds: float = 300) -> Column:
    return F.coalesce(F.col("status").isin("claimed", "running") & (F.col("last_heartbeat") < _ago(now, seconds)), F.lit(False))


def oldest_reclaim(ledger: DataFrame, me: str, now: Column, expiry: float) -> DataFrame:
    """(status, partition_id): the reclaimable range to try first of each status, oldest update or heartbeat first."""
    rows = ledger.filter(reclaimable(me, now, expiry))
    since = F.when(F.col("status") == "claimed", F.col("updated_at")).otherwise(F.col("last_heartbeat"))
    return rows.groupBy("status").agg(F.min_by("partition_id", F.struct(since, "partition_id")).alias("partition_id"))


def policy(pending: Column, has_ring: Column) -> Column:
    return F.when((pending >= RING_POLICY) & has_ring, F.lit("ring")).when(pending >= RANDOM_POLICY, F.lit("random")).otherwise(F.lit("direct"))


def pick(ledger: DataFrame, workers: DataFrame, now: Column, expiry: float) -> DataFrame:
    """(worker_id, policy, partition_id, outcome): the range that each worker takes, all asking at once.

    Pending ranges come first: from 20 on the smallest one that the ring gives to the worker, else, from 5 on, the first of
    its seeded shuffle, else the smallest. Without pending ranges it is the reclaimable claimed range of the oldest update,
    then the running one of the oldest heartbeat, if its heartbeat is stale enough to be taken from its owner. What several
    workers want goes to the one of smallest name ("acquired"); the others have a "conflict" and ask again. "none": nothing
    to take.
    """
    names = workers.select("worker_id").distinct()
    pending = ledger.filter("status = 'pending' and worker_id = ''").select("partition_id")
    n = pending.count()
    shuffled = trial_orders(names, pending).select("worker_id", F.lit("random").alias("policy"), F.get("tries", F.lit(0)).alias("partition_id")) if n >= RANDOM_POLICY else None
    if n >= RING_POLICY:
        preferred = prefer(pending, ring(names)).groupBy("worker_id").agg(F.min("partition_id").alias("own"))
        wanted = shuffled.join(preferred, "worker_id", "left").select("worker_id", F.when(F.col("own").isNotNull(), "ring").otherwise("random").alias("policy"), F.coalesce("own", "partition_id").alias("partition_id"))
    elif shuffled is not None:
        wanted = shuffled
    elif n:
        wanted = names.select("worker_id", F.lit("direct").alias("policy"), F.lit(pending.agg(F.min("partition_id")).first()[0]).alias("partition_id"))
    else:
        rows = ledger.filter(reclaimable("", now, expiry) & preemptable(now)).select("partition_id", "status", F.col("worker_id").alias("owner"), F.when(F.col("status") == "claimed", F.col("updated_at")).otherwise(F.col("last_heartbeat")).alias("since"))
        firsts = rows.groupBy("status", "owner").agg(F.min(F.struct("since", "partition_id")).alias("first"))

        def oldest(status: str) -> Column:
            """Of the oldest ranges of two owners one at least is another's."""
            found = firsts.filter(F.col("status") == status).orderBy("first").limit(2).select("owner", "first.partition_id").collect()
            ids = [F.lit(r.partition_id) for r in found] + [F.lit(None)] * 2
            return F.when(F.col("worker_id") == (found[0].owner if found else ""), ids[1]).otherwise(ids[0]).cast("long")

        own = names.select("worker_id", *[oldest(s).alias(s) for s in ("claimed", "running")])
        wanted = own.select("worker_id", F.when(F.col("claimed").isNotNull(), "claimed").when(F.col("running").isNotNull(), "running").otherwise("none").alias("policy"), F.coalesce("claimed", "running").alias("partition_id"))
    winners = wanted.groupBy("partition_id").agg(F.min("worker_id").alias("winner"))
    out = wanted.join(winners, "partition_id", "left")
    outcome = F.when(F.col("partition_id").isNull(), "none").when(F.col("winner") == F.col("worker_id"), "acquired").otherwise("conflict")
    return out.select("worker_id", "policy", F.col("partition_id").cast("long").alias("partition_id"), outcome.alias("outcome"))


def trial_orders(workers: DataFrame, pending: DataFrame) -> DataFrame:
    """(worker_id, tries): the ids each worker would try, in order, from a shuffle of all pending ids; only the places that are tried are looked up."""
    ids = pending.select(F.col("partition_id").alias("id")).na.drop()
    n = ids.count()
    k = ids.sparkSession.range(1).select(try_count(F.lit(n))).first()[0]
    places = F.udf(lambda seed: shuffle_places(n, k, seed), "array<bigint>")
    tried = workers.select("worker_id").distinct().withColumn("places", places(fnv1a32(F.col("worker_id")))).select("worker_id", F.posexplode("places").alias("turn", "place"))
    found = tried.join(ordinal(ids, "id", "place", first=0), "place").groupBy("worker_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id")))["id"].alias("tries"))
    return workers.select("worker_id").join(found, "worker_id", "left").select("worker_id", F.coalesce("tries", F.array().cast("array<bigint>")).alias("tries"))
