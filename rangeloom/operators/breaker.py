"""The circuit breaker: its automaton over ordered events, and what windows can say of it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONSECUTIVE, TOTAL, OPEN_SECONDS, PROBES, WINDOW_SECONDS = 3, 5, 30.0, 2, 300.0


@dataclass
class Breaker:
    """closed, open or half-open; fed events in order of time.

    Attempts and failures first let old failures expire, each of which also takes one off the consecutive count; an open
    breaker closes if that leaves both counts below their thresholds. A partition that fails again only renews its time.
    """

    state: str = "closed"
    consecutive: int = 0
    half_open: int = 0
    since: float = 0.0
    trips: int = 0
    failed: dict[int, float] = field(default_factory=dict)

    @property
    def over(self) -> bool:
        return self.consecutive >= CONSECUTIVE or len(self.failed) >= TOTAL

    def turn(self, state: str, now: float, probes: int = 0) -> None:
        self.state, self.since, self.half_open = state, now, probes

    def expire(self, now: float) -> None:
        before = len(self.failed)
        self.failed = {k: t for k, t in self.failed.items() if now - t <= WINDOW_SECONDS}
        self.consecutive = max(0, self.consecutive - (before - len(self.failed)))
        if self.state == "open" and not self.over:
            self.turn("closed", now, self.half_open)

    def attempt(self, now: float) -> bool:
        self.expire(now)
        if self.state == "open" and now - self.since > OPEN_SECONDS:
            self.turn("half-open", now, 1)
            return True
        if self.state == "half-open" and self.half_open < PROBES:
            self.half_open += 1
            return True
        return self.state == "closed"

    def failure(self, partition: int, now: float) -> None:
        self.expire(now)
        self.consecutive += partition not in self.failed
        self.failed[partition] = now
        if self.state == "half-open":
            self.turn("open", now)
        elif self.state == "closed" and self.over:
            self.turn("open", now, self.half_open)
            self.trips += 1

    def success(self, partition: int, now: float) -> None:
        self.failed.pop(partition, None)
        self.consecutive = 0
        if self.state == "half-open":
            self.turn("closed", now, self.half_open - 1)
            self.failed = {}

    def feed(self, kind: str, partition: int, now: float) -> bool:
        """Whether an attempt may run; True for other events."""
        if kind == "attempt":
            return self.attempt(now)
        (self.success if kind == "success" else self.failure)(partition, now)
        return True


OUT = "worker_id string, seq long, kind string, partition_id long, allowed boolean, state string, consecutive_failures long, total_failures long, trips long"


def automaton(events: DataFrame) -> DataFrame:
    """Events (worker_id, seq, ts in seconds, kind, partition_id) with the breaker's state after each.

    The automaton is a fold in order of time with expiry at each read, so a worker's events meet in one task; a worker is
    one machine, whose attempts are few.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        breaker, out = Breaker(), []
        for r in frame.sort_values(["ts", "seq"]).itertuples(index=False):
            allowed = breaker.feed(r.kind, r.partition_id, r.ts)
            out.append((r.worker_id, r.seq, r.kind, r.partition_id, allowed, breaker.state, breaker.consecutive, len(breaker.failed), breaker.trips))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return events.select("worker_id", "seq", "ts", "kind", "partition_id").groupBy("worker_id").applyInPandas(run, OUT)


def failure_runs(events: DataFrame) -> DataFrame:
    """(worker_id, n_runs, longest): maximal runs of failures without a success between, per worker; an upper bound for the breaker's count."""
    by = Window.partitionBy("worker_id").orderBy("ts", "seq")
    marked = events.filter("kind <> 'attempt'").withColumn("island", F.sum((F.col("kind") == "success").cast("int")).over(by))
    runs = marked.filter("kind = 'failure'").groupBy("worker_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("worker_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("longest"))


def failure_windows(events: DataFrame, seconds: int) -> DataFrame:
    """(seq, worker_id, n_failed): at each failure, the partitions that failed within the last ``seconds``, each counted once.

    A failure counts from its time until its partition fails again or the window has passed, so the answer is a running
    sum of such beginnings and ends; no set is held. The sums run inside days of a worker's log, one row per day carries on.
    """
    length, day = seconds * 1_000_000, 86_400_000_000
    failures = events.filter("kind = 'failure'").select("seq", "worker_id", "partition_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    again = F.lead("at").over(Window.partitionBy("worker_id", "partition_id").orderBy("at", "seq"))
    spans = failures.withColumn("end", F.least(F.coalesce(again, F.col("at") + length + 1), F.col("at") + length + 1))
    turns = spans.select("worker_id", "seq", "at", F.lit(1).alias("step")).unionByName(spans.select("worker_id", F.lit(None).cast("long").alias("seq"), F.col("end").alias("at"), F.lit(-1).alias("step")))
    turns = turns.withColumn("day", F.floor(F.col("at") / day))
    inside = Window.partitionBy("worker_id", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("worker_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = turns.groupBy("worker_id", "day").agg(F.sum("step").alias("all")).select("worker_id", "day", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    sums = turns.withColumn("here", F.sum("step").over(inside)).filter("step = 1").join(days, ["worker_id", "day"])
    return sums.select("seq", "worker_id", (F.col("here") + F.col("before")).cast("long").alias("n_failed"))
