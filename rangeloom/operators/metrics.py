"""Dashboard answers from event samples: histograms, rates, quantiles, ratios, means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the histogram buckets in seconds.
ASSIGNMENT_BUCKETS = (0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
TASK_BUCKETS = (0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)


def histogram(samples: DataFrame, value: str, buckets: tuple[float, ...]) -> DataFrame:
    """(le, n): how many values are at most each bound, and all of them at infinity. One pass: every bound is a conditional count."""
    bounds = [*buckets, float("inf")]
    counts = samples.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(F.explode(pairs).alias("x")).select("x.le", "x.n")


def quantile(buckets: DataFrame, q: float) -> DataFrame:
    """(q, value): the quantile of a histogram (le, n), linear inside its bucket; the largest finite bound where it lies beyond. A histogram has few rows."""
    w = Window.orderBy("le")
    rows = buckets.select("le", "n", F.lag("le", 1, 0.0).over(w).alias("low"), F.lag("n", 1, 0).over(w).alias("below"), F.max("n").over(Window.partitionBy()).alias("total"), F.max(F.when(F.col("le") < float("inf"), F.col("le"))).over(Window.partitionBy()).alias("top"))
    rank = F.lit(q) * F.col("total")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / F.nullif(F.col("n") - F.col("below"), F.lit(0))
    value = F.when(F.col("le") == float("inf"), F.col("top")).otherwise(inside)
    return rows.filter(F.col("n") >= rank).agg(F.min_by(value, "le").alias("value")).select(F.lit(q).alias("q"), "value")


def rate_per_hour(samples: DataFrame, minutes: int) -> DataFrame:
    """(window_start, n, per_hour): samples in each window of ``minutes``, and their rate an hour."""
    start = F.window(F.col("ts"), f"{minutes} minutes")["start"].alias("window_start")
    return samples.groupBy(start).agg(F.count(F.lit(1)).alias("n")).withColumn("per_hour", F.col("n") * F.lit(60.0 / minutes))


def rate_by(samples: DataFrame, by: str, minutes: int, amount: Column | None = None) -> DataFrame:
    """(by, window_start, increase, per_hour): how much a counter of each label grew in each window (by ``amount`` a sample, 1 by default) and its rate an hour."""
    start = F.window(F.col("ts"), f"{minutes} minutes")["start"].alias("window_start")
    grown = F.sum(F.lit(1) if amount is None else amount).alias("increase")
    return samples.groupBy(by, start).agg(grown).withColumn("per_hour", F.col("increase") * F.lit(60.0 / minutes))


def error_ratio(samples: DataFrame, is_error: Column, by: str) -> DataFrame:
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(is_error).alias("errors")).withColumn("ratio", F.col("errors") / F.col("total"))


def mean_by(samples: DataFrame, value: str, by: str) -> DataFrame:
    return samples.groupBy(by).agg(F.count(value).alias("n"), (F.sum(value) / F.count(value)).alias("mean"))


def snapshot(ledger: DataFrame, workers: DataFrame) -> DataFrame:
    """(metric, label, value): the gauges of the ledger as samples."""
    parts = [
        ledger.groupBy(F.col("status").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("partitions").alias("metric"), "label", "value"),
        ledger.filter("worker_id <> ''").groupBy(F.col("worker_id").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("assigned").alias("metric"), "label", "value"),
        workers.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("active_workers").alias("metric"), F.lit("").alias("label"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _labels(**columns: str) -> Column:
    """Labels as text, name=value, in the order of names."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for name, c in sorted(columns.items())]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def _samples(rows: DataFrame, metric: str, value: Column, **labels: str) -> DataFrame:
    """One sample per combination of labels."""
    return rows.groupBy(_labels(**labels).alias("labels")).agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), "labels", "value")


def _distribution(rows: DataFrame, metric: str, value: str, buckets: tuple[float, ...], **labels: str) -> DataFrame:
    """The cumulative buckets, sum and count of a histogram per combination of labels, in one aggregation."""
    counts = [F.count_if(F.col(value) <= b).cast("double") for b in buckets] + [F.count(value).cast("double")]
    names = [*(f"{b:g}" for b in buckets), "+Inf"]
    cells = F.array(
        *[F.struct(F.lit(f"{metric}_bucket").alias("metric"), F.lit(f"le={n}").alias("le"), c.alias("value")) for n, c in zip(names, counts, strict=True)],
        F.struct(F.lit(f"{metric}_sum").alias("metric"), F.lit("").alias("le"), F.coalesce(F.sum(value).cast("double"), F.lit(0.0)).alias("value")),
        F.struct(F.lit(f"{metric}_count").alias("metric"), F.lit("").alias("le"), F.count(value).cast("double").alias("value")),
    )
    rows = rows.groupBy(_labels(**labels).alias("labels")).agg(cells.alias("cells")).select("labels", F.explode("cells").alias("c"))
    return rows.select("c.metric", F.concat_ws(",", *[F.nullif(x, F.lit("")) for x in (F.col("c.le"), F.col("labels"))]).alias("labels"), "c.value")


def registry(*, leaders: DataFrame, ledger: DataFrame, plans: DataFrame, workers: DataFrame, beats: DataFrame, nodes: DataFrame, queue: DataFrame, runs: DataFrame, trips: DataFrame) -> DataFrame:
    """(metric, labels, value): all fifteen metrics as samples.

    ``leaders`` (worker_id, is_leader), ``ledger``, ``plans`` (seconds) of planning rounds, ``workers`` that are active, ``beats``
    (worker_id, ts, ok), ``nodes`` (worker_id, version, go_version, os_type), ``queue`` (worker_id) of waiting tasks, ``runs``
    (worker_id, seconds, processor_seconds, items, ok, error_type) of finished tasks, ``trips`` (worker_id, breaker_name).
    """
    one, good = F.count(F.lit(1)), runs.filter("ok")
    parts = [
        _samples(leaders, "is_leader", F.max(F.col("is_leader").cast("int")), worker_id="worker_id"),
        _samples(ledger, "partitions_total", one),
        _samples(ledger.filter("worker_id <> ''"), "partitions_assigned_total", one),
        _distribution(plans, "partitions_assignment_duration_seconds", "seconds", ASSIGNMENT_BUCKETS),
        _samples(workers, "active_workers_count", one),
        _samples(beats.filter("ok"), "node_heartbeat_timestamp_seconds", F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))), worker_id="worker_id"),
        _samples(beats.filter("not ok"), "node_heartbeat_errors_total", one, worker_id="worker_id"),
        _samples(nodes, "node_info", F.max(F.lit(1)), worker_id="worker_id", version="version", go_version="go_version", os_type="os_type"),
        _samples(queue, "node_task_queue_active_tasks", one, worker_id="worker_id"),
        _samples(good, "node_tasks_processed_total", one, worker_id="worker_id"),
        _samples(good, "node_tasks_processed_items_total", F.sum("items"), worker_id="worker_id"),
        _samples(runs.filter("not ok"), "node_tasks_errors_total", one, worker_id="worker_id", error_type="error_type"),
        _distribution(runs, "node_task_processing_duration_seconds", "seconds", TASK_BUCKETS, worker_id="worker_id"),
        _distribution(runs, "node_task_processor_duration_seconds", "processor_seconds", TASK_BUCKETS, worker_id="worker_id"),
        _samples(trips, "node_circuit_breaker_tripped_total", one, worker_id="worker_id", breaker_name="breaker_name"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
