"""Every query of the range ledger with its SQL twin.

Inputs follow from the driver's tables: ``events`` is a log of range transitions (a user's id is the partition id, the event type the
status it brings), ``orders``, ``lineitem`` and ``labels`` are id spaces, the latter two with holes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, scalars
from ..operators import archive, assign, breaker, gaps, metrics, planner, process, transitions
from ..operators import ledger as led
from ..operators.neighbours import Layout, bounds_of, ordinal
from ..sources.tables import keys_like, ledger_from_json, ledger_from_json_map, queue_head, read, to_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3600, 86400
#: Ranges of the lineitem key space have this width in the examples, so that holes of a few keys matter.
TILE = 10


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- shared inputs, in both languages


def now():
    """The time that all queries take as the present."""
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")


STATUS_OF = {"signup": "pending", "view": "claimed", "click": "running", "purchase": "completed", "error": "failed"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger that the event log leaves: one aggregation per partition id."""
    events = read(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    last = F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("l")
    rows = events.groupBy(F.col("user_id").alias("partition_id")).agg(
        last, F.count(F.lit(1)).alias("version"), F.min("ts").alias("created_at"), F.max(F.when(F.col("event_type").isin("view", "click"), F.col("ts"))).alias("last_heartbeat")
    )
    worker = F.when(F.col("status") == "pending", "").otherwise(F.concat(F.lit("worker-"), (F.col("l.event_id") % 7).cast("string")))
    rows = rows.withColumn("status", status[F.col("l.event_type")])
    return rows.select(
        "partition_id", (F.col("partition_id") * 100 + 1).alias("min_id"), ((F.col("partition_id") + 1) * 100).alias("max_id"), worker.alias("worker_id"), "last_heartbeat", "status",
        F.col("l.ts").alias("updated_at"), "version", F.when(F.col("status") == "failed", F.concat(F.lit("event "), F.col("l.event_id").cast("string"))).alias("error"), "created_at",
    )


LEDGER = """WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS version,
    min(ts) OVER (PARTITION BY user_id) AS created_at, max(CASE WHEN event_type IN ('view', 'click') THEN ts END) OVER (PARTITION BY user_id) AS last_heartbeat FROM events),
named AS (SELECT *, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status FROM last WHERE rn = 1),
ledger AS (SELECT user_id AS partition_id, user_id * 100 + 1 AS min_id, (user_id + 1) * 100 AS max_id, CASE WHEN status = 'pending' THEN '' ELSE 'worker-' || (event_id % 7) END AS worker_id,
    last_heartbeat, status, ts AS updated_at, version, CASE WHEN status = 'failed' THEN 'event ' || event_id END AS error, created_at FROM named)
"""
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def islands_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.islands(read(spark, sf_dir, "lineitem"), "l_orderkey")


ISLANDS = """WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), grouped AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM ids),
islands AS (SELECT min(id) AS min_id, max(id) AS max_id, count(*) AS n_ids FROM grouped GROUP BY g)
"""
RANGES = ISLANDS + ", ranges AS (SELECT row_number() OVER (ORDER BY min_id) AS partition_id, min_id, max_id FROM islands)\n"


def numbered_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal(islands_of_lineitem(spark, sf_dir).select("min_id", "max_id"), "min_id", "partition_id", bounds=_line_keys(spark, sf_dir))


def _line_keys(spark: SparkSession, sf_dir: str) -> Layout:
    return bounds_of(read(spark, sf_dir, "lineitem"), "l_orderkey")


def every_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that nest and overlap: one of every order, 50 ids apart, of a width its customer gives."""
    low = F.col("o_orderkey") * 50
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("partition_id"), low.alias("min_id"), (low + 1 + F.col("o_custkey") % 190).alias("max_id"))


EVERY_ORDER = "WITH ranges AS (SELECT o_orderkey AS partition_id, o_orderkey * 50 AS min_id, o_orderkey * 50 + 1 + o_custkey % 190 AS max_id FROM orders)\n"


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter("worker_id <> ''").select("worker_id").distinct()


H32 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
RING = LEDGER + f""", workers AS (SELECT DISTINCT worker_id FROM ledger WHERE worker_id <> ''),
points AS (SELECT w.worker_id, unnest([w.worker_id || ':' || i, i || ':' || w.worker_id]) AS key FROM workers w, range(50) r(i)),
ring AS (SELECT {H32.format("key")} AS h, max(worker_id) AS worker_id FROM points GROUP BY 1),
assigned AS (SELECT partition_id, arg_min(ring.worker_id, CASE WHEN h >= {H32.format("partition_id::VARCHAR")} THEN h ELSE h + 4294967296 END) AS worker_id FROM ledger, ring GROUP BY partition_id)
"""


def breaker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as attempts, purchases as successes and errors as failures of workers 0 to 6."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "attempt", "purchase", "success", "error", "failure")])[F.col("event_type")]
    rows = read(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "purchase", "error"))
    return rows.select(F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string")).alias("worker_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), F.col("user_id").alias("partition_id"))


BREAKER = "WITH ev AS (SELECT 'worker-' || (event_id % 7) AS worker_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'attempt' WHEN 'purchase' THEN 'success' ELSE 'failure' END AS kind, user_id AS partition_id FROM events WHERE event_type IN ('view', 'purchase', 'error'))\n"


# --- scans, filters, point lookups


@query(LEDGER + "SELECT * FROM ledger")
def ledger_latest(spark, sf_dir):
    return ledger(spark, sf_dir)


def _filtered(spark, sf_dir, **options):
    active, done = archive.tiers(ledger(spark, sf_dir))
    return led.query(active, led.Filters(**options), now(), done).select("partition_id", "status", "worker_id", "updated_at")


_SHOWN = "SELECT partition_id, status, worker_id, updated_at FROM ledger WHERE status <> 'completed' AND "


@query(LEDGER + _SHOWN + "status IN ('pending', 'running')")
def ledger_filter_status(spark, sf_dir):
    return _filtered(spark, sf_dir, statuses=("pending", "running"))


@query(LEDGER + _SHOWN + f"updated_at < {NOW_SQL} - INTERVAL 36 HOUR")
def ledger_filter_stale(spark, sf_dir):
    return _filtered(spark, sf_dir, stale_seconds=36 * HOUR)


@query(LEDGER + _SHOWN + f"updated_at < {NOW_SQL} - INTERVAL 36 HOUR AND worker_id <> 'worker-3'")
def ledger_filter_stale_excl(spark, sf_dir):
    return _filtered(spark, sf_dir, stale_seconds=36 * HOUR, exclude_worker="worker-3")


@query(LEDGER + _SHOWN + "partition_id BETWEEN 10 AND 120 AND partition_id NOT IN (11, 12, 40)")
def ledger_filter_range_notin(spark, sf_dir):
    return _filtered(spark, sf_dir, min_id=10, max_id=120, exclude_ids=(11, 12, 40))


@query(LEDGER + _SHOWN + "false")
def ledger_filter_stale_zero_hash(spark, sf_dir):
    return _filtered(spark, sf_dir, stale_seconds=0, mode="hash")


@query(LEDGER + _SHOWN + "true")
def ledger_filter_stale_zero_simple(spark, sf_dir):
    return _filtered(spark, sf_dir, stale_seconds=0, mode="simple")


@query(LEDGER + _SHOWN + "status IN ('running', 'failed') ORDER BY partition_id LIMIT 10")
def ledger_filter_limit(spark, sf_dir):
    """The limit is the feature: the rows of smallest partition id."""
    return _filtered(spark, sf_dir, statuses=("running", "failed"), limit=10)


@query(LEDGER + "SELECT partition_id, status, worker_id, updated_at FROM ledger WHERE status IN ('completed', 'failed')")
def ledger_filter_with_archive(spark, sf_dir):
    return _filtered(spark, sf_dir, statuses=("completed", "failed"), include_archived=True)


@query(LEDGER + "SELECT partition_id, status, worker_id FROM ledger WHERE status = 'pending' AND worker_id = ''")
def pending_unowned(spark, sf_dir):
    return ledger(spark, sf_dir).filter("status = 'pending' and worker_id = ''").select("partition_id", "status", "worker_id")


@query(LEDGER + "SELECT partition_id, status, CASE WHEN status = 'completed' THEN 'archived' ELSE 'active' END AS tier FROM ledger")
def ledger_all_tiers(spark, sf_dir):
    active, done = archive.tiers(ledger(spark, sf_dir))
    return active.withColumn("tier", F.lit("active")).unionByName(done.withColumn("tier", F.lit("archived"))).select("partition_id", "status", "tier")


@query(LEDGER + "SELECT partition_id, status, version, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS tier FROM ledger WHERE partition_id IN (1, 7, 20, 33, 90, 149)")
def ledger_point_lookup(spark, sf_dir):
    active, done = archive.tiers(ledger(spark, sf_dir))
    return led.lookup([active, done], [1, 7, 20, 33, 90, 149, -5]).select("partition_id", "status", "version", "tier")


@query(LEDGER + "SELECT partition_id, min_id, max_id, worker_id, status, version FROM ledger")
def ledger_json_scan(spark, sf_dir):
    """Rows as JSON documents and back, with broken ones among them left out."""
    lines = to_json(ledger(spark, sf_dir))
    broken = spark.createDataFrame([("{not json",), ("",), (None,)], "value string")
    return ledger_from_json(lines.unionByName(broken)).select("partition_id", "min_id", "max_id", "worker_id", "status", "version")


@query(LEDGER + "SELECT substr(worker_id, 8) AS key, count(*) AS n FROM ledger WHERE worker_id LIKE 'worker-_' GROUP BY 1")
def keys_by_glob(spark, sf_dir):
    keys = ledger(spark, sf_dir).select(F.col("worker_id").alias("key"))
    return keys_like(keys, "?", "worker-").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# --- statistics

_STATS = """count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'claimed') AS claimed, count(*) FILTER (status = 'running') AS running,
count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, coalesce(max(partition_id), 0) AS max_partition_id, coalesce(max(max_id), 0) AS last_allocated_id,
CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'completed') / count(*) ELSE 0 END AS completion_rate, CASE WHEN count(*) > 0 THEN count(*) FILTER (status = 'failed') / count(*) ELSE 0 END AS failure_rate"""


@query(LEDGER + f"SELECT {_STATS} FROM ledger")
def ledger_stats(spark, sf_dir):
    return led.stats(ledger(spark, sf_dir))


@query(LEDGER + f"SELECT {_STATS} FROM ledger")
def ledger_stats_rebuild(spark, sf_dir):
    """From both tiers again."""
    active, done = archive.tiers(ledger(spark, sf_dir))
    return led.stats(active.unionByName(done))


@query(LEDGER + f"SELECT {_STATS} FROM ledger WHERE partition_id < 0")
def ledger_stats_empty(spark, sf_dir):
    return led.stats(ledger(spark, sf_dir).filter("partition_id < 0"))


@query("""WITH s AS (SELECT *, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events),
t AS (SELECT status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM s)
SELECT status, cast(sum(d) AS BIGINT) AS n FROM (SELECT status, 1 AS d FROM t UNION ALL SELECT old, -1 FROM t WHERE old IS NOT NULL) GROUP BY status""")
def ledger_stats_delta(spark, sf_dir):
    """Counters kept by each transition's +1 and -1 end where the ledger's counts are."""
    from pyspark.sql import Window

    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[F.col("event_type")]
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = read(spark, sf_dir, "events").select(status.alias("new_status"), F.lag(status).over(by).alias("old_status"))
    return led.stats_deltas(moves)


@query(LEDGER + "SELECT min_id // 1000 AS bucket, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM ledger GROUP BY 1")
def stats_by_range(spark, sf_dir):
    return led.metadata_counts(ledger(spark, sf_dir), F.floor(F.col("min_id") / 1000), "bucket")


@query(LEDGER + "SELECT worker_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM ledger GROUP BY 1")
def stats_by_worker(spark, sf_dir):
    return led.metadata_counts(ledger(spark, sf_dir), F.col("worker_id"), "worker_id")


@query(LEDGER + "SELECT cast(date_trunc('hour', updated_at) AS TIMESTAMP) AS hour, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM ledger GROUP BY 1")
def stats_by_hour(spark, sf_dir):
    return led.metadata_counts(ledger(spark, sf_dir), F.date_trunc("hour", "updated_at").cast("timestamp_ntz"), "hour")


# --- planning


def _plan(spark, sf_dir, size, last=0):
    top = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").cast("long").alias("next_id"))
    return planner.plan_ranges(top.select(F.lit(last).cast("long").alias("last_id"), "next_id", F.lit(0).cast("long").alias("max_partition_id")), size)


def _plan_sql(size: int, last: int = 0) -> str:
    return f"""WITH b AS (SELECT max(o_orderkey) AS nxt, greatest(1, (max(o_orderkey) - {last} + {size - 1}) // {size}) AS n FROM orders), i AS (SELECT nxt, n, unnest(range(0, n)) AS i FROM b)
SELECT 1 + i AS partition_id, {last} + i * {size} + 1 AS min_id, CASE WHEN i = n - 1 THEN nxt ELSE {last} + (i + 1) * {size} END AS max_id FROM i"""


@query(_plan_sql(3000))
def plan_ranges_orders(spark, sf_dir):
    return _plan(spark, sf_dir, 0)


@query(_plan_sql(700, 123))
def plan_ranges_remainder(spark, sf_dir):
    return _plan(spark, sf_dir, 700, 123)


@query("SELECT coalesce(max(id), 100) AS next_max_id FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey > 100 ORDER BY 1 LIMIT 500)")
def planner_next_max_id(spark, sf_dir):
    return planner.RangeSource(read(spark, sf_dir, "lineitem"), "l_orderkey").next_max_id(100, 500)


@query("SELECT n, size, workers, multiple::BIGINT AS multiple, look::BIGINT AS look, effective::BIGINT AS effective FROM (VALUES (1, 1000, 2, 3, 9000, 1000), (2, 1000, 4, 3, 12000, 1000), (3, 0, 4, 3, 1000000, 3000), (4, 1000000000, 1000, 10000000000, 1000000, 1000000000), (5, 1000, 10, 5, 50000, 1000)) t(n, size, workers, multiple, look, effective)")
def look_ahead_table(spark, sf_dir):
    rows = spark.createDataFrame([(1, 1000, 2, 3), (2, 1000, 4, 3), (3, 0, 4, 3), (4, 10**9, 1000, 10**10), (5, 1000, 10, 5)], "n int, size int, workers int, multiple long")
    return rows.select("n", "size", "workers", "multiple", scalars.look_ahead(F.col("size"), F.col("workers"), F.col("multiple")).alias("look"), scalars.effective_size(F.col("size")).alias("effective"))


@query(LEDGER + "SELECT count(*) FILTER (status IN ('pending', 'claimed')) AS waiting, count(*) FILTER (status IN ('pending', 'claimed')) < 1000 AS allocate FROM ledger")
def backpressure_decision(spark, sf_dir):
    return planner.may_allocate(led.stats(ledger(spark, sf_dir)))


@query(f"""WITH t AS (SELECT unnest(range(0, (SELECT max(l_orderkey) FROM lineitem), {TILE})) AS a)
SELECT a AS min_id, a + {TILE - 1} AS max_id FROM t WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey > a AND l_orderkey <= a + {TILE - 1})""")
def range_has_data(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    top = lines.agg(F.max("l_orderkey").alias("top"))
    tiles = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1, F.lit(TILE).cast("long"))).alias("min_id")).withColumn("max_id", F.col("min_id") + TILE - 1)
    return gaps.has_data(tiles, lines, "l_orderkey", size=TILE)


# --- gaps and islands


@query("WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), n AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM ids) SELECT id + 1 AS start_id, nxt - 1 AS end_id FROM n WHERE id + 1 < nxt")
def gaps_lineitem(spark, sf_dir):
    return gaps.id_gaps(read(spark, sf_dir, "lineitem"), "l_orderkey")


@query("WITH ids AS (SELECT DISTINCT doc_id AS id FROM labels), n AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM ids) SELECT id + 1 AS start_id, nxt - 1 AS end_id FROM n WHERE id + 1 < nxt")
def gaps_labels(spark, sf_dir):
    return gaps.id_gaps(read(spark, sf_dir, "labels"), "doc_id")


@query(ISLANDS + "SELECT * FROM islands")
def islands_lineitem(spark, sf_dir):
    return islands_of_lineitem(spark, sf_dir)


@query(EVERY_ORDER + "SELECT max_id + 1 AS start_id, nxt - 1 AS end_id FROM (SELECT *, lead(min_id) OVER (ORDER BY min_id) AS nxt FROM ranges) WHERE max_id + 1 < nxt")
def gaps_adjacent_every_order(spark, sf_dir):
    return gaps.gaps_adjacent(every_order(spark, sf_dir))


@query(EVERY_ORDER + "SELECT cov + 1 AS start_id, nxt - 1 AS end_id FROM (SELECT max(max_id) OVER (ORDER BY min_id ROWS UNBOUNDED PRECEDING) AS cov, lead(min_id) OVER (ORDER BY min_id) AS nxt FROM ranges) WHERE cov + 1 < nxt")
def gaps_covered_every_order(spark, sf_dir):
    return gaps.gaps_covered(every_order(spark, sf_dir))


_FILL = """, cut AS (SELECT g.start_id, g.end_id FROM gaps g), tiles AS (SELECT a AS min_id, least(a + 39, end_id) AS max_id FROM (SELECT end_id, unnest(generate_series(start_id, end_id, 40)) AS a FROM cut)),
kept AS (SELECT * FROM tiles t WHERE EXISTS (SELECT 1 FROM items WHERE id > t.min_id AND id <= t.max_id))
SELECT 1000 + row_number() OVER (ORDER BY min_id) - 1 AS partition_id, min_id, max_id FROM kept"""


@query(EVERY_ORDER + ", items AS (SELECT l_orderkey * 50 + l_linenumber * 7 AS id FROM lineitem), gaps AS (SELECT cov + 1 AS start_id, nxt - 1 AS end_id FROM (SELECT max(max_id) OVER (ORDER BY min_id ROWS UNBOUNDED PRECEDING) AS cov, lead(min_id) OVER (ORDER BY min_id) AS nxt FROM ranges) WHERE cov + 1 < nxt)" + _FILL)
def gap_fill_every_order(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 50 + F.col("l_linenumber") * 7).alias("id"))
    return gaps.split_gaps(gaps.gaps_covered(every_order(spark, sf_dir)), items, "id", size=40, next_id=1000)


@query(RANGES + "SELECT max_id + 1 AS start_id, nxt - 1 AS end_id FROM (SELECT *, lead(min_id) OVER (ORDER BY min_id) AS nxt, lead(partition_id) OVER (ORDER BY min_id) AS np FROM ranges) WHERE max_id + 1 < nxt AND (partition_id > 200 OR np > 200)")
def gaps_incremental(spark, sf_dir):
    return gaps.gaps_around_new(numbered_islands(spark, sf_dir), 200, _line_keys(spark, sf_dir))


@query(EVERY_ORDER + """, starts AS (SELECT min_id AS place, max(n) AS n FROM (SELECT min_id, count(*) OVER (ORDER BY min_id) AS n FROM ranges) GROUP BY 1), ends AS (SELECT max_id AS place, max(n) AS n FROM (SELECT max_id, count(*) OVER (ORDER BY max_id) AS n FROM ranges) GROUP BY 1),
lasts AS (SELECT max_id AS place, max(partition_id) AS pid FROM ranges GROUP BY 1), firsts AS (SELECT min_id AS place, min(partition_id) AS pid FROM ranges GROUP BY 1),
sides AS (SELECT partition_id, before.pid AS before, after.pid AS after, s1.n - coalesce(e1.n, 0) AS open_low, s2.n - coalesce(e2.n, 0) AS open_high FROM ranges r
    ASOF LEFT JOIN starts s1 ON r.min_id >= s1.place ASOF LEFT JOIN ends e1 ON r.min_id > e1.place ASOF LEFT JOIN starts s2 ON r.max_id >= s2.place ASOF LEFT JOIN ends e2 ON r.max_id > e2.place
    ASOF LEFT JOIN lasts before ON r.min_id > before.place ASOF LEFT JOIN firsts after ON r.max_id < after.place)
SELECT partition_id AS probe_id, CASE WHEN open_low <= 1 THEN before END AS prev_id, CASE WHEN open_high <= 1 THEN after END AS next_id FROM sides""")
def adjacent_every_order(spark, sf_dir):
    """A probe of every order. The SQL twin counts the ranges that are open at a bound; tests compare with a plain model too."""
    ranges = every_order(spark, sf_dir)
    probes = ranges.select(F.col("partition_id").alias("probe_id"), F.col("partition_id").alias("self_id"), "min_id", "max_id")
    return gaps.adjacent_ranges(probes, ranges)


@query(RANGES + """, n AS (SELECT *, lead(min_id) OVER (ORDER BY min_id) AS nxt FROM ranges), first_break AS (SELECT min(min_id) AS place FROM n WHERE nxt IS NOT NULL AND max_id + 1 < nxt)
SELECT coalesce(max(max_id), 0) AS confirmed_max_id FROM ranges WHERE min_id < coalesce((SELECT place FROM first_break), (SELECT max(min_id) FROM ranges))""")
def contiguous_prefix(spark, sf_dir):
    return gaps.contiguous_prefix(numbered_islands(spark, sf_dir), _line_keys(spark, sf_dir))


# --- assignment


@query(RING + "SELECT * FROM assigned")
def ring_assignment(spark, sf_dir):
    return assign.prefer(ledger(spark, sf_dir).select("partition_id"), assign.ring(workers(spark, sf_dir)))


@query(RING + ", c AS (SELECT w.worker_id, count(a.partition_id) AS n FROM workers w LEFT JOIN assigned a USING (worker_id) GROUP BY 1) SELECT count(*) AS worker_count, cast(sum(n) AS BIGINT) AS total, var_pop(n) AS variance, CASE WHEN var_pop(n) = 0 THEN 100 ELSE least(100, greatest(0, 100 * exp(-sqrt(var_pop(n)) / avg(n)))) END AS score FROM c")
def ring_distribution(spark, sf_dir):
    names = workers(spark, sf_dir)
    return assign.quality(assign.distribution(names, assign.prefer(ledger(spark, sf_dir).select("partition_id"), assign.ring(names))))


@query(RING + f""", less AS (SELECT * FROM ring WHERE worker_id <> 'worker-0'),
after AS (SELECT partition_id, arg_min(less.worker_id, CASE WHEN h >= {H32.format("partition_id::VARCHAR")} THEN h ELSE h + 4294967296 END) AS new_worker FROM ledger, less GROUP BY partition_id)
SELECT partition_id, worker_id AS old_worker, new_worker FROM assigned JOIN after USING (partition_id) WHERE worker_id <> new_worker""")
def ring_rebalance_diff(spark, sf_dir):
    """One worker leaves: only its ranges move."""
    parts, names = ledger(spark, sf_dir).select("partition_id"), workers(spark, sf_dir)
    return assign.moved(assign.prefer(parts, assign.ring(names)), assign.prefer(parts, assign.ring(names.filter("worker_id <> 'worker-0'"))))


@query(LEDGER + f"SELECT partition_id, (status = 'claimed' AND updated_at < {NOW_SQL} - INTERVAL 48 HOUR AND worker_id <> 'worker-1') OR coalesce(status = 'running' AND last_heartbeat < {NOW_SQL} - INTERVAL 120 HOUR AND worker_id <> 'worker-1', false) AS reclaim FROM ledger")
def reclaimable(spark, sf_dir):
    return ledger(spark, sf_dir).select("partition_id", assign.reclaimable("worker-1", now(), 24 * HOUR).alias("reclaim"))


@query(LEDGER + f"SELECT partition_id, worker_id FROM ledger WHERE status IN ('claimed', 'running') AND last_heartbeat < {NOW_SQL} - INTERVAL 30 HOUR")
def preemptable(spark, sf_dir):
    return ledger(spark, sf_dir).filter(assign.preemptable(now(), 30 * HOUR)).select("partition_id", "worker_id")


@query(LEDGER + f"""SELECT status, arg_min(partition_id, {{'t': CASE status WHEN 'claimed' THEN updated_at ELSE last_heartbeat END, 'p': partition_id}}) AS partition_id FROM ledger
WHERE worker_id <> 'worker-1' AND ((status = 'claimed' AND updated_at < {NOW_SQL} - INTERVAL 24 HOUR) OR (status = 'running' AND last_heartbeat < {NOW_SQL} - INTERVAL 60 HOUR)) GROUP BY status""")
def oldest_reclaim(spark, sf_dir):
    return assign.oldest_reclaim(ledger(spark, sf_dir), "worker-1", now(), 12 * HOUR)


@query("SELECT n, CASE WHEN n <= 3 THEN n WHEN n <= 10 THEN (3 * n + 3) // 4 WHEN n <= 50 THEN (n + 1) // 2 ELSE least(greatest(n // 2, 5), 20) END AS tries FROM range(1, 201) t(n)")
def try_count_table(spark, sf_dir):
    return spark.range(1, 201).select(F.col("id").alias("n"), hashing.try_count(F.col("id")).alias("tries"))


@query(LEDGER + f"SELECT worker_id, max(updated_at) AS last_beat FROM ledger WHERE worker_id <> '' GROUP BY 1 HAVING max(updated_at) > {NOW_SQL} - INTERVAL 2 DAY")
def active_workers(spark, sf_dir):
    beats = ledger(spark, sf_dir).filter("worker_id <> ''").select("worker_id", F.col("updated_at").alias("ts"))
    return assign.alive(beats, now(), 2 * DAY)


@query("SELECT * FROM (VALUES ('worker-1', 'removed'), ('worker-9', 'added'), ('worker-8', 'added')) t(worker_id, change)")
def worker_set_changes(spark, sf_dir):
    old, new = (spark.createDataFrame([(f"worker-{i}",) for i in ids], "worker_id string") for ids in ((1, 2, 3), (2, 3, 8, 9)))
    return assign.set_changes(old, new, "worker_id")


_SEEDS = LEDGER.replace("WITH ", "WITH RECURSIVE ", 1) + """, workers AS (SELECT DISTINCT worker_id FROM ledger WHERE worker_id <> ''),
fnv AS (SELECT worker_id, 0 AS i, 2166136261::BIGINT AS h FROM workers UNION ALL SELECT worker_id, i + 1, xor(h, ascii(substr(worker_id, i + 1, 1))::BIGINT) * 16777619 % 4294967296 FROM fnv WHERE i < length(worker_id)),
seeds AS (SELECT worker_id, h AS seed FROM fnv WHERE i = length(worker_id))
"""
_STEP = "(r * 1103515245 + 12345) % 4294967296"


@query(_SEEDS + f""", pending AS (SELECT list(partition_id ORDER BY partition_id) AS a, count(*) AS n FROM ledger WHERE status = 'pending'),
tries AS (SELECT *, CASE WHEN n <= 3 THEN n WHEN n <= 10 THEN (3 * n + 3) // 4 WHEN n <= 50 THEN (n + 1) // 2 ELSE least(greatest(n // 2, 5), 20) END AS k FROM pending),
shuffled AS (SELECT worker_id, seed AS r, a, n - 1 AS i FROM seeds, tries WHERE n > 0 UNION ALL
    SELECT worker_id, {_STEP}, list_transform(a, lambda x, p : CASE WHEN p = i + 1 THEN a[{_STEP} % (i + 1) + 1] WHEN p = {_STEP} % (i + 1) + 1 THEN a[i + 1] ELSE x END), i - 1 FROM shuffled WHERE i > 0),
orders_ AS (SELECT worker_id, unnest(CASE WHEN n <= k THEN t.a ELSE s.a[1:k] END) AS partition_id, unnest(range(0, k)) AS turn FROM shuffled s, tries t WHERE i = 0)
SELECT worker_id, turn::INT AS turn, partition_id FROM orders_""")
def seeded_shuffle(spark, sf_dir):
    """The pending ranges that each worker tries, in its order."""
    tries = assign.trial_orders(workers(spark, sf_dir), ledger(spark, sf_dir).filter("status = 'pending'"))
    return tries.select("worker_id", F.posexplode("tries").alias("turn", "partition_id"))


@query(_SEEDS + "SELECT worker_id, seed FROM seeds")
def fnv_seed(spark, sf_dir):
    return workers(spark, sf_dir).select("worker_id", hashing.fnv1a32(F.col("worker_id")).alias("seed"))


# --- transitions


_REQUESTS_EVERY = ", requests AS (SELECT c_custkey AS request_id, c_custkey % (SELECT max(user_id) + 1 FROM events) AS partition_id, 'worker-' || (c_custkey % 7) AS worker_id FROM customer)\n"


@query(LEDGER + _REQUESTS_EVERY + f""", w AS (SELECT r.*, CASE WHEN l.worker_id = r.worker_id AND status IN ('claimed', 'running') THEN 'renewed' WHEN status = 'pending' AND l.worker_id = '' THEN 'claimed'
WHEN status IN ('claimed', 'running') AND last_heartbeat < {NOW_SQL} - INTERVAL 5 MINUTE THEN 'preempted' ELSE 'denied' END AS want FROM requests r LEFT JOIN ledger l USING (partition_id)),
x AS (SELECT *, min(CASE WHEN want IN ('claimed', 'preempted') THEN request_id END) OVER (PARTITION BY partition_id) AS winner FROM w)
SELECT request_id, partition_id, worker_id, CASE WHEN want IN ('claimed', 'preempted') AND request_id <> winner THEN 'denied' ELSE want END AS outcome FROM x""")
def acquire_every_customer(spark, sf_dir):
    """A request of every customer, over all ids of the ledger."""
    ids = read(spark, sf_dir, "events").agg(F.max("user_id") + 1).first()[0]
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), (F.col("c_custkey") % F.lit(ids)).alias("partition_id"), F.concat(F.lit("worker-"), (F.col("c_custkey") % 7).cast("string")).alias("worker_id"))
    return transitions.acquire(ledger(spark, sf_dir), rows, now())


def _release_sql(owner_kept: str) -> str:
    return LEDGER + f"""SELECT partition_id, CASE WHEN status IN ('completed', 'failed') THEN status ELSE 'pending' END AS status, CASE WHEN status IN ({owner_kept}) THEN worker_id ELSE '' END AS worker_id,
CASE WHEN status = 'completed' THEN last_heartbeat END AS last_heartbeat FROM ledger WHERE worker_id <> ''"""


def _release(spark, sf_dir, mode):
    rows = ledger(spark, sf_dir)
    return transitions.release(rows, rows.filter("worker_id <> ''").select("partition_id", "worker_id"), mode=mode)


@query(_release_sql("'completed', 'failed'"))
def release_outcomes_hash(spark, sf_dir):
    return _release(spark, sf_dir, "hash")


@query(_release_sql("'completed'"))
def release_outcomes_simple(spark, sf_dir):
    return _release(spark, sf_dir, "simple")


@query(LEDGER + "SELECT partition_id, 'pending' AS status, '' AS worker_id, version + 1 AS version FROM ledger WHERE status = 'failed'")
def retry_failed(spark, sf_dir):
    return transitions.retry_failed(ledger(spark, sf_dir)).select("partition_id", "status", "worker_id", "version")


_CREATE = LEDGER + ", wanted AS (SELECT o_orderkey AS partition_id, o_orderkey * 100 + 1 AS min_id, (o_orderkey + 1) * 100 + CASE WHEN o_orderkey % 9 = 0 THEN 50 ELSE 0 END AS max_id FROM orders)\n"


_STATE = ", state AS (SELECT w.*, CASE WHEN l.partition_id IS NULL THEN 'created' WHEN l.min_id = w.min_id AND l.max_id = w.max_id THEN 'exists' ELSE 'conflict' END AS outcome FROM wanted w LEFT JOIN ledger l USING (partition_id))\n"


def _create_every(spark, sf_dir, mode):
    """A range asked for by every order."""
    key = F.col("o_orderkey")
    wanted = read(spark, sf_dir, "orders").select(key.alias("partition_id"), (key * 100 + 1).alias("min_id"), ((key + 1) * 100 + F.when(key % 9 == 0, 50).otherwise(0)).alias("max_id"))
    return transitions.create_if_absent(ledger(spark, sf_dir), wanted, mode=mode)


@query(_CREATE + _STATE + "SELECT * FROM state")
def create_every_order_hash(spark, sf_dir):
    return _create_every(spark, sf_dir, "hash")


@query(_CREATE + _STATE + """SELECT * FROM state WHERE outcome <> 'conflict' UNION ALL
SELECT (SELECT max(p) FROM (SELECT max(partition_id) AS p FROM ledger UNION ALL SELECT max(partition_id) FROM wanted)) + row_number() OVER (ORDER BY partition_id), min_id, max_id, 'created' FROM state WHERE outcome = 'conflict'""")
def create_every_order_simple(spark, sf_dir):
    return _create_every(spark, sf_dir, "simple")


@query(_plan_sql(70) .replace("SELECT 1 + i AS partition_id", ", p AS (SELECT 1 + i AS partition_id").replace(" FROM i", " FROM i) SELECT *, (partition_id - 1) // 50 + 1 AS batch_no FROM p", 1).replace("FROM b)\n, p", "FROM b), p"))
def create_batches(spark, sf_dir):
    return transitions.batches(_plan(spark, sf_dir, 70))


_UPDATES = LEDGER + ", updates AS (SELECT partition_id, CASE WHEN partition_id % 3 = 0 THEN version ELSE version - 1 END AS expected FROM ledger UNION ALL SELECT 100000 + partition_id, 0 FROM ledger WHERE partition_id % 10 = 0)\n"


def _updates(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    known = rows.select("partition_id", F.when(F.col("partition_id") % 3 == 0, F.col("version")).otherwise(F.col("version") - 1).alias("expected"))
    return rows, known.unionByName(rows.filter("partition_id % 10 = 0").select((F.col("partition_id") + 100000).alias("partition_id"), F.lit(0).cast("long").alias("expected")))


@query(_UPDATES + """SELECT u.partition_id, CASE WHEN l.partition_id IS NULL AND expected = 0 THEN 'created' WHEN version = expected THEN 'updated' ELSE 'stale' END AS outcome,
CASE WHEN (l.partition_id IS NULL AND expected = 0) OR version = expected THEN expected + 1 ELSE version END AS version FROM updates u LEFT JOIN ledger l USING (partition_id)""")
def compare_and_set(spark, sf_dir):
    rows, updates = _updates(spark, sf_dir)
    return transitions.compare_and_set(rows, updates, now())


@query(_UPDATES + f"""SELECT l.partition_id, CASE WHEN u.expected = l.version THEN 'failed' ELSE status END AS status, CASE WHEN u.expected = l.version THEN {NOW_SQL} ELSE updated_at END AS updated_at,
version + CASE WHEN u.expected = l.version THEN 1 ELSE 0 END AS version, CASE WHEN u.expected = l.version THEN 'gave up' ELSE error END AS error FROM ledger l LEFT JOIN updates u USING (partition_id)""")
def update_status(spark, sf_dir):
    rows, updates = _updates(spark, sf_dir)
    options = F.lit(None).cast("map<string,string>")
    changed = updates.select("partition_id", "expected", F.lit("failed").alias("status"), F.lit("gave up").alias("error"), options.alias("options"))
    return transitions.apply_updates(rows.withColumn("options", options), changed, now()).select("partition_id", "status", "updated_at", "version", "error")


@query(LEDGER + "SELECT partition_id, status FROM ledger WHERE partition_id NOT IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 7)")
def delete_partitions(spark, sf_dir):
    gone = read(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("partition_id"))
    return transitions.delete(ledger(spark, sf_dir), gone).select("partition_id", "status")


# --- processing

_PLANNED = f"planned AS ({_plan_sql(1000)})"


@query("WITH " + _PLANNED + ", counts AS (SELECT partition_id, count(l_orderkey) AS n_items FROM planned LEFT JOIN lineitem ON l_orderkey BETWEEN min_id AND max_id GROUP BY 1) SELECT p.*, n_items FROM planned p JOIN counts USING (partition_id)")
def process_ranges(spark, sf_dir):
    return process.count_items(_plan(spark, sf_dir, 1000), read(spark, sf_dir, "lineitem"), "l_orderkey", size=1000)


@query(LEDGER + "SELECT partition_id, worker_id, CASE WHEN partition_id % 10 = 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN partition_id % 10 = 3 THEN 0 ELSE 100 END::BIGINT AS n_items, CASE WHEN partition_id % 10 = 3 THEN 'range ' || partition_id END AS error FROM ledger")
def run_processor(spark, sf_dir):
    def work(low: int, high: int, options: dict) -> int:
        if options["partition_id"] % 10 == 3:
            raise ValueError(f"range {options['partition_id']}")
        return high - low + 1

    return process.run_processor(ledger(spark, sf_dir).withColumn("options", F.lit(None).cast("map<string,string>")), work)


# --- archive


@query(LEDGER + ", a AS (SELECT partition_id, row_number() OVER (ORDER BY partition_id) AS place, count(*) OVER () AS n FROM ledger WHERE status = 'completed') SELECT partition_id, (place - 1) // 5 + 1 AS batch_no FROM a WHERE n > 12 AND place <= (n - 12 + 4) // 5 * 5")
def archive_tiering(spark, sf_dir):
    return archive.compression_plan(archive.tiers(ledger(spark, sf_dir))[1], threshold=12, batch=5)


@query(LEDGER + """, a AS (SELECT partition_id, row_number() OVER (ORDER BY partition_id) AS place, count(*) OVER () AS n FROM ledger WHERE status = 'completed'), b AS (SELECT CASE WHEN n > 12 AND place <= (n - 12 + 4) // 5 * 5 THEN (place - 1) // 5 + 1 END AS batch FROM a)
SELECT count(*) FILTER (batch IS NULL) AS uncompressed_partitions, count(DISTINCT batch) AS compressed_batches, count(DISTINCT batch) * 5 AS estimated_compressed_partitions, count(*) FILTER (batch IS NULL) + count(DISTINCT batch) * 5 AS total_estimated_partitions, count(DISTINCT batch) > 0 AS compression_enabled FROM b""")
def archive_stats(spark, sf_dir):
    done = archive.tiers(ledger(spark, sf_dir))[1]
    return archive.archive_stats(done, archive.compression_plan(done, threshold=12, batch=5), batch=5)


def _registered(spark, sf_dir):
    return ledger(spark, sf_dir).filter("worker_id <> ''").groupBy("worker_id").agg(F.min("created_at").alias("register_time"))


_CODES = LEDGER + ", codes AS (SELECT worker_id, row_number() OVER (ORDER BY min(created_at), worker_id) AS code FROM ledger WHERE worker_id <> '' GROUP BY worker_id)\n"


@query(_CODES + "SELECT * FROM codes")
def worker_dictionary(spark, sf_dir):
    return archive.worker_dictionary(_registered(spark, sf_dir))


@query(_CODES + "SELECT partition_id, CASE code WHEN 0 THEN '' ELSE coalesce(worker_id, 'unknown_worker_' || code) END AS worker_id FROM (SELECT partition_id, partition_id % 12 AS code FROM ledger) LEFT JOIN codes USING (code)")
def worker_decode_unknown(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("partition_id", (F.col("partition_id") % 12).alias("code"))
    return archive.decode_workers(rows, archive.worker_dictionary(_registered(spark, sf_dir))).select("partition_id", "worker_id")


def _archive_round(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    codes = archive.worker_dictionary(_registered(spark, sf_dir))
    plan = rows.select("partition_id", F.expr("partition_id div 64 + 1").alias("batch_no"))
    return archive.compress(rows, plan, codes), codes


@query()
def batch_codec_sizes(spark, sf_dir):
    blobs = _archive_round(spark, sf_dir)[0]
    sums = blobs.agg(F.sum("partition_count").alias("n_rows"), F.sum("json_bytes").alias("json_bytes"), F.sum("binary_bytes").alias("binary_bytes"), F.sum(F.length("compressed_data")).alias("gzip_bytes"))
    return sums.withColumn("saved", 1 - F.col("gzip_bytes") / F.col("json_bytes"))


@query(LEDGER + "SELECT partition_id, min_id, max_id, worker_id, status, error, cast(date_trunc('second', updated_at) AS TIMESTAMP) AS updated_at, cast(date_trunc('second', created_at) AS TIMESTAMP) AS created_at FROM ledger")
def batch_codec_round_trip(spark, sf_dir):
    """What the codec keeps: seconds of times; version, options and heartbeat are lost."""
    blobs, codes = _archive_round(spark, sf_dir)
    return archive.decompress(blobs, codes).select("partition_id", "min_id", "max_id", "worker_id", "status", "error", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), F.col("created_at").cast("timestamp_ntz").alias("created_at"))


# --- circuit breaker


@query(BREAKER + ", m AS (SELECT *, sum(CASE WHEN kind = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id ORDER BY ts, seq) AS island FROM ev WHERE kind <> 'attempt'), r AS (SELECT worker_id, island, count(*) AS n FROM m WHERE kind = 'failure' GROUP BY 1, 2) SELECT worker_id, count(*) AS n_runs, max(n) AS longest FROM r GROUP BY 1")
def breaker_consecutive_islands(spark, sf_dir):
    return breaker.failure_runs(breaker_events(spark, sf_dir))


@query(BREAKER + ", f AS (SELECT * FROM ev WHERE kind = 'failure') SELECT a.seq, a.worker_id, count(DISTINCT b.partition_id) AS n_failed FROM f a JOIN f b ON a.worker_id = b.worker_id AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts GROUP BY 1, 2")
def breaker_failure_window(spark, sf_dir):
    return breaker.failure_windows(breaker_events(spark, sf_dir), 6 * HOUR)


@query(BREAKER.replace("WITH ", "WITH RECURSIVE ", 1) + """, log AS (SELECT worker_id, seq, kind, partition_id, epoch_us(ts) / 1e8 AS moment, row_number() OVER (PARTITION BY worker_id ORDER BY ts, seq) AS n FROM ev),
fold AS (SELECT DISTINCT worker_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::BIGINT AS partition_id, NULL::BOOLEAN AS allowed, 'closed' AS state, 0::BIGINT AS consecutive, 0::BIGINT AS probes, 0::DOUBLE AS since, 0::BIGINT AS trips, []::STRUCT(p BIGINT, t DOUBLE)[] AS failed FROM log
UNION ALL SELECT worker_id, n, seq, kind, partition_id, kind <> 'attempt' OR state = 'closed' OR turns OR probing,
    CASE WHEN kind = 'attempt' THEN CASE WHEN turns THEN 'half-open' ELSE state END WHEN kind = 'success' THEN CASE WHEN state = 'half-open' THEN 'closed' ELSE state END WHEN trips_now OR state = 'half-open' THEN 'open' ELSE state END,
    CASE kind WHEN 'success' THEN 0 ELSE consecutive END,
    CASE WHEN kind = 'attempt' THEN CASE WHEN turns THEN 1 WHEN probing THEN probes + 1 ELSE probes END WHEN state = 'half-open' THEN CASE kind WHEN 'success' THEN probes - 1 ELSE 0 END ELSE probes END,
    CASE WHEN turns OR trips_now OR (kind <> 'attempt' AND state = 'half-open') THEN moment ELSE since END, trips + CASE WHEN trips_now THEN 1 ELSE 0 END, CASE WHEN kind = 'success' AND state = 'half-open' THEN [] ELSE failed END
FROM (SELECT *, kind = 'attempt' AND state = 'open' AND moment - since > 30 AS turns, kind = 'attempt' AND state = 'half-open' AND probes < 2 AS probing, kind = 'failure' AND state = 'closed' AND (consecutive >= 3 OR len(failed) >= 5) AS trips_now
FROM (SELECT * REPLACE (CASE kind WHEN 'failure' THEN consecutive + CASE WHEN len(list_filter(failed, lambda f : f.p = partition_id)) = 0 THEN 1 ELSE 0 END ELSE consecutive END AS consecutive,
    CASE kind WHEN 'attempt' THEN failed WHEN 'success' THEN list_filter(failed, lambda f : f.p <> partition_id) ELSE list_append(list_filter(failed, lambda f : f.p <> partition_id), {'p': partition_id, 't': moment}) END AS failed)
FROM (SELECT * REPLACE (CASE WHEN closes THEN 'closed' ELSE state END AS state, CASE WHEN closes THEN moment ELSE since END AS since) FROM (SELECT *, kind <> 'success' AND state = 'open' AND consecutive < 3 AND len(failed) < 5 AS closes
FROM (SELECT * REPLACE (CASE kind WHEN 'success' THEN consecutive ELSE greatest(0, consecutive - len(failed) + len(list_filter(failed, lambda f : moment - f.t <= 300))) END AS consecutive, CASE kind WHEN 'success' THEN failed ELSE list_filter(failed, lambda f : moment - f.t <= 300) END AS failed)
FROM (SELECT l.*, f.state, f.consecutive, f.probes, f.since, f.trips, f.failed FROM fold f JOIN log l ON l.worker_id = f.worker_id AND l.n = f.n + 1)))))))
SELECT worker_id, seq, kind, partition_id, allowed, state, consecutive AS consecutive_failures, len(failed) AS total_failures, trips FROM fold WHERE n > 0""")
def breaker_automaton(spark, sf_dir):
    """Event times are divided by 100, so that the thresholds of seconds and minutes meet some of the log."""
    events = breaker_events(spark, sf_dir).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e8))
    return breaker.automaton(events)


# --- commands and metrics


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 10")
def command_queue_head(spark, sf_dir):
    """The ten commands that a poll takes, oldest first; the limit is the feature."""
    return queue_head(read(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id"), 10, "event_id", "event_id")


_BOUNDS = "(VALUES (0.001::DOUBLE), (0.01), (0.1), (0.5), (1.0), (2.0), (5.0), (10.0), (30.0), (60.0), ('inf'::DOUBLE)) b(le)"


@query(f"SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM {_BOUNDS}")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(read(spark, sf_dir, "events"), "value", metrics.TASK_BUCKETS)


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, count(*) AS n, count(*) * 1.0::DOUBLE AS per_hour FROM events GROUP BY 1")
def metric_rate_per_hour(spark, sf_dir):
    return metrics.rate_per_hour(read(spark, sf_dir, "events"), 60)


@query(f"""WITH h AS (SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM {_BOUNDS}), r AS (SELECT le, n, lag(le, 1, 0) OVER (ORDER BY le) AS low, lag(n, 1, 0) OVER (ORDER BY le) AS below, max(n) OVER () AS total FROM h)
SELECT 0.95::DOUBLE AS q, arg_min(CASE WHEN le = 'inf' THEN 60 ELSE low + (le - low) * (0.95::DOUBLE * total - below) / nullif(n - below, 0) END, le) AS value FROM r WHERE n >= 0.95::DOUBLE * total""")
def metric_p95(spark, sf_dir):
    return metrics.quantile(metrics.histogram(read(spark, sf_dir, "events"), "value", metrics.TASK_BUCKETS), 0.95)


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / count(*) AS ratio FROM events GROUP BY 1")
def metric_error_ratio(spark, sf_dir):
    return metrics.error_ratio(read(spark, sf_dir, "events"), F.col("event_type") == "error", "user_id")


@query("SELECT event_type, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1")
def metric_mean_duration(spark, sf_dir):
    return metrics.mean_by(read(spark, sf_dir, "events").select("event_type", F.col("value").cast("decimal(20,6)").alias("value")), "value", "event_type").withColumn("mean", F.col("mean").cast("double"))


@query(RING + """SELECT 'partitions' AS metric, status AS label, count(*)::DOUBLE AS value FROM ledger GROUP BY status UNION ALL SELECT 'assigned', worker_id, count(*)::DOUBLE FROM ledger WHERE worker_id <> '' GROUP BY 2
UNION ALL SELECT 'active_workers', '', count(*)::DOUBLE FROM workers""")
def metric_snapshot(spark, sf_dir):
    return metrics.snapshot(ledger(spark, sf_dir), workers(spark, sf_dir))


@query(LEDGER + f"SELECT worker_id, max(last_heartbeat) AS last_beat, coalesce(max(last_heartbeat) < {NOW_SQL} - INTERVAL 30 HOUR, true) AS is_stale FROM ledger WHERE worker_id <> '' GROUP BY 1")
def heartbeat_alert(spark, sf_dir):
    beats = ledger(spark, sf_dir).filter("worker_id <> ''").groupBy("worker_id").agg(F.max("last_heartbeat").alias("last_beat"))
    return beats.withColumn("is_stale", F.coalesce(F.col("last_beat") < now() - F.expr("INTERVAL 30 HOURS"), F.lit(True)))


@query(EVERY_ORDER + ", others AS (SELECT c_custkey AS partition_id, c_custkey * 500 AS min_id, c_custkey * 500 + c_custkey % 400 AS max_id FROM customer) SELECT a.partition_id AS a_id, b.partition_id AS b_id FROM ranges a JOIN others b ON a.min_id <= b.max_id AND b.min_id <= a.max_id")
def range_overlaps_every_order(spark, sf_dir):
    low = F.col("c_custkey") * 500
    others = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("partition_id"), low.alias("min_id"), (low + F.col("c_custkey") % 400).alias("max_id"))
    return gaps.overlaps(every_order(spark, sf_dir), others, size=100)


@query("WITH ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), n AS (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM ids) SELECT id + 1 AS start_id, nxt - 1 AS end_id FROM n WHERE id + 1 < nxt AND NOT (id + 1 <= 400 AND nxt - 1 <= 400)")
def gaps_unconfirmed(spark, sf_dir):
    return gaps.unconfirmed(gaps.id_gaps(read(spark, sf_dir, "lineitem"), "l_orderkey"), 400)


@query(RANGES + "SELECT * FROM ranges ORDER BY partition_id DESC LIMIT 20")
def range_cache_trim(spark, sf_dir):
    """The limit is the feature: the newest ranges."""
    return gaps.newest(numbered_islands(spark, sf_dir), 20).select("partition_id", "min_id", "max_id")


@query("SELECT true AS same")
def worker_sets_equal(spark, sf_dir):
    names = workers(spark, sf_dir)
    return assign.same_set(names, names.orderBy(F.desc("worker_id")), "worker_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN event_id % 2 = 0 THEN 'added' END AS c FROM events WHERE event_type = 'signup'")
def options_merge(spark, sf_dir):
    events = read(spark, sf_dir, "events").filter("event_type = 'signup'")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("added")))
    merged = scalars.merge_options(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")), new)
    return events.select("event_id", merged.alias("o")).select("event_id", *[F.try_element_at("o", F.lit(k)).alias(k) for k in "abc"])


@query("""WITH s AS (SELECT 'worker-' || (user_id % 40) AS worker_id, ts, event_id, event_type FROM events WHERE event_type IN ('signup', 'error')), r AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, event_id DESC) AS n, min(ts) FILTER (event_type = 'signup') OVER (PARTITION BY worker_id) AS register_time FROM s)
SELECT worker_id, register_time, CASE WHEN event_type = 'error' THEN ts END AS stop_time FROM r WHERE n = 1""")
def worker_registry(spark, sf_dir):
    """Registrations and stops as a log: the first registration and, if a stop came last, its time; rows of stopped workers stay."""
    log = read(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "error")).select(F.concat(F.lit("worker-"), (F.col("user_id") % 40).cast("string")).alias("worker_id"), "ts", "event_id", "event_type")
    first = log.filter("event_type = 'signup'").groupBy("worker_id").agg(F.min("ts").alias("register_time"))
    last = led.latest(log, "worker_id", ["ts", "event_id"]).select("worker_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("stop_time"))
    return last.join(first, "worker_id", "left").select("worker_id", "register_time", "stop_time")


@query("SELECT user_id, count(*) AS n FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.event_id = e.event_id + 1) GROUP BY 1")
def queue_remaining(spark, sf_dir):
    """Queue length per user: items put in (views) less those taken out (a purchase as the next event)."""
    events = read(spark, sf_dir, "events")
    taken = events.filter("event_type = 'purchase'").select((F.col("event_id") - 1).alias("event_id"))
    return events.filter("event_type = 'view'").join(taken, "event_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS counter, cast(sum(event_id % 5) AS BIGINT) AS value FROM events GROUP BY 1")
def counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("counter")).agg(F.sum(F.col("event_id") % 5).alias("value"))


@query("SELECT worker_id, cast(sum(items) AS BIGINT) AS items, cast(sum(seconds) AS BIGINT) AS seconds, CASE WHEN sum(seconds) > 0 THEN sum(items) / sum(seconds) END AS per_second, count(*) FILTER (ok) / count(*) AS success FROM (SELECT 'worker-' || (event_id % 7) AS worker_id, user_id AS items, event_id % 60 AS seconds, event_type <> 'error' AS ok FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY 1")
def worker_speed(spark, sf_dir):
    done = read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return led.worker_speed(done.select(F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string")).alias("worker_id"), F.col("user_id").alias("items"), (F.col("event_id") % 60).alias("seconds"), (F.col("event_type") != "error").alias("ok")))


@query("""WITH e AS (SELECT user_id % 3 AS lock_id, 'worker-' || (event_id % 7) AS owner, ts, event_id AS seq FROM events WHERE event_type = 'signup'), c AS (SELECT *, lag(owner) OVER (PARTITION BY lock_id ORDER BY ts, seq) AS before FROM e),
d AS (SELECT * FROM c WHERE owner IS DISTINCT FROM before) SELECT lock_id, owner, ts AS since, lead(ts) OVER (PARTITION BY lock_id ORDER BY ts, seq) AS until FROM d""")
def lock_owner_timeline(spark, sf_dir):
    log = read(spark, sf_dir, "events").filter("event_type = 'signup'").select((F.col("user_id") % 3).alias("lock_id"), F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string")).alias("owner"), "ts", F.col("event_id").alias("seq"))
    return led.owner_spans(log, "lock_id", "owner")


# --- tasks for all workers at once, holds, owners' updates, update modes


def _fleet(spark):
    return spark.createDataFrame([(f"worker-{i}",) for i in range(7)], "worker_id string")


_ORDER_LEDGER = """WITH RECURSIVE workers AS (SELECT 'worker-' || i AS worker_id FROM range(7) t(i)),
points AS (SELECT w.worker_id, unnest([w.worker_id || ':' || i, i || ':' || w.worker_id]) AS key FROM workers w, range(50) r(i)),
"""


@query(_ORDER_LEDGER + f"""ring AS (SELECT {H32.format("key")} AS h, max(worker_id) AS worker_id FROM points GROUP BY 1),
pending AS (SELECT o_orderkey AS partition_id FROM orders WHERE o_orderstatus = 'O'),
assigned AS (SELECT partition_id, arg_min(ring.worker_id, CASE WHEN h >= {H32.format("partition_id::VARCHAR")} THEN h ELSE h + 4294967296 END) AS worker_id FROM pending, ring GROUP BY partition_id)
SELECT worker_id, 'ring' AS policy, min(partition_id)::BIGINT AS partition_id, 'acquired' AS outcome FROM assigned GROUP BY worker_id""")
def pick_pending_tasks(spark, sf_dir):
    """Open orders as pending ranges: many, so that the ring decides."""
    status = F.create_map(*[F.lit(x) for x in ("O", "pending", "F", "running", "P", "claimed")])[F.col("o_orderstatus")]
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("partition_id"), status.alias("status"), F.when(F.col("o_orderstatus") == "O", "").otherwise("worker-1").alias("worker_id"), now().alias("updated_at"), now().alias("last_heartbeat"))
    return assign.pick(rows, _fleet(spark), now(), HOUR)


@query(LEDGER + f""", workers AS (SELECT 'worker-' || i AS worker_id FROM range(7) t(i)),
stale AS (SELECT status, worker_id AS owner, partition_id, CASE status WHEN 'claimed' THEN updated_at ELSE last_heartbeat END AS since FROM ledger
    WHERE last_heartbeat < {NOW_SQL} - INTERVAL 5 MINUTE AND ((status = 'claimed' AND updated_at < {NOW_SQL} - INTERVAL 24 HOUR) OR (status = 'running' AND last_heartbeat < {NOW_SQL} - INTERVAL 60 HOUR))),
best AS (SELECT w.worker_id, arg_min(partition_id, {{'t': since, 'p': partition_id}}) FILTER (status = 'claimed') AS claimed, arg_min(partition_id, {{'t': since, 'p': partition_id}}) FILTER (status = 'running') AS running FROM workers w LEFT JOIN stale s ON s.owner <> w.worker_id GROUP BY 1),
wanted AS (SELECT worker_id, CASE WHEN claimed IS NOT NULL THEN 'claimed' WHEN running IS NOT NULL THEN 'running' ELSE 'none' END AS policy, coalesce(claimed, running) AS partition_id FROM best)
SELECT worker_id, policy, partition_id, CASE WHEN partition_id IS NULL THEN 'none' WHEN worker_id = min(worker_id) OVER (PARTITION BY partition_id) THEN 'acquired' ELSE 'conflict' END AS outcome FROM wanted""")
def pick_reclaimed_tasks(spark, sf_dir):
    """Nothing pending: stale ranges of others are taken."""
    return assign.pick(ledger(spark, sf_dir).filter("status <> 'pending'"), _fleet(spark), now(), 12 * HOUR)


_ASKED = LEDGER + ", asked AS (SELECT partition_id + d AS partition_id, CASE WHEN partition_id % 2 = 0 THEN worker_id ELSE 'worker-' || (partition_id % 7) END AS worker_id, partition_id % 3 AS k FROM ledger, (VALUES (0), (100000)) t(d) WHERE worker_id <> '')\n"


def _asked(spark, sf_dir):
    """Requests for every owned range, half of them by its owner, and as many for ranges that don't exist."""
    rows = ledger(spark, sf_dir)
    own = F.when(F.col("partition_id") % 2 == 0, F.col("worker_id")).otherwise(F.concat(F.lit("worker-"), (F.col("partition_id") % 7).cast("string")))
    owned = rows.filter("worker_id <> ''").select("partition_id", own.alias("worker_id"), (F.col("partition_id") % 3).alias("k"))
    return rows, owned.unionByName(owned.withColumn("partition_id", F.col("partition_id") + 100000))


@query(_ASKED + f"""SELECT a.partition_id, a.worker_id, CASE WHEN l.worker_id IS NULL THEN 'missing' WHEN l.worker_id <> a.worker_id THEN 'denied' WHEN status IN ('claimed', 'running') THEN 'renewed' ELSE 'idle' END AS outcome,
CASE WHEN l.worker_id = a.worker_id AND status IN ('claimed', 'running') THEN {NOW_SQL} ELSE last_heartbeat END AS last_heartbeat, version + CASE WHEN l.worker_id = a.worker_id AND status IN ('claimed', 'running') THEN 1 ELSE 0 END AS version
FROM asked a LEFT JOIN ledger l USING (partition_id)""")
def maintain_holds(spark, sf_dir):
    rows, asked = _asked(spark, sf_dir)
    return transitions.maintain(rows, asked, now())


def _status_requests(spark, sf_dir):
    rows, asked = _asked(spark, sf_dir)
    status = F.when(F.col("k") == 0, "completed").when(F.col("k") == 1, "failed").otherwise("running")
    options = F.create_map(F.lit("error"), F.concat(F.lit("e"), F.col("partition_id").cast("string")))
    requests = asked.select("partition_id", "worker_id", status.alias("status"), options.alias("options"))
    return transitions.update_status(rows.withColumn("options", F.lit(None).cast("map<string,string>")), requests, now())


@query(_ASKED + "SELECT a.partition_id, a.worker_id, CASE WHEN l.worker_id IS NULL THEN 'missing' WHEN l.worker_id <> a.worker_id THEN 'denied' WHEN k = 0 THEN 'archived' ELSE 'updated' END AS outcome FROM asked a LEFT JOIN ledger l USING (partition_id)")
def status_by_owner(spark, sf_dir):
    return _status_requests(spark, sf_dir)[2]


@query(_ASKED + f""", j AS (SELECT l.*, k, coalesce(a.worker_id = l.worker_id, false) AS hit FROM ledger l LEFT JOIN asked a USING (partition_id))
SELECT partition_id, CASE WHEN hit AND k = 0 THEN 'archived' ELSE 'active' END AS tier, CASE WHEN NOT hit THEN status WHEN k = 0 THEN 'completed' WHEN k = 1 THEN 'failed' ELSE 'running' END AS status, version + CASE WHEN hit AND k > 0 THEN 1 ELSE 0 END AS version,
CASE WHEN hit AND k = 1 THEN 'e' || partition_id ELSE error END AS error, CASE WHEN hit THEN {NOW_SQL} ELSE updated_at END AS updated_at, CASE WHEN hit AND k = 2 THEN {NOW_SQL} ELSE last_heartbeat END AS last_heartbeat FROM j""")
def status_tiers(spark, sf_dir):
    """Both tiers after owners' status changes: what is completed has left the active one."""
    active, done, _ = _status_requests(spark, sf_dir)
    rows = active.withColumn("tier", F.lit("active")).unionByName(done.withColumn("tier", F.lit("archived")))
    return rows.select("partition_id", "tier", "status", "version", "error", "updated_at", "last_heartbeat")


_MODES = LEDGER + """, given AS (SELECT partition_id + d AS partition_id, ['force', 'expected', 'upsert', 'auto'][partition_id % 4 + 1] AS mode, CASE WHEN d > 0 THEN 0 WHEN partition_id % 3 = 0 THEN version ELSE version - 1 END AS expected,
    CASE WHEN partition_id % 8 = 0 THEN 0 WHEN partition_id % 5 = 0 THEN version - 1 ELSE version END AS version, min_id, max_id + 7 AS max_id FROM ledger, (VALUES (0), (100000)) t(d)),
o AS (SELECT g.*, l.version AS old, l.status AS old_status, l.worker_id AS old_worker, l.max_id AS old_max, l.updated_at AS old_updated, l.created_at AS old_created,
    CASE WHEN mode = 'force' THEN 'saved' WHEN l.version IS NULL THEN CASE WHEN mode = 'auto' THEN 'missing' ELSE 'created' END WHEN mode = 'upsert' OR (mode = 'expected' AND expected = l.version) OR (mode = 'auto' AND g.version = l.version) THEN 'updated' ELSE 'stale' END AS outcome FROM given g LEFT JOIN ledger l USING (partition_id))
"""


def _modes(spark, sf_dir):
    """A whole-row update of every range and of as many that don't exist, each by one of the four modes."""
    rows, pid = ledger(spark, sf_dir), F.col("partition_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("force", "expected", "upsert", "auto")]), (pid % 4 + 1).cast("int"))
    none = F.lit(None).cast("timestamp_ntz")
    expected = F.when(pid % 3 == 0, F.col("version")).otherwise(F.col("version") - 1)
    version = F.when(pid % 8 == 0, 0).when(pid % 5 == 0, F.col("version") - 1).otherwise(F.col("version"))
    given = rows.select(pid, mode.alias("mode"), expected.alias("expected"), version.alias("version"), "min_id", (F.col("max_id") + 7).alias("max_id"), F.lit("worker-9").alias("worker_id"), none.alias("last_heartbeat"), F.lit("running").alias("status"), none.alias("updated_at"), F.lit(None).cast("string").alias("error"), none.alias("created_at"))
    return rows, given.unionByName(given.withColumns({"partition_id": pid + 100000, "expected": F.lit(0).cast("long")}))


@query(_MODES + f"""SELECT partition_id, outcome, CASE outcome WHEN 'saved' THEN 'running' WHEN 'updated' THEN 'running' WHEN 'created' THEN 'pending' ELSE old_status END AS status, CASE outcome WHEN 'saved' THEN 'worker-9' WHEN 'updated' THEN 'worker-9' WHEN 'created' THEN '' ELSE old_worker END AS worker_id,
CASE outcome WHEN 'saved' THEN CASE WHEN version = 0 THEN 1 ELSE version END WHEN 'updated' THEN old + 1 WHEN 'created' THEN 1 ELSE old END AS version, CASE WHEN outcome IN ('saved', 'updated', 'created') THEN max_id ELSE old_max END AS max_id,
CASE WHEN outcome IN ('saved', 'updated', 'created') THEN {NOW_SQL} ELSE old_updated END AS updated_at, CASE WHEN outcome IN ('saved', 'created') THEN {NOW_SQL} WHEN outcome = 'updated' THEN NULL ELSE old_created END AS created_at FROM o""")
def update_modes(spark, sf_dir):
    rows, given = _modes(spark, sf_dir)
    return transitions.update(rows, given, now()).select("partition_id", "outcome", "status", "worker_id", "version", "max_id", "updated_at", "created_at")


@query(_MODES + f"""SELECT partition_id, 'running' AS status, CASE WHEN version = 0 THEN 1 ELSE version END AS version, max_id, {NOW_SQL} AS updated_at FROM given WHERE mode = 'force'
UNION ALL SELECT partition_id, status, version, max_id, updated_at FROM ledger WHERE partition_id NOT IN (SELECT partition_id FROM given WHERE mode = 'force')""")
def blind_save(spark, sf_dir):
    rows, given = _modes(spark, sf_dir)
    return transitions.save(rows, given.filter("mode = 'force'"), now()).select("partition_id", "status", "version", "max_id", "updated_at")


@query(_plan_sql(70).replace("SELECT 1 + i AS partition_id", ", p AS (SELECT 1 + i AS partition_id").replace(" FROM i", " FROM i) SELECT (partition_id - 1) // 50 + 1 AS batch_no, count(*) AS n, max(partition_id) AS max_partition_id, max(max_id) AS max_data_id FROM p GROUP BY 1", 1).replace("FROM b)\n, p", "FROM b), p"))
def create_batch_totals(spark, sf_dir):
    """What the counters take from each batch of new ranges."""
    rows = transitions.batches(_plan(spark, sf_dir, 70))
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.max("partition_id").alias("max_partition_id"), F.max("max_id").alias("max_data_id"))


@query("""SELECT 'sized' AS source, (SELECT coalesce(max(id), 200) FROM (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey > 200 ORDER BY 1 LIMIT 1200)) AS next_max_id
UNION ALL SELECT 'unknown', (SELECT coalesce(max(id), 200) FROM (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey > 200 ORDER BY 1 LIMIT 10000))""")
def next_processing_range(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    found = [planner.next_range(planner.RangeSource(orders, "o_orderkey", size), 200, 4, 3).select(F.lit(name).alias("source"), "next_max_id") for name, size in (("sized", 100), ("unknown", None))]
    return found[0].unionByName(found[1])


@query("SELECT * FROM (VALUES ('12', 12), ('-7', -7), ('', 0), ('x1', 0), ('9223372036854775807', 9223372036854775807), ('99999999999999999999', 0), (NULL, 0)) t(txt, n)")
def parsed_counters(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("12", "-7", "", "x1", "9223372036854775807", "99999999999999999999", None)], "txt string")
    return rows.select("txt", scalars.int_or_zero(F.col("txt")).alias("n"))


@query(LEDGER + "SELECT partition_id, (epoch_us(updated_at) * 1000)::DOUBLE AS score FROM ledger")
def queue_scores(spark, sf_dir):
    return ledger(spark, sf_dir).select("partition_id", scalars.score(F.col("updated_at")).alias("score"))


@query("SELECT event_id, 'cmd-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || substr(sha256(event_id || chr(0) || event_type), 1, 6) AS command_id, 'node-' || substr(sha256(user_id::VARCHAR), 1, 8) AS node_id FROM events WHERE event_type = 'error'")
def content_ids(spark, sf_dir):
    return read(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", hashing.command_id(F.col("ts"), F.col("event_id"), F.col("event_type")).alias("command_id"), hashing.short_id("node-", F.col("user_id")).alias("node_id"))


@query("""WITH e AS (SELECT user_id % 3 AS lock_id, 'worker-' || (event_id % 7) AS owner, ts, event_id AS seq FROM events WHERE event_type = 'signup'), l AS (SELECT lock_id, ts, arg_max(owner, seq) AS owner FROM e GROUP BY 1, 2),
t AS (SELECT user_id % 3 AS lock_id, ts, event_id FROM events WHERE event_type = 'purchase') SELECT t.lock_id, t.ts, t.event_id, l.owner FROM t ASOF LEFT JOIN l ON t.lock_id = l.lock_id AND t.ts >= l.ts""")
def leader_at(spark, sf_dir):
    """Who held each lock when a purchase came."""
    events = read(spark, sf_dir, "events").withColumn("lock_id", F.col("user_id") % 3)
    log = events.filter("event_type = 'signup'").select("lock_id", F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string")).alias("owner"), "ts", F.col("event_id").alias("seq"))
    return led.holder_at(log, events.filter("event_type = 'purchase'").select("lock_id", "ts", "event_id"), "lock_id", "owner")


_ALLOCATE = LEDGER + ", s AS (SELECT max(max_id) AS top, max(partition_id) AS pid FROM ledger), f AS (SELECT coalesce(max(id), (SELECT top FROM s)) AS nxt FROM (SELECT DISTINCT o_custkey * 1000 AS id FROM orders WHERE o_custkey * 1000 > (SELECT top FROM s) ORDER BY 1 LIMIT 40))\n"


@query(_ALLOCATE + ", n AS (SELECT *, (nxt - top + 499) // 500 AS n FROM s, f WHERE nxt > top), i AS (SELECT *, unnest(range(0, n)) AS i FROM n) SELECT pid + 1 + i AS partition_id, top + i * 500 + 1 AS min_id, CASE WHEN i = n - 1 THEN nxt ELSE top + (i + 1) * 500 END AS max_id FROM i")
def allocate_next(spark, sf_dir):
    """The next ranges over a sparse id space (customers of orders, 1,000 apart) above what the ledger covers."""
    ids = read(spark, sf_dir, "orders").select((F.col("o_custkey") * 1000).alias("id"))
    return planner.allocate(spark, ledger(spark, sf_dir), planner.RangeSource(ids, "id", 500), 40, threshold=10**9)


@query(LEDGER + """, thin AS (SELECT * FROM ledger WHERE partition_id % 3 <> 1), gaps AS (SELECT max_id + 1 AS start_id, nxt - 1 AS end_id FROM (SELECT *, lead(min_id) OVER (ORDER BY min_id) AS nxt FROM thin) WHERE max_id + 1 < nxt),
ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey <= (SELECT max(max_id) FROM thin)), tiles AS (SELECT a AS min_id, least(a + 39, end_id) AS max_id FROM (SELECT end_id, unnest(generate_series(start_id, end_id, 40)) AS a FROM gaps)),
kept AS (SELECT * FROM tiles t WHERE EXISTS (SELECT 1 FROM ids WHERE id > t.min_id AND id <= t.max_id))
SELECT (SELECT max(partition_id) FROM thin) + row_number() OVER (ORDER BY min_id) AS partition_id, min_id, max_id FROM kept""")
def allocate_fillers(spark, sf_dir):
    """Nothing lies above the ledger, a third of which is missing: the gaps that hold ids are planned."""
    thin = ledger(spark, sf_dir).filter("partition_id % 3 <> 1")
    top = thin.agg(F.max("max_id").alias("top"))
    ids = read(spark, sf_dir, "lineitem").join(F.broadcast(top), F.col("l_orderkey") <= F.col("top"), "left_semi").select(F.col("l_orderkey").alias("id"))
    return planner.allocate(spark, thin, planner.RangeSource(ids, "id", 40), 1000, threshold=10**9)


@query("SELECT 0 AS n_ranges")
def allocate_under_pressure(spark, sf_dir):
    return planner.allocate(spark, ledger(spark, sf_dir), planner.RangeSource(read(spark, sf_dir, "orders"), "o_orderkey", 100), 1000, threshold=1).agg(F.count(F.lit(1)).cast("int").alias("n_ranges"))


@query(LEDGER + "SELECT partition_id, min_id, max_id, worker_id, status, version FROM ledger")
def ledger_json_map_scan(spark, sf_dir):
    """The ledger kept as JSON maps of partition id to row, one map per ten ids."""
    rows = ledger(spark, sf_dir)
    entries = rows.groupBy(F.floor(F.col("partition_id") / 10).alias("g")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("partition_id").cast("string"), F.struct(*rows.columns)))).alias("m"))  # ten rows a map
    return ledger_from_json_map(entries.select(F.to_json("m").alias("value"))).select("partition_id", "min_id", "max_id", "worker_id", "status", "version")


# --- compressed batches


@query(LEDGER + "SELECT partition_id, min_id, max_id, worker_id, status, error, cast(date_trunc('second', updated_at) AS TIMESTAMP) AS updated_at FROM ledger WHERE status = 'completed'")
def archive_every_tier(spark, sf_dir):
    """Finished ranges from both archive tiers: those of the compression plan out of their batches, the others as rows."""
    done = archive.tiers(ledger(spark, sf_dir))[1]
    codes = archive.worker_dictionary(_registered(spark, sf_dir))
    plan = archive.compression_plan(done, threshold=12, batch=5)
    columns = ["partition_id", "min_id", "max_id", "worker_id", "status", "error"]
    packed = archive.decompress(archive.compress(done, plan, codes), codes).select(*columns, F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    loose = done.join(plan, "partition_id", "left_anti").select(*columns, F.date_trunc("second", "updated_at").cast("timestamp_ntz").alias("updated_at"))
    return loose.unionByName(packed)


@query(LEDGER + "SELECT count(*) AS n_rows, cast(sum(29 + coalesce(strlen(error), 0)) AS BIGINT) AS binary_bytes, count(DISTINCT partition_id // 64) AS n_batches FROM ledger")
def batch_binary_bytes(spark, sf_dir):
    blobs = _archive_round(spark, sf_dir)[0]
    return blobs.agg(F.sum("partition_count").alias("n_rows"), F.sum("binary_bytes").alias("binary_bytes"), F.count(F.lit(1)).alias("n_batches"))


@query(LEDGER + """SELECT partition_id // 64 + 1 AS batch_no, count(*) AS partition_count, count(*) AS readable, true AS ok, NULL::VARCHAR AS problem FROM ledger GROUP BY 1
UNION ALL SELECT 1000000 + partition_id // 64 + 1, count(*) + 1, count(*), false, 'count' FROM ledger GROUP BY partition_id // 64 UNION ALL SELECT 2000000 + partition_id // 64 + 1, count(*), 0, false, 'unreadable' FROM ledger GROUP BY partition_id // 64""")
def batch_integrity(spark, sf_dir):
    """Sound batches, such of a wrong count, and cut ones."""
    blobs = _archive_round(spark, sf_dir)[0]
    miscounted = blobs.withColumns({"batch_no": F.col("batch_no") + 1000000, "partition_count": F.col("partition_count") + 1})
    broken = blobs.withColumns({"batch_no": F.col("batch_no") + 2000000, "compressed_data": F.expr("substring(compressed_data, 1, length(compressed_data) - 9)")})
    return archive.integrity(blobs.unionByName(miscounted).unionByName(broken))


@query(LEDGER + "SELECT partition_id, min_id, max_id, worker_id, status, error FROM ledger WHERE partition_id IN (3, 64, 65, 100, 149)")
def compressed_search(spark, sf_dir):
    blobs, codes = _archive_round(spark, sf_dir)
    return archive.search(blobs, [149, 3, 64, 65, 100, -1, 10**9], codes).select("partition_id", "min_id", "max_id", "worker_id", "status", "error")


# --- metrics by label

_RUNS = "SELECT 'worker-' || (event_id % 7) AS worker_id, value::DECIMAL(20, 6) AS v, user_id AS items, event_type = 'purchase' AS ok, 'kind-' || (user_id % 2) AS error_type FROM events WHERE event_type IN ('purchase', 'error')"


def _histogram_sql(metric: str, source: str, buckets: tuple, by: str = "") -> str:
    le = ", ".join(f"('{b:g}', {b}::DOUBLE)" for b in buckets)
    group, label, both = ("GROUP BY worker_id", "'worker_id=' || worker_id", "',worker_id=' || worker_id") if by else ("GROUP BY ALL", "''", "''")
    return f"""SELECT '{metric}_bucket' AS metric, 'le=' || le || {both} AS labels, count(*) FILTER (v <= b)::DOUBLE AS value FROM {source}, (VALUES {le}, ('+Inf', 'inf'::DOUBLE)) t(le, b) GROUP BY le{", worker_id" if by else ""}
UNION ALL SELECT '{metric}_sum', {label}, sum(v)::DOUBLE FROM {source} {group} UNION ALL SELECT '{metric}_count', {label}, count(v)::DOUBLE FROM {source} {group}"""


@query(LEDGER + f""", workers AS (SELECT DISTINCT worker_id FROM ledger WHERE worker_id <> ''), runs AS ({_RUNS}), plans AS (SELECT value::DECIMAL(20, 6) AS v FROM events WHERE event_type = 'view'),
beats AS (SELECT 'worker-' || (event_id % 7) AS worker_id, ts, event_id % 5 <> 0 AS ok FROM events WHERE event_type = 'click')
SELECT 'is_leader' AS metric, 'worker_id=' || worker_id AS labels, CASE WHEN worker_id = 'worker-3' THEN 1 ELSE 0 END::DOUBLE AS value FROM workers
UNION ALL SELECT 'partitions_total', '', count(*)::DOUBLE FROM ledger UNION ALL SELECT 'partitions_assigned_total', '', count(*)::DOUBLE FROM ledger WHERE worker_id <> ''
UNION ALL {_histogram_sql("partitions_assignment_duration_seconds", "plans", metrics.ASSIGNMENT_BUCKETS)}
UNION ALL SELECT 'active_workers_count', '', count(*)::DOUBLE FROM workers UNION ALL SELECT 'node_heartbeat_timestamp_seconds', 'worker_id=' || worker_id, floor(epoch(max(ts)))::DOUBLE FROM beats WHERE ok GROUP BY worker_id
UNION ALL SELECT 'node_heartbeat_errors_total', 'worker_id=' || worker_id, count(*)::DOUBLE FROM beats WHERE NOT ok GROUP BY worker_id
UNION ALL SELECT 'node_info', 'go_version=1.22,os_type=linux,version=1.0,worker_id=' || worker_id, 1::DOUBLE FROM workers
UNION ALL SELECT 'node_task_queue_active_tasks', 'worker_id=worker-' || (partition_id % 7), count(*)::DOUBLE FROM ledger WHERE status = 'pending' GROUP BY partition_id % 7
UNION ALL SELECT 'node_tasks_processed_total', 'worker_id=' || worker_id, count(*)::DOUBLE FROM runs WHERE ok GROUP BY worker_id UNION ALL SELECT 'node_tasks_processed_items_total', 'worker_id=' || worker_id, sum(items)::DOUBLE FROM runs WHERE ok GROUP BY worker_id
UNION ALL SELECT 'node_tasks_errors_total', 'error_type=' || error_type || ',worker_id=' || worker_id, count(*)::DOUBLE FROM runs WHERE NOT ok GROUP BY worker_id, error_type
UNION ALL {_histogram_sql("node_task_processing_duration_seconds", "runs", metrics.TASK_BUCKETS, "worker_id")}
UNION ALL {_histogram_sql("node_task_processor_duration_seconds", "runs", metrics.TASK_BUCKETS, "worker_id")}
UNION ALL SELECT 'node_circuit_breaker_tripped_total', 'breaker_name=main,worker_id=' || worker_id, count(*)::DOUBLE FROM runs WHERE NOT ok AND items % 3 = 0 GROUP BY worker_id""")
def metric_registry(spark, sf_dir):
    """All fifteen metrics as samples; purchases and errors are task runs, clicks heartbeats, views planning rounds."""
    events, rows, names = read(spark, sf_dir, "events"), ledger(spark, sf_dir), workers(spark, sf_dir)
    by = F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string")).alias("worker_id")
    seconds = F.col("value").cast("decimal(20,6)")
    runs = events.filter(F.col("event_type").isin("purchase", "error")).select(by, seconds.alias("seconds"), seconds.alias("processor_seconds"), F.col("user_id").alias("items"), (F.col("event_type") == "purchase").alias("ok"), F.concat(F.lit("kind-"), (F.col("user_id") % 2).cast("string")).alias("error_type"))
    return metrics.registry(
        leaders=names.withColumn("is_leader", F.col("worker_id") == "worker-3"),
        ledger=rows,
        plans=events.filter("event_type = 'view'").select(seconds.alias("seconds")),
        workers=names,
        beats=events.filter("event_type = 'click'").select(by, "ts", (F.col("event_id") % 5 != 0).alias("ok")),
        nodes=names.withColumns({"version": F.lit("1.0"), "go_version": F.lit("1.22"), "os_type": F.lit("linux")}),
        queue=rows.filter("status = 'pending'").select(F.concat(F.lit("worker-"), (F.col("partition_id") % 7).cast("string")).alias("worker_id")),
        runs=runs,
        trips=runs.filter("not ok and items % 3 = 0").withColumn("breaker_name", F.lit("main")),
    )


@query("SELECT 'worker-' || (event_id % 7) AS worker_id, time_bucket(INTERVAL 360 MINUTE, ts) AS window_start, cast(sum(user_id) AS BIGINT) AS increase, sum(user_id) * (60.0::DOUBLE / 360) AS per_hour FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def metric_rate_by_worker(spark, sf_dir):
    done = read(spark, sf_dir, "events").filter("event_type = 'purchase'").withColumn("worker_id", F.concat(F.lit("worker-"), (F.col("event_id") % 7).cast("string")))
    return metrics.rate_by(done, "worker_id", 360, F.col("user_id"))


@query("SELECT le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in metrics.ASSIGNMENT_BUCKETS) + ", ('inf'::DOUBLE)) b(le)")
def metric_assignment_histogram(spark, sf_dir):
    return metrics.histogram(read(spark, sf_dir, "events"), "value", metrics.ASSIGNMENT_BUCKETS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges over the line items' key space without those that hold nothing, each with its worker on the ring and its item count."""
    lines = read(spark, sf_dir, "lineitem")
    top = lines.agg(F.max("l_orderkey").alias("next_id"))
    plan = planner.plan_ranges(top.select(F.lit(0).cast("long").alias("last_id"), "next_id", F.lit(0).cast("long").alias("max_partition_id")), 100)
    plan = gaps.has_data(plan, lines, "l_orderkey", size=100, start_exclusive=False)
    names = spark.createDataFrame([(f"worker-{i}",) for i in range(7)], "worker_id string")
    return process.count_items(assign.prefer(plan, assign.ring(names)), lines, "l_orderkey", size=100)


@query(f"""WITH planned AS (SELECT 1 + i AS partition_id, i * 100 + 1 AS min_id, least((i + 1) * 100, (SELECT max(l_orderkey) FROM lineitem)) AS max_id FROM range((SELECT greatest(1, (max(l_orderkey) + 99) // 100) FROM lineitem)) t(i)),
points AS (SELECT 'worker-' || w AS worker_id, unnest(['worker-' || w || ':' || i, i || ':' || 'worker-' || w]) AS key FROM range(7) a(w), range(50) r(i)), ring AS (SELECT {H32.format("key")} AS h, max(worker_id) AS worker_id FROM points GROUP BY 1),
assigned AS (SELECT partition_id, arg_min(ring.worker_id, CASE WHEN h >= {H32.format("partition_id::VARCHAR")} THEN h ELSE h + 4294967296 END) AS worker_id FROM planned, ring GROUP BY partition_id),
counts AS (SELECT partition_id, count(*) AS n_items FROM planned JOIN lineitem ON l_orderkey BETWEEN min_id AND max_id GROUP BY 1)
SELECT partition_id, min_id, max_id, worker_id, n_items FROM planned JOIN assigned USING (partition_id) JOIN counts USING (partition_id)""")
def plan_assign_count(spark, sf_dir):
    return flagship(spark, sf_dir)


