"""Reading and writing ledgers, archives, commands and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "partition_id long, min_id long, max_id long, worker_id string, last_heartbeat timestamp_ntz, status string, updated_at timestamp_ntz, options map<string,string>, version long, error string, created_at timestamp_ntz"
ARCHIVE = LEDGER + ", tier string"
WORKERS = "worker_id string, register_time timestamp_ntz, stop_time timestamp_ntz"
COMMANDS = "id string, type string, timestamp long, status string, parameters map<string,string>, error string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only the columns and row groups that a query asks for are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_from_json(lines: DataFrame, column: str = "value", *, strict: bool = False) -> DataFrame:
    """Ledger rows from one JSON document each; bad ones are left out, or fail the query if ``strict``."""
    row = F.from_json(column, LEDGER, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return lines.select(row.alias("row")).filter("row is not null and row.partition_id is not null").select("row.*")


def ledger_from_json_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ledger rows from JSON maps of id to row; nothing from a missing map."""
    rows = F.from_json(column, f"map<string,struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _split(LEDGER))}>>")
    return lines.select(F.explode(F.map_values(rows)).alias("row")).select("row.*")


def _split(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


def to_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def append(rows: DataFrame, path: str) -> None:
    """One commit: all rows or none appear."""
    rows.write.mode("append").parquet(path)


def insert_new(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Appends rows whose partition id the table hasn't yet."""
    append(rows.join(spark.read.parquet(path).select("partition_id"), "partition_id", "left_anti").select(*rows.columns), path)


def archive(rows: DataFrame, path: str, tier: str = "archived") -> None:
    """Appends finished rows to a tier of the archive, a partition folder each, compressed with zstd."""
    rows.withColumn("tier", F.lit(tier)).write.mode("append").partitionBy("tier").option("compression", "zstd").parquet(path)


def read_archive(spark: SparkSession, path: str, tier: str | None = None) -> DataFrame:
    """The archive, or one tier, of which alone the files are read."""
    rows = spark.read.schema(ARCHIVE).parquet(path)
    return rows.filter(F.col("tier") == tier) if tier else rows


def keys_like(keys: DataFrame, pattern: str, prefix: str = "") -> DataFrame:
    """Keys that match a glob of ``*`` and ``?``, without their prefix."""
    like = (prefix + pattern).replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return keys.filter(F.col("key").like(like)).select(F.expr(f"substring(key, {len(prefix) + 1})").alias("key"))


def queue_head(items: DataFrame, k: int, score: str = "score", tie: str = "item") -> DataFrame:
    """The ``k`` items of lowest score; none for k of 0 or less."""
    return items.orderBy(score, tie).limit(k) if k > 0 else items.limit(0)
