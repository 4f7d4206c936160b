"""Tiers of finished ranges, their compression plan, worker dictionary and byte codec."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import STATUSES, relative_seconds, status_code
from .neighbours import ordinal

THRESHOLD, BATCH = 100_000, 50_000
#: Fixed value: the row layout, little-endian: id, first data id, width, worker code, status code, two times, error length.
ROW = struct.Struct("<IQIHBIIH")


def tiers(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, archive)."""
    done = F.col("status") == "completed"
    return ledger.filter(~done), ledger.filter(done)


def compression_plan(archive: DataFrame, *, threshold: int = THRESHOLD, batch: int = BATCH) -> DataFrame:
    """(partition_id, batch_no): rows to compress once there are more than ``threshold``: whole batches, oldest ids first, as many as the excess needs."""
    n = archive.count()
    full = -(-(n - threshold) // batch) if n > threshold else 0
    placed = ordinal(archive.select("partition_id"), "partition_id", "place").filter(F.col("place") <= full * batch)
    return placed.select("partition_id", F.expr(f"(place - 1) div {batch} + 1").alias("batch_no"))


def archive_stats(archive: DataFrame, plan: DataFrame, *, batch: int = BATCH) -> DataFrame:
    """One row: rows not compressed, batches, the estimate of compressed rows (whole batches), total, whether anything is compressed."""
    left = archive.join(plan, "partition_id", "left_anti").agg(F.count(F.lit(1)).alias("uncompressed_partitions"))
    packed = plan.agg(F.countDistinct("batch_no").alias("compressed_batches"))
    estimate = F.col("compressed_batches") * batch
    return left.join(F.broadcast(packed)).select("uncompressed_partitions", "compressed_batches", estimate.alias("estimated_compressed_partitions"), (F.col("uncompressed_partitions") + estimate).alias("total_estimated_partitions"), (F.col("compressed_batches") > 0).alias("compression_enabled"))


def worker_dictionary(workers: DataFrame) -> DataFrame:
    """(worker_id, code): 1-based by registration. Workers are few (machines), the window runs over them alone."""
    return workers.select("worker_id", F.row_number().over(Window.orderBy("register_time", "worker_id")).cast("long").alias("code"))


#: Codes have 16 bits, so a dictionary never grows beyond what can be broadcast.
MOST_WORKERS = 65_535


def _dictionary(codes: DataFrame) -> DataFrame:
    if codes.limit(MOST_WORKERS + 1).count() > MOST_WORKERS:
        raise ValueError(f"worker codes have 16 bits: at most {MOST_WORKERS} workers")
    return F.broadcast(codes)


def encode_workers(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows with their worker's code, 0 for no worker; an unknown worker is an error."""
    unknown = F.raise_error(F.concat(F.lit("worker without a code: "), F.col("worker_id"))).cast("long")
    return rows.join(_dictionary(codes), "worker_id", "left").withColumn("code", F.when(F.coalesce("worker_id", F.lit("")) == "", 0).otherwise(F.coalesce(F.col("code").cast("long"), unknown)))


def decode_workers(rows: DataFrame, codes: DataFrame) -> DataFrame:
    named = rows.join(_dictionary(codes), "code", "left")
    return named.withColumn("worker_id", F.when(F.col("code") == 0, "").otherwise(F.coalesce("worker_id", F.concat(F.lit("unknown_worker_"), F.col("code").cast("string")))))


def encode_row(r) -> bytes:
    """A row in the layout; the width counts both ends. What doesn't fit a field is an error, but for the error text: its 16-bit length holds 65,535 bytes, longer ones are cut at the end of a character."""
    error = (r.error or "").encode()[:65535].decode(errors="ignore").encode()
    width = r.max_id - r.min_id + 1
    for name, value, top in (("partition id", r.partition_id, 1 << 32), ("first data id", r.min_id, 1 << 64), ("width", width, 1 << 32), ("worker code", r.code, 1 << 16)):
        if not 0 <= value < top:
            raise ValueError(f"{name} {value} of range {r.partition_id} doesn't fit its field")
    return ROW.pack(r.partition_id, r.min_id, width, r.code, r.status_code, r.updated, r.created, len(error)) + error


def decode_rows(data: bytes) -> list[tuple]:
    """(partition_id, min_id, max_id, code, status, updated, created, error) of each row; version, options and heartbeat are not stored. Cut data is an error."""
    out, at = [], 0
    while at < len(data):
        pid, low, width, code, status, updated, created, size = ROW.unpack_from(data, at)
        at += ROW.size
        if at + size > len(data):
            raise struct.error("error text is cut")
        out.append((pid, low, low + width - 1, code, STATUSES[status] if status < len(STATUSES) else STATUSES[0], updated, created, data[at : at + size].decode(errors="replace") or None))
        at += size
    return out


def compress(archive: DataFrame, plan: DataFrame, codes: DataFrame) -> DataFrame:
    """(batch_no, base_timestamp, compressed_data, partition_count, json_bytes, binary_bytes, first_id, last_id): each batch of the plan as one gzip blob, with the partition ids it spans."""
    rows = encode_workers(archive.join(plan, "partition_id"), codes)
    base = rows.groupBy("batch_no").agg(F.min(F.unix_timestamp(F.col("created_at").cast("timestamp"))).alias("base"))
    rows = rows.join(base, "batch_no").select(
        "batch_no", "base", "partition_id", "min_id", "max_id", "code", status_code(F.col("status")).alias("status_code"), "error",
        relative_seconds(F.col("updated_at").cast("timestamp"), F.col("base")).alias("updated"), relative_seconds(F.col("created_at").cast("timestamp"), F.col("base")).alias("created"),
        F.length(F.to_json(F.struct(*archive.columns))).alias("json_bytes"),
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("partition_id")
        data = b"".join(encode_row(r) for r in frame.itertuples(index=False))
        row = (frame["batch_no"].iloc[0], frame["base"].iloc[0], gzip.compress(data, mtime=0), len(frame), int(frame["json_bytes"].sum()), len(data), frame["partition_id"].iloc[0], frame["partition_id"].iloc[-1])
        return pd.DataFrame([row], columns=["batch_no", "base_timestamp", "compressed_data", "partition_count", "json_bytes", "binary_bytes", "first_id", "last_id"])

    # A group is one batch, of bounded size by the plan.
    return rows.groupBy("batch_no").applyInPandas(run, "batch_no long, base_timestamp long, compressed_data binary, partition_count long, json_bytes long, binary_bytes long, first_id long, last_id long")


_UNREADABLE = (OSError, EOFError, struct.error, zlib.error, ValueError, TypeError)


def decompress(blobs: DataFrame, codes: DataFrame, *, skip_unreadable: bool = False) -> DataFrame:
    """The rows of batches. A batch that can't be read is an error, or with ``skip_unreadable`` left out: ``integrity`` names such batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["partition_id", "min_id", "max_id", "code", "status", "updated_at", "created_at", "error"]
        for frame in frames:
            for r in frame.itertuples(index=False):
                try:
                    rows = decode_rows(gzip.decompress(r.compressed_data))
                except _UNREADABLE as problem:
                    if skip_unreadable:
                        continue
                    raise ValueError(f"batch {r.batch_no} can't be read") from problem
                out = pd.DataFrame(rows, columns=names)
                out[["updated_at", "created_at"]] = out[["updated_at", "created_at"]] + r.base_timestamp
                yield out

    kinds = "partition_id long, min_id long, max_id long, code long, status string, updated_at long, created_at long, error string"
    rows = blobs.select("batch_no", "base_timestamp", "compressed_data").mapInPandas(run, kinds)
    return decode_workers(rows.withColumns({c: F.timestamp_seconds(c) for c in ("updated_at", "created_at")}), codes)


def integrity(blobs: DataFrame) -> DataFrame:
    """(batch_no, partition_count, readable, ok, problem) per batch: every row is decoded; ok if all are and as many as were stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                readable, problem = 0, None
                try:
                    readable = len(decode_rows(gzip.decompress(r.compressed_data)))
                    problem = None if readable == r.partition_count else "count"
                except _UNREADABLE:
                    problem = "unreadable"
                out.append((r.batch_no, r.partition_count, readable, problem is None, problem))
            yield pd.DataFrame(out, columns=["batch_no", "partition_count", "readable", "ok", "problem"])

    return blobs.select("batch_no", "partition_count", "compressed_data").mapInPandas(run, "batch_no long, partition_count long, readable long, ok boolean, problem string")


def search(blobs: DataFrame, ids: list[int], codes: DataFrame) -> DataFrame:
    """Rows of some partition ids in compressed batches. Only batches whose span holds one of them are decoded; the span is a filter that Parquet's statistics serve. Unreadable batches are passed over."""
    wanted = sorted({i for i in ids if i > 0})
    if not wanted:
        return decompress(blobs.filter("false"), codes)
    spans = F.exists(F.array(*[F.lit(i) for i in wanted]), lambda i: i.between(F.col("first_id"), F.col("last_id")))
    near = blobs.filter((F.col("last_id") >= wanted[0]) & (F.col("first_id") <= wanted[-1]) & spans)
    return decompress(near, codes, skip_unreadable=True).filter(F.col("partition_id").isin(*wanted))
