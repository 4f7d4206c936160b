"""Small functions of the planner, the ledger and the archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SIZE = 3000
OVERFLOW_LOOK_AHEAD = 1_000_000
MIN_WORKERS = 3
#: Statuses in the order of their archive codes.
STATUSES = ("pending", "claimed", "running", "completed", "failed")


def effective_size(size: Column) -> Column:
    return F.when(size > 0, size).otherwise(F.lit(DEFAULT_SIZE)).cast("long")


def look_ahead(size: Column, workers: Column, multiple: Column) -> Column:
    """size * max(workers, 3) * multiple; a fixed look-ahead where a factor isn't positive or the product overflows."""
    product = F.try_multiply(F.try_multiply(size.cast("long"), F.greatest(workers, F.lit(MIN_WORKERS)).cast("long")), multiple.cast("long"))
    return F.when((size > 0) & (multiple > 0), F.coalesce(product, F.lit(OVERFLOW_LOOK_AHEAD))).otherwise(F.lit(OVERFLOW_LOOK_AHEAD)).cast("long")


def rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def score(ts: Column) -> Column:
    """Nanoseconds since 1970 as a double, by which queues and registers are ordered (a double tells about 256 ns apart)."""
    return (F.unix_micros(ts.cast("timestamp")) * 1000).cast("double")


def int_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("long"))


def status_code(status: Column) -> Column:
    """0 to 4; unknown statuses count as pending."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)])
    return F.coalesce(table[status], F.lit(0))


def status_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in STATUSES]), code), F.lit(STATUSES[0]))


def relative_seconds(ts: Column, base: Column) -> Column:
    """Seconds after ``base``; 0 outside the unsigned 32-bit range."""
    delta = F.unix_timestamp(ts) - base
    return F.when((delta >= 0) & (delta < 1 << 32), delta).otherwise(F.lit(0)).cast("long")


def merge_options(old: Column, new: Column) -> Column:
    """The keys of both maps; those of ``new`` win, none is deleted."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    left = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(left, new)
