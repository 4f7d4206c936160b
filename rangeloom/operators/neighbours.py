"""Next and previous rows in the order of a number, without a window over the whole table.

Rows are bucketed by value; windows run inside buckets, and a small table of one row per bucket carries values over the
edges. Buckets are of equal width where that deals the rows evenly, else they are cut at quantiles of a sample of the
keys, so that far outliers and clustered ids don't end up in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about; the least and the most number of buckets; rows up to which equal widths always do.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS, SMALL = 250_000, 64, 65_536, 2_000_000
#: Sampled keys per bucket; how many times its even share a bucket of equal width may hold.
SAMPLED, UNEVEN = 16, 4


@dataclass(frozen=True)
class Layout:
    """How keys fall into buckets: by equal widths over low..high, or by ascending ``cuts`` (the first key of each bucket but the first)."""

    low: int
    high: int
    buckets: int = LEAST_BUCKETS
    cuts: tuple[int, ...] | None = None

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // self.buckets))

    def of(self, key: int) -> int:
        return (key - self.low) // self.width if self.cuts is None else bisect_right(self.cuts, key)

    def bucket(self, key: Column) -> Column:
        if self.cuts is None:
            return F.floor((key - F.lit(self.low)) / F.lit(self.width)).cast("long")
        # A binary search over one literal; the number of steps is the logarithm of the number of buckets.
        n = len(self.cuts)
        held = F.split(F.lit(",".join(map(str, self.cuts))), ",").cast("array<bigint>")
        steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at)).cast("long")

    def negated(self) -> Layout:
        """For the keys' negatives."""
        return replace(self, low=-self.high, high=-self.low, cuts=None if self.cuts is None else tuple(1 - c for c in reversed(self.cuts)))


def bounds_of(df: DataFrame, key: str) -> Layout:
    """The layout for the values of a column: the bounds of a stored one come from the file footers; large tables are sampled by a hash of the key."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if low is None:
        return Layout(0, 0, 1)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n // BUCKET_ROWS)))
    even = Layout(low, high, buckets)
    if n <= SMALL and high - low < 1 << 62:
        return even
    share = min(1.0, SAMPLED * buckets / n)
    hashed = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    sampled = df.select(F.col(key).cast("long").alias("k")).filter(F.col("k").isNotNull() & (hashed < int(share * (1 << 30)) + 1)).distinct()
    keys = sorted(sampled.toArrow().column("k").to_pylist())  # about SAMPLED per bucket, so bounded by MOST_BUCKETS
    if len(keys) < 2:
        return even
    counts: dict[int, int] = {}
    for k in keys:
        counts[even.of(k)] = counts.get(even.of(k), 0) + 1
    if max(counts.values()) * buckets <= UNEVEN * len(keys) + SAMPLED * buckets / 4 and high - low < 1 << 62:
        return even
    cuts = sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)})
    return Layout(low, high, len(cuts) + 1, tuple(cuts))


def bucketed(df: DataFrame, key: str, layout: Layout | None = None) -> DataFrame:
    """``df`` with ``__bucket``: the part of the key's range that a row falls in. A known ``layout`` saves a pass over ``df``; it may be that of a wider table."""
    return df.withColumn("__bucket", (layout or bounds_of(df, key)).bucket(F.col(key)))


_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}
_JOINS = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def sweep(df: DataFrame, key: str, ties: tuple[str, ...], following: dict[str, str], measures: dict[str, tuple[str, str]], *, bounds: Layout | None = None) -> DataFrame:
    """``with_next`` and ``running`` in one pass over the rows, in the order of ``key`` and ``ties``."""
    rows = bucketed(df, key, bounds)
    order = [key, *ties]
    inside = Window.partitionBy("__bucket").orderBy(*order)
    sofar = inside.rowsBetween(Window.unboundedPreceding, 0)
    values = F.struct(*[F.col(c).alias(n) for n, c in following.items()]) if following else F.struct(F.lit(0))
    edges = rows.groupBy("__bucket").agg(F.min_by(values, F.struct(*order)).alias("__first"), *[_KINDS[k](c).alias(f"__all_{n}") for n, (k, c) in measures.items()])
    across = Window.orderBy("__bucket")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("__bucket", F.lead("__first").over(across).alias("__over"), *[_KINDS[k](f"__all_{n}").over(earlier).alias(f"__before_{n}") for n, (k, _) in measures.items()])
    here = [*([F.lead(values).over(inside).alias("__next")] if following else []), *[_KINDS[k](c).over(sofar).alias(f"__here_{n}") for n, (k, c) in measures.items()]]
    out = rows.select("*", *here).join(F.broadcast(edges), "__bucket")  # at most MOST_BUCKETS rows
    found = [F.coalesce("__next", "__over")[n].alias(n) for n in following]
    return out.select(*df.columns, *found, *[_JOINS[k](F.col(f"__here_{n}"), F.col(f"__before_{n}")).alias(n) for n, (k, _) in measures.items()])


def with_next(df: DataFrame, key: str, values: dict[str, str], *, bounds: Layout | None = None) -> DataFrame:
    """Each row with ``new: column`` values of the row of next larger ``key`` (ties in any order); null at the end."""
    return sweep(df, key, (), values, {}, bounds=bounds)


def running(df: DataFrame, key: str, tie: str, measures: dict[str, tuple[str, str]], *, bounds: Layout | None = None) -> DataFrame:
    """Each row with running "sum", "max" or "min" of columns, itself included, in the order of ``key`` and ``tie``: {name: (kind, column)}."""
    return sweep(df, key, (tie,), {}, measures, bounds=bounds)


def ordinal(df: DataFrame, key: str, name: str, *, first: Column | int = 1, bounds: Layout | None = None) -> DataFrame:
    """Each row with its place in the order of ``key``, counted from ``first``."""
    rows = bucketed(df, key, bounds)
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(key))
    out = rows.withColumn("__place", place).join(F.broadcast(sizes), "__bucket")  # at most MOST_BUCKETS rows
    return out.select(*df.columns, (F.col("__place") + F.col("__before") + (F.lit(first) if isinstance(first, int) else first) - 1).cast("long").alias(name))
