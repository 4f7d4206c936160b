"""Gaps, islands and fillers of integer ranges. Ranges are (partition_id, min_id, max_id), both ends inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import Layout, bounds_of, ordinal, running, sweep, with_next


def gaps_adjacent(ranges: DataFrame, bounds: Layout | None = None) -> DataFrame:
    """(start_id, end_id) between each range and the next by start; nested ranges can give false gaps (see ``gaps_covered``)."""
    out = with_next(ranges.select("min_id", "max_id"), "min_id", {"following": "min_id"}, bounds=bounds)
    return out.filter("max_id + 1 < following").select((F.col("max_id") + 1).alias("start_id"), (F.col("following") - 1).alias("end_id")).distinct()


def gaps_covered(ranges: DataFrame, bounds: Layout | None = None) -> DataFrame:
    """(start_id, end_id) that no range covers between the first start and the last: the running end counts."""
    out = sweep(ranges.select("min_id", "max_id"), "min_id", ("max_id",), {"following": "min_id"}, {"covered": ("max", "max_id")}, bounds=bounds)
    return out.filter("covered + 1 < following").select((F.col("covered") + 1).alias("start_id"), (F.col("following") - 1).alias("end_id")).distinct()


def id_gaps(ids: DataFrame, key: str) -> DataFrame:
    """Runs of missing ids between present ones."""
    keys = ids.select(F.col(key).alias("min_id")).na.drop().distinct()
    return gaps_adjacent(keys.withColumn("max_id", F.col("min_id")), bounds_of(ids, key))


def islands(ids: DataFrame, key: str) -> DataFrame:
    """(min_id, max_id, n_ids) of the maximal runs of consecutive ids."""
    keys = ids.select(F.col(key).alias("id")).na.drop().distinct()
    layout = bounds_of(ids, key)
    backward = with_next(keys.select((-F.col("id")).alias("__neg"), "id"), "__neg", {"previous": "id"}, bounds=layout.negated())
    starts = backward.filter("previous is null or previous < id - 1").select("id", "previous")
    ended = with_next(starts, "id", {"end": "previous"}, bounds=layout)
    return ended.select(F.col("id").alias("min_id"), F.coalesce("end", F.lit(layout.high)).cast("long").alias("max_id")).withColumn("n_ids", F.col("max_id") - F.col("min_id") + 1)


def contiguous_prefix(ranges: DataFrame, bounds: Layout | None = None) -> DataFrame:
    """(confirmed_max_id): the largest end of the run of ranges from the first start without a break, its last range left out; 0 if none."""
    out = with_next(ranges.select("min_id", "max_id"), "min_id", {"following": "min_id"}, bounds=bounds)
    place = out.filter("following is not null and max_id + 1 < following").agg(F.min("min_id")).first()[0]
    if place is None:
        place = ranges.agg(F.max("min_id")).first()[0]
    return ranges.filter(F.col("min_id") < F.lit(place)).agg(F.coalesce(F.max("max_id"), F.lit(0)).cast("long").alias("confirmed_max_id"))


def has_data(ranges: DataFrame, ids: DataFrame, key: str, *, low: str = "min_id", high: str = "max_id", size: int, start_exclusive: bool = True) -> DataFrame:
    """Ranges (at most ``size`` wide) that hold an id. The start doesn't count unless ``start_exclusive`` is off.

    A range meets the ids of at most two cells of width ``size``, so this is an equi-join on cells with a range filter.
    """
    cells = ids.select(F.col(key).alias("__id")).na.drop().distinct().withColumn("__cell", F.floor(F.col("__id") / size))
    tiles = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    begins = F.col("__id") > F.col(low) if start_exclusive else F.col("__id") >= F.col(low)
    hit = tiles.join(cells, (tiles["__cell"] == cells["__cell"]) & begins & (F.col("__id") <= F.col(high)), "left_semi")
    return hit.drop("__cell").distinct()


def split_gaps(gaps: DataFrame, ids: DataFrame, key: str, *, size: int, next_id: int, start_exclusive: bool = True) -> DataFrame:
    """Fillers (partition_id, min_id, max_id): gaps (which share no id) cut in tiles of ``size``; those with data are numbered on from ``next_id`` in order.

    The tiles come from the ids: a running pass finds the gap that each id lies in, so a gap costs nothing for its width.
    """
    edge, layout = "struct<at:long,end:long>", bounds_of(ids, key)
    starts = gaps.select(F.col("start_id").alias("at"), F.lit(0).alias("turn"), F.struct(F.col("start_id").alias("at"), F.col("end_id").alias("end")).cast(edge).alias("edge"))
    found = ids.select(F.col(key).cast("long").alias("at")).na.drop().distinct().select("at", F.lit(1).alias("turn"), F.lit(None).cast(edge).alias("edge"))
    inside = running(starts.unionByName(found), "at", "turn", {"gap": ("max", "edge")}, bounds=layout).filter((F.col("turn") == 1) & (F.col("at") <= F.col("gap.end")))
    tile = F.col("gap.at") + F.expr(f"(at - gap.at) div {size}") * size
    tiles = inside.select("at", tile.alias("min_id"), F.col("gap.end").alias("end"))
    tiles = tiles.filter("at > min_id") if start_exclusive else tiles
    kept = tiles.select("min_id", F.least("end", F.col("min_id") + size - 1).alias("max_id")).distinct()
    return ordinal(kept, "min_id", "partition_id", first=next_id, bounds=layout).select("partition_id", "min_id", "max_id")


def overlaps(a: DataFrame, b: DataFrame, *, size: int) -> DataFrame:
    """(a_id, b_id) of ranges that share an id, each pair once.

    A range has a level, by how many times its width holds ``size``, and lies in at most two cells of that level and of
    each wider one. A pair meets on the wider of its two levels, in the cell where its common part begins. Only levels
    that occur are laid out (64 at most).
    """

    def levelled(df: DataFrame, p: str) -> DataFrame:
        wide = F.greatest(F.lit(0), F.ceil(F.log2((F.col("max_id") - F.col("min_id") + 1) / F.lit(size)))).cast("int")
        return df.filter("max_id >= min_id").select(F.col("partition_id").alias(f"{p}_id"), F.col("min_id").alias(f"{p}_min"), F.col("max_id").alias(f"{p}_max"), wide.alias(f"{p}_level"))

    a, b = levelled(a, "a"), levelled(b, "b")
    levels = sorted({r[0] for df in (a, b) for r in df.select(df.columns[3]).distinct().collect()})

    def laid(df: DataFrame, p: str) -> DataFrame:
        steps = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(size << n).cast("long").alias("width")) for n in levels])
        on = df.withColumn("on", F.explode(F.filter(steps, lambda x: x["level"] >= F.col(f"{p}_level"))))
        cell = lambda c: F.expr(f"floor({c} / on.width)")
        return on.select(f"{p}_id", f"{p}_min", f"{p}_max", f"{p}_level", F.col("on.level").alias("level"), F.col("on.width").alias("width"), F.explode(F.sequence(cell(f"{p}_min"), cell(f"{p}_max"))).alias("cell"))

    if not levels:
        return a.join(b, a["a_id"] == b["b_id"]).select("a_id", "b_id")
    pairs = laid(a, "a").join(laid(b, "b").drop("width"), ["level", "cell"]).filter("a_min <= b_max and b_min <= a_max")
    return pairs.filter("level = greatest(a_level, b_level) and cell = floor(greatest(a_min, b_min) / width)").select("a_id", "b_id")


def unconfirmed(gaps_: DataFrame, confirmed: int) -> DataFrame:
    """Gaps that don't lie wholly at or below an id up to which the space is known to be whole."""
    return gaps_.filter(~((F.col("start_id") <= confirmed) & (F.col("end_id") <= confirmed)))


def newest(ranges: DataFrame, n: int = 500) -> DataFrame:
    """The ``n`` ranges of largest partition id, as the planner's range cache keeps them."""
    return ranges.orderBy(F.desc("partition_id")).limit(n)


def gaps_around_new(ranges: DataFrame, since: int, bounds: Layout | None = None) -> DataFrame:
    """Gaps that touch a range of partition id above ``since`` on either side."""
    out = with_next(ranges.select("partition_id", "min_id", "max_id"), "min_id", {"following": "min_id", "next_pid": "partition_id"}, bounds=bounds)
    out = out.filter((F.col("max_id") + 1 < F.col("following")) & ((F.col("partition_id") > since) | (F.col("next_pid") > since)))
    return out.select((F.col("max_id") + 1).alias("start_id"), (F.col("following") - 1).alias("end_id")).distinct()


def adjacent_ranges(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(probe_id, prev_id, next_id): per probe (probe_id, self_id, min_id, max_id) the nearest range before and after it.

    A range over the probe's start hides the previous side, one over its end the next side; the probe's own range
    (``self_id``, of the same bounds) counts for neither. One running pass over starts, ends and probes each way, so no pair
    of a probe and a far range ever meets.
    """
    none = F.lit(None).cast("struct<at:long,pid:long>")
    own = probes.join(ranges.select(F.col("partition_id").alias("self_id"), F.lit(1).alias("own")), "self_id", "left").select("probe_id", "min_id", "max_id", F.coalesce("own", F.lit(0)).alias("own"))
    start = ranges.select(F.col("min_id").alias("at"), F.struct(F.col("min_id").alias("at"), F.col("partition_id").alias("pid")).alias("edge"))
    end = ranges.select(F.col("max_id").alias("at"), F.struct(F.col("max_id").alias("at"), F.col("partition_id").alias("pid")).alias("edge"))

    def side(at: str, sign: int) -> DataFrame:
        """(probe_id, open, near): ranges open at the probe's bound, and the last edge passed on the way there."""
        enters, leaves = (start, end) if sign > 0 else (end, start)
        events = enters.select(F.col("at") * sign, F.lit(0).alias("turn"), F.lit(1).alias("step"), none.alias("edge"), F.lit(None).cast("long").alias("probe_id"), F.lit(0).alias("own"))
        events = events.union(own.select(F.col(at) * sign, F.lit(1), F.lit(0), none, "probe_id", "own"))
        events = events.union(leaves.select(F.col("at") * sign, F.lit(2), F.lit(-1), "edge", F.lit(None).cast("long"), F.lit(0))).toDF("at", "turn", "step", "edge", "probe_id", "own")
        passed = running(events, "at", "turn", {"open": ("sum", "step"), "near": ("max" if sign > 0 else "min", "edge")})
        return passed.filter("probe_id is not null").select("probe_id", F.when(F.col("open") <= F.col("own"), F.col("near")["pid"]).alias("near"))

    before, after = side("min_id", 1), side("max_id", -1)
    return before.withColumnRenamed("near", "prev_id").join(after.withColumnRenamed("near", "next_id"), "probe_id")
