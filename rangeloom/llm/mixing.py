"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import shuffle_width

#: Means above this are drawn as sums of equal smaller draws (sums of Poisson counts are Poisson).
LARGEST_MEAN = 16.0
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 10_000


def uniform(key: Column, seed: int, draw: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 digest of key, seed and draw."""
    text = F.concat_ws(":", key, F.lit(str(seed)), draw.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, *, weights: dict[str, float] | None = None, power: float = 0.7, rows: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy_no") -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, numbered by ``copy_col`` from 1, in shuffled order.

    A source's mean rate is its target share of ``rows`` (as many as come in, by default) over its own count; shares are
    ``weights`` (sources not named: none) or proportional to count ** ``power``. The count of a row inverts the Poisson
    distribution at a uniform hash of its id, so it depends on nothing but id, seed and rate. Rows are dealt to partitions
    and sorted in them by a hash of id and copy: a global shuffle in one exchange, whatever source or copy is frequent.
    A null source counts as the source ''. A row of null id draws by its text. Rows that repeat an id draw the same count.
    A ``copy_col`` of the input is replaced; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != copy_col]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("key"))
    counts = given.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        share = F.coalesce(table[F.col("source")], F.lit(0.0)).cast("double")
    counts = counts.withColumn("share", share)
    total, shares, sources = counts.agg(F.sum("n"), F.sum("share"), F.count(F.lit(1))).first()
    target = float(total or 0) if rows is None else float(rows)
    mean = F.col("share") * F.lit(target / shares if shares else 0.0) / F.col("n")
    rates = counts.withColumn("mean", mean).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN)).cast("int"))
    rates = rates.withColumn("part", F.col("mean") / F.col("draws"))
    rates = rates.select("source", "draws", cumulative(F.col("part")).alias("cdf"))
    # The second key, which follows from the source, makes both sides of a join that is not broadcast pass an exchange of their own: Spark can split it where a source is frequent.
    again = F.pmod(F.xxhash64("source"), F.lit(2)).alias("__again")
    rates = F.broadcast(rates.select("*", again)) if sources <= BROADCAST_SOURCES else rates.select("*", again)
    one = lambda draw: F.size(F.filter("cdf", lambda c: c <= uniform(F.col("key"), seed, draw)))
    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda total, draw: total + one(draw))
    drawn = given.select("*", again).join(rates, ["source", "__again"]).withColumn("copies", count).filter("copies > 0")
    out = drawn.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = out.withColumn("place", F.xxhash64("key", "copy", F.lit(seed)))
    out = out.repartition(shuffle_width(spark), "place").sortWithinPartitions("place")
    return out.select("row.*", F.col("copy").alias(copy_col))


def cumulative(mean: Column) -> Column:
    """The Poisson distribution's cumulative values from 0 on, as far as they tell apart numbers of 52 bits."""
    steps = F.sequence(F.lit(1), F.lit(90))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(state: Column, j: Column) -> Column:
        p = state["p"] * mean / j
        following = F.element_at(state["c"], -1) + p
        return F.when((state["p"] < 1e-18) & (j > mean), state).otherwise(F.struct(p.alias("p"), F.concat(state["c"], F.array(following)).alias("c")))

    return F.aggregate(steps, start, step, lambda state: state["c"])


#: DuckDB's twin of the query: the same digests, rates and cumulative values.
ORACLE = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
shares AS (SELECT source, n, pow(n::DOUBLE, 0.7) AS share FROM counts),
totals AS (SELECT sum(n)::DOUBLE AS n, sum(share) AS share FROM shares),
rates AS (SELECT s.source, s.share * (totals.n / totals.share) / s.n AS mean, greatest(1, ceil(s.share * (totals.n / totals.share) / s.n / 16.0))::INT AS draws
          FROM shares s, totals),
pmf AS (SELECT source, mean / draws AS part, 0 AS j, exp(-mean / draws) AS p, exp(-mean / draws) AS c FROM rates
        UNION ALL SELECT source, part, j + 1, p * part / (j + 1), c + p * part / (j + 1) FROM pmf WHERE j < 90 AND NOT (p < 1e-18 AND j + 1 > part)),
cdf AS (SELECT source, list(c ORDER BY j) AS c FROM pmf GROUP BY source),
drawn AS (SELECT d.*, list_sum([len(list_filter(cdf.c, lambda c : c <= u)) FOR u IN
            [('0x' || substr(md5(d.doc_id || ':17:' || i), 1, 13))::BIGINT / 4503599627370496.0 FOR i IN range(1, draws + 1)]])::BIGINT AS copies
          FROM documents d JOIN rates r ON coalesce(d.source, '') = r.source JOIN cdf ON cdf.source = r.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy_no FROM drawn WHERE copies > 0
"""
