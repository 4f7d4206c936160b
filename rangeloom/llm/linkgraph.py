"""URL filters: rules by host and path, and for the rest trust and distrust over the graph of hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: (verdict, host, path prefix)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts up to which their verdicts are broadcast.
BROADCAST_HOSTS = 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float, rounds: int) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, weight), which sum to one, over ``edges`` (src, dst, share).

    The shares of a source sum to one; what hosts without links hold goes back to the seeds. Every round's moved ranks
    are checkpointed, which keeps lineage short; one number, their sum, comes to the driver.
    """
    rank = seeds.select("host", F.col("weight").alias("rank"))
    for _ in range(rounds):
        moved = cut(edges.join(rank, edges["src"] == rank["host"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got")))
        arrived = moved.agg(F.coalesce(F.sum("got"), F.lit(0.0))).first()[0]
        home = seeds.select("host", (F.col("weight") * (1 - damping * arrived)).alias("rank"))
        rank = home.unionByName(moved.select("host", (damping * F.col("got")).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
    return rank


def judge_urls(pages: DataFrame, *, rules: tuple = RULES, damping: float = 0.85, rounds: int = 15, least: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) per page.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path what
    follows up to ``?``, ``#`` or the end; null urls and such without ``://`` have neither. The longest fitting rule
    decides. Hosts that rules mostly allow are trusted seeds, those that rules mostly block are blocked seeds, weighted
    by the difference. Trust is personalised PageRank over links between hosts, distrust the same over the reversed
    links from the blocked seeds. A page without a rule is blocked if its host's distrust exceeds ``least`` times its
    trust, else allowed; hosts that neither reaches are allowed. Without links between hosts both are the seeds' own.
    Null html has no links; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.select("id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = rows.select("id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("found"))
    lean = F.sum(F.when(F.col("found.verdict") == "allow", 1).when(F.col("found.verdict") == "block", -1).otherwise(0)).alias("lean")
    hosts = cut(ruled.filter("host <> ''").groupBy("host").agg(lean))
    good, bad, n_hosts = hosts.agg(F.sum(F.greatest("lean", F.lit(0))), F.sum(F.greatest(-F.col("lean"), F.lit(0))), F.count(F.lit(1))).first()
    linked = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))
    pairs = rows.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(linked, lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    pairs = cut(pairs.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))
    trust = hosts.filter("lean > 0").select("host", (F.col("lean") / float(good or 1)).alias("weight"))
    distrust = hosts.filter("lean < 0").select("host", (-F.col("lean") / float(bad or 1)).alias("weight"))
    if pairs.isEmpty():
        trust, distrust = (s.withColumnRenamed("weight", "rank") for s in (trust, distrust))
    else:
        back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        trust, distrust = (propagate(_shares(e), cut(s), damping=damping, rounds=rounds) for e, s in ((pairs, trust), (back, distrust)))
    verdicts = hosts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    verdicts = cut(verdicts.filter(F.coalesce("distrust", F.lit(0.0)) > least * F.coalesce("trust", F.lit(0.0))).select("host", F.lit("block").alias("by_host")))
    if n_hosts <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    out = ruled.join(verdicts, "host", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "by_host", F.lit("allow")).alias("verdict"))


def _shares(pairs: DataFrame) -> DataFrame:
    totals = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    return cut(pairs.join(totals, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))


def oracle(damping: float = 0.85, rounds: int = 15, least: float = 1.0) -> str:
    """DuckDB's twin of the query: rules, links between hosts and as many rounds of both propagations."""
    lower = f"'{_UPPER}', '{_LOWER}'"

    def side(name: str, edges: str, seeds: str) -> str:
        out = [f"{name}0 AS MATERIALIZED (SELECT host, weight AS rank FROM {seeds})"]
        for k in range(1, rounds + 1):
            out.append(f"{name}_moved{k} AS MATERIALIZED (SELECT dst AS host, sum(rank * share) AS got FROM {edges} JOIN {name}{k - 1} ON src = host GROUP BY dst)")
            home = f"SELECT host, weight * (1 - {damping} * (SELECT coalesce(sum(got), 0) FROM {name}_moved{k})) AS rank FROM {seeds}"
            out.append(f"{name}{k} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM ({home} UNION ALL SELECT host, {damping} * got FROM {name}_moved{k}) GROUP BY host)")
        return ",\n".join(out)

    rules = ", ".join(f"('{v}', '{n}', '{p}')" for v, n, p in RULES)
    return rf"""
WITH parts AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {lower}), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(rule_verdict, name, prefix) AS (VALUES {rules}),
ruled AS (SELECT page_id, host, path, arg_max(name || prefix, length(name || prefix)) AS rule, arg_max(rule_verdict, length(name || prefix)) AS rule_verdict
          FROM parts LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY page_id, host, path),
leans AS (SELECT host, sum(CASE rule_verdict WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END)::DOUBLE AS lean FROM ruled WHERE host <> '' GROUP BY host),
good AS MATERIALIZED (SELECT host, lean / sum(lean) OVER () AS weight FROM leans WHERE lean > 0),
bad AS MATERIALIZED (SELECT host, lean / sum(lean) OVER () AS weight FROM leans WHERE lean < 0),
linked AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1), lambda h : translate(h, {lower})))) AS dst FROM parts WHERE host <> ''),
pairs AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM linked WHERE src <> dst GROUP BY src, dst),
ahead AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM pairs),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM pairs),
{side("trust", "ahead", "good")},
{side("distrust", "back", "bad")}
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN coalesce(d.rank, 0) > {least} * coalesce(t.rank, 0) THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN trust{rounds} t USING (host) LEFT JOIN distrust{rounds} d USING (host)
"""


ORACLE = oracle()
