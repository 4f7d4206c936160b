"""Connected components of a link table, and spanning forests of link blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs of ``links`` (boolean, rows x columns) that join what it joins; at most rows + columns of them."""
    label = np.full(links.shape[1], -1, dtype=np.int64)
    rows, columns = [], []
    for i in np.flatnonzero(links.any(axis=1)):
        at = np.flatnonzero(links[i])
        have = label[at]
        _, first = np.unique(have, return_index=True)
        fresh = at[have < 0]
        joined = at[first[have[first] >= 0]]
        ends = np.concatenate([fresh, joined])
        rows.append(np.full(len(ends), i))
        columns.append(ends)
        if len(joined):
            label[np.isin(label, label[joined])] = i
        label[fresh] = i
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` by u. The second key, which follows from u, makes both sides pass an exchange of their own: such a join Spark can split where a node has many edges."""
    again = F.pmod(F.col("u"), F.lit(2)).alias("__again")
    return rows.select("*", again).join(table.select("*", again), ["u", "__again"]).drop("__again")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of an edge the smallest node reachable.

    Alternating large-star and small-star steps: each keeps what is connected and moves edges towards the smallest
    node, in about log(nodes) rounds. The table is written to the checkpoint folder every round. Null ends and loops are
    left out. Only two numbers (row count, checksum) come to the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v")).distinct()
    e = cut(e)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _joined(both.filter(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") > F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, least)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.filter(F.col("u") > F.col("v")).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
