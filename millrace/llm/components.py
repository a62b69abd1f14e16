"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node that it reaches.

    Alternates large-star and small-star steps: every node links its larger neighbours, then its smaller ones, to the
    smallest node near it. No step holds a node's neighbours in one row: minima are aggregated with map-side combine and
    joined back, so a node with very many links is split by the adaptive skew join. Each round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path."""
    now = common.staged(edges.select("u", "v").where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionAll(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").where("u <> v").distinct()
        after = common.staged(small, "edges")
        state = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
        common.dropped(now)
        now = after
        if state == seen:
            break
        seen = state
    roots = now.select("v").distinct().selectExpr("v AS node", "v AS component")
    return now.selectExpr("u AS node", "v AS component").unionAll(roots)
