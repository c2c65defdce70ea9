"""Connected components of links, by alternating large and small stars.

Each round hangs the neighbours of every node on its smallest neighbour: first those
larger than the node, then those smaller. All steps are a grouped minimum, combined
before the shuffle, and a join that adaptive execution can split, so a node with very
many links is no task of its own. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(mark, 20)), F.sum(mark.bitwiseAND(F.lit((1 << 20) - 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes of `edges` (a, b); nulls and loops are no links."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small, "links")
        state, old = _state(edges), state
        if state == old:
            break
    tops = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
