"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import free, keep


#: Rows of an edge or pair table for each file: so few lie in one, and are dealt with in one task without a shuffle.
PER_FILE = 100_000


def files_for(rows: int) -> int:
    return max(1, -(-rows // PER_FILE))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) that is not its component's least node, which is its root.

    Each round is written, so lineage stays short; a node's edges are only ever reduced to their minimum (pre-aggregated) and joined
    back (a join that can split a hot node). Rounds grow with the logarithm of the longest path. Up to ``PER_FILE`` edges lie in one partition, which needs
    no exchange.
    """
    edges = edges.where("u <> v").select("u", "v")
    parts, before = files_for(edges.count()), None  # no round has more
    now = keep(edges.coalesce(parts).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * parts if parts > 1 else 1)
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large.coalesce(parts), "edges-large")
        last = now
        large_ = large.coalesce(parts)
        parent = large_.groupBy("u").agg(F.min("v").alias("m"))
        small = large_.join(parent, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        seen = Observation()
        now = small.unionByName(parent.select("u", F.col("m").alias("v"))).coalesce(2 * parts if parts > 1 else 1).distinct().coalesce(parts)
        now = keep(now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x")), "edges-small")
        free(last, large)
        # the stars no longer change: the same edges as a round ago
        mark = seen.get["n"], seen.get["x"]
        if mark == before:
            return now.select("u", F.col("v").alias("root"))
        before = mark
