"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node with partial aggregation, then a join of the
arcs with these minima. Few minima are broadcast; many are written first, so that
the join reads both sides from shuffles of its own and AQE can split the arcs of
a node that has very many. Each round is written to the shared folder; the
round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.runtime import discard, stored


#: Nodes up to which their minima are broadcast (16 bytes each).
BROADCAST_NODES = 500_000


def _star(arcs: DataFrame, scratch: list[str]) -> DataFrame:
    """For arcs u -> v: link each v, and u, to the least of u and its targets."""
    least = stored(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(8), "components-least")
    scratch.append(least.path)
    return arcs.join(F.broadcast(least.df) if least.df.count() <= BROADCAST_NODES else least.df, "u")


def _files(rows: int) -> int:
    """Tasks that write a round, in proportion to its rows, so that small rounds are not many tiny files."""
    return 1 + rows // 250_000


def _stars(arcs: DataFrame) -> bool:
    """Whether each node points to one root at most, and no root points anywhere."""
    ends = arcs.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(arcs.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each node's component, for every node that has an edge; self-edges and nulls are ignored."""
    spark = edges.sparkSession
    arcs = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(arcs.coalesce(_files(edges.count())), "components")
    while not _stars(now.df):
        scratch: list[str] = []
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scratch).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _star(large, scratch)
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small.coalesce(_files(now.df.count())), "components")
        for path in (now.path, *scratch):
            discard(spark, path)
        now = after
    nodes = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
