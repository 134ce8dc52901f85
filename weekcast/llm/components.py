"""Connected components of a link table, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(arcs: DataFrame) -> DataFrame:
    return arcs.join(arcs.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in `links` (u, v); root is the smallest node reachable.

    Alternates the two star steps of Kiveris et al. (2014): a logarithmic number of rounds even for long
    chains, and a node with very many links costs a partial aggregate and a join that Spark may split.
    Loops and repeated links change nothing; links with a null end are ignored. Every round is written to
    the shared folder. No links give no rows.
    """
    edges = stored(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    before = None
    while True:
        now = _state(edges)
        if now == before or now[0] == 0:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(down)
        nearer = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stored(nearer.distinct(), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
