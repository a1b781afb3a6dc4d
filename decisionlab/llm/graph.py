"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decisionlab.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each linked node: columns `node`, `root`.

    Nodes that are themselves the smallest of their component have no row.
    Every round first moves each node's larger neighbours to its smallest one, then the
    smaller ones, until all links point at roots. Minima are combined map-side, each round
    is a written table, and no round makes more links than the one before, apart from one for
    each node. Links from a node to itself and links with a null are ignored.
    """
    big, small = F.greatest(a, b), F.least(a, b)
    now = cut_lineage(
        links.filter(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        outward = (
            now.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        low = outward.groupBy("u").agg(F.min("v").alias("m"))
        inward = outward.join(low, "u")
        moved = inward.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m"))
        now = cut_lineage(
            moved.unionByName(inward.select("u", "m")).distinct().withColumnRenamed("m", "v")
        )
        before, state = state, now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
