"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import materialise


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` for every id of ``links`` (columns ``a, b``); the component is its smallest id.

    Each round links every vertex' larger neighbours, then its smaller ones, to the smallest vertex around it, until
    what is left are stars: no centre has an edge of its own, no member two.  Minima are combined map-side; nothing
    is gathered per vertex.  Rounds are logarithmic in the size of a component.
    """
    links = links.filter(F.col("a") != F.col("b"))
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def settled(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("own"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("own"), F.lit(1).alias("centre")))
        return ends.groupBy("x").agg(F.sum("own").alias("own"), F.max("centre").alias("centre")).filter("own + centre > 1").isEmpty()

    for _ in range(most_rounds):
        if settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
