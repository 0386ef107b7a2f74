"""Connected components of links, without links or components on the driver.

Alternates two steps until nothing changes: every node hands its larger neighbours, then its smaller ones, to its least neighbour.
The result is a star around each component's least node. Each round is written to the shared folder, so no lineage grows and a lost
executor costs one round at most. Links must be a forest or otherwise linear in the nodes; both operators that call this emit
spanning forests of their buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelake.llm.shared import forget, written


def _star(edges: DataFrame, of: str, to: str) -> DataFrame:
    """For each value of `of`, the least of it and its `to` values, beside each of them. The minimum is combined before the shuffle, and the join may split a value with many rows."""
    least = edges.groupBy(of).agg(F.min(to).alias("least")).withColumn("least", F.least("least", of))
    return edges.join(least, of)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that links (a long, b long) name. Links of a node to itself are ignored; repeated ones count once."""
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _star(large, "u", "v")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).where("u != v").distinct()
        new = written(small)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components didn't settle")
    least = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
    out._made_of = [edges]
    return out
