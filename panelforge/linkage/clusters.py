"""Clusters of linked records: connected components of the pairs at or above a weight.

Alternating stars on stored tables: every node's larger neighbours are tied to its least one,
then every node's smaller neighbours are, until nothing changes. Rounds grow with the logarithm of
a cluster's size. A hub's rows are never together: its least neighbour is found by parts (a hash
of the neighbour), and brought back to each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.sources.staging import stage

#: Parts into which the neighbours of a node are split.
HUB_PARTS = 32
MOST_ROUNDS = 60


def _with_least(around: DataFrame, parts: int) -> DataFrame:
    """Rows (u, v) with the least v of their u."""
    cut = around.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)))
    by_part = cut.groupBy("u", "part").agg(F.min("v").alias("least"))
    least = by_part.groupBy("u").agg(F.min("least").alias("least"))
    back = by_part.select("u", "part").join(least, "u")
    return cut.join(back, ["u", "part"]).drop("part")


def _tie_larger(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node, tied to the least of the node and its neighbours."""
    turned = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                     F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    around = _with_least(edges.select(F.inline(turned)), parts)
    return around.where("v > u").select(
        F.col("v").alias("a"), F.least("u", "least").alias("b")
    )


def _tie_smaller(edges: DataFrame, parts: int) -> DataFrame:
    """Every node and its smaller neighbours, tied to the least of these."""
    below = _with_least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), parts)
    ties = F.array(F.struct(F.col("u").alias("a"), F.col("least").alias("b")),
                   F.struct(F.col("v").alias("a"), F.col("least").alias("b")))
    return below.select(F.inline(ties)).where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def clusters(
    pairs: DataFrame,
    unique_id: str,
    weight: str,
    threshold: float,
    records: DataFrame | None = None,
    hub_parts: int = HUB_PARTS,
    most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """(unique_id, cluster): the least id reachable through pairs at or above the threshold.

    Given ``records``, those without such a pair form clusters of their own. Pairs with a missing
    id or weight link nothing.
    """
    a, b = F.col(f"{unique_id}_l"), F.col(f"{unique_id}_r")
    strong = pairs.where((F.col(weight) >= threshold) & (a != b))
    edges = stage(
        strong.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    before = _state(edges)
    for _ in range(most_rounds):
        edges = stage(_tie_smaller(_tie_larger(edges, hub_parts), hub_parts), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"clusters have not settled after {most_rounds} rounds")
    members = edges.select(F.col("a").alias(unique_id), F.col("b").alias("cluster"))
    heads = edges.select(F.col("b").alias(unique_id), F.col("b").alias("cluster")).distinct()
    found = members.unionByName(heads)
    if records is None:
        return found
    every = records.select(unique_id).where(F.col(unique_id).isNotNull()).distinct()
    return every.join(found, unique_id, "left").select(
        unique_id, F.coalesce("cluster", unique_id).alias("cluster")
    )
