"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.sources.staging import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    pair = F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
    )
    return edges.select(F.explode(pair).alias("p")).select("p.u", "p.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them; edges point downwards."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    ties = edges.join(least, "a")
    pair = F.array(
        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
    )
    return ties.select(F.explode(pair).alias("p")).select("p.a", "p.b").where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
    )


def components(links: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of its component, for every node that has a link.

    Each round is two map-side combined aggregates and two equality joins, whose hot keys
    adaptive execution can split; rounds grow with the logarithm of a component's size.
    Raises if it has not settled after most_rounds.
    """
    a, b = F.col(left), F.col(right)
    edges = stage(
        links.where(a != b)
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "links",
    )
    before = _state(edges)
    for _ in range(most_rounds):
        edges = stage(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
