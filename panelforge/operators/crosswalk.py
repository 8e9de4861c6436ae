"""Identifier crosswalks: applying, building and checking them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.staging import stage


def apply_crosswalk(
    df: DataFrame, crosswalk: DataFrame, identifier: str, cluster: str | None = None
) -> DataFrame:
    """Replace identifiers by their cluster where the crosswalk has one."""
    cluster = cluster or f"{identifier}_cluster"
    mapping = crosswalk.select(identifier, F.col(cluster).alias("_cluster")).distinct()
    return (
        df.join(mapping, identifier, "left")
        .withColumn(identifier, F.coalesce("_cluster", identifier))
        .select(*df.columns)
    )


def best_by_weight(
    pairs: DataFrame, record: str, partner: str, weight: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Heaviest partner per record, with what its own row carries, as one map-side combined minimum.

    Ties go to the least partner (then the least carried values), as in ``best_match``. Pairs
    without a partner or weight do not compete.
    """
    w = F.col(weight)
    # NaN weighs most, as in any descending order.
    order = [F.when(F.isnan(w), 0).otherwise(1).alias("nan"), (-w).alias("w")]
    row = F.struct(*order, F.col(partner).alias("partner"),
                   *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    known = F.col(partner).isNotNull() & w.isNotNull()
    return (
        pairs.groupBy(record)
        .agg(F.min(F.when(known, row)).alias("_best"))
        .select(
            record,
            F.col("_best.partner").alias(partner),
            *[F.col(f"_best.c{i}").alias(c) for i, c in enumerate(carry)],
        )
    )


def best_match(
    pairs: DataFrame, record: str, weight: str, tie_break: Sequence[str]
) -> DataFrame:
    """Whole best row per record: heaviest first, ties by the given columns ascending."""
    order = Window.partitionBy(record).orderBy(
        F.col(weight).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]
    )
    return pairs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def enforce_one_to_one(matches: DataFrame, member: str, cluster: str) -> DataFrame:
    """Drop matches whose member is itself the cluster of another match."""
    clusters = matches.select(F.col(cluster).alias(member)).where(F.col(member).isNotNull())
    return matches.where(F.col(member).isNotNull()).join(
        clusters.distinct(), member, "left_anti"
    )


def one_to_one_matching(pairs: DataFrame, left: str, right: str, weight: str) -> DataFrame:
    """Pairs in which every left and every right record occurs once: the greedy matching.

    The same pairs as taking the heaviest first, then the heaviest of the rest, and so on (ties:
    least left, then least right id), but in parallel: each round takes all pairs that are the
    best of both their records, and drops what these rule out. The heaviest pair left is always
    such a pair, so it ends; rounds follow the longest chain of ever lighter pairs, not the number
    of records. Pairs with a missing id or weight match nothing; of repeated pairs the heaviest
    counts.
    """
    rest = stage(
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .where(F.col(weight).isNotNull())
        .groupBy(left, right)
        .agg(F.max(weight).alias(weight)),
        "to-match",
    )
    taken = rest.limit(0)
    while not rest.isEmpty():
        first = [F.min(F.struct(-F.col(weight), c))[c].alias("_best") for c in (right, left)]
        of_left = rest.groupBy(left).agg(first[0]).withColumnRenamed("_best", right)
        of_right = rest.groupBy(right).agg(first[1]).withColumnRenamed("_best", left)
        found = stage(rest.join(of_left.join(of_right, [left, right]), [left, right]), "matched")
        taken = taken.unionByName(found)
        for side in (left, right):
            rest = rest.join(found.select(side), side, "left_anti")
        rest = stage(rest, "to-match")
    return taken.select(left, right, weight)


def edges_to_unlinked(
    pairs: DataFrame, unique_id: str, known: str, weight: str, carry: Sequence[str] = ()
) -> DataFrame:
    """From scored pairs with exactly one side known, the best known value per unknown record."""
    left, right = F.col(f"{known}_l"), F.col(f"{known}_r")
    left_unknown = left.isNull()
    edges = pairs.where(left.isNull() != right.isNull()).select(
        F.when(left_unknown, F.col(f"{unique_id}_l"))
        .otherwise(F.col(f"{unique_id}_r"))
        .alias(unique_id),
        F.coalesce(left, right).alias(known),
        weight,
        *carry,
    )
    return best_match(edges, unique_id, weight, [known])


def unmapped_report(
    entities: DataFrame,
    crosswalk: DataFrame,
    measures: DataFrame,
    identifier: str,
    by: Sequence[str],
    value: str,
    total: str,
) -> DataFrame:
    """Entities without a crosswalk entry, with their positive total, largest first."""
    missing = entities.select(identifier).join(
        crosswalk.select(identifier).distinct(), identifier, "left_anti"
    )
    return (
        missing.join(measures.where(F.col(value) > 0.0), identifier, "inner")
        .groupBy(identifier, *by)
        .agg(F.sum(value).alias(total))
        .orderBy(F.col(total).desc(), identifier, *by)
    )


def duplicate_identifiers(crosswalk: DataFrame, identifier: str) -> DataFrame:
    """Identifiers listed more than once (should be none)."""
    return (
        crosswalk.groupBy(identifier)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def missing_pairs(crosswalk: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected pairs the crosswalk does not contain (should be none)."""
    return expected.join(crosswalk, list(expected.columns), "left_anti")
