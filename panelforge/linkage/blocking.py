"""Candidate pairs: equality blocks, range conditions, hot blocks split into tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.staging import stage

# Rows of one side a single block may bring to a task before it is split.
TILE_ROWS = 2000
# Cuts of a block by its range values, at most.
RANGE_TILES = 64


@dataclass(frozen=True)
class Rule:
    """Pairs agree on all keys and satisfy the residual condition, if any.

    ``before``: a pair of columns, the left one's value must be below the right one's.
    """

    keys: tuple[str, ...]
    residual: Callable[[], Column] | None = None
    before: tuple[str, str] | None = None

    def condition(self) -> Column:
        holds = F.lit(True)
        for key in self.keys:
            equal = F.col(f"{key}_l") == F.col(f"{key}_r")
            holds = holds & F.coalesce(equal, F.lit(False))
        return holds & self.remainder()

    def remainder(self) -> Column:
        """What pairs must satisfy besides equal keys."""
        holds = F.lit(True)
        if self.before is not None:
            holds = holds & (F.col(f"{self.before[0]}_l") < F.col(f"{self.before[1]}_r"))
        if self.residual is not None:
            holds = holds & self.residual()
        return F.coalesce(holds, F.lit(False))


def block_on(*keys: str) -> Rule:
    return Rule(tuple(keys))


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def _tiles(count: str, tile_rows: int, name: str) -> Column:
    return F.greatest(F.ceil(F.coalesce(count, F.lit(0)) / tile_rows), F.lit(1)).alias(name)


def _hot_side(df: DataFrame, keys: Sequence[str], tile_rows: int, name: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > tile_rows).select(*keys, _tiles("_n", tile_rows, name))


def hot_blocks(counts: DataFrame, keys: Sequence[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Blocks beyond one tile on either side, with the number of tiles of each side.

    At most rows / tile_rows entries. They are stored, so that their measured size lets them be
    broadcast and records move by tile only.
    """
    wide = counts.where((F.col("n_l") > tile_rows) | (F.col("n_r") > tile_rows))
    tiles = [_tiles(f"n{side}", tile_rows, f"_tiles{side}") for side in ("_l", "_r")]
    return stage(wide.select(*keys, *tiles), "hot-blocks")


def tiled_sides(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    unique_id: str,
    tile_rows: int = TILE_ROWS,
    hot: DataFrame | None = None,
) -> tuple[list[DataFrame], list[str]]:
    """Both sides as ``_l``/``_r`` columns, each row once per tile of the other side of its block.

    Pairs that agree on the keys agree on the columns named as well, in one copy of each.
    """
    keys = list(keys)
    if hot is None:
        sides = [
            _hot_side(df, keys, tile_rows, f"_tiles{side}")
            for df, side in ((left, "_l"), (right, "_r"))
        ]
        hot = stage(sides[0].join(sides[1], keys, "outer"), "hot-blocks")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        tile = F.pmod(F.xxhash64(unique_id), F.coalesce(f"_tiles{own}", F.lit(1)))
        meets = F.sequence(
            F.lit(0).cast("long"), F.coalesce(f"_tiles{other}", F.lit(1)).cast("long") - 1
        )
        return df.join(hot, keys, "left").select(
            *[F.col(c).alias(f"{c}{own}") for c in df.columns],
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            tile.cast("long").alias(f"_tile{own}"),
            F.explode(meets).alias(f"_tile{other}"),
        )

    on = [*[f"_key_{k}" for k in keys], "_tile_l", "_tile_r"]
    return [spread(left, "_l", "_r"), spread(right, "_r", "_l")], on


def tiled_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    unique_id: str,
    tile_rows: int = TILE_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """All pairs that agree on the keys, as ``_l``/``_r`` columns.

    A block with more than ``tile_rows`` rows on a side is cut into tiles by a hash of the
    record id; every left tile meets every right tile exactly once. No task sees more of
    a block than one tile per side, and no pair is lost. ``hot`` may bring what
    ``hot_blocks`` finds, if the counts are known already.
    """
    spread, on = tiled_sides(left, right, keys, unique_id, tile_rows, hot)
    # Few bytes may make many pairs: neither the files nor the size of the records may set the tasks.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = [side.repartition(tasks, *on) for side in spread]
    return sides[0].join(sides[1], on, "inner").drop(*on)


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    before: tuple[str, str],
    unique_id: str,
    tile_rows: int = TILE_ROWS,
    tiles: int = RANGE_TILES,
    check: bool = True,
) -> DataFrame:
    """Pairs that agree on the keys with the left range value below the right one.

    Each block is cut at quantiles of its range values (approximate ones do: any cut is right),
    and the least and largest value of each tile tell which tiles can hold a pair; no other
    tiles meet. Values that a block has few of get a tile each, so then every pair formed counts;
    else only a tile's own pairs are formed in vain, one part in ``tiles``. Rows are copied once per
    partner tile, ``2 * tiles`` times at most; hot tiles are split as hot blocks are. Without
    ``check`` the pairs formed in vain are left in.
    """
    keys = list(keys)
    own = {"_l": before[0], "_r": before[1]}
    known = {s: df.where(F.col(own[s]).isNotNull()) for s, df in (("_l", left), ("_r", right))}
    values = known["_l"].select(*keys, F.col(own["_l"]).alias("_v")).unionByName(
        known["_r"].select(*keys, F.col(own["_r"]).alias("_v"))
    )
    shares = [k / tiles for k in range(1, tiles)]
    cuts = stage(
        values.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx("_v", shares, 100 * tiles)).alias("_cuts")
        ),
        "cuts",
    )

    def tiled(side: str) -> DataFrame:
        value = F.col(own[side])
        # A cut opens a tile, and the value of the cut itself is a tile of its own.
        at = F.size(F.filter("_cuts", lambda c: c < value))
        on = F.exists("_cuts", lambda c: c == value).cast("int")
        return known[side].join(cuts, keys).withColumn("_t", 2 * at + on).drop("_cuts")

    def reach(side: str) -> DataFrame:
        value = F.min(own[side]) if side == "_l" else F.max(own[side])
        return tiled(side).groupBy(*keys, "_t").agg(value.alias(f"_reach{side}"))

    lows = reach("_l").withColumnRenamed("_t", "_tile_l")
    highs = reach("_r").withColumnRenamed("_t", "_tile_r")
    meets = stage(
        lows.join(highs, keys).where(F.col("_reach_l") < F.col("_reach_r"))
        .select(*keys, "_tile_l", "_tile_r"),
        "tile-pairs",
    )

    def copied(side: str, other: str) -> DataFrame:
        partners = meets.groupBy(*keys, F.col(f"_tile{side}").alias("_t")).agg(
            F.collect_list(f"_tile{other}").alias("_partners")
        )
        return (
            tiled(side)
            .join(partners, [*keys, "_t"])
            .withColumn(f"_meet{other}", F.explode("_partners"))
            .withColumnRenamed("_t", f"_meet{side}")
            .drop("_partners")
        )

    met = ["_meet_l", "_meet_r"]
    pairs = tiled_join(
        copied("_l", "_r"), copied("_r", "_l"), [*keys, *met], unique_id, tile_rows
    )
    pairs = pairs.drop(*[f"{m}{s}" for m in met for s in own])
    return pairs.where(F.col(f"{before[0]}_l") < F.col(f"{before[1]}_r")) if check else pairs


def _with_known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def only_rule(
    pairs: DataFrame,
    rules: Sequence[Rule],
    at: int,
    unique_id: str,
    within: bool,
    directed: bool = False,
) -> DataFrame:
    """Of pairs with equal keys of rule ``at``, those that it is the first to find."""
    pairs = pairs.where(rules[at].remainder())
    if within:
        id_l, id_r = F.col(f"{unique_id}_l"), F.col(f"{unique_id}_r")
        pairs = pairs.where(id_l != id_r if directed else id_l < id_r)
    for earlier in rules[:at]:
        pairs = pairs.where(~earlier.condition())
    return pairs.withColumn("match_key", F.lit(at))


def candidate_pairs(
    left: DataFrame,
    right: DataFrame | None,
    unique_id: str,
    rules: Sequence[Rule],
    directed: bool = False,
    tile_rows: int = TILE_ROWS,
    only_last: bool = False,
) -> DataFrame:
    """Pairs of all rules, each pair once, tagged with the first rule that finds it.

    ``only_last``: those that no rule but the last finds.

    Without ``right`` pairs are formed within ``left``: once per unordered pair (smaller id
    left), or in the direction the residual condition gives if ``directed``.
    """
    frames = []
    for i, rule in enumerate(rules):
        if only_last and i + 1 < len(rules):
            continue
        mine = _with_known_keys(left, rule.keys)
        others = _with_known_keys(left if right is None else right, rule.keys)
        if rule.before is not None:
            pairs = range_join(mine, others, rule.keys, rule.before, unique_id, tile_rows)
        else:
            pairs = tiled_join(mine, others, rule.keys, unique_id, tile_rows)
        frames.append(only_rule(pairs, rules, i, unique_id, right is None, directed))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def block_sizes(left: DataFrame, right: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows and pairs per block, to see how a rule scales before running it."""
    counts = _with_known_keys(left, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_l"))
    if right is None:
        pairs = F.col("n_l") * (F.col("n_l") - 1) / 2
        return counts.select(*keys, "n_l", F.col("n_l").alias("n_r"), pairs.alias("pairs"))
    others = _with_known_keys(right, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_r"))
    pairs = F.col("n_l").cast("double") * F.col("n_r")
    return counts.join(others, list(keys)).select(*keys, "n_l", "n_r", pairs.alias("pairs"))
