"""Prefix trie of conversations whose heads come from other conversations.

Every conversation is rebuilt: the first h turns of its base conversation, then its own turns
after its first h. Rebuilt texts are never made. A turn is a symbol x below a prime; a sequence
has the fingerprint (n, x1 + x2 B + ... + xn B^(n-1)), and

    (n, v) * (m, w) = (n + m, v + B^n w)

is a monoid, so products of pieces combine. Each conversation's prefix values are scanned once;
with the products H of the base's head and V of the own first h turns, the prefix through own turn
g has the value H + (v_g - V) B^(head - h), that is A + M v with two numbers for each piece.

Equality is proven, not assumed. A turn is stored with a reference to its content (128 bits of its
SHA-256), and one pass finds that no reference stands for two contents. In every group of prefixes
of one depth and fingerprint, all last turns must have one reference and all prefixes less it one
fingerprint: with that, by induction over the depth, a group is one sequence. If a group fails, the
whole work is done again with other multipliers.

Sums over subtrees go along paths. A conversation owns the nodes of which it is the smallest
member, which are the last ones on its path. A node's subtree is the owned nodes of its members,
less what its own owner owns above it. So one sum over members gives a subtree's total.

Skew: rows are ordered by ranges of (conversation, turn), so a conversation of any length is cut
into pieces that later joins use as keys; prefixes are counted map-side before they meet, so a
common first turn is no hot key. SHA-256 runs over a node's ids in order, so the ids that end in
one node reach one task, as packed strings and read as a stream.

Turns of equal number are ordered by reference. Rows without a conversation are left out; null
role or text is empty. Repeated rows are turns of their own. No conversation, no node, not even
the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelforge.sources.staging import stage

PRIME = (1 << 61) - 1
#: Conversations that share a base, and the number of different head lengths.
GROUP = 100
HEADS = 6
#: Nodes of one conversation whose sums are run up together.
CHUNK = 4096
#: Conversation ids in one packed string.
PACKED = 4096
ATTEMPTS = 5


def base_of(conv_id: Column) -> Column:
    return conv_id - F.pmod(conv_id, F.lit(GROUP))


def head_of(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


@dataclass(frozen=True)
class Symbols:
    """Multipliers of one attempt: how turns become symbols and symbols products."""

    attempt: int
    prime: int = PRIME

    def _drawn(self, name: str) -> int:
        drawn = hashlib.sha256(f"{name} {self.attempt}".encode()).digest()
        return int.from_bytes(drawn, "big") % (self.prime - 2) + 2

    @property
    def base(self) -> int:
        return self._drawn("base")

    @property
    def mix(self) -> tuple[int, int]:
        return self._drawn("first"), self._drawn("second")


def _turns(given: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, r1, r2, chars, content) with content as one unambiguous string."""
    said, by = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    content = F.concat(F.length(by).cast("string"), F.lit(":"), by, said)
    sha = F.sha2(content.cast("binary"), 256)
    halves = [F.conv(F.substring(sha, at, 16), 16, -10).cast("long") for at in (1, 17)]
    return given.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        halves[0].alias("r1"),
        halves[1].alias("r2"),
        F.length(said).cast("long").alias("chars"),
        content.alias("content"),
    )


def _prove_references(turns: DataFrame) -> None:
    """Raise if a reference stands for two contents; each text moves once a task at most."""
    contents = turns.groupBy("r1", "r2", "content").agg(F.lit(1).alias("one"))
    twice = contents.groupBy("r1", "r2").count().where("count > 1")
    if not twice.isEmpty():
        raise RuntimeError("two different turns share 128 bits of their SHA-256")


def _scan(symbols: Symbols):
    """Function for mapInArrow over sorted rows: value through (v) and before (u) each turn."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        prime, base, (a, b) = symbols.prime, symbols.base, symbols.mix
        conv, at, power, value = None, 0, 1, 0
        for batch in batches:
            place, through, before = [], [], []
            for c, r1, r2 in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != conv:
                    conv, at, power, value = c, 0, 1, 0
                before.append(value)
                value = (value + (a * r1 + b * r2) * power) % prime
                power = power * base % prime
                at += 1
                place.append(at)
                through.append(value)
            made = [pa.array(x, pa.int64()) for x in ([part] * len(place), place, through, before)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], [*batch.schema.names, "part", "i", "v", "u"]
            )

    return scan


def _conversations(scanned: DataFrame) -> DataFrame:
    """(conv_id, runs): the pieces of each conversation in order, at most one a partition.

    A piece is (part, n, v, firsts); firsts are its first turns, as many as a head can have.
    """
    first = F.struct("i", "r1", "r2", "chars")
    pieces = scanned.groupBy("conv_id", "part").agg(
        F.max("i").alias("n"),
        F.max_by("v", "i").alias("v"),
        F.array_sort(F.collect_list(F.when(F.col("i") < HEADS, first))).alias("firsts"),
    )
    piece = F.struct("part", "n", "v", "firsts")
    return pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("runs"))


_REBUILT = (
    "conv_id long, length long, "
    "heads array<struct<depth:long,fp:long,pfp:long,r1:long,r2:long,chars:long>>, "
    "own array<struct<part:long,after:long,deeper:long,add:long,times:long>>"
)


def _rebuild(symbols: Symbols):
    """Function for mapInArrow over (conv_id, h, runs, firsts of the base): combined products."""

    def products(turns: list[dict]) -> list[int]:
        (a, b), prime, values, power = symbols.mix, symbols.prime, [0], 1
        for t in turns:
            values.append((values[-1] + (a * t["r1"] + b * t["r2"]) * power) % prime)
            power = power * symbols.base % prime
        return values

    def one(h: int, runs: list[dict], base: list[dict]) -> tuple[int, list, list]:
        prime, n = symbols.prime, sum(r["n"] for r in runs)
        base = base[:h]
        head, head_values = len(base), products(base)
        skipped = products([t for r in runs for t in r["firsts"]][:h])[-1]
        heads = [{"depth": 0, "fp": 0}]
        for d, t in enumerate(base, 1):
            values = {"fp": head_values[d], "pfp": head_values[d - 1]}
            heads.append({"depth": d, **values, **{k: t[k] for k in ("r1", "r2", "chars")}})
        own, before, value = [], 0, 0
        moved = pow(symbols.base, head - h, prime)
        for r in runs:
            times = pow(symbols.base, before, prime)
            if before + r["n"] > h:
                own.append(
                    {
                        "part": r["part"],
                        "after": h - before,
                        "deeper": before + head - h,
                        "add": (head_values[-1] + (value - skipped) * moved) % prime,
                        "times": times * moved % prime,
                    }
                )
            value = (value + times * r["v"]) % prime
            before += r["n"]
        return head + max(0, n - h), heads, own

    schema = to_arrow_schema(StructType.fromDDL(_REBUILT))

    def rebuild(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [
                {"conv_id": r["conv_id"]}
                | dict(zip(("length", "heads", "own"),
                           one(r["h"], r["runs"], r["base"] or []), strict=True))
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return rebuild


def _shifted(symbols: Symbols):
    """Function for mapInArrow: v and u become the rebuilt prefixes' fingerprints."""

    def shifted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        prime = symbols.prime
        for batch in batches:
            kept = dict(zip(batch.schema.names, batch.columns, strict=True))
            add, times = (kept.pop(k).to_pylist() for k in ("add", "times"))
            for name in ("fp", "pfp"):
                pieces = zip(add, times, kept[name].to_pylist(), strict=True)
                kept[name] = pa.array([(a + m * v) % prime for a, m, v in pieces], pa.int64())
            yield pa.RecordBatch.from_pydict(kept)

    return shifted


def _prefixes(ordered: DataFrame, symbols: Symbols, base: Callable, head: Callable) -> DataFrame:
    """(conv_id, depth, fp, pfp, r1, r2, chars, ends): every prefix of every rebuilt conversation."""
    scanned = stage(
        ordered.repartitionByRange("conv_id", "turn", "r1", "r2", "tie")
        .sortWithinPartitions("conv_id", "turn", "r1", "r2", "tie")
        .select("conv_id", "r1", "r2", "chars")
        .mapInArrow(
            _scan(symbols),
            "conv_id long, r1 long, r2 long, chars long, part long, i long, v long, u long",
        ),
        "turns",
    )
    convs = stage(_conversations(scanned), "conversations")
    bases = convs.where(base(F.col("conv_id")) == F.col("conv_id")).select(
        F.col("conv_id").alias("base_id"),
        F.slice(F.flatten("runs.firsts"), 1, HEADS - 1).alias("base"),
    )
    based = convs.withColumn("base_id", base(F.col("conv_id"))).join(bases, "base_id", "left")
    rebuilt = stage(
        based.select("conv_id", head(F.col("conv_id")).alias("h"), "runs", "base").mapInArrow(
            _rebuild(symbols), _REBUILT
        ),
        "rebuilt",
    )
    heads = rebuilt.select("conv_id", "length", F.explode("heads").alias("t")).select(
        "conv_id", "length", "t.*"
    )
    pieces = rebuilt.select("conv_id", "length", F.explode("own").alias("o")).select(
        "conv_id", "length", "o.*"
    )
    own = (
        scanned.join(pieces, ["conv_id", "part"])
        .where(F.col("i") > F.col("after"))
        .select(
            "conv_id",
            "length",
            (F.col("i") + F.col("deeper")).alias("depth"),
            F.col("v").alias("fp"),
            F.col("u").alias("pfp"),
            "r1",
            "r2",
            "chars",
            "add",
            "times",
        )
        .mapInArrow(_shifted(symbols), heads.schema)
    )
    both = heads.unionByName(own)
    return both.withColumn("ends", F.col("depth") == F.col("length")).drop("length")


def _nodes(prefixes: DataFrame) -> tuple[DataFrame, bool]:
    """(depth, fp, pfp, conv_id, n_convs, chars) of each group, and whether all groups are sound."""
    lone = ("pfp", "r1", "r2")
    ranges = [f(c).alias(f"{f.__name__}_{c}") for c in lone for f in (F.min, F.max)]
    found = stage(
        prefixes.groupBy("depth", "fp").agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("chars").alias("chars"),
            *ranges,
        ),
        "nodes",
    )
    mixed = found.where(" OR ".join(f"min_{c} <> max_{c}" for c in lone))
    nodes = found.select(
        "depth", "fp", F.col("min_pfp").alias("pfp"), "conv_id", "n_convs",
        F.coalesce("chars", F.lit(0)).alias("chars"),
    )
    return nodes, mixed.isEmpty()


def _chunk(depth: Column, chunk: int) -> Column:
    return F.floor(depth / chunk)


def _running(nodes: DataFrame, chunk: int) -> DataFrame:
    """nodes with `above`: what their owner's nodes of smaller depth save."""
    cut = nodes.withColumn("chunk", _chunk(F.col("depth"), chunk))
    totals = cut.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("__saved"))
    past = Window.rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "conv_id",
        "chunk",
        F.sum("__saved").over(past.partitionBy("conv_id").orderBy("chunk")).alias("__base"),
    )
    inside = F.sum("saved").over(past.partitionBy("conv_id", "chunk").orderBy("depth"))
    none = F.lit(0)
    return (
        cut.withColumn("__inside", inside)
        .join(base, ["conv_id", "chunk"])
        .withColumn("above", F.coalesce("__inside", none) + F.coalesce("__base", none))
        .drop("chunk", "__inside", "__base")
    )


def _pack(packed: int):
    """Function for mapInArrow over sorted (depth, fp, conv_id): ids of a node as joined strings."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        node, ids, out = None, [], []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != node or len(ids) == packed):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = key
                ids.append(conv)
            yield _packed_batch(pa, out)
            out = []
        if ids:
            yield _packed_batch(pa, [(*node, ids[0], ",".join(map(str, ids)))])

    def _packed_batch(pa, rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "fp", "least", "ids"])

    return pack


def _hash_packed(batches: Iterator) -> Iterator:
    """Function for mapInArrow over strings sorted by node and first id: one hash a node."""
    import pyarrow as pa

    def batch(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "fp", "ends_sha256"])

    node, sha = None, None
    for given in batches:
        done = []
        for *key, ids in zip(*(c.to_pylist() for c in given.columns), strict=True):
            if key == node:
                sha.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, sha.hexdigest()))
            node, sha = key, hashlib.sha256(ids.encode())
        yield batch(done)
    if node is not None:
        yield batch([(*node, sha.hexdigest())])


def _ends(prefixes: DataFrame, packed: int) -> DataFrame:
    """(depth, fp, ends_sha256) of the nodes in which conversations end."""
    strings = (
        prefixes.where("ends")
        .select("depth", "fp", "conv_id")
        .repartitionByRange("depth", "fp", "conv_id")
        .sortWithinPartitions("depth", "fp", "conv_id")
        .mapInArrow(_pack(packed), "depth long, fp long, least long, ids string")
    )
    return (
        strings.repartition("depth", "fp")
        .sortWithinPartitions("depth", "fp", "least")
        .select("depth", "fp", "ids")
        .mapInArrow(_hash_packed, "depth long, fp long, ends_sha256 string")
    )


def trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    base: Callable[[Column], Column] = base_of,
    head: Callable[[Column], Column] = head_of,
    prime: int = PRIME,
    chunk: int = CHUNK,
    packed: int = PACKED,
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    base gives the id of the base conversation, head how many of its turns (below HEADS) stand
    in for the first ones. A node's conv_id is its smallest member; n_convs its members; n_leaves
    and saved_tokens (code points that n_convs - 1 members need not store again) count its subtree;
    ends_sha256 is the hash of the ids that end in it.
    """
    turns = _turns(conversations, conv_id, turn, role, text)
    _prove_references(turns)
    ordered = stage(
        turns.drop("content").withColumn("tie", F.monotonically_increasing_id()), "ordered"
    )
    for attempt in range(attempts):
        prefixes = stage(_prefixes(ordered, Symbols(attempt, prime), base, head), "prefixes")
        nodes, sound = _nodes(prefixes)
        if sound:
            break
    else:
        raise RuntimeError(f"fingerprints clash under each of {attempts} choices of multipliers")

    node = ["depth", "fp"]
    up = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(up, F.col("pfp").alias("fp"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), node, "left").select(
        *node,
        "pfp",
        "conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    nodes = stage(_running(nodes, chunk), "sums")

    owned = nodes.groupBy("conv_id").agg(
        F.sum("saved").alias("saved"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.max("depth").alias("deepest"),
        F.min("depth").alias("highest"),
    )
    worth = owned.where("saved > 0 OR leaf > 0").select(
        "conv_id", "saved", "leaf",
        F.explode(F.sequence(F.lit(0).cast("long"), _chunk(F.col("deepest"), chunk))).alias("chunk"),
    )
    below = (
        prefixes.select(*node, "conv_id", _chunk(F.col("depth"), chunk).alias("chunk"))
        .join(worth, ["conv_id", "chunk"])
        .groupBy(*node)
        .agg(F.sum("saved").alias("below"), F.sum("leaf").alias("n_leaves"))
    )
    # A node whose owner owns its parent too has that owner as parent; only the highest look up.
    highest = owned.where("highest > 0").select("conv_id", F.col("highest").alias("depth"))
    asked = nodes.join(highest, ["conv_id", "depth"]).select(
        *node, up.alias("up"), F.col("pfp")
    )
    parents = nodes.select(
        F.col("depth").alias("up"), F.col("fp").alias("pfp"), F.col("conv_id").alias("parent")
    )
    looked_up = asked.join(parents, ["up", "pfp"]).select(*node, "parent")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(below, node, "left")
        .join(looked_up, node, "left")
        .join(_ends(prefixes, packed), node, "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
