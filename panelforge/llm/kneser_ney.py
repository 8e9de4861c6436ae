"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of a text (white space as one blank, an end mark in front), so its
n-grams are exact 64-bit keys. Nothing of it is ever held whole:

1. Trusted texts give n-gram counts, combined per task and summed by key. (Which documents are
   trusted is joined by id alone and put beside each block, as in 3.) The tables of the
   lower orders hold continuation counts, derived order by order; discounts come from the
   counts of counts (a few numbers).
2. Each block of documents lists its distinct n-grams. Their probabilities are found for all
   blocks at once, order by order, by joins with the sharded count and context tables.
3. The probabilities a block needs are written to the shared folder, one folder per block. The
   task that scores documents reads the table of their block and averages.

Blocks are ranges of the stored rows, so the texts are not shuffled for scoring. A fifth of the
trusted documents (by id hash) is not counted; their perplexities, being those of unseen good
text, give the threshold of their language: the `QUANTILE` of them. On the logarithm, its
distance above the language's median is averaged with that of all languages, which weighs as
much as `PRIOR` documents, so that a language with a handful of documents, one of them noisy,
has a sound threshold too; with many documents the average is the quantile itself.

Null and blank texts have no perplexity and are not kept. A document whose language is null, or
has no held-out trusted document, is held to the same quantile over all of these. Without
any there is no threshold, and texts are kept; without trusted text there is no model, and every
text has perplexity 256 (all bytes alike). Repeated rows are judged one by one. Input columns
named like the results are replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.sources.staging import stage, stage_path

ORDER = 5
#: Share of held-out trusted documents that their language's threshold keeps.
QUANTILE = 0.97
#: Held-out documents that the distance of all languages weighs as much as.
PRIOR = 10
FOLDS = 5
ACCURACY = 10_000
LEAST_DISCOUNT = 0.1
_PIECE = 1 << 20
_MARK = b"\0"
UNIFORM = 1.0 / 256


def _prepared(text: bytes | None) -> bytes:
    return b" ".join((text or b"").split())


def grams_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ending at each byte of each text, number of its text); texts are prepared."""
    pad = _MARK * (order - 1)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8).astype(np.uint64)
    whole = np.zeros(len(data), dtype=np.uint64)
    for back in range(order):
        whole[back:] |= data[: len(data) - back] << np.uint64(8 * back)
    number = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + (number + 1) * (order - 1)
    del begin
    return whole[at].astype(np.int64), number


def _pieces(texts: list[bytes], most: int = _PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(first text number, texts) of about `most` bytes together."""
    held, total, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text)
        total += len(text)
        if total >= most:
            yield first, held
            held, total, first = [], 0, k + 1
    if held:
        yield first, held


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found)).astype(np.int64)


def _counted(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) over all texts."""
    keys = counts = np.zeros(0, dtype=np.int64)
    for _, part in _pieces(texts):
        found, n = np.unique(grams_of(part, order)[0], return_counts=True)
        keys, counts = _added(np.concatenate([keys, found]), np.concatenate([counts, n]))
    return keys, counts


def _texts(column: pa.Array) -> list[bytes]:
    return [_prepared(t) for t in column.cast(pa.binary()).to_pylist()]


def _side_table(folder: str, block: int) -> pa.Table | None:
    """What was written for a block below the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(f"{folder}/block={block}")
    listed = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    files = [f.path for f in listed if f.path.endswith(".parquet")]
    if not files:
        return None
    return pa.concat_tables([pq.ParquetFile(system.open_input_file(f)).read() for f in files])


def _by_block(rows: DataFrame, name: str) -> str:
    """The folder where rows (with a column block) are stored, one folder per block."""
    folder = stage_path(rows.sparkSession, name)
    rows.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


@lru_cache(maxsize=2)
def _ids(folder: str, block: int) -> frozenset:
    table = _side_table(folder, block)
    return frozenset() if table is None else frozenset(table["id"].to_pylist())


def _gram_counts(docs: DataFrame, trusted: str, order: int) -> DataFrame:
    """(gram, c) over the texts of docs (block, id, text) whose ids the folder has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            good = [doc in _ids(trusted, block) for block, doc in rows]
            texts = _texts(batch.column(2).filter(pa.array(good, pa.bool_())))
            keys, counts = _counted(texts, order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["gram", "c"]
            )

    return docs.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _suffix(column: str, order: int):
    """The last `order` bytes of a gram."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * order) - 1).cast("long"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of one order for counts 1, 2 and more."""
    seen = {
        r["c"]: r["n"] for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()
    }
    n1, n2, n3, n4 = (seen.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    # never zero: a context must leave something to n-grams it has not seen
    return tuple(min(max(d, LEAST_DISCOUNT), float(k)) for k, d in enumerate(found, 1))


class Model:
    """Stored tables of each order: (gram, c) and (context, total, gamma), and the discounts."""

    def __init__(self, docs: DataFrame, trusted: str, order: int = ORDER) -> None:
        """docs: (block, id, text) of a stored table; trusted: the folder of ids by block."""
        self.order = order
        self.counts: dict[int, DataFrame] = {}
        self.contexts: dict[int, DataFrame] = {}
        self.discounts: dict[int, tuple[float, float, float]] = {}
        found = _gram_counts(docs, trusted, order)
        for k in range(order, 0, -1):
            found = self.counts[k] = stage(found, f"grams{k}")
            one, two, more = self.discounts[k] = _discounts(found)
            left_over = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
            self.contexts[k] = stage(
                found.groupBy(F.shiftrightunsigned("gram", 8).alias("context"))
                .agg(F.sum("c").alias("total"), F.sum(left_over).alias("spare"))
                .select("context", "total", (F.col("spare") / F.col("total")).alias("gamma")),
                f"contexts{k}",
            )
            found = found.groupBy(_suffix("gram", k - 1).alias("gram")).agg(
                F.count("*").alias("c")
            )

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """(gram, logp) for stored distinct grams, the natural logarithm."""
        lower = None
        for k in range(1, self.order + 1):
            wanted = (
                grams.select("gram")
                if k == self.order
                else grams.select(_suffix("gram", k).alias("gram")).distinct()
            )
            keyed = wanted.select(
                "gram",
                F.shiftrightunsigned("gram", 8).alias("context"),
                _suffix("gram", k - 1).alias("shorter") if k > 1 else F.lit(0).alias("shorter"),
            )
            one, two, more = self.discounts[k]
            joined = keyed.join(self.counts[k], "gram", "left").join(
                self.contexts[k], "context", "left"
            )
            if lower is None:
                joined = joined.withColumn("below", F.lit(UNIFORM))
            else:
                joined = joined.join(
                    lower.select(F.col("gram").alias("shorter"), F.col("p").alias("below")),
                    "shorter",
                )
            kept = (
                F.when(F.col("c") == 1, 1 - one)
                .when(F.col("c") == 2, 2 - two)
                .when(F.col("c") > 2, F.col("c") - more)
                .otherwise(0.0)
            )
            lower = joined.select(
                "gram",
                F.when(F.col("total").isNull(), F.col("below"))
                .otherwise(kept / F.col("total") + F.col("gamma") * F.col("below"))
                .alias("p"),
            )
        return lower.select("gram", F.log("p").alias("logp"))


def _block_grams(docs: DataFrame, text: str, order: int) -> DataFrame:
    """Distinct (block, gram)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks):
                own = [texts[k] for k in np.flatnonzero(blocks == block)]
                keys, _ = _counted(own, order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), block), pa.int64()), pa.array(keys, pa.int64())],
                    names=["block", "gram"],
                )

    return (
        docs.select("__block", text).mapInArrow(collect, "block long, gram long").distinct()
    )


@lru_cache(maxsize=2)
def _table(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams of a block and their log probabilities."""
    table = _side_table(folder, block)
    if table is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    grams, logp = table["gram"].to_numpy(), table["logp"].to_numpy()
    order = np.argsort(grams)
    return grams[order], logp[order]


def _mean_logs(texts: list[bytes], order: int, table) -> list[float | None]:
    """Mean log probability of each text, None for an empty one."""
    grams, logp = table
    sums = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts])
    for first, part in _pieces(texts):
        keys, number = grams_of(part, order)
        if len(keys):
            at = np.searchsorted(grams, keys)
            sums[first : first + len(part)] += np.bincount(
                number, weights=logp[at], minlength=len(part)
            )
    return [float(s / n) if n else None for s, n in zip(sums, sizes, strict=True)]


def perplexities(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (a stored table with a column __block) with perplexity."""
    wanted = stage(_block_grams(docs, text, model.order), "block-grams")
    grams = stage(wanted.select("gram").distinct(), "all-grams")
    known = model.probabilities(grams)
    folder = _by_block(wanted.join(known, "gram"), "block-tables")
    names = [c for c in docs.columns if c not in ("perplexity", "__block")]
    fields = [f for f in docs.schema.fields if f.name in names]
    order = model.order

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(text))
            blocks = batch.column("__block").to_numpy(zero_copy_only=False)
            found: list[float | None] = [None] * len(texts)
            for block in np.unique(blocks):
                at = np.flatnonzero(blocks == block)
                means = _mean_logs([texts[k] for k in at], order, _table(folder, int(block)))
                for k, mean in zip(at, means, strict=True):
                    found[k] = None if mean is None else float(np.exp(-mean))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(found, pa.float64())],
                names=[*names, "perplexity"],
            )

    schema = T.StructType([*fields, T.StructField("perplexity", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def thresholds(
    reference: DataFrame, lang: str = "lang", quantile: float = QUANTILE
) -> tuple[DataFrame, float | None]:
    """(lang, threshold) of the languages in reference, which has perplexities of good text, and
    the threshold of any other language (None if reference is empty)."""
    logs = reference.select(lang, F.log("perplexity").alias("__log"))
    points = F.percentile_approx("__log", [0.5, quantile], ACCURACY).alias("__points")
    of_all = logs.agg(points).first()["__points"]
    own = stage(
        logs.where(F.col(lang).isNotNull())
        .groupBy(lang)
        .agg(points, F.count("*").alias("__n"))
        .select(
            lang,
            "__n",
            F.col("__points")[0].alias("__middle"),
            (F.col("__points")[1] - F.col("__points")[0]).alias("__above"),
        ),
        "languages",
    )
    shared = own.agg(F.sum(F.col("__n") * F.col("__above")) / F.sum("__n")).first()[0]
    above = (F.col("__n") * F.col("__above") + F.lit(shared).cast("double") * PRIOR) / (
        F.col("__n") + PRIOR
    )
    limits = own.select(lang, F.exp(F.col("__middle") + above).alias("threshold"))
    return stage(limits, "thresholds"), None if of_all is None else float(np.exp(of_all[1]))


def judge(
    docs: DataFrame,
    trusted: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    block: str | None = None,
    order: int = ORDER,
    quantile: float = QUANTILE,
) -> DataFrame:
    """docs without text, with perplexity, threshold and kept.

    trusted has the ids of trusted documents. block names a column of docs that is the same
    for neighbouring stored rows (some ten thousand of them) and does not change when they are
    read again; without one, docs are stored anew by the partition they came in.
    """
    if block is None:
        docs = stage(docs.withColumn("__block", F.spark_partition_id().cast("long")), "blocked")
    else:
        docs = docs.withColumn("__block", F.col(block).cast("long")).drop(block)
    good = trusted.select(F.col(doc_id)).where(F.col(doc_id).isNotNull()).distinct()
    unseen = F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0
    places = docs.select(F.col(doc_id), F.col("__block").alias("block"))
    counted = places.join(good.where(~unseen), doc_id, "left_semi")
    folder = _by_block(counted.select("block", F.col(doc_id).alias("id")), "trusted")
    model = Model(docs.select("__block", doc_id, text), folder, order)
    scored = stage(perplexities(docs, model, text).drop(text, "threshold", "kept"), "perplexity")
    reference = scored.join(good.where(unseen), doc_id, "left_semi").where("perplexity IS NOT NULL")
    limits, common = thresholds(reference, lang, quantile)
    return (
        scored.join(limits, lang, "left")
        .withColumn("threshold", F.coalesce("threshold", F.lit(common).cast("double")))
        .withColumn(
            "kept",
            F.col("perplexity").isNotNull()
            & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)),
        )
    )
