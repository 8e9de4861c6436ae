"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled
texts. A text is encoded in lower case, in blocks and whole, with every dictionary; the language with the
smallest total wins. If the runner-up is nearly as small, the guess is not accepted.

Learning takes, per language, the document with the smallest id hash in each of `SAMPLES` hash
buckets: one map-side combined aggregate over ids, then one scan that picks those texts. At
most SAMPLES * DICTIONARY_BYTES bytes per language reach the driver.

Null texts and texts without a letter get "und", score 0, and are not accepted. With one
learned language every other text gets it; with none, "und". Ties go to the language that
sorts first. Repeated rows are judged one by one; input columns named like the results are
replaced, all others pass through.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 128
DICTIONARY_BYTES = 110_000
BLOCK_BYTES = 20_000
LEVEL = 6
MIN_MARGIN = 0.004
UNKNOWN = "und"


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the id falls into the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    samples: int = SAMPLES,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionaries by language from the rows given (the caller leaves out held-out rows)."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"),
        F.xxhash64(F.col(doc_id).cast("string")).alias("h"),
        F.col(text).alias("text"),
    )
    slot = F.pmod("h", F.lit(samples))
    chosen = usable.groupBy("lang", slot.alias("slot")).agg(F.min("h").alias("h"))
    # at most `samples` rows per language
    picked = usable.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"])
    each = -(-dictionary_bytes // samples)
    rows = (
        picked.groupBy("lang", "h")
        .agg(F.min(F.substring("text", 1, each)).alias("text"), F.count("*").alias("n"))
        .select("lang", "h", "text")
        .collect()
    )
    parts: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        parts.setdefault(row["lang"], []).append(row["text"].lower().encode()[:each])
    return {k: b"\n".join(v)[-dictionary_bytes:] for k, v in parts.items()}


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    made = []
    for name, content in dictionaries:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        made.append(
            (
                name,
                zstandard.ZstdCompressor(
                    level=level, dict_data=known, write_content_size=False, write_dict_id=False
                ),
            )
        )
    return made


def _judge_one(text: str | None, compressors, block: int) -> tuple[str, float, float]:
    """(language, score, margin) of one text."""
    if text is None or not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0
    data = text.lower().encode("utf-8", "surrogatepass")
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    sizes = sorted(
        (sum(len(c.compress(b)) for b in blocks), name) for name, c in compressors
    )
    best, name = sizes[0]
    if len(sizes) == 1:
        return name, 1.0, 1.0
    total = sum(2.0 ** max(best - size, -60) for size, _ in sizes)
    return name, 1.0 / total, (sizes[1][0] - best) / sizes[1][0]


_RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
    ]
)


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    level: int = LEVEL,
    block: int = BLOCK_BYTES,
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """docs with lang_pred, score, margin and accepted."""
    known = tuple(sorted(dictionaries.items()))

    @F.pandas_udf(_RESULT)
    def judged(texts: pd.Series) -> pd.DataFrame:
        compressors = _compressors(known, level)
        rows = [_judge_one(t, compressors, block) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "margin"])

    found = docs.withColumn("__found", judged(F.col(text)))
    fields = {n: F.col(f"__found.{n}") for n in ("lang_pred", "score", "margin")}
    return (
        found.withColumns(fields)
        .drop("__found")
        .withColumn(
            "accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= min_margin)
        )
    )
