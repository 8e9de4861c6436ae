"""Normalising of names and addresses."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.series import as_col
from panelforge.sources.staging import stage

# The helpers travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _accent_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus combining marks."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        decomposed = unicodedata.normalize("NFD", chr(code))
        base = [c for c in decomposed if not unicodedata.combining(c)]
        if len(decomposed) > 1 and len(base) == 1 and base[0] != chr(code):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_map()


def strip_accents(text: str | Column) -> Column:
    """Accented letters to their base letter; combining marks on their own are removed."""
    replaced = F.translate(as_col(text), _ACCENTED, _PLAIN)
    return F.regexp_replace(replaced, r"[\u0300-\u036f]", "")


def _squash(text: Column) -> Column:
    """Lower case without punctuation and outer blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\w\s]", ""))


def clean(text: str | Column, remove: Sequence[str | Column] = ()) -> Column:
    """Comparable form of a name: no accents, lower case, no punctuation, no given parts.

    ``remove`` lists columns (or literals) whose normalised text is cut out. An empty
    result becomes missing.
    """
    result = _squash(strip_accents(text))
    for part in remove:
        result = F.replace(result, F.coalesce(_squash(as_col(part)), F.lit("")), F.lit(""))
    return F.nullif(F.trim(result), F.lit(""))


def stop_words(codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct words of ``;``-separated entries, reduced to a-z and 0-9."""
    entries = codes.select(
        F.explode(
            F.flatten(F.array(*[F.coalesce(F.split(c, ";"), F.array()) for c in columns]))
        ).alias("entry")
    )
    word = F.regexp_replace(F.lower(F.trim("part")), "[^a-z0-9]", "")
    return (
        entries.distinct()
        .select(F.explode(F.split("entry", " ")).alias("part"))
        .select(word.alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )


#: Stop words that a projection carries as literals; longer lists are joined.
LITERAL_WORDS = 10_000


def _bare(text: Column) -> Column:
    """Text with letters a-z, digits and the blanks that separate words."""
    return F.regexp_replace(text, "(?i)[^a-z0-9 ]", "")


def _paired(text: Column) -> Column:
    """Every word with its bare form, in order."""
    return F.arrays_zip(
        F.split(text, " ").alias("word"), F.split(_bare(text), " ").alias("bare")
    )


def _strip_by_literals(text: Column, listed: Sequence[str]) -> Column:
    """Words whose bare form is not listed; the list is one hash set in the JVM."""
    kept = F.filter(_paired(text), lambda pair: ~pair["bare"].isin(*listed))
    return F.array_join(kept["word"], " ")


def _strip_by_join(df: DataFrame, stop_list: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same by a join of every word with the list, for lists of any length.

    Rows are numbered in a stored copy, so that rows without an id, or with the same one, do not
    mix. A row's words come back in order; they are at most its own.
    """
    numbered = stage(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    texts = F.array(
        *[F.struct(F.lit(c).alias("column"), _paired(F.col(c)).alias("pairs")) for c in columns]
    )
    words = (
        numbered.select("_row", F.explode(texts).alias("_e"))
        .select("_row", "_e.column", F.posexplode("_e.pairs").alias("at", "_p"))
        .select("_row", "column", "at", "_p.word", F.col("_p.bare").alias("_bare"))
    )
    kept = words.join(stop_list.select(F.col("word").alias("_bare")), "_bare", "left_anti")

    def ordered(c: str) -> Column:
        mine = F.when(F.col("column") == c, F.struct("at", "word"))
        return F.array_join(F.array_sort(F.collect_list(mine))["word"], " ").alias(f"_kept_{c}")

    back = kept.groupBy("_row").agg(*[ordered(c) for c in columns])
    joined = numbered.join(back, "_row", "left")
    return joined.select(*[F.col(f"_kept_{c}").alias(c) if c in columns else F.col(c)
                           for c in df.columns])


def strip_stop_words(
    df: DataFrame,
    stop_list: DataFrame,
    columns: Sequence[str],
    literal_words: int = LITERAL_WORDS,
) -> DataFrame:
    """Remove stop words from the columns, keeping word order; nothing left means missing.

    A list of at most ``literal_words`` words becomes part of one projection that moves no row;
    a longer one is joined.
    """
    found = stop_list.where(F.col("word").isNotNull()).select("word").distinct()
    listed = [r.word for r in found.limit(literal_words + 1).collect()]
    if not listed:
        stripped = df
    elif len(listed) <= literal_words:
        stripped = df.withColumns({c: _strip_by_literals(F.col(c), listed) for c in columns})
    else:
        stripped = _strip_by_join(df, found, columns)
    return stripped.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})
