"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in column expression and every rule compares two integers, so the
whole judgement is a projection over the scan: no shuffle, no Python, no state.

Null and blank texts have no words; all measures are 0, the base check fails and the document
is not kept. Repeated rows are judged one by one. Columns of the input whose names the
operator adds are replaced; all others pass through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.columns import SPACES, let, words

#: Symbols counted, window length, base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is it for as with by on are this from at or an be was not have "
    "der die das und in zu den von mit sich für ist im dem nicht ein eine als auch auf "
    "le la les de des du et à un une que en pour dans qui est sur pas au par "
    "el los las y o un una que en por con para se su al lo como del"
).split()


class Rule(NamedTuple):
    """A document fails if factor * measure > limit * per (or <, if sign is "<")."""

    name: str
    factor: int
    measure: str
    sign: str
    limit: int
    per: str


#: The table of the production query. "one" is the constant 1; n_stop_words counts the
#: different stop words that occur.
RULES = (
    Rule("word_length_low", 10, "word_chars", "<", 20, "n_words"),
    Rule("word_length_high", 10, "word_chars", ">", 150, "n_words"),
    Rule("symbols", 100, "n_symbols", ">", 10, "n_words"),
    Rule("stop_words", 1, "n_stop_words", "<", 2, "one"),
    Rule("duplicate_lines", 100, "n_dup_lines", ">", 30, "n_lines"),
    Rule("ellipsis_lines", 100, "n_ellipsis_lines", ">", 30, "n_lines"),
    Rule("bullet_lines", 100, "n_bullet_lines", ">", 90, "n_lines"),
)


def _repeat_words(found: Column, size: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the text.

    Window hashes only show whether anything can repeat (equal windows have equal hashes);
    then the windows themselves are sorted, so the count is exact.
    """
    starts = F.sequence(F.lit(1), size - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, window)))
    suspicious = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    windows = F.sort_array(
        F.transform(
            starts,
            lambda i: F.struct(
                F.array_join(F.slice(found, i, window), " ").alias("w"), i.alias("i")
            ),
        )
    )

    def repeated(s: Column) -> Column:
        def twin(k: Column) -> Column:
            before = F.when(k > 0, F.get(s, k - 1)["w"])
            after = F.get(s, k + 1)["w"]
            here = F.get(s, k)["w"]
            return F.coalesce(here == before, F.lit(False)) | F.coalesce(
                here == after, F.lit(False)
            )

        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin)
        return F.sort_array(F.transform(at, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        steps = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        total = F.aggregate(
            steps,
            F.lit(window),
            lambda acc, k: acc + F.least(F.lit(window), F.get(p, k) - F.get(p, k - 1)),
        )
        return F.when(F.size(p) == 0, 0).otherwise(total)

    exact = let(let(windows, repeated), covered)
    return F.when(size < window, 0).when(~suspicious, 0).otherwise(exact).cast("long")


def measures(
    text: Column, window: int = WINDOW, stop_words: tuple[str, ...] | list[str] = STOP_WORDS
) -> dict[str, Column]:
    """The counts the rules may use: two structs (by word, by line) and the symbols."""
    text = F.coalesce(text, F.lit(""))
    stops = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    blank = F.lit(SPACES)

    def of_words(found: Column) -> list[Column]:
        size = F.size(found)
        return [
            size.cast("long").alias("n_words"),
            F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
            F.size(F.array_intersect(found, stops)).cast("long").alias("n_stop_words"),
            _repeat_words(found, size, window).alias("n_repeat_words"),
        ]

    def of_lines(lines: Column) -> list[Column]:
        def having(test) -> Column:
            return F.size(F.filter(lines, test)).cast("long")

        return [
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            having(
                lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…")
            ).alias("n_ellipsis_lines"),
            having(
                lambda line: F.ltrim(line).startswith("- ")
                | F.ltrim(line).startswith("* ")
                | F.ltrim(line).startswith("•")
            ).alias("n_bullet_lines"),
        ]

    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, blank) != "")
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))
    return {
        "__by_word": let(words(text), lambda found: F.struct(*of_words(found))),
        "__by_line": let(lines, lambda found: F.struct(*of_lines(found))),
        "n_symbols": symbols.cast("long"),
    }


_WORD = ("n_words", "word_chars", "n_stop_words", "n_repeat_words")
_LINE = ("n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines")


def compile_rules(rules: tuple[Rule, ...], measure: dict[str, Column]) -> list[Column]:
    """One boolean column per rule: true where the document breaks it."""
    values = measure | {"one": F.lit(1)}
    compiled = []
    for rule in rules:
        left, right = rule.factor * values[rule.measure], rule.limit * values[rule.per]
        compiled.append(left > right if rule.sign == ">" else left < right)
    return compiled


def judge(
    docs: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    window: int = WINDOW,
    stop_words: tuple[str, ...] | list[str] = STOP_WORDS,
) -> DataFrame:
    """docs with every measure, base_failed, broken (names of broken rules) and kept."""
    found = docs.withColumns(measures(F.col(text), window, stop_words))
    fields = {n: F.col(f"__by_word.{n}") for n in _WORD}
    fields |= {n: F.col(f"__by_line.{n}") for n in _LINE}
    found = found.withColumns(fields).drop("__by_word", "__by_line")
    named = {n: F.col(n) for n in (*fields, "n_symbols")}
    base = (named["n_words"] < min_words) | (
        100 * named["n_repeat_words"] > max_repeat_percent * named["n_words"]
    )
    broken = F.array_compact(
        F.array(
            *[
                F.when(test, F.lit(rule.name))
                for rule, test in zip(rules, compile_rules(rules, named), strict=True)
            ]
        )
    )
    return (
        found.withColumn("base_failed", base)
        .withColumn("broken", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )
