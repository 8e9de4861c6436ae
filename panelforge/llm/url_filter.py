"""URL filters: rules first, then logistic regression on hashed character n-grams.

Rules are compiled into one CASE expression, longest rule first. The classifier is trained
from a small labelled URL table (a bounded table by contract: at most `MAX_LABELLED` rows are
taken) and its weights become one array literal, so judging is a projection over the scan:
no shuffle, no Python.

A null URL, or one without "://", has an empty host and path: no rule fits, and the classifier
judges an empty feature set by its intercept. Repeated rows are judged one by one. Input
columns named like the results are replaced; all others pass through.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.columns import ascii_lower

BUCKETS = 1 << 16
SIZES = (3, 4)
MAX_LABELLED = 10_000

#: Rules of the production query, (rule, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Default labelled table, from general web vocabulary: words that mark hosts to block, words of
#: ordinary hosts, and words that go with either kind, so that they tell nothing.
_MARKING = (
    "casino bet bets poker slots jackpot lottery pills viagra pharma adult porn xxx escort spam "
    "phish malware warez crack keygen torrent payday ads adserver clickbait"
).split()
_ORDINARY = (
    "river town garden station school library museum bakery cinema hospital mountain village "
    "weather kitchen orchestra bicycle football market harbour forest letters science history "
    "travel theatre"
).split()
_EITHER = "win free cheap best hot online club zone farm track shop x now news house land".split()
#: Frequent letter pairs, of which names without a meaning are made.
_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st nt to ng".split()
_TOP = ("example.com", "example.net", "example.org")
_PATHS = ("/en/12", "/fr/345.html", "/de/6789?page=2", "/es/77#top", "/index.html", "/a/b")
#: Hosts that the default table leaves out, to measure on hosts it has not seen.
_LEFT_OUT = frozenset("casino-win spam-farm ads-track free-bets cheap-pills adult-x".split())
#: Ordinary held-out addresses that may lie above the threshold.
FALSE_BLOCKS = 0.005


class Model(NamedTuple):
    weights: list[float]
    intercept: float
    threshold: float = 0.5


def _names(words: list[str]) -> list[str]:
    """Two-word names with one of the words that go with either kind, in both orders."""
    found = []
    for k, word in enumerate(words):
        for j, other in enumerate(_EITHER):
            first, last = (word, other) if (k + j) % 2 else (other, word)
            found.append(f"{first}{'-' if (k + j) % 3 else ''}{last}")
    return [name for name in found if name not in _LEFT_OUT]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, blocked (0 or 1), held_out (a fifth of the names)."""
    pairs, n = _PAIRS, len(_PAIRS)
    made = [f"{pairs[k % n]}{pairs[(5 * k + 1) % n]}{pairs[(k // n + 7) % n]}" for k in range(300)]
    blocked = _names(_MARKING)
    ordinary = [*_names(_ORDINARY), *made]
    rows = []
    for label, names in ((1, blocked), (0, ordinary)):
        names = sorted(set(names), key=lambda x: zlib.crc32(x.encode()))[: 7 * len(blocked) // 5]
        for k, name in enumerate(names):
            held_out = zlib.crc32(name.encode()) % 5 == 0
            for j, prefix in enumerate(("", "www.", "blog.", "m.")):
                host = f"{prefix}{name}.{_TOP[(k + j) % len(_TOP)]}"
                url = f"https://{host}{_PATHS[(k + j) % len(_PATHS)]}"
                rows.append(f"{label} {str(held_out).lower()} {url}")
    line = F.explode(F.split(F.lit("\n".join(rows)), "\n"))
    field = F.split("line", " ")
    return spark.range(1).select(line.alias("line")).select(
        field[2].alias("url"),
        field[0].cast("int").alias("blocked"),
        field[1].cast("boolean").alias("held_out"),
    )


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path, as the module describes."""
    at = F.instr(url, "://")
    has = F.coalesce(at > 0, F.lit(False))
    rest = F.when(has, F.substr(url, at + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, kind: str, buckets: int) -> Column:
    """Bucket numbers of the character n-grams of text."""
    found = []
    for n in SIZES:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
        found.append(
            F.transform(
                F.coalesce(starts, F.array().cast("array<int>")),
                lambda i, n=n: F.pmod(
                    F.xxhash64(F.lit(kind), F.substr(text, i, F.lit(n))), F.lit(buckets)
                ).cast("int"),
            )
        )
    return F.concat(*found)


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct hashed n-grams of host and path, kept apart by kind."""
    return F.array_distinct(
        F.concat(_grams(host, "host", buckets), _grams(path, "path", buckets))
    )


def train(labelled: DataFrame, buckets: int = BUCKETS, penalty: float = 0.0003) -> Model:
    """Logistic regression on at most MAX_LABELLED rows of (url, blocked).

    Rows marked in a column held_out, if there is one, are not learned: they set the threshold, so
    that at most FALSE_BLOCKS of the ordinary ones among them lie above it.
    """
    if "held_out" in labelled.columns:
        learned = train(labelled.where("NOT held_out").drop("held_out"), buckets, penalty)
        kept_back = labelled.where("held_out AND blocked = 0")
        scored = judge(kept_back, learned, rules=())
        above = scored.agg(F.percentile("block_score", 1 - FALSE_BLOCKS).alias("t")).first()["t"]
        return learned._replace(threshold=max(0.5, above or 0.5))
    host, path = host_and_path(F.col("url"))
    rows = (
        labelled.where(F.col("blocked").isNotNull())
        .limit(MAX_LABELLED)
        .select(host.alias("h"), path.alias("p"), F.col("blocked").cast("double").alias("label"))
        .select("label", features(F.col("h"), F.col("p"), buckets).alias("found"))
        .select("label", F.col("found").cast("array<string>").alias("found"))
        .coalesce(1)
        .persist()
    )
    # Bucket numbers are their own vocabulary: each becomes its place in a sparse vector.
    numbered = CountVectorizerModel.from_vocabulary(
        [str(k) for k in range(buckets)], inputCol="found", outputCol="features"
    ).setBinary(True)
    try:
        fitted = LogisticRegression(
            regParam=penalty, maxIter=60, standardization=False
        ).fit(numbered.transform(rows))
    finally:
        rows.unpersist()
    return Model([float(w) for w in fitted.coefficients.toArray()], float(fitted.intercept))


def _rule_test(rule: str, host: Column, path: Column) -> Column:
    rule_host, slash, rule_path = rule.partition("/")
    fits = (host == rule_host) | host.endswith(f".{rule_host}")
    return fits & path.startswith(f"{slash}{rule_path}")


def judge(
    pages: DataFrame,
    model: Model,
    rules: tuple[tuple[str, str], ...] = RULES,
    url: str = "url",
) -> DataFrame:
    """pages with host, path, rule, block_score and verdict."""
    host, path = host_and_path(F.col(url))
    split = pages.withColumn("host", host).withColumn("path", path)
    ordered = sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].partition("/")[0]), r[0]))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for text, said in reversed(ordered):
        test = _rule_test(text, F.col("host"), F.col("path"))
        rule = F.when(test, F.lit(text)).otherwise(rule)
        verdict = F.when(test, F.lit(said)).otherwise(verdict)
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    total = F.aggregate(
        features(F.col("host"), F.col("path"), len(model.weights)),
        F.lit(model.intercept),
        lambda acc, bucket: acc + F.get(weights, bucket),
    )
    return (
        split.withColumn("rule", rule)
        .withColumn("block_score", 1 / (1 + F.exp(-total)))
        .withColumn(
            "verdict",
            F.coalesce(verdict, F.when(F.col("block_score") > model.threshold, "block").otherwise("allow")),
        )
    )
