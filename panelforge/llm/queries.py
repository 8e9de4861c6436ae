"""Registered queries of the llm operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import (
    decontaminate,
    exact_dedup,
    html_wrapper,
    kneser_ney,
    language_id,
    packing,
    prefix_trie,
    quality_rules,
    simhash,
    suffix_dedup,
    url_filter,
    vector_codes,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Stored rows whose n-gram probabilities are looked up together.
BLOCK_ROWS = 20_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def _op10_sql() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted(set(quality_rules.STOP_WORDS)))
    return rf"""
WITH source AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM source, unnest(range(1, len(words) - 6)) AS t(i)),
repeats AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM repeats, range(8) AS r(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(list_intersect(list_distinct(words), [{stops}]))::BIGINT AS n_stop_words,
         len(list_filter(lines, lambda l: rtrim(l, ' ') LIKE '%...' OR
                         rtrim(l, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines,
         len(list_filter(lines, lambda l: ltrim(l, ' ') LIKE '- %' OR
                         ltrim(l, ' ') LIKE '* %' OR ltrim(l, ' ') LIKE '•%'))::BIGINT
           AS n_bullet_lines
  FROM source LEFT JOIN covered USING (doc_id)),
based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words
         OR 100 * n_symbols > 10 * n_words OR n_stop_words < 2
         OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_ellipsis_lines > 30 * n_lines
         OR 100 * n_bullet_lines > 90 * n_lines) AS kept
FROM based"""


@_query("op10_quality_rules", _op10_sql())
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rule table for every document."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@_query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    fold = language_id.held_out(F.col("doc_id"))
    known = docs.where(F.col("doc_id").isNotNull() & ~fold)
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(known))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "accepted")


@_query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_groups(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


@_query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 tokens."""
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@_query("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the bundles that were written."""
    found = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op7_html_wrapper")
def op7_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_wrapper.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


@_query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated strings of 50 bytes are removed."""
    found = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@_query("op9_kneser_ney")
def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of those labelled good, and the verdict."""
    row = F.col("_metadata.row_index")
    block = F.xxhash64(F.col("_metadata.file_path"), F.floor(row / BLOCK_ROWS))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.pmod(block, F.lit(1 << 40)).alias("block")
    )
    trusted = _table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0))
    found = kneser_ney.judge(docs, trusted, block="block")
    return found.select("doc_id", "lang", "perplexity", "threshold", "kept")


@_query(
    "op12_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and whether it is the one that stays."""
    found = exact_dedup.groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _op11_sql() -> str:
    """Every distance of every round, round by round."""
    rounds = []
    for k in range(vector_codes.ROUNDS + 1):
        rounds.append(f"""
near{k} AS MATERIALIZED (
  SELECT row, part, min(d * 16 + entry) % 16 AS entry, min(d * 16 + entry) // 16 AS d
  FROM (SELECT c.row, part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d
        FROM components c JOIN book{k} b USING (part, position) GROUP BY ALL)
  GROUP BY row, part)""")
        if k < vector_codes.ROUNDS:
            rounds.append(f"""
middle{k} AS (
  SELECT part, entry, position, sum(x) AS s, count(*)::HUGEINT AS n
  FROM near{k} JOIN components USING (row, part) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, position,
         CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM book{k} b LEFT JOIN middle{k} USING (part, entry, position))""")
    last = f"near{vector_codes.ROUNDS}"
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label,
         list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS MATERIALIZED (
  SELECT row, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS position, v[i] AS x
  FROM kept, unnest(range(1, len(v) + 1)) AS t(i)),
book0 AS (SELECT part, row - 1 AS entry, position, x FROM components WHERE row <= 16),
{",".join(rounds)},
coded AS (
  SELECT row, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code,
         sum(d)::BIGINT AS error
  FROM {last} GROUP BY row)
SELECT vec_id, code, error,
       (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, position))
        FROM book{vector_codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (row)"""


@_query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code, its error and that of its label, and a digest of the codebooks."""
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    return vector_codes.with_group_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


#: One step of CRC-32 by bits, over the ASCII codes of the id's digits.
_CRC_SQL = """
xor(list_reduce(list_prepend(4294967295::BIGINT,
                             list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
        lambda x, step: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
    4294967295)"""


@_query(
    "op13_prefix_trie",
    f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY i) AS own, ({_CRC_SQL}) % 6 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS MATERIALIZED (
  SELECT conv_id, d AS depth, path[1:d] AS path, d = len(path) AS ends
  FROM rebuilt, unnest(range(len(path) + 1)) AS t(d)),
nodes AS MATERIALIZED (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), ''))
           AS ends_sha256
  FROM prefixes GROUP BY depth, path),
children AS (
  SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL),
worth AS MATERIALIZED (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.path[-1].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children USING (depth, path)),
below AS (
  SELECT p.depth, p.path, sum(saved)::BIGINT AS saved_tokens,
         count(*) FILTER (n_children = 0) AS n_leaves
  FROM worth n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM worth n JOIN below USING (depth, path)
LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1]""",
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))
