"""Registered queries of the numbered operators, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import collocations, hard_negatives, host_arrays, impact_topk, minmax_hash, mixing, packing, rule_ledger, secret_forest, substrings, viterbi, wacz, weak_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query("op1_temperature_mix")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Every use of every document: no source repeated more than twice, each document used at least once."""
    return mixing.mix(_table(spark, d, "documents"), repetition_limit=2.0)


@_query("op2_debruijn_substrings", r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w)
), f AS (
  SELECT doc_id, p FROM g QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM f
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) AS w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, d, "documents"))


@_query("op3_impact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return impact_topk.top_k(_table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op4_viterbi_counts")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return viterbi.count_tokens(_table(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"))


@_query("op5_secret_forest")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with the forest's verdict; values only as digests."""
    found = secret_forest.scan(_table(spark, d, "documents"))
    return found.select("doc_id", "place", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


@_query("op6_weak_quality")
def op6(spark: SparkSession, d: str) -> DataFrame:
    scored = weak_quality.score_quality(_table(spark, d, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "accepted")


@_query("op7_rule_ledger", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)
), twice AS (
  SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
         len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutters
  FROM d LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_capitals > word_chars OR 3 * n_exclamations > n_words OR 100 * n_stutters > 30 * n_words) AS kept
FROM m
""")
def op7(spark: SparkSession, d: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(_table(spark, d, "documents")))
    base = F.col("failures").bitwiseAND(rule_ledger.mask(rule_ledger.BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


@_query("op8_wacz_reader", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CAST(CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS BIGINT) AS refers_to
FROM q
""")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return wacz.round_trip(_table(spark, d, "pages"))


@_query("op9_minmax_near_duplicates", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS gram FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g AS a JOIN g AS b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT l.y, r.root FROM r JOIN l ON r.id = l.x
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, min(root) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY w.doc_id, n
""")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return minmax_hash.near_duplicates(_table(spark, d, "documents"))


@_query("op10_differencing_pack")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"))


@_query("op11_packed_negatives", """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS anchor_id, c.id, q.label = c.label AS same, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.id % 50 = 0 AND q.id <> c.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    vectors = _table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


@_query("op12_son_collocations", r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), g AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, range(1, 6) AS s(k))
), f AS (
  SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(w)) AS n FROM t GROUP BY lang
), c AS (
  SELECT lang, phrase, k, a, j, array_to_string(w[1:j], ' ') AS left_part, array_to_string(w[j + 1:], ' ') AS right_part
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k >= 2)
), s AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.a AS l, r.a AS r, n, CAST(1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM c JOIN f AS l ON c.lang = l.lang AND left_part = l.phrase JOIN f AS r ON c.lang = r.lang AND right_part = r.phrase JOIN n ON c.lang = n.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1
), z AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a AS most
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k >= 3))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM s WHERE NOT EXISTS (FROM z WHERE z.lang = s.lang AND z.phrase = s.phrase AND most >= s.a)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(_table(spark, d, "documents"))


@_query("op13_host_suffix_text", r"""
WITH b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\x09-\x0D\x20]+', ' ', 'g'))) AS l
  FROM pages
)
SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10)) AS text, CAST(length(array_to_string(list_filter(l, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars FROM b
""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return host_arrays.extract(_table(spark, d, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
