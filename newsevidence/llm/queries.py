"""The operators applied to their whole tables; contract columns are derived here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(apply_options(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    from .sharding import tree_shards

    return tree_shards(_table(spark, folder, "documents"), shards=40)


@query
def op3_letter_profiles(spark: SparkSession, folder: str) -> DataFrame:
    from .langid import identify_languages

    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    return identify_languages(_table(spark, folder, "documents"), train)


@query
def op5_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import quality_cascade

    return quality_cascade(_table(spark, folder, "documents")).drop("failed_rule")


_WORD = r"[^\x20\x09-\x0D]+"
ORACLES["op5_rule_cascade"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, t, lines, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2 * n_words AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * len(lines)
  AND NOT (word_chars > 20 * n_words
    AND 2 * length(regexp_replace(t, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}\p{{Tibetan}}]+', '', 'g')) > length(t))
  AND 2 * length(regexp_replace(t, '\P{{L}}+', '', 'g')) >= word_chars
  AND 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) <= 9 * len(lines) AS kept
FROM j
"""


@query
def op7_chunk_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    from .pieces import encode_pieces

    coded = encode_pieces(_table(spark, folder, "documents"), path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op2_capture_index(spark: SparkSession, folder: str) -> DataFrame:
    from .common import run_folder
    from .warc import look_up, resolved, url_key, write_archives, write_index

    pages, place = _table(spark, folder, "pages"), run_folder(spark)
    parts = write_index(write_archives(pages, place), place)
    return resolved(look_up(pages.select(url_key(F.col("url"))), parts, place))


ORACLES["op2_capture_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, min(page_id) AS keeper FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest,
  CASE WHEN keeper IS NULL OR keeper = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> d.page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND payload_bytes >= 100
"""


@query
def op9_seed_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import contaminated_passages

    found = contaminated_passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "score", "similarity", "end_word")


@query
def op6_window_graph(spark: SparkSession, folder: str) -> DataFrame:
    from .substrings import remove_repeats

    kept = remove_repeats(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op6_window_graph"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) > 12)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS f FROM windows) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM later),
places AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT p.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p.i) AS t
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op8_minhash_bands(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(_table(spark, folder, "documents"))


ORACLES["op8_minhash_bands"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
texts AS (SELECT min(doc_id) AS id, text, count(*) AS copies, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY text),
grams AS (
  SELECT DISTINCT id, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM texts)),
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY 1),
links AS (
  SELECT a.id AS a, b.id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id
  JOIN sizes x ON x.id = a.id JOIN sizes y ON y.id = b.id
  GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*)) - 1e-9),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1),
reach AS (SELECT id AS a, id AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(t.id, w.doc_id) AS text_id, coalesce(copies, 1) AS n_copies, coalesce(n, 0) AS n_links,
  coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN texts t ON t.text = w.text LEFT JOIN degree g ON g.id = t.id LEFT JOIN class c ON c.id = t.id
"""


@query
def op4_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from .scoring import mixed_scores

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return mixed_scores(_table(spark, folder, "documents"), held_out)


@query
def op10_license_paths(spark: SparkSession, folder: str) -> DataFrame:
    from .licenses import scan_licenses

    docs = _table(spark, folder, "documents")
    # The table has no paths; a document lies in the directory of its source and language.
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"))


@query
def op11_neighbour_descent(spark: SparkSession, folder: str) -> DataFrame:
    from .neighbours import nearest

    rows = _table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op12_packed_negatives(spark: SparkSession, folder: str) -> DataFrame:
    from .negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, folder, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_packed_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_dot_product(a.parts, c.parts) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


@query
def op13_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    from .periodic import contract_rewrite, periodic_runs

    found = periodic_runs(_table(spark, folder, "documents"), contract_rewrite)
    runs = F.arrays_zip("lengths", "starts", "periods")
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["lengths"]).alias("less"), r["starts"].alias("start"), r["periods"].alias("period"))))
    found = found.withColumn("best", best).withColumn("length", -F.col("best.less"))
    return found.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.floor(1000 * F.col("length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
