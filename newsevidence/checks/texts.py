"""Checks of the text scalars and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text, vectors
from ..functions.answers import parse_verdict
from ..operators.sentences import split_sentences_trained, train_sentences
from ..operators.views import batch_reject_reasons, sentences_reject_reason, text_reject_reason, vector_reject_reason
from . import adapters as A
from .registry import check


def _documents(spark, d):
    return A.load_wide(spark, d, "documents")


@check("table_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def table_scan(spark, d):
    from ..sources.tables import read_table

    return read_table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


@check("clean_text", f"SELECT doc_id, {A.clean('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return _documents(spark, d).select("doc_id", text.clean_text("text").alias("cleaned"))


@check("sentences", """
    SELECT doc_id, unnest(range(0, len(sentences))) AS pos, unnest(sentences) AS sentence FROM t_sentences
    """, ("t_sentences",))
def sentences(spark, d):
    docs = _documents(spark, d)
    return docs.select("doc_id", F.posexplode(text.split_sentences("text")).alias("pos", "sentence"))


_LEFT, _RIGHT = r"""["''“”‘’«»(\[{]""", r"""["''“”‘’«»)\]},;:!?]"""


def _type(w: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({w}), '^{_LEFT}+|{_RIGHT}+$', '', 'g'), '\.$', '')"


_MARKED = r"""([.!?])["''”’»)\]]*$"""
_MODEL = rf"""
    WITH words AS (
      SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w
      FROM (SELECT doc_id, list_filter(string_split({A.clean('text')}, ' '), lambda x: x <> '') AS w FROM documents)),
    tokens AS (
      SELECT doc_id, i, w, {_type('w')} AS type, regexp_extract(w, '{_MARKED}', 1) AS mark,
        regexp_replace(lower(w), '^{_LEFT}+|{_RIGHT}+$', '', 'g') LIKE '%.' AS stop,
        lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS next, lead({_type('w')}) OVER (PARTITION BY doc_id ORDER BY i) AS after
      FROM words),
    counts AS (
      SELECT type, count(*) FILTER (stop) AS d, count(*) FILTER (NOT stop) AS r FROM tokens WHERE regexp_matches(type, '\p{{L}}') GROUP BY 1),
    totals AS (SELECT CAST(sum(d + r) AS DOUBLE) AS n, sum(d) / sum(d + r) AS p FROM counts),
    abbreviations AS (
      SELECT type, -2 * ((d * ln(p) + r * ln(1 - p)) - (d * ln(0.99) + r * ln(0.01))) * exp(-len(replace(type, '.', '')))
        * (len(type) - len(replace(type, '.', '')) + 1) * pow(CAST(len(replace(type, '.', '')) AS DOUBLE), -r) AS score
      FROM counts, totals WHERE d > 0),
    short AS (SELECT * FROM abbreviations WHERE score >= 0.3),
    follows AS (
      SELECT after AS type, CAST(count(*) AS DOUBLE) AS ab FROM tokens t
      WHERE mark <> '' AND next IS NOT NULL AND (mark <> '.' OR len(type) > 1 AND type NOT LIKE '%.'
        AND type NOT IN (SELECT type FROM short)) GROUP BY 1),
    found AS (
      SELECT f.type, ab, CAST(d + r AS DOUBLE) AS b, (SELECT sum(ab) FROM follows) AS a, n
      FROM follows f JOIN counts c ON f.type = c.type, totals),
    firsts AS (
      SELECT type, -2 * (ab * ln(b / n) + (a - ab) * ln(1 - b / n) + (b - ab) * ln(b / n) + (n - a - b + ab) * ln(1 - b / n)
        - ab * ln(least(ab / a, 1 - 1e-12)) - (a - ab) * ln(greatest(1 - ab / a, 1e-12))
        - (b - ab) * ln(greatest((b - ab) / (n - a), 1e-12)) - (n - a - b + ab) * ln(least(1 - (b - ab) / (n - a), 1 - 1e-12))) AS score
      FROM found WHERE ab / b > a / n),
    starters AS (SELECT * FROM firsts WHERE score >= 30)
    """


@check("sentence_model", _MODEL + """
    SELECT 'abbreviation' AS kind, type, round(score, 6) AS score FROM short
    UNION ALL SELECT 'starter', type, round(score, 6) FROM starters
    """)
def sentence_model(spark, d):
    return train_sentences(_documents(spark, d)).select("kind", "type", F.round("score", 6).alias("score"))


@check("sentences_trained", _MODEL + rf"""
    , flags AS (
      SELECT doc_id, i, w, next IS NOT NULL AND mark <> '' AND CASE
        WHEN mark <> '.' THEN TRUE
        WHEN type IN (SELECT type FROM short) OR regexp_matches(type, '^\p{{L}}$') OR type LIKE '%.'
          THEN after IN (SELECT type FROM starters) AND regexp_matches(next, '^{_LEFT}*\p{{Lu}}')
        WHEN regexp_matches(type, '^\p{{N}}[\p{{N}}.,]*$') THEN NOT regexp_matches(next, '^{_LEFT}*\p{{Ll}}')
        ELSE TRUE END AS ends
      FROM tokens),
    placed AS (SELECT doc_id, i, w, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM flags),
    whole AS (SELECT doc_id, s, string_agg(w, ' ' ORDER BY i) AS sentence FROM placed GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos, sentence FROM whole WHERE length(sentence) >= 3
    """)
def sentences_trained(spark, d):
    docs = _documents(spark, d)
    split = split_sentences_trained(docs, train_sentences(docs))
    return split.select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))


@check("dedup_key", rf"""
    SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}]+', ' ', 'g')) AS dedup_key
    FROM documents
    """)
def dedup_key(spark, d):
    """SQL has no NFKC; the supplied texts hold no character that NFKC changes, so both sides agree."""
    return _documents(spark, d).select("doc_id", text.dedup_key("text").alias("dedup_key"))


@check("url_hash", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash(spark, d):
    return A.load(spark, d, "pages").select("page_id", keys.sha256_hex("url").alias("url_hash"))


@check("domains", r"""
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS domain
    FROM pages
    """)
def domains(spark, d):
    return A.load(spark, d, "pages").select("page_id", keys.normalize_domain("url").alias("domain"))


@check("field_norm", """
    SELECT id, nullif(trim(country_code), '') AS trimmed, lower(nullif(trim(website_url), '')) AS lowered,
      coalesce(upper(nullif(trim(country_code), '')), 'XX') AS country, coalesce(lower(nullif(trim(country_code), '')), 'en')
        AS language
    FROM t_publishers
    """, ("t_publishers",))
def field_norm(spark, d):
    return A.publishers(spark, d).select(
        "id",
        text.trim_to_null("country_code").alias("trimmed"),
        text.lower_or("website_url").alias("lowered"),
        text.upper_or("country_code", "XX").alias("country"),
        text.lower_or("country_code", "en").alias("language"),
    )


@check("labels_norm", f"""
    SELECT rating_id, {A.norm('bias')} AS bias, {A.norm('factual_reporting')} AS factual_reporting,
      {A.norm('credibility')} AS credibility FROM t_ratings
    """, ("t_ratings",))
def labels_norm(spark, d):
    labels = ("bias", "factual_reporting", "credibility")
    return A.ratings(spark, d).select("rating_id", *[text.normalize_label(c).alias(c) for c in labels])


@check("token_est", """
    SELECT doc_id, CAST(coalesce(list_sum(list_transform(sentences, lambda s: length(s))), 0) // 4 AS BIGINT) AS tokens FROM t_sentences
    """, ("t_sentences",))
def token_est(spark, d):
    docs = _documents(spark, d)
    return docs.select("doc_id", text.estimate_tokens(text.split_sentences("text")).alias("tokens"))


@check("chunk_ids", """
    SELECT article_id, j, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
      || CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9'
         WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id
    FROM (SELECT article_id, id % 4 AS j, md5('a:' || article_id || ':c:' || (id % 4)) AS h FROM t_links)
    """, ("t_links",))
def chunk_ids(spark, d):
    rows = A.links(spark, d).selectExpr("article_id", "id % 4 as j")
    return rows.select("article_id", "j", keys.chunk_object_id("article_id", "j").alias("chunk_id"))


@check("hash_embed", f"""
    SELECT doc_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first_value, round(v[40], 6) AS middle_value,
      len(v) AS dim
    FROM (SELECT doc_id, {A.hashed('h')} AS v
          FROM (SELECT doc_id, sha256(text) AS h FROM documents))
    """)
def hash_embed(spark, d):
    docs = _documents(spark, d).select("doc_id", vectors.hash_embedding("text", 64).alias("v"))
    return docs.select(
        "doc_id",
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.col("v")[0], 6).alias("first_value"),
        F.round(F.col("v")[39], 6).alias("middle_value"),
        F.size("v").alias("dim"),
    )


@check("embed_udf", f"""
    SELECT doc_id, round(list_sum(v), 3) AS total, len(v) AS dim
    FROM (SELECT doc_id, {A.hashed('h')} AS v
          FROM (SELECT doc_id, sha256(text) AS h FROM documents))
    """)
def embed_udf(spark, d):
    """The embedder hook, driven by a Python embedder that must agree with the native one."""
    docs = _documents(spark, d).select("doc_id", "text")
    out = vectors.embed(docs, "text", lambda texts: vectors.digest_matrix(texts, 64), dim=64)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("doc_id", F.round(total, 3).alias("total"), F.size("vector").alias("dim"))


@check("cosine_pairs", """
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
    """)
def cosine_pairs(spark, d):
    e = A.load(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) v")
    nxt = e.selectExpr("vec_id - 1 as vec_id", "v as w")
    return e.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine("v", "w"), 6).alias("cosine"))


@check("iso_dates", """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed
    FROM events
    """)
def iso_dates(spark, d):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    variant = F.col("event_id") % 6
    raw = (
        F.when(variant == 0, F.lit(" ")).when(variant == 1, F.lit("not-a-date"))
        .when(variant == 2, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
        .when(variant == 3, F.concat(iso, F.lit("Z"))).when(variant == 4, F.concat(iso, F.lit(".5Z")))
        .otherwise(F.concat(iso, F.lit("+00:00")))
    )
    parsed = text.parse_iso_utc(raw)
    events = A.load(spark, d, "events")
    return events.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


# Parts of the verdict rule in SQL, over a table ``given(id, answer)``.
VERDICT_PARTS = rf"""
    lines AS (
      SELECT id, {A.trim('answer')} AS t FROM given
    ), tagged AS (
      SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\r\n|\n|\r'), lambda s: lower({A.trim('s')})),
        lambda s: starts_with(s, 'verdict:'))[1] AS line FROM lines
    ), parts AS (
      SELECT *, trim(substr(line, 9)) AS value,
        {A.trim("regexp_replace(t, '(?is)^" + chr(92) + "s*verdict" + chr(92) + "s*:[^" + chr(92) + "n" + chr(92) + "r]*[" + chr(92) + "n" + chr(92) + "r]*', '')")} AS rest
      FROM tagged
    ), judged AS (
    SELECT id, CASE WHEN starts_with(value, 'true') THEN 'true' WHEN starts_with(value, 'false') THEN 'false'
        WHEN starts_with(value, 'mixed') THEN 'mixed' ELSE 'unclear' END AS verdict,
      CASE WHEN rest IS NULL OR rest = '' THEN '(no explanation)' ELSE rest END AS explanation
    FROM parts)"""


@check("verdicts", f"""
    SELECT * FROM (WITH given AS (SELECT id, answer FROM t_answers), {VERDICT_PARTS} SELECT * FROM judged)
    """, ("t_answers",))
def verdicts(spark, d):
    parsed = A.answers(spark, d).select("id", parse_verdict("answer").alias("p"))
    return parsed.select("id", "p.verdict", "p.explanation")


@check("snippets", f"""
    SELECT doc_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 397) || '...' WHEN t = '' THEN NULL ELSE t END AS snippet
    FROM (SELECT doc_id, {A.trim('text')} AS t FROM documents)
    """)
def snippets(spark, d):
    return _documents(spark, d).select("doc_id", text.snippet("text").alias("snippet"))


@check("paragraphs", f"""
    SELECT d.doc_id, coalesce(len(ps), 0) AS n_paragraphs, coalesce(array_to_string(ps, chr(10) || chr(10)), '') AS joined
    FROM documents d LEFT JOIN (
      SELECT doc_id, coalesce(list(p ORDER BY i), []) AS ps
      FROM (SELECT doc_id, p, min(i) AS i
            FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS p FROM (
                SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: {A.trim('s')}) AS l FROM documents))
            WHERE length(p) >= 40 GROUP BY doc_id, p)
      GROUP BY doc_id) k ON k.doc_id = d.doc_id
    """)
def paragraphs(spark, d):
    docs = _documents(spark, d)
    kept = docs.select("doc_id", text.keep_paragraphs(F.split("text", "\n")).alias("ps"))
    return kept.select("doc_id", F.size("ps").alias("n_paragraphs"), text.join_paragraphs("ps").alias("joined"))


@check("quality_gate", r"""
    SELECT doc_id, n >= 5 AND length(text) >= 1500 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) > length(text) * 0.5
      AS good
    FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents)
    """)
def quality_gate(spark, d):
    docs = _documents(spark, d).withColumn("n", F.size(F.split("text", "\n")))
    return docs.select("doc_id", text.passes_quality("text", "n").alias("good"))


@check("text_gate", f"""
    SELECT doc_id, CASE WHEN {A.trim('text')} = '' THEN 'text is empty'
      WHEN length({A.trim('text')}) > 20000 THEN 'text is too long' END AS reject_reason FROM documents
    """)
def text_gate(spark, d):
    docs = _documents(spark, d)
    return docs.select("doc_id", text_reject_reason("text", 20_000).alias("reject_reason"))


@check("batch_gate", f"""
    SELECT source, count(*) AS n_items, CAST(sum(length({A.trim('text')})) AS BIGINT) AS n_chars,
      CASE WHEN count(*) > 100 THEN 'too many texts in one request'
        WHEN bool_or({A.trim('text')} = '') THEN 'a text is empty'
        WHEN max(length({A.trim('text')})) > 20000 THEN 'a text is too long'
        WHEN sum(length({A.trim('text')})) > 100000 THEN 'total size exceeds the limit' END AS reject_reason
    FROM documents GROUP BY source
    """)
def batch_gate(spark, d):
    docs = _documents(spark, d).select("source", "text")
    return batch_reject_reasons(docs, "source", "text", max_chars=20_000, max_total=100_000)


@check("sentence_gate", f"""
    SELECT doc_id, CASE WHEN len(l) > 40 THEN 'too many sentences in one request'
      WHEN list_sum(list_transform(l, lambda x: length({A.trim('x')}))) > 8000 THEN 'total size exceeds the limit'
      WHEN len(list_filter(l, lambda x: {A.trim('x')} = '')) > 0 THEN 'a sentence is empty'
      WHEN len(list_filter(l, lambda x: length(x) > 400)) > 0 THEN 'a sentence is too long' END AS reject_reason
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    """)
def sentence_gate(spark, d):
    docs = _documents(spark, d).withColumn("l", F.split("text", "\n"))
    return docs.select("doc_id", sentences_reject_reason("l", 40, 400, 8_000).alias("reject_reason"))


@check("vector_gate", """
    SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'vector size is -1' WHEN vec_id % 7 = 0 THEN 'vector size is 3'
      WHEN len(embedding) <> 64 THEN 'vector size is ' || len(embedding) END AS reject_reason FROM embeddings
    """)
def vector_gate(spark, d):
    cut = A.load(spark, d, "embeddings").selectExpr(
        "vec_id", "case when vec_id % 11 = 0 then null when vec_id % 7 = 0 then slice(embedding, 1, 3) else embedding end as v")
    return cut.select("vec_id", vector_reject_reason("v", 64).alias("reject_reason"))
