"""Checks of claim tables and of the whole flows."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators import views as V
from ..plans.ingest import ingest
from ..plans.verify import claim_evidence, store_answers, verdict_prompts
from ..session import shared_dir
from ..sources.tables import stage
from . import adapters as A
from .chunks import DIM, _chunk_table
from .hits import GOOD_SOURCE, evidence_sql
from .registry import check
from .texts import VERDICT_PARTS
from .web import LOW, PARAGRAPHS, landed, robots


@check("owner_claims", "SELECT id, owner_username FROM t_claims WHERE owner_username = 'user1'", ("t_claims",))
def owner_claims(spark, d):
    return V.owner_claims(A.claims(spark, d), "user1").select("id", "owner_username")


@check("recent_claims", """
    SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM t_claims WHERE owner_username = 'user2'
    ORDER BY t_claims.created_at DESC, id DESC LIMIT 5
    """, ("t_claims",))
def recent_claims(spark, d):
    return V.recent_claims(A.claims(spark, d), 5, "user2").select("id", A.stamp("created_at"))


@check("claim_gate", f"""
    SELECT id, CASE WHEN {A.trim('claim_text')} = '' THEN 'claim is empty' WHEN length({A.trim('claim_text')}) > 400
      THEN 'claim is too long' END AS reject_reason FROM t_claims
    """, ("t_claims",))
def claim_gate(spark, d):
    return A.claims(spark, d).select("id", V.claim_reject_reason("claim_text").alias("reject_reason"))


@check("claim_history", f"""
    SELECT * FROM (WITH known AS (SELECT DISTINCT conv_id AS claim_id FROM conversations WHERE turn = 0)
    SELECT conv_id AS claim_id, 0 AS section, NULL AS at, 0 AS entry_id, text, role AS note FROM conversations WHERE turn = 0
    UNION ALL
    SELECT h.claim_id, 1, NULL, rank, text, source_name FROM t_hits h JOIN known k ON k.claim_id = h.claim_id
    UNION ALL
    SELECT conv_id, 2, strftime(TIMESTAMP '{A.BASE}' + to_minutes(turn), '%Y-%m-%d %H:%M:%S'), conv_id * 1000 + turn, text, role
    FROM conversations WHERE turn > 0 AND conv_id IN (SELECT claim_id FROM known))
    """, ("t_hits",))
def claim_history(spark, d):
    claims, followups = A.threads(spark, d)
    history = V.claim_history(claims, followups, A.hits(spark, d))
    return history.select("claim_id", "section", A.stamp("at"), "entry_id", "text", "note")


# The plan of the claim check in SQL: chunk vectors, all distances, the five nearest, sources, prompt lines.
_VERIFY = f"""
    vectors AS (
      SELECT doc_id, chunk_index, list(CAST(x AS FLOAT) ORDER BY j) AS v FROM (
        SELECT doc_id, chunk_index, j, avg(x) AS x FROM (
          SELECT c.doc_id, c.chunk_index, unnest(range(0, 64)) AS j, unnest(s.v) AS x
          FROM t_chunk_rows c JOIN t_sentence_vectors s ON s.doc_id = c.doc_id AND s.i > c.first AND s.i <= c.stop)
        GROUP BY doc_id, chunk_index, j) GROUP BY doc_id, chunk_index
      UNION ALL
      SELECT doc_id, chunk_index, CAST({A.hashed('h')} AS FLOAT[]) FROM (
        SELECT doc_id, chunk_index, sha256(text) AS h FROM t_chunk_rows WHERE stop < 0)
    ), stored AS (
      SELECT c.doc_id, c.text, v.v, a.title, p.name AS source_name,
        coalesce(a.published_date, TIMESTAMP '{A.BASE}') AS published_date, nullif({A.trim('r.bias')}, '') AS bias,
        nullif({A.trim('r.factual_reporting')}, '') AS factual_reporting, nullif({A.trim('r.credibility')}, '') AS credibility,
        md5('a:' || c.doc_id || ':c:' || c.chunk_index) AS d
      FROM t_chunk_rows c JOIN vectors v ON v.doc_id = c.doc_id AND v.chunk_index = c.chunk_index
      JOIN t_content t ON t.article_id = c.doc_id JOIN t_articles a ON a.id = c.doc_id
      JOIN t_publishers p ON p.id = a.publisher_id LEFT JOIN t_ratings r ON r.rating_id = p.rating_id
    ), asked AS (
      SELECT claim_id, claim_text, {A.hashed('h')} AS v FROM (
        SELECT claim_id, {A.trim('claim_text')} AS claim_text, sha256({A.trim('claim_text')}) AS h FROM t_claims)
      WHERE length(claim_text) BETWEEN 1 AND 400
    ), nearest AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY distance, substr(d, 1, 12), '3' || substr(d, 14, 3), d) AS rank
        FROM (SELECT q.claim_id, s.*, CAST(1 - list_cosine_similarity(q.v, CAST(s.v AS DOUBLE[])) AS FLOAT) AS distance
              FROM asked q, stored s))
      WHERE rank <= 5 AND distance <= 0.5 AND {GOOD_SOURCE} AND NOT coalesce({A.norm('credibility')} IN ('very low', 'low'), FALSE)
    ), blocks AS (
      SELECT claim_id, string_agg({evidence_sql(False)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence
      FROM nearest GROUP BY claim_id
    )"""


@check("verify_claims", f"""
    SELECT * FROM (WITH {_VERIFY}
    SELECT q.claim_id, 'Check ' || claim_text || chr(10) || 'on 2024-06-01' || chr(10) || coalesce(evidence, '(no evidence found)')
      AS prompt FROM asked q LEFT JOIN blocks b ON b.claim_id = q.claim_id)
    """, ("t_chunk_rows", "t_sentence_vectors", "t_content", "t_articles", "t_publishers", "t_ratings", "t_claims"))
def verify_claims(spark, d):
    """Claims to prompts over the chunk table cut from all documents."""
    chunks = stage(_chunk_table(spark, d), f"{shared_dir(spark)}/verify_claims/{uuid4().hex}", "chunks")
    good, evidence, _ = claim_evidence(A.claims(spark, d).select("claim_id", "claim_text"), chunks, dim=DIM)
    template = "Check {{CLAIM}}\non {{TODAY}}\n{{EVIDENCE}}"
    return verdict_prompts(good, evidence, F.lit("2024-06-01").cast("date"), template)


@check("store_answers", f"""
    SELECT * FROM (WITH given AS (SELECT id, coalesce(answer, 'No text field found in AI response: '
        || '{{"candidates":[{{"content":{{"parts":[{{}}]}}}}]}}') AS answer FROM t_answers), {VERDICT_PARTS} SELECT * FROM judged)
    """, ("t_answers",))
def store_answers_query(spark, d):
    log = A.answers(spark, d).selectExpr(
        "id", "'claim' as claim_text", "cast(null as string) as model_answer", "cast(null as string) as verdict",
        "cast(null as string) as explanation",
    )
    part = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.col("answer").alias("text"))).alias("parts")).alias(
        "content"))).alias("candidates")))
    responses = A.answers(spark, d).select("id", part.alias("body"))
    return store_answers(log, responses).select("id", "verdict", "explanation")


# The ingestion plan in SQL. Pages answer by page number, see ``landed``; texts are cut as in ``extract_pages``.
INGEST_TABLES = {
    "i_found": (f"""
        SELECT k.*, k.article_id IS NULL AND first_rn = 1 AS is_new FROM (
          SELECT n.*, a.id AS article_id, row_number() OVER (PARTITION BY n.publisher_id, n.url_hash ORDER BY n.endpoint_id, n.pos)
            AS first_rn
          FROM (SELECT t.*, e.publisher_id, sha256(t.external_url) AS url_hash FROM t_new t JOIN t_endpoints e ON e.id = t.endpoint_id
            AND NOT (e.robots_disallowed OR coalesce(e.blocked_until > TIMESTAMP '{A.NOW}', FALSE))) n
          LEFT JOIN t_known_articles a ON a.publisher_id = n.publisher_id AND a.canonical_url_hash = n.url_hash) k
        """, ("t_new", "t_endpoints", "t_known_articles")),
    "i_pages": (f"""
        SELECT url, page_id % 6 AS v, body, good, NOT CASE length(host_key) % 4
            WHEN 0 THEN NOT (path LIKE '/en/%' AND path NOT LIKE '/en/7%') WHEN 1 THEN NOT (path LIKE '%.html' OR path LIKE '/fr%')
            WHEN 2 THEN scheme = 'https' ELSE TRUE END AS barred
        FROM (
          SELECT p.url, j.*, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path,
            regexp_extract(url, '^(https?)', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1))
              || CASE regexp_extract(url, '^(https?)', 1) WHEN 'https' THEN ':443' ELSE ':80' END AS host_key
          FROM pages p JOIN (WITH {PARAGRAPHS.format(n=2, chars=200)} SELECT * FROM judged) j ON j.page_id = p.page_id)""", ()),
    "i_judged": (f"""
        SELECT publisher_id, url_hash, endpoint_id, pos, source_item_id,
          coalesce(raw_text, CASE WHEN v = 5 AND good AND NOT barred THEN body END) AS text,
          CASE WHEN raw_text IS NOT NULL THEN 200 WHEN v IS NULL OR barred THEN NULL
            WHEN v = 0 THEN 403 WHEN v = 1 THEN 404 WHEN v = 2 THEN 500 ELSE 200 END AS http_status,
          CASE WHEN raw_text IS NOT NULL THEN NULL WHEN v IS NULL THEN 'Fetch failed' WHEN barred THEN 'Robots.txt disallows fetching'
            WHEN v IN (0, 2) THEN 'Blocked/Rate-limited/CAPTCHA suspected' WHEN v = 1 THEN 'HTTP status 404' END AS fetch_error,
          CASE WHEN raw_text IS NOT NULL OR v IS NULL OR barred THEN NULL WHEN v = 3 THEN 'Non-HTML contentType: application/pdf'
            WHEN v = 4 THEN 'Non-HTML contentType: null' WHEN v = 5 AND NOT good THEN {LOW} END AS extraction_error
        FROM i_found LEFT JOIN i_pages ON url = external_url WHERE is_new""", ("i_found", "i_pages")),
    # An endpoint's items up to its first stop signal.
    "i_stops": ("""
        SELECT endpoint_id, min(pos) AS stop FROM i_judged
        WHERE text IS NULL AND (fetch_error LIKE 'Blocked%' OR fetch_error LIKE 'Robots.txt%') GROUP BY endpoint_id""", ("i_judged",)),
    "i_results": ("""
        SELECT j.*, row_number() OVER (ORDER BY url_hash, publisher_id) + (SELECT max(id) FROM t_known_articles) AS id
        FROM i_judged j LEFT JOIN i_stops s ON s.endpoint_id = j.endpoint_id WHERE stop IS NULL OR pos <= stop
        """, ("i_judged", "i_stops", "t_known_articles")),
    "i_texts": ("SELECT id AS doc_id, text FROM i_results WHERE text IS NOT NULL", ("i_results",)),
}
A.TABLES.update(INGEST_TABLES)
A.TABLES.update(A.chunk_tables("i", "i_texts", ("i_texts",)))


@check("ingest_attempts", f"""
    SELECT * FROM (WITH outcome AS (
      SELECT endpoint_id, pos, text IS NOT NULL AS success, CASE WHEN text IS NOT NULL THEN NULL
        WHEN fetch_error LIKE 'Blocked%' THEN 'BLOCKED_OR_CAPTCHA' WHEN fetch_error LIKE 'Robots.txt%' THEN 'ROBOTS_DISALLOWED'
        WHEN extraction_error LIKE 'Low-quality%' THEN 'EXTRACTION_FAILED' END AS reason FROM i_results
    ), kept AS (
      SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN reason IN ('BLOCKED_OR_CAPTCHA', 'ROBOTS_DISALLOWED') THEN 1 ELSE 0 END)
        OVER (PARTITION BY endpoint_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops FROM outcome)
      WHERE stops = 0
    ), counts AS (
      SELECT endpoint_id, count(*) FILTER (success) AS processed, count(*) FILTER (NOT success) AS failed,
        CASE WHEN bool_or(reason = 'ROBOTS_DISALLOWED') THEN 'ROBOTS_DISALLOWED'
          WHEN bool_or(reason = 'BLOCKED_OR_CAPTCHA') THEN 'BLOCKED_OR_CAPTCHA'
          WHEN bool_or(reason = 'EXTRACTION_FAILED') THEN 'EXTRACTION_FAILED' END AS reason FROM kept GROUP BY endpoint_id
    )
    SELECT i.endpoint_id, CASE WHEN skip THEN 'SKIPPED' WHEN coalesce(failed, 0) = 0 THEN 'SUCCESS' WHEN processed > 0 THEN 'PARTIAL'
        ELSE 'FAILED' END AS status,
      CASE WHEN skip THEN 0 ELSE fetched END AS articles_fetched, CASE WHEN skip THEN 0 ELSE coalesce(processed, 0) END AS articles_processed,
      CASE WHEN skip THEN 0 ELSE coalesce(failed, 0) END AS articles_failed, CASE WHEN NOT skip THEN reason END AS reason
    FROM (SELECT endpoint_id, count(*) AS fetched FROM t_items GROUP BY endpoint_id) i
    JOIN (SELECT id, robots_disallowed OR coalesce(blocked_until > TIMESTAMP '{A.NOW}', FALSE) AS skip FROM t_endpoints) e
      ON e.id = i.endpoint_id LEFT JOIN counts c ON c.endpoint_id = i.endpoint_id)
    """, ("t_items", "t_endpoints", "i_results"))
def ingest_attempts(spark, d):
    """The whole ingestion plan over the pages table: status and counts per endpoint."""
    return _ingested(spark, d).attempts.select("endpoint_id", "status", "articles_fetched", "articles_processed",
                                               "articles_failed", "reason")


@check("ingest_articles", """
    SELECT id, publisher_id, url_hash AS canonical_url_hash, CASE WHEN text IS NULL THEN 'ERROR' ELSE 'INDEXED' END AS status,
      http_status, fetch_error, extraction_error, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS chunk_count,
      CASE WHEN text IS NOT NULL THEN TRUE END AS indexed
    FROM i_results LEFT JOIN (SELECT doc_id, count(*) AS n FROM i_chunk_rows GROUP BY doc_id) ON doc_id = id
    UNION ALL
    SELECT id, publisher_id, canonical_url_hash, 'INDEXED', NULL, NULL, NULL, NULL, NULL FROM t_known_articles
    """, ("i_results", "i_chunk_rows", "t_known_articles"))
def ingest_articles(spark, d):
    out = _ingested(spark, d).articles
    return out.select("id", "publisher_id", "canonical_url_hash", "status", "http_status", "fetch_error",
                      "extraction_error", "chunk_count", "indexed")


@check("ingest_links", """
    SELECT source_endpoint_id, source_item_id FROM t_known_links
    UNION ALL
    SELECT f.endpoint_id, f.source_item_id FROM i_found f LEFT JOIN i_stops s ON s.endpoint_id = f.endpoint_id
    WHERE (stop IS NULL OR f.pos <= stop) AND (f.article_id IS NOT NULL OR EXISTS (
      SELECT 1 FROM i_results r WHERE r.publisher_id = f.publisher_id AND r.url_hash = f.url_hash))
    """, ("t_known_links", "i_found", "i_stops", "i_results"))
def ingest_links(spark, d):
    return _ingested(spark, d).links.select("source_endpoint_id", "source_item_id")


@check("ingest_chunks", "SELECT doc_id AS article_id, count(*) AS n FROM i_chunk_rows GROUP BY doc_id", ("i_chunk_rows",))
def ingest_chunks(spark, d):
    return _ingested(spark, d).chunks.groupBy("article_id").agg(F.count("*").alias("n"))


def _ingested(spark, d):
    items = A.feed_items(spark, d)
    fetches = items.groupBy("endpoint_id").agg(F.count("*").alias("fetched")).withColumns({
        "fetch_error": F.lit(None).cast("string"), "sample_url": F.lit(None).cast("string"), "sample_allowed": F.lit(True),
    })
    return ingest(
        items, fetches, landed(spark, d).drop("page_id"), robots(spark, d), publishers=A.publishers(spark, d),
        endpoints=A.endpoints(spark, d), ratings=A.ratings(spark, d), articles=A.known_articles(spark, d),
        links=A.known_links(spark, d), now=A.now(), dim=DIM, work_dir=f"{shared_dir(spark)}/ingest/{uuid4().hex}",
        min_paragraphs=2, min_chars=200,
    )
