"""Checks of page extraction, fetch outcomes and robots rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web as W
from ..operators.pages import extract_pages as extract
from ..operators.pages import fetch_results as fetched
from ..operators.robots import host_key, robots_filter
from . import adapters as A
from .registry import check


def landed(spark, d):
    """Pages as landed answers: status, type and body vary by page."""
    return A.load_wide(spark, d, "pages").selectExpr(
        "page_id",
        "url",
        "case page_id % 6 when 0 then 403 when 1 then 404 when 2 then 500 else 200 end as http_status",
        "case page_id % 6 when 3 then 'application/pdf' when 4 then null else 'text/html; charset=utf-8' end as content_type",
        "if(page_id % 6 = 2, concat('Please Verify  you are\\n human ', html), html) as body",
    )


@check("fetch_outcomes", """
    SELECT page_id, page_id % 6 IN (0, 2) AS blocked,
      CASE WHEN page_id % 6 IN (0, 2) THEN 'Blocked/Rate-limited/CAPTCHA suspected'
        WHEN page_id % 6 = 1 THEN 'HTTP status 404' END AS fetch_error,
      CASE page_id % 6 WHEN 3 THEN 'Non-HTML contentType: application/pdf' WHEN 4 THEN 'Non-HTML contentType: null' END
        AS type_error
    FROM pages
    """)
def fetch_outcomes(spark, d):
    return landed(spark, d).select(
        "page_id",
        W.blocked_suspected("http_status", "body").alias("blocked"),
        W.fetch_error("http_status", "body").alias("fetch_error"),
        W.content_type_error("http_status", "content_type").alias("type_error"),
    )


@check("media_urls", """
    SELECT pos, external_url LIKE '%/VIDEO/%' AS is_media, external_url LIKE '%/VIDEO/%' AND raw_text IS NULL AS skipped
    FROM t_items
    """, ("t_items",))
def media_urls(spark, d):
    return A.feed_items(spark, d).select("pos", W.is_media_url("external_url").alias("is_media"),
                                         W.skips_media("external_url", "raw_text").alias("skipped"))


@check("block_reasons", """
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'BLOCKED_OR_CAPTCHA' WHEN 1 THEN 'ROBOTS_DISALLOWED'
      WHEN 2 THEN 'EXTRACTION_FAILED' WHEN 3 THEN 'ROBOTS_DISALLOWED' END AS reason FROM pages
    """)
def block_reasons(spark, d):
    pages = A.load(spark, d, "pages").selectExpr(
        "page_id",
        "page_id % 6 = 0 as blocked",
        "case page_id % 6 when 0 then 'robots.txt' when 1 then 'Robots.txt disallows fetching'"
        " when 3 then 'no ROBOTS.TXT rule' when 4 then 'HTTP status 500' end as fetch_error",
        "case page_id % 6 when 2 then 'Low-quality extraction (x)' when 3 then 'low-quality extraction'"
        " when 5 then 'Non-HTML' end as extraction_error",
    )
    return pages.select("page_id", W.block_reason("blocked", "fetch_error", "extraction_error").alias("reason"))


# The supplied pages all have one <article> of plain paragraphs with unclosed <p> and <b> tags, which SQL can cut.
PARAGRAPHS = r"""
    cut AS (
      SELECT page_id, unnest(range(1, len(l))) AS i, unnest(l[2:]) AS raw FROM (
        SELECT page_id, string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>') AS l FROM pages)
    ), texts AS (
      SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(
        regexp_replace(replace(split_part(raw, '</p>', 1), '<br>', ' '), '<[^>]*>', '', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM cut
    ), kept AS (
      SELECT page_id, t, min(i) AS i FROM texts
      WHERE length(t) >= 40 AND NOT regexp_matches(lower(t), 'accept cookies|subscribe|sign in') GROUP BY page_id, t
    ), joined AS (
      SELECT p.page_id, count(t) AS n_paragraphs, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i), '') AS body
      FROM pages p LEFT JOIN kept k ON k.page_id = p.page_id GROUP BY p.page_id
    ), judged AS (
      SELECT *, n_paragraphs >= {n} AND length(body) >= {chars}
        AND length(regexp_replace(body, '[^\p{{L}}]', '', 'g')) > length(body) * 0.5 AS good FROM joined
    )"""
LOW = "'Low-quality extraction (likely boilerplate or dynamic page)'"


@check("extract_pages", f"""
    SELECT * FROM (WITH {PARAGRAPHS.format(n=2, chars=200)}
    SELECT page_id, n_paragraphs, CASE WHEN good THEN body END AS extracted_text,
      CASE WHEN NOT good THEN {LOW} END AS extraction_error FROM judged)
    """)
def extract_pages(spark, d):
    """Whole pages through the tree walk; the gate is lowered because the supplied pages are short."""
    out = extract(A.load_wide(spark, d, "pages"), min_paragraphs=2, min_chars=200)
    return out.select("page_id", "n_paragraphs", "extracted_text", "extraction_error")


@check("extract_pages_default", f"""
    SELECT * FROM (WITH {PARAGRAPHS.format(n=5, chars=1500)}
    SELECT page_id, n_paragraphs, CASE WHEN good THEN length(body) END AS n_chars,
      CASE WHEN NOT good THEN {LOW} END AS extraction_error FROM judged)
    """)
def extract_pages_default(spark, d):
    out = extract(A.load_wide(spark, d, "pages"))
    return out.select("page_id", "n_paragraphs", F.length("extracted_text").alias("n_chars"), "extraction_error")


@check("fetch_results", f"""
    SELECT * FROM (WITH {PARAGRAPHS.format(n=2, chars=200)}
    SELECT page_id, url AS final_url, CASE page_id % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 200 END AS http_status,
      page_id % 6 IN (0, 2) AS blocked_suspected,
      CASE WHEN page_id % 6 IN (0, 2) THEN 'Blocked/Rate-limited/CAPTCHA suspected'
        WHEN page_id % 6 = 1 THEN 'HTTP status 404' END AS fetch_error,
      CASE WHEN page_id % 6 = 3 THEN 'Non-HTML contentType: application/pdf' WHEN page_id % 6 = 4 THEN 'Non-HTML contentType: null'
        WHEN page_id % 6 = 5 AND NOT good THEN {LOW} END AS extraction_error,
      CASE WHEN page_id % 6 = 5 AND good THEN body END AS extracted_text
    FROM judged JOIN pages USING (page_id))
    """)
def fetch_results(spark, d):
    return fetched(landed(spark, d), min_paragraphs=2, min_chars=200)


@check("fetch_validators", f"""
    SELECT * FROM (WITH {PARAGRAPHS.format(n=2, chars=200)}, answers AS (
      SELECT page_id, 200 AS http_status, CAST(NULL AS VARCHAR) AS type_error, 0 AS v FROM pages
      UNION ALL SELECT page_id + 1000000, CASE page_id % 4 WHEN 0 THEN 403 WHEN 1 THEN 404 ELSE 200 END,
        CASE WHEN page_id % 4 = 2 THEN 'Non-HTML contentType: application/pdf' WHEN page_id % 4 = 3 THEN 'Non-HTML contentType: null' END, 1 FROM pages)
    SELECT a.page_id, a.http_status, CASE a.http_status WHEN 403 THEN 'Blocked/Rate-limited/CAPTCHA suspected' WHEN 404 THEN 'HTTP status 404' END AS fetch_error,
      CASE WHEN v = 0 AND NOT good THEN {LOW} ELSE type_error END AS extraction_error, CASE WHEN v = 0 AND good THEN body END AS extracted_text,
      CASE WHEN a.page_id % 3 > 0 THEN 'W/"' || a.page_id || '"' END AS http_etag,
      CASE WHEN a.page_id % 2 = 0 THEN 'Mon, 01 Jan 2024 10:00:00 GMT' END AS http_last_modified
    FROM answers a LEFT JOIN judged j ON j.page_id = a.page_id)
    """)
def fetch_validators(spark, d):
    """Every page as a good answer, and once more as one that fails; answers carry validators or not."""
    p = A.load_wide(spark, d, "pages").select("page_id", "url", F.col("html").alias("body"))
    good = p.selectExpr("page_id", "url", "200 as http_status", "'text/html' as content_type", "body")
    bad = p.selectExpr("page_id + 1000000 as page_id", "url", "case page_id % 4 when 0 then 403 when 1 then 404 else 200 end as http_status",
                       "case page_id % 4 when 2 then 'application/pdf' when 3 then null else 'text/html' end as content_type", "body")
    answers = good.union(bad).selectExpr("*", """if(page_id % 3 > 0, concat('W/"', page_id, '"'), null) as http_etag""",
                                         "if(page_id % 2 = 0, 'Mon, 01 Jan 2024 10:00:00 GMT', null) as http_last_modified")
    return fetched(answers, min_paragraphs=2, min_chars=200).drop("final_url", "blocked_suspected")


def robots(spark, d):
    """One robots body per host of the pages, by the length of the host name."""
    hosts = A.load(spark, d, "pages").select(host_key("url").alias("host_key")).distinct()
    n = F.length("host_key") % 4
    body = (
        F.when(n == 0, F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/7"))
        .when(n == 1, F.lit("User-agent: other\nDisallow: /\n\nUser-agent: NewsEvidence\nDisallow: /*.html$\nDisallow: /fr # no"))
        .when(n == 2, F.lit("User-agent: *\nDisallow: /"))
        .otherwise(F.lit("User-agent: *\nDisallow:"))
    )
    status = F.when((n == 2) & host_key_secure(), F.lit(404)).otherwise(F.lit(200))
    return hosts.select("host_key", status.alias("status"), body.alias("body"))


def host_key_secure():
    return F.col("host_key").startswith("https")


@check("robots", r"""
    WITH u AS (
      SELECT page_id, url, regexp_extract(url, '^(https?)', 1) AS scheme,
        lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
        regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS path FROM pages
    ), k AS (
      SELECT *, scheme || '://' || host || CASE scheme WHEN 'https' THEN ':443' ELSE ':80' END AS host_key FROM u
    )
    SELECT page_id, CASE length(host_key) % 4
      WHEN 0 THEN NOT (path LIKE '/en/%' AND path NOT LIKE '/en/7%')
      WHEN 1 THEN NOT (path LIKE '%.html' OR path LIKE '/fr%')
      WHEN 2 THEN scheme = 'https' ELSE TRUE END AS allowed
    FROM k
    """)
def robots_check(spark, d):
    return robots_filter(A.load(spark, d, "pages").select("page_id", "url"), robots(spark, d)).select("page_id", "allowed")
