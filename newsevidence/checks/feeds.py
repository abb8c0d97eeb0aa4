"""Checks of landed feeds, API pages, ratings files and discovery."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import discover as D
from ..operators.views import endpoint_counts
from ..session import shared_dir
from ..sources import feeds as S
from ..sources.tables import stage
from ..streaming.discover import read_state, stream_discover
from . import adapters as A
from .registry import check


def feed_documents(spark, d):
    """RSS documents of a site, at most 50 entries each, with gaps in date, description and title."""
    p = A.load(spark, d, "pages").selectExpr("page_id", "url", "split_part(url, '/', 3) as host")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    date = F.date_format(F.expr(A.at(A.BASE, "page_id")), "dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item>"),
        F.when(F.col("page_id") % 10 == 9, F.lit("<title> </title>")).otherwise(
            F.concat(F.lit("<title>Page "), F.col("page_id"), F.lit("</title>"))),
        F.when(F.col("page_id") % 11 == 10, F.lit("")).otherwise(
            F.concat(F.lit("<link>"), esc(F.col("url")), F.lit("</link>"))),
        F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit("<description>about</description>")),
        F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("<pubDate>"), F.lit("Mon, "), date, F.lit(" GMT</pubDate>"))),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<guid>g"), F.col("page_id"), F.lit("</guid>"))).otherwise(F.lit("")),
        F.lit("</item>"),
    )
    packed = p.select("host", "page_id", item.alias("item")).groupBy("host", F.floor(F.col("page_id") / 50)).agg(
        F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("l")
    )
    xml = F.concat(F.lit("<rss><channel><title>f</title>"), F.array_join(F.transform("l", lambda x: x["item"]), ""),
                   F.lit("</channel></rss>"))
    return packed.select(F.length("host").cast("long").alias("endpoint_id"), xml.alias("xml"))


@check("rss_items", f"""
    SELECT length(split_part(url, '/', 3)) AS endpoint_id, 'Page ' || page_id AS title, url AS external_url,
      CASE WHEN page_id % 5 = 0 THEN 'g' || page_id ELSE url END AS source_item_id,
      CASE WHEN page_id % 3 = 0 THEN '' ELSE 'about' END AS description,
      strftime(CASE WHEN page_id % 4 = 0 THEN TIMESTAMP '{A.NOW}' ELSE TIMESTAMP '{A.BASE}' + to_hours(page_id) END,
        '%Y-%m-%d %H:%M:%S') AS published_date
    FROM pages WHERE page_id % 10 <> 9 AND page_id % 11 <> 10
    """)
def rss_items(spark, d):
    items = S.parse_rss(feed_documents(spark, d), A.now())
    return items.select("endpoint_id", "title", "external_url", "source_item_id", "description", A.stamp("published_date"))


def _mixed_feeds(spark, d):
    """One document per page: RSS, Atom, RDF, or something no reader takes."""
    p = A.load(spark, d, "pages").selectExpr("page_id", "replace(replace(url, '&', '&amp;'), '<', '&lt;') as u")
    return p.selectExpr("page_id as endpoint_id", """case page_id % 6
        when 0 then concat('<rss><channel><item><title>P', page_id, '</title><link>', u, '</link><pubDate>Mon, 01 Jan 24 10:00 GMT</pubDate></item></channel></rss>')
        when 1 then concat('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>P', page_id, '</title><link href="', u,
          '"/><id>i', page_id, '</id><updated>2024-01-01T10:00:00Z</updated></entry></feed>')
        when 2 then concat('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><item><title>P', page_id, '</title><link>', u, '</link></item></rdf:RDF>')
        when 3 then concat('<rss><channel><item><title>P', page_id)
        when 4 then '<html><body>no feed</body></html>' else null end as xml""")


@check("feed_formats", f"""
    SELECT page_id AS endpoint_id, 'P' || page_id AS title, url AS external_url,
      CASE WHEN page_id % 6 = 1 THEN 'i' || page_id ELSE url END AS source_item_id,
      CASE WHEN page_id % 6 = 2 THEN strftime(TIMESTAMP '{A.NOW}', '%Y-%m-%d %H:%M:%S') ELSE '2024-01-01 10:00:00' END AS published_date
    FROM pages WHERE page_id % 6 < 3
    """)
def feed_formats(spark, d):
    items = S.parse_rss(_mixed_feeds(spark, d), A.now())
    return items.select("endpoint_id", "title", "external_url", "source_item_id", A.stamp("published_date"))


# Feeds as sites publish them: elements of other vocabularies before and behind the core ones, HTML entities, CDATA.
_OTHERS = "<media:title>Media</media:title><media:description>of the picture</media:description><itunes:author>A</itunes:author>"
_WILD = f"""
    SELECT page_id AS endpoint_id, CASE page_id % 6
      WHEN 0 THEN '<rss xmlns:media="m" xmlns:atom="a"><channel><title>f</title><atom:link href="self" rel="self"/><item><title>P' || page_id
        || '</title>{_OTHERS}<link>' || u || '</link><atom:link href="other" rel="related"/><description>text</description></item></channel></rss>'
      WHEN 1 THEN '<rss><channel><item>{_OTHERS}<title>P' || page_id || '&nbsp;&eacute; A&T &copy; &unknown; x&#233;</title><link>' || u
        || '</link><content:encoded>whole</content:encoded><dc:date>2024-01-01T10:00:00Z</dc:date></item></channel></rss>'
      WHEN 2 THEN '<atom:feed xmlns:atom="http://www.w3.org/2005/Atom" xmlns:media="m"><atom:entry><media:title>Media</media:title><atom:title>P' || page_id
        || '</atom:title><atom:link rel="self" href="self"/><atom:link href="' || u || '"/><atom:id>i' || page_id || '</atom:id></atom:entry></atom:feed>'
      WHEN 3 THEN '<rss><channel><item><title><![CDATA[P' || page_id || ' & <b>&nbsp;</b>]]>' || '</title><link>' || u
        || '</link><description><![CDATA[a &amp; b]]>' || '</description></item></channel></rss>'
      WHEN 4 THEN '<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/"><channel rdf:about="x"/><item rdf:about="y"><title>P' || page_id || '</title><link>' || u
        || '</link><dc:date>2024-01-01T10:00:00Z</dc:date><dc:title>Other</dc:title></item></rdf:RDF>'
      ELSE '<rss><channel><item><media:title>Only media</media:title><atom:link href="x"/></item></channel></rss>' END AS xml
    FROM (SELECT page_id, replace(replace(url, '&', '&amp;'), '<', '&lt;') AS u FROM pages)"""


@check("feed_namespaces", f"""
    SELECT page_id AS endpoint_id, 'P' || page_id || CASE page_id % 6 WHEN 1 THEN chr(160) || 'é A&T © &unknown; xé' WHEN 3 THEN ' & <b>&nbsp;</b>' ELSE '' END AS title,
      url AS external_url, CASE WHEN page_id % 6 = 2 THEN 'i' || page_id ELSE url END AS source_item_id,
      CASE page_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'whole' WHEN 3 THEN 'a &amp; b' ELSE '' END AS description,
      CASE WHEN page_id % 6 IN (1, 4) THEN '2024-01-01 10:00:00' ELSE strftime(TIMESTAMP '{A.NOW}', '%Y-%m-%d %H:%M:%S') END AS published_date
    FROM pages WHERE page_id % 6 < 5
    """)
def feed_namespaces(spark, d):
    A.load(spark, d, "pages").createOrReplaceTempView("wild_pages")
    feeds = spark.sql(_WILD.replace("FROM pages", "FROM wild_pages").replace("chr(160)", "char(160)"))
    items = S.parse_rss(feeds, A.now())
    return items.select("endpoint_id", "title", "external_url", "source_item_id", "description", A.stamp("published_date"))


@check("feed_rejects", """
    SELECT page_id AS endpoint_id, CASE page_id % 6 WHEN 3 THEN 'feed is not well-formed' WHEN 4 THEN 'not a feed' ELSE 'feed is empty' END
      AS reject_reason FROM pages WHERE page_id % 6 >= 3
    """)
def feed_rejects(spark, d):
    return S.feed_rejects(_mixed_feeds(spark, d))


@check("rating_rejects", """
    SELECT p_partkey AS part, 'not a JSON array of ratings' AS reject_reason FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT p_partkey, 'body is empty' FROM part WHERE p_partkey % 3 = 2
    """)
def rating_rejects(spark, d):
    bodies = A.load(spark, d, "part").selectExpr(
        "p_partkey as part", "case p_partkey % 3 when 0 then concat('[{\"Source\": \"', p_name, '\"}]') when 1 then concat('{\"Source', p_name) else ' ' end as body")
    return S.rating_rejects(bodies)


def _planned(spark, d):
    endpoints = A.endpoints(spark, d)
    return S.plan_api_batches(endpoints, endpoint_counts(endpoints, A.links(spark, d)))


_PLAN = """
    due AS (
      SELECT e.id AS endpoint_id, lower(trim(api_query)) AS source_id, coalesce(n, 0) AS n
      FROM t_endpoints e LEFT JOIN (SELECT source_endpoint_id, count(*) AS n FROM t_links GROUP BY 1) l
        ON l.source_endpoint_id = e.id
      WHERE enabled AND kind = 'API' AND lower(api_provider) = 'newsapi' AND trim(api_query) <> ''
    ), ranked AS (
      SELECT *, row_number() OVER (ORDER BY n DESC, endpoint_id) AS rank FROM due
    ), planned AS (
      SELECT (rank - 1) // 20 AS batch, endpoint_id, source_id, rank,
        rank = min(rank) OVER (PARTITION BY source_id) AS is_owner FROM ranked
    )"""


@check("endpoint_counts", """
    SELECT e.id AS endpoint_id, coalesce(n, 0) AS n FROM t_endpoints e LEFT JOIN (
      SELECT source_endpoint_id, count(*) AS n FROM t_links GROUP BY 1) l ON l.source_endpoint_id = e.id
    """, ("t_endpoints", "t_links"))
def endpoint_counts_query(spark, d):
    return endpoint_counts(A.endpoints(spark, d), A.links(spark, d))


@check("api_batches", f"""
    SELECT * FROM (WITH {_PLAN}
    SELECT batch, string_agg(source_id, ',' ORDER BY rank) AS sources, count(*) AS n_sources
    FROM (SELECT batch, source_id, min(rank) AS rank FROM planned GROUP BY batch, source_id) GROUP BY batch)
    """, ("t_endpoints", "t_links"))
def api_batches(spark, d):
    return S.batch_requests(_planned(spark, d))


def _stored_plan(spark, d):
    """The batch plan as a run stores it before it asks for pages."""
    return stage(_planned(spark, d), f"{shared_dir(spark)}/api_plan/{uuid4().hex}", "planned")


def api_pages(spark, d, planned):
    """API pages from the pages table: up to 40 articles each, one page per batch and number."""
    p = A.load(spark, d, "pages").selectExpr(
        "page_id div 40 as batch", "cast(page_id % 3 + 1 as int) as page", "page_id", "url"
    )
    # Sources 'src-N' of the planned endpoints; the case and blanks vary.
    owners = planned.filter("is_owner").groupBy("batch").agg(F.min("source_id").alias("source_id"))
    rows = p.join(owners, "batch", "left")
    one = F.struct(
        F.struct(F.when(F.col("page_id") % 7 == 6, F.lit("elsewhere")).otherwise(
            F.concat(F.lit(" "), F.upper("source_id"))).alias("id")).alias("source"),
        F.when(F.col("page_id") % 8 == 7, F.lit(" ")).otherwise(F.concat(F.lit("Page "), F.col("page_id"))).alias("title"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://same.example.com/"), F.col("batch"))).otherwise(
            F.col("url")).alias("url"),
        F.when(F.col("page_id") % 4 == 0, F.lit("soon")).otherwise(
            F.date_format(F.expr(A.at(A.BASE, "page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publishedAt"),
    )
    packed = rows.groupBy("batch", "page").agg(F.array_sort(F.collect_list(F.struct(F.col("page_id"), one.alias("a")))).alias("l"))
    status = F.when(F.col("batch") % 3 == 1, F.lit("error")).otherwise(F.lit("ok"))
    body = F.to_json(F.struct(status.alias("status"), F.lit("rateLimited").alias("code"), F.lit("slow down").alias("message"),
                              F.transform("l", lambda x: x["a"]).alias("articles")))
    return packed.select("batch", "page", body.alias("json"))


@check("api_articles", f"""
    SELECT * FROM (WITH {_PLAN}, owners AS (
      SELECT batch, min(source_id) AS source_id FROM planned WHERE is_owner GROUP BY batch
    ), rows_ AS (
      SELECT page_id // 40 AS batch, page_id % 3 + 1 AS page, page_id,
        CASE WHEN page_id % 5 = 0 THEN 'https://same.example.com/' || (page_id // 40) ELSE url END AS url
      FROM pages WHERE page_id % 7 <> 6 AND page_id % 8 <> 7 AND (page_id // 40) % 3 <> 1
    )
    SELECT endpoint_id, batch, external_url, title, description, published_date,
      row_number() OVER (PARTITION BY endpoint_id, batch ORDER BY page, page_id) AS feed_order FROM (
      SELECT p.endpoint_id, r.batch, r.page, r.page_id, r.url AS external_url, 'Page ' || r.page_id AS title, '' AS description,
        CASE WHEN r.page_id % 4 = 0 THEN NULL
          ELSE strftime(TIMESTAMP '{A.BASE}' + to_hours(r.page_id), '%Y-%m-%d %H:%M:%S') END AS published_date,
        row_number() OVER (PARTITION BY p.endpoint_id, r.batch, r.url ORDER BY r.page, r.page_id) AS rn
      FROM rows_ r JOIN owners o ON o.batch = r.batch
      JOIN planned p ON p.batch = r.batch AND p.source_id = o.source_id AND p.is_owner)
    WHERE rn = 1)
    """, ("t_endpoints", "t_links"))
def api_articles(spark, d):
    planned = _stored_plan(spark, d)
    flat = S.flatten_api_pages(api_pages(spark, d, planned), planned)
    order = F.row_number().over(Window.partitionBy("endpoint_id", "batch").orderBy("pos")).cast("long")
    return flat.select("endpoint_id", "batch", "external_url", "title", "description", A.stamp("published_date"), order.alias("feed_order"))


@check("api_rejects", """
    SELECT DISTINCT page_id // 40 AS batch, page_id % 3 + 1 AS page, 'rateLimited' AS code, 'slow down' AS message
    FROM pages WHERE (page_id // 40) % 3 = 1
    """)
def api_rejects(spark, d):
    return S.api_page_rejects(api_pages(spark, d, _stored_plan(spark, d)))


@check("page_budget", """
    SELECT batch, page, n_articles FROM (
      SELECT p.*, row_number() OVER (ORDER BY batch, page) AS rn FROM (
        SELECT run_id AS batch, page, n_articles,
          coalesce(bool_or(n_articles < 100) OVER (PARTITION BY run_id ORDER BY page
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended
        FROM (SELECT event_id // 7 AS run_id, event_id % 7 + 1 AS page,
                CASE WHEN value < 60 THEN 100 ELSE 40 END AS n_articles FROM events)
        WHERE page <= 5) p
      WHERE NOT ended)
    WHERE rn <= 100
    """)
def page_budget(spark, d):
    pages = A.load(spark, d, "events").selectExpr(
        "event_id div 7 as batch", "event_id % 7 + 1 as page", "if(value < 60, 100, 40) as n_articles"
    )
    return S.pages_in_budget(pages)


@check("ratings_read", """
    SELECT rating_id, source_name, rating_url, bias, factual_reporting, source_url FROM t_ratings
    """, ("t_ratings",))
def ratings_read(spark, d):
    """Ratings as landed files: one JSON array per outlet type, opened by a byte order mark."""
    entry = F.struct(
        F.col("source_name").alias("Source"), F.col("rating_url").alias("MBFC URL"), F.col("bias").alias("Bias"),
        F.col("country").alias("Country"), F.col("factual_reporting").alias("Factual Reporting"),
        F.col("media_type").alias("Media Type"), F.col("source_url").alias("Source URL"),
        F.col("credibility").alias("Credibility"), F.col("rating_id").alias("Source ID#"), F.lit("x").alias("Unknown"),
    )
    bodies = A.ratings(spark, d).groupBy("media_type", F.floor(F.col("rating_id") / 500).alias("part")).agg(
        F.concat(F.lit("﻿"), F.to_json(F.collect_list(entry))).alias("body")
    )
    parsed = S.parse_ratings(bodies.select("body"))
    return parsed.select("rating_id", "source_name", "rating_url", "bias", "factual_reporting", "source_url")


@check("valid_items", "SELECT endpoint_id, pos, source_item_id, external_url FROM t_valid", ("t_valid",))
def valid_items(spark, d):
    return D.valid_items(A.feed_items(spark, d)).select("endpoint_id", "pos", "source_item_id", "external_url")


@check("new_items", """
    SELECT endpoint_id, pos, source_item_id FROM t_valid v WHERE NOT EXISTS (SELECT 1 FROM t_known_links k
      WHERE k.source_endpoint_id = v.endpoint_id AND k.source_item_id = v.source_item_id)
    """, ("t_valid", "t_known_links"))
def new_items(spark, d):
    fresh = D.new_items(D.valid_items(A.feed_items(spark, d)), A.known_links(spark, d))
    return fresh.select("endpoint_id", "pos", "source_item_id")


def _discovery(spark, d):
    return D.discover(A.feed_items(spark, d), A.endpoints(spark, d), A.known_articles(spark, d),
                      A.known_links(spark, d), A.now())


_MATCHED = """
    keyed AS (
      SELECT n.*, e.publisher_id, sha256(n.external_url) AS url_hash FROM t_new n JOIN t_endpoints e ON e.id = n.endpoint_id
    ), matched AS (
      SELECT k.*, a.id AS article_id,
        row_number() OVER (PARTITION BY k.publisher_id, k.url_hash ORDER BY k.endpoint_id, k.pos) AS first_rn
      FROM keyed k LEFT JOIN t_known_articles a ON a.publisher_id = k.publisher_id AND a.canonical_url_hash = k.url_hash
    )"""


@check("discover", f"""
    SELECT * FROM (WITH {_MATCHED}
    SELECT article_id AS id, publisher_id, url_hash AS canonical_url_hash, external_url AS canonical_url, title,
      article_id IS NULL AS is_new, CASE WHEN article_id IS NULL THEN 'DISCOVERED' END AS status
    FROM matched WHERE first_rn = 1)
    """, ("t_new", "t_endpoints", "t_known_articles"))
def discover(spark, d):
    found = _discovery(spark, d).articles
    return found.select("id", "publisher_id", "canonical_url_hash", "canonical_url", "title", "is_new", "status")


@check("discover_links", f"""
    SELECT * FROM (WITH {_MATCHED}
    SELECT endpoint_id AS source_endpoint_id, source_item_id, article_id, article_id IS NULL AND first_rn = 1 AS is_new
    FROM matched)
    """, ("t_new", "t_endpoints", "t_known_articles"))
def discover_links(spark, d):
    return _discovery(spark, d).links.select("source_endpoint_id", "source_item_id", "article_id", "is_new")


@check("merge_articles", f"""
    SELECT * FROM (WITH {_MATCHED}, fresh AS (
      SELECT publisher_id, url_hash, row_number() OVER (ORDER BY url_hash, publisher_id)
        + (SELECT max(id) FROM t_known_articles) AS id
      FROM matched WHERE first_rn = 1 AND article_id IS NULL)
    SELECT id, publisher_id, url_hash AS canonical_url_hash, 'DISCOVERED' AS status, '{A.NOW}' AS last_seen_at FROM fresh
    UNION ALL
    SELECT id, publisher_id, canonical_url_hash, 'INDEXED',
      CASE WHEN id IN (SELECT article_id FROM matched) THEN '{A.NOW}' ELSE '{A.BASE}' END FROM t_known_articles)
    """, ("t_new", "t_endpoints", "t_known_articles"))
def merge_articles(spark, d):
    known = A.known_articles(spark, d)
    found = _discovery(spark, d).articles
    merged = D.merge_articles(known, D.new_article_rows(known, found, A.now()), D.seen_again(found))
    return merged.select("id", "publisher_id", "canonical_url_hash", "status", A.stamp("last_seen_at"))


@check("stream_discover", f"""
    SELECT * FROM (WITH {_MATCHED}, fresh AS (
      SELECT publisher_id, url_hash, row_number() OVER (ORDER BY url_hash, publisher_id)
        + (SELECT max(id) FROM t_known_articles) AS id
      FROM matched WHERE first_rn = 1 AND article_id IS NULL)
    SELECT id, publisher_id, url_hash AS canonical_url_hash, 'DISCOVERED' AS status FROM fresh
    UNION ALL SELECT id, publisher_id, canonical_url_hash, 'INDEXED' FROM t_known_articles)
    """, ("t_new", "t_endpoints", "t_known_articles"))
def stream_discover_query(spark, d):
    """Discovery driven by a stream over the pages file; equals the batch result."""
    state = f"{shared_dir(spark)}/stream_discover/{uuid4().hex}"
    schema = "page_id bigint, url string, html string"
    items = lambda pages: pages.selectExpr("page_id", "url", "explode(array(0, 1)) as j").selectExpr(*A.ITEM_COLUMNS)
    version = stream_discover(
        spark, f"{d}/page[s].parquet", schema, items, A.endpoints(spark, d), state,
        (A.known_articles(spark, d), A.known_links(spark, d)), A.now(),
    )
    articles, _ = read_state(spark, state, version)
    return articles.select("id", "publisher_id", "canonical_url_hash", "status")


@check("article_validators", """
    SELECT page_id + 100 AS id, CASE page_id % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'old' WHEN 2 THEN 'new' || page_id END AS http_etag,
      CASE page_id % 4 WHEN 0 THEN 'before' WHEN 1 THEN 'before' WHEN 2 THEN 'after' END AS http_last_modified FROM pages
    """)
def article_validators(spark, d):
    """Untouched articles and those with own text keep their validators; a fetch sets what it was told, or nothing."""
    articles = A.page_articles(spark, d).withColumns({"http_etag": F.lit("old"), "http_last_modified": F.lit("before")})
    v = "(id - 100) % 4"
    results = articles.filter(f"{v} <> 0").selectExpr(
        "id as article_id", f"if({v} = 1, 'own text', null) as raw_text", "200 as http_status", "cast(null as string) as fetch_error",
        "cast(null as string) as extraction_error", "'text' as extracted_text", f"timestamp'{A.NOW}' as fetched_at", "cast(null as string) as index_error",
        f"if({v} <> 3, concat('new', id - 100), null) as http_etag", f"if({v} <> 3, 'after', null) as http_last_modified")
    chunks = results.selectExpr("article_id", "1 as chunk_count")
    return D.apply_article_state(articles, results, chunks).select("id", "http_etag", "http_last_modified")


@check("article_state", """
    SELECT page_id + 100 AS id, status, http_status, fetch_error, extraction_error, chunk_count, indexed FROM (
      SELECT page_id, CASE WHEN v IN (0, 1, 2, 3, 4) THEN 'ERROR' WHEN v = 8 THEN 'INDEXED' ELSE 'INDEXED' END AS status,
        CASE v WHEN 0 THEN 404 WHEN 1 THEN NULL WHEN 8 THEN NULL ELSE 200 END AS http_status,
        CASE v WHEN 0 THEN 'HTTP status 404' WHEN 1 THEN 'Fetch failed' END AS fetch_error,
        CASE v WHEN 2 THEN 'Low-quality' WHEN 3 THEN 'No meaningful text extracted' WHEN 4 THEN 'Indexing failed: down' END
          AS extraction_error,
        CASE WHEN v IN (5, 6, 7) THEN 3 END AS chunk_count,
        CASE WHEN v = 4 THEN FALSE WHEN v IN (5, 6, 7) THEN TRUE END AS indexed
      FROM (SELECT page_id, page_id % 9 AS v FROM pages))
    """)
def article_state(spark, d):
    articles = A.page_articles(spark, d)
    v = "(id - 100) % 9"
    results = articles.filter(f"{v} <> 8").selectExpr(
        "id as article_id",
        f"if({v} = 5, 'own text', null) as raw_text",
        f"case {v} when 0 then 404 when 1 then null when 5 then 500 else 200 end as http_status",
        f"if({v} = 5, 'ignored', null) as fetch_error",
        f"case {v} when 2 then 'Low-quality' when 5 then 'ignored' end as extraction_error",
        f"if({v} = 3, ' ', 'some text') as extracted_text",
        f"timestamp'{A.NOW}' as fetched_at",
        f"if({v} = 4, 'down', null) as index_error",
    )
    chunks = articles.filter(f"{v} in (5, 6, 7)").selectExpr("id as article_id", "3 as chunk_count")
    out = D.apply_article_state(articles, results, chunks)
    return out.select("id", "status", "http_status", "fetch_error", "extraction_error", "chunk_count", "indexed")
