"""Checks of the catalog: upserts, syncs, mapping, guards, patches, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as U
from ..operators import catalog as C
from ..operators import creates
from ..operators.keyed import upsert
from . import adapters as A
from .registry import check


@check("upsert_publishers", f"""
    SELECT coalesce(p.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.name ELSE p.name END AS name,
      CASE WHEN s.id IS NOT NULL THEN s.country_code ELSE p.country_code END AS country_code,
      CASE WHEN p.id IS NULL THEN 'inserted' WHEN s.id IS NULL THEN 'kept'
        WHEN s.name IS DISTINCT FROM p.name OR s.country_code IS DISTINCT FROM p.country_code THEN 'updated' ELSE 'kept' END
        AS action,
      CASE WHEN p.id IS NOT NULL AND (s.id IS NULL
        OR (s.name IS NOT DISTINCT FROM p.name AND s.country_code IS NOT DISTINCT FROM p.country_code))
        THEN '{A.BASE}' ELSE '{A.NOW}' END AS updated_at
    FROM t_publishers p FULL JOIN (
      SELECT s_suppkey * 20 AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Customer#' || lpad(CAST(s_suppkey * 20 AS VARCHAR), 9, '0')
        ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'US' END AS country_code FROM supplier) s
    ON s.id = p.id
    """, ("t_publishers",))
def upsert_publishers(spark, d):
    changes = A.load(spark, d, "supplier").selectExpr(
        "s_suppkey * 20 as id",
        "if(s_suppkey % 2 = 0, concat('Customer#', lpad(cast(s_suppkey * 20 as string), 9, '0')), s_name) as name",
        "if(s_suppkey % 4 = 1, null, 'US') as country_code",
    )
    out = upsert(A.publishers(spark, d), changes, ["id"], "replace", now=A.now(), action="action")
    return out.select("id", "name", "country_code", "action", A.stamp("updated_at"))


def _entries(spark, d):
    """Rating entries as a sync gets them: repeats, missing ids, odd sites."""
    return A.load(spark, d, "part").selectExpr(
        "p_partkey as pos",
        "case when p_partkey % 17 = 3 then null when p_partkey % 10 = 9 then p_partkey - 1 else p_partkey * 2 end as rating_id",
        "concat(' ', p_name, ' ') as source_name",
        "concat('https://ratings.example.org/new/', p_partkey) as rating_url",
        "if(p_size % 3 = 0, '  ', p_brand) as bias",
        "'US' as country",
        "p_type as factual_reporting",
        "' ' as media_type",
        "cast(null as string) as credibility",
        "case p_partkey % 4 when 0 then concat('https://www.new', p_partkey, '.example.com/a?b') when 1 then 'nodots'"
        " when 2 then 'bad site' else concat('[New', p_partkey, '.Example.org]') end as source_url",
    )


@check("sync_ratings", """
    SELECT * FROM (WITH entries AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rating_id ORDER BY pos) AS rn FROM (
        SELECT p_partkey AS pos, CASE WHEN p_partkey % 17 = 3 THEN NULL WHEN p_partkey % 10 = 9 THEN p_partkey - 1
            ELSE p_partkey * 2 END AS rating_id, p_name, p_size, p_brand, p_type FROM part)
        WHERE rating_id IS NOT NULL) WHERE rn = 1
    ), fresh AS (
      SELECT rating_id, trim(p_name) AS source_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS bias,
        p_type AS factual_reporting, CAST(NULL AS VARCHAR) AS media_type,
        CASE pos % 4 WHEN 0 THEN 'https://www.new' || pos || '.example.com/a?b' WHEN 3 THEN '[New' || pos || '.Example.org]' END
          AS source_url,
        CASE pos % 4 WHEN 0 THEN 'new' || pos || '.example.com' WHEN 3 THEN 'new' || pos || '.example.org' END
          AS source_url_domain
      FROM entries
    )
    SELECT coalesce(f.rating_id, r.rating_id) AS rating_id,
      CASE WHEN f.rating_id IS NULL THEN r.source_name ELSE f.source_name END AS source_name,
      CASE WHEN f.rating_id IS NULL THEN r.bias ELSE f.bias END AS bias,
      CASE WHEN f.rating_id IS NULL THEN r.factual_reporting ELSE f.factual_reporting END AS factual_reporting,
      CASE WHEN f.rating_id IS NULL THEN r.media_type ELSE f.media_type END AS media_type,
      CASE WHEN f.rating_id IS NULL THEN r.source_url ELSE f.source_url END AS source_url,
      CASE WHEN f.rating_id IS NULL THEN r.source_url_domain ELSE f.source_url_domain END AS source_url_domain
    FROM fresh f FULL JOIN t_ratings r ON r.rating_id = f.rating_id)
    """, ("t_ratings",))
def sync_ratings(spark, d):
    out = C.sync_ratings(_entries(spark, d), A.ratings(spark, d), A.now())
    return out.select("rating_id", "source_name", "bias", "factual_reporting", "media_type", "source_url", "source_url_domain")


_MAPPED = """
    SELECT p.id, r.rating_id FROM t_publishers p JOIN (
      SELECT source_url_domain, min(rating_id) AS rating_id FROM t_ratings GROUP BY 1) r ON r.source_url_domain = p.domain
    WHERE p.rating_id IS NULL"""


@check("map_publishers", _MAPPED, ("t_publishers", "t_ratings"))
def map_publishers(spark, d):
    return C.map_publishers(A.publishers(spark, d), A.ratings(spark, d))


@check("sync_counts", f"""
    SELECT (SELECT count(*) FROM part) AS fetched,
      (SELECT count(DISTINCT CASE WHEN p_partkey % 17 = 3 THEN NULL WHEN p_partkey % 10 = 9 THEN p_partkey - 1
         ELSE p_partkey * 2 END) FROM part) AS saved,
      (SELECT count(*) FROM ({_MAPPED})) AS mapped
    """, ("t_publishers", "t_ratings"))
def sync_counts(spark, d):
    mapping = C.map_publishers(A.publishers(spark, d), A.ratings(spark, d))
    return C.rating_sync_counts(_entries(spark, d), mapping)


def _catalog(spark, d):
    """News sources as a sync gets them: some name known publishers, several share a name, some are incomplete."""
    return A.load(spark, d, "part").selectExpr(
        "p_partkey as pos",
        "case when p_partkey % 19 = 5 then ' ' else concat(' SRC-', p_partkey % 700) end as source_id",
        "case when p_partkey % 23 = 7 then null when p_partkey % 2 = 0"
        " then concat('CUSTOMER#', lpad(cast(p_partkey div 3 as string), 9, '0')) else concat('Fresh ', p_partkey div 5) end as name",
        "case p_size % 3 when 0 then null when 1 then ' de ' else 'us' end as country",
        "case p_size % 4 when 0 then ' ' else concat('https://fresh.example.com/', p_partkey) end as url",
    )


_CATALOG = """
    cat AS (
      SELECT p_partkey AS pos, CASE WHEN p_partkey % 19 = 5 THEN NULL ELSE 'src-' || (p_partkey % 700) END AS source_id,
        CASE WHEN p_partkey % 23 = 7 THEN NULL WHEN p_partkey % 2 = 0
          THEN 'CUSTOMER#' || lpad(CAST(p_partkey // 3 AS VARCHAR), 9, '0') ELSE 'Fresh ' || (p_partkey // 5) END AS name,
        CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'DE' ELSE 'US' END AS country,
        CASE p_size % 4 WHEN 0 THEN NULL ELSE 'https://fresh.example.com/' || p_partkey END AS url
      FROM part
    ), good AS (
      SELECT *, lower(name) AS k FROM cat WHERE source_id IS NOT NULL AND name IS NOT NULL
    ), grouped AS (
      SELECT k, min(pos) AS first_pos, arg_min(name, pos) AS name,
        min(pos) FILTER (country IS NOT NULL) AS cpos, arg_min(country, pos) FILTER (country IS NOT NULL) AS country,
        min(pos) FILTER (url IS NOT NULL) AS spos, arg_min(url, pos) FILTER (url IS NOT NULL) AS url
      FROM good GROUP BY k
    ), have AS (
      SELECT DISTINCT lower(p.name) AS k, e.api_query FROM t_endpoints e JOIN t_publishers p ON p.id = e.publisher_id
      WHERE e.kind = 'API' AND e.api_provider = 'newsapi'
    ), made AS (
      SELECT k, source_id, arg_min(name, pos) AS display_name FROM good g
      WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.k = g.k AND h.api_query = g.source_id) GROUP BY k, source_id
    )"""


@check("sync_source_publishers", f"""
    SELECT * FROM (WITH {_CATALOG}
    SELECT coalesce(g.k, lower(p.name)) AS name_key, coalesce(p.name, g.name) AS name,
      CASE WHEN trim(coalesce(p.country_code, '')) = '' THEN coalesce(g.country, p.country_code) ELSE p.country_code END
        AS country_code,
      CASE WHEN trim(coalesce(p.website_url, '')) = '' THEN coalesce(g.url, p.website_url) ELSE p.website_url END AS website_url
    FROM grouped g FULL JOIN t_publishers p ON lower(p.name) = g.k)
    """, ("t_publishers", "t_endpoints"))
def sync_source_publishers(spark, d):
    out = C.sync_source_publishers(_catalog(spark, d), A.publishers(spark, d), A.now())
    return out.select("name_key", "name", "country_code", "website_url")


@check("sync_source_endpoints", f"""
    SELECT * FROM (WITH {_CATALOG}
    SELECT k AS name_key, display_name, source_id AS api_query, 30 AS fetch_interval_minutes FROM made)
    """, ("t_publishers", "t_endpoints"))
def sync_source_endpoints(spark, d):
    out = C.sync_source_endpoints(_catalog(spark, d), A.publishers(spark, d), A.endpoints(spark, d))
    return out.select("name_key", "display_name", "api_query", "fetch_interval_minutes")


@check("sync_source_counts", f"""
    SELECT * FROM (WITH {_CATALOG}, fills AS (
      SELECT g.k, unnest(list_distinct(list_filter([
          CASE WHEN (p.name IS NULL OR trim(coalesce(p.country_code, '')) = '') THEN cpos END,
          CASE WHEN (p.name IS NULL OR trim(coalesce(p.website_url, '')) = '') THEN spos END],
          lambda x: x IS NOT NULL AND (p.name IS NOT NULL OR x <> first_pos)))) AS pos
      FROM grouped g LEFT JOIN t_publishers p ON lower(p.name) = g.k)
    SELECT (SELECT count(*) FROM cat) AS fetched, (SELECT count(*) FROM made) AS created_endpoints,
      (SELECT count(*) FROM fills) AS enriched_publishers,
      (SELECT count(*) FROM cat) - (SELECT count(*) FROM made) AS existing)
    """, ("t_publishers", "t_endpoints"))
def sync_source_counts(spark, d):
    return C.source_sync_counts(_catalog(spark, d), A.publishers(spark, d), A.endpoints(spark, d))


@check("name_lookup", """
    SELECT upper(s_name) AS wanted, p.id, p.name FROM (
      SELECT replace(s_name, 'Supplier', 'Customer') AS s_name FROM supplier) s JOIN t_publishers p ON lower(p.name) = lower(s_name)
    """, ("t_publishers",))
def name_lookup(spark, d):
    names = A.load(spark, d, "supplier").selectExpr("upper(replace(s_name, 'Supplier', 'Customer')) as name")
    return C.publisher_by_name(A.publishers(spark, d), names)


@check("locator_lookup", """
    SELECT w.publisher_id, e.id FROM (
      SELECT DISTINCT publisher_id, kind, upper(api_provider) AS p, upper(api_query) AS q FROM t_endpoints WHERE kind = 'API') w
    JOIN t_endpoints e ON e.publisher_id = w.publisher_id AND e.kind = w.kind AND lower(e.api_provider) = lower(w.p)
      AND lower(e.api_query) = lower(w.q)
    """, ("t_endpoints",))
def locator_lookup(spark, d):
    endpoints = A.endpoints(spark, d)
    wanted = endpoints.filter("kind = 'API'").selectExpr(
        "publisher_id", "kind", "upper(api_provider) as api_provider", "upper(api_query) as api_query"
    ).distinct()
    return C.endpoint_by_locator(endpoints, wanted).select("publisher_id", "id")


@check("deletable", """
    SELECT 'publisher' AS kind, id, CASE WHEN id IN (SELECT publisher_id FROM t_endpoints)
      THEN 'source endpoints' WHEN id IN (SELECT publisher_id FROM t_articles) THEN 'articles' END AS blocked_by
    FROM t_publishers
    UNION ALL
    SELECT 'rating', rating_id, CASE WHEN rating_id IN (SELECT rating_id FROM t_publishers WHERE rating_id IS NOT NULL)
      THEN 'publishers' END FROM t_ratings
    """, ("t_publishers", "t_endpoints", "t_articles", "t_ratings"))
def deletable(spark, d):
    publishers = A.publishers(spark, d)
    a = C.deletable_publishers(publishers, A.endpoints(spark, d), A.articles(spark, d))
    b = C.deletable_ratings(A.ratings(spark, d), publishers)
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "id", "blocked_by")
    return kind(a, "publisher").unionByName(kind(b, "rating"))


@check("catalog_list", """
    SELECT e.id, e.display_name, e.kind, p.name AS publisher_name, p.rating_id FROM t_endpoints e
    LEFT JOIN t_publishers p ON p.id = e.publisher_id
    """, ("t_endpoints", "t_publishers"))
def catalog_list(spark, d):
    publishers = A.publishers(spark, d)
    listed = C.endpoint_list(A.endpoints(spark, d), publishers)
    rated = C.publisher_list(publishers).select(F.col("id").alias("publisher_id"), "rating_id")
    return listed.join(rated, "publisher_id", "left").select("id", "display_name", "kind", "publisher_name", "rating_id")


@check("rating_list", "SELECT rating_id, source_name, source_url_domain FROM t_ratings", ("t_ratings",))
def rating_list(spark, d):
    return C.rating_list(A.ratings(spark, d)).select("rating_id", "source_name", "source_url_domain")


@check("audit", """
    SELECT 'lineitem' AS table_name, 'unique_line' AS rule, l_orderkey || '|' || l_linenumber AS key,
      CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'publishers', 'length_country_code', CAST(id AS VARCHAR), CAST(length(country_code) AS VARCHAR)
      FROM t_publishers WHERE length(country_code) > 2
    UNION ALL SELECT 'publishers', 'fk_rating_id', CAST(id AS VARCHAR), CAST(rating_id AS VARCHAR) FROM t_publishers p
      WHERE rating_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_ratings r WHERE r.rating_id = p.rating_id)
    UNION ALL SELECT 'publishers', 'fk_rating_id', CAST(-c_custkey AS VARCHAR), CAST(-7 AS VARCHAR) FROM customer WHERE c_custkey % 50 = 0
    UNION ALL SELECT 'source_endpoints', 'kind_fields', CAST(id AS VARCHAR), kind FROM t_endpoints WHERE NOT (
      (kind = 'RSS' AND rss_url IS NOT NULL AND api_provider IS NULL AND api_query IS NULL)
      OR (kind = 'API' AND rss_url IS NULL AND api_provider IS NOT NULL AND api_query IS NOT NULL))
    UNION ALL SELECT 'articles', 'allowed_status', CAST(id AS VARCHAR), status FROM t_articles
      WHERE status NOT IN ('DISCOVERED', 'FETCHED', 'EXTRACTED', 'INDEXED')
    UNION ALL SELECT 'articles', 'required_title', CAST(id AS VARCHAR), '' FROM t_articles
      WHERE title IS NULL OR trim(title, ' ' || chr(9) || chr(10) || chr(13)) = ''
    UNION ALL SELECT 'article_sources', 'fk_source_endpoint_id', CAST(article_id AS VARCHAR), CAST(source_endpoint_id AS VARCHAR)
      FROM t_links l WHERE NOT EXISTS (SELECT 1 FROM t_endpoints e WHERE e.id = l.source_endpoint_id)
    UNION ALL SELECT 'ingestion_runs', 'single_running', 'RUNNING', CAST(count(*) AS VARCHAR) FROM t_runs
      WHERE status = 'RUNNING' HAVING count(*) > 1
    """, ("t_publishers", "t_ratings", "t_endpoints", "t_articles", "t_links", "t_runs"))
def audit(spark, d):
    publishers, endpoints = A.publishers(spark, d), A.endpoints(spark, d)
    articles, links = A.articles(spark, d), A.links(spark, d)
    unrated = A.load(spark, d, "customer").filter("c_custkey % 50 = 0").selectExpr("-c_custkey as id", "-7L as rating_id")
    lines = A.load(spark, d, "lineitem")
    return U.audit(
        U.unique(lines, "lineitem", "unique_line", [F.col("l_orderkey"), F.col("l_linenumber")]),
        U.max_length(publishers, "publishers", "country_code", 2, "id"),
        U.foreign_key(publishers.unionByName(unrated, allowMissingColumns=True), "publishers", "rating_id", A.ratings(spark, d),
                      "rating_id", "id"),
        U.kind_fields(endpoints),
        U.allowed(articles, "articles", "status", ["DISCOVERED", "FETCHED", "EXTRACTED", "INDEXED"], "id"),
        U.required(articles, "articles", "title", "id"),
        U.foreign_key(links, "article_sources", "source_endpoint_id", endpoints, "id", "article_id"),
        U.single_running(A.runs(spark, d)),
    )


# Rows added to whole tables so that each kind of rule has something to report.
_AUDITED = """
    p AS (SELECT id, name, country_code, rating_id FROM t_publishers
      UNION ALL SELECT -c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) WHEN 1 THEN chr(9) || ' ' ELSE 'a|b' END,
        CASE WHEN c_custkey % 2 = 0 THEN 'USA' END, -c_custkey FROM customer WHERE c_custkey % 40 < 3),
    e AS (SELECT id, publisher_id, kind, rss_url, api_provider, api_query FROM t_endpoints
      UNION ALL SELECT -s_suppkey, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'RSS' WHEN 1 THEN 'API' ELSE 'FTP' END,
        CASE WHEN s_suppkey % 3 = 1 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'a|b' ELSE 'a' END,
        CASE WHEN s_suppkey % 3 = 1 THEN 'c' END, NULL FROM supplier),
    a AS (SELECT id, publisher_id, canonical_url, canonical_url_hash, status FROM t_articles
      UNION ALL SELECT -n_nationkey - 1, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -99999 END, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE 'u' END,
        'h' || (n_nationkey % 4), CASE n_nationkey % 3 WHEN 0 THEN 'GONE' WHEN 1 THEN NULL ELSE 'INDEXED' END FROM nation),
    l AS (SELECT article_id, source_endpoint_id, source_item_id FROM t_links
      UNION ALL SELECT -n_nationkey - 1000, n_nationkey % 4, 'item' FROM nation),
    g AS (SELECT id, run_id, source_endpoint_id, started_at, status FROM t_logs
      UNION ALL SELECT -n_nationkey - 1, -1, n_nationkey % 3, NULL, 'LOST' FROM nation),
    u AS (SELECT id, started_at, status FROM t_runs)"""


@check("audit_catalog", f"""
    SELECT * FROM (WITH {_AUDITED}
    SELECT 'publishers' AS table_name, 'required_name' AS rule, CAST(id AS VARCHAR) AS key, '' AS detail FROM p WHERE {A.trim("coalesce(name, '')")} = ''
    UNION ALL SELECT 'publishers', 'length_country_code', CAST(id AS VARCHAR), CAST(length(country_code) AS VARCHAR) FROM p WHERE length(country_code) > 2
    UNION ALL SELECT 'publishers', 'unique_name', lower(name), CAST(count(*) AS VARCHAR) FROM p GROUP BY lower(name) HAVING count(*) > 1
    UNION ALL SELECT 'publishers', 'fk_rating_id', CAST(id AS VARCHAR), CAST(rating_id AS VARCHAR) FROM p
      WHERE rating_id IS NOT NULL AND rating_id NOT IN (SELECT rating_id FROM t_ratings)
    UNION ALL SELECT 'source_endpoints', 'kind_fields', CAST(id AS VARCHAR), kind FROM e WHERE NOT (
      (kind = 'RSS' AND rss_url IS NOT NULL AND api_provider IS NULL AND api_query IS NULL)
      OR (kind = 'API' AND rss_url IS NULL AND api_provider IS NOT NULL AND api_query IS NOT NULL))
    UNION ALL SELECT 'source_endpoints', 'allowed_kind', CAST(id AS VARCHAR), kind FROM e WHERE kind NOT IN ('RSS', 'API')
    UNION ALL SELECT 'source_endpoints', 'unique_locator', publisher_id || '|' || kind || '|' || coalesce(rss_url, '') || '|'
      || coalesce(api_provider, '') || '|' || coalesce(api_query, ''), CAST(count(*) AS VARCHAR)
      FROM e GROUP BY publisher_id, kind, rss_url, api_provider, api_query HAVING count(*) > 1
    UNION ALL SELECT 'source_endpoints', 'fk_publisher_id', CAST(id AS VARCHAR), CAST(publisher_id AS VARCHAR) FROM e
      WHERE publisher_id NOT IN (SELECT id FROM p)
    UNION ALL SELECT 'articles', 'required_canonical_url', CAST(id AS VARCHAR), '' FROM a WHERE trim(canonical_url) = ''
    UNION ALL SELECT 'articles', 'allowed_status', CAST(id AS VARCHAR), coalesce(status, 'null') FROM a
      WHERE status IS NULL OR status NOT IN ('DISCOVERED', 'FETCHED', 'EXTRACTED', 'INDEXED', 'ERROR')
    UNION ALL SELECT 'articles', 'unique_url', publisher_id || '|' || canonical_url_hash, CAST(count(*) AS VARCHAR) FROM a
      GROUP BY publisher_id, canonical_url_hash HAVING count(*) > 1
    UNION ALL SELECT 'articles', 'fk_publisher_id', CAST(id AS VARCHAR), CAST(publisher_id AS VARCHAR) FROM a
      WHERE publisher_id NOT IN (SELECT id FROM p)
    UNION ALL SELECT 'article_sources', 'unique_item', source_endpoint_id || '|' || source_item_id, CAST(count(*) AS VARCHAR) FROM l
      GROUP BY source_endpoint_id, source_item_id HAVING count(*) > 1
    UNION ALL SELECT 'article_sources', 'fk_article_id', CAST(article_id AS VARCHAR), CAST(article_id AS VARCHAR) FROM l
      WHERE article_id NOT IN (SELECT id FROM a)
    UNION ALL SELECT 'article_sources', 'fk_source_endpoint_id', CAST(article_id AS VARCHAR), CAST(source_endpoint_id AS VARCHAR) FROM l
      WHERE source_endpoint_id NOT IN (SELECT id FROM e)
    UNION ALL SELECT 'ingestion_runs', 'single_running', 'RUNNING', CAST(count(*) AS VARCHAR) FROM u WHERE status = 'RUNNING' HAVING count(*) > 1
    UNION ALL SELECT 'ingestion_logs', 'required_source_endpoint_id', CAST(id AS VARCHAR), '' FROM g WHERE source_endpoint_id IS NULL
    UNION ALL SELECT 'ingestion_logs', 'required_started_at', CAST(id AS VARCHAR), '' FROM g WHERE started_at IS NULL
    UNION ALL SELECT 'ingestion_logs', 'allowed_status', CAST(id AS VARCHAR), status FROM g
      WHERE status NOT IN ('STARTED', 'PROCESSING', 'SUCCESS', 'PARTIAL', 'FAILED', 'SKIPPED')
    UNION ALL SELECT 'ingestion_logs', 'unique_run_endpoint', run_id || '|' || source_endpoint_id, CAST(count(*) AS VARCHAR) FROM g
      GROUP BY run_id, source_endpoint_id HAVING count(*) > 1
    UNION ALL SELECT 'ingestion_logs', 'fk_run_id', CAST(id AS VARCHAR), CAST(run_id AS VARCHAR) FROM g WHERE run_id NOT IN (SELECT id FROM u))
    """, ("t_publishers", "t_ratings", "t_articles", "t_links", "t_endpoints", "t_logs", "t_runs"))
def audit_catalog(spark, d):
    plus = lambda df, rows: df.unionByName(rows, allowMissingColumns=True)
    publishers = plus(A.publishers(spark, d), A.load(spark, d, "customer").filter("c_custkey % 40 < 3").selectExpr(
        "-c_custkey as id", r"case c_custkey % 3 when 0 then lower(c_name) when 1 then '\t ' else 'a|b' end as name",
        "if(c_custkey % 2 = 0, 'USA', null) as country_code", "-c_custkey as rating_id"))
    endpoints = plus(A.endpoints(spark, d), A.load(spark, d, "supplier").selectExpr(
        "-s_suppkey as id", "s_suppkey as publisher_id", "case s_suppkey % 3 when 0 then 'RSS' when 1 then 'API' else 'FTP' end as kind",
        "case when s_suppkey % 3 = 1 then null when s_suppkey % 2 = 0 then 'a|b' else 'a' end as rss_url",
        "if(s_suppkey % 3 = 1, 'c', null) as api_provider"))
    nations = A.load(spark, d, "nation")
    articles = plus(A.articles(spark, d), nations.selectExpr(
        "-n_nationkey - 1 as id", "if(n_nationkey % 2 = 0, 1, -99999) as publisher_id", "if(n_nationkey % 5 = 0, ' ', 'u') as canonical_url",
        "concat('h', n_nationkey % 4) as canonical_url_hash",
        "case n_nationkey % 3 when 0 then 'GONE' when 1 then null else 'INDEXED' end as status"))
    links = plus(A.links(spark, d), nations.selectExpr(
        "-n_nationkey - 1000 as article_id", "n_nationkey % 4 as source_endpoint_id", "'item' as source_item_id"))
    logs = plus(A.logs(spark, d), nations.selectExpr(
        "-n_nationkey - 1 as id", "-1 as run_id", "n_nationkey % 3 as source_endpoint_id", "'LOST' as status"))
    return U.audit_catalog(publishers, endpoints, articles, A.ratings(spark, d), links, A.runs(spark, d), logs)


@check("apply_patches", """
    SELECT * FROM (WITH patches AS (
      SELECT s_suppkey * 3 AS id, CASE s_suppkey % 8 WHEN 0 THEN ' ' WHEN 1 THEN 'CUSTOMER#000000001' WHEN 2 THEN ' Same name '
          WHEN 3 THEN NULL ELSE 'Renamed ' || s_suppkey END AS name,
        CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'FR' END AS country_code,
        CASE WHEN s_suppkey % 10 = 9 THEN -5 WHEN s_suppkey % 5 = 0 THEN s_suppkey END AS rating_id
      FROM supplier
      UNION ALL SELECT 10000000, 'X', NULL, NULL
    ), judged AS (
      SELECT q.*, p.name AS old_name, CASE WHEN p.id IS NULL THEN 'not found' WHEN trim(q.name) = '' THEN 'name must not be blank'
        WHEN EXISTS (SELECT 1 FROM t_publishers o WHERE lower(o.name) = lower(trim(q.name)) AND o.id <> q.id)
          OR EXISTS (SELECT 1 FROM patches e WHERE lower(trim(e.name)) = lower(trim(q.name)) AND trim(e.name) <> '' AND e.id < q.id
            AND e.id IN (SELECT id FROM t_publishers) AND (e.rating_id IS NULL OR e.rating_id IN (SELECT rating_id FROM t_ratings))
            AND NOT EXISTS (SELECT 1 FROM t_publishers o WHERE lower(o.name) = lower(trim(e.name)) AND o.id <> e.id))
          THEN 'name already exists'
        WHEN q.rating_id IS NOT NULL AND q.rating_id NOT IN (SELECT rating_id FROM t_ratings) THEN 'rating not found' END AS reject_reason
      FROM patches q LEFT JOIN t_publishers p ON p.id = q.id
    )
    SELECT p.id, CASE WHEN j.name IS NOT NULL THEN trim(j.name) ELSE p.name END AS name,
      CASE WHEN j.country_code IS NOT NULL THEN nullif(trim(j.country_code), '') ELSE p.country_code END AS country_code,
      coalesce(j.rating_id, p.rating_id) AS rating_id, NULL AS reject_reason
    FROM t_publishers p LEFT JOIN (SELECT * FROM judged WHERE reject_reason IS NULL) j ON j.id = p.id
    UNION ALL SELECT id, NULL, NULL, NULL, reject_reason FROM judged WHERE reject_reason IS NOT NULL)
    """, ("t_publishers", "t_ratings"))
def apply_patches(spark, d):
    patches = A.load(spark, d, "supplier").selectExpr(
        "s_suppkey * 3 as id",
        "case s_suppkey % 8 when 0 then ' ' when 1 then 'CUSTOMER#000000001' when 2 then ' Same name ' when 3 then null"
        " else concat('Renamed ', s_suppkey) end as name",
        "case s_suppkey % 3 when 0 then '' when 1 then 'FR' end as country_code",
        "cast(null as string) as website_url",
        "case when s_suppkey % 10 = 9 then -5 when s_suppkey % 5 = 0 then s_suppkey end as rating_id",
    )
    extra = spark.range(1).selectExpr("10000000L as id", "'X' as name", "cast(null as string) as country_code",
                                      "cast(null as string) as website_url", "cast(null as bigint) as rating_id")
    kept, rejects = C.patch_publishers(A.publishers(spark, d), patches.unionByName(extra), A.ratings(spark, d), A.now())
    kept = kept.select("id", "name", "country_code", "rating_id")
    return kept.unionByName(rejects, allowMissingColumns=True)


@check("endpoint_patches", """
    SELECT * FROM (WITH patches AS (
      SELECT c_custkey * 2 AS id, CASE c_custkey % 4 WHEN 0 THEN 'RSS' WHEN 1 THEN 'API' END AS kind,
        CASE c_custkey % 3 WHEN 0 THEN 'https://moved.example.com/' || c_custkey WHEN 1 THEN ' ' END AS rss_url,
        CASE WHEN c_custkey % 5 = 0 THEN 'newsapi' END AS api_provider, CASE WHEN c_custkey % 7 = 0 THEN 'new-' || c_custkey END AS api_query
      FROM customer
    ), merged AS (
      SELECT e.id, e.publisher_id, coalesce(p.kind, e.kind) AS kind,
        CASE WHEN coalesce(p.kind, e.kind) = 'RSS' THEN coalesce(p.rss_url, e.rss_url) END AS rss_url,
        CASE WHEN coalesce(p.kind, e.kind) = 'API' THEN coalesce(p.api_provider, e.api_provider) END AS api_provider,
        CASE WHEN coalesce(p.kind, e.kind) = 'API' THEN coalesce(p.api_query, e.api_query) END AS api_query
      FROM patches p JOIN t_endpoints e ON e.id = p.id
    ), fielded AS (
      SELECT m.*, CASE WHEN kind = 'RSS' AND trim(coalesce(rss_url, '')) = '' THEN 'rss_url is required'
        WHEN kind = 'API' AND trim(coalesce(api_provider, '')) = '' THEN 'api_provider is required'
        WHEN kind = 'API' AND trim(coalesce(api_query, '')) = '' THEN 'api_query is required'
        WHEN EXISTS (SELECT 1 FROM t_endpoints o WHERE o.id <> m.id AND o.publisher_id = m.publisher_id AND o.kind = m.kind
            AND coalesce(o.rss_url, '') = coalesce(m.rss_url, '') AND coalesce(o.api_provider, '') = coalesce(m.api_provider, '')
            AND coalesce(o.api_query, '') = coalesce(m.api_query, '')) THEN 'endpoint already exists' END AS wrong
      FROM merged m
    ), judged AS (
      SELECT m.* EXCLUDE (wrong), CASE WHEN wrong IS NOT NULL THEN wrong
        WHEN EXISTS (SELECT 1 FROM fielded o WHERE o.wrong IS NULL AND o.id < m.id AND o.publisher_id = m.publisher_id AND o.kind = m.kind
            AND coalesce(o.rss_url, '') = coalesce(m.rss_url, '') AND coalesce(o.api_provider, '') = coalesce(m.api_provider, '')
            AND coalesce(o.api_query, '') = coalesce(m.api_query, '')) THEN 'endpoint already exists' END AS reject_reason
      FROM fielded m
    )
    SELECT id, kind, rss_url, api_provider, api_query, reject_reason FROM judged WHERE reject_reason IS NULL
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, reject_reason FROM judged WHERE reject_reason IS NOT NULL
    UNION ALL SELECT id, kind, rss_url, api_provider, api_query, NULL FROM t_endpoints e
      WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.id = e.id AND j.reject_reason IS NULL))
    """, ("t_endpoints",))
def endpoint_patches(spark, d):
    patches = A.load(spark, d, "customer").selectExpr(
        "c_custkey * 2 as id",
        "case c_custkey % 4 when 0 then 'RSS' when 1 then 'API' end as kind",
        "case c_custkey % 3 when 0 then concat('https://moved.example.com/', c_custkey) when 1 then ' ' end as rss_url",
        "if(c_custkey % 5 = 0, 'newsapi', null) as api_provider",
        "if(c_custkey % 7 = 0, concat('new-', c_custkey), null) as api_query",
    )
    kept, rejects = C.patch_endpoints(A.endpoints(spark, d), patches, A.publishers(spark, d), A.now())
    kept = kept.select("id", "kind", "rss_url", "api_provider", "api_query")
    return kept.unionByName(rejects, allowMissingColumns=True)


@check("rating_patches", """
    SELECT * FROM (WITH patches AS (
      SELECT s_suppkey * 7 AS rating_id, CASE s_suppkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' New ' || s_suppkey END AS source_name,
        CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Center' END AS bias,
        CASE s_suppkey % 4 WHEN 0 THEN ' https://WWW.moved' || s_suppkey || '.example.org/x ' WHEN 1 THEN 'bad url' END AS source_url
      FROM supplier
    )
    SELECT r.rating_id, CASE WHEN p.source_name IS NOT NULL THEN trim(p.source_name) ELSE r.source_name END AS source_name,
      CASE WHEN p.bias IS NOT NULL THEN nullif(p.bias, '') ELSE r.bias END AS bias,
      CASE WHEN p.source_url IS NOT NULL THEN trim(p.source_url) ELSE r.source_url END AS source_url,
      CASE WHEN p.source_url LIKE '%WWW.moved%' THEN regexp_extract(p.source_url, '(moved[0-9]+.example.org)', 1)
        WHEN p.source_url IS NOT NULL THEN NULL ELSE r.source_url_domain END AS source_url_domain
    FROM t_ratings r LEFT JOIN (SELECT * FROM patches WHERE coalesce(trim(source_name), 'x') <> '') p ON p.rating_id = r.rating_id)
    """, ("t_ratings",))
def rating_patches(spark, d):
    patches = A.load(spark, d, "supplier").selectExpr(
        "s_suppkey * 7 as rating_id",
        "case s_suppkey % 5 when 0 then '  ' when 1 then concat(' New ', s_suppkey) end as source_name",
        "cast(null as string) as rating_url",
        "case s_suppkey % 3 when 0 then '' when 1 then 'Center' end as bias",
        "cast(null as string) as country", "cast(null as string) as factual_reporting",
        "cast(null as string) as media_type", "cast(null as string) as credibility",
        "case s_suppkey % 4 when 0 then concat(' https://WWW.moved', s_suppkey, '.example.org/x ') when 1 then 'bad url' end"
        " as source_url",
        "cast(null as string) as source_url_domain",
    )
    kept, _ = C.patch_ratings(A.ratings(spark, d), patches, A.now())
    return kept.select("rating_id", "source_name", "bias", "source_url", "source_url_domain")


# Requests in order of their place: blank, taken, repeated and new names; known and unknown ratings.
_NEW_PUBLISHERS = """
    SELECT p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN upper('Customer#' || lpad(CAST(p_partkey % 40 AS {text}), 9, '0'))
        ELSE ' New ' || (p_partkey % 60) || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END END AS name,
      CASE WHEN p_partkey % 3 = 0 THEN ' DE ' ELSE ' ' END AS country_code, CAST(NULL AS {text}) AS website_url,
      CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 100000000 WHEN p_partkey % 7 = 1 THEN p_partkey END AS rating_id
    FROM {part}"""


def _requests(spark, d, table, sql):
    A.load(spark, d, table).createOrReplaceTempView(f"asked_{table}")
    return spark.sql(sql.format(text="STRING", **{table: f"asked_{table}"}))


@check("publisher_creates", f"""
    SELECT * FROM (WITH asked AS ({_NEW_PUBLISHERS.format(text='VARCHAR', part='part')}),
    keyed AS (SELECT *, lower(nullif({A.trim('name')}, '')) AS k FROM asked),
    judged AS (
      SELECT *, CASE WHEN k IS NULL THEN 'name must not be blank' WHEN k IN (SELECT lower(name) FROM t_publishers) THEN 'publisher already exists'
        WHEN rating_id > 100000000 THEN 'rating not found' END AS wrong FROM keyed),
    settled AS (
      SELECT *, coalesce(wrong, CASE WHEN pos > min(pos) FILTER (wrong IS NULL) OVER (PARTITION BY k) THEN 'publisher already exists' END) AS reject_reason FROM judged)
    SELECT pos, CASE WHEN reject_reason IS NULL THEN (SELECT max(id) FROM t_publishers)
        + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY sha256(k)) END AS id, reject_reason,
      CASE WHEN reject_reason IS NULL THEN {A.trim('name')} END AS name, CASE WHEN reject_reason IS NULL AND pos % 3 = 0 THEN 'DE' END AS country_code
    FROM settled)
    """, ("t_publishers",))
def publisher_creates(spark, d):
    publishers = A.publishers(spark, d)
    made = creates.create_publishers(publishers, _requests(spark, d, "part", _NEW_PUBLISHERS), A.ratings(spark, d), A.now())
    return made.results.join(made.publishers.select("id", "name", "country_code"), "id", "left").select("pos", "id", "reject_reason", "name", "country_code")


# Owners by id, by name and new ones; each kind with and without its locator; locators held, repeated and new.
_NEW_ENDPOINTS = """
    SELECT p_partkey AS pos, CASE p_partkey % 6 WHEN 0 THEN p_partkey % 30 + 1 WHEN 1 THEN p_partkey + 100000000 END AS publisher_id,
      CASE p_partkey % 6 WHEN 2 THEN ' ' WHEN 3 THEN upper('Customer#' || lpad(CAST(p_partkey % 30 + 1 AS {text}), 9, '0')) ELSE 'Owner ' || (p_partkey % 25) END AS publisher_name,
      CASE WHEN p_partkey % 4 = 0 THEN 'C' || p_partkey END AS country_code, CAST(NULL AS {text}) AS website_url,
      CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'RSS' ELSE 'API' END AS kind, 'Feed ' || p_partkey AS display_name,
      CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'https://new.example.com/' || (p_partkey % 9) END AS rss_url, 'newsapi' AS api_provider,
      CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 'q' || (p_partkey % 8) END AS api_query, CAST(NULL AS BOOLEAN) AS enabled,
      CASE WHEN p_partkey % 5 = 0 THEN 60 END AS fetch_interval_minutes
    FROM {part}"""


@check("endpoint_creates", f"""
    SELECT * FROM (WITH asked AS ({_NEW_ENDPOINTS.format(text='VARCHAR', part='part')}),
    named AS (SELECT a.*, lower(nullif({A.trim('publisher_name')}, '')) AS k FROM asked a),
    found AS (
      SELECT n.*, CASE WHEN publisher_id IS NULL THEN p.id ELSE i.id END AS owner, publisher_id IS NOT NULL AND i.id IS NULL AS lost
      FROM named n LEFT JOIN t_publishers i ON i.id = n.publisher_id LEFT JOIN (SELECT lower(name) AS k, min(id) AS id FROM t_publishers GROUP BY 1) p ON p.k = n.k),
    plain AS (SELECT * REPLACE (CASE WHEN kind = 'API' THEN NULL ELSE rss_url END AS rss_url, CASE WHEN kind = 'RSS' THEN NULL ELSE api_provider END AS api_provider,
        CASE WHEN kind = 'RSS' THEN NULL ELSE api_query END AS api_query), coalesce(CAST(owner AS VARCHAR), 'name:' || k) AS who FROM found),
    located AS (SELECT *, concat_ws(chr(31), who, coalesce(kind, ''), coalesce(rss_url, ''), coalesce(api_provider, ''), coalesce(api_query, '')) AS loc FROM plain),
    judged AS (
      SELECT *, CASE WHEN lost THEN 'publisher not found' WHEN publisher_id IS NULL AND k IS NULL THEN 'publisher_name is required'
        WHEN kind IS NULL THEN 'kind is required' WHEN kind = 'RSS' AND trim(rss_url) = '' THEN 'rss_url is required'
        WHEN kind = 'API' AND api_query IS NULL THEN 'api_query is required'
        WHEN EXISTS (SELECT 1 FROM t_endpoints e WHERE CAST(e.publisher_id AS VARCHAR) = who AND e.kind = l.kind AND coalesce(e.rss_url, '') = coalesce(l.rss_url, '')
          AND coalesce(e.api_provider, '') = coalesce(l.api_provider, '') AND coalesce(e.api_query, '') = coalesce(l.api_query, '')) THEN 'endpoint already exists' END AS wrong
      FROM located l),
    settled AS (
      SELECT *, coalesce(wrong, CASE WHEN pos > min(pos) FILTER (wrong IS NULL) OVER (PARTITION BY loc) THEN 'endpoint already exists' END) AS reject_reason FROM judged),
    made AS (SELECT k, (SELECT max(id) FROM t_publishers) + row_number() OVER (ORDER BY sha256(k)) AS id FROM (
      SELECT DISTINCT k FROM settled WHERE reject_reason IS NULL AND owner IS NULL)),
    owned AS (SELECT s.*, CASE WHEN reject_reason IS NULL THEN coalesce(owner, m.id) END AS publisher FROM settled s LEFT JOIN made m ON m.k = s.k),
    said AS (SELECT publisher, max_by(country_code, pos) FILTER (country_code IS NOT NULL) AS country FROM owned WHERE publisher IS NOT NULL GROUP BY 1)
    SELECT pos, CASE WHEN reject_reason IS NULL THEN (SELECT max(id) FROM t_endpoints) + row_number() OVER (PARTITION BY reject_reason IS NULL ORDER BY sha256(loc)) END AS id,
      reject_reason, o.publisher AS publisher_id, CASE WHEN reject_reason IS NULL THEN coalesce(fetch_interval_minutes, 30) END AS minutes,
      CASE WHEN reject_reason IS NULL THEN coalesce(country, p.country_code) END AS country
    FROM owned o LEFT JOIN said ON said.publisher = o.publisher LEFT JOIN t_publishers p ON p.id = o.publisher)
    """, ("t_publishers", "t_endpoints"))
def endpoint_creates(spark, d):
    made = creates.create_endpoints(A.endpoints(spark, d), A.publishers(spark, d), _requests(spark, d, "part", _NEW_ENDPOINTS), A.now())
    rows = made.results.join(made.endpoints.select("id", "publisher_id", F.col("fetch_interval_minutes").alias("minutes")), "id", "left")
    owner = made.publishers.select(F.col("id").alias("publisher_id"), F.col("country_code").alias("country"))
    return rows.join(owner, "publisher_id", "left").select("pos", "id", "reject_reason", "publisher_id", "minutes", "country")
