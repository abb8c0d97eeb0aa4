"""The supplied tables seen as the engine's tables: once for Spark, once as SQL.

Modulo arithmetic below only picks the variant a row gets; no row of a supplied table is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread

BASE = "2024-01-01 00:00:00"
NOW = "1998-06-01 00:00:00"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_wide(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on, read with a partition per core at least."""
    return spread(load(spark, folder, name))


def at(base: str, hours: str = "0", minutes: str = "0") -> str:
    """Spark expression for a timestamp some hours and minutes after ``base``."""
    return f"timestamp'{base}' + make_dt_interval(0, cast({hours} as int), cast({minutes} as int))"


def now():
    return F.lit(NOW).cast("timestamp")


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def articles(spark, folder):
    return load(spark, folder, "documents").selectExpr(
        "doc_id as id",
        "cast(substr(source, 4) as bigint) as publisher_id",
        "concat('https://', source, '.example.com/a/', doc_id) as canonical_url",
        "sha2(concat('https://', source, '.example.com/a/', doc_id), 256) as canonical_url_hash",
        r"split_part(text, '\n', 1) as title",
        "if(doc_id % 3 = 0, null, lang) as description",
        f"if(doc_id % 10 = 0, null, {at(BASE, 'doc_id')}) as published_date",
        "element_at(array('DISCOVERED','FETCHED','EXTRACTED','INDEXED','ERROR'), cast(doc_id % 5 as int) + 1) as status",
        f"timestamp'{BASE}' as last_seen_at",
    )


def content(spark, folder):
    """Content of every article."""
    return load(spark, folder, "documents").selectExpr("doc_id as article_id", "text as extracted_text")


def long_content(spark, folder):
    """Content where some articles have none yet, for the rule that lists those."""
    return content(spark, folder).filter("length(extracted_text) >= 100")


def links(spark, folder):
    return load(spark, folder, "documents").selectExpr(
        "doc_id as article_id", "explode(sequence(0, cast(n_chars % 3 as int))) as j"
    ).selectExpr(
        "article_id * 4 + j as id",
        "article_id",
        "(article_id * 7 + j * 11) % 1500 as source_endpoint_id",
        "concat('item-', article_id, '-', j) as source_item_id",
        f"{at(BASE, '0', 'article_id * 3 + (j * 7) % 4')} as fetched_at",
    )


def publishers(spark, folder):
    return load(spark, folder, "customer").selectExpr(
        "c_custkey as id",
        "c_name as name",
        "case c_nationkey % 4 when 0 then 'US' when 1 then 'GB' when 2 then null else ' ' end as country_code",
        "case c_custkey % 5 when 0 then concat('https://www.Site', c_custkey, '.example.com/news?x=1')"
        " when 1 then concat('SITE', c_custkey, '.example.com') when 2 then concat(' (site', c_custkey, '.example.com) ')"
        " when 3 then null else concat('not a site ', c_custkey) end as website_url",
        "if(c_custkey % 3 = 0, c_custkey, null) as rating_id",
        f"timestamp'{BASE}' as created_at",
        f"timestamp'{BASE}' as updated_at",
    )


def ratings(spark, folder):
    return load(spark, folder, "part").selectExpr(
        "p_partkey as rating_id",
        "p_name as source_name",
        "concat('https://ratings.example.org/', p_partkey) as rating_url",
        "case p_size % 6 when 0 then 'Left-Center' when 1 then 'CONSPIRACY-PSEUDOSCIENCE' when 2 then ' right '"
        " when 3 then '' when 4 then 'Satire' else null end as bias",
        "'US' as country",
        "case p_size % 5 when 0 then 'HIGH' when 1 then 'Very_Low' when 2 then 'mostly-factual' when 3 then ' low '"
        " else null end as factual_reporting",
        "p_type as media_type",
        "concat('https://www.site', p_partkey div 2, '.example.com/') as source_url",
        "concat('site', p_partkey div 2, '.example.com') as source_url_domain",
        "case p_size % 4 when 0 then 'high credibility' when 1 then 'Low' when 2 then '  ' else null end as credibility",
        f"timestamp'{BASE}' as synced_at",
    )


def endpoints(spark, folder):
    return load(spark, folder, "orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as publisher_id",
        "if(o_orderstatus = 'F', 'RSS', 'API') as kind",
        "concat('Feed ', o_orderkey) as display_name",
        "if(o_orderstatus = 'F', concat('https://feeds.example.com/', o_orderkey), null) as rss_url",
        "case when o_orderstatus = 'F' then null when o_orderpriority = '1-URGENT' then 'NewsAPI'"
        " when o_orderpriority = '5-LOW' then 'other' else 'newsapi' end as api_provider",
        "case when o_orderstatus = 'F' then null when o_orderkey % 11 = 0 then ' '"
        " when o_orderkey % 3 = 0 then concat(' SRC-', o_orderkey % 4000) else concat('src-', o_orderkey % 4000) end as api_query",
        "o_totalprice < 400000 as enabled",
        "cast(1440 * (1 + o_orderkey % 300) as int) as fetch_interval_minutes",
        "if(o_orderpriority = '5-LOW', null, cast(o_orderdate as timestamp)) as last_fetched_at",
        "cast(null as timestamp) as last_success_at",
        "cast(null as timestamp) as last_attempted_at",
        "cast(o_orderkey % 4 as int) as failure_count",
        "o_orderpriority = '3-MEDIUM' and o_orderstatus = 'O' as robots_disallowed",
        "if(o_orderstatus = 'P' and o_orderpriority = '2-HIGH',"
        " cast(o_orderdate as timestamp) + make_dt_interval(30), null) as blocked_until",
        "if(o_orderkey % 2 = 1, 'BLOCKED_OR_CAPTCHA', null) as block_reason",
        "cast(o_orderkey % 2 as int) as block_count",
        "cast(o_orderdate as timestamp) as created_at",
        "cast(o_orderdate as timestamp) as updated_at",
    )


def logs(spark, folder):
    k = "cast(get_json_object(props, '$.k') as int)"
    return load(spark, folder, "events").withColumn("k", F.expr(k)).selectExpr(
        "event_id as id",
        "0L as version",
        "event_id div 4 as run_id",
        "cast(k as bigint) as source_endpoint_id",
        "cast(ts as timestamp) as started_at",
        "if(value < 2, null, cast(ts as timestamp) + make_dt_interval(0, 0, cast(floor(value) as int))) as completed_at",
        "k as articles_fetched",
        "k % 7 as articles_processed",
        "k % 3 as articles_failed",
        "case event_type when 'error' then 'FAILED' when 'purchase' then 'PARTIAL' when 'signup' then 'SKIPPED'"
        " else 'SUCCESS' end as status",
        "if(event_type = 'error', case k % 6 when 0 then 'Robots.txt disallows scraping for this source'"
        " when 1 then 'NLP embed failed: 503' when 2 then 'HTTP status 500' when 3 then ''"
        " when 4 then null else 'Too many chunks for embedding' end, null) as error_details",
    )


def runs(spark, folder):
    return logs(spark, folder).groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), F.max("started_at").alias("ended")
    ).selectExpr(
        "run_id as id",
        "0L as version",
        "started_at",
        "if(run_id % 4 in (0, 3), null, ended) as completed_at",
        "case run_id % 4 when 1 then 'COMPLETED' when 2 then 'FAILED' else 'RUNNING' end as status",
    )


ITEM_COLUMNS = [
    "cast(length(url) as bigint) as endpoint_id",
    "cast(page_id * 2 + j as int) as pos",
    "case when j = 1 and page_id % 2 = 0 then concat(url, '#again') when page_id % 5 = 3 then null else url end"
    " as source_item_id",
    "case page_id % 9 when 4 then concat(url, '/VIDEO/1') when 7 then ' ' else url end as external_url",
    "concat('Page ', page_id) as title",
    "'' as description",
    "if(page_id % 18 = 4, concat('Own text of page ', page_id), null) as raw_text",
    f"{at(BASE, 'page_id')} as published_date",
]


def feed_items(spark, folder):
    """Two items per page: the second repeats the URL under another id, or the whole item."""
    pages = load(spark, folder, "pages").selectExpr("page_id", "url", "explode(array(0, 1)) as j")
    return pages.selectExpr(*ITEM_COLUMNS)


def known_articles(spark, folder):
    """Articles a former run left behind: one per page with a secure URL."""
    return load(spark, folder, "pages").filter("url like 'https://%'").selectExpr(
        "page_id + 100 as id", "cast(length(url) as bigint) as ep", "url"
    ).join(endpoints(spark, folder).selectExpr("id as ep", "publisher_id"), "ep").selectExpr(
        "id", "publisher_id", "url as canonical_url", "sha2(url, 256) as canonical_url_hash",
        f"timestamp'{BASE}' as last_seen_at", "'INDEXED' as status",
    )


def page_articles(spark, folder):
    """One article per page."""
    return load(spark, folder, "pages").selectExpr("page_id + 100 as id", "cast(length(url) as bigint) as ep", "url").join(
        endpoints(spark, folder).selectExpr("id as ep", "publisher_id"), "ep", "left"
    ).selectExpr("id", "publisher_id", "url as canonical_url", "sha2(url, 256) as canonical_url_hash",
                 f"timestamp'{BASE}' as last_seen_at", "'INDEXED' as status")


def known_links(spark, folder):
    return load(spark, folder, "pages").filter("url like '%.example.net/%'").selectExpr(
        "page_id + 100 as article_id", "cast(length(url) as bigint) as source_endpoint_id", "url as source_item_id",
        f"timestamp'{BASE}' as fetched_at",
    )


def hits(spark, folder):
    """Five hits per claim, labels and gaps by document length."""
    return load(spark, folder, "documents").selectExpr(
        "doc_id div 5 as claim_id",
        "cast(doc_id % 5 as int) as rank",
        "if(n_chars % 4 = 0, null, doc_id div 5 * 2 + if(doc_id % 5 >= 3, 1, 0)) as article_id",
        "if(n_chars % 3 = 0, null, concat('https://example.com/', doc_id div 5)) as article_url",
        "if(n_chars % 7 = 0, ' ', concat('Title ', doc_id div 5)) as title",
        "source as source_name",
        f"if(doc_id % 10 = 0, null, {at(BASE, 'doc_id div 7')}) as published_date",
        "case n_chars % 6 when 0 then 'Left-Center' when 1 then 'CONSPIRACY-PSEUDOSCIENCE' when 2 then ' right '"
        " when 3 then '' when 4 then 'Satire' else null end as bias",
        "case n_chars % 5 when 0 then 'HIGH' when 1 then 'Very_Low' when 2 then 'mostly-factual' when 3 then ' low '"
        " else null end as factual_reporting",
        "case n_chars % 8 when 0 then 'high credibility' when 1 then 'Low' when 2 then '  ' else null end as credibility",
        "cast(n_chars % 100 as double) / 100 as distance",
        "text",
    )


def vector_chunks(spark, folder):
    return load(spark, folder, "embeddings").selectExpr(
        "vec_id as chunk_id",
        "embedding as vector",
        "vec_id div 3 as article_id",
        "concat('chunk ', vec_id) as text",
        "concat('src', label) as source_name",
        f"if(label = 3, null, {at(BASE, 'vec_id')}) as published_date",
        "case label % 6 when 0 then 'Left-Center' when 1 then 'CONSPIRACY-PSEUDOSCIENCE' when 2 then ' right '"
        " when 3 then '' when 4 then 'Satire' else null end as bias",
        "case label % 5 when 0 then 'HIGH' when 1 then 'Very_Low' when 2 then 'mostly-factual' when 3 then ' low '"
        " else null end as factual_reporting",
        "cast(null as string) as credibility",
    )


def vector_claims(spark, folder):
    return load(spark, folder, "embeddings").selectExpr("vec_id as claim_id", "embedding as vector")


def claims(spark, folder):
    return load(spark, folder, "benchmark").selectExpr(
        "item_id as id",
        "item_id as claim_id",
        "text as claim_text",
        "concat('user', item_id % 3) as owner_username",
        f"{at(BASE, '0', 'item_id div 2')} as created_at",
        "case item_id % 4 when 0 then 'true' when 1 then 'mixed' else null end as verdict",
        "if(item_id % 5 = 0, null, 'stored explanation') as explanation",
    )


def threads(spark, folder):
    """(claims, follow-ups): the first turn of a conversation is the claim, later turns follow up."""
    turns = load(spark, folder, "conversations")
    first = turns.filter("turn = 0").selectExpr("conv_id as id", "text as claim_text", "role as verdict")
    later = turns.filter("turn > 0").selectExpr(
        "conv_id * 1000 + turn as id", "conv_id as claim_id", "text as question", "role as answer",
        f"{at(BASE, '0', 'turn')} as created_at",
    )
    return first, later


def answers(spark, folder):
    return load(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn as id",
        r"case (conv_id + turn) % 8 when 0 then concat('Verdict: TRUE\nExplanation: ', text)"
        r" when 1 then concat('  verdict : false\n', text) when 2 then concat(text, '\n Verdict: Mixed')"
        r" when 3 then concat('VERDICT:falsey\r\n\r\n', text) when 4 then null"
        r" when 5 then concat('Verdict: **true**\n', text) when 6 then text else 'Verdict: unclear' end as answer",
    )


# ------------------------------------------------------------------------------------------------
# The same tables for the SQL side.

TRIM = r"trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def trim(x: str) -> str:
    return TRIM.format(x)


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[\x00-\x1F\x{{7F}}-\x{{9F}}]', ' ', 'g'), '{WS}', ' ', 'g'))"


def norm(x: str) -> str:
    return rf"regexp_replace({trim(f'translate(lower({x}), ' + chr(39) + '_-/' + chr(39) + ', ' + chr(39) + '   ' + chr(39) + ')')}, '\s+', ' ', 'g')"


BIAS = (
    "CASE {0} % 6 WHEN 0 THEN 'Left-Center' WHEN 1 THEN 'CONSPIRACY-PSEUDOSCIENCE' WHEN 2 THEN ' right '"
    " WHEN 3 THEN '' WHEN 4 THEN 'Satire' ELSE NULL END"
)
FACTUAL = (
    "CASE {0} % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Very_Low' WHEN 2 THEN 'mostly-factual' WHEN 3 THEN ' low '"
    " ELSE NULL END"
)

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "t_articles": (f"""
        SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS publisher_id,
          'https://' || source || '.example.com/a/' || doc_id AS canonical_url,
          sha256('https://' || source || '.example.com/a/' || doc_id) AS canonical_url_hash,
          split_part(text, chr(10), 1) AS title,
          CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS description,
          CASE WHEN doc_id % 10 = 0 THEN NULL ELSE TIMESTAMP '{BASE}' + to_hours(doc_id) END AS published_date,
          (['DISCOVERED','FETCHED','EXTRACTED','INDEXED','ERROR'])[doc_id % 5 + 1] AS status
        FROM documents""", ()),
    "t_content": ("SELECT doc_id AS article_id, text AS extracted_text FROM documents", ()),
    "t_long_content": ("SELECT doc_id AS article_id, text AS extracted_text FROM documents WHERE length(text) >= 100", ()),
    "t_links": (f"""
        SELECT article_id * 4 + j AS id, article_id, (article_id * 7 + j * 11) % 1500 AS source_endpoint_id,
          'item-' || article_id || '-' || j AS source_item_id,
          TIMESTAMP '{BASE}' + to_minutes(article_id * 3 + (j * 7) % 4) AS fetched_at
        FROM (SELECT doc_id AS article_id, unnest(range(0, n_chars % 3 + 1)) AS j FROM documents)""", ()),
    "t_publishers": ("""
        SELECT c_custkey AS id, c_name AS name,
          CASE c_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN NULL ELSE ' ' END AS country_code,
          CASE c_custkey % 5 WHEN 0 THEN 'https://www.Site' || c_custkey || '.example.com/news?x=1'
            WHEN 1 THEN 'SITE' || c_custkey || '.example.com' WHEN 2 THEN ' (site' || c_custkey || '.example.com) '
            WHEN 3 THEN NULL ELSE 'not a site ' || c_custkey END AS website_url,
          CASE WHEN c_custkey % 5 < 3 THEN 'site' || c_custkey || '.example.com' END AS domain,
          CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS rating_id
        FROM customer""", ()),
    "t_ratings": (f"""
        SELECT p_partkey AS rating_id, p_name AS source_name, 'https://ratings.example.org/' || p_partkey AS rating_url,
          {BIAS.format('p_size')} AS bias, 'US' AS country, {FACTUAL.format('p_size')} AS factual_reporting,
          p_type AS media_type, 'https://www.site' || (p_partkey // 2) || '.example.com/' AS source_url,
          'site' || (p_partkey // 2) || '.example.com' AS source_url_domain,
          CASE p_size % 4 WHEN 0 THEN 'high credibility' WHEN 1 THEN 'Low' WHEN 2 THEN '  ' ELSE NULL END AS credibility
        FROM part""", ()),
    "t_endpoints": ("""
        SELECT o_orderkey AS id, o_custkey AS publisher_id,
          CASE WHEN o_orderstatus = 'F' THEN 'RSS' ELSE 'API' END AS kind, 'Feed ' || o_orderkey AS display_name,
          CASE WHEN o_orderstatus = 'F' THEN 'https://feeds.example.com/' || o_orderkey END AS rss_url,
          CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'NewsAPI'
            WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE 'newsapi' END AS api_provider,
          CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderkey % 11 = 0 THEN ' '
            WHEN o_orderkey % 3 = 0 THEN ' SRC-' || (o_orderkey % 4000) ELSE 'src-' || (o_orderkey % 4000) END AS api_query,
          o_totalprice < 400000 AS enabled, 1440 * (1 + o_orderkey % 300) AS fetch_interval_minutes,
          CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS last_fetched_at,
          o_orderkey % 4 AS failure_count, o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' AS robots_disallowed,
          CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN o_orderdate + to_days(30) END AS blocked_until,
          CASE WHEN o_orderkey % 2 = 1 THEN 'BLOCKED_OR_CAPTCHA' END AS block_reason, o_orderkey % 2 AS block_count
        FROM orders""", ()),
    "t_logs": ("""
        SELECT event_id AS id, 0 AS version, event_id // 4 AS run_id, k AS source_endpoint_id, ts AS started_at,
          CASE WHEN value < 2 THEN NULL ELSE ts + to_minutes(CAST(floor(value) AS BIGINT)) END AS completed_at,
          k AS articles_fetched, k % 7 AS articles_processed, k % 3 AS articles_failed,
          CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'PARTIAL' WHEN 'signup' THEN 'SKIPPED'
            ELSE 'SUCCESS' END AS status,
          CASE WHEN event_type = 'error' THEN CASE k % 6 WHEN 0 THEN 'Robots.txt disallows scraping for this source'
            WHEN 1 THEN 'NLP embed failed: 503' WHEN 2 THEN 'HTTP status 500' WHEN 3 THEN '' WHEN 4 THEN NULL
            ELSE 'Too many chunks for embedding' END END AS error_details
        FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""", ()),
    "t_runs": ("""
        SELECT run_id AS id, 0 AS version, min(started_at) AS started_at,
          CASE WHEN run_id % 4 IN (0, 3) THEN NULL ELSE max(started_at) END AS completed_at,
          CASE run_id % 4 WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' ELSE 'RUNNING' END AS status
        FROM t_logs GROUP BY run_id""", ("t_logs",)),
    "t_items": (f"""
        SELECT length(url) AS endpoint_id, page_id * 2 + j AS pos, page_id,
          CASE WHEN j = 1 AND page_id % 2 = 0 THEN url || '#again' WHEN page_id % 5 = 3 THEN NULL ELSE url END
            AS source_item_id,
          CASE page_id % 9 WHEN 4 THEN url || '/VIDEO/1' WHEN 7 THEN ' ' ELSE url END AS external_url,
          'Page ' || page_id AS title,
          CASE WHEN page_id % 18 = 4 THEN 'Own text of page ' || page_id END AS raw_text
        FROM pages, (VALUES (0), (1)) v(j)""", ()),
    "t_valid": ("""
        SELECT endpoint_id, pos, coalesce(source_item_id, external_url) AS source_item_id, external_url, title, raw_text
        FROM t_items WHERE trim(external_url) <> '' AND NOT (raw_text IS NULL AND external_url LIKE '%/VIDEO/%')
        """, ("t_items",)),
    "t_known_articles": ("""
        SELECT p.page_id + 100 AS id, e.publisher_id, p.url AS canonical_url, sha256(p.url) AS canonical_url_hash
        FROM pages p JOIN t_endpoints e ON e.id = length(p.url) WHERE p.url LIKE 'https://%'""", ("t_endpoints",)),
    "t_known_links": ("""
        SELECT length(url) AS source_endpoint_id, url AS source_item_id FROM pages WHERE url LIKE '%.example.net/%'
        """, ()),
    "t_new": ("""
        SELECT * FROM (
          SELECT v.*, row_number() OVER (PARTITION BY endpoint_id, source_item_id ORDER BY pos) AS rn
          FROM t_valid v WHERE NOT EXISTS (SELECT 1 FROM t_known_links k
            WHERE k.source_endpoint_id = v.endpoint_id AND k.source_item_id = v.source_item_id))
        WHERE rn = 1""", ("t_valid", "t_known_links")),
    "t_hits": (f"""
        SELECT doc_id // 5 AS claim_id, doc_id % 5 AS rank,
          CASE WHEN n_chars % 4 = 0 THEN NULL ELSE doc_id // 5 * 2 + CASE WHEN doc_id % 5 >= 3 THEN 1 ELSE 0 END END
            AS article_id,
          CASE WHEN n_chars % 3 = 0 THEN NULL ELSE 'https://example.com/' || (doc_id // 5) END AS article_url,
          CASE WHEN n_chars % 7 = 0 THEN ' ' ELSE 'Title ' || (doc_id // 5) END AS title,
          source AS source_name,
          CASE WHEN doc_id % 10 = 0 THEN NULL ELSE TIMESTAMP '{BASE}' + to_hours(doc_id // 7) END AS published_date,
          {BIAS.format('n_chars')} AS bias, {FACTUAL.format('n_chars')} AS factual_reporting,
          CASE n_chars % 8 WHEN 0 THEN 'high credibility' WHEN 1 THEN 'Low' WHEN 2 THEN '  ' ELSE NULL END AS credibility,
          CAST(n_chars % 100 AS DOUBLE) / 100 AS distance, text
        FROM documents""", ()),
    "t_chunks": (f"""
        SELECT vec_id AS chunk_id, embedding AS vector, vec_id // 3 AS article_id, 'chunk ' || vec_id AS text,
          'src' || label AS source_name,
          CASE WHEN label = 3 THEN NULL ELSE TIMESTAMP '{BASE}' + to_hours(vec_id) END AS published_date,
          {BIAS.format('label')} AS bias, {FACTUAL.format('label')} AS factual_reporting
        FROM embeddings""", ()),
    "t_pairs": ("""
        SELECT q.vec_id AS claim_id, c.vec_id AS chunk_id,
          CAST(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS FLOAT) AS distance
        FROM embeddings q, embeddings c""", ()),
    "t_claims": (f"""
        SELECT item_id AS id, item_id AS claim_id, text AS claim_text, 'user' || (item_id % 3) AS owner_username,
          TIMESTAMP '{BASE}' + to_minutes(item_id // 2) AS created_at,
          CASE item_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'mixed' END AS verdict,
          CASE WHEN item_id % 5 = 0 THEN NULL ELSE 'stored explanation' END AS explanation
        FROM benchmark""", ()),
    "t_answers": ("""
        SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 8
          WHEN 0 THEN 'Verdict: TRUE' || chr(10) || 'Explanation: ' || text
          WHEN 1 THEN '  verdict : false' || chr(10) || text WHEN 2 THEN text || chr(10) || ' Verdict: Mixed'
          WHEN 3 THEN 'VERDICT:falsey' || chr(13) || chr(10) || chr(13) || chr(10) || text WHEN 4 THEN NULL
          WHEN 5 THEN 'Verdict: **true**' || chr(10) || text WHEN 6 THEN text ELSE 'Verdict: unclear' END AS answer
        FROM conversations""", ()),
}


def hashed(h: str) -> str:
    """SQL for the 64 values of the deterministic embedding from a hex digest."""
    digit = lambda at: f"strpos('0123456789abcdef', substr({h}, 2 * (j % 32) + {at}, 1)) - 1"
    return f"list_transform(range(0, 64), lambda j: CAST(({digit(1)}) * 16 + {digit(2)} AS DOUBLE) / 255.0)"


def chunk_tables(p: str, source: str, needs: tuple[str, ...]) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Sentences, boundaries, the chunk fold and chunk rows of ``source(doc_id, text)``, as tables ``{p}_…``."""
    return {
        f"{p}_sentences": (rf"""
        SELECT doc_id, list_filter(list_transform(string_split(
            regexp_replace({clean('text')}, '([.!?]) ', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s)),
            lambda s: length(s) >= 3) AS sentences
        FROM {source}""", needs),
        f"{p}_sentence_vectors": (f"""
        SELECT doc_id, i, s, h, {hashed('h')} AS v
        FROM (SELECT doc_id, unnest(range(1, len(sentences) + 1)) AS i, unnest(sentences) AS s,
                sha256(unnest(sentences)) AS h FROM {p}_sentences)""", (f"{p}_sentences",)),
        f"{p}_flags": (f"""
        SELECT doc_id, i, s, v, len(s) AS n, coalesce(list_cosine_similarity(v,
            lag(v) OVER (PARTITION BY doc_id ORDER BY i)) < 0.65, TRUE) AS boundary
        FROM {p}_sentence_vectors""", (f"{p}_sentence_vectors",)),
        f"{p}_fold": (f"""
        SELECT doc_id, 0 AS i, 0 AS start, CAST(0 AS BIGINT) AS chars, -1 AS cut FROM (SELECT DISTINCT doc_id FROM {p}_flags)
        UNION ALL
        SELECT doc_id, i, CASE WHEN is_cut THEN i ELSE start END, CASE WHEN is_cut THEN 0 ELSE chars END,
          CASE WHEN is_cut THEN i ELSE -1 END
        FROM (
          SELECT f.doc_id, s.i, f.start, f.chars + s.n AS chars,
            s.i - f.start >= 2 AND (coalesce(nxt.boundary, FALSE) OR s.i - f.start >= 8
              OR (f.chars + s.n) // 4 > 400) AS is_cut
          FROM {p}_fold f JOIN {p}_flags s ON s.doc_id = f.doc_id AND s.i = f.i + 1
          LEFT JOIN {p}_flags nxt ON nxt.doc_id = f.doc_id AND nxt.i = f.i + 2)""", (f"{p}_flags",)),
        f"{p}_semantic": (f"""
        SELECT doc_id, chunk_index, CASE WHEN n_chunks > 1 THEN greatest(begin - 1, 0) ELSE begin END AS first, begin, stop
        FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stop) - 1 AS chunk_index, stop,
                coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY stop), 0) AS begin,
                count(*) OVER (PARTITION BY doc_id) AS n_chunks
              FROM (SELECT doc_id, cut AS stop FROM {p}_fold WHERE cut > 0
                    UNION SELECT doc_id, max(i) FROM {p}_flags GROUP BY doc_id))""", (f"{p}_fold", f"{p}_flags")),
        f"{p}_chunk_rows": (f"""
        SELECT c.doc_id, c.chunk_index, c.first, c.stop, array_to_string(s.sentences[c.first + 1 : c.stop], ' ') AS text
        FROM {p}_semantic c JOIN {p}_sentences s ON s.doc_id = c.doc_id WHERE len(s.sentences) >= 10
        UNION ALL
        SELECT doc_id, k, -1, -1, array_to_string(sentences[4 * k + 1 : 4 * k + 4], ' ')
        FROM (SELECT doc_id, sentences, unnest(range(0, (len(sentences) + 3) // 4)) AS k FROM {p}_sentences
              WHERE len(sentences) < 10)""", (f"{p}_semantic", f"{p}_sentences")),
    }


TABLES.update(chunk_tables("t", "documents", ()))


def with_tables(sql: str, needs: tuple[str, ...]) -> str:
    """Prefix a query with the adapter tables it needs, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in TABLES[name][1]:
            add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return sql
    word = "WITH RECURSIVE" if any(n.endswith("_fold") for n in ordered) else "WITH"
    return f"{word} " + ",\n".join(f"{n} AS ({TABLES[n][0]})" for n in ordered) + "\n" + sql
