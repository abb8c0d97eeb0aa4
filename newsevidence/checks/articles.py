"""Checks of keyed building blocks, article views and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..operators.keyed import keep_first as first_rows
from . import adapters as A
from .registry import check


@check("keep_first", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
    """)
def keep_first(spark, d):
    kept = first_rows(A.load(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")])
    return kept.select("o_custkey", "o_orderkey", "o_totalprice")


@check("latest_source", """
    SELECT article_id, id, source_endpoint_id, source_item_id FROM (
      SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY fetched_at DESC, id DESC) AS rn FROM t_links) WHERE rn = 1
    """, ("t_links",))
def latest_source(spark, d):
    return V.latest_source(A.links(spark, d)).select("article_id", "id", "source_endpoint_id", "source_item_id")


@check("article_ratings", f"""
    SELECT a.id, p.name AS source_name, nullif({A.trim('r.bias')}, '') AS bias,
      nullif({A.trim('r.factual_reporting')}, '') AS factual_reporting, nullif({A.trim('r.credibility')}, '') AS credibility
    FROM t_articles a JOIN t_publishers p ON p.id = a.publisher_id LEFT JOIN t_ratings r ON r.rating_id = p.rating_id
    """, ("t_articles", "t_publishers", "t_ratings"))
def article_ratings(spark, d):
    view = V.article_with_rating(A.articles(spark, d), A.publishers(spark, d), A.ratings(spark, d))
    return view.select("id", "source_name", "bias", "factual_reporting", "credibility")


_VIEW = """
    FROM t_articles a JOIN t_publishers p ON p.id = a.publisher_id LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY fetched_at DESC, id DESC) AS rn FROM t_links)
      WHERE rn = 1) l ON l.article_id = a.id"""


@check("metadata_view", f"""
    SELECT a.id AS article_id, a.publisher_id, p.name AS publisher_name, canonical_url, title, description,
      strftime(published_date, '%Y-%m-%d %H:%M:%S') AS published_date, status, source_endpoint_id, source_item_id,
      strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at {_VIEW}
    """, ("t_articles", "t_publishers", "t_links"))
def metadata_view(spark, d):
    view = V.article_metadata_view(A.articles(spark, d), A.publishers(spark, d), A.links(spark, d))
    return view.select(*[A.stamp(c) if c in ("published_date", "fetched_at") else c for c in view.columns])


@check("content_view", f"""
    SELECT a.id AS article_id, p.name AS publisher_name, source_item_id, c.extracted_text {_VIEW}
      JOIN t_content c ON c.article_id = a.id
    """, ("t_articles", "t_publishers", "t_links", "t_content"))
def content_view(spark, d):
    view = V.article_content_view(A.articles(spark, d), A.content(spark, d), A.publishers(spark, d), A.links(spark, d))
    return view.select("article_id", "publisher_name", "source_item_id", "extracted_text")


@check("content_rejects", """
    SELECT id AS article_id, 'content not found' AS reject_reason FROM t_articles
    WHERE id NOT IN (SELECT article_id FROM t_long_content)
    """, ("t_articles", "t_long_content"))
def content_rejects(spark, d):
    return V.missing_content(A.articles(spark, d), A.long_content(spark, d))


@check("latest_articles", """
    SELECT id, title FROM t_articles ORDER BY published_date DESC NULLS LAST, id DESC LIMIT 50
    """, ("t_articles",))
def latest_articles(spark, d):
    return V.latest_articles(A.articles(spark, d)).select("id", "title")


@check("title_search", """
    SELECT p_partkey AS id, p_name FROM part WHERE lower(p_name) LIKE '%r_d%' ORDER BY p_size DESC NULLS LAST, id DESC LIMIT 200
    """)
def title_search(spark, d):
    parts = A.load(spark, d, "part").withColumnsRenamed({"p_partkey": "id", "p_size": "published_date"})
    return V.title_search(parts, " R_D ", 500, title="p_name").select("id", "p_name")


@check("paging", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 60")
def paging(spark, d):
    return V.page_of(A.load(spark, d, "orders"), 3, order=("o_orderkey",)).select("o_orderkey", "o_custkey")


@check("paging_after", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 79 ORDER BY o_orderkey LIMIT 20")
def paging_after(spark, d):
    return V.page_after(A.load(spark, d, "orders"), 79, key="o_orderkey").select("o_orderkey", "o_custkey")


@check("page_totals", """
    SELECT o_custkey, count(*) AS total_elements, CAST(ceil(count(*) / 5.0) AS BIGINT) AS total_pages FROM orders GROUP BY o_custkey
    """)
def page_totals(spark, d):
    return V.page_totals(A.load(spark, d, "orders"), 5, ["o_custkey"])
