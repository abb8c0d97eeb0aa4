"""Ingestion of a whole batch of landed items as one plan over all endpoints."""

from __future__ import annotations

from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.vectors import Embedder
from ..functions.web import block_reason
from ..operators.chunking import chunk_documents
from ..operators.discover import (
    apply_article_state, discover, merge_articles, merge_links, new_article_rows, new_link_rows, seen_again, valid_items,
)
from ..operators.keyed import salted_join
from ..operators.pages import VALIDATORS, fetch_results
from ..operators.robots import robots_filter
from ..operators.runs import endpoint_attempt, first_stops, update_endpoint_state, worked_endpoints
from ..operators.views import article_with_rating
from ..sources.chunks import INFO_COLUMNS, finish_chunk_rows, texts_with_info
from ..sources.tables import stage

# Fixed value: message of a page that its robots rules keep out.
ROBOTS_FETCH = "Robots.txt disallows fetching"


class Ingested(NamedTuple):
    articles: DataFrame
    links: DataFrame
    content: DataFrame
    chunks: DataFrame
    attempts: DataFrame
    endpoints: DataFrame


def page_results(pages: DataFrame, robots: DataFrame, now: Column, **gate) -> DataFrame:
    """Fetch results of landed ``pages(url, http_status, content_type, body)``, robots rules applied.

    Validators that were landed come along; a page that is barred was not fetched and has none.
    """
    barred = ~F.col("allowed")
    # The rules meet URLs only; bodies don't travel by host.
    verdict = robots_filter(pages.select("url").distinct(), robots).select("url", "allowed")
    judged = pages.join(verdict, "url").withColumn("body", F.when(~barred, F.col("body")))
    results = fetch_results(judged.withColumn("page_id", F.col("url")), keep=("allowed",), **gate)
    return results.select(
        F.col("page_id").alias("url"),
        F.when(~barred, F.col("http_status")).alias("http_status"),
        (F.col("blocked_suspected") & ~barred).alias("blocked_suspected"),
        F.when(barred, F.lit(ROBOTS_FETCH)).otherwise(F.col("fetch_error")).alias("fetch_error"),
        F.when(~barred, F.col("extraction_error")).alias("extraction_error"),
        F.when(~barred, F.col("extracted_text")).alias("extracted_text"),
        now.alias("fetched_at"),
        *[F.when(~barred, F.col(c)).alias(c) for c in VALIDATORS if c in pages.columns],
    )


def ingest(items: DataFrame, fetches: DataFrame, pages: DataFrame, robots: DataFrame, *, publishers: DataFrame,
           endpoints: DataFrame, ratings: DataFrame, articles: DataFrame, links: DataFrame, now: Column, dim: int,
           work_dir: str, embedder: Embedder | None = None, run_id: int = 0, **gate) -> Ingested:
    """One run: discover items, read their pages, chunk and embed new articles, move all states.

    ``items`` are feed items of due endpoints, ``fetches`` what was landed per endpoint, ``pages``
    one landed answer per URL. Endpoints that are flagged, blocked, failed or barred discover nothing. The others end
    at the first stop signal among the pages of their new items; only items up to it make articles and links, so an
    endpoint's new articles are those its attempt counts. Only new articles are read and indexed. What several outputs
    share (discovery, page verdicts, article snapshot, chunks) is staged in a folder of the run's own under ``work_dir``
    in the shared folder, so each costly step runs once.
    """
    work_dir = f"{work_dir}/run-{uuid4().hex}"  # a later run must not write over what this one's result still reads
    due = items.join(worked_endpoints(fetches, endpoints, now), "endpoint_id", "left_semi")
    found = discover(due, endpoints, articles, links, now)
    found = found._replace(
        articles=stage(found.articles, work_dir, "found_articles"), links=stage(found.links, work_dir, "found_links")
    )
    key = ["publisher_id", "canonical_url_hash"]
    # The item that made an article: its own text outranks the page, its place orders the attempt.
    item_keys = ["source_endpoint_id", "source_item_id"]
    accepted = valid_items(due).withColumnRenamed("endpoint_id", "source_endpoint_id")
    given = accepted.groupBy(*item_keys).agg(
        F.min("pos").alias("pos"), F.min_by("raw_text", "pos").alias("raw_text")
    )
    placed = found.links.join(given, item_keys)
    own_text = placed.filter(F.col("is_new") & ~is_blank("raw_text")).select(*key, "raw_text")
    candidates = found.articles.filter("is_new").select(*key, "canonical_url")
    wanted = pages.join(candidates.select(F.col("canonical_url").alias("url")).distinct(), "url", "left_semi")
    judged = (
        candidates.join(page_results(wanted, robots, now, **gate), F.col("canonical_url") == F.col("url"), "left")
        .join(own_text, key, "left")
        .withColumn("index_error", F.lit(None).cast("string"))
        .withColumn("fetched_at", now)
        .withColumn("fetch_error", F.when(F.col("url").isNull(), F.lit("Fetch failed")).otherwise(F.col("fetch_error")))
    )
    text = F.when(~is_blank("raw_text"), F.col("raw_text")).otherwise(F.col("extracted_text"))
    judged = stage(judged.withColumn("reason", F.when(is_blank(text), block_reason(
        F.coalesce("blocked_suspected", F.lit(False)), "fetch_error", "extraction_error"))), work_dir, "judged")
    # An endpoint ends at its first stop signal: what follows is not touched and comes again in a later run.
    owners = placed.filter("is_new").select("source_endpoint_id", "pos", *key)
    stops = first_stops(owners.join(judged.select(*key, "reason"), key), ("source_endpoint_id",))
    placed = salted_join(placed, stops, ["source_endpoint_id"], ["source_endpoint_id", "pos"], "left")
    placed = stage(placed.filter(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).drop("stop"), work_dir, "placed")
    made = placed.filter("is_new").select(*key)
    placed = placed.join(made.withColumn("_made", F.lit(True)), key, "left").filter("article_id is not null or _made").drop("_made")
    touched = placed.select(*key).distinct()
    kept = found.articles.join(touched, key, "left_semi")
    fresh = stage(new_article_rows(articles, kept, now), work_dir, "new_articles")
    stored = stage(merge_articles(articles, fresh, seen_again(kept)), work_dir, "stored_articles")
    stored_links = merge_links(links, new_link_rows(placed.select(*found.links.columns), fresh))
    new = fresh.select(*key, F.col("id").alias("article_id"))
    results = new.join(judged, key)
    results = stage(results, work_dir, "results")
    content = results.select("article_id", text.alias("extracted_text"), now.alias("extracted_at")).filter(
        ~is_blank("extracted_text")
    )
    known = texts_with_info(content, article_with_rating(fresh, publishers, ratings), now)
    cut = chunk_documents(known, "extracted_text", dim=dim, embedder=embedder, keep=INFO_COLUMNS)
    chunks = stage(finish_chunk_rows(cut), work_dir, "chunks")
    counts = chunks.groupBy("article_id").agg(F.count("*").cast("int").alias("chunk_count"))
    final = apply_article_state(stored, results, counts)

    outcome = results.select(
        *key,
        (~is_blank(text)).alias("success"),
        (~is_blank(text)).alias("indexed"),
        "reason",
    )
    worked = placed.join(outcome, key, "left").select(
        F.lit(run_id).alias("run_id"),
        F.col("source_endpoint_id").alias("endpoint_id"),
        "pos",
        F.lit(False).alias("skipped"),
        "is_new",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("indexed", F.lit(False)).alias("indexed"),
        F.when(~F.coalesce("success", F.lit(False)), F.col("reason")).alias("reason"),
    )
    attempts = endpoint_attempt(fetches.withColumn("run_id", F.lit(run_id)), endpoints, worked, now)
    return Ingested(final, stored_links, content, chunks, attempts, update_endpoint_state(endpoints, attempts, now))
