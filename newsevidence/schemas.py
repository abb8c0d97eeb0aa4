"""Table schemas, stated as DDL. Readers pass them explicitly; nothing is inferred."""

from __future__ import annotations

PUBLISHERS = (
    "id bigint, name string, country_code string, website_url string, rating_id bigint, "
    "created_at timestamp, updated_at timestamp"
)
SOURCE_ENDPOINTS = (
    "id bigint, publisher_id bigint, kind string, display_name string, rss_url string, api_provider string, "
    "api_query string, enabled boolean, fetch_interval_minutes int, last_fetched_at timestamp, "
    "last_success_at timestamp, last_attempted_at timestamp, failure_count int, robots_disallowed boolean, "
    "blocked_until timestamp, block_reason string, block_count int, created_at timestamp, updated_at timestamp"
)
ARTICLES = (
    "id bigint, publisher_id bigint, original_url string, canonical_url string, canonical_url_hash string, "
    "title string, description string, published_date timestamp, first_seen_at timestamp, "
    "last_seen_at timestamp, content_fetched_at timestamp, http_status int, http_etag string, "
    "http_last_modified string, content_hash string, chunk_count int, status string, fetch_error string, "
    "extraction_error string, indexed boolean, created_at timestamp, updated_at timestamp"
)
ARTICLE_CONTENT = "article_id bigint, extracted_text string, extracted_at timestamp"
ARTICLE_SOURCES = (
    "id bigint, article_id bigint, source_endpoint_id bigint, source_item_id string, fetched_at timestamp"
)
INGESTION_RUNS = (
    "id bigint, version bigint, started_at timestamp, completed_at timestamp, status string, correlation_id string"
)
INGESTION_LOGS = (
    "id bigint, version bigint, run_id bigint, source_endpoint_id bigint, started_at timestamp, "
    "completed_at timestamp, articles_fetched int, articles_processed int, articles_failed int, status string, "
    "error_details string, correlation_id string"
)
RATINGS = (
    "rating_id bigint, source_name string, rating_url string, bias string, country string, "
    "factual_reporting string, media_type string, source_url string, source_url_domain string, "
    "credibility string, synced_at timestamp"
)
CLAIM_LOG = (
    "id bigint, claim_text string, owner_username string, created_at timestamp, model_answer string, "
    "verdict string, explanation string, bias_analysis string"
)
CLAIM_FOLLOWUP = "id bigint, claim_id bigint, question string, answer string, created_at timestamp"
CHUNKS = (
    "chunk_id string, text string, article_id bigint, article_url string, article_title string, "
    "source_name string, bias string, factual_reporting string, credibility string, "
    "published_date timestamp, chunk_index int, vector array<float>"
)
FEED_ITEMS = (
    "endpoint_id bigint, pos int, source_item_id string, external_url string, title string, "
    "description string, raw_text string, published_date timestamp"
)

TABLES = {
    "publishers": PUBLISHERS,
    "source_endpoints": SOURCE_ENDPOINTS,
    "articles": ARTICLES,
    "article_content": ARTICLE_CONTENT,
    "article_sources": ARTICLE_SOURCES,
    "ingestion_runs": INGESTION_RUNS,
    "ingestion_logs": INGESTION_LOGS,
    "ratings": RATINGS,
    "claim_log": CLAIM_LOG,
    "claim_followup": CLAIM_FOLLOWUP,
    "chunks": CHUNKS,
}

# What the enumerated columns may hold.
ALLOWED = {
    ("source_endpoints", "kind"): ["RSS", "API"],
    ("articles", "status"): ["DISCOVERED", "FETCHED", "EXTRACTED", "INDEXED", "ERROR"],
    ("ingestion_runs", "status"): ["RUNNING", "COMPLETED", "FAILED", "PARTIAL"],
    ("ingestion_logs", "status"): ["STARTED", "PROCESSING", "SUCCESS", "PARTIAL", "FAILED", "SKIPPED"],
}
