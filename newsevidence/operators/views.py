"""Read views over articles and claims, listings and pages, and the text gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trim_to_null, trim_ws
from .keyed import latest

# Limits of listings and inputs.
LIST_LIMIT = 50
LIST_LIMIT_MAX = 200
PAGE_SIZE = 20
PAGE_SIZE_MAX = 200
MAX_TEXT_CHARS = 50_000
MAX_BATCH_ITEMS = 100
MAX_BATCH_CHARS = 500_000
MAX_CLAIM_CHARS = 400
MAX_ARTICLE_CHUNKS = 100


def rated_publishers(publishers: DataFrame, ratings: DataFrame) -> DataFrame:
    """Publishers with the labels of their rating, blank labels as nulls."""
    labels = ratings.select(
        "rating_id", *[trim_to_null(c).alias(c) for c in ("bias", "factual_reporting", "credibility")]
    )
    return publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("source_name"), "rating_id").join(
        labels, "rating_id", "left"
    )


def article_with_rating(articles: DataFrame, publishers: DataFrame, ratings: DataFrame) -> DataFrame:
    """Articles with publisher name and rating labels: the two small tables meet first, so the
    articles are joined once."""
    return articles.join(rated_publishers(publishers, ratings), "publisher_id")


def latest_source(links: DataFrame) -> DataFrame:
    """Newest link per article."""
    return latest(links, ["article_id"], ["fetched_at", "id"])


def article_metadata_view(articles: DataFrame, publishers: DataFrame, links: DataFrame) -> DataFrame:
    """Eleven columns per article: identity, publisher, newest source."""
    source = latest_source(links).select("article_id", "source_endpoint_id", "source_item_id", "fetched_at")
    names = publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher_name"))
    return (
        articles.withColumnRenamed("id", "article_id")
        .join(source, "article_id", "left")
        .join(names, "publisher_id")
        .select("article_id", "publisher_id", "publisher_name", "canonical_url", "title", "description",
                "published_date", "status", "source_endpoint_id", "source_item_id", "fetched_at")
    )


def article_content_view(articles: DataFrame, content: DataFrame, publishers: DataFrame,
                         links: DataFrame) -> DataFrame:
    """Metadata view plus text, for articles that have text."""
    return article_metadata_view(articles, publishers, links).join(content, "article_id")


def missing_content(articles: DataFrame, content: DataFrame) -> DataFrame:
    """Articles the content view rejects."""
    return articles.withColumnRenamed("id", "article_id").join(content, "article_id", "left_anti").select(
        "article_id", F.lit("content not found").alias("reject_reason")
    )


def clamp_limit(limit: int) -> int:
    return LIST_LIMIT if limit <= 0 else min(limit, LIST_LIMIT_MAX)


def latest_articles(articles: DataFrame, limit: int = 0) -> DataFrame:
    """Newest articles: published date descending with nulls last, then id; a top-k, not a sort."""
    return articles.orderBy(F.desc_nulls_last("published_date"), F.desc("id")).limit(clamp_limit(limit))


def title_search(articles: DataFrame, query: str | None, limit: int = 0, title: str = "title") -> DataFrame:
    """Titles that contain the query, ignoring case; ``%`` and ``_`` are wildcards. Blank means latest."""
    if query is None or not query.strip():
        return latest_articles(articles, limit)
    return latest_articles(articles.filter(F.lower(title).like(f"%{query.strip().lower()}%")), limit)


def check_page(page: int, size: int) -> None:
    if page < 0:
        raise ValueError("page must be >= 0")
    if not 1 <= size <= PAGE_SIZE_MAX:
        raise ValueError("size must be between 1 and 200")


def page_of(df: DataFrame, page: int = 0, size: int = PAGE_SIZE, order: tuple[str, ...] = ("id",)) -> DataFrame:
    check_page(page, size)
    return df.orderBy(*order).offset(page * size).limit(size)


def page_after(df: DataFrame, last: int | None, size: int = PAGE_SIZE, key: str = "id") -> DataFrame:
    """The page after key ``last``; unlike an offset its cost does not grow with the page number."""
    check_page(0, size)
    rest = df if last is None else df.filter(F.col(key) > last)
    return rest.orderBy(key).limit(size)


def page_totals(df: DataFrame, size: int = PAGE_SIZE, by: list[str] | None = None) -> DataFrame:
    check_page(0, size)
    counted = df.groupBy(*(by or [])).agg(F.count("*").alias("total_elements"))
    return counted.withColumn("total_pages", F.ceil(F.col("total_elements") / size))


def owner_claims(claims: DataFrame, owner: str, is_admin: bool = False) -> DataFrame:
    """Claims a user may see."""
    if is_admin:
        return claims
    if not owner or not owner.strip():
        raise ValueError("owner must be given")
    return claims.filter(F.col("owner_username") == owner)


def recent_claims(claims: DataFrame, limit: int, owner: str, is_admin: bool = False) -> DataFrame:
    visible = owner_claims(claims, owner, is_admin)
    return visible.orderBy(F.desc("created_at"), F.desc("id")).limit(max(limit, 0))


def claim_history(claims: DataFrame, followups: DataFrame, evidence: DataFrame) -> DataFrame:
    """History of every claim in long form: one row per entry, ordered by (claim_id, section, at, entry_id).

    Sections are 0 the claim with its verdict, 1 its evidence in rank order, 2 its follow-ups in time
    order. The long form keeps a claim with very many entries spread over tasks.
    """
    head = claims.select(
        F.col("id").alias("claim_id"), F.lit(0).alias("section"), F.lit(None).cast("timestamp").alias("at"),
        F.lit(0).cast("long").alias("entry_id"), F.col("claim_text").alias("text"), F.col("verdict").alias("note"),
    )
    found = evidence.select(
        "claim_id", F.lit(1).alias("section"), F.lit(None).cast("timestamp").alias("at"),
        F.col("rank").cast("long").alias("entry_id"), F.col("text"), F.col("source_name").alias("note"),
    )
    asked = followups.select(
        "claim_id", F.lit(2).alias("section"), F.col("created_at").alias("at"), F.col("id").alias("entry_id"),
        F.col("question").alias("text"), F.col("answer").alias("note"),
    )
    known = claims.select(F.col("id").alias("claim_id"))
    return head.unionByName(found.unionByName(asked).join(known, "claim_id", "left_semi"))


# Text gates ------------------------------------------------------------------------------------

def text_reject_reason(text, max_chars: int = MAX_TEXT_CHARS) -> Column:
    """Why a text may not be preprocessed; null when it may."""
    stripped = F.length(trim_ws(text))
    return F.when(is_blank(text), F.lit("text is empty")).when(stripped > max_chars, F.lit("text is too long"))


def claim_reject_reason(text, max_chars: int = MAX_CLAIM_CHARS) -> Column:
    return F.when(is_blank(text), F.lit("claim is empty")).when(
        F.length(trim_ws(text)) > max_chars, F.lit("claim is too long")
    )


def sentences_reject_reason(sentences, max_items: int = MAX_BATCH_ITEMS, max_chars: int = MAX_TEXT_CHARS,
                            max_total: int = MAX_BATCH_CHARS) -> Column:
    """Why a list of sentences may not be embedded; null when it may. Single sentences count with their blanks."""
    s = F.col(sentences) if isinstance(sentences, str) else sentences
    total = F.aggregate(s, F.lit(0), lambda n, x: n + F.coalesce(F.length(trim_ws(x)), F.lit(0)))
    return (
        F.when(F.coalesce(F.size(s), F.lit(-1)) <= 0, F.lit("sentences list is empty"))
        .when(F.size(s) > max_items, F.lit("too many sentences in one request"))
        .when(total > max_total, F.lit("total size exceeds the limit"))
        .when(F.exists(s, lambda x: is_blank(x)), F.lit("a sentence is empty"))
        .when(F.exists(s, lambda x: F.length(x) > max_chars), F.lit("a sentence is too long"))
    )


def vector_reject_reason(vector, dim: int) -> Column:
    size = F.coalesce(F.size(vector), F.lit(-1))
    return F.when(size != dim, F.concat(F.lit("vector size is "), size.cast("string")))


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reject_reason", reason)
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()),
    )


def batch_reject_reasons(texts: DataFrame, request: str, text: str, max_items: int = MAX_BATCH_ITEMS,
                         max_chars: int = MAX_TEXT_CHARS, max_total: int = MAX_BATCH_CHARS) -> DataFrame:
    """``(request, n_items, n_chars, reject_reason)`` for embedding requests."""
    length = F.length(trim_ws(text))
    totals = texts.groupBy(request).agg(
        F.count("*").alias("n_items"),
        F.sum(F.coalesce(length, F.lit(0))).alias("n_chars"),
        F.max(is_blank(text)).alias("_blank"),
        F.max(F.coalesce(length, F.lit(0))).alias("_longest"),
    )
    reason = (
        F.when(F.col("n_items") > max_items, F.lit("too many texts in one request"))
        .when(F.col("_blank"), F.lit("a text is empty"))
        .when(F.col("_longest") > max_chars, F.lit("a text is too long"))
        .when(F.col("n_chars") > max_total, F.lit("total size exceeds the limit"))
    )
    return totals.select(request, "n_items", "n_chars", reason.alias("reject_reason"))


def chunk_count_rejects(chunks: DataFrame, article: str = "article_id", limit: int = MAX_ARTICLE_CHUNKS) -> DataFrame:
    """Articles with more chunks than one embedding request may carry."""
    counted = chunks.groupBy(article).agg(F.count("*").alias("n_chunks"))
    return counted.filter(F.col("n_chunks") > limit).withColumn(
        "reject_reason", F.lit("too many chunks for embedding")
    )


def endpoint_counts(endpoints: DataFrame, links: DataFrame) -> DataFrame:
    """Links per endpoint, 0 where there are none."""
    counted = links.groupBy(F.col("source_endpoint_id").alias("id")).agg(F.count("*").alias("n"))
    return endpoints.select("id").join(counted, "id", "left").select(
        F.col("id").alias("endpoint_id"), F.coalesce("n", F.lit(0)).alias("n")
    )
