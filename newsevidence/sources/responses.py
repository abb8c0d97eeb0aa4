"""Landed answers of the vector store and of the models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_iso_utc, trim_to_null

HITS_SCHEMA = (
    "errors array<string>, data struct<Get: struct<ArticleChunk: array<struct<text: string, articleTitle: string, "
    "sourceName: string, articleId: bigint, articleUrl: string, publishedDate: string, chunkIndex: int, "
    "mbfcBias: string, mbfcFactualReporting: string, mbfcCredibility: string, "
    "_additional: struct<distance: double>>>>>"
)
# Distance of a hit that names none, and the reply for a body without text.
MISSING_DISTANCE = 1.0
NO_TEXT = "No text field found in AI response: "


def _parsed(responses: DataFrame) -> DataFrame:
    return responses.withColumn("r", F.from_json("json", HITS_SCHEMA))


def hit_rejects(responses: DataFrame) -> DataFrame:
    """Responses that report errors or are not JSON."""
    bad = (F.coalesce(F.size("r.errors"), F.lit(0)) > 0) | F.col("r.data").isNull()
    return _parsed(responses).filter(bad).select("query_id", "json")


def parse_hits(responses: DataFrame, max_distance: float | None = None) -> DataFrame:
    """Hits of ``responses(query_id, json)`` in response order; failed responses are left out."""
    good = _parsed(responses).filter(F.coalesce(F.size("r.errors"), F.lit(0)) <= 0)
    hits = good.select("query_id", F.posexplode("r.data.Get.ArticleChunk").alias("rank", "h"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = hits.select(
        "query_id",
        "rank",
        F.coalesce("h._additional.distance", F.lit(MISSING_DISTANCE)).cast("float").alias("distance"),
        F.when(F.col("h.articleId") > 0, F.col("h.articleId")).alias("article_id"),
        trim_to_null("h.articleUrl").alias("article_url"),
        empty("h.articleTitle").alias("title"),
        empty("h.text").alias("text"),
        empty("h.sourceName").alias("source_name"),
        parse_iso_utc("h.publishedDate").alias("published_date"),
        F.coalesce("h.chunkIndex", F.lit(0)).alias("chunk_index"),
        trim_to_null("h.mbfcBias").alias("bias"),
        trim_to_null("h.mbfcFactualReporting").alias("factual_reporting"),
        trim_to_null("h.mbfcCredibility").alias("credibility"),
    )
    if max_distance is None:
        return out
    return out.filter(F.col("distance") <= F.lit(max_distance).cast("float"))


def model_text(responses: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``answer``: the first text part of a chat response, else a fixed message with the body."""
    text = F.get_json_object(body, "$.candidates[0].content.parts[0].text")
    return responses.withColumn("answer", F.coalesce(text, F.concat(F.lit(NO_TEXT), F.col(body))))


def model_vector(responses: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``vector`` from an embedding response and ``reject_reason`` where there is none."""
    values = F.get_json_object(body, "$.predictions[0].embeddings.values")
    vector = F.from_json(values, "array<double>").cast("array<float>")
    out = responses.withColumn("vector", vector)
    missing = F.coalesce(F.size("vector"), F.lit(0)) <= 0
    return out.withColumn("reject_reason", F.when(missing, F.lit("no embedding values")))
