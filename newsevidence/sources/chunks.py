"""The chunk table: row building, schema growth, hand-made evidence, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import chunk_object_id
from ..functions.text import trim_to_null

# Columns added to chunk tables written before ratings existed, and manual defaults.
RATING_COLUMNS = ["bias", "factual_reporting", "credibility"]
MANUAL_SOURCE = "manual"


INFO_COLUMNS = ("article_url", "article_title", "source_name", *RATING_COLUMNS, "published_date")


def article_info(articles: DataFrame, now: Column | None = None) -> DataFrame:
    """What every chunk of an article carries, from the rated article view: id, canonical_url,
    title, source_name, labels, published_date."""
    stamp = F.current_timestamp() if now is None else now
    return articles.select(
        F.col("id").alias("article_id"),
        F.coalesce("canonical_url", F.lit("")).alias("article_url"),
        F.coalesce("title", F.lit("")).alias("article_title"),
        F.coalesce("source_name", F.lit("")).alias("source_name"),
        *[trim_to_null(c).alias(c) for c in RATING_COLUMNS],
        F.coalesce("published_date", stamp).alias("published_date"),
    )


def texts_with_info(texts: DataFrame, articles: DataFrame, now: Column | None = None) -> DataFrame:
    """Texts next to what their chunks must carry.

    The merge hint makes the join partition by article id. A broadcast of small texts would leave
    the costly cut on partitions by publisher, where one outlet may hold a third of all articles.
    """
    return texts.join(article_info(articles, now).hint("merge"), "article_id")


def finish_chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the chunk table from chunks that carry their article's columns."""
    return chunks.select(
        chunk_object_id("article_id", "chunk_index").alias("chunk_id"),
        "text",
        "article_id",
        *INFO_COLUMNS,
        "chunk_index",
        F.col("vector").cast("array<float>").alias("vector"),
    )


def build_chunk_rows(articles: DataFrame, chunks: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the chunk table from ``chunks(article_id, chunk_index, text, vector)``.

    Articles without chunks write nothing. Where the texts are still at hand, start from
    :func:`texts_with_info` and cut afterwards: that shuffles texts instead of vectors.
    """
    return finish_chunk_rows(chunks.join(article_info(articles, now), "article_id"))


def pair_chunks(packed: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows from arrays ``chunks`` and ``vectors``; arrays of different length raise."""
    same = F.size("chunks") == F.coalesce(F.size("vectors"), F.lit(-1))
    checked = F.when(same, F.arrays_zip(F.col("chunks").alias("text"), F.col("vectors").alias("vector"))).otherwise(
        F.raise_error(F.lit("chunk and vector counts differ")).cast("array<struct<text:string,vector:array<double>>>")
    )
    some = packed.filter(F.size("chunks") > 0)
    return some.select(key, F.posexplode(checked).alias("chunk_index", "c")).select(key, "chunk_index", "c.*")


def grow_schema(stored: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Stored chunks with missing label columns added as nulls; all others stay as they are."""
    out = stored
    for c in columns or RATING_COLUMNS:
        if c not in stored.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files of all ages: columns that older files lack read as nulls."""
    return grow_schema(spark.read.option("mergeSchema", "true").parquet(path))


def write_chunks(stored: DataFrame, fresh: DataFrame, *, replace_article: bool = False) -> DataFrame:
    """Chunk table after a write: same ids are replaced.

    Ids go by chunk index, so an article that now has fewer chunks keeps its old higher ones unless
    ``replace_article`` drops all its rows first.
    """
    replaced = fresh.select("article_id").distinct() if replace_article else fresh.select("chunk_id")
    kept = grow_schema(stored).join(replaced, replaced.columns[0], "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def manual_rows(notes: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunk rows from hand-made ``notes(note_id, title, text, source, vector)``, and the rejects."""
    stamp = F.current_timestamp() if now is None else now
    good = F.coalesce(F.size("vector"), F.lit(0)) > 0
    rows = notes.filter(good).select(
        F.concat(F.lit("manual-"), F.col("note_id").cast("string")).alias("chunk_id"),
        "text",
        F.lit(0).cast("long").alias("article_id"),
        F.lit("").alias("article_url"),
        F.col("title").alias("article_title"),
        F.coalesce(trim_to_null("source"), F.lit(MANUAL_SOURCE)).alias("source_name"),
        *[F.lit(None).cast("string").alias(c) for c in RATING_COLUMNS],
        stamp.alias("published_date"),
        F.lit(0).alias("chunk_index"),
        F.col("vector").cast("array<float>").alias("vector"),
    )
    rejects = notes.filter(~good).select("note_id", F.lit("vector is empty").alias("reject_reason"))
    return rows, rejects
