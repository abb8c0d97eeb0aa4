"""Vectors kept by what was embedded, so that no text goes to a model twice.

The store is an append-only table of key, model and vector. A run looks its texts up by key, embeds the distinct ones that
are missing, appends them, and reads all vectors back. The store is filtered where it lies and never rewritten.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import EMBED_BATCH, Embedder, embed
from ..session import shared_dir
from ..sources.tables import stage
from .chunking import dedup_hash
from .history import touched_history

STORE = "key string, vector array<float>, model string"


def read_store(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """``key, vector`` of a model, one row per key; none where nothing was stored yet."""
    try:
        rows = spark.read.schema(STORE).parquet(f"{folder}/vectors").filter(F.col("model") == model)
    except AnalysisException:
        return spark.createDataFrame([], "key string, vector array<float>")
    return rows.select("key", "vector")


def embed_stored(texts: DataFrame, folder: str, *, text: str, model: str, embedder: Embedder | None = None, dim: int, out: str = "vector",
                 batch: int = EMBED_BATCH) -> DataFrame:
    """``texts`` with the vector of each text, taken from the store below ``folder`` or made and stored now.

    Texts with one dedup key share a vector: that of the first one embedded, the smallest text of its run. ``model`` names
    what makes the vectors; different ones don't mix. Null texts count as empty. What a run that failed has appended is
    used by the next one; if two runs embedded a key, one of the vectors is taken, the same for all its texts. The texts are
    written once with their keys to the shared folder; where none is missing, no text is shuffled.
    """
    spark, run = texts.sparkSession, f"{shared_dir(texts.sparkSession)}/embed_stored/{uuid4().hex}"
    # A key costs a pass over the text; it is made once and kept beside the row.
    keyed = stage(texts.withColumn("__key", dedup_hash(text)), run, "texts")
    asked = keyed.select("__key").distinct()
    known = touched_history(read_store(spark, folder, model), asked, {"key": "__key"})
    missing = stage(asked.join(known.select(F.col("key").alias("__key")), "__key", "left_anti"), run, "missing")
    if not missing.isEmpty():
        rows = touched_history(keyed.select("__key", text), missing, {"__key": "__key"})
        keys = rows.groupBy("__key").agg(F.min(F.coalesce(text, F.lit(""))).alias("__text")).join(missing, "__key", "left_semi")
        made = embed(keys, "__text", embedder, out="vector", dim=dim, batch=batch)
        made.select(F.col("__key").alias("key"), F.col("vector").cast("array<float>").alias("vector"), F.lit(model).alias("model")) \
            .write.mode("append").partitionBy("model").parquet(f"{folder}/vectors")
    stored = touched_history(read_store(spark, folder, model), asked, {"key": "__key"})
    stored = stored.groupBy(F.col("key").alias("__key")).agg(F.min("vector").alias(out))
    return keyed.join(stored, "__key", "left").drop("__key")
