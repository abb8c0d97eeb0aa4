"""Nearest evidence for whole tables of claims, and the filters around it."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col, is_blank, normalize_label
from ..session import shared_dir
from .cells import Cells, build_cells, common_size, open_cells, search_cells, with_cell_columns  # noqa: F401
from .keyed import top_per_key
from .vectorset import TILE_CHUNKS, TopK, chunk_vector_rejects, claim_vector_rejects, tile_rows, unit_rows, unusable_vector  # noqa: F401

# Search defaults and the labels of badly rated sources.
TOP_K = 5
MAX_DISTANCE = 0.5
SEARCH_LIMIT = 10
SEARCH_LIMIT_MAX = 100
MIN_SCORE = 0.7
BAD_BIAS = ["questionable", "conspiracy", "pseudoscience", "satire"]
BAD_LEVELS = ["very low", "low"]

# Size bound under which the claim vectors may be sent to every task.
BROADCAST_BYTES = 64 * 1024 * 1024
# Estimated size of one hit row when hits are broadcast to fetch their chunk columns.
HIT_BYTES = 64


def is_bad_source(bias="bias", factual="factual_reporting", credibility="credibility") -> Column:
    """Bias label contains a bad token, or a level label is one of the bad levels; blanks are fine."""
    contains = normalize_label(bias).rlike("|".join(BAD_BIAS))
    level = lambda c: F.coalesce(normalize_label(c).isin(BAD_LEVELS), F.lit(False))
    return F.coalesce(contains, F.lit(False)) | level(factual) | level(credibility)


def drop_bad_sources(hits: DataFrame, **labels: str) -> DataFrame:
    return hits.filter(~is_bad_source(**labels))


def score(distance) -> Column:
    return (F.lit(1.0).cast("float") - col(distance).cast("float")).cast("float")


def with_min_score(hits: DataFrame, min_score: float = MIN_SCORE, distance: str = "distance") -> DataFrame:
    """Keep hits whose float score reaches ``min_score``; adds ``score``."""
    return hits.withColumn("score", score(distance)).filter(F.col("score") >= F.lit(min_score).cast("float"))


def within_distance(hits: DataFrame, max_distance: float = MAX_DISTANCE, distance: str = "distance") -> DataFrame:
    """Keep hits within the limit; both sides are compared in single precision."""
    return hits.filter(F.col(distance).cast("float") <= F.lit(max_distance).cast("float"))


def search_filters(chunks: DataFrame, source_names: list[str] | None = None, published_after=None,
                   published_before=None) -> DataFrame:
    """Restrict chunks by source and date before a search."""
    out = chunks
    if source_names:
        out = out.filter(F.col("source_name").isin(source_names))
    if published_after is not None:
        out = out.filter(F.col("published_date") >= F.lit(published_after))
    if published_before is not None:
        out = out.filter(F.col("published_date") <= F.lit(published_before))
    return out


def _broadcast_hits(claims: pd.DataFrame, chunks: DataFrame, k: int, max_distance: float, schema: T.StructType):
    """One pass over the chunks; every task holds the bounded claim matrix and keeps k rows per claim."""
    shared = chunks.sparkSession.sparkContext.broadcast(
        (claims["claim_id"].to_numpy(), unit_rows(claims["vector"])) if len(claims) else None
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if shared.value is None:
            return
        best = TopK(*shared.value, k, max_distance)
        for batch in batches:
            step = tile_rows(2 * best.dim, TILE_CHUNKS)
            for low in range(0, len(batch), step):
                part = batch.iloc[low:low + step]
                best.add(part["chunk_id"].to_numpy(), unit_rows(part["vector"]))
        if best.count.any():
            yield best.rows().drop(columns="tag")

    return chunks.select("chunk_id", "vector").mapInPandas(scan, schema)


def _nearest(claims: DataFrame, chunks: DataFrame, k: int, max_distance: float, broadcast_bytes: int,
             cells: Cells | None = None) -> tuple[DataFrame, int | None]:
    """Hits, and the most rows they can have where the claims were few enough to count.

    Vectors that can't be compared take no part on either side: the claims' commonest size, or the layout's, is expected.
    """
    spark = claims.sparkSession
    dim = cells.dim if cells else common_size(claims.select("vector"))
    id_type = cells.id_type if cells else chunks.schema["chunk_id"].dataType
    schema = T.StructType([
        T.StructField("claim_id", claims.schema["claim_id"].dataType),
        T.StructField("chunk_id", id_type),
        T.StructField("distance", T.FloatType()),
    ])
    if dim is None:  # no claim to search for
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])), 0
    folder = f"{shared_dir(spark)}/search/{uuid4().hex}"
    if cells:
        return search_cells(claims, cells, k, max_distance, folder), None
    slim = claims.select("claim_id", "vector").filter(unusable_vector("vector", dim).isNull())
    fit = max(1, broadcast_bytes // (8 * dim))
    small = slim.limit(fit + 1).toPandas()  # never more than the bound allows, plus one row
    if len(small) > fit:
        made = build_cells(chunks.select("chunk_id", "vector"), f"{folder}/cells", dim)
        return search_cells(slim, made, k, max_distance, folder).drop("cell"), None
    usable = chunks.filter(unusable_vector("vector", dim).isNull())
    hits = _broadcast_hits(small, usable, k, max_distance, schema)
    return top_per_key(hits, ["claim_id"], [F.asc("distance"), F.asc("chunk_id")], k, rank="rank"), len(small) * k


def nearest_chunks(claims: DataFrame, chunks: DataFrame | None, k: int = TOP_K, max_distance: float = MAX_DISTANCE, *,
                   broadcast_bytes: int = BROADCAST_BYTES, cells: Cells | None = None) -> DataFrame:
    """``(claim_id, chunk_id, distance, rank)``: the k nearest chunks of each claim within the limit.

    Distance is one minus cosine, and it and the limit are single precision; ties go to the smaller
    chunk id. Dropping rows past ``max_distance`` early does not change which rows survive both cuts.
    Claims and chunks without a usable vector have no part in it, see :func:`claim_vector_rejects` and
    :func:`chunk_vector_rejects`. With ``cells``, a stored layout, only cells that can hold a hit are
    read. Without it the claims are counted up to the broadcast bound: below it they travel to every
    task, above it a layout is made for this search.
    """
    return _nearest(claims, chunks, k, max_distance, broadcast_bytes, cells)[0].drop("cell")


def _with_chunk_columns(hits: DataFrame, most: int | None, chunks: DataFrame) -> DataFrame:
    """Fetch the other columns of the hit chunks.

    Few claims have few hits (k each), which are then broadcast so that the chunk table is scanned
    but not shuffled; its vectors are not read again.
    """
    if most is not None and most * HIT_BYTES <= BROADCAST_BYTES:
        hits = F.broadcast(hits)
    return chunks.drop("vector").join(hits, "chunk_id")


def evidence_search(claims: DataFrame, chunks: DataFrame | None, k: int = TOP_K, max_distance: float = MAX_DISTANCE, *,
                    prefilter: bool = False, broadcast_bytes: int = BROADCAST_BYTES, cells: Cells | None = None) -> DataFrame:
    """Evidence of every claim: top k, distance limit, then badly rated sources dropped.

    A claim may therefore end with fewer than k rows; ``prefilter`` drops the sources first. With ``cells``, the layout
    that :func:`build_cells` has stored, neither vectors nor texts of cells without a hit are read; a prefilter must have been
    applied before the layout was made.
    """
    if cells:
        if prefilter:
            raise ValueError("a stored layout is filtered when it is made")
        hits, _ = _nearest(claims, chunks, k, max_distance, broadcast_bytes, cells)
        return drop_bad_sources(with_cell_columns(hits, cells))
    pool = drop_bad_sources(chunks) if prefilter else chunks
    hits, most = _nearest(claims, pool, k, max_distance, broadcast_bytes)
    found = _with_chunk_columns(hits, most, pool)
    return found if prefilter else drop_bad_sources(found)


def search(claims: DataFrame, chunks: DataFrame, limit: int = SEARCH_LIMIT, min_score: float = MIN_SCORE,
           broadcast_bytes: int = BROADCAST_BYTES, **filters) -> DataFrame:
    """Vector search by score, with optional source and date filters applied first."""
    if not 1 <= limit <= SEARCH_LIMIT_MAX:
        raise ValueError("limit must be between 1 and 100")
    pool = search_filters(chunks, **filters)
    # What scores less can't come out; the slack leaves the exact cut to the score itself.
    hits, most = _nearest(claims, pool, limit, min(2.0, 1.0 - min_score + 1e-3), broadcast_bytes)
    return _with_chunk_columns(with_min_score(hits, min_score), most, pool)


def article_chunks(chunks: DataFrame, article_id: int | None = None, limit: int = 512) -> DataFrame:
    """Chunk texts by index, at most ``limit`` per article, blank ones dropped after the limit."""
    rows = chunks if article_id is None else chunks.filter(F.col("article_id") == article_id)
    first = top_per_key(rows, ["article_id"], [F.asc("chunk_index")], limit)
    return first.filter(~is_blank("text"))
