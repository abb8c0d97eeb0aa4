"""Cutting sentence arrays into chunks, and chunk vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, dedup_key, split_sentences
from ..functions.vectors import Embedder, cosine, embed, hash_embedding, mean_vector
from .chunk_stream import (
    FIXED_SENTENCES,
    MAX_SENTENCES,
    MAX_TOKENS,
    MIN_SENTENCES,
    OVERLAP,
    SEMANTIC_FROM,
    SIMILARITY,
    hash_embedder,
    stream_chunks,
)

def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed_chunks(sentences, size: int = FIXED_SENTENCES) -> Column:
    """Runs of ``size`` sentences joined by a blank; the last run may be shorter."""
    s = col(sentences)
    last = F.ceil(F.size(s) / size).cast("int") - 1
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(s, i * size + 1, F.lit(size)), " "))
    return F.when(F.size(s) > 0, runs).otherwise(F.array().cast("array<string>"))


def boundary_flags(vectors, threshold: float = SIMILARITY) -> Column:
    """Per sentence: is it unlike the one before it? The first one counts as a boundary."""
    v = col(vectors)
    rest = F.size(v) - 1
    low = F.zip_with(F.slice(v, 1, rest), F.slice(v, 2, rest), lambda a, b: cosine(a, b) < threshold)
    return (
        F.when(F.size(v) > 1, F.concat(F.array(F.lit(True)), low))
        .otherwise(F.array(F.lit(True)))
    )


def semantic_boundaries(sentences, vectors, threshold: float = SIMILARITY) -> Column:
    """Indexes of boundary sentences, 0 always among them; unequal lengths raise."""
    flags = boundary_flags(vectors, threshold)
    spots = F.filter(F.transform(flags, lambda f, i: F.when(f, i).otherwise(-1)), lambda i: i >= 0)
    fits = F.coalesce(F.size(col(sentences)) == F.size(col(vectors)), F.lit(False))
    return F.when(fits, spots).otherwise(
        F.raise_error(F.lit("sentences.size != embeddings.size")).cast("array<int>")
    )


def chunk_cuts(sentences, flags, min_sentences: int = MIN_SENTENCES, max_sentences: int = MAX_SENTENCES,
               max_tokens: int = MAX_TOKENS) -> Column:
    """Ends of the chunks made before the remainder, by one pass with a running character count.

    A boundary met while the chunk is below its minimum is lost, not postponed.
    """
    s, flags = col(sentences), col(flags)
    state = F.struct(
        F.lit(0).alias("start"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("cuts")
    )

    def step(acc: Column, i: Column) -> Column:
        chars = acc["chars"] + F.length(F.get(s, i - 1))
        count = i - acc["start"]
        at_boundary = F.coalesce(F.get(flags, i), F.lit(False))
        full = (count >= max_sentences) | (F.floor(chars / 4) > max_tokens)
        cut = (count >= min_sentences) & (at_boundary | full)
        return F.struct(
            F.when(cut, i).otherwise(acc["start"]).alias("start"),
            F.when(cut, F.lit(0).cast("long")).otherwise(chars).alias("chars"),
            F.when(cut, F.array_append(acc["cuts"], i)).otherwise(acc["cuts"]).alias("cuts"),
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.size(s)), state, step, lambda acc: acc["cuts"])
    return F.when(F.size(s) > 0, folded).otherwise(F.array().cast("array<int>"))


CHUNK_TYPE = (
    "array<struct<text:string,start:int,end:int,idx:array<int>,has_overlap:boolean,overlap_count:int>>"
)


def chunks_from_cuts(sentences, cuts, overlap: int = OVERLAP) -> Column:
    """Chunks between cuts plus the remainder, each later one opened ``overlap`` sentences early."""
    s = col(sentences)

    def build(ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))

        def chunk(start: Column, end: Column) -> Column:
            first = F.when(F.size(ends) > 1, F.greatest(start - overlap, F.lit(0))).otherwise(start)
            if overlap <= 0:
                first = start
            return F.struct(
                F.array_join(F.slice(s, first + 1, end - first), " ").alias("text"),
                first.alias("start"),
                end.alias("end"),
                F.sequence(first, end - 1).alias("idx"),
                (first < start).alias("has_overlap"),
                (start - first).alias("overlap_count"),
            )

        return F.zip_with(starts, ends, chunk)

    n = F.size(s)
    all_ends = _bind(
        col(cuts), lambda c: F.when(F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)) < n, F.array_append(c, n)).otherwise(c)
    )
    return F.when(n > 0, _bind(all_ends, build)).otherwise(F.array()).cast(CHUNK_TYPE)


def semantic_chunks(sentences, vectors, *, threshold: float = SIMILARITY, min_sentences: int = MIN_SENTENCES,
                    max_sentences: int = MAX_SENTENCES, max_tokens: int = MAX_TOKENS,
                    overlap: int = OVERLAP) -> Column:
    """Greedy chunks that prefer to end at semantic boundaries."""
    flags = boundary_flags(vectors, threshold)
    return _bind_chunks(
        sentences, flags, min_sentences=min_sentences, max_sentences=max_sentences, max_tokens=max_tokens,
        overlap=overlap,
    )


def _bind_chunks(sentences, flags: Column, *, min_sentences: int = MIN_SENTENCES, max_sentences: int = MAX_SENTENCES,
                 max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    return _bind(
        flags,
        lambda f: _bind(
            chunk_cuts(sentences, f, min_sentences, max_sentences, max_tokens),
            lambda cuts: chunks_from_cuts(sentences, cuts, overlap),
        ),
    )


def chunk_vectors(chunks, vectors) -> Column:
    """One vector per chunk: the mean of the vectors of all its sentences, overlap included."""
    v = col(vectors)
    return F.transform(
        col(chunks), lambda c: mean_vector(F.slice(v, c["start"] + 1, c["end"] - c["start"]))
    )


def sentence_vectors(sentences, dim: int) -> Column:
    return F.transform(col(sentences), lambda s: hash_embedding(s, dim))


def chunk_documents(docs: DataFrame, text_col: str, *, dim: int, embedder: Embedder | None = None,
                    key: str = "article_id", keep: tuple[str, ...] = (), semantic: bool = True, errors: bool = False) -> DataFrame:
    """Rows ``(key, *keep, chunk_index, text, vector)`` of all documents, see :func:`chunk_stream.stream_chunks`.

    From ten sentences on the cut is semantic and a chunk's vector is the mean of its sentences;
    below that runs of four sentences are cut and embedded as they are. Columns in ``keep`` ride
    along, so that what a chunk needs to know of its article is joined before the cut, to texts
    instead of vectors. Without an embedder the deterministic one is used. A document that the
    embedder fails on is cut into fixed runs; ``errors`` adds a column that says why.
    """
    semantic_from = SEMANTIC_FROM if semantic else 2**31 - 1
    rows = stream_chunks(docs.select(key, *keep, text_col), split_sentences(text_col), embedder or hash_embedder(dim), keep=(key, *keep),
                         semantic_from=semantic_from)
    return rows.select(key, *keep, "chunk_index", "text", "vector", *(["error"] if errors else []))


def dedup_hash(text: str) -> Column:
    """Key under which two texts count as the same, as a hash."""
    # Never null, and stated so: a join then adds no null filter that would compute the key once more.
    return F.coalesce(F.sha2(dedup_key(text), 256), F.lit(""))


def embed_unique(texts: DataFrame, *, request: str, position: str, text: str, dim: int,
                 embedder: Embedder | None = None, out: str = "vector") -> DataFrame:
    """Embed the first text of every dedup key of a request and share its vector with the rest.

    The result has the columns of ``texts`` but the text itself. Keys are shuffled as hashes and the
    texts only once, pre-aggregated, to find the first of each key. The join back has one row per key
    on its right side, so a key repeated very often is split by adaptive execution.
    """
    keyed = texts.withColumn("_key", dedup_hash(text))
    first = keyed.groupBy(request, "_key").agg(F.min_by(text, position).alias("_first"))
    vectors = embed(first, "_first", embedder, out=out, dim=dim).drop("_first")
    return keyed.drop(text).join(vectors, [request, "_key"], "left").drop("_key")


def embed_counts(texts: DataFrame, *, request: str, text: str) -> DataFrame:
    """Per request: how many texts came in and how many had to be embedded."""
    per_key = texts.select(request, dedup_hash(text).alias("_key")).groupBy(request, "_key").agg(
        F.count("*").alias("_n")
    )
    return per_key.groupBy(request).agg(
        F.sum("_n").alias("original_count"), F.count("*").alias("unique_count")
    )
