"""Checks of chunking, vectors of chunks, and the chunk table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.text import split_sentences
from ..functions.vectors import digest_matrix
from ..operators import chunking as C
from ..operators.search import article_chunks
from ..operators.vector_store import embed_stored
from ..operators.views import article_with_rating, chunk_count_rejects
from ..session import shared_dir
from ..sources import chunks as S
from . import adapters as A
from .registry import check

DIM = 64


def _sentences(spark, d):
    docs = A.load_wide(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", split_sentences("text").alias("s"))


def _cut(spark, d):
    """Chunks of all documents by the operator that takes any embedder, here the deterministic one."""
    return C.stream_chunks(_sentences(spark, d), F.col("s"), C.hash_embedder(DIM), keep=("doc_id",), semantic_from=0)


@check("fixed_chunks", """
    SELECT doc_id, k AS chunk_index, array_to_string(sentences[4 * k + 1 : 4 * k + 4], ' ') AS chunk
    FROM (SELECT doc_id, sentences, unnest(range(0, (len(sentences) + 3) // 4)) AS k FROM t_sentences)
    """, ("t_sentences",))
def fixed_chunks(spark, d):
    return _sentences(spark, d).select("doc_id", F.posexplode(C.fixed_chunks("s")).alias("chunk_index", "chunk"))


@check("boundaries", """
    SELECT doc_id, i - 1 AS boundary FROM t_flags WHERE boundary
    """, ("t_flags",))
def boundaries(spark, d):
    return _cut(spark, d).select("doc_id", F.explode("boundaries").alias("boundary"))


@check("semantic_chunks", """
    SELECT c.doc_id, c.chunk_index, c.first AS start, c.stop AS end_, c.begin - c.first AS overlap_count,
      array_to_string(s.sentences[c.first + 1 : c.stop], ' ') AS text
    FROM t_semantic c JOIN t_sentences s ON s.doc_id = c.doc_id
    """, ("t_semantic", "t_sentences"))
def semantic_chunks(spark, d):
    return _cut(spark, d).select("doc_id", "chunk_index", "start", F.col("end").alias("end_"), "overlap_count", "text")


@check("chunk_vectors", """
    SELECT c.doc_id, c.chunk_index, round(avg(v.v[1]), 6) AS first_value, round(avg(v.v[32]), 6) AS last_value,
      round(avg(list_sum(v.v)), 5) AS total
    FROM t_semantic c JOIN t_sentence_vectors v ON v.doc_id = c.doc_id AND v.i > c.first AND v.i <= c.stop
    GROUP BY c.doc_id, c.chunk_index
    """, ("t_semantic", "t_sentence_vectors"))
def chunk_vectors(spark, d):
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return _cut(spark, d).select("doc_id", "chunk_index", F.round(F.col("vector")[0], 6).alias("first_value"),
                                 F.round(F.col("vector")[31], 6).alias("last_value"), F.round(total, 5).alias("total"))


# A model that takes no short text: documents with one among what it is given fall back to fixed runs.
_TOO_SHORT = 25


def _strict_embedder(texts):
    if any(len(t) < _TOO_SHORT for t in texts):
        raise ValueError("text is too short")
    return digest_matrix(texts, DIM)


@check("chunk_fallbacks", f"""
    SELECT * FROM (WITH runs AS (
      SELECT doc_id, n, k, array_to_string(sentences[4 * k + 1 : 4 * k + 4], ' ') AS text
      FROM (SELECT doc_id, sentences, len(sentences) AS n, unnest(range(0, (len(sentences) + 3) // 4)) AS k FROM t_sentences)),
    failing AS (
      SELECT doc_id FROM t_sentences WHERE len(sentences) >= 10 AND list_min(list_transform(sentences, lambda s: length(s))) < {_TOO_SHORT}
      UNION SELECT doc_id FROM runs WHERE n < 10 AND length(text) < {_TOO_SHORT})
    SELECT c.doc_id, c.chunk_index, array_to_string(s.sentences[c.first + 1 : c.stop], ' ') AS text, TRUE AS semantic, TRUE AS has_vector, FALSE AS failed
    FROM t_semantic c JOIN t_sentences s ON s.doc_id = c.doc_id WHERE len(s.sentences) >= 10 AND c.doc_id NOT IN (SELECT doc_id FROM failing)
    UNION ALL
    SELECT doc_id, k, text, FALSE, length(text) >= {_TOO_SHORT}, doc_id IN (SELECT doc_id FROM failing)
    FROM runs WHERE n < 10 OR doc_id IN (SELECT doc_id FROM failing))
    """, ("t_semantic", "t_sentences"))
def chunk_fallbacks(spark, d):
    """An embedder that fails on short texts: documents with one are cut into fixed runs, all others are as ever."""
    rows = C.stream_chunks(_sentences(spark, d), F.col("s"), _strict_embedder, keep=("doc_id",))
    return rows.select("doc_id", "chunk_index", "text", "semantic", F.col("vector").isNotNull().alias("has_vector"),
                       F.col("error").isNotNull().alias("failed"))


@check("embed_unique", r"""
    SELECT source, doc_id, round(list_sum(list_transform(range(0, 64), lambda j: CAST(
        (strpos('0123456789abcdef', substr(h, 2 * (j % 32) + 1, 1)) - 1) * 16
        + strpos('0123456789abcdef', substr(h, 2 * (j % 32) + 2, 1)) - 1 AS DOUBLE) / 255.0)), 6) AS total
    FROM (SELECT source, doc_id, first_value(sha256(text)) OVER (PARTITION BY source, k ORDER BY doc_id) AS h
          FROM (SELECT source, doc_id, text,
                  trim(regexp_replace(lower(text), '[\s\x{0B}\x{1C}-\x{1F}]+', ' ', 'g')) AS k FROM documents))
    """)
def embed_unique(spark, d):
    """One request per source: duplicates share the vector of the first text of their key."""
    docs = A.load_wide(spark, d, "documents").select("source", "doc_id", "text")
    out = C.embed_unique(docs, request="source", position="doc_id", text="text", dim=DIM)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.select("source", "doc_id", F.round(total, 6).alias("total"))


def _refuses(texts):
    raise RuntimeError("nothing should be embedded again")


@check("vector_store", r"""
    SELECT doc_id, round(list_sum(list_transform(range(0, 64), lambda j: CAST(CAST((
        (strpos('0123456789abcdef', substr(h, 2 * (j % 32) + 1, 1)) - 1) * 16
        + strpos('0123456789abcdef', substr(h, 2 * (j % 32) + 2, 1)) - 1) / 255.0 AS FLOAT) AS DOUBLE))), 5) AS total
    FROM (SELECT doc_id, sha256(coalesce(min(text) FILTER (doc_id % 2 = 0) OVER (PARTITION BY k), min(text) OVER (PARTITION BY k))) AS h
          FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '[\s\x{0B}\x{1C}-\x{1F}]+', ' ', 'g')) AS k FROM documents))
    """)
def vector_store(spark, d):
    """Half of the texts, then all of them, then all of them again, when nothing is left to embed."""
    docs = A.load_wide(spark, d, "documents").select("doc_id", "text")
    run = lambda texts, embedder: embed_stored(texts, folder, text="text", model="digest", embedder=embedder, dim=DIM)
    folder = f"{shared_dir(spark)}/vector_store/{uuid4().hex}"
    run(docs.filter("doc_id % 2 = 0"), C.hash_embedder(DIM))
    run(docs, C.hash_embedder(DIM))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return run(docs, _refuses).select("doc_id", F.round(total, 5).alias("total"))


@check("embed_counts", r"""
    SELECT source, count(*) AS original_count, count(DISTINCT
      trim(regexp_replace(lower(text), '[\s\x{0B}\x{1C}-\x{1F}]+', ' ', 'g'))) AS unique_count
    FROM documents GROUP BY source
    """)
def embed_counts(spark, d):
    docs = A.load(spark, d, "documents").select("source", "text")
    return C.embed_counts(docs, request="source", text="text")


def _chunk_table(spark, d):
    rated = article_with_rating(A.articles(spark, d), A.publishers(spark, d), A.ratings(spark, d))
    texts = S.texts_with_info(A.content(spark, d), rated, F.lit(A.BASE).cast("timestamp"))
    return S.finish_chunk_rows(C.chunk_documents(texts, "extracted_text", dim=DIM, keep=S.INFO_COLUMNS))


@check("chunk_rows", f"""
    SELECT md5('a:' || doc_id || ':c:' || chunk_index) AS id_digest, doc_id AS article_id, chunk_index, text,
      canonical_url AS article_url, p.name AS source_name, {A.trim('r.bias')} AS bias_trimmed,
      strftime(coalesce(a.published_date, TIMESTAMP '{A.BASE}'), '%Y-%m-%d %H:%M:%S') AS published_date
    FROM t_chunk_rows x JOIN t_articles a ON a.id = x.doc_id JOIN t_content ON article_id = x.doc_id
    JOIN t_publishers p ON p.id = a.publisher_id LEFT JOIN t_ratings r ON r.rating_id = p.rating_id
    """.replace(A.trim('r.bias'), f"nullif({A.trim('r.bias')}, '')"),
    ("t_chunk_rows", "t_articles", "t_content", "t_publishers", "t_ratings"))
def chunk_rows(spark, d):
    """Documents to chunk table in one plan: sentences, cut, vectors, ratings, ids."""
    rows = _chunk_table(spark, d)
    name = F.concat(F.lit("a:"), F.col("article_id").cast("string"), F.lit(":c:"), F.col("chunk_index").cast("string"))
    return rows.select(F.md5(name).alias("id_digest"), "article_id", "chunk_index", "text", "article_url", "source_name",
                       F.col("bias").alias("bias_trimmed"), A.stamp("published_date"))


@check("article_chunks", """
    SELECT doc_id AS article_id, k AS chunk_index, sentences[k + 1] AS text
    FROM (SELECT doc_id, sentences, unnest(range(0, least(len(sentences), 40))) AS k FROM t_sentences)
    WHERE trim(sentences[k + 1]) <> ''
    """, ("t_sentences",))
def article_chunks_query(spark, d):
    rows = _sentences(spark, d).select(F.col("doc_id").alias("article_id"), F.posexplode("s").alias("chunk_index", "text"))
    return article_chunks(rows, limit=40)


@check("chunk_count_rejects", """
    SELECT doc_id AS article_id, len(sentences) AS n_chunks, 'too many chunks for embedding' AS reject_reason
    FROM t_sentences WHERE len(sentences) > 100
    """, ("t_sentences",))
def chunk_count_rejects_query(spark, d):
    rows = _sentences(spark, d).select(F.col("doc_id").alias("article_id"), F.explode("s").alias("text"))
    return chunk_count_rejects(rows)


@check("schema_growth", """
    SELECT chunk_id, source_name, CAST(NULL AS VARCHAR) AS bias, CAST(NULL AS VARCHAR) AS factual_reporting,
      CAST(NULL AS VARCHAR) AS credibility FROM t_chunks
    """, ("t_chunks",))
def schema_growth(spark, d):
    stored = A.vector_chunks(spark, d).select("chunk_id", "source_name")
    return S.grow_schema(stored)


@check("chunk_upsert", """
    SELECT vec_id AS chunk_id, CASE WHEN label < 5 THEN 'fresh ' || vec_id ELSE 'chunk ' || vec_id END AS text
    FROM embeddings
    UNION ALL SELECT vec_id + 1000000, 'fresh ' || vec_id FROM embeddings WHERE label >= 5
    """)
def chunk_upsert(spark, d):
    stored = A.vector_chunks(spark, d).select("chunk_id", "text")
    fresh = A.load(spark, d, "embeddings").selectExpr(
        "if(label < 5, vec_id, vec_id + 1000000) as chunk_id", "concat('fresh ', vec_id) as text"
    )
    return S.write_chunks(stored, fresh).select("chunk_id", "text")


@check("manual_rows", """
    SELECT 'manual-' || vec_id AS chunk_id, CASE WHEN label = 1 THEN 'manual' ELSE 'desk' END AS source_name,
      0 AS article_id, '' AS article_url, 0 AS chunk_index
    FROM embeddings WHERE label <> 2
    """)
def manual_rows(spark, d):
    notes = A.load(spark, d, "embeddings").selectExpr(
        "vec_id as note_id", "'Note' as title", "concat('text ', vec_id) as text",
        "if(label = 1, ' ', 'desk') as source", "if(label = 2, array(), embedding) as vector",
    )
    rows, _ = S.manual_rows(notes)
    return rows.select("chunk_id", "source_name", "article_id", "article_url", "chunk_index")
