"""Checks of the nearest-evidence search, its filters, and evidence views."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.answers import evidence_line
from ..operators import evidence as E
from ..operators import search as S
from ..operators.signatures import approximate_search, build_signatures, recall_report
from ..session import shared_dir
from ..sources import responses as R
from . import adapters as A
from .registry import check

# The supplied vectors lie far apart: the default limit of 0.5 would leave little but self matches.
MAX_DISTANCE = 0.68

_NEAREST = f"""
    SELECT claim_id, chunk_id, distance, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY distance, chunk_id) AS rank FROM {{pairs}})
    WHERE rank <= {{k}} AND distance <= CAST({{limit}} AS FLOAT)"""
GOOD_SOURCE = (
    f"NOT (coalesce(regexp_matches({A.norm('bias')}, 'questionable|conspiracy|pseudoscience|satire'), FALSE)"
    f" OR coalesce({A.norm('factual_reporting')} IN ('very low', 'low'), FALSE))"
)


@check("evidence_search", f"""
    SELECT n.claim_id, n.chunk_id, n.rank, round(CAST(n.distance AS DOUBLE), 6) AS distance, c.source_name
    FROM ({_NEAREST.format(pairs='t_pairs', k=5, limit=MAX_DISTANCE)}) n JOIN t_chunks c ON c.chunk_id = n.chunk_id
    WHERE {GOOD_SOURCE}
    """, ("t_pairs", "t_chunks"))
def evidence_search(spark, d):
    """Flagship: for every vector as a claim its nearest chunks within the limit, bad sources dropped."""
    found = S.evidence_search(A.vector_claims(spark, d), A.vector_chunks(spark, d), 5, MAX_DISTANCE)
    return found.select("claim_id", "chunk_id", "rank", F.round(F.col("distance").cast("double"), 6).alias("distance"),
                        "source_name")


@check("evidence_search_cells", f"""
    SELECT claim_id, chunk_id, rank, round(CAST(distance AS DOUBLE), 6) AS distance
    FROM ({_NEAREST.format(pairs='t_pairs', k=5, limit=MAX_DISTANCE)})
    """, ("t_pairs",))
def evidence_search_cells(spark, d):
    """The same search on the path for claim tables too large to broadcast."""
    found = S.nearest_chunks(A.vector_claims(spark, d), A.vector_chunks(spark, d), 5, MAX_DISTANCE, broadcast_bytes=1)
    return found.select("claim_id", "chunk_id", "rank", F.round(F.col("distance").cast("double"), 6).alias("distance"))


# The supplied vectors, every third one again, and some that nothing can be compared with.
_ODD_CHUNKS = f"""
    SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    UNION ALL SELECT vec_id + 1000000, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 3 = 0
    UNION ALL SELECT vec_id + 2000000, list_transform(range(0, 64), lambda j: 0.0) FROM embeddings WHERE vec_id % 50 = 0"""


def _odd_chunks(spark, d):
    v = A.vector_chunks(spark, d).select("chunk_id", "vector", "source_name")
    again = v.where("chunk_id % 3 = 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000)
    zero = v.where("chunk_id % 50 = 0").select(F.col("chunk_id") + 2_000_000, F.expr("array_repeat(0F, 64)"), "source_name")
    none = v.where("chunk_id % 10 = 0").select(F.col("chunk_id") + 3_000_000, F.expr("""
        case chunk_id % 40 when 0 then null when 10 then array() when 20 then slice(vector, 1, 63)
        else transform(vector, (x, i) -> if(i = 5, if(chunk_id % 80 = 30, null, float('nan')), x)) end"""), "source_name")
    return v.unionByName(again).union(zero).union(none)


@check("evidence_search_stored", f"""
    SELECT claim_id, chunk_id, rank, round(CAST(distance AS DOUBLE), 6) AS distance, 'src' || e.label AS source_name
    FROM ({_NEAREST.format(pairs=f"""(
        SELECT q.vec_id AS claim_id, c.chunk_id, CAST(1 - coalesce(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), c.v), 0) AS FLOAT) AS distance
        FROM embeddings q, ({_ODD_CHUNKS}) c WHERE c.chunk_id < 2000000)""", k=5, limit=MAX_DISTANCE)}) n
    JOIN embeddings e ON e.vec_id = n.chunk_id % 1000000
    """)
def evidence_search_stored(spark, d):
    """Search over a layout stored by cell: copies, zero vectors, and vectors that can't be used among the chunks."""
    folder = f"{shared_dir(spark)}/stored_cells/{uuid4().hex}"
    cells = S.build_cells(_odd_chunks(spark, d), folder, cell_rows=50)
    hits = S.search_cells(A.vector_claims(spark, d), cells, 5, MAX_DISTANCE, f"{folder}/run")
    return S.with_cell_columns(hits, cells).select(
        "claim_id", "chunk_id", "rank", F.round(F.col("distance").cast("double"), 6).alias("distance"), "source_name")


def _approx_recall(spark, claims, chunks):
    """Recall of the approximate form against the exact one."""
    folder = f"{shared_dir(spark)}/signatures/{uuid4().hex}"
    index = build_signatures(chunks, folder, similarity=0.5, recall=0.97)
    found = approximate_search(claims, index, 5, 0.5, f"{folder}/run")
    exact = S.nearest_chunks(claims, chunks, 5, 0.5)
    return recall_report(exact, found).select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


_EXACT_COUNT = f"""
    SELECT count(*) AS n_exact, TRUE AS recall_reached FROM ({_NEAREST.format(pairs='t_pairs', k=5, limit=0.5)})
    """


@check("approximate_search", _EXACT_COUNT, ("t_pairs",))
def approximate_search_64(spark, d):
    return _approx_recall(spark, A.vector_claims(spark, d), A.vector_chunks(spark, d))


@check("approximate_search_3072", _EXACT_COUNT, ("t_pairs",))
def approximate_search_3072(spark, d):
    """The same angles at the size of a real model's vectors."""
    wide = F.flatten(F.array_repeat("vector", 48)).alias("vector")
    return _approx_recall(spark, A.vector_claims(spark, d).select("claim_id", wide), A.vector_chunks(spark, d).select("chunk_id", wide))


@check("chunk_vector_rejects", """
    SELECT vec_id + 3000000 AS chunk_id, CASE vec_id % 40 WHEN 0 THEN 'vector is missing' WHEN 10 THEN 'vector is empty'
      WHEN 20 THEN 'vector has 63 numbers, not 64' ELSE CASE WHEN vec_id % 80 = 30 THEN 'vector has missing numbers'
      ELSE 'vector has numbers that are not finite' END END AS reject_reason
    FROM embeddings WHERE vec_id % 10 = 0
    """)
def chunk_vector_rejects(spark, d):
    return S.chunk_vector_rejects(_odd_chunks(spark, d), 64)


@check("filtered_search", f"""
    SELECT claim_id, n.chunk_id, rank, round(CAST(CAST(1 AS FLOAT) - distance AS DOUBLE), 5) AS score
    FROM ({_NEAREST.format(pairs='''(SELECT p.* FROM t_pairs p JOIN t_chunks c ON c.chunk_id = p.chunk_id
        WHERE c.source_name IN ('src1', 'src2', 'src5') AND c.published_date >= TIMESTAMP '2024-01-02'
          AND c.published_date <= TIMESTAMP '2024-02-01')''', k=10, limit=2)}) n
    WHERE CAST(1 AS FLOAT) - distance >= CAST(0.3 AS FLOAT)
    """, ("t_pairs", "t_chunks"))
def filtered_search(spark, d):
    found = S.search(
        A.vector_claims(spark, d), A.vector_chunks(spark, d), 10, 0.3, source_names=["src1", "src2", "src5"],
        published_after="2024-01-02", published_before="2024-02-01",
    )
    return found.select("claim_id", "chunk_id", "rank", F.round(F.col("score").cast("double"), 5).alias("score"))


@check("good_sources", f"""
    SELECT claim_id, rank FROM t_hits WHERE {GOOD_SOURCE}
      AND NOT coalesce({A.norm('credibility')} IN ('very low', 'low'), FALSE)
    """, ("t_hits",))
def good_sources(spark, d):
    return S.drop_bad_sources(A.hits(spark, d)).select("claim_id", "rank")


@check("hit_threshold", """
    SELECT claim_id, rank, round(CAST(CAST(1 AS FLOAT) - CAST(distance AS FLOAT) AS DOUBLE), 5) AS score FROM t_hits
    WHERE CAST(1 AS FLOAT) - CAST(distance AS FLOAT) >= CAST(0.7 AS FLOAT)
    """, ("t_hits",))
def hit_threshold(spark, d):
    kept = S.with_min_score(A.hits(spark, d))
    return kept.select("claim_id", "rank", F.round(F.col("score").cast("double"), 5).alias("score"))


@check("hit_distance", """
    SELECT claim_id, rank FROM t_hits WHERE CAST(distance AS FLOAT) <= CAST(0.5 AS FLOAT)
    """, ("t_hits",))
def hit_distance(spark, d):
    return S.within_distance(A.hits(spark, d)).select("claim_id", "rank")


def evidence_sql(with_bias: bool) -> str:
    label = lambda name, c: f"CASE WHEN trim({c}) <> '' THEN '{name}=' || {c} END"
    parts = [label("factual_reporting", "factual_reporting"), label("credibility", "credibility")]
    if with_bias:
        parts.insert(0, label("bias", "bias"))
    labels = f"concat_ws(', ', {', '.join(parts)})"
    return f"""concat_ws(' | ', CASE WHEN trim(title) <> '' THEN title END,
        CASE WHEN trim(source_name) <> '' THEN 'source=' || source_name END,
        'published=' || strftime(published_date, '%Y-%m-%d'),
        CASE WHEN {labels} <> '' THEN 'MBFC(' || {labels} || ')' END, CASE WHEN {A.trim('text')} <> '' THEN text END)"""


@check("evidence_lines", f"""
    SELECT claim_id, rank, {evidence_sql(False)} AS line, {evidence_sql(True)} AS bias_line FROM t_hits
    """, ("t_hits",))
def evidence_lines(spark, d):
    return A.hits(spark, d).select("claim_id", "rank", evidence_line().alias("line"),
                                   evidence_line(with_bias=True).alias("bias_line"))


@check("evidence_groups", f"""
    WITH keyed AS (
      SELECT *, CASE WHEN article_id IS NOT NULL THEN 'id:' || article_id
        WHEN trim(article_url) <> '' THEN 'url:' || article_url
        ELSE 'title:' || coalesce(title, '') || '|source:' || coalesce(source_name, '') || '|published:'
          || coalesce(strftime(published_date, '%Y-%m-%dT%H:%M:%S'), '') END AS group_key,
        {A.trim('text')} AS content
      FROM t_hits
    ), sized AS (
      SELECT *, count(*) OVER (PARTITION BY claim_id, group_key) AS n,
        min(rank) OVER (PARTITION BY claim_id, group_key) AS first_rank,
        row_number() OVER (PARTITION BY claim_id, group_key ORDER BY rank) - 1 AS at_
      FROM keyed
    )
    SELECT claim_id, group_key, first_rank, CASE WHEN n >= 3 THEN 0 ELSE at_ END AS part, n >= 3 AS "grouped",
      count(*) AS chunk_count, arg_min(title, rank) AS title,
      string_agg(CASE WHEN length(content) > 260 THEN '+' ELSE '-' END, '' ORDER BY rank) AS toggles,
      md5(string_agg(content, '|' ORDER BY rank)) AS content_digest
    FROM sized GROUP BY claim_id, group_key, first_rank, CASE WHEN n >= 3 THEN 0 ELSE at_ END, n >= 3
    """.replace("WITH keyed", "SELECT * FROM (WITH keyed", 1) + ")", ("t_hits",))
def evidence_groups(spark, d):
    views = E.evidence_groups(A.hits(spark, d))
    toggles = F.array_join(F.transform("chunks", lambda c: F.when(c["show_toggle"], F.lit("+")).otherwise("-")), "")
    digest = F.md5(F.array_join(F.transform("chunks", lambda c: c["content"]), "|"))
    return views.select("claim_id", "group_key", "first_rank", "part", "grouped", "chunk_count", "title",
                        toggles.alias("toggles"), digest.alias("content_digest"))


TEMPLATE = "Claim: {{CLAIM}}\nDay: {{TODAY}}\nFound:\n{{EVIDENCE}}\n"


@check("prompts", f"""
    SELECT c.claim_id, 'Claim: ' || c.claim_text || chr(10) || 'Day: 2024-06-01' || chr(10) || 'Found:' || chr(10)
      || coalesce(e.evidence, '(no evidence found)') || chr(10) AS prompt
    FROM t_claims c LEFT JOIN (
      SELECT claim_id, string_agg({evidence_sql(False)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence
      FROM t_hits WHERE {GOOD_SOURCE} GROUP BY claim_id) e ON e.claim_id = c.claim_id
    """, ("t_claims", "t_hits"))
def prompts(spark, d):
    hits = A.hits(spark, d).filter(~S.is_bad_source(credibility="factual_reporting"))
    return E.prompt_table(A.claims(spark, d), hits, TEMPLATE, "verdict", F.lit("2024-06-01").cast("date"))


@check("bias_prompts", f"""
    SELECT c.claim_id, c.claim_text || ' / ' || coalesce(c.verdict, 'unclear') || chr(10)
      || coalesce(e.evidence, '(no evidence found)') AS prompt
    FROM t_claims c LEFT JOIN (
      SELECT claim_id, string_agg({evidence_sql(True)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence
      FROM t_hits GROUP BY claim_id) e ON e.claim_id = c.claim_id
    """, ("t_claims", "t_hits"))
def bias_prompts(spark, d):
    return E.prompt_table(A.claims(spark, d), A.hits(spark, d), "{{CLAIM}} / {{VERDICT}}\n{{EVIDENCE}}", "bias")


@check("followup_prompts", f"""
    SELECT c.claim_id, c.claim_text || ' / ' || coalesce(c.verdict, 'unclear') || ' / '
      || coalesce(c.explanation, '(no explanation stored)') || ' / why?' || chr(10)
      || coalesce(e.evidence, '(no evidence found)') AS prompt
    FROM t_claims c LEFT JOIN (
      SELECT claim_id, string_agg({evidence_sql(False)}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence
      FROM t_hits GROUP BY claim_id) e ON e.claim_id = c.claim_id
    """, ("t_claims", "t_hits"))
def followup_prompts(spark, d):
    asked = A.claims(spark, d).withColumn("question", F.lit("why?"))
    template = "{{CLAIM}} / {{VERDICT}} / {{EXPLANATION}} / {{FOLLOWUP_QUESTION}}\n{{EVIDENCE}}"
    return E.prompt_table(asked, A.hits(spark, d), template, "followup")


def _responses(spark, d):
    """The hits of a claim as the JSON a vector store would have answered."""
    hits = A.hits(spark, d)
    iso = F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one = F.struct(
        F.col("rank"),
        F.struct(
            F.when(F.col("rank") != 1, F.col("text")).alias("text"),
            F.col("title").alias("articleTitle"),
            F.col("source_name").alias("sourceName"),
            F.when(F.col("rank") == 2, F.lit(0).cast("long")).otherwise(F.col("article_id")).alias("articleId"),
            F.when(F.col("rank") == 3, F.lit(" ")).otherwise(F.col("article_url")).alias("articleUrl"),
            F.when(F.col("rank") == 4, F.lit("someday")).otherwise(iso).alias("publishedDate"),
            F.col("rank").alias("chunkIndex"),
            F.col("bias").alias("mbfcBias"),
            F.struct(F.when(F.col("rank") != 0, F.col("distance")).alias("distance")).alias("_additional"),
        ).alias("h"),
    )
    packed = hits.groupBy(F.col("claim_id").alias("query_id")).agg(F.array_sort(F.collect_list(one)).alias("l"))
    body = F.to_json(F.struct(
        F.when(F.col("query_id") % 7 == 3, F.array(F.lit("failed"))).alias("errors"),
        F.struct(F.struct(F.transform("l", lambda x: x["h"]).alias("ArticleChunk")).alias("Get")).alias("data"),
    ))
    return packed.select("query_id", body.alias("json"))


@check("hits_parse", f"""
    SELECT claim_id AS query_id, rank, CASE WHEN rank = 0 THEN 1.0 ELSE round(distance, 4) END AS distance,
      CASE WHEN rank <> 2 AND article_id > 0 THEN article_id END AS article_id,
      CASE WHEN rank <> 3 THEN article_url END AS article_url, title, CASE WHEN rank = 1 THEN '' ELSE text END AS text,
      nullif(trim(bias), '') AS bias, CASE WHEN rank <> 4 THEN strftime(published_date, '%Y-%m-%d %H:%M:%S') END AS published_date
    FROM t_hits WHERE claim_id % 7 <> 3
    """, ("t_hits",))
def hits_parse(spark, d):
    parsed = R.parse_hits(_responses(spark, d))
    return parsed.select("query_id", "rank", F.round(F.col("distance").cast("double"), 4).alias("distance"), "article_id",
                         "article_url", "title", "text", "bias", A.stamp("published_date"))


@check("hit_rejects", "SELECT DISTINCT claim_id AS query_id FROM t_hits WHERE claim_id % 7 = 3", ("t_hits",))
def hit_rejects(spark, d):
    return R.hit_rejects(_responses(spark, d)).select("query_id")


@check("model_text", """
    SELECT id, CASE WHEN id % 3 = 0 THEN 'No text field found in AI response: {"candidates":[]}' ELSE text END AS answer
    FROM (SELECT conv_id * 1000 + turn AS id, text FROM conversations)
    """)
def model_text(spark, d):
    turns = A.load(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "text")
    part = F.struct(F.col("text"))
    full = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part).alias("parts")).alias("content"))).alias("candidates")))
    bodies = turns.select("id", F.when(F.col("id") % 3 == 0, F.lit('{"candidates":[]}')).otherwise(full).alias("body"))
    return R.model_text(bodies).select("id", "answer")


@check("model_vectors", """
    SELECT vec_id, CASE WHEN label = 0 THEN NULL ELSE round(CAST(embedding[3] AS DOUBLE), 5) END AS third,
      CASE WHEN label = 0 THEN 'no embedding values' END AS reject_reason FROM embeddings
    """)
def model_vectors(spark, d):
    e = A.load(spark, d, "embeddings")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("embedding").alias("values")).alias("embeddings"))).alias(
        "predictions")))
    bodies = e.select("vec_id", F.when(F.col("label") == 0, F.lit('{"predictions":[]}')).otherwise(body).alias("body"))
    out = R.model_vector(bodies)
    third = F.round(F.get("vector", F.lit(2)).cast("double"), 5)
    return out.select("vec_id", third.alias("third"), "reject_reason")
