"""Claims to prompts, and landed answers to stored verdicts, for whole claim tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import parse_verdict
from ..functions.text import trim_ws
from ..functions.vectors import Embedder, embed
from ..operators.evidence import prompt_table
from ..operators.keyed import upsert
from ..operators.search import MAX_DISTANCE, TOP_K, evidence_search
from ..operators.views import claim_reject_reason, split_rejects
from ..session import shared_dir
from ..sources.responses import model_text
from ..sources.tables import stage
from . import templates


def claim_evidence(claims: DataFrame, chunks: DataFrame, *, dim: int, embedder: Embedder | None = None,
                   k: int = TOP_K, max_distance: float = MAX_DISTANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(valid claims, their evidence, rejected claims) from ``claims(claim_id, claim_text)``."""
    trimmed = claims.withColumn("claim_text", trim_ws("claim_text"))
    good, bad = split_rejects(trimmed, claim_reject_reason("claim_text"))
    # Staged: the search reads the vectors more than once, the embedder runs once.
    vectors = embed(good.select("claim_id", "claim_text"), "claim_text", embedder, dim=dim).select("claim_id", "vector")
    vectors = stage(vectors, f"{shared_dir(claims.sparkSession)}/claim_vectors/{uuid4().hex}", "vectors")
    found = evidence_search(vectors.select("claim_id", "vector"), chunks, k, max_distance)
    return good, found.withColumnRenamed("article_title", "title"), bad


def verdict_prompts(claims: DataFrame, evidence: DataFrame, today: Column | None = None,
                    template: str = templates.VERDICT) -> DataFrame:
    return prompt_table(claims, evidence, template, "verdict", today)


def store_answers(claim_log: DataFrame, responses: DataFrame, now: Column | None = None) -> DataFrame:
    """Claim log after landed model responses ``(id, body)``: answer, verdict, explanation."""
    parsed = model_text(responses).select("id", "answer", parse_verdict("answer").alias("p")).select(
        "id",
        F.col("answer").alias("model_answer"),
        F.col("p.verdict").alias("verdict"),
        F.col("p.explanation").alias("explanation"),
    )
    known = parsed.join(claim_log.select("id"), "id", "left_semi")
    return upsert(claim_log, known, ["id"], "replace", now=now)
