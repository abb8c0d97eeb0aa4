"""Evidence as the model and the reader see it: prompts and grouped views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import evidence_line
from ..functions.text import is_blank, trim_ws

# Thresholds of the grouped view and separators of the prompt.
GROUP_FROM = 3
TOGGLE_CHARS = 260
EVIDENCE_SEPARATOR = "\n\n---\n\n"
NO_EVIDENCE = "(no evidence found)"
NO_STORED_EXPLANATION = "(no explanation stored)"
DEFAULT_VERDICT = "unclear"
KINDS = ("verdict", "bias", "followup")


def group_key(article_id="article_id", url="article_url", title="title", source="source_name",
              published="published_date") -> Column:
    """Article id, else URL, else title with source and date."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    described = F.concat(
        F.lit("title:"), text(title), F.lit("|source:"), text(source), F.lit("|published:"),
        F.coalesce(F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
    )
    return (
        F.when(F.col(article_id).isNotNull(), F.concat(F.lit("id:"), F.col(article_id).cast("string")))
        .when(~is_blank(url), F.concat(F.lit("url:"), F.col(url)))
        .otherwise(described)
    )


def evidence_groups(hits: DataFrame, claim: str = "claim_id", rank: str = "rank") -> DataFrame:
    """Views of the evidence of every claim, in first-hit order.

    Three or more chunks of one article become one row with an array of chunks; fewer stay single
    rows. The hits of a claim are at most k, which bounds the arrays.
    """
    keyed = hits.withColumn("group_key", group_key())
    shown = trim_ws(F.coalesce("text", F.lit("")))
    entry = F.struct(
        F.col(rank).alias("rank"), shown.alias("content"), (F.length(shown) > TOGGLE_CHARS).alias("show_toggle"),
        "title", "source_name", "published_date", "article_url",
    )
    groups = keyed.groupBy(claim, "group_key").agg(
        F.array_sort(F.collect_list(entry)).alias("e"), F.min(rank).alias("first_rank")
    )
    grouped = F.size("e") >= GROUP_FROM
    parts = F.when(grouped, F.array(F.col("e"))).otherwise(F.transform("e", lambda x: F.array(x)))
    rows = groups.select(claim, "group_key", "first_rank", grouped.alias("grouped"), F.posexplode(parts).alias("part", "c"))
    return rows.select(
        claim, "group_key", "first_rank", "part", "grouped",
        F.size("c").alias("chunk_count"),
        F.col("c")[0]["title"].alias("title"),
        F.col("c")[0]["source_name"].alias("source_name"),
        F.col("c")[0]["published_date"].alias("published_date"),
        F.col("c")[0]["article_url"].alias("article_url"),
        F.transform("c", lambda x: F.struct(x["content"].alias("content"), x["show_toggle"].alias("show_toggle"))).alias(
            "chunks"
        ),
    )


def evidence_text(hits: DataFrame, claim: str = "claim_id", rank: str = "rank", with_bias: bool = False) -> DataFrame:
    """Evidence block per claim: its lines in hit order."""
    lines = hits.select(claim, rank, evidence_line(with_bias=with_bias).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct(rank, "line")))
    joined = F.array_join(F.transform(ordered, lambda r: r["line"]), EVIDENCE_SEPARATOR)
    return lines.groupBy(claim).agg(joined.alias("evidence"))


def fill_template(template: Column, slots: dict[str, Column]) -> Column:
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def prompt_table(claims: DataFrame, hits: DataFrame, template: str, kind: str = "verdict",
                 today: Column | None = None) -> DataFrame:
    """``(claim_id, prompt)`` for all claims; the template is the caller's text with ``{{SLOTS}}``.

    Slots: CLAIM, EVIDENCE; TODAY for verdicts; VERDICT for bias and follow-ups; EXPLANATION and
    FOLLOWUP_QUESTION for follow-ups. Bias labels of sources appear in bias prompts only.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown prompt kind {kind}")
    blocks = evidence_text(hits, with_bias=kind == "bias")
    joined = claims.join(blocks, "claim_id", "left")
    slots = {
        "CLAIM": F.col("claim_text"),
        "EVIDENCE": F.coalesce("evidence", F.lit(NO_EVIDENCE)),
    }
    if kind == "verdict":
        slots["TODAY"] = F.date_format(F.current_date() if today is None else today, "yyyy-MM-dd")
    else:
        slots["VERDICT"] = F.coalesce("verdict", F.lit(DEFAULT_VERDICT))
    if kind == "followup":
        slots["EXPLANATION"] = F.coalesce("explanation", F.lit(NO_STORED_EXPLANATION))
        slots["FOLLOWUP_QUESTION"] = F.col("question")
    return joined.select("claim_id", fill_template(F.lit(template), slots).alias("prompt"))
