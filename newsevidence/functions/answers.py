"""Model answers and evidence text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, is_blank, trim_to_null, trim_ws

# Fixed values.
NO_EXPLANATION = "(no explanation)"
_VERDICT_TAG = "verdict:"


def parse_verdict(answer) -> Column:
    """``struct(verdict, explanation, raw)`` from a model answer."""
    answer = col(answer)
    text = trim_ws(answer)
    lines = F.transform(F.split(text, r"\R"), lambda s: F.lower(trim_ws(s)))
    tagged = F.get(F.filter(lines, lambda s: s.startswith(_VERDICT_TAG)), F.lit(0))
    value = trim_ws(F.substring(tagged, len(_VERDICT_TAG) + 1, 2_000_000))
    verdict = F.lit("unclear")
    for word in ("mixed", "false", "true"):
        verdict = F.when(value.startswith(word), F.lit(word)).otherwise(verdict)
    rest = trim_to_null(F.regexp_replace(text, r"(?is)^\s*verdict\s*:[^\n\r]*[\n\r]*", ""))
    return F.struct(
        verdict.alias("verdict"),
        F.coalesce(rest, F.lit(NO_EXPLANATION)).alias("explanation"),
        answer.alias("raw"),
    )


def _labelled(prefix: str, c) -> Column:
    return F.when(~is_blank(c), F.concat(F.lit(prefix), col(c)))


def evidence_line(title="title", source="source_name", published="published_date", bias="bias",
                  factual="factual_reporting", credibility="credibility", text="text",
                  with_bias: bool = False) -> Column:
    """One evidence entry of a prompt; blank parts are left out."""
    labels = [_labelled("factual_reporting=", factual), _labelled("credibility=", credibility)]
    if with_bias:
        labels.insert(0, _labelled("bias=", bias))
    joined = F.concat_ws(", ", *labels)
    return F.concat_ws(
        " | ",
        _labelled("", title),
        _labelled("source=", source),
        F.concat(F.lit("published="), F.date_format(col(published), "yyyy-MM-dd")),
        F.when(joined != "", F.concat(F.lit("MBFC("), joined, F.lit(")"))),
        _labelled("", text),
    )
