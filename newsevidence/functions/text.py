"""Text scalars. All of them are native expressions, save the NFKC step of :func:`dedup_key`."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits and separators that results depend on.
SNIPPET_LIMIT = 400
MIN_SENTENCE_CHARS = 3
MIN_PARAGRAPH_CHARS = 40
MIN_ARTICLE_PARAGRAPHS = 5
MIN_ARTICLE_CHARS = 1500
MIN_LETTER_SHARE = 0.5
LOW_QUALITY = "Low-quality extraction (likely boilerplate or dynamic page)"

# Characters up to and including the blank: what a plain trim removes on both ends.
_BLANKS = "".join(chr(i) for i in range(33))
_MARK = "\u001e"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(col(c), F.lit(_BLANKS))


def trim_to_null(c) -> Column:
    return F.nullif(trim_ws(c), F.lit(""))


def is_blank(c) -> Column:
    """True for null, empty and whitespace-only text."""
    return trim_to_null(c).isNull()


def lower_or(c, default: str | None = None) -> Column:
    return F.coalesce(F.lower(trim_to_null(c)), F.lit(default))


def upper_or(c, default: str | None = None) -> Column:
    return F.coalesce(F.upper(trim_to_null(c)), F.lit(default))


def collapse_ws(c) -> Column:
    """Runs of Unicode whitespace become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def clean_text(c) -> Column:
    """Control characters become blanks, whitespace collapses, ends are stripped."""
    return collapse_ws(F.regexp_replace(col(c), r"[\x00-\x1F\x7F-\x9F]", " "))


def split_sentences(c) -> Column:
    """Array of trimmed sentences; a boundary is ``.``, ``!`` or ``?`` followed by whitespace."""
    marked = F.regexp_replace(clean_text(c), r"([.!?])\s+", "$1" + _MARK)
    parts = F.transform(F.split(marked, _MARK), lambda s: F.trim(s))
    return F.coalesce(
        F.filter(parts, lambda s: F.length(s) >= MIN_SENTENCE_CHARS),
        F.array().cast("array<string>"),
    )


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def dedup_key(c) -> Column:
    """Key under which two texts count as the same: NFKC, lower case, single blanks.

    Only non-ASCII text is handed to Python; NFKC leaves ASCII untouched.
    """
    text = col(c)
    plain = F.length(text) == F.octet_length(text)
    normal = F.coalesce(_nfkc(F.when(~plain, text)), text, F.lit(""))
    # Python's whitespace class also holds U+001C..U+001F, the Java one does not.
    return F.trim(F.regexp_replace(F.lower(normal), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_label(c) -> Column:
    """Rating label with ``_ - /`` as blanks, lower case, single blanks."""
    spaced = trim_ws(F.translate(F.lower(col(c)), "_-/", "   "))
    return F.regexp_replace(spaced, r"\s+", " ")


def estimate_tokens(sentences) -> Column:
    """Sum of sentence lengths, integer-divided by four."""
    chars = F.aggregate(col(sentences), F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))
    return F.floor(chars / 4)


def snippet(c, limit: int = SNIPPET_LIMIT) -> Column:
    text = trim_to_null(c)
    cut = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def keep_paragraphs(paragraphs, min_chars: int = MIN_PARAGRAPH_CHARS) -> Column:
    """Trimmed paragraphs of at least ``min_chars``, exact repeats dropped, first one kept."""
    trimmed = F.transform(col(paragraphs), trim_ws)
    return F.array_distinct(F.filter(trimmed, lambda p: F.length(p) >= min_chars))


def join_paragraphs(paragraphs) -> Column:
    return F.array_join(col(paragraphs), "\n\n")


def passes_quality(
    text,
    n_paragraphs,
    min_paragraphs: int = MIN_ARTICLE_PARAGRAPHS,
    min_chars: int = MIN_ARTICLE_CHARS,
) -> Column:
    text = col(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    ok = (
        (col(n_paragraphs) >= min_paragraphs)
        & (F.length(text) >= min_chars)
        & (letters > F.length(text) * MIN_LETTER_SHARE)
    )
    return F.coalesce(ok, F.lit(False))


def parse_iso_utc(c) -> Column:
    """ISO-8601 instant to a timestamp; blank or malformed text gives null."""
    text = trim_to_null(c)
    instant = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)$"
    return F.when(text.rlike(instant), F.try_to_timestamp(text))
