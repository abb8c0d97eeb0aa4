"""Short-circuit cascade of quality rules, built from DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS

#: Rows of the sample, on average, that sets the order of the rules. The order never changes a verdict.
SAMPLE_ROWS = 500

#: Letters of scripts that put no spaces between words. Where they are half of a text, words may be of any length.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]+"


Measures = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """``test`` is true for a bad document, ``work`` tells how many steps it takes to find out.

    Both are given the text (never null) as ``text``, counts by name, and may use any that follow from what the rule
    ``needs``: the ``words`` of a text, its ``lines`` with a word, or both.
    """

    name: str
    test: Callable[[Measures], Column]
    work: Callable[[Measures], Column]
    needs: tuple[str, ...] = ("words", "lines")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often it is used, lambdas included."""
    return F.get(F.transform(F.array(value), body), 0)


def _words_in_repeats(w: Column, width: int = 3) -> Column:
    """Words of ``w`` in windows of ``width`` that occur twice or more.

    Windows are hashed and sorted with their places: equal ones become neighbours, and the places found, sorted
    again, tell how many words they cover. The work is n log n for any number of repeats.
    """
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(
        F.xxhash64(*[F.get(w, i + j) for j in range(width)]).alias("k"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["k"] == x["k"], F.lit(False))
        hits = F.filter(s, lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(F.lit(False)) | same(x, i + 1))
        places = F.array_sort(F.transform(hits, lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + p + width - F.greatest(a["end"], p)).alias("n"), (p + width).alias("end")),
            lambda a: a["n"])

    return F.when(F.size(w) > width, _let(F.sort_array(keys), covered)).otherwise(F.lit(0))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)


def _counts(text: Column, parts: Mapping[str, Column]) -> dict[str, Column]:
    """Every count that follows from the text and the ``parts`` given, as an expression that nothing has computed yet."""
    out = {
        "text": text,
        "word_chars": F.length(F.translate(text, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
    }
    if "words" in parts:
        out |= {"n_words": F.size(parts["words"]).cast("long"), "n_repeat_words": _words_in_repeats(parts["words"]).cast("long")}
    if "lines" in parts:
        x = parts["lines"]
        out |= {"n_lines": F.size(x).cast("long"), "n_dup_lines": (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_bullets": F.size(F.filter(x, lambda y: y.rlike(r"^[ \t]*[-*•]"))).cast("long")}
    return out


_PARTS = {"words": lambda: words(F.col("text")), "lines": lambda: _lines(F.coalesce(F.col("text"), F.lit("")))}


def measured(docs: DataFrame) -> DataFrame:
    """Add the counts that rules use; see :func:`quality_cascade` for their meaning."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counted(part: str, x: Column) -> Column:
        own = {n: c for n, c in _counts(text, {part: x}).items() if n not in _counts(text, {})}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    every = docs.withColumn("_words", _let(_PARTS["words"](), lambda x: counted("words", x)))
    every = every.withColumn("_lines", _let(_PARTS["lines"](), lambda x: counted("lines", x)))
    rest = [c.alias(n) for n, c in _counts(text, {}).items() if n != "text"]
    return every.select(*docs.columns, *rest, "_words.*", "_lines.*")


def default_rules() -> list[Rule]:
    """Published web-text heuristics (word count, word length, symbols, repeated lines and windows, bullets).

    Work is counted in characters looked at; sorting the windows of a text takes n log n steps of some 40 characters each.
    """
    chars = lambda times: lambda m: F.length(m["text"]) * times
    long_words = lambda m: F.when(m["word_chars"] > m["n_words"] * 20, F.length(F.regexp_replace(m["text"], _UNSPACED, "")) * 2 > F.length(m["text"])).otherwise(F.lit(False))
    return [
        Rule("too_few_words", lambda m: m["n_words"] < 50, lambda m: F.lit(1), ("words",)),
        Rule("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50, lambda m: 40 * m["n_words"] * F.log2(m["n_words"] + 2), ("words",)),
        Rule("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | long_words(m), chars(1), ("words",)),
        Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"], chars(1), ("words",)),
        Rule("repeated_lines", lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 3, chars(4), ("lines",)),
        Rule("no_letters", lambda m: F.length(F.regexp_replace(m["text"], r"\P{L}+", "")) * 2 < m["word_chars"], chars(6), ()),
        Rule("bullets", lambda m: m["n_bullets"] * 10 > m["n_lines"] * 9, chars(5), ("lines",)),
    ]


#: What fails the base rules is not kept, whatever the rules of a cascade are.
_BASE = ("too_few_words", "repeated_windows")


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, best first, with the rejected share and the mean work that the sample has of each.

    The sample are the rows whose hash (of id and text) falls below a limit, so it is the same in each run and however rows are dealt;
    it is measured where it lies, and only a number per rule comes to the driver. Rules that never reject come last, the
    cheapest first; ties by name.
    """
    if not rules:
        return []
    total = docs.count()
    limit = int(min(1.0, sample_rows / max(total, 1)) * (1 << 31))
    key = [c for c in ("doc_id", "text") if c in docs.columns]  # copies of a text are drawn one by one
    sample = measured(docs.where(F.pmod(F.xxhash64(*key), F.lit(1 << 31)) < limit).select("text")).withColumn("text", F.coalesce("text", F.lit("")))
    m = {n: F.col(n) for n in sample.columns}
    found = sample.agg(*[F.avg(F.coalesce(r.test(m), F.lit(False)).cast("double")).alias(f"share{i}") for i, r in enumerate(rules)],
                       *[F.avg(r.work(m).cast("double")).alias(f"work{i}") for i, r in enumerate(rules)]).first()
    known = [(r, float(found[f"share{i}"] or 0), max(float(found[f"work{i}"] or 0), 1.0)) for i, r in enumerate(rules)]
    return sorted(known, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def _first_failed(order: Sequence[Rule], m: Measures) -> Column:
    """The first rule that rejects, by counts that are columns."""
    failed = F.lit(None).cast("string")
    for rule in reversed(order):
        failed = F.when(rule.test(m), F.lit(rule.name)).otherwise(failed)
    return failed


def _cascade(order: Sequence[Rule], parts: Mapping[str, Column]) -> Column:
    """The first rule that rejects. Words and lines are cut where the first rule comes that needs them, once; counts are made
    inside their rule. What follows a rule that rejects is not evaluated."""
    if not order:
        return F.lit(None).cast("string")
    rule = order[0]
    for part in rule.needs:
        if part not in parts:
            return _let(_PARTS[part](), lambda x: _cascade(order, {**parts, part: x}))
    m = _counts(F.coalesce(F.col("text"), F.lit("")), parts)
    return F.when(rule.test(m), F.lit(rule.name)).otherwise(_cascade(order[1:], parts))


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measure every row of ``docs`` (``doc_id``, ``text``) and judge it by a cascade of rules.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule``.
    Words are ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` counts code points in words, ``n_symbols`` the characters
    ``#*$%&|<>``, ``n_dup_lines`` the lines with a word that equal an earlier line, ``n_repeat_words`` the words in
    windows of three words found twice or more. ``base_failed``: under 50 words, or over half of them repeated.
    ``kept`` is true when no rule rejects; ``failed_rule`` names the first that does in the chosen order, the rules
    after it are not evaluated (here all counts are results as well; :func:`good_documents` spares them). Null and blank texts
    have no words and fail. Rows keep their number: repeated rows
    and null ids are judged on their own. More columns are ignored. The order is set on a bounded sample and has no
    influence on ``kept``. An empty table gives an empty result.
    """
    order = [rule for rule, _, _ in order_rules(docs, list(rules if rules is not None else default_rules()), sample_rows)]
    counted = measured(docs.select("doc_id", "text"))
    m = {n: F.col(n) for n in counted.columns} | {"text": F.coalesce(F.col("text"), F.lit(""))}
    failed_base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = counted.withColumn("base_failed", failed_base).withColumn("failed_rule", _first_failed(order, m))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")


def good_documents(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` that :func:`quality_cascade` keeps, whole.

    Words, lines and counts are made inside the branch of the rule that needs them first, so a row that an earlier rule
    rejects is spared them.
    """
    own = list(rules if rules is not None else default_rules())
    own += [r for r in default_rules() if r.name in _BASE and r.name not in {x.name for x in own}]
    order = [rule for rule, _, _ in order_rules(docs, own, sample_rows)]
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    return whole.where(_cascade(order, {}).isNull()).select("whole.*")
