"""Sentence boundaries learnt from the corpus itself, without labels.

A full stop behind an abbreviation ends no sentence. Which words are abbreviations is told by counts over all texts: how
much more often a word stands before a stop than chance has it (log-likelihood ratio), how short it is, and how rarely
it stands without. Words that follow sure boundaries much more often than chance has it start sentences; such a word,
with a capital, lets a sentence end even at an abbreviation. All counts are Spark aggregates, and the learnt table is applied with
native expressions.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_SENTENCE_CHARS, clean_text, col
from ..session import shared_dir
from ..sources.tables import stage

# The limits of the published method.
ABBREVIATION = 0.3
STARTER = 30.0
#: Learnt words up to this number become part of the expression; more are joined.
LITERALS = 4_000
_EDGES = r"^[\"'“”‘’«»(\[{]+|[\"'“”‘’«»)\]},;:!?]+$"
_END = r"([.!?])[\"'”’»)\]]*$"
_MARK = "\u001e"
_TINY = 1e-12


def bare(token) -> Column:
    """A token in lower case without the quotes, brackets and commas around it; a stop stays."""
    return F.regexp_replace(F.lower(col(token)), _EDGES, "")


def word_type(token) -> Column:
    return F.regexp_replace(bare(token), r"\.$", "")


def end_mark(token) -> Column:
    """The ``.``, ``!`` or ``?`` that a token ends with, else an empty string."""
    return F.regexp_extract(col(token), _END, 1)


def _has_letter(word: Column) -> Column:
    return word.rlike(r"\p{L}")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``type, with_stop, plain``: how often each word with a letter ends in a stop, and how often it doesn't.

    Tokens are counted as they stand first, so that each distinct one is looked into once.
    """
    token = docs.select(F.explode(F.split(clean_text(text), " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    typed = token.select(word_type("token").alias("type"), bare("token").endswith(".").alias("stop"), "n").where(_has_letter(F.col("type")))
    total = lambda stop: F.coalesce(F.sum(F.when(stop, F.col("n"))), F.lit(0))
    return typed.groupBy("type").agg(total(F.col("stop")).alias("with_stop"), total(~F.col("stop")).alias("plain"))


def abbreviations(counts: DataFrame, total: int, stops: int) -> DataFrame:
    """``type, score`` of the words taken for abbreviations, of ``total`` words, ``stops`` of them with a stop."""
    p = min(max(stops / total, _TINY), 1 - _TINY) if total else 0.5
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    inner = (F.length("type") - letters + 1).cast("double")
    ratio = -2 * ((F.col("with_stop") * math.log(p) + F.col("plain") * math.log(1 - p))
                  - (F.col("with_stop") * math.log(0.99) + F.col("plain") * math.log(0.01)))
    score = ratio * F.exp(-letters.cast("double")) * inner * F.pow(letters.cast("double"), -F.col("plain").cast("double"))
    return counts.where("with_stop > 0").select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def _pairs(docs: DataFrame, text: str) -> DataFrame:
    """``before, mark, after, n``: words around a place where a sentence could end."""
    pair = docs.select(_pieces(text).alias("p")).select(F.explode(_places(F.col("p"))).alias("x")).where("x.after is not null")
    return pair.groupBy(word_type("x.before").alias("before"), end_mark("x.before").alias("mark"), word_type("x.after").alias("after")).agg(F.count("*").alias("n"))


def followers(docs: DataFrame, abbreviated: DataFrame, text: str = "text") -> DataFrame:
    """``type, n``: how often each word comes right behind a sure boundary."""
    known = abbreviated.select(F.col("type").alias("before"), F.lit(True).alias("short"))
    pairs = _pairs(docs, text).join(known, "before", "left")
    sure = pairs.where((F.col("mark") != ".") | (F.col("short").isNull() & (F.length("before") > 1) & ~F.col("before").endswith(".")))
    return sure.groupBy(F.col("after").alias("type")).agg(F.sum("n").alias("n"))


def starters(counts: DataFrame, after: DataFrame, total: int, breaks: int) -> DataFrame:
    """``type, score`` of the words that start sentences: those that follow sure boundaries more often than chance has it."""
    found = after.join(counts.select("type", (F.col("with_stop") + F.col("plain")).alias("all")), "type")
    a, n = float(max(breaks, 1)), float(max(total, 2))
    b, ab = F.col("all").cast("double"), F.col("n").cast("double")

    def term(hits: Column, misses: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(_TINY)), F.lit(1 - _TINY))
        return hits * F.log(p) + misses * F.log(1 - p)

    score = -2 * (term(ab, a - ab, b / n) + term(b - ab, n - a - b + ab, b / n) - term(ab, a - ab, ab / a) - term(b - ab, n - a - b + ab, (b - ab) / (n - a)))
    return found.where(ab / b > F.lit(a / n)).select("type", score.alias("score")).where(F.col("score") >= STARTER)


def train_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Learn from all of ``docs``: rows ``kind`` (``abbreviation`` or ``starter``), ``type``, ``score``.

    Two passes over the texts; counts by word are written to the shared folder in between. Null and blank texts teach
    nothing; an empty table gives an empty model, with which every stop ends a sentence.
    """
    folder = f"{shared_dir(docs.sparkSession)}/sentences-{uuid.uuid4().hex}"
    counts = stage(word_counts(docs, text), folder, "counts")
    total, stops = (int(x or 0) for x in counts.agg(F.sum(F.col("with_stop") + F.col("plain")), F.sum("with_stop")).first())
    short = stage(abbreviations(counts, total, stops), folder, "abbreviations")
    after = stage(followers(docs, short, text), folder, "followers")
    first = starters(counts, after, total, int(after.agg(F.sum("n")).first()[0] or 0))
    return stage(short.select(F.lit("abbreviation").alias("kind"), "type", "score").unionByName(
        first.select(F.lit("starter").alias("kind"), "type", "score")), folder, "model")


def _pieces(text) -> Column:
    """A cleaned text, cut wherever a sentence could end."""
    return F.split(F.regexp_replace(clean_text(text), r"([.!?][\"'”’»)\]]*) ", "$1" + _MARK), _MARK)


def _last(piece: Column) -> Column:
    return F.substring_index(piece, " ", -1)


def _first(piece: Column) -> Column:
    return F.substring_index(piece, " ", 1)


def _places(pieces: Column) -> Column:
    """``before, after`` of every piece: its last token and the first one of the next piece, which the last piece hasn't."""
    return F.zip_with(pieces, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))), lambda a, b: F.struct(_last(a).alias("before"), _first(b).alias("after")))


def ends_sentence(before: Column, after: Column, is_short: Column, is_starter: Column) -> Column:
    """Whether a sentence ends between two tokens, the first of which ends with a mark.

    ``!`` and ``?`` end it. A stop behind an abbreviation, a single letter or other stops does so only before a learnt
    starter with a capital; one behind a number not before a small letter; any other one does.
    """
    word = word_type(before)
    opening = F.regexp_replace(after, r"^[\"'“”‘’«»(\[{]+", "")
    weak = is_short | (word.rlike(r"^\p{L}$")) | word.endswith(".")
    return (
        F.when(end_mark(before) != ".", True)
        .when(weak, is_starter & opening.rlike(r"^\p{Lu}"))
        .when(word.rlike(r"^\p{N}[\p{N}.,]*$"), ~opening.rlike(r"^\p{Ll}"))
        .otherwise(True)
    )


def _joined(pieces: Column, ends) -> Column:
    """Sentences: pieces with a boundary, or a blank, between them. ``ends(i, before, after)`` decides.

    Pieces are bound by an array of one, and a condition that is not deterministic keeps a filter on the sentences above what makes
    them: pushed down, it would cut the text anew for each of its pieces.
    """
    bound = F.get(F.transform(F.array(pieces), lambda p: _sentences(p, ends)), F.lit(0))
    return F.when(F.spark_partition_id() >= 0, bound)


def _sentences(pieces: Column, ends) -> Column:
    def closed(piece: Column, i: Column) -> Column:
        after = F.get(pieces, i + 1)
        glue = F.when(after.isNull(), "").when(ends(i, _last(piece), _first(after)), _MARK).otherwise(" ")
        return F.concat(piece, glue)

    parts = F.transform(F.split(F.array_join(F.transform(pieces, closed), ""), _MARK), F.trim)
    return F.coalesce(F.filter(parts, lambda s: F.length(s) >= MIN_SENTENCE_CHARS), F.array().cast("array<string>"))


def split_sentences_trained(docs: DataFrame, model: DataFrame, text: str = "text", out: str = "sentences", literals: int = LITERALS) -> DataFrame:
    """Add the array ``out`` of trimmed sentences of at least three characters to every row of ``docs``.

    Null and blank texts have none. A model of up to ``literals`` words becomes part of the expression, so texts stay
    where they are. A larger one is joined to the places where sentences could end, by word; what comes back to a text is the list
    of its places that join, by the text's checksum, so equal texts are looked up once.
    """
    held = model.select("kind", "type").limit(literals + 1).collect()
    if len(held) <= literals:
        short = [r["type"] for r in held if r["kind"] == "abbreviation"]
        first = [r["type"] for r in held if r["kind"] == "starter"]
        ends = lambda i, before, after: ends_sentence(before, after, word_type(before).isin(short), word_type(after).isin(first))
        return docs.withColumn("__pieces", _pieces(text)).withColumn(out, _joined(F.col("__pieces"), ends)).drop("__pieces")
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.col(text).cast("binary"))))
    pieces = keyed.where(F.col(text).isNotNull()).select("__key", _pieces(text).alias("p")).dropDuplicates(["__key"])
    places = pieces.select("__key", F.posexplode(_places(F.col("p"))).alias("i", "x")).where("x.after is not null")
    places = places.select("__key", "i", "x.before", "x.after", word_type("x.before").alias("t"), word_type("x.after").alias("u"))
    kind = lambda k, name, flag: model.where(F.col("kind") == k).select(F.col("type").alias(name), F.lit(True).alias(flag))
    judged = places.join(kind("abbreviation", "t", "short"), "t", "left").join(kind("starter", "u", "first"), "u", "left")
    none = F.lit(False)
    joins = judged.where(~ends_sentence(F.col("before"), F.col("after"), F.coalesce("short", none), F.coalesce("first", none)))
    joins = joins.groupBy("__key").agg(F.collect_list("i").alias("__joins"))
    whole = keyed.join(joins, "__key", "left").withColumn("__pieces", _pieces(text))
    stays = lambda i, before, after: ~F.coalesce(F.array_contains(F.col("__joins"), i), none)
    return whole.withColumn(out, _joined(F.col("__pieces"), stays)).drop("__pieces", "__joins", "__key")
