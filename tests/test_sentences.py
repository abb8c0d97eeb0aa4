"""Sentence boundaries learnt from a small corpus."""

import pytest
from pyspark.sql import functions as F

from newsevidence.operators.sentences import _pairs, split_sentences_trained, train_sentences, word_counts

FILL = ["We saw Dr. {0} in town. The talk went well. He left at noon.", "Then Mr. {0} spoke for an hour. She stayed. He paid 3.5 dollars.",
        "Some call it a win. The vote was near. The team of Dr. {0} was there.", "He came early. They met at 5 p.m. on Monday. The rain fell."]
NAMES = ["Smith", "Jones", "Brown", "Weber", "Lopez", "Nguyen", "Kim", "Rossi"]
# The words that end sentences above, inside of one: a word that only ever stands before a stop would pass for an abbreviation.
INNER = "By noon the town was well fed, an hour went by near there, rain fell and she stayed a win for dollars early on Monday, they say"
TEXTS = [f.format(n) for f in FILL for n in NAMES] * 2 + [f"{INNER} again and again now" for _ in range(20)]
CASES = [
    (1000, "Dr. Smith met Mr. Jones. It was good! Was it? Yes."), (1001, "They met at 5 p.m. yesterday. He left."),
    (1002, "It ended at 5 p.m. The rain fell."), (1003, 'J. Weber said "no." He left.'), (1004, "He paid 10. Then he left."), (1005, None),
    (1006, "  "), (1007, "ok"), (1008, "Dr. Smith\nmet   Dr. Kim."), (1009, "Dr. Smith met Mr. Jones. It was good! Was it? Yes."),
]
WANT = {
    1000: ["Dr. Smith met Mr. Jones.", "It was good!", "Was it?", "Yes."], 1001: ["They met at 5 p.m. yesterday.", "He left."],
    1002: ["It ended at 5 p.m.", "The rain fell."], 1003: ['J. Weber said "no."', "He left."], 1004: ["He paid 10.", "Then he left."], 1005: [], 1006: [],
    1007: [], 1008: ["Dr. Smith met Dr. Kim."], 1009: ["Dr. Smith met Mr. Jones.", "It was good!", "Was it?", "Yes."],
}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, ""])], "doc_id long, text string")
    return train_sentences(docs)


def test_abbreviations_and_starters_are_learnt(model):
    found = {}
    for r in model.collect():
        found.setdefault(r.kind, set()).add(r.type)
    assert {"dr", "mr", "p.m"} <= found["abbreviation"] and not found["abbreviation"] & {"town", "noon", "the", "he"}
    assert {"he", "the"} <= found["starter"]


@pytest.mark.parametrize("literals", [4_000, 0])
def test_boundaries(spark, model, literals):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in CASES], "doc_id long, text string, other string")
    out = split_sentences_trained(docs, model, literals=literals)
    assert out.columns == ["doc_id", "text", "other", "sentences"]
    assert {r.doc_id: r.sentences for r in out.collect()} == WANT


def test_without_a_corpus_every_stop_ends_a_sentence(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = train_sentences(none)
    assert model.count() == 0
    docs = spark.createDataFrame([(1, "Dr. Smith left. He ran.")], "doc_id long, text string")
    assert split_sentences_trained(docs, model).first().sentences == ["Dr.", "Smith left.", "He ran."]
    assert split_sentences_trained(none, model).count() == 0


@pytest.mark.parametrize("literals", [4_000, 0])
def test_a_text_is_cut_once(spark, model, literals):
    """A filter that Spark infers from an explode must not cut the text again for each of its pieces."""
    docs = spark.createDataFrame([(1, "The rain fell. He left. " * 2000)], "doc_id long, text string")
    out = split_sentences_trained(docs, model, literals=literals).select("doc_id", F.posexplode("sentences").alias("pos", "sentence"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(") == (1 if literals else 2)  # with a joined model, once more for its places
    assert [r.sentence for r in out.orderBy("pos").collect()] == ["The rain fell.", "He left."] * 2000


def test_words_are_counted_with_and_without_stops(spark):
    docs = spark.createDataFrame([("He met Dr. Kim, (dr.) Kim and kim.",), ("kim.\tDr",), (None,), ("  ",), ("... 5. !",)], "text string")
    got = {r.type: (r.with_stop, r.plain) for r in word_counts(docs).collect()}
    assert got == {"he": (0, 1), "met": (0, 1), "dr": (2, 1), "kim": (2, 2), "and": (0, 1)}


def test_places_are_those_between_tokens(spark):
    docs = spark.createDataFrame([('Well... "Yes!" said J. R. Kim (no.) . ! Ende.',), ("one",), ("",), (None,), ("a. b. a. b",)], "text string")
    got = {(r.before, r.mark, r.after): r.n for r in _pairs(docs, "text").collect()}
    assert got == {("well..", ".", "yes"): 1, ("yes", "!", "said"): 1, ("j", ".", "r"): 1, ("r", ".", "kim"): 1, ("no", ".", ""): 1,
                   ("", ".", ""): 1, ("", "!", "ende"): 1, ("a", ".", "b"): 2, ("b", ".", "a"): 1}
