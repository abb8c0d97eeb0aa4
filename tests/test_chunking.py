"""Chunking against literal cases and a plain brute-force fold."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newsevidence.functions.vectors import digest_matrix
from newsevidence.operators import chunk_stream as S
from newsevidence.operators import chunking as C


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_fixed(spark):
    six = [f"Sentence {i}" for i in range(1, 7)]
    got = one(spark, [(six,), ([],)], "s array<string>", C.fixed_chunks("s"))
    assert got == [[" ".join(six[:4]), " ".join(six[4:])], []]


def test_boundaries(spark):
    schema = "s array<string>, v array<array<double>>"
    rows = [(["a", "b", "c"], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), (["a"], [[1.0]])]
    assert one(spark, rows, schema, C.semantic_boundaries("s", "v", 0.5)) == [[0, 2], [0]]
    with pytest.raises(PySparkException):
        one(spark, [(["a"], [[1.0], [2.0]])], schema, C.semantic_boundaries("s", "v"))


def cut(spark, sentences, bounds, **kw):
    overlap = kw.pop("overlap", 0)
    flags = [i in bounds for i in range(len(sentences))]
    column = C.chunks_from_cuts("s", C.chunk_cuts("s", "f", **kw), overlap)
    return one(spark, [(sentences, flags)], "s array<string>, f array<boolean>", column)[0]


def test_semantic_cases(spark):
    got = cut(spark, list("ABCDE"), {0, 2}, min_sentences=2, max_sentences=10, max_tokens=1000)
    assert [(c.text, c.start, c.end) for c in got] == [("A B", 0, 2), ("C D E", 2, 5)]
    assert len(cut(spark, ["x" * 100] * 2, set(), min_sentences=1, max_sentences=10, max_tokens=10)) == 2
    got = cut(spark, list("ABCD"), {2}, min_sentences=2, max_sentences=10, max_tokens=1000, overlap=1)
    assert (got[1].text, got[1].idx, got[1].has_overlap, got[1].overlap_count) == ("B C D", [1, 2, 3], True, 1)
    got = cut(spark, list("AB"), set(), min_sentences=2, max_sentences=10, max_tokens=1000, overlap=1)
    assert [(c.text, c.has_overlap) for c in got] == [("A B", False)]
    assert cut(spark, [], set()) == []


def brute(lengths, bounds, low, high, tokens):
    """Chunk spans by re-summing at every step."""
    spans, start = [], 0
    for i in range(1, len(lengths) + 1):
        big = i - start >= high or sum(lengths[start:i]) // 4 > tokens
        if i - start >= low and (i in bounds or big):
            spans.append((start, i))
            start = i
    return spans + ([(start, len(lengths))] if start < len(lengths) else [])


@pytest.mark.parametrize("overlap", [0, 1, 2, 5])
def test_native_and_task_rules_equal_brute_force(spark, overlap):
    rng = random.Random(overlap)
    docs = []
    for _ in range(60):
        n = rng.randrange(0, 60)
        docs.append((["w" * rng.choice([3, 40, 300, 900]) for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]))
    column = C.chunks_from_cuts("s", C.chunk_cuts("s", "f"), overlap)
    got = one(spark, docs, "s array<string>, f array<boolean>", column)
    for (sentences, flags), chunks in zip(docs, got):
        lengths = [len(s) for s in sentences]
        spans = brute(lengths, {i for i, f in enumerate(flags) if f}, 2, 8, 400)
        cutter = S.Cutter(2, 8, 400, overlap)
        pushed = [cutter.push(s, np.ones(2) * i, f) for i, (s, f) in enumerate(zip(sentences, flags))] + [cutter.finish()]
        pushed = [p for p in pushed if p]
        assert [(p[2] + p[4], p[3]) for p in pushed] == spans and [(p[0], p[2]) for p in pushed] == [(c.text, c.start) for c in chunks]
        assert all(p[1][0] == pytest.approx((p[2] + p[3] - 1) / 2) for p in pushed)
        assert [(c.start + c.overlap_count, c.end) for c in chunks] == spans
        # Overlap of the recursive rule: not before the opened start of the chunk before.
        opened = 0
        for i, (a, b) in enumerate(spans):
            opened = a if i == 0 or len(spans) == 1 else max(a - overlap, opened)
            assert chunks[i].start == opened and chunks[i].text == " ".join(sentences[opened:b])


def test_stream_equals_native_path(spark):
    rng = random.Random(3)
    docs = [(i, [f"s{rng.random()}" for _ in range(n)]) for i, n in enumerate((0, 1, 2, 9, 30, 77))]
    df = spark.createDataFrame(docs, "id long, s array<string>")
    native = df.withColumn("v", C.sentence_vectors("s", 48)).where(F.size("s") > 0)
    native = native.select("id", C.semantic_chunks("s", "v").alias("c"), C.semantic_boundaries("s", "v").alias("b"), "v")
    native = {r.id: r for r in native.withColumn("cv", C.chunk_vectors("c", "v")).collect()}
    for batch in (1, 7, 100):
        rows = C.stream_chunks(df, F.col("s"), C.hash_embedder(48), keep=("id",), batch=batch, semantic_from=0).collect()
        for i, want in native.items():
            got = sorted((r for r in rows if r.id == i), key=lambda r: r.chunk_index)
            assert [(r.text, r.start, r.end, r.overlap_count) for r in got] == [(c.text, c.start, c.end, c.overlap_count) for c in want.c]
            assert [x for r in got for x in r.boundaries] == want.b
            for r, v in zip(got, want.cv):
                assert r.vector == pytest.approx(v)


@pytest.mark.parametrize("batch", [3, 100])
def test_one_bad_document_leaves_the_rest_unchanged(spark, batch):
    rng = random.Random(5)
    docs = [(i, [f"sentence {rng.random()}" for _ in range(n)]) for i, n in enumerate((12, 15, 4, 30, 11))]
    docs += [(5, ["fine one", "bad", "fine two"]), (6, [f"text {i}" if i != 7 else "bad" for i in range(12)]), (7, None), (8, [])]
    df = spark.createDataFrame(docs, "id long, s array<string>").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("no vector")
        return digest_matrix(texts, 16)

    run = lambda e: [r.asDict() for r in C.stream_chunks(df, F.col("s"), e, keep=("id",), batch=batch).orderBy("id", "chunk_index").collect()]
    good, some = run(C.hash_embedder(16)), run(embedder)
    assert [r for r in some if r["id"] < 6] == [r for r in good if r["id"] < 6]
    six = [r for r in some if r["id"] == 6]
    assert [(r["start"], r["end"], r["semantic"]) for r in six] == [(0, 4, False), (4, 8, False), (8, 12, False)]
    assert all(r["error"] == "RuntimeError: no vector" and r["vector"] is not None for r in six) and not any(r["id"] > 6 for r in some)
    short = lambda texts: digest_matrix(texts, 16)[:-1]
    assert all(r["vector"] is None and "mismatch" in r["error"] for r in run(short))
    ragged = lambda texts: [[1.0] * (1 + len(t) % 2) for t in texts]
    assert any(r["error"] for r in run(ragged))


def test_long_documents_hand_over_before_their_end(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_BYTES", 4096)
    monkeypatch.setattr(S, "SLICE_BYTES", 2048)
    parts = [f"sentence number {i}" for i in range(300)]
    df = spark.createDataFrame([(1, parts), (2, parts[:20])], "id long, s array<string>").coalesce(1)
    rows = C.stream_chunks(df, F.col("s"), C.hash_embedder(64), keep=("id",)).collect()
    native = df.withColumn("v", C.sentence_vectors("s", 64)).select("id", F.posexplode(C.semantic_chunks("s", "v")).alias("i", "c")).collect()
    assert sorted((r.id, r.chunk_index, r.text) for r in rows) == sorted((r.id, r.i, r.c.text) for r in native)

    def late(texts):
        if parts[250] in texts:
            raise RuntimeError("late")
        return digest_matrix(texts, 64)

    one = sorted((r for r in C.stream_chunks(df, F.col("s"), late, keep=("id",)).collect() if r.id == 1), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in one] == list(range(len(one))) and one[0].semantic and not one[-1].semantic
    assert {i for r in one for i in range(r.start, r.end)} == set(range(300))


def test_documents_with_an_embedder_equal_the_hash_path(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(8))
    docs = [(i, " ".join(f"{word()} {word()}." for _ in range(n))) for i, n in enumerate([0, 1, 5, 9, 10, 25, 60])]
    df = spark.createDataFrame(docs, "article_id long, text string")
    key = lambda r: (r.article_id, r.chunk_index)
    native = sorted(C.chunk_documents(df, "text", dim=32).collect(), key=key)
    model = sorted(C.chunk_documents(df, "text", dim=32, embedder=lambda t: digest_matrix(t, 32)).collect(), key=key)
    assert [(key(r), r.text) for r in native] == [(key(r), r.text) for r in model]
    for a, b in zip(native, model):
        assert a.vector == pytest.approx(b.vector, abs=1e-6)


def test_embed_unique_shares_the_first_vector(spark):
    rows = [("r1", 0, "A b"), ("r1", 1, "a  B"), ("r2", 0, "a  B"), ("r2", 1, "ﬁn"), ("r2", 2, "FIN")]
    df = spark.createDataFrame(rows, "request string, pos int, text string")
    out = {(r.request, r.pos): r.vector for r in C.embed_unique(df, request="request", position="pos", text="text", dim=32).collect()}
    vec = lambda t: digest_matrix([t], 32)[0].tolist()
    assert out == {("r1", 0): vec("A b"), ("r1", 1): vec("A b"), ("r2", 0): vec("a  B"), ("r2", 1): vec("ﬁn"), ("r2", 2): vec("ﬁn")}
    counts = C.embed_counts(df, request="request", text="text").collect()
    assert sorted(tuple(r) for r in counts) == [("r1", 2, 1), ("r2", 3, 2)]
