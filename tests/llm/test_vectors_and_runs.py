"""Neighbour search, hard negatives and periodic runs against plain versions, on odd rows, and on empty tables."""

import random
from collections import Counter

import brute as B
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsevidence.llm import negatives, neighbours, periodic
from newsevidence.llm.queries import QUERIES

VECTORS = "vec_id long, label int, vector array<float>, node long, `a.b` int, query string, seq string, members int"


def vector_rows(seed=1, n=400, size=8):
    r = random.Random(seed)
    made = [[r.gauss(0, 1) for _ in range(size)] for _ in range(n)]
    rows = [(i, i % 3, [float(np.float32(x)) for x in v]) for i, v in enumerate(made)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(60)]  # copies
    rows += [(20, 2, rows[3][2]), (20, 2, rows[3][2])]  # an id with two vectors, and a repeated row
    odd = [(None, 1, rows[0][2]), (2000, None, rows[1][2]), (2020, 0, None), (2040, 0, [0.0] * size), (2060, 1, [1.0, None] + [0.0] * (size - 2)),
           (2080, 1, [float("nan")] * size), (2100, 2, [float("inf")] + [0.0] * (size - 1)), (2120, 2, [0.5, 0.25]), (2140, 0, [])]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "q", "s", 3) for r in rows], VECTORS).repartition(3)


# 11 ---------------------------------------------------------------------------------------------

def test_nearest(spark):
    rows, odd = vector_rows()
    df = frame(spark, rows + odd)
    found = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    plain = list(dict.fromkeys([(i, tuple(v)) for i, _, v in rows] + [(2000, tuple(rows[1][2]))]))
    asked = [r for r in plain if r[0] % 20 == 0]
    assert set(found) == {i for i, _ in asked}
    hits = total = 0
    for q in asked:
        got = sorted(found[q[0]])
        if q[0] == 20:  # two rows with this id ask
            assert len(got) == 40
            continue
        want = B.nearest(plain, q, 20)
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(g[2] == pytest.approx(s, abs=1e-12) for g, (_, s) in zip(got, want) if g[1] == _)
        hits += len({g[1] for g in got} & {i for i, _ in want})
        total += 20
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
    assert hits >= 0.95 * total


def test_nearest_in_a_small_table_is_exact(spark):
    rows = [(i, (float(i % 7), float(i % 5) - 2, 1.0)) for i in range(40)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, vector array<double>")
    for k in (3, 32):
        got = {}
        for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: [g[1:] for g in sorted(v)] for q, v in got.items()} == {i: B.nearest(rows, (i, v), k) for i, v in rows if i % 20 == 0}
    few = df.where("vec_id < 3")
    assert neighbours.nearest(few, few, k=20).count() == 6
    assert neighbours.nearest(df.limit(0), df, k=20).count() == 0 and neighbours.nearest(df, df.limit(0), k=20).count() == 0


def test_queries_from_outside_and_longer_vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((1500, 12)) * r.uniform(0.2, 3, (1500, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    asks = [(5000 + i, [float(x) for x in r.standard_normal(12)]) for i in range(30)]
    df, ask = (spark.createDataFrame(x, "vec_id long, vector array<double>") for x in (rows, asks))
    got = {}
    for x in neighbours.nearest(df, ask, k=10).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = sum(len(got[i] & set(np.argsort(-(base @ np.array(v)))[:10].tolist())) for i, v in asks)
    assert hits >= 0.9 * 300


def test_recall_of_the_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op11_neighbour_descent"](spark, folder).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    hits = total = 0
    for i, q in enumerate(ids):
        if q % 20 == 0:
            score = x @ x[i]
            score[i] = -np.inf
            hits += len(set(ids[np.argsort(-score)[:20]].tolist()) & set(got[q]))
            total += 20
    assert len(got) == sum(i % 20 == 0 for i in ids) and hits >= 0.95 * total


# 12 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("scale,size", [(1, 8), (400, 8), (1e6, 8), (0.01, 3)])
def test_packed_products_are_exact(scale, size):
    r = np.random.default_rng(3)
    parts = np.floor(r.standard_normal((101, size)) * 256 * scale).astype(np.int64)
    reach = int(np.abs(parts).max())
    block = negatives.Packed(parts, reach)
    assert (block.fields > 1) == (scale < 400) and block.fields * block.bits <= 53
    assert (block.scores(parts[:9]) == parts[:9] @ parts.T).all()


def test_hard_negatives(spark):
    rows, odd = vector_rows(2, 150, 4)
    rows = [(i, c, [x / 4 for x in v]) for i, c, v in rows]
    kept = rows + [(None, 1, odd[0][2]), (2040, 0, [0.0] * 4), (2120, 2, [0.5, 0.25]), (2140, 0, [])]
    df = frame(spark, [r for r in rows] + [(None, 1, odd[0][2]), *odd[1:3], (2040, 0, [0.0] * 4), (2060, 1, [1.0, None]), (2080, 1, [float("nan")]),
                                           (2100, 2, [float("-inf")]), (2120, 2, [0.5, 0.25]), (2140, 0, [])])
    got = Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == Counter(B.hard_negatives(kept, lambda i: i is not None and i % 10 == 0)) and len(got) > 100
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_anchors_in_several_scans(spark, monkeypatch):
    rows, _ = vector_rows(5, 90, 4)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 4096)
    got = Counter(tuple(r) for r in negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0).collect())
    assert got == Counter(B.hard_negatives(rows, lambda i: i % 5 == 0))


# 13 ---------------------------------------------------------------------------------------------

def texts():
    r = random.Random(9)
    line = " ".join(r.choice("abcdefgh") for _ in range(9))
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    made = [None, "", " \n\t ", "one", "w " * 11, "w " * 12, "a b " * 6, "a b " * 5 + "a", (line + "\n") * 40, " ".join(fib[-1]), "x y z " * 4 + "x q " + "x y z " * 5,
            " ".join(r.choice("ab") for _ in range(400)), " ".join(r.choice("abc") for _ in range(700)), "ü ü " * 9 + "é", "\x1c\x85 " * 13]
    for _ in range(60):
        w = []
        while len(w) < 120:
            w += ([r.choice("abc") for _ in range(r.randint(1, 30))] * r.randint(1, 4))[:-1]
        made.append(" ".join(w))
    return [(i, t) for i, t in enumerate(made)] + [(None, "a b " * 8), (8, "a b " * 8), (8, "a b " * 8)]


def test_runs(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, runs_sha256 string, starts array<int>").repartition(4)
    got = Counter((r.doc_id, r.n_words, tuple(zip(r.starts, r.lengths, r.periods)), r.runs_sha256, r.collapsed_sha256) for r in periodic.periodic_runs(df).collect())
    want = Counter()
    for i, t in rows:
        w = B.words(t)
        found = B.runs(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want[(i, len(w), tuple(found), B.sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), B.sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert got == want
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_runs_of_a_very_long_text(spark):
    r = random.Random(3)
    unit = [str(r.randint(0, 9999)) for _ in range(40_000)]
    text = " ".join(unit * 2 + unit[:7] + ["end"] + ["w"] * 30_000)
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [*zip(row.starts, row.lengths, row.periods)][0] == (0, 80_007, 40_000) and (80_008, 30_000, 1) in [*zip(row.starts, row.lengths, row.periods)]


def test_runs_query(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if len(B.words(t)) <= 1500]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_word_runs"](spark, folder).collect()}
    assert len(got) == len(docs) and len(short) > 100
    assert [got[i] for i, _ in short] == [B.run_columns(i, t) for i, t in short]
    assert sum(r[1] > 0 for r in got.values()) > 5
