"""Nearest chunks against brute force on both paths, and the filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsevidence.operators import cells as C
from newsevidence.operators import search as S


def tables(spark, n_claims, n_chunks, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    claims = rng.normal(size=(n_claims, dim)).astype(np.float32)
    chunks = rng.normal(size=(n_chunks, dim)).astype(np.float32)
    chunks[: n_chunks // 3] = claims[0]  # a third of all chunks are copies: ties and a hot cell
    chunks[-1] = 0
    to_df = lambda m, c: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{c} long, vector array<float>")
    return to_df(claims, "claim_id"), to_df(chunks, "chunk_id"), claims, chunks


def brute(claims, chunks, k, limit):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    d = (1 - unit(claims.astype(float)) @ unit(chunks.astype(float)).T).astype(np.float32)
    out = []
    for q in range(len(claims)):
        best = sorted(range(len(chunks)), key=lambda c: (d[q, c], c))[:k]
        out += [(q, c, r + 1) for r, c in enumerate(best) if d[q, c] <= np.float32(limit)]
    return sorted(out)


@pytest.mark.parametrize("k, limit", [(5, 0.5), (3, 2.0), (200, 0.9)])
@pytest.mark.parametrize("bound", [1, S.BROADCAST_BYTES])
def test_both_paths_equal_brute_force(spark, monkeypatch, k, limit, bound):
    monkeypatch.setattr(C, "BLOCK_CHUNKS", 50)
    monkeypatch.setattr(C, "BLOCK_CLAIMS", 7)
    monkeypatch.setattr(C, "CELL_ROWS", 10)
    claims, chunks, q, c = tables(spark, 30, 300)
    got = S.nearest_chunks(claims, chunks, k, limit, broadcast_bytes=bound)
    assert sorted((r.claim_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(q, c, k, limit)


def test_empty_sides(spark):
    claims, chunks, _, _ = tables(spark, 3, 9)
    assert S.nearest_chunks(claims.limit(0), chunks).count() == 0
    assert S.nearest_chunks(claims, chunks.limit(0)).count() == 0
    assert S.nearest_chunks(claims, chunks.limit(0), broadcast_bytes=1).count() == 0


def test_bad_sources_after_the_limit_unless_prefiltered(spark):
    rows = [(1, [1.0, 0.0], "Questionable", None, None), (2, [0.9, 0.1], None, "very_low", None),
            (3, [0.8, 0.2], "center", "high", "high"), (4, [0.7, 0.3], None, None, " LOW ")]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<float>, bias string, factual_reporting string, credibility string")
    claims = spark.createDataFrame([(1, [1.0, 0.0])], "claim_id long, vector array<float>")
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(S.evidence_search(claims, chunks, 2)) == []
    assert ids(S.evidence_search(claims, chunks, 2, prefilter=True)) == [3]
    assert ids(S.evidence_search(claims, chunks, 4)) == [3]


def test_limit_is_single_precision(spark):
    hits = spark.createDataFrame([(0.68,), (0.6800001,)], "distance double")
    assert S.within_distance(hits, 0.68).count() == 1


def test_score_is_compared_in_single_precision(spark):
    hits = spark.createDataFrame([(0.2,), (0.2,), (0.9,), (0.3,)], "distance double")
    assert S.with_min_score(hits, 0.3).count() == 3
    assert S.with_min_score(hits, 0.7).count() == 3


def test_search_limits(spark):
    claims, chunks, _, _ = tables(spark, 2, 9)
    for limit in (0, 101):
        with pytest.raises(ValueError):
            S.search(claims, chunks, limit)


def test_article_chunks_cut_before_blanks(spark):
    rows = [(1, i, " " if i == 1 else f"t{i}") for i in range(5)] + [(2, 0, "x")]
    df = spark.createDataFrame(rows, "article_id long, chunk_index int, text string")
    got = S.article_chunks(df, limit=3).orderBy("article_id", "chunk_index").collect()
    assert [(r.article_id, r.text) for r in got] == [(1, "t0"), (1, "t2"), (2, "x")]
    assert S.article_chunks(df, 2).count() == 1


def test_claims_without_a_usable_vector_are_listed(spark):
    from newsevidence.operators.search import claim_vector_rejects, nearest_chunks

    rows = [(1, None), (2, []), (3, [1.0, 0.0]), (4, [None, 1.0]), (5, [1.0]), (6, [1.0, float("nan")]), (7, [0.9, 0.1])]
    claims = spark.createDataFrame(rows, "claim_id long, vector array<float>")
    odd = [("c", None), ("d", []), ("e", [1.0, None]), ("f", [1.0, 0.0, 0.0]), ("g", [float("inf"), 0.0])]
    chunks = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 1.0]), *odd], "chunk_id string, vector array<float>")
    for bound in (1, 1 << 20):
        got = nearest_chunks(claims, chunks, 1, 0.5, broadcast_bytes=bound).collect()
        assert sorted((r.claim_id, r.chunk_id) for r in got) == [(3, "a"), (7, "a")]
    assert {r.claim_id for r in claim_vector_rejects(claims).collect()} == {1, 2, 4, 6}
    assert {r.claim_id: r.reject_reason for r in claim_vector_rejects(claims, 2).collect()}[5] == "vector has 1 numbers, not 2"
    assert {r.chunk_id for r in S.chunk_vector_rejects(chunks, 2).collect()} == set("cdefg")


@pytest.mark.parametrize("k, limit", [(5, 0.5), (3, 2.0), (40, 1.0)])
def test_stored_cells(spark, monkeypatch, tmp_path, k, limit):
    monkeypatch.setattr(C, "BLOCK_CHUNKS", 60)
    claims, chunks, q, c = tables(spark, 30, 600, seed=2)
    odd = spark.createDataFrame([(1000, None), (1001, [1.0]), (1002, [None] * 16)], "chunk_id long, vector array<float>")
    text = chunks.unionByName(odd).withColumn("text", F.concat(F.lit("t"), "chunk_id")).withColumn("bias", F.lit(None).cast("string"))
    stored = S.build_cells(text, str(tmp_path / "cells"), cell_rows=20)
    assert stored.rows.sum() == 600 and len(stored.rows) > 10 and stored.dim == 16
    cells = S.open_cells(spark, stored.folder)
    got = S.nearest_chunks(claims, None, k, limit, cells=cells)
    assert sorted((r.claim_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(q, c, k, limit)
    rows = spark.read.parquet(f"{stored.folder}/chunks")
    assert "text" in rows.columns and rows.where("cell is null").count() == 0


def test_evidence_from_stored_cells(spark, tmp_path):
    claims, chunks, _, _ = tables(spark, 10, 200, seed=4)
    level = F.when(F.col("chunk_id") % 4 == 0, "Very_Low").otherwise("high")
    wide = chunks.select("*", F.concat(F.lit("t"), "chunk_id").alias("text"), F.lit("center").alias("bias"), level.alias("factual_reporting"),
                         F.lit(None).cast("string").alias("credibility"))
    cells = S.build_cells(wide, str(tmp_path / "cells"), cell_rows=10)
    bag = lambda df: sorted((r.claim_id, r.chunk_id, r["rank"], r.text) for r in df.collect())
    want = bag(S.evidence_search(claims, wide, 5, 0.9))
    assert bag(S.evidence_search(claims, None, 5, 0.9, cells=cells)) == want and len(want) > 10


def test_cells_spare_what_cannot_match(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16)) * 4
    chunks = (middles[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    claims = (middles[:20] + rng.normal(size=(20, 16))).astype(np.float32)
    to_df = lambda m, c: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{c} long, vector array<float>")
    cells = S.build_cells(to_df(chunks, "chunk_id"), str(tmp_path / "cells"), cell_rows=50)
    hits = C.search_cells(to_df(claims, "claim_id"), cells, 5, 0.5, str(tmp_path / "run"))
    assert sorted((r.claim_id, r.chunk_id, r["rank"]) for r in hits.collect()) == brute(claims, chunks, 5, 0.5)
    copies = spark.read.parquet(str(tmp_path / "run/routes")).groupBy("claim_id").count().agg(F.avg("count"), F.max("count")).first()
    assert copies[0] < 0.6 * len(cells.rows)  # of some 80 cells


def test_empty_layouts(spark, tmp_path):
    claims, chunks, _, _ = tables(spark, 3, 9)
    none = S.build_cells(chunks.limit(0), str(tmp_path / "none"))
    assert S.nearest_chunks(claims, None, cells=none).count() == 0
    some = S.build_cells(chunks, str(tmp_path / "some"))
    assert S.nearest_chunks(claims.limit(0), None, cells=some).count() == 0


def test_plans_of_signatures():
    from newsevidence.operators.signatures import plan_signatures

    for rows in (1, 100, 10_000, 10_000_000):
        for similarity in (0.5, 0.8, 0.95):
            plan = plan_signatures(rows, similarity, 0.95)
            assert plan.recall >= 0.95 and plan.tables <= 8 and plan.flips <= plan.bits
    big = plan_signatures(10_000_000, 0.9, 0.95)
    assert big.tables * big.probes / 2**big.bits < 0.05  # share of the table a claim is compared with


def test_approximate_search(spark, tmp_path):
    from newsevidence.operators.signatures import approximate_search, build_signatures, recall_report

    rng = np.random.default_rng(6)
    middles = rng.normal(size=(60, 24)) * 2
    chunks = (middles[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.7).astype(np.float32)
    chunks[:500] = chunks[0]
    claims = (middles[:40] + rng.normal(size=(40, 24)) * 0.7).astype(np.float32)
    to_df = lambda m, c: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{c} long, vector array<float>")
    odd = spark.createDataFrame([(9000, None), (9001, [1.0])], "chunk_id long, vector array<float>")
    index = build_signatures(to_df(chunks, "chunk_id").unionByName(odd), str(tmp_path / "i"), similarity=0.8, recall=0.97)
    assert index.plan.bits > 0 and index.rows.sum() == 6000 * index.plan.tables
    found = approximate_search(to_df(claims, "claim_id"), index, 10, 0.5, str(tmp_path / "r"))
    exact = S.nearest_chunks(to_df(claims, "claim_id"), to_df(chunks, "chunk_id"), 10, 0.5)
    report = recall_report(exact, found).first()
    assert report.n_exact == 400 and report.recall >= 0.95
    known = {(r.claim_id, r.chunk_id): r.distance for r in exact.collect()}
    assert all(known.get((r.claim_id, r.chunk_id), r.distance) == pytest.approx(r.distance, abs=1e-6) for r in found.collect())
    none = build_signatures(to_df(chunks, "chunk_id").limit(0), str(tmp_path / "n"))
    assert approximate_search(to_df(claims, "claim_id"), none, 5, 0.5, str(tmp_path / "rn")).count() == 0


def _odd_vectors(rng, n, dim=16):
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[n // 2:n // 2 + n // 5] = v[0]  # many copies
    return v


def test_top_k_is_that_of_double_precision():
    from newsevidence.operators.vectorset import TopK, unit_rows

    rng = np.random.default_rng(8)
    q, c = _odd_vectors(rng, 300), _odd_vectors(rng, 900)
    c[:200] = q[0] + rng.normal(size=(200, 16)).astype(np.float32) * 1e-4
    ids = rng.permutation(900)
    for k, limit in ((3, 0.5), (7, 2.0), (60, 0.3)):
        best = TopK(np.arange(300), unit_rows(list(q)), k, limit)
        best.add(ids, unit_rows(list(c)))
        got = {(r.claim_id, r.chunk_id) for r in best.rows().itertuples()}
        distance = (1 - unit_rows(list(q)) @ unit_rows(list(c)).T).astype(np.float32)
        want = {(i, ids[j]) for i in range(300) for j in np.lexsort((ids, distance[i]))[:k] if distance[i, j] <= np.float32(limit)}
        assert len(got ^ want) <= 2  # sums in another order may round a tie the other way


@pytest.mark.parametrize("similarity", [0.5, 0.95])
def test_vectors_are_sent_once_to_a_block_and_probed_pairs_are_compared(spark, tmp_path, similarity):
    from newsevidence.operators import signatures as G
    from newsevidence.operators.vectorset import unit_rows

    rng = np.random.default_rng(9)
    middles = rng.normal(size=(60, 16)) * 2
    c = (middles[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.4).astype(np.float32)
    q = c[:1500] + rng.normal(size=(1500, 16)).astype(np.float32) * 0.1
    to_df = lambda m, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} long, vector array<float>")
    index = G.build_signatures(to_df(c, "chunk_id"), str(tmp_path / "i"), similarity=similarity, recall=0.97)
    plan = index.plan
    assert (plan.tables * plan.probes * 4 < 1 << plan.bits) == (similarity == 0.95)  # both ways to compare
    found = G.approximate_search(to_df(q, "claim_id"), index, 4, 0.3, str(tmp_path / "r"))
    assert spark.read.parquet(f"{index.folder}/chunks").count() == 6000  # once, whatever the number of tables
    assert spark.read.parquet(str(tmp_path / "r/claims")).count() == 1500
    u, w = unit_rows(list(q)), unit_rows(list(c))
    normals = G.planes(plan, 16, index.seed)
    a, b = G._buckets(u, plan, normals), G._buckets(w, plan, normals)
    met = np.zeros((1500, 6000), bool)
    for t in range(plan.tables):
        met |= np.bitwise_count(a[:, t, None] ^ b[None, :, t]) <= plan.flips
    distance = np.where(met, (1 - u @ w.T).astype(np.float32), 9)
    want = {(i, int(j)) for i in range(1500) for j in np.lexsort((np.arange(6000), distance[i]))[:4] if distance[i, j] <= np.float32(0.3)}
    got = {(r.claim_id, r.chunk_id) for r in found.collect()}
    assert len(got ^ want) <= 2 and len(want) > 1500


def test_claims_go_once_to_a_run_of_cells(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(10)
    q, c = rng.normal(size=(200, 16)).astype(np.float32), rng.normal(size=(3000, 16)).astype(np.float32)
    to_df = lambda m, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} long, vector array<float>")
    monkeypatch.setattr(C, "BLOCK_BYTES", 500 * 16 * 4)
    cells = S.build_cells(to_df(c, "chunk_id"), str(tmp_path / "cells"), cell_rows=20)
    hits = C.search_cells(to_df(q, "claim_id"), cells, 5, 1.5, str(tmp_path / "run"))
    assert sorted((r.claim_id, r.chunk_id, r["rank"]) for r in hits.collect()) == brute(q, c, 5, 1.5)
    where = {r.chunk_id: r.cell for r in cells.table(spark, "chunk_id").collect()}
    assert all(where[r.chunk_id] == r.cell for r in hits.collect())
    copies = spark.read.parquet(str(tmp_path / "run/routes"))
    assert len(cells.rows) > 100 and copies.count() <= 200 * (1 + C.blocks_for(3000, 16))  # not one for each cell
    assert spark.read.parquet(str(tmp_path / "run/away")).where("claim_id is not null").count() <= 200


def test_chunks_pass_by_a_block_of_claims_in_pieces(spark, monkeypatch):
    import pandas as pd
    from pyspark.sql import types as T

    monkeypatch.setattr(C, "HELD_BYTES", 100 * 16 * 4)
    claims, chunks, _, c = tables(spark, 40, 2000)
    block = lambda df, key: df.withColumn("block", (F.col(key) % 3).cast("int"))

    def begin(asked, q):
        pieces = []
        total = lambda: pd.DataFrame({"claims": [len(q)], "pieces": [len(pieces)], "largest": [max(n for n, _ in pieces)], "sum": [sum(s for _, s in pieces)]})
        return lambda held, v: pieces.append((held.num_rows, float(v.raw.sum()))), total

    schema = T._parse_datatype_string("claims long, pieces long, largest long, sum double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        got = C.compare_blocks(block(claims, "claim_id"), block(chunks, "chunk_id"), ["block"], 2, begin, 16, schema).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.claims for r in got) == [13, 13, 14]
    assert all(r.pieces > 4 and r.largest <= 130 for r in got)
    assert sum(r["sum"] for r in got) == pytest.approx(float(c.sum()), abs=0.1)
    # What a task holds of wide vectors is a block of claims, however many there are.
    assert all(rows * 3072 * 4 / C.blocks_for(rows, 3072, 5) <= C.CLAIM_BYTES for rows in (50_000, 100_000, 1_000_000))


def test_directions_of_many_wide_claims_are_not_kept(monkeypatch):
    from newsevidence.operators import vectorset as V

    rng = np.random.default_rng(12)
    q, c = _odd_vectors(rng, 300, 96), _odd_vectors(rng, 900, 96)
    ids = rng.permutation(900)
    bag = lambda best: [best.rows().round(5).values.tolist(), best.near is None]
    kept = V.TopK(np.arange(300), V.Units(q), 4, 0.9)
    kept.add(ids, V.Units(c))
    monkeypatch.setattr(V, "NEAR_BYTES", 0)
    monkeypatch.setattr(V, "TILE_BYTES", 96 * 4 * 50)
    again = V.TopK(np.arange(300), V.Units(q), 4, 0.9)
    for a in range(0, 900, 200):
        again.add(ids[a:a + 200], V.Units(c[a:a + 200]))
    assert bag(again) == [bag(kept)[0], True] and not bag(kept)[1] and len(kept.rows()) > 300


def test_many_pivots_in_bounded_memory():
    import tracemalloc

    from pyspark.sql import types as T

    rng = np.random.default_rng(13)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, 16)))
    pivots, claim = unit(20_000), unit(3_000)
    lo, hi = rng.uniform(0, 0.5, 20_000), rng.uniform(0.4, 1.2, 20_000)
    cells = C.Cells("", 16, T.LongType(), pivots, lo, hi, rng.integers(0, 3, 20_000))
    tracemalloc.start()
    try:
        own, angle = C._nearest_pivot(claim, pivots)
        near = C.near_cells(claim[:500], own[:500], np.linspace(0.1, 3.1, 500), cells)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6  # all products of the first step alone are 480 MB
    angles = np.arccos(np.clip(claim[:500] @ pivots.T, -1, 1))
    assert (own[:500] == angles.argmin(axis=1)).all() and np.allclose(angle[:500], angles.min(axis=1))
    reach = np.linspace(0.1, 3.1, 500)[:, None]
    across = np.sqrt(np.maximum(2 - 2 * pivots[own[:500]] @ pivots.T, 1e-30))
    plane = np.arcsin(np.clip((np.cos(angle[:500, None]) - np.cos(angles)) / across, 0, 1))
    want = (np.maximum(np.maximum(angles - hi, lo - angles), plane) <= reach) & (cells.rows > 0) & (own[:500, None] != np.arange(20_000))
    assert (near != want).sum() <= 5 and 0.02 < want.mean() < 0.98  # rounding


def test_hits_are_merged_with_those_of_their_claims_only():
    from newsevidence.operators.vectorset import TopK, Units

    rng = np.random.default_rng(14)
    q, c = rng.normal(size=(50, 8)).astype(np.float32), rng.normal(size=(400, 8)).astype(np.float32)
    names = np.array([f"c{i:03d}" if i % 40 else None for i in range(400)], object)
    for ids in (np.arange(400), names):
        best, some = TopK(np.arange(50), Units(q), 3, 2.0), TopK(np.arange(50), Units(q), 3, 2.0)
        best.add(ids, Units(c))
        for a in range(0, 400, 7):  # claims of one half, then of the other
            for half in (np.arange(25), np.arange(25, 50)):
                some.compare(half, ids[a:a + 7], Units(c[a:a + 7]), np.arange(len(ids[a:a + 7])), None, np.full(7, a, np.int32))
        assert best.rows().drop(columns="tag").equals(some.rows().drop(columns="tag")) and len(best.rows()) == 150
        assert (some.rows()["tag"] % 7 == 0).all() and some.rows()["tag"].max() > 200
