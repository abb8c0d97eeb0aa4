"""Approximate nearest search: signatures of random hyperplanes, several buckets probed, distances exact.

A signature says on which side of each plane a vector lies; two vectors at an angle t differ in a bit with probability
t / pi. Each of a few tables puts a chunk into the bucket of its signature. A claim probes its own bucket and those a few
bits away, and is compared exactly with what lies there. How many bits, tables and probes there are follows from the
similarity and the recall asked for. Vectors are stored and sent once with their buckets in all tables, not once per table
or probe; which pairs are probed is settled where a block of claims meets a block of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, comb, log, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from ..sources.tables import stage
from .cells import Cells, blocks_for, common_size, compare_blocks, shelve
from .keyed import top_per_key
from .vectorset import TopK, Units, in_order, unit_rows, unusable_vector

#: Copies of the chunk vectors that may be stored, and chunks of a bucket below which smaller ones don't pay.
MOST_TABLES, BUCKET_ROWS = 8, 64


@dataclass(frozen=True)
class Plan:
    """``tables`` of ``bits`` planes, of which up to ``flips`` are varied in a probe."""

    bits: int
    flips: int
    tables: int
    recall: float

    @property
    def probes(self) -> int:
        return sum(comb(self.bits, i) for i in range(self.flips + 1))


def plan_signatures(rows: int, similarity: float, recall: float, most_tables: int = MOST_TABLES) -> Plan:
    """The cheapest plan that meets a pair of that cosine with probability ``recall``.

    Its cost is the number of chunks a claim is compared with, and a fixed sum for each probe. One bucket for all is
    always among the plans, so there is one for every recall.
    """
    differ = acos(max(-1.0, min(1.0, similarity))) / pi
    best = (float(rows), Plan(0, 0, 1, 1.0))
    for bits in range(1, max(1, (rows // BUCKET_ROWS).bit_length()) + 1):
        for flips in range(bits):
            met = sum(comb(bits, i) * differ**i * (1 - differ) ** (bits - i) for i in range(flips + 1))
            tables = 1 if met >= recall else ceil(log(1 - recall) / log(1 - met)) if met > 0 else most_tables + 1
            if tables > most_tables:
                continue
            plan = Plan(bits, flips, tables, 1 - (1 - met) ** tables)
            cost = tables * plan.probes * (rows / 2**bits + 16)
            if cost < best[0]:
                best = (cost, plan)
    return best[1]


@dataclass(frozen=True)
class Signatures(Cells):
    """A stored index; ``rows[t << bits | bucket]`` is the number of chunks of a bucket in table t. Cells are those of the first table."""

    plan: Plan
    seed: int


def planes(plan: Plan, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((plan.tables, plan.bits, dim))


def _buckets(matrix: np.ndarray, plan: Plan, normals: np.ndarray) -> np.ndarray:
    """Bucket of each vector in each table."""
    sides = matrix @ normals.reshape(-1, matrix.shape[1]).T > 0
    return (sides.reshape(len(matrix), plan.tables, plan.bits).astype(np.int64) << np.arange(plan.bits)).sum(axis=2)


def build_signatures(chunks: DataFrame, folder: str, dim: int | None = None, similarity: float = 0.5, recall: float = 0.95,
                     most_tables: int = MOST_TABLES, seed: int = 11) -> Signatures:
    """Write ``chunks`` (``chunk_id``, ``vector``) with their ``buckets``, by that of the first table, below ``folder``.

    Rows without a usable vector of ``dim`` numbers are left out, as in :func:`cells.build_cells`.
    """
    spark = chunks.sparkSession
    dim = dim or common_size(chunks) or 1
    good = chunks.select("chunk_id", "vector").where(unusable_vector("vector", dim).isNull())
    plan = plan_signatures(good.count(), similarity, recall, most_tables)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normals = planes(plan, dim, seed)
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.iloc[low:low + 2048]
                buckets = _buckets(unit_rows(part["vector"]), plan, normals).astype(np.int32)
                yield part.assign(cell=buckets[:, 0], buckets=list(buckets))

    kinds = [T.StructField("cell", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))]
    with small_batches(spark):
        shelve(good.mapInPandas(place, T.StructType([*good.schema.fields, *kinds])), f"{folder}/chunks")
    rows = np.zeros(plan.tables << plan.bits, np.int64)
    counted = spark.read.schema("buckets array<int>").parquet(f"{folder}/chunks").select(F.posexplode("buckets").alias("t", "b")) \
        .select((F.col("t") * F.lit(1 << plan.bits) + F.col("b")).alias("cell")).groupBy("cell").count().toPandas()  # a row per bucket
    rows[counted["cell"].to_numpy(int)] = counted["count"]
    none = np.zeros(0)
    return Signatures(folder, dim, good.schema["chunk_id"].dataType, none, none, none, rows, plan, seed)


def _compare_probed(plan: Plan, k: int):
    """Of a block of claims: the k nearest of those pairs with chunks that any table's probes let meet."""
    # Where most pairs meet, whole tiles are multiplied and hits looked up; else each bucket with the claims that probe it.
    sparse = plan.tables * plan.probes * 4 < 1 << plan.bits

    def begin(asked: pa.Table, claims: Units):
        buckets = lambda t: t.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, plan.tables)
        mine = buckets(asked)
        bits = np.array([i.bit_count() for i in range(1 << plan.bits)], np.uint8)
        best = TopK(asked.column("claim_id").to_pandas().to_numpy(), claims, k, asked.column("bar").to_numpy())

        def meet(held: pa.Table, chunks: Units) -> None:
            ids, theirs = held.column("chunk_id").to_pandas().to_numpy(), buckets(held)

            def meets(q: np.ndarray, c: np.ndarray) -> np.ndarray:
                met = np.zeros(len(q), bool)
                for t in range(plan.tables):
                    met |= bits[mine[q, t] ^ theirs[c, t]] <= plan.flips
                return met

            if not sparse:
                best.add(ids, chunks, meets)
                return
            order = in_order(ids)
            for t in range(plan.tables):
                at = order[np.argsort(theirs[order, t], kind="stable")]
                first = np.flatnonzero(np.diff(theirs[at, t], prepend=-1))
                for a, b in zip(first, np.append(first[1:], len(at))):
                    asking = np.flatnonzero(bits[mine[:, t] ^ theirs[at[a], t]] <= plan.flips)
                    best.compare(asking, ids, chunks, at[a:b], lambda q, c: _first_met(bits, mine, theirs, plan, t, q, c))

        return meet, lambda: best.rows().drop(columns="tag")

    return begin


def _first_met(bits: np.ndarray, mine: np.ndarray, theirs: np.ndarray, plan: Plan, table: int, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Pairs that no table before this one has let meet: a chunk met in several tables is the same hit."""
    new = np.ones(len(q), bool)
    for t in range(table):
        new &= bits[mine[q, t] ^ theirs[c, t]] > plan.flips
    return new


def approximate_search(claims: DataFrame, index: Signatures, k: int, max_distance: float, folder: str) -> DataFrame:
    """``claim_id, chunk_id, distance, rank``: the nearest chunks found, staged below ``folder``.

    Distances are exact, in single precision; ties go to the smaller chunk id. A chunk as near as the index was planned
    for is found with its recall, nearer ones more often. Claims without a usable vector have no hits. Claims and chunks
    are dealt over blocks; each vector is sent once to each block of the other side.
    """
    spark, plan = claims.sparkSession, index.plan
    schema = T.StructType([T.StructField("claim_id", claims.schema["claim_id"].dataType), T.StructField("chunk_id", index.id_type),
                           T.StructField("distance", T.FloatType())])
    total = int(index.rows.sum()) // plan.tables
    if not total:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    dim, seed = index.dim, index.seed

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        normals = planes(plan, dim, seed)
        for batch in batches:
            for low in range(0, len(batch), 2048):
                part = batch.iloc[low:low + 2048]
                yield part.assign(buckets=list(_buckets(unit_rows(part["vector"]), plan, normals).astype(np.int32)))

    good = claims.select("claim_id", "vector").where(unusable_vector("vector", dim).isNull())
    kind = f"claim_id {schema['claim_id'].dataType.simpleString()}, vector {dict(claims.dtypes)['vector']}, buckets array<int>"
    with small_batches(spark):
        signed = stage(good.mapInPandas(sign, kind).withColumn("bar", F.lit(float(max_distance)).cast("float")), folder, "claims")
    across, down = blocks_for(signed.count(), dim, k), blocks_for(total, dim)
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = signed.withColumn("block", deal("claim_id", across)).withColumn("part", each(down))
    right = index.table(spark, "chunk_id", "vector", "buckets").drop("cell", "shelf").withColumn("part", deal("chunk_id", down)).withColumn("block", each(across))
    hits = compare_blocks(left, right, ["block", "part"], 2 * across * down, _compare_probed(plan, k), dim, schema)
    hits = hits.dropDuplicates(["claim_id", "chunk_id"])
    with small_batches(spark):
        return stage(top_per_key(hits, ["claim_id"], [F.asc("distance"), F.asc("chunk_id")], k, rank="rank"), folder, "hits")


def recall_report(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row ``n_exact, n_found, recall``: how many of the exact hits were found, per pair of claim and chunk."""
    pairs = exact.select("claim_id", "chunk_id").join(found.select("claim_id", "chunk_id", F.lit(1).alias("hit")), ["claim_id", "chunk_id"], "left")
    return pairs.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn(
        "recall", F.when(F.col("n_exact") > 0, F.col("n_found") / F.col("n_exact")))
