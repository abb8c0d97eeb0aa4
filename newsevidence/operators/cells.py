"""A chunk table stored by cell, and exact nearest search over it in two rounds.

A cell holds the chunks that are closer to its pivot than to any other. Pivots are taken from the table and grow with
it. The first round looks for a claim's neighbours in the cell it would belong to; the k-th distance found there bounds
how far away better ones can be. In the second round the claim goes to just those other cells that come that near: by
the triangle inequality to the pivot, and by the distance to the plane between the two cells. Both bounds are exact, so
the result is that of a comparison with every chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import small_batches
from ..sources.tables import stage
from .keyed import top_per_key
from .vectorset import TILE_CLAIMS, TopK, Units, in_order, tile_rows, unit_rows, unusable_vector

#: Chunks of a cell on average, and bytes of pivots that every task may hold.
CELL_ROWS = 2_000
PIVOT_BYTES = 64 * 1024 * 1024
#: Rows of one side of a block of comparisons.
BLOCK_CLAIMS = 8_192
BLOCK_CHUNKS = 16_384
#: Where claims go to many cells, both sides are dealt over this many blocks, or more if a block's vectors take more bytes.
LEAST_BLOCKS, BLOCK_BYTES = 8, 160 * 1024 * 1024
#: A task holds one block of claims, with a running list of hits for each, and this much of the chunks that pass by it.
CLAIM_BYTES, HIT_BYTES, HELD_BYTES = 96 * 1024 * 1024, 16, 16 * 1024 * 1024
#: Pairs of claims and cells that are judged at once.
_JUDGED = 1 << 20
#: Folders that cells are dealt over; within one, files are in order of the cell, so row groups of others are skipped.
SHELVES = 512
NAMED_CELLS = 1_000
# Room for the single precision of distances.
_SLACK = 1e-3


@dataclass(frozen=True)
class Cells:
    """A stored layout. ``lo`` and ``hi`` are the least and largest angle to the pivot in each cell, ``rows`` its size."""

    folder: str
    dim: int
    id_type: T.DataType
    pivots: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray

    def table(self, spark: SparkSession, *columns: str) -> DataFrame:
        """The chunk table with ``cell``; only the columns named are read."""
        chunks = spark.read.parquet(f"{self.folder}/chunks")
        return chunks.select("cell", "shelf", *columns) if columns else chunks.drop("angle")

    def part(self, spark: SparkSession, used: list[int], *columns: str) -> DataFrame:
        """The rows of the cells ``used``, as a partition and row-group filter where they are not too many to name."""
        chunks = self.table(spark, *columns)
        if len(used) <= NAMED_CELLS:
            chunks = chunks.where(F.col("shelf").isin(sorted({c % SHELVES for c in used})) & F.col("cell").isin(used))
        return chunks.drop("shelf")


def _nearest_pivot(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell, angle = np.zeros(len(matrix), np.int64), np.zeros(len(matrix))
    step = max(1, _JUDGED // max(1, len(pivots)))
    for a in range(0, len(matrix), step):
        similarity = matrix[a:a + step] @ pivots.T
        cell[a:a + step] = best = similarity.argmax(axis=1)
        angle[a:a + step] = np.arccos(np.clip(similarity[np.arange(len(best)), best], -1.0, 1.0))
    return cell, angle


def common_size(vectors: DataFrame, vector: str = "vector") -> int | None:
    """The commonest length of the vectors that are usable in themselves (ties: the longer); None without any."""
    sizes = vectors.where(unusable_vector(vector).isNull()).groupBy(F.size(vector).alias("n")).count()
    row = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return int(row["n"]) if row else None


def build_cells(chunks: DataFrame, folder: str, dim: int | None = None, cell_rows: int | None = None) -> Cells:
    """Write ``chunks`` (``chunk_id``, ``vector`` and any other columns) by cell below ``folder``.

    Rows without a usable vector of ``dim`` numbers (the commonest size, if none is given) are left out, see
    :func:`vectorset.chunk_vector_rejects`. Each file holds rows of one cell; a cell that very many chunks share is many files, small
    cells are not spread. Row counts and angles per cell are kept beside the pivots.
    """
    spark = chunks.sparkSession
    dim = dim or common_size(chunks) or 1
    good = chunks.where(unusable_vector("vector", dim).isNull())
    most = max(1, PIVOT_BYTES // (8 * dim))
    wanted = min(most, 1 + good.count() // (cell_rows or CELL_ROWS))
    picked = good.select("chunk_id", "vector").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("vector").toPandas()
    pivots = unit_rows(picked["vector"])
    pivots = np.unique(pivots[np.abs(pivots).sum(axis=1) > 0], axis=0) if len(pivots) else pivots
    if not len(pivots):
        pivots = np.eye(1, dim)
    sent = spark.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, angle = _nearest_pivot(unit_rows(batch["vector"]), sent.value)
                yield batch.assign(cell=cell.astype(np.int32), angle=angle)

    schema = T.StructType([*good.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    with small_batches(spark):
        shelve(good.mapInPandas(place, schema), f"{folder}/chunks")
    ring = spark.read.schema("cell int, angle double").parquet(f"{folder}/chunks").groupBy("cell").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
    index = pd.DataFrame({"cell": np.arange(len(pivots), dtype=np.int32), "vector": [v.tolist() for v in pivots]})
    index = spark.createDataFrame(index, "cell int, vector array<double>").join(ring, "cell")
    # The type of ids is kept even where there are no rows.
    stage(index.withColumn("dim", F.lit(dim)).withColumn("chunk_id", F.lit(None).cast(good.schema["chunk_id"].dataType)), folder, "pivots")
    return open_cells(spark, folder)


def shelve(placed: DataFrame, path: str) -> None:
    """Write rows with a ``cell`` by shelf and cell. Rebalancing brings a cell together, but splits a far larger one."""
    shelved = placed.withColumn("shelf", F.pmod("cell", F.lit(SHELVES)).cast("int")).hint("rebalance", "shelf", "cell")
    shelved.sortWithinPartitions("shelf", "cell").write.partitionBy("shelf").mode("overwrite").parquet(path)


def open_cells(spark: SparkSession, folder: str) -> Cells:
    """Read the pivots of a stored layout (PIVOT_BYTES at most); cells without rows are not kept."""
    stored = spark.read.parquet(f"{folder}/pivots")
    id_type, index = stored.schema["chunk_id"].dataType, stored.drop("chunk_id").orderBy("cell").toPandas()
    if not len(index):
        return Cells(folder, 1, id_type, np.zeros((0, 1)), *(np.zeros(0) for _ in range(2)), np.zeros(0, np.int64))
    size = int(index["cell"].max()) + 1
    pivots, lo, hi, rows = np.zeros((size, int(index["dim"][0]))), np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, np.int64)
    at = index["cell"].to_numpy()
    pivots[at], lo[at], hi[at], rows[at] = np.stack(index["vector"]), index["lo"], index["hi"], index["n"]
    return Cells(folder, int(index["dim"][0]), id_type, pivots, lo, hi, rows)


def near_cells(claim: np.ndarray, own: np.ndarray, reach: np.ndarray, cells: Cells, some: np.ndarray | None = None) -> np.ndarray:
    """For claims (rows) and cells: whether the cell, not their own, may hold a chunk within their reach (an angle); of ``some``, if given.

    Angles are compared by their cosines; claims are judged some at a time, so what is held besides the answer is bounded.
    """
    some = np.arange(len(cells.rows)) if some is None else some
    pivots, full = cells.pivots[some], cells.rows[some] > 0
    lo, hi = (np.where(full, x[some], 0.0) for x in (cells.lo, cells.hi))
    out = np.zeros((len(claim), len(some)), bool)
    cos, sin, back = np.cos(hi), np.sin(hi), np.pi - hi
    step = max(1, _JUDGED // 8 // max(1, len(some)))
    for a in range(0, len(claim), step):
        part, home, far = claim[a:a + step], cells.pivots[own[a:a + step]], reach[a:a + step, None]
        similarity = np.clip(part @ pivots.T, -1.0, 1.0)
        # The rings: the angle to the pivot is at most hi + reach, and at least lo - reach.
        near = (similarity >= cos * np.cos(far) - sin * np.sin(far)) | (far >= back)
        if len(lo) and (lo > far.min()).any():
            near &= similarity <= np.cos(np.maximum(lo - far, 0.0))
        # The plane between the own cell and the other; a chunk of the other lies beyond it.
        across = np.sqrt(np.maximum(2.0 - 2.0 * np.clip(home @ pivots.T, -1.0, 1.0), 1e-30))
        ahead = np.clip(np.einsum("ij,ij->i", part, home), -1.0, 1.0)[:, None] - similarity
        near &= (ahead <= across * np.sin(np.minimum(far, np.pi / 2))) | (far >= np.pi / 2)
        out[a:a + step] = near & full & (own[a:a + step, None] != some)
    return out


def _route_home(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: Cells = sent.value
        full = np.flatnonzero(cells.rows > 0)
        for batch in batches:
            if len(batch):
                cell, _ = _nearest_pivot(unit_rows(batch["vector"]), cells.pivots[full])
                yield batch.assign(cell=full[cell].astype(np.int32))

    return run


def blocks_for(rows: int, dim: int, k: int | None = None) -> int:
    """Blocks that ``rows`` vectors are dealt over: a fixed number until these would grow past BLOCK_BYTES.

    For claims, which a task holds with ``k`` hits of each, past CLAIM_BYTES.
    """
    size = -(-rows * dim * 4 // BLOCK_BYTES) if k is None else -(-rows * _claim_bytes(dim, k) // CLAIM_BYTES)
    return max(min(LEAST_BLOCKS, -(-rows // TILE_CLAIMS)), size, 1)


def _claim_bytes(dim: int, k: int) -> int:
    return 4 * dim + HIT_BYTES * k


def _reach(bar: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(1.0 - bar.astype(np.float64), -1.0, 1.0)) + _SLACK


def _route_away(sent, slots: np.ndarray):
    """The slots that each claim has to go to, and at the end, in a row without a claim, the cells that any came near."""
    names, first = np.unique(slots, return_index=True)  # a slot is a run of cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: Cells = sent.value
        used = np.zeros(len(cells.rows), bool)
        step = max(1, min(1024, 16 * _JUDGED // len(used)))
        for batch in batches:
            for low in range(0, len(batch), step):
                part = batch.iloc[low:low + step]
                near = near_cells(unit_rows(part["vector"]), part["cell"].to_numpy(), _reach(part["bar"].to_numpy()), cells)
                used |= near.any(axis=0)
                q, slot = np.nonzero(np.logical_or.reduceat(near, first, axis=1))
                if len(q):
                    rows, ends = np.unique(q, return_index=True)
                    yield part.iloc[rows].assign(slots=np.split(names[slot].astype(np.int32), ends[1:]), used=None)
        if used.any():
            yield pd.DataFrame({"claim_id": [None], "vector": [None], "cell": pd.array([None], "Int32"), "bar": [None], "slots": [None],
                                "used": [np.flatnonzero(used).astype(np.int32)]})

    return run


#: What a block of claims does with chunks: takes a piece of them and their vectors; and its hits at the end, as rows.
Begin = Callable[[pa.Table, Units], tuple[Callable[[pa.Table, Units], None], Callable[[], pd.DataFrame]]]


def compare_blocks(claims: DataFrame, chunks: DataFrame, keys: list[str], parts: int, begin: Begin, dim: int, schema: T.StructType) -> DataFrame:
    """Hits (rows of ``schema``) of each block of claims among the chunks of the same ``keys`` (whole numbers), on ``parts`` partitions.

    A key's claims come before its chunks: a task holds one block of claims, and the chunks pass by in pieces of HELD_BYTES. The number of
    partitions is stated, so that a task never gets many blocks at once, however well they compress.
    """
    sides = [df.withColumnRenamed("vector", name).withColumn("side", F.lit(i)) for i, (df, name) in enumerate(((claims, "asked"), (chunks, "held")))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition(parts, *keys).sortWithinPartitions(*keys, "side")
    out, most = to_arrow_schema(schema), max(1, HELD_BYTES // (4 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, vectors, work = None, [], [], None

        def taken() -> tuple[pa.Table, Units]:
            table, units = pa.Table.from_batches(waiting), Units.of_pieces(vectors, dim)
            waiting.clear()
            return table, units

        def hits() -> Iterator[pa.RecordBatch]:
            if work and waiting:
                work[0](*taken())
            waiting.clear()
            vectors.clear()
            if work and len(found := work[1]()):
                yield from pa.Table.from_pandas(found, schema=out, preserve_index=False).to_batches(max_chunksize=10_000)

        for batch in batches:
            marks = np.stack([batch.column(x).to_numpy() for x in (*keys, "side")], axis=1)
            for a, b in pairwise([0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1), len(marks)] if len(marks) else []):
                if now is None or (marks[a, :-1] != now).any():
                    yield from hits()
                    now, work = marks[a, :-1], None
                if marks[a, -1] and not work:
                    if not waiting:  # chunks that no claim asks for
                        continue
                    work = begin(*taken())
                piece = batch.slice(a, b - a)
                vectors.append(piece.column("held" if work else "asked"))
                # Copied, else the ids would keep the vectors that came with them.
                waiting.append(piece.drop_columns(["asked", "held"]).take(pa.array(np.arange(b - a))))
                if work and sum(map(len, vectors)) >= most:
                    work[0](*taken())
        yield from hits()

    return both.mapInArrow(run, schema)


def _compare_away(away: DataFrame, sent, slots: np.ndarray, used: list[int], k: int, schema: T.StructType) -> DataFrame:
    """Hits of claims in the cells near to them. A slot is a run of cells; a claim is sent once to a slot, not to each cell."""
    cells, spark = sent.value, away.sparkSession
    rows = np.bincount(slots, cells.rows)
    blocks = blocks_for(away.count(), cells.dim, k)
    parts = np.maximum(1, -(-rows.astype(np.int64) * cells.dim * 4 // BLOCK_BYTES))  # a cell of very many copies
    dealt = spark.createDataFrame([(i, int(n)) for i, n in enumerate(parts)], "slot int, parts int")
    slot_of = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(slots), dtype=np.int32), "slot": slots.astype(np.int32)}), "cell int, slot int")
    left = away.select("claim_id", "vector", F.col("cell").alias("own"), "bar", F.explode("slots").alias("slot"),
                       F.pmod(F.xxhash64("claim_id"), F.lit(blocks)).cast("int").alias("block"))
    left = left.join(F.broadcast(dealt), "slot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = cells.part(spark, used, "chunk_id", "vector").join(F.broadcast(slot_of.join(dealt, "slot")), "cell")
    right = right.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts") \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def begin(asked: pa.Table, claims: Units):
        cells: Cells = sent.value
        own = asked.column("own").to_numpy()
        best = TopK(asked.column("claim_id").to_pandas().to_numpy(), claims, k, asked.column("bar").to_numpy())

        def meet(held: pa.Table, chunks: Units) -> None:
            ids, cell = held.column("chunk_id").to_pandas().to_numpy(), held.column("cell").to_numpy()
            by_id = in_order(ids)
            order = by_id[np.argsort(cell[by_id], kind="stable")]
            some, first = np.unique(cell[order], return_index=True)
            last = np.append(first[1:], len(order))
            step = max(1, min(8 * TILE_CLAIMS, 16 * _JUDGED // len(some)))
            for a in range(0, len(claims), step):
                rows = np.arange(a, min(a + step, len(claims)))
                tall = tile_rows(2 * cells.dim, TILE_CLAIMS)
                near = np.concatenate([near_cells(claims.exact(r), own[r], _reach(best.bar[r]), cells, some)
                                       for r in np.split(rows, range(tall, len(rows), tall))])
                if 4 * int(near.sum(axis=0) @ (last - first)) >= len(rows) * len(order):
                    # Most pairs are near: whole tiles are multiplied, all but those of a claim's own cell, which have been compared.
                    best.compare(rows, ids, chunks, by_id, lambda q, c: own[q] != cell[c], cell)
                    continue
                for i in np.flatnonzero(near.any(axis=0)):
                    best.compare(rows[near[:, i]], ids, chunks, order[first[i]:last[i]], None, cell)

        return meet, lambda: best.rows().rename(columns={"tag": "cell"})

    pairs = blocks * int(parts.sum())
    return compare_blocks(left, right, ["slot", "part", "block"], 2 * pairs, begin, cells.dim, schema)


def compare_in_cells(routed: DataFrame, cells: Cells, k: int, schema: T.StructType) -> DataFrame:
    """Hits of routed claims (``claim_id, vector, cell, bar``) in their cells, at most ``k`` per claim and block.

    Both sides of a cell are cut into bounded blocks. The chunk table is read for the cells in use only.
    """
    spark = routed.sparkSession
    most = max(1, min(BLOCK_CLAIMS, CLAIM_BYTES // _claim_bytes(cells.dim, k)))
    used = routed.groupBy("cell").count().toPandas()  # a row per cell at most
    held = cells.rows[used["cell"].to_numpy(int)]
    cut = used.assign(blocks=(-(-used["count"] // most)).astype(np.int32), splits=(-(-held // max(1, min(BLOCK_CHUNKS, BLOCK_BYTES // (4 * cells.dim))))).astype(np.int32))
    size = 4 * cells.dim * int((used["count"] * cut["splits"]).sum() + (held * cut["blocks"]).sum())
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // HELD_BYTES))
    cut = spark.createDataFrame(cut.drop(columns="count"), "cell int, blocks int, splits int")
    claim_side = routed.join(F.broadcast(cut), "cell").withColumn("block", F.pmod(F.xxhash64("claim_id"), F.col("blocks")).cast("int")) \
        .withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("blocks", "splits")
    chunks = cells.part(spark, used["cell"].tolist(), "chunk_id", "vector")
    chunk_side = chunks.join(F.broadcast(cut), "cell").withColumn("split", F.pmod(F.xxhash64("chunk_id"), F.col("splits")).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "splits")

    def begin(asked: pa.Table, claims: Units):
        best = TopK(asked.column("claim_id").to_pandas().to_numpy(), claims, k, asked.column("bar").to_numpy())
        cell = asked.column("cell")[0].as_py()
        return lambda held, chunks: best.add(held.column("chunk_id").to_pandas().to_numpy(), chunks), lambda: best.rows().assign(cell=np.int32(cell))

    return compare_blocks(claim_side, chunk_side, ["cell", "split", "block"], parts, begin, cells.dim, schema)


def slots_of(cells: Cells) -> np.ndarray:
    """The slot of each cell: cells one behind the other, slots of about equal numbers of rows."""
    total = int(cells.rows.sum())
    before = np.cumsum(cells.rows) - cells.rows
    return (before * blocks_for(total, cells.dim) // max(total, 1)).astype(np.int64)


def search_cells(claims: DataFrame, cells: Cells, k: int, max_distance: float, folder: str) -> DataFrame:
    """``claim_id, chunk_id, distance, rank, cell``: the k nearest chunks of each claim within the limit, staged below ``folder``.

    Distance is one minus cosine in single precision, ties go to the smaller chunk id, and a zero vector is at distance 1
    of everything. Claims without a usable vector of the layout's size have no hits. Rows of one ``claim_id`` should be equal.
    The copies of a claim that were made are in ``folder/routes``: ``claim_id, slot``, where the slot of the copy in its own cell is null.
    """
    spark = claims.sparkSession
    schema = T.StructType([T.StructField("claim_id", claims.schema["claim_id"].dataType), T.StructField("chunk_id", cells.id_type),
                           T.StructField("distance", T.FloatType()), T.StructField("cell", T.IntegerType())])
    order = [F.asc("distance"), F.asc("chunk_id")]
    if not len(cells.rows):
        return spark.createDataFrame([], T.StructType([*schema.fields[:3], T.StructField("rank", T.IntegerType()), schema.fields[3]]))
    sent = spark.sparkContext.broadcast(cells)  # PIVOT_BYTES, bounded
    with small_batches(spark):
        good = claims.select("claim_id", "vector").where(unusable_vector("vector", cells.dim).isNull())
        kind = f"claim_id {schema['claim_id'].dataType.simpleString()}, vector {dict(claims.dtypes)['vector']}"
        home = stage(good.mapInPandas(_route_home(sent), f"{kind}, cell int").withColumn("bar", F.lit(float(max_distance)).cast("float")), folder, "home")
        first = stage(top_per_key(compare_in_cells(home, cells, k, schema), ["claim_id"], order, k), folder, "first")
        kth = first.groupBy("claim_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where(F.col("n") >= k).select("claim_id", "kth")
        bounded = home.join(kth, "claim_id", "left").withColumn("bar", F.least("bar", F.coalesce("kth", "bar"))).select("claim_id", "vector", "cell", "bar")
        slots = slots_of(cells)
        routed = stage(bounded.mapInPandas(_route_away(sent, slots), f"{kind}, cell int, bar float, slots array<int>, used array<int>"), folder, "away")
        used = [r[0] for r in routed.select(F.explode("used")).distinct().collect()]  # a row per cell at most
        away = routed.where("slots is not null").drop("used")
        stage(home.select("claim_id", F.lit(None).cast("int").alias("slot")).unionByName(away.select("claim_id", F.explode("slots").alias("slot"))), folder, "routes")
        rest = _compare_away(away, sent, slots, used, k, schema)
        return stage(top_per_key(first.unionByName(rest), ["claim_id"], order, k, rank="rank").select("claim_id", "chunk_id", "distance", "rank", "cell"), folder, "hits")


def with_cell_columns(hits: DataFrame, cells: Cells) -> DataFrame:
    """Fetch the other columns of hit chunks from their cells; vectors are not read, cells without a hit neither."""
    spark = hits.sparkSession
    used = [r["cell"] for r in hits.select("cell").distinct().limit(NAMED_CELLS + 1).collect()]
    chunks = cells.part(spark, used).drop("vector")
    return chunks.join(hits, ["cell", "chunk_id"]).drop("cell")
