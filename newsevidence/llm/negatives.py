"""Hard negatives by exact integer inner products, several candidates to a multiplication.

Components are scaled to integers. Those of a few candidates are biased to be non-negative and put into separated fields
of one integer; it is multiplied once per anchor component, and the fields of the sum, less what the biases add, are the
candidates' scores. The integers have 53 bits and are held as doubles, so a block of products is one matrix product, in
which every step is exact. Where 53 bits are too few for one field, plain 64-bit integers are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import run_folder, staged

#: Bytes of anchors that tasks hold at a time; more anchors take more scans of the candidates.
ANCHOR_BYTES = 32 << 20
#: Scaled components are cut off here, so that sums fit 64 bits.
LARGEST = 1 << 27
_BLOCK, _COMPONENTS, _ANCHORS, _LAST, _LOW = 1 << 14, 1 << 21, 128, (1 << 63) - 1, -(1 << 62)


def field_bits(size: int, reach: int) -> int:
    """Bits of a field that holds a sum of ``size`` products of two components biased from -reach..reach."""
    return max(1, (size * (2 * reach) ** 2).bit_length())


class Packed:
    """A block of candidates (rows of ``parts``), packed into fields."""

    def __init__(self, parts: np.ndarray, reach: int):
        self.rows, size = parts.shape
        self.parts, self.reach = parts, reach
        self.bits = field_bits(size, reach)
        self.fields = 53 // self.bits
        if self.fields:
            self.width = -(-self.rows // self.fields)
            biased = np.zeros((self.width * self.fields, size))
            biased[:self.rows] = parts + reach
            self.wide = np.zeros((self.width, size))
            for k in reversed(range(self.fields)):
                self.wide = self.wide * float(1 << self.bits) + biased[k * self.width:(k + 1) * self.width]
            self.wide = np.ascontiguousarray(self.wide.T)
            self.sums = parts.sum(axis=1)

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products of anchors (rows) with all candidates of the block."""
        if not self.fields:
            return anchors @ self.parts.T
        total = (anchors + self.reach).astype(np.float64) @ self.wide
        found, step = [], float(1 << self.bits)
        for _ in range(self.fields):
            rest = np.floor(total / step)
            found.append(total - rest * step)
            total = rest
        out = np.concatenate(found, axis=1)[:, :self.rows].astype(np.int64)
        out -= (self.reach * anchors.sum(axis=1))[:, None] + self.parts.shape[1] * self.reach**2
        out -= (self.reach * self.sums)[None, :]
        return out


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each row, in order; ties by place."""
    n = scores.shape[1]
    if n > 4 * k and int(np.abs(np.where(scores == _LOW, 0, scores)).max(initial=0)) < (1 << 62) // n:
        key = np.where(scores == _LOW, _LOW, scores * n) + np.arange(n - 1, -1, -1)
        at = np.argpartition(key, n - k, axis=1)[:, n - k:]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1), 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


class _Best:
    """The best rows so far of each of ``n`` lists of ``k`` places."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.seq = np.full((n, k), _LOW), np.full((n, k), _LAST), np.full((n, k), _LAST)

    def add(self, span: slice, scores: np.ndarray, ids: np.ndarray, seqs: np.ndarray) -> None:
        """Offer the rows of a block, which are in order of id and row number."""
        at = _first(scores, self.k)
        score = np.concatenate((self.score[span], np.take_along_axis(scores, at, 1)), axis=1)
        id_, seq = np.concatenate((self.id[span], ids[at]), axis=1), np.concatenate((self.seq[span], seqs[at]), axis=1)
        order = np.lexsort((seq, id_, -score), axis=1)[:, :self.k]
        self.score[span], self.id[span], self.seq[span] = (np.take_along_axis(x, order, 1) for x in (score, id_, seq))

    def rows(self, anchors: np.ndarray, turn: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(self.score > _LOW)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors[row]), pa.array(turn[row]), pa.array(self.id[row, place]), pa.array(self.seq[row, place]), pa.array(self.score[row, place])],
            names=["anchor", "turn", "id", "seq", "score"])


_FOUND = "anchor long, turn int, id long, seq long, score long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(64, min(_BLOCK, _COMPONENTS // len(batch.column("parts")[0])))
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            matrix = _matrix(part.column("parts"))
            id_, seq, label = (part.column(c).to_numpy() for c in ("id", "seq", "label"))
            order = np.lexsort((seq, id_))
            yield id_[order], seq[order], label[order], matrix[order]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _positives(sent, reach: int, k: int):
    """The first rows of the anchor's label, its own left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, labels, parts = sent.value[:3]
        best = _Best(len(seqs), k)
        for id_, seq, label, matrix in _blocks(batches):
            block = Packed(matrix, reach)
            place = {s: i for i, s in enumerate(seq.tolist())}
            for low in range(0, len(seqs), _ANCHORS):
                span = slice(low, min(len(seqs), low + _ANCHORS))
                scores = np.where(labels[span, None] == label[None, :], block.scores(parts[span]), _LOW)
                for i, s in enumerate(seqs[span].tolist()):
                    if s in place:
                        scores[i, place[s]] = _LOW
                best.add(span, scores, id_, seq)
        yield best.rows(seqs, np.zeros(len(seqs), np.int32))

    return run


def _negatives(sent, reach: int, k: int, low_percent: int, high_percent: int):
    """For each positive, the first rows of other labels whose score lies in the band below the positive's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, labels, parts, at, turn, score = sent.value
        # The band of whole scores, in integers of any size.
        least = np.array([max(_LOW + 1, -(-low_percent * s // 100)) for s in score.tolist()], np.int64)
        most = np.array([high_percent * s // 100 for s in score.tolist()], np.int64)
        best = _Best(len(at), k)
        for id_, seq, label, matrix in _blocks(batches):
            block = Packed(matrix, reach)
            for low in range(0, len(seqs), _ANCHORS):
                end = min(len(seqs), low + _ANCHORS)
                scores = np.where(labels[low:end, None] != label[None, :], block.scores(parts[low:end]), _LOW)
                a, b = np.searchsorted(at, [low, end])  # positives are in order of their anchor
                for first in range(a, b, _ANCHORS):
                    span = slice(first, min(b, first + _ANCHORS))
                    own = scores[at[span] - low]
                    inside = (own >= least[span, None]) & (own <= most[span, None])
                    best.add(span, np.where(inside, own, _LOW), id_, seq)
        yield best.rows(seqs[at], turn)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` over all tasks; each task sends at most ``k`` rows per list."""
    order = W.partitionBy("anchor", "turn").orderBy(F.desc("score"), "id", "seq")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, scale: int = 256,
                   low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` (a condition on the columns of ``rows``) is true.

    ``rows`` has ``vec_id, label, vector``; more columns are ignored. Component x becomes floor(scale * x), a score is an
    integer inner product; higher scores come first, ties by smaller ``vec_id``. An anchor's positives are its first
    ``positives`` other rows of the same label. For each, the first ``negatives`` rows of other labels come out for which
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score. Returns ``anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null label, a null vector or a null or non-finite component take no part; a shorter vector counts as
    followed by zeros, and an empty or zero one has score 0. Every row stands for itself: one that repeats another is an
    anchor and a candidate of its own, whose twin is another row. A null id comes last and is given as null. Scaled
    components beyond 2**27 count as 2**27. An empty table or one without anchors gives an empty result. Candidates are
    scanned in place, once per ``ANCHOR_BYTES`` of anchors and phase, and never shuffled.
    """
    spark, folder = rows.sparkSession, run_folder(rows.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    base = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_LAST)).alias("id"), F.col("label").cast("long").alias("label"),
                       F.col("vector").cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    base = base.where(F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False)))
    whole = F.transform("vector", lambda x: F.greatest(F.least(F.floor(x * float(scale)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    base = staged(base.select(F.monotonically_increasing_id().alias("seq"), "id", "label", "asks", whole.alias("parts")), folder, "parts")
    about = base.agg(F.max(F.size("parts")).alias("size"), F.max(F.greatest(F.abs(F.array_max("parts")), F.abs(F.array_min("parts")))).alias("reach"),
                     F.count(F.when(F.col("asks"), 1)).alias("anchors")).first()
    size, reach = max(1, about["size"] or 0), max(1, about["reach"] or 0)
    padded = F.concat("parts", F.array_repeat(F.lit(0), F.lit(size) - F.size("parts")))
    same = base.withColumn("parts", padded)
    every = same.select("seq", "id", "label", "parts")
    rounds = max(1, -(-about["anchors"] * (size * 8 + 256) // ANCHOR_BYTES))
    out = None
    for turn in range(rounds):
        asking = same.where("asks").where(F.pmod(F.xxhash64("seq"), F.lit(rounds)) == turn).orderBy("seq")
        held = asking.select("seq", "id", "label", "parts").toArrow()  # bounded by ANCHOR_BYTES
        if not held.num_rows:
            continue
        seqs, labels, matrix = held.column("seq").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("parts"))
        sent = spark.sparkContext.broadcast((seqs, labels, matrix))
        near = staged(_ranked(every.mapInArrow(_positives(sent, reach, positives), _FOUND), positives), folder, f"positives{turn}")
        lists = near.select("anchor", "rank", "score").orderBy("anchor", "rank").toArrow()  # so is this
        at = np.searchsorted(seqs, lists.column("anchor").to_numpy())
        more = spark.sparkContext.broadcast((seqs, labels, matrix, at, lists.column("rank").to_numpy().astype(np.int32), lists.column("score").to_numpy()))
        found = _ranked(every.mapInArrow(_negatives(more, reach, negatives, low_percent, high_percent), _FOUND), negatives)
        known = near.select("anchor", F.col("rank").alias("turn"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
        named = found.join(known, ["anchor", "turn"]).join(asking.select(F.col("seq").alias("anchor"), F.col("id").alias("asked")), "anchor")
        shown = lambda c: F.when(F.col(c) != _LAST, F.col(c))
        part = staged(named.select(shown("asked").alias("anchor_id"), shown("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                   shown("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), folder, f"negatives{turn}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
