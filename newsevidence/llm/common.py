"""Helpers of the operators: staging in the shared folder, bounded slices, words and hashes as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import stage

#: Space and the control characters from tab to carriage return.
SEPARATORS = " \t\n\x0b\f\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_PIECE = 1 << 20
_BASE = _U(0x9E3779B97F4A7C15)


def run_folder(spark: SparkSession) -> str:
    """A new folder of one run below the folder every executor shares."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str | None = None, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs a re-read."""
    return stage(df, folder or run_folder(df.sparkSession), name)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the plan's input, from file sizes; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, bytes_each: int = 12 << 20) -> int:
    """Number of document buckets so that one holds about ``bytes_each`` of the (compressed) input."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    return max(partitions, -(-size // bytes_each)) if size < 1 << 60 else partitions


def bucket_of(count: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (splitmix64)."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=_U) * _BASE + mix(np.array([seed], _U)))


_TABLE = seeded(256, 1)
_POWERS: list[np.ndarray] = []
_ROOT = _U(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = _U(pow(int(_ROOT), -1, 1 << 64))
        up, down = np.full(n, _ROOT), np.full(n, inverse)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte ranges, 64-bit hashes, first word of each text.

    ``first[i]:first[i + 1]`` are the words of text ``i``. The bytes are read piece by piece, so the extra
    memory per piece is fixed; a single longer word makes its piece longer.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        self.data, base, end = data, int(offsets[0]), int(offsets[-1])
        cuts = offsets.astype(np.int64)
        starts, ends, codes = [], [], []
        at = base
        while at < end:
            stop = min(end, at + _PIECE)
            while stop < end:
                look = _IS_SPACE[data[stop - 1:min(end, stop + _PIECE)]]
                found = int(look.argmax())
                if look[found]:
                    stop = stop + found
                    break
                stop = min(end, stop + _PIECE)
            piece = data[at:stop]
            word = np.zeros(len(piece) + 2, bool)
            np.logical_not(_IS_SPACE[piece], out=word[1:-1])
            begins, over = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
            inner = cuts[(cuts > at) & (cuts < stop)] - at
            begins[inner] |= word[1:-1][inner]
            over[inner - 1] |= word[1:-1][inner - 1]
            s, e = np.flatnonzero(begins), np.flatnonzero(over) + 1
            starts.append(s + at)
            ends.append(e + at)
            if hashes and len(s):
                up, down = _powers(max(_PIECE + 1, len(piece) + 1))
                total = np.zeros(len(piece) + 1, _U)
                np.cumsum((_TABLE[LOWER[piece]] if lower else _TABLE[piece]) * up[:len(piece)], out=total[1:])
                codes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(_U)))
            at = stop
        none = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.codes = np.concatenate(codes) if codes else np.zeros(0, _U)
        self.first = np.searchsorted(self.starts, cuts)

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode()


def words_of(column: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Words of a string column; null texts have none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return Words(data, offsets, lower, hashes)


def grams(codes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``n`` consecutive word codes; position ``i`` starts at word ``i``."""
    count = max(0, len(codes) - n + 1)
    factors = seeded(n, 100 + seed) | _U(1)
    out = np.zeros(count, _U)
    for j in range(n):
        out += codes[j:j + count] * factors[j]
    return mix(out)


def gram_docs(first: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For all gram positions of a batch: their text, and which ones stay inside it."""
    count = max(0, total - n + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:count], (doc[:count] == doc[n - 1:n - 1 + count])


def slices(table: pa.Table | pa.RecordBatch, text: str = "text", bytes_each: int = 4 << 20) -> Iterator:
    """Cut rows into runs of at most about ``bytes_each`` of text; a longer text makes a run of its own."""
    column = table.column(text)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > bytes_each:
            yield table.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield table.slice(start)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
