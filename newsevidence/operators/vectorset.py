"""Vectors inside tasks: unit rows, the running k nearest, and which vectors can't be used."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tile of the distance matrix held at a time: 16 MiB in single precision, less where the vectors of a side would pass TILE_BYTES.
TILE_CLAIMS = 1_024
TILE_CHUNKS = 4_096
TILE_BYTES = 16 * 1024 * 1024
# Directions of claims are kept up to this size; those of more claims are made again for every tile.
NEAR_BYTES = 32 * 1024 * 1024
# Places of claims and chunks that are judged at once.
_PAIRS = 1 << 18
#: For places of claims and of chunks: which of these pairs are to be compared.
Meets = Callable[[np.ndarray, np.ndarray], np.ndarray]


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """A matrix of the vectors, scaled to length one; zero vectors stay zero."""
    if not len(vectors):
        return np.zeros((0, 1))
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def unusable_vector(vector: str = "vector", dim: int | None = None) -> Column:
    """Why a vector can't be searched with or for; null where it can."""
    found = (
        F.when(F.col(vector).isNull(), F.lit("vector is missing"))
        .when(F.size(vector) == 0, F.lit("vector is empty"))
        .when(F.exists(vector, lambda x: x.isNull()), F.lit("vector has missing numbers"))
        .when(F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit("vector has numbers that are not finite"))
    )
    if dim is None:
        return found
    return found.when(F.size(vector) != dim, F.concat(F.lit("vector has "), F.size(vector).cast("string"), F.lit(f" numbers, not {dim}")))


def claim_vector_rejects(claims: DataFrame, dim: int | None = None) -> DataFrame:
    """``(claim_id, reject_reason)`` of claims that a search leaves out; ``dim`` is the size it expects."""
    return claims.select("claim_id", unusable_vector("vector", dim).alias("reject_reason")).filter("reject_reason is not null")


def chunk_vector_rejects(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """``(chunk_id, reject_reason)`` of chunks that no search can find."""
    return chunks.select("chunk_id", unusable_vector("vector", dim).alias("reject_reason")).filter("reject_reason is not null")


def in_order(ids: np.ndarray) -> np.ndarray:
    """Places in order of the ids; nulls come last."""
    return pd.Series(ids).sort_values(kind="stable").index.to_numpy()


def tile_rows(dim: int, most: int) -> int:
    """Rows of a tile: ``most``, or as many vectors of ``dim`` numbers as take TILE_BYTES in single precision."""
    return max(1, min(most, TILE_BYTES // (4 * max(dim, 1))))


class Units:
    """Vectors of a block with their lengths; directions are made tile by tile, in the precision asked for."""

    def __init__(self, raw: np.ndarray, norms: np.ndarray | None = None):
        self.raw = raw
        if norms is None:
            step = tile_rows(raw.shape[1], TILE_CHUNKS)
            norms = np.concatenate([np.zeros(0), *(np.linalg.norm(raw[a:a + step].astype(np.float64), axis=1) for a in range(0, len(raw), step))])
        self.norms = np.where(norms > 0, norms, 1.0)

    @classmethod
    def of_pieces(cls, pieces: list[pa.Array], dim: int) -> Units:
        """Of Arrow arrays of usable vectors of ``dim`` numbers. The list is emptied, so that no vector is held twice for long."""
        raw = np.zeros((sum(len(p) for p in pieces), dim), pieces[0].type.value_type.to_pandas_dtype() if pieces else np.float32)
        at = 0
        for i, piece in enumerate(pieces):
            raw[at:at + len(piece)] = piece.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            at, pieces[i], piece = at + len(piece), None, None
        pieces.clear()
        return cls(raw)

    def __len__(self) -> int:
        return len(self.raw)

    def exact(self, rows: np.ndarray | slice) -> np.ndarray:
        return self.raw[rows].astype(np.float64) / self.norms[rows, None]

    def single(self, rows: np.ndarray | slice) -> np.ndarray:
        """Divided in double precision and rounded once."""
        raw = self.raw[rows]
        return np.divide(raw, self.norms[rows, None], out=np.empty(raw.shape, np.float32), dtype=np.float64, casting="same_kind")


class TopK:
    """Running k nearest chunks of a block of claims: distance first, then chunk id.

    Works on tiles, so the distance matrix stays small however many claims and chunks a task holds. Products are made in
    single precision first; what they leave in question, by a bound on their error, is computed in double. ``limit`` is the
    largest distance that counts, one number or one per claim. A tile's hits are merged with those of its claims only.
    """

    def __init__(self, claim_ids: np.ndarray, claims: np.ndarray | Units, k: int, limit: float | np.ndarray):
        self.claim_ids, self.k = claim_ids, k
        self.claims = claims if isinstance(claims, Units) else Units(claims, np.ones(len(claims)))
        self.dim = self.claims.raw.shape[1]
        self.near: np.ndarray | None = None
        if len(self.claims) * self.dim * 4 <= NEAR_BYTES:
            self.near = self.claims.single(slice(None))
        self.bar = np.broadcast_to(np.asarray(limit, dtype=np.float32), len(claim_ids)).copy()
        # Rounding of both factors and of each sum of products, each sum being 1 at most; and that of the distance.
        self.slack = (self.dim + 8) * 2.0**-24 + 1e-6
        # The best of each claim in order: the first ``count`` places of its row.
        self.count = np.zeros(len(claim_ids), np.int64)
        self.distance = np.empty((len(claim_ids), k), np.float32)
        self.chunk_id = np.empty((len(claim_ids), k), np.int64)
        self.tag = np.empty((len(claim_ids), k), np.int32)

    def add(self, chunk_ids: np.ndarray, chunks: np.ndarray | Units, meets: Meets | None = None) -> None:
        """Compare all claims with more chunks; of the pairs only those that ``meets`` lets through, if given."""
        chunks = chunks if isinstance(chunks, Units) else Units(chunks, np.ones(len(chunks)))
        self.compare(np.arange(len(self.claim_ids)), chunk_ids, chunks, in_order(chunk_ids), meets)

    def compare(self, claims: np.ndarray, chunk_ids: np.ndarray, chunks: Units, at: np.ndarray, meets: Meets | None = None,
                tags: np.ndarray | None = None) -> None:
        """Compare some claims (places) with chunks (places, in order of their ids); ``tags`` are kept with the hits."""
        wide, tall = tile_rows(self.dim, TILE_CHUNKS), tile_rows(self.dim, TILE_CLAIMS)
        for c0 in range(0, len(at) if len(claims) else 0, wide):
            some = at[c0:c0 + wide]
            tile = chunks.single(some).T
            for q0 in range(0, len(claims), tall):
                rows = claims[q0:q0 + tall]
                near = self.claims.single(rows) if self.near is None else self.near[rows]
                q, c, distance = self._within(rows, near @ tile, chunks, some, meets)
                if len(q):
                    self._keep(q, chunk_ids[c], distance, np.zeros(len(c), np.int32) if tags is None else tags[c])

    def _within(self, rows: np.ndarray, sim: np.ndarray, chunks: Units, at: np.ndarray, meets: Meets | None):
        """Claims, chunks and distances of the pairs of a tile that may be among the k nearest."""
        mask = sim >= (1.0 - self.bar[rows] - self.slack).astype(np.float32)[:, None]
        q, c = np.divmod(np.flatnonzero(mask), len(at))
        n = np.bincount(q, minlength=len(rows))
        over = np.flatnonzero(n > self.k)
        found = []
        if len(over):
            step = max(1, _PAIRS // len(at)) if meets is not None else len(over)
            for a in range(0, len(over), step):
                some = over[a:a + step]
                if meets is not None:
                    mask[some] &= meets(np.repeat(rows[some], len(at)), np.tile(at, len(some))).reshape(len(some), -1)
                close = np.where(mask[some], sim[some], np.float32(-9))
                kth = -np.partition(-close, self.k - 1, axis=1)[:, self.k - 1]
                mask[some] &= close >= (kth - 2 * self.slack)[:, None]
                n[some] = np.count_nonzero(mask[some], axis=1)
            # Very many that near: copies. Of equal distances the first k chunk ids are enough.
            wide = np.flatnonzero(n > 8 * self.k + 32)
            if len(wide):
                exact = chunks.exact(at).T
                step = tile_rows(2 * self.dim, len(wide))
                for a in range(0, len(wide), step):
                    some = wide[a:a + step]
                    d = (1.0 - self.claims.exact(rows[some]) @ exact).astype(np.float32)
                    d[~mask[some]] = np.inf
                    kth = np.partition(d, self.k - 1, axis=1)[:, self.k - 1:self.k]
                    tie = d == kth
                    w, c = np.nonzero(((d < kth) | (tie & (np.cumsum(tie, axis=1) <= self.k))) & np.isfinite(d))
                    found.append((rows[some[w]], at[c], d[w, c]))
                mask[wide] = False
            q, c = np.divmod(np.flatnonzero(mask), len(at))
        q, c = rows[q], at[c]
        if meets is not None and len(q):
            met = meets(q, c)
            q, c = q[met], c[met]
        step = max(1, (1 << 20) // self.dim)
        for a in range(0, len(q), step):
            b = slice(a, a + step)
            found.append((q[b], c[b], (1.0 - np.einsum("ij,ij->i", self.claims.exact(q[b]), chunks.exact(c[b]))).astype(np.float32)))
        if not found:
            return q, c, np.zeros(0, np.float32)
        q, c, distance = (np.concatenate(x) for x in zip(*found))
        good = distance <= self.bar[q]
        return q[good], c[good], distance[good]

    def _keep(self, q: np.ndarray, chunk_id: np.ndarray, distance: np.ndarray, tag: np.ndarray) -> None:
        if self.chunk_id.dtype != chunk_id.dtype:  # ids of another type: strings, or numbers with nulls among them
            both = np.result_type(self.chunk_id, chunk_id) if self.count.any() else chunk_id.dtype
            self.chunk_id = self.chunk_id.astype(both)
        hit, at = np.unique(q, return_inverse=True)
        known = self.count[hit]
        old = np.repeat(np.arange(len(hit)), known)
        place = np.arange(len(old)) - np.repeat(np.cumsum(known) - known, known)
        joined = lambda kept, new: np.concatenate([kept[hit[old], place], new])
        at, distance, chunk_id, tag = np.concatenate([old, at]), joined(self.distance, distance), joined(self.chunk_id, chunk_id), joined(self.tag, tag)
        if chunk_id.dtype == object:
            order = pd.DataFrame({"q": at, "distance": distance, "chunk_id": chunk_id}).sort_values(["q", "distance", "chunk_id"], kind="stable").index.to_numpy()
        else:
            order = np.lexsort((chunk_id, distance, at))
        at, many = at[order], np.bincount(at, minlength=len(hit))
        place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        good = place < self.k
        at, place, order = hit[at[good]], place[good], order[good]
        self.distance[at, place], self.chunk_id[at, place], self.tag[at, place] = distance[order], chunk_id[order], tag[order]
        self.count[hit] = np.minimum(many, self.k)
        full = hit[many >= self.k]
        self.bar[full] = self.distance[full, self.k - 1]

    def rows(self) -> pd.DataFrame:
        q, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        return pd.DataFrame({"claim_id": self.claim_ids[q], "chunk_id": self.chunk_id[q, place], "distance": self.distance[q, place],
                             "tag": self.tag[q, place]})
