"""Semantic chunks of any number of documents, cut and pooled while an embedder's batches pass by.

Sentences of consecutive documents fill a model batch together. A document's open chunk, and the sentences that the next
one may overlap with, are all that is held of its vectors; a chunk leaves as soon as it is cut, with the mean of its
sentences' vectors. So no sentence vector is ever a column, shuffled or gathered, whatever their size.

A call that fails is repeated document by document. One that fails again makes its document fall back to fixed runs, with an
error beside its rows; all others are as without it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import EMBED_BATCH, Embedder, digest_matrix

# Defaults of the two chunking modes.
FIXED_SENTENCES = 4
SIMILARITY = 0.65
MIN_SENTENCES = 2
MAX_SENTENCES = 8
MAX_TOKENS = 400
OVERLAP = 1
SEMANTIC_FROM = 10
#: Bytes of vectors after which rows are handed over, and after which a document's chunks no longer wait for its end.
SLICE_BYTES, HELD_BYTES = 8 << 20, 64 << 20

_RESULT = (
    "chunk_index int, text string, vector array<double>, start int, end int, overlap_count int, "
    "boundaries array<int>, semantic boolean, error string"
)


def hash_embedder(dim: int) -> Embedder:
    """The deterministic embedding as a model."""
    return lambda texts: digest_matrix(texts, dim)


class Cutter:
    """The greedy rule over a stream: a chunk ends at a boundary, or when it is full, once it has its minimum.

    ``push`` takes a sentence with its vector and whether it is a boundary (unlike the one before), and gives the chunk
    that it closes, if any. A boundary met while the chunk is below its minimum is lost.
    """

    def __init__(self, min_sentences: int, max_sentences: int, max_tokens: int, overlap: int):
        self.rule = (min_sentences, max_sentences, max_tokens)
        self.overlap = max(0, overlap)
        self.start = self.at = self.chars = 0
        self.texts: deque[str] = deque()
        self.vectors: deque[np.ndarray] = deque()
        self.opened = 0
        self.marks: list[int] = []

    def push(self, text: str, vector: np.ndarray, boundary: bool) -> tuple | None:
        low, high, tokens = self.rule
        count = self.at - self.start
        closed = None
        if count and count >= low and (boundary or count >= high or self.chars // 4 > tokens):
            closed = self._close()
        if boundary:
            self.marks.append(self.at)
        self.texts.append(text)
        self.vectors.append(vector)
        self.at += 1
        self.chars += len(text)
        return closed

    def finish(self) -> tuple | None:
        return self._close() if self.at > self.start else None

    def _close(self) -> tuple:
        chunk = (" ".join(self.texts), np.mean(np.stack(self.vectors), axis=0), self.opened, self.at, self.start - self.opened, self.marks)
        self.start, self.chars, self.marks = self.at, 0, []
        self.opened = max(self.at - self.overlap, self.opened)
        while len(self.texts) > self.at - self.opened:
            self.texts.popleft()
            self.vectors.popleft()
        return chunk


def fixed_runs(sentences: list[str], size: int = FIXED_SENTENCES) -> list[tuple[str, int, int]]:
    """Runs of ``size`` sentences with their place; the last may be shorter."""
    return [(" ".join(sentences[a:a + size]), a, min(a + size, len(sentences))) for a in range(0, len(sentences), size)]


class _Document:
    """One row on its way through the batches."""

    def __init__(self, row: int, sentences: list[str], semantic: bool, cutter: Cutter):
        self.row, self.sentences, self.semantic = row, sentences, semantic
        self.runs = [] if semantic else fixed_runs(sentences)
        self.items = sentences if semantic else [t for t, _, _ in self.runs]
        self.cutter, self.seen, self.sent, self.committed = cutter, 0, 0, 0
        self.before: np.ndarray | None = None
        self.size: int | None = None
        self.done: list[tuple] = []
        self.error: str | None = None

    def take(self, vectors: np.ndarray, threshold: float) -> None:
        if vectors.shape[1] != (self.size or vectors.shape[1]):
            raise ValueError("vectors must be equally long")
        self.size = vectors.shape[1]
        if not self.semantic:
            for v in vectors:
                text, a, b = self.runs[self.seen]
                self.done.append((text, v, a, b, 0, [], False))
                self.seen += 1
            return
        first = vectors[:1] if self.before is None else self.before[None]
        every = np.concatenate((first, vectors))
        norms = np.linalg.norm(every, axis=1)
        scale = norms[1:] * norms[:-1]
        dots = np.einsum("ij,ij->i", every[1:], every[:-1])
        unlike = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0) < threshold
        for v, far in zip(vectors, unlike.tolist()):
            closed = self.cutter.push(self.sentences[self.seen], v, far or self.seen == 0)
            if closed:
                self.done.append((*closed, True))
            self.seen += 1
        self.before = vectors[-1]
        if self.seen == len(self.sentences) and (closed := self.cutter.finish()):
            self.done.append((*closed, True))


def _as_matrix(found, count: int) -> np.ndarray:
    if len(found) != count:
        raise ValueError(f"embedding count mismatch: expected {count} got {len(found)}")
    matrix = np.asarray(found, dtype=np.float64)
    if matrix.ndim != 2:
        raise ValueError("vectors must be equally long")
    return matrix


class _Stream:
    """Documents in, result rows out, in order."""

    def __init__(self, embedder: Embedder, batch: int, threshold: float, emit: Callable[[int, list[tuple]], None]):
        self.embedder, self.batch, self.threshold, self.emit = embedder, batch, threshold, emit
        self.pending: deque[tuple[_Document, str]] = deque()
        self.open: deque[_Document] = deque()

    def add(self, doc: _Document) -> None:
        self.open.append(doc)
        self.pending.extend((doc, t) for t in doc.items)
        while len(self.pending) >= self.batch:
            self._call(self.batch)

    def finish(self) -> None:
        while self.pending:
            self._call(self.batch)
        self._settle()

    def _call(self, n: int) -> None:
        part = [self.pending.popleft() for _ in range(min(n, len(self.pending)))]
        groups: list[tuple[_Document, list[str]]] = []
        for doc, text in part:
            if doc.error is None:
                if not groups or groups[-1][0] is not doc:
                    groups.append((doc, []))
                groups[-1][1].append(text)
        texts = [t for _, g in groups for t in g]
        try:
            vectors = _as_matrix(self.embedder(texts), len(texts)) if texts else None
        except Exception:  # which document it was is found out below
            vectors = None
        at = 0
        for doc, g in groups:
            try:
                own = vectors[at:at + len(g)] if vectors is not None else _as_matrix(self.embedder(g), len(g))
                doc.take(own, self.threshold)
            except Exception as e:
                doc.error = f"{type(e).__name__}: {e}"
            at += len(g)
        self._settle()

    def _fall_back(self, doc: _Document) -> list[tuple]:
        """Fixed runs of what has not been handed over, embedded by themselves; one that fails again has no vector."""
        begin = doc.committed
        runs = [(t, a + begin, b + begin) for t, a, b in fixed_runs(doc.sentences[begin:])]
        vectors: list[np.ndarray | None] = []
        for low in range(0, len(runs), self.batch):
            texts = [t for t, _, _ in runs[low:low + self.batch]]
            try:
                vectors += list(_as_matrix(self.embedder(texts), len(texts)))
            except Exception:
                vectors += [self._alone(t) for t in texts]
        return [(t, v, a, b, 0, [], False) for (t, a, b), v in zip(runs, vectors)]

    def _alone(self, text: str) -> np.ndarray | None:
        try:
            return _as_matrix(self.embedder([text]), 1)[0]
        except Exception:
            return None

    def _settle(self) -> None:
        while self.open:
            doc = self.open[0]
            if doc.error is not None:
                self._hand_over(doc, self._fall_back(doc))
                self.open.popleft()
            elif doc.seen == len(doc.items):
                self._hand_over(doc, doc.done)
                self.open.popleft()
            else:
                if doc.semantic and doc.done and len(doc.done) * (doc.size or 1) * 8 > HELD_BYTES:
                    self._hand_over(doc, doc.done)
                    doc.committed, doc.done = doc.done[-1][3], []
                return

    def _hand_over(self, doc: _Document, rows: list[tuple]) -> None:
        self.emit(doc.row, [(doc.sent + i, *r, doc.error) for i, r in enumerate(rows)])
        doc.sent += len(rows)


def _batch_of(source: pa.RecordBatch, kept: list[str], rows: list[tuple[int, tuple]]) -> pa.RecordBatch:
    at = pa.array([r for r, _ in rows], pa.int64())
    index, text, vector, start, end, overlap, marks, semantic, error = zip(*(x for _, x in rows))
    kinds = [pa.int32(), pa.string(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.string()]
    columns = [pa.array(c, k) for c, k in zip((index, text, vector, start, end, overlap, marks, semantic, error), kinds)]
    names = ["chunk_index", "text", "vector", "start", "end", "overlap_count", "boundaries", "semantic", "error"]
    return pa.RecordBatch.from_arrays([source.column(k).take(at) for k in kept] + columns, names=kept + names)


def stream_chunks(docs: DataFrame, sentences: Column, embedder: Embedder, *, keep: tuple[str, ...] = (), batch: int = EMBED_BATCH,
                  threshold: float = SIMILARITY, min_sentences: int = MIN_SENTENCES, max_sentences: int = MAX_SENTENCES,
                  max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, semantic_from: int = SEMANTIC_FROM) -> DataFrame:
    """Chunks with vectors of every document: ``*keep, chunk_index, text, vector, start, end, overlap_count, boundaries,
    semantic, error``.

    ``embedder`` takes a list of at most ``batch`` texts and gives a vector for each. From ``semantic_from`` sentences on a
    document is cut by meaning and a chunk's vector is the mean of its sentences' (overlap included); below that runs of
    four sentences are embedded as they are. ``start`` and ``end`` are sentence places, ``boundaries`` those sentences of
    the chunk that are unlike the one before. Where a document's own sentences make the embedder fail (an exception, a
    wrong number of vectors, uneven ones), it is cut into fixed runs (``semantic`` false) that are embedded instead; one that
    fails again stays without a vector. ``error`` says why, in all rows of the document that come after. A document of more chunks than HELD_BYTES hands over those
    done already, so only what follows falls back. Null or empty ``sentences`` give no rows.
    """
    source = docs.select(*keep, sentences.alias("__sentences"))
    schema = T.StructType([*source.drop("__sentences").schema.fields, *T.DataType.fromDDL(_RESULT).fields])
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        rows: list[tuple[int, tuple]] = []
        size = 0
        # Open documents may come from earlier batches: their kept columns are looked up by batch.
        sources: dict[int, pa.RecordBatch] = {}
        current = None

        def flush() -> None:
            nonlocal rows, size
            if rows:
                ready.append(_batch_of(sources[current], kept, rows))
            rows, size = [], 0

        def emit(place: tuple[int, int], found: list[tuple]) -> None:
            nonlocal current, size
            if place[0] != current:
                flush()
                current = place[0]
                for old in [k for k in sources if k < current]:
                    del sources[old]
            for row in found:
                rows.append((place[1], row))
                size += 8 * len(row[2]) if row[2] is not None else 0
                if size > SLICE_BYTES:
                    flush()

        stream = _Stream(embedder, batch, threshold, emit)
        for number, given in enumerate(batches):
            sources[number] = given
            lists = given.column(given.schema.get_field_index("__sentences"))
            for i in range(given.num_rows):
                parts = lists[i].as_py()
                if not parts:
                    continue
                cutter = Cutter(min_sentences, max_sentences, max_tokens, overlap)
                stream.add(_Document((number, i), parts, len(parts) >= semantic_from, cutter))
                yield from ready
                ready.clear()
        stream.finish()
        flush()
        yield from ready

    return source.mapInArrow(run, schema)
