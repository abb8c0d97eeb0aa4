"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_docs, grams, run_folder, slices, staged, words_of

#: Words of a seed. Every position of an item is one: an edited copy may have kept any of them.
SEED = 3
#: Alignment scores per word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage counts when its score is at least this share of the best possible one for the item (or for a full part
#: of PART words of it).
SHARE, PART = 0.5, 30
#: Bytes of test items held by a task at a time; more items are worked through in blocks.
BLOCK_BYTES = 16 << 20
_LANES = 1 << 21


class _Items:
    """One block of test items: word hashes, and all seeds with their places."""

    def __init__(self, rows: list[tuple[int, int, str]]):
        self.rows = [r[0] for r in rows]
        self.ids = [r[1] for r in rows]
        w = words_of(pa.array([r[2] for r in rows], pa.string()), lower=True)
        self.codes = [w.codes[w.first[i]:w.first[i + 1]] for i in range(len(rows))]
        seeds = [(h, i, p) for i, c in enumerate(self.codes) for p, h in enumerate(_seed_codes(c).tolist())]
        self.hash = np.array([s[0] for s in seeds], np.uint64)
        self.item = np.array([s[1] for s in seeds], np.int64)
        self.pos = np.array([s[2] for s in seeds], np.int64)


def _seed_codes(codes: np.ndarray) -> np.ndarray:
    """Seeds of one item; an item shorter than a seed is one seed of its own length."""
    return grams(codes, min(SEED, len(codes)), seed=min(SEED, len(codes))) if len(codes) else np.zeros(0, np.uint64)


def _member(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``x`` whose value is in ``sorted_``, and the places there. A small filter goes first."""
    if not len(sorted_) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = 22
    table = np.zeros(1 << bits, bool)
    table[(sorted_ >> np.uint64(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(x >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.searchsorted(sorted_, x[maybe])
    at[at == len(sorted_)] = 0
    hit = sorted_[at] == x[maybe]
    return maybe[hit], at[hit]


def _all_hits(words, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word position and seed place of every seed found; short items have shorter seeds."""
    out = []
    for n in range(1, SEED + 1):
        g = grams(words.codes, n, seed=n)
        doc, inside = gram_docs(words.first, n, len(words.codes))
        where, at = _member(sorted_, g)
        keep = inside[where]
        out.append((doc[where[keep]], where[keep], at[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignments of pairs: columns score, end (behind the last aligned word of the passage).

    Pairs are lanes of one array; a row of all score tables is one step, gaps along it come from a running maximum.
    """
    out = np.zeros((len(items), 2), np.int64)
    size = np.array([max(len(a), 1) * 4096 + len(b) for a, b in zip(items, passages)])
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        stop, width = start, 0
        while stop < len(order) and max(width, len(passages[order[stop]])) * (stop - start + 1) <= _LANES or stop == start:
            width = max(width, len(passages[order[stop]]))
            stop += 1
        lane = order[start:stop]
        start = stop
        height = max(len(items[i]) for i in lane)
        a = np.zeros((len(lane), height), np.uint64)
        b = np.full((len(lane), width), 1, np.uint64)
        for k, i in enumerate(lane):
            a[k, :len(items[i])] = items[i]
            b[k, :len(passages[i])] = passages[i]
        steps = (np.arange(width + 1) * GAP).astype(np.int32)
        row = np.zeros((len(lane), width + 1), np.int32)
        best, end = np.zeros(len(lane), np.int32), np.zeros(len(lane), np.int64)
        for j in range(height):
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + np.where(a[:, j:j + 1] == b, MATCH, MISMATCH), row[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new - steps, axis=1) + steps
            top, at = new.max(axis=1), new.argmax(axis=1)
            better = top > best
            best[better], end[better] = top[better], at[better]
            row = new
        out[lane, 0], out[lane, 1] = best, end
    return out


def _find(block: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(block)
        use = np.argsort(items.hash, kind="stable")
        distinct, first, copies = np.unique(items.hash[use], return_index=True, return_counts=True)
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), lower=True)
                doc, where, at = _all_hits(words, distinct)
                times = copies[at]
                k = np.repeat(first[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                item, start = items.item[use[k]], np.repeat(where, times) - items.pos[use[k]]
                doc = np.repeat(doc, times)
                # Hits of one item that lie close together make one passage.
                order = np.lexsort((start, item, doc))
                doc, item, start = doc[order], item[order], start[order]
                length = np.array([len(c) for c in items.codes], np.int64)[item]
                new = np.ones(len(order), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > length[1:])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(order)) - 1
                if not len(begin):
                    continue
                d, it = doc[begin], item[begin]
                # So many words may stand between those of a copy before its score is too low.
                slack = length[begin] * MATCH - np.ceil(SHARE * np.minimum(length[begin], PART) * MATCH).astype(np.int64)
                low = np.maximum(words.first[d], start[begin] - slack)
                high = np.minimum(words.first[d + 1], start[last] + length[begin] + slack)
                found = align([items.codes[i] for i in it.tolist()], [words.codes[a:b] for a, b in zip(low.tolist(), high.tolist())])
                full = length[begin] * MATCH
                good = found[:, 0] >= SHARE * np.minimum(full, PART * MATCH)
                rows = part.column("row").to_numpy(zero_copy_only=False)[d[good]]
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(rows), "doc_id": part.column("doc_id").take(pa.array(d[good])),
                    "item_row": pa.array(np.array(items.rows, np.int64)[it[good]]),
                    "item_id": pa.array([items.ids[i] for i in it[good].tolist()], pa.int64()),
                    "score": pa.array(found[good, 0]), "similarity": pa.array(found[good, 0] / full[good]),
                    "end_word": pa.array((low[good] - words.first[d[good]] + found[good, 1]).astype(np.int64))})

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, int, str]]]:
    """Test items in blocks of bounded bytes; the driver holds one block at a time."""
    rows, size = [], 0
    numbered = benchmark.select("item_id", "text").where("text is not null")
    for i, r in enumerate(numbered.toLocalIterator(prefetchPartitions=False)):
        if rows and size + len(r["text"]) > BLOCK_BYTES // 4:
            yield rows
            rows, size = [], 0
        rows.append((i, r["item_id"], r["text"]))
        size += len(r["text"])
    if rows:
        yield rows


def contaminated_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document (``doc_id``, ``text``) and a test item (``item_id``, ``text``) that it holds a copy of.

    Words are ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z). One pass joins all documents with the seeds, all n-grams of
    SEED words of an item, cuts a passage around neighbouring hits of an item and aligns it with the whole item. The
    passage reaches as far as a copy through a hit can. No seed is left out for being frequent or rare.
    Kept: score at least SHARE of the item's best possible score, where more than PART words count as PART.
    Test items are the query set: they go to the tasks in blocks of bounded size, one pass for each.

    Returns ``row, doc_id, item_row, item_id, score, similarity, end_word``, the best passage of each pair of rows (the
    first on a tie). ``row`` numbers the rows of ``docs``, so repeated and null ids stay apart. Null and empty texts
    give nothing, nor do empty tables; more columns are ignored.
    """
    spark = docs.sparkSession
    folder = run_folder(spark)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    schema = "row long, doc_id long, item_row long, item_id long, score long, similarity double, end_word long"
    found = None
    for n, block in enumerate(_blocks(benchmark)):
        part = staged(rows.mapInArrow(_find(block), schema), folder, f"block{n}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = F.max_by(F.struct("doc_id", "item_id", "score", "similarity", "end_word"), F.struct(F.col("score"), -F.col("end_word"))).alias("b")
    return found.groupBy("row", "item_row").agg(best).select("row", "item_row", "b.*")


def without_test_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no passage of a test item, whole. ``docs`` must be a scan or a staged table, whose
    rows number alike each time."""
    row = F.monotonically_increasing_id()
    bad = contaminated_passages(docs, benchmark).select("row").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row.alias("row"))
    return whole.join(bad, "row", "left_anti").select("whole.*")
