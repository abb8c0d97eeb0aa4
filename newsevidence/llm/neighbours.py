"""Approximate nearest neighbours by inner product: an NN-descent graph, searched greedily.

Equal vectors are one node. Vectors are scaled into the unit ball and given one more component that puts them on its
surface, so the largest inner product with a query is the smallest angle. A forest of random splits, fitted on a bounded
sample, gives every node first neighbours; then neighbours of neighbours meet through Spark joins until lists settle.
A query starts at nodes of its leaf (and at its own node, if it is one) and follows the graph: each round expands the
best nodes of its pool that have not been expanded. What the pool ends with is scored anew on the original vectors.

Graph and search see vectors as 8-bit components; ids travel as packed arrays, one row per node or query.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import run_folder, staged

#: Neighbours of a node, and nodes met by way of who lists them.
NEIGHBOURS, REVERSE = 32, 32
#: Random trees that give first neighbours, nodes of a leaf, and vectors (taken by hash) that the splits are fitted on.
TREES, LEAF, SAMPLE = 4, 1024, 20_000
#: Rounds of NN-descent, and the share of list places below whose change they end.
ROUNDS, SETTLED = 5, 0.04
#: Nodes in a query's pool, how many of them are expanded in a round, and how many are scored on original vectors.
POOL, EXPAND, RESCORED = 256, 48, 96
_ENTRIES, _SAMPLE_LEAF, _BUFFER = 8, 64, 1 << 20
_NONE = np.float32(-9)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array, dtype=np.uint8) -> np.ndarray:
    """A binary column whose values have one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype)
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0]:starts[-1]]
    return np.ascontiguousarray(data.reshape(len(column), -1)).view(dtype)


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    flat = np.ascontiguousarray(matrix)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(flat) + 1, dtype=np.int64) * width
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
    raise ValueError("batch too large")


def _packed(x: np.ndarray) -> np.ndarray:
    """8-bit components behind their scale."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30).astype(np.float32) / np.float32(127)
    bytes_ = np.rint(x / scale[:, None]).astype(np.int8)
    return np.concatenate((scale[:, None].view(np.uint8), bytes_.view(np.uint8)), axis=1)


def _unpacked(codes: np.ndarray) -> np.ndarray:
    scale = np.ascontiguousarray(codes[:, :4]).view(np.float32)
    return codes[:, 4:].view(np.int8).astype(np.float32) * scale


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _on_sphere(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    rest = np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


class _Forest:
    """Random trees: each split halves the sample along the difference of two of its points."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            planes, cuts, kids, todo = [], [], [], [(np.arange(len(sample)), -1, 0)]
            leaves = 0
            while todo:
                at, parent, side = todo.pop()
                split = None
                if len(at) > leaf:
                    a, b = sample[draw.choice(at, 2, replace=False)]
                    along = sample[at] @ (a - b)
                    cut = np.median(along)
                    if (along <= cut).any() and (along > cut).any():
                        split = (a - b, cut, along <= cut)
                if split is None:
                    own, leaves = -1 - leaves, leaves + 1
                else:
                    own = len(planes)
                    planes.append(split[0])
                    cuts.append(split[1])
                    kids.append([0, 0])
                    todo += [(at[split[2]], own, 0), (at[~split[2]], own, 1)]
                if parent >= 0:
                    kids[parent][side] = own
            self.trees.append((np.array(planes, np.float32).reshape(-1, sample.shape[1]), np.array(cuts, np.float32), np.array(kids, np.int64).reshape(-1, 2)))
        # Where the sample is too small for leaves of the size wanted, signs against further directions divide them.
        self.more = draw.standard_normal((20, sample.shape[1])).astype(np.float32)

    def leaves(self, x: np.ndarray, tree: int, bits: int) -> np.ndarray:
        planes, cuts, kids = self.trees[tree]
        at = np.zeros(len(x), np.int64) if len(planes) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], planes[node]) > cuts[node]
            at[inner] = kids[node, right.astype(np.int64)]
        leaf = -1 - at
        for k in range(bits):
            leaf = leaf * 2 + (x @ self.more[(k + tree * 5) % len(self.more)] > 0)
        return leaf


def _placed(forest, longest: float, size: int, bits: int):
    """Codes and leaves of nodes, one row per tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                x = _on_sphere(_vectors(batch.column("vector"), size), longest).astype(np.float32)
                codes, node = _binary(_packed(x)), batch.column("node")
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([node, codes, pa.array(np.full(len(x), t, np.int32)), pa.array(forest.value.leaves(x, t, bits))],
                                                     names=["node", "code", "tree", "leaf"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, whole, several to a table of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.ones(batch.num_rows, bool)
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        if held:
            last = held[-1]
            new[0] = any(last.column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns))
        begin = np.flatnonzero(new)
        if len(begin) and (held or begin[-1] > 0):
            if begin[-1]:
                held.append(batch.slice(0, int(begin[-1])))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(int(begin[-1]) if len(begin) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _starts(*columns: np.ndarray) -> list[int]:
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]


def _best(scores: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best of each row, padded with id -1; ties by id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :width]
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    lacking = width - ids.shape[1]
    if lacking > 0:
        ids = np.pad(ids, ((0, 0), (0, lacking)), constant_values=-1)
        scores = np.pad(scores, ((0, 0), (0, lacking)), constant_values=_NONE)
    return np.where(scores > _NONE, ids, -1), scores


def _in_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest nodes within each leaf."""
    for table in _groups(batches, ["tree", "leaf", "piece"]):
        node, codes = table.column("node").to_numpy(), _rows(table.column("code"))
        cuts = _starts(*(table.column(k).to_numpy() for k in ("tree", "leaf", "piece")))
        for a, b in zip(cuts, cuts[1:]):
            x, ids = _unpacked(codes[a:b]), node[a:b]
            for low in range(0, len(x), 512):
                score = x[low:low + 512] @ x.T
                score[np.arange(len(score)), low + np.arange(len(score))] = _NONE
                some = min(NEIGHBOURS, len(x))
                at = np.argpartition(-score, some - 1, axis=1)[:, :some]
                near, sims = _best(np.take_along_axis(score, at, 1), ids[at], NEIGHBOURS)
                own = slice(a + low, a + low + len(score))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), _binary(codes[own]), _binary(near), _binary(sims)], names=["node", "code", "ids", "sims"])


def _distinct_best(ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    return _best(np.where(again | (ids < 0), _NONE, sims), ids, NEIGHBOURS)


def _joined_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list per node, made of the lists that the trees gave it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [(np.zeros((batch.num_rows, NEIGHBOURS), np.int64) - 1, np.full((batch.num_rows, NEIGHBOURS), _NONE, np.float32)) for _ in range(TREES)]
        for k, column in ((0, "ids"), (1, "sims")):
            lists = batch.column(column)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            turn = np.arange(len(owner)) - np.searchsorted(owner, owner)
            values = _rows(lists.flatten(), (np.int64, np.float32)[k])
            for t in range(TREES):
                parts[t][k][owner[turn == t]] = values[turn == t]
        ids, sims = _distinct_best(np.concatenate([p[0] for p in parts], 1), np.concatenate([p[1] for p in parts], 1))
        yield _graph_rows(batch.column("node"), batch.column("code"), ids, sims, ids >= 0)


_GRAPH = "node long, code binary, ids binary, sims binary, fresh binary, least float, changed int"


def _graph_rows(node, code, ids, sims, fresh) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [node, code, _binary(ids), _binary(sims), _binary(fresh.astype(np.uint8)), pa.array(sims[:, -1]), pa.array(fresh.sum(axis=1).astype(np.int32))],
        names=["node", "code", "ids", "sims", "fresh", "least", "changed"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An edge per list place."""
    for batch in batches:
        ids, sims, fresh = _rows(batch.column("ids"), np.int64), _rows(batch.column("sims"), np.float32), _rows(batch.column("fresh"))
        if not len(ids):
            continue
        some = ids >= 0
        own = np.repeat(batch.column("node").to_numpy(), some.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[some]), pa.array(sims[some]), pa.array(fresh[some].astype(bool))],
                                         names=["node", "near", "sim", "fresh"])


def _around(graph: DataFrame) -> DataFrame:
    """Who meets at a node: itself, those it lists, and the nearest of those that list it. ``at, node, fresh``."""
    edges = graph.select("node", "ids", "sims", "fresh").mapInArrow(_listed, "node long, near long, sim float, fresh boolean")
    # The rank filter limits each task's rows before the shuffle, so a node that very many list is no hot key.
    rank = F.row_number().over(W.partitionBy("near").orderBy(F.desc("sim"), "node"))
    back = edges.withColumn("rank", rank).where(f"rank <= {REVERSE}").select(F.col("near").alias("at"), "node", "fresh")
    forth = edges.select(F.col("node").alias("at"), F.col("near").alias("node"), "fresh")
    return forth.unionByName(back).groupBy("at", "node").agg(F.max("fresh").alias("fresh")).unionByName(
        graph.select(F.col("node").alias("at"), "node", F.lit(True).alias("fresh")))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that meet at a third, new to each other's way, better than the worst place of the first's list."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def emit() -> pa.RecordBatch:
        a, b, s = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s = a[keep], b[keep], s[keep]
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < NEIGHBOURS
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep])], names=["node", "near", "sim"])

    for table in _groups(batches, ["at"]):
        at, node = table.column("at").to_numpy(), table.column("node").to_numpy()
        fresh, least = table.column("fresh").to_numpy(), table.column("least").to_numpy()
        x, cuts = _unpacked(_rows(table.column("code"))), _starts(at)
        for a, b in zip(cuts, cuts[1:]):
            own = x[a:b]
            score = own @ own.T
            good = (score > least[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            found.append((node[a + i], node[a + j], score[i, j]))
            size += len(i)
            if size > _BUFFER:
                yield emit()
                found, size = [], 0
    if size:
        yield emit()


def _improved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists with what was found for them; ``fresh`` marks places that are new."""
    for batch in batches:
        ids, sims = _rows(batch.column("ids"), np.int64), _rows(batch.column("sims"), np.float32)
        if not len(ids):
            continue
        more, more_sims = np.full(ids.shape, -1, np.int64), np.full(ids.shape, _NONE, np.float32)
        found = batch.column("found")
        flat = found.flatten()
        owner = np.repeat(np.arange(len(ids)), np.diff(found.offsets.to_numpy()))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        more[owner, place] = flat.field("near").to_numpy(zero_copy_only=False)
        more_sims[owner, place] = flat.field("sim").to_numpy(zero_copy_only=False)
        new_ids, new_sims = _distinct_best(np.concatenate((ids, more), 1), np.concatenate((sims, more_sims), 1))
        fresh = (new_ids >= 0) & ~(new_ids[:, :, None] == ids[:, None, :]).any(axis=2)
        yield _graph_rows(batch.column("node"), batch.column("code"), new_ids, new_sims, fresh)


def neighbour_graph(placed: DataFrame, folder: str) -> DataFrame:
    """The neighbour lists of nodes, staged. ``placed`` has a row per node and tree: ``node, code, tree, leaf``.

    Trees give first lists. In a round, all that meet at a node are compared with each other when one of the two came
    there anew; what beats the worst place of a list enters it. Groups are bounded by 1 + NEIGHBOURS + REVERSE.
    """
    room = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("pieces")).where("pieces > 1")
    # Leaves that the sample could not divide (near copies by the million) are dealt by hash; joins mend what that parts.
    split = placed.join(room, ["tree", "leaf"], "left").withColumn("piece", F.pmod(F.xxhash64("node", "tree"), F.coalesce("pieces", F.lit(1))).cast("int"))
    dealt = split.select("tree", "leaf", "piece", "node", "code").repartition("tree", "leaf", "piece").sortWithinPartitions("tree", "leaf", "piece", "node")
    lists = dealt.mapInArrow(_in_leaf, "node long, code binary, ids binary, sims binary")
    lists = lists.groupBy("node").agg(F.first("code").alias("code"), F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims"))
    graph = staged(lists.mapInArrow(_joined_lists, _GRAPH), folder, "graph0")
    total = graph.count()
    for turn in range(1, ROUNDS + 1):
        member = graph.select("node", "code", "least")
        met = _around(graph).join(member, "node").repartition("at").sortWithinPartitions("at", "node")
        pairs = met.mapInArrow(_meet, "node long, near long, sim float").groupBy("node", "near").agg(F.max("sim").alias("sim"))
        rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("sim"), "near"))
        found = pairs.withColumn("rank", rank).where(f"rank <= {NEIGHBOURS}").groupBy("node").agg(F.collect_list(F.struct("near", "sim")).alias("found"))
        none = F.array().cast("array<struct<near:long,sim:float>>")
        wide = graph.join(found, "node", "left").select("node", "code", "ids", "sims", F.coalesce("found", none).alias("found"))
        graph = staged(wide.mapInArrow(_improved, _GRAPH), folder, f"graph{turn}")
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * NEIGHBOURS * total:
            break
    return graph


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per node with the ids and codes of all around it."""
    for table in _groups(batches, ["at"]):
        at, node, codes = table.column("at").to_numpy(), table.column("node").to_numpy(), _rows(table.column("code"))
        cuts = _starts(at)
        for low in range(0, len(cuts) - 1, 1024):
            spans = list(zip(cuts[low:low + 1024], cuts[low + 1:low + 1025]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[[a for a, _ in spans]]), pa.array([node[a:b].tobytes() for a, b in spans]), pa.array([codes[a:b].tobytes() for a, b in spans])],
                names=["at", "ids", "codes"])


def _first_pools(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("vector"), size)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            codes = _packed(np.concatenate((x, np.zeros((len(x), 1))), axis=1))
            ids = np.full((len(x), POOL), -1, np.int64)
            for i, starts in enumerate(batch.column("starts").to_pylist()):
                starts = sorted(set(starts))[:POOL]
                ids[i, :len(starts)] = starts
            # Entries count as better than anything until their own score is known: they are expanded first.
            scores = np.where(ids >= 0, np.float32(9), _NONE).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("query"), _binary(codes), _binary(ids), _binary(scores), _binary(np.zeros(ids.shape, np.uint8))],
                                             names=["query", "code", "ids", "scores", "done"])

    return run


_POOL_ROWS = "query long, code binary, ids binary, scores binary, done binary"


def _next(ids: np.ndarray, done: np.ndarray) -> np.ndarray:
    """The best places that are still to be expanded; places are in order of score."""
    todo = (ids >= 0) & (done == 0)
    return todo & (np.cumsum(todo, axis=1) <= EXPAND)


def _frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, scores, done = _rows(batch.column("ids"), np.int64), _rows(batch.column("scores"), np.float32), _rows(batch.column("done"))
        if not len(ids):
            continue
        row, place = np.nonzero(_next(ids, done))
        take = pa.array(row)
        least = np.where(scores[:, -1] > 8, _NONE, scores[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(ids[row, place]), batch.column("query").take(take), batch.column("code").take(take), pa.array(least[row])],
                                         names=["at", "query", "code", "least"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies around an expanded node and beats the worst place of the query's pool."""
    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.int64)
            count = np.array([len(v) // 8 for v in batch.column("ids").to_pylist()])
            q = _unpacked(_rows(batch.column("code")))
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            owner = np.repeat(np.arange(batch.num_rows), count)
            score = np.einsum("ij,ij->i", _unpacked(codes), q[owner])
            good = score > batch.column("least").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(owner[good])), pa.array(ids[good]), pa.array(score[good])],
                                             names=["query", "near", "score"])


def _advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, scores, done = _rows(batch.column("ids"), np.int64).copy(), _rows(batch.column("scores"), np.float32).copy(), _rows(batch.column("done")).copy()
        if not len(ids):
            continue
        done[_next(ids, done)] = 1
        found = batch.column("found").to_pylist()
        for i, hits in enumerate(found):
            if hits:
                near = np.frombuffer(b"".join(h["ids"] for h in hits), np.int64)
                score = np.frombuffer(b"".join(h["scores"] for h in hits), np.float32)
                known = ids[i] >= 0
                every = np.concatenate((near, ids[i][known]))
                # A found score stands before the pool's (that of an entry is not known); a place that was expanded stays so.
                value, first = np.unique(every, return_index=True)
                score = np.concatenate((score, scores[i][known]))[first]
                old = np.isin(value, ids[i][known & (done[i] == 1)])
                order = np.lexsort((value, -score))[:POOL]
                ids[i], scores[i], done[i] = -1, _NONE, 0
                ids[i, :len(order)], scores[i, :len(order)], done[i, :len(order)] = value[order], score[order], old[order]
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("code"), _binary(ids), _binary(scores), _binary(done)],
                                         names=["query", "code", "ids", "scores", "done"])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one task found for a query, in one row; only as many as a pool has room for."""
    for table in _groups(batches, ["query"]):
        query, near, score = (table.column(c).to_numpy() for c in ("query", "near", "score"))
        order = np.lexsort((near, query))
        query, near, score = query[order], near[order], score[order]
        keep = np.ones(len(query), bool)
        keep[1:] = (query[1:] != query[:-1]) | (near[1:] != near[:-1])
        query, near, score = query[keep], near[keep], score[keep]
        order = np.lexsort((near, -score, query))
        query, near, score = query[order], near[order], score[order]
        cuts = _starts(query)
        spans = [(a, min(b, a + POOL)) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(query[[a for a, _ in spans]]), pa.array([near[a:b].tobytes() for a, b in spans]),
                                          pa.array([score[a:b].tobytes() for a, b in spans])], names=["query", "ids", "scores"])


def _pool_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, scores = _rows(batch.column("ids"), np.int64), _rows(batch.column("scores"), np.float32)
        if not len(ids):
            continue
        ids, scores = ids[:, :RESCORED], scores[:, :RESCORED]
        row, place = np.nonzero(ids >= 0)
        yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(row)), pa.array(ids[row, place])], names=["query", "node"])


def greedy_search(graph: DataFrame, starts: DataFrame, folder: str, size: int) -> DataFrame:
    """``query, node``: the best places of each query's pool after a greedy walk over ``graph``.

    ``starts``: ``query, vector, starts`` (an array of nodes). A round joins the places to be expanded with what lies
    around them; a place that falls out of the pool is worse than all in it and needs no memory. It ends when no pool
    has a place left to expand.
    """
    spark = graph.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    around = _around(graph).join(graph.select("node", "code"), "node").repartition(partitions, "at").sortWithinPartitions("at", "node")
    packs = around.mapInArrow(_packs, "at long, ids binary, codes binary").repartition(partitions, "at")
    # In buckets, so that no round shuffles the graph.
    table = f"around_{uuid.uuid4().hex}"
    packs.write.bucketBy(partitions, "at").option("path", f"{folder}/around").saveAsTable(table)
    try:
        return _walk(spark.table(table), staged(starts.mapInArrow(_first_pools(size), _POOL_ROWS), folder, "pools0"), folder, partitions)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _walk(packs: DataFrame, pools: DataFrame, folder: str, partitions: int) -> DataFrame:
    turn = 0
    while True:
        turn += 1
        frontier = staged(pools.mapInArrow(_frontier, "at long, query long, code binary, least float"), folder, f"frontier{turn}")
        if not frontier.take(1):
            return pools.mapInArrow(_pool_rows, "query long, node long")
        met = packs.join(frontier.hint("shuffle_hash"), "at").select("query", "code", "least", "ids", "codes")
        hits = met.mapInArrow(_scored, "query long, near long, score float")
        hits = hits.repartition(partitions, "query").sortWithinPartitions("query").mapInArrow(_hits, "query long, ids binary, scores binary")
        hits = hits.groupBy("query").agg(F.collect_list(F.struct("ids", "scores")).alias("found"))
        pools = staged(pools.join(hits, "query", "left").mapInArrow(_advanced, _POOL_ROWS), folder, f"pools{turn}")


def _entry_leaf(forest, size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("vector"), size)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                leaf = forest.value.leaves(np.concatenate((x, np.zeros((len(x), 1))), axis=1).astype(np.float32), 0, bits)
                yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(leaf)], names=["query", "leaf"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query: ``query_id, rank, vec_id, score``.

    ``rows`` and ``queries`` have ``vec_id`` and ``vector`` (an array of floats or doubles; more columns are ignored).
    Scores are sums in double precision over the original vectors, ties go to the smaller id, and a query's own row (same
    id and vector) is no candidate. Rows that are null, zero, without id, or hold null or non-finite components take no
    part, neither do those of another length than the commonest of ``rows`` (ties: the longer). ``k`` is 32 at most. Rows equal in id and
    vector count once; one id with several vectors is several rows. Fewer candidates than ``k`` are all given. The result
    is approximate, but for tables within one pool (256 distinct vectors or fewer), which are searched whole.
    """
    if not 0 < k <= RESCORED // 3:
        raise ValueError(f"k must be from 1 to {RESCORED // 3}")
    spark, folder = rows.sparkSession, run_folder(rows.sparkSession)
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")) \
        .where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    every, asked = clean(rows), clean(queries)
    lengths = every.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = int(lengths["size"]) if lengths else 0
    every, asked = every.where(F.size("vector") == size), asked.where(F.size("vector") == size)
    # A class needs no more members than a query can get, and one for the query itself.
    rank = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    member = every.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    nodes = member.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "vector", "members"), folder, "nodes")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    about = nodes.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    if not about["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = float(about["longest"]) * (1 + 1e-12)
    sample = nodes.select("vector", "node").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()
    ratio = about["n"] / sample.num_rows
    leaf = max(_SAMPLE_LEAF, int(LEAF / ratio))
    bits = min(40, max(0, math.ceil(math.log2(leaf * ratio / LEAF))))
    forest = _Forest(_on_sphere(_vectors(sample.column("vector"), size), longest).astype(np.float32), leaf)
    sent = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE
    placed = staged(nodes.mapInArrow(_placed(sent, longest, size, bits), "node long, code binary, tree int, leaf long"), folder, "placed")
    graph = neighbour_graph(placed, folder)

    query = asked.groupBy("vector").agg(F.count("*").alias("n")).select("vector")
    query = query.join(nodes.select("vector", "node"), "vector", "left")
    query = staged(query.select(F.monotonically_increasing_id().alias("query"), "vector", "node"), folder, "queries")
    leaf = query.mapInArrow(_entry_leaf(sent, size, bits), "query long, leaf long")
    placed = placed.where("tree = 0")
    turn = F.row_number().over(W.partitionBy("leaf").orderBy("node"))
    entry = placed.select("leaf", "node").withColumn("turn", turn).where(f"turn <= {_ENTRIES}").groupBy("leaf").agg(F.collect_list("node").alias("entries"))
    anywhere = [r["node"] for r in placed.select("node").orderBy(F.xxhash64("node"), "node").limit(POOL if about["n"] <= POOL else _ENTRIES).collect()]
    fixed = F.array(*[F.lit(n).cast("long") for n in anywhere])
    own = F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array().cast("array<bigint>"))
    starts = query.join(leaf, "query").join(entry, "leaf", "left").select(
        "query", "vector", F.concat(own, F.coalesce("entries", F.array().cast("array<bigint>")), fixed).alias("starts"))
    found = greedy_search(graph, starts, folder, size)

    product = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    close = found.join(nodes.select("node", F.col("vector").alias("other"), "members"), "node").join(query.select("query", "vector"), "query")
    close = close.select("query", "node", product.alias("score"), F.explode("members").alias("vec_id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "node"))
    close = close.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    close = staged(close.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "node"))).alias("best")), folder, "best")
    asked = asked.distinct().join(query.select("query", "vector", "node"), "vector").select("query", "node", F.col("vec_id").alias("query_id"))
    own = lambda b: (b["vec_id"] == F.col("query_id")) & F.coalesce(b["node"] == F.col("node"), F.lit(False))
    out = asked.join(close, "query").select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: ~own(b)), 1, k)).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
