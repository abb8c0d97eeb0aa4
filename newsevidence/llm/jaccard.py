"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets, and the groups it forms.

Copies of a text are one node. Nodes that share a band hash meet, but no list of pairs is made: each node joins a block
of its leader (the least node it shares a bucket with), and two blocks are compared when some bucket has members of
both. Blocks are bounded, so a group of any size becomes many tasks, and what leaves a task is a link count per node
and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_docs, grams, mix, run_folder, seeded, slices, staged, words_of

NGRAM, SIMILARITY = 5, 0.8
#: Chance of meeting for a pair at the threshold, and rows of a band.
RECALL, ROWS = 0.9999, 4
#: Nodes and grams of a block, on average.
BLOCK_NODES, BLOCK_GRAMS = 256, 400_000
_CELLS = 1 << 22
_LAST = (1 << 63) - 1


def band_count(similarity: float, rows: int, recall: float) -> int:
    """Bands so that a pair of that similarity shares one with probability ``recall``: 1 - (1 - s**r)**b."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def _gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes of a batch in text order, and where each text's begin. A text of 1 to n - 1 words is one gram."""
    w = words_of(column)
    doc, inside = gram_docs(w.first, n, len(w.codes))
    codes, doc = grams(w.codes, n, seed=n)[inside], doc[inside]
    length = np.diff(w.first)
    short = np.flatnonzero((length > 0) & (length < n))
    if len(short):
        own = np.array([grams(w.codes[w.first[i]:w.first[i + 1]], int(length[i]), seed=int(length[i]))[0] for i in short.tolist()], np.uint64)
        at = np.searchsorted(doc, short)
        codes, doc = np.insert(codes, at, own), np.insert(doc, at, short)
    return codes, np.searchsorted(doc, np.arange(len(length) + 1))


def _sign(n: int, bands: int, rows: int):
    factors = seeded(bands * rows, 17) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codes, first = _gram_sets(part.column("text"), n)
                have = np.flatnonzero(np.diff(first))
                out = np.zeros((len(have), bands), np.int32)
                if len(have):
                    for b in range(bands):
                        band = np.full(len(have), b + 1, np.uint64)
                        for f in factors[b * rows:(b + 1) * rows]:
                            band = mix(band * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(codes * f, first[have]))
                        out[:, b] = (band >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keep = pa.array(have)
                size = pa.array(np.diff(first)[have])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * bands), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_key").take(keep), part.column("node").take(keep), size, lists],
                                                 names=["doc_key", "node", "grams", "bands"])

    return run


def _ship(n: int):
    """The gram set of each node, once per comparison it takes part in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, bytes_each=1 << 20):
                codes, first = _gram_sets(part.column("text"), n)
                rows = []
                for i, (node, pairs, side) in enumerate(zip(*(part.column(c).to_pylist() for c in ("node", "pairs", "sides")))):
                    if node not in seen:
                        seen.add(node)
                        packed = np.unique(codes[first[i]:first[i + 1]]).tobytes()
                        rows += [(p, s, node, packed) for p, s in zip(pairs, side)]
                        while len(rows) > 256:
                            yield _packed(rows[:256])
                            rows = rows[256:]
                if rows:
                    yield _packed(rows)

    return run


def _packed(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["pair", "side", "node", "set"])


def shared_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with all sets; sets are sorted and distinct."""
    out = np.zeros((left, len(sets)), np.int64)
    if len(sets) <= 6:
        for i in range(left):
            for j in range(len(sets)):
                out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if i != j else len(sets[i])
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    used = times[column] > 1
    owner, column = owner[used], place[column[used]]
    width = max(64, _CELLS // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        cells = np.zeros((len(sets), width), np.float32)
        cells[owner[a:b], column[a:b] - low] = 1
        out += np.rint(cells[:left] @ cells.T).astype(np.int64)
    return out


def _compared(nodes: list[bytes], sides: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple]:
    """Link counts of the nodes of one comparison, and edges of a spanning forest of the links."""
    left = sum(s == 0 for s in sides)
    alone = left == len(nodes)
    size = np.array([len(s) for s in sets], np.int64)
    both = shared_counts(sets, left)
    linked = both >= similarity * (size[:left, None] + size[None, :] - both) - 1e-9
    if alone:
        np.fill_diagonal(linked, False)
    else:
        linked[:, :left] = False
    degree = np.zeros(len(nodes), np.int64)
    degree[:left] += linked.sum(axis=1)
    if not alone:
        degree += linked.sum(axis=0)
    root = np.arange(len(nodes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(left):
        for j in np.flatnonzero(linked[i]).tolist() if linked[i].any() else ():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    out = []
    for i in np.flatnonzero(degree).tolist():
        r = find(i)
        out.append((nodes[i], int(degree[i]), nodes[r] if r != i else None))
    return out


def _compare(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, nodes, sides, sets = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            rows = _compared(nodes, sides, sets, similarity) if len(nodes) > 1 else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))],
                                                 names=["node", "links", "other"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("pair", "side", "node", "set")]
            for p, s, node, packed in zip(*columns):
                if p != pair:
                    yield from close()
                    pair, nodes, sides, sets = p, [], [], []
                if not nodes or nodes[-1] != node or sides[-1] != s:  # a lost split may have shipped a node twice
                    nodes.append(node)
                    sides.append(s)
                    sets.append(np.frombuffer(packed, np.uint64))
        yield from close()

    return run


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``node, root``: the least node of the connected component of every node in ``edges`` (``a``, ``b``).

    Large-star and small-star steps: each links neighbours to the least one around, halving the height of the trees;
    every round is written to the shared folder. A star is final when no root has a smaller neighbour.
    """
    stars = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), folder, "edges0")
    turn = 0
    while True:
        turn += 1
        # Final when every larger end has one neighbour and no smaller end is a larger one.
        many = stars.groupBy("a").count().where("count > 1").select("a")
        if not many.unionByName(stars.join(stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")).take(1):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        around = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), folder, f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = staged(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"edges{turn}")


def node_of(text: str = "text") -> F.Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, n: int = NGRAM, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """Distinct texts with a word: ``node, doc_key, copies, n_links, class_key``.

    ``node`` is the text's MD5, ``doc_key`` its smallest id (null ids count as the largest), ``n_links`` the number of
    other texts whose sets of ``n``-word grams have at least that Jaccard similarity, ``class_key`` the smallest id in
    the connected component of links. A pair at the threshold is met with probability ``recall``, others more often.
    """
    folder = run_folder(docs.sparkSession)
    bands = band_count(similarity, rows, recall)
    base = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_key"), node_of().alias("node"), "text")
    signed = base.mapInArrow(_sign(n, bands, rows), "doc_key long, node binary, grams long, bands array<int>")
    texts = staged(signed.groupBy("node").agg(F.min("doc_key").alias("doc_key"), F.count("*").alias("copies"),
                                              F.max("grams").alias("grams"), F.min("bands").alias("bands")), folder, "texts")
    member = texts.select("node", F.posexplode("bands").alias("band", "hash"))
    bucket = member.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").drop("n")
    member = staged(member.join(bucket, ["band", "hash"]), folder, "members")
    leader = member.groupBy("node").agg(F.min("lead").alias("leader")).join(texts.select("node", "doc_key", "grams"), "node")
    room = leader.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("grams") / BLOCK_GRAMS)).alias("blocks"))
    block = staged(leader.join(room, "leader").select(
        "node", "doc_key", F.xxhash64("leader", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), folder, "blocks")
    met = member.select("node", "band", "hash").join(block.select("node", "block"), "node").select("band", "hash", "block").distinct()
    pairs = met.join(met.select("band", "hash", F.col("block").alias("other")), ["band", "hash"]).where("block <= other")
    pairs = pairs.select("block", "other").distinct().withColumn("pair", F.xxhash64("block", "other"))
    ways = pairs.select("block", "pair", F.lit(0).alias("side")).unionByName(
        pairs.where("block <> other").select(F.col("other").alias("block"), "pair", F.lit(1).alias("side")))
    wanted = block.join(ways, "block").groupBy("node", "doc_key").agg(F.collect_list(F.struct("pair", "side")).alias("to"))
    shipped = base.join(wanted, ["node", "doc_key"]).select("node", "text", F.col("to.pair").alias("pairs"), F.col("to.side").alias("sides"))
    shipped = shipped.mapInArrow(_ship(n), "pair long, side int, node binary, set binary")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met_sets = shipped.repartition(shuffles, "pair").sortWithinPartitions("pair", "side", "node")
    links = staged(met_sets.mapInArrow(_compare(similarity), "node binary, links long, other binary"), folder, "links")
    degree = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    root = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), folder)
    grouped = texts.select("node", "doc_key", "copies").join(degree, "node", "left").join(root, "node", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_key", "node")).alias("f"))
    return grouped.join(first, "root").select("node", "doc_key", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                                              F.col("f.doc_key").alias("class_key"), F.col("f.node").alias("class_node"))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id, text_id, n_copies, n_links, class_id``.

    ``text_id`` is the smallest id of the rows with this very text, ``n_copies`` their number, ``n_links`` the number
    of other texts it is similar to, ``class_id`` the smallest id of its group of linked texts. Null, blank and unlinked
    texts are groups of their own (null and blank: one per row). A null id counts as the largest and is given as
    null. Words are ``[^\\x20\\x09-\\x0D]+``, case kept; a text of fewer than five words is one gram. Repeated rows stay.
    More columns are ignored. An empty table gives an empty result.
    """
    texts = similar_texts(docs, **options)
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    found = docs.select("doc_id", node_of().alias("node")).join(texts, "node", "left")
    own = F.col("doc_key").isNull()
    return found.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(known("doc_key")).alias("text_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(own, F.col("doc_id")).otherwise(known("class_key")).alias("class_id"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` without near copies: of each group the row with the smallest id stays, whole.

    Null and blank texts are no copies of anything and stay. Of fully equal rows (id and text) one stays.
    """
    texts = similar_texts(docs, **options)
    first = texts.where("node = class_node").select("node", "doc_key", F.lit(True).alias("first"))
    later = texts.where("node <> class_node").select("node")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), node_of().alias("node"),
                        F.coalesce("doc_id", F.lit(_LAST)).alias("doc_key"))
    repeated = texts.where("copies > 1").select("node", F.lit(True).alias("many"))
    named = whole.join(later, "node", "left_anti").join(first.withColumnRenamed("doc_key", "least"), "node", "left")
    named = named.where("first is null or doc_key = least").join(repeated, "node", "left")
    once = named.where("many").dropDuplicates(["node", "doc_key"])
    return named.where("many is null").select("whole.*").unionByName(once.select("whole.*"))
