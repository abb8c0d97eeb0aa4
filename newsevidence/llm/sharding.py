"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import run_folder, staged


def shard_of(key: Column, weights: Sequence[float], racks: int = 2, shards_per_rack: int = 5, grown: Sequence[float] = ()) -> Column:
    """The shard a key descends to.

    Shard ``s`` hangs in rack ``s // shards_per_rack``, ``racks`` racks to a region. At each level the children of the
    node reached draw an exponential waiting time each, fixed by the key and the child, at a rate that is the weight of its
    subtree; the least wins, so a child is chosen in proportion to its weight. Draws are made along the path only: one per
    region, then one per rack of that region, then one per shard of that rack. A changed weight changes draws of the nodes
    above it alone, so rows move only into (or out of) those subtrees, and none between two others. Each weight of
    ``grown`` is one more shard in a region of its own: no other draw changes, so it takes rows only into itself. Weights
    must be positive.
    """
    if not weights or min([*weights, *grown]) <= 0:
        raise ValueError("every shard needs a positive weight")

    def cut(nodes: list, size: int) -> list:
        return [nodes[i:i + size] for i in range(0, len(nodes), size)]

    def branch(name: str, weight: float, kids: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.array(*kids).alias("kids"))

    def leaf(s: int, weight: float) -> Column:
        return F.struct(F.lit(f"shard {s}").alias("name"), F.lit(float(weight)).alias("weight"), F.lit(s).alias("shard"))

    shards = cut(list(enumerate(weights)), shards_per_rack)
    places = [[(f"rack {r * racks + i}", rack) for i, rack in enumerate(part)] for r, part in enumerate(cut(shards, racks))]
    places += [[(f"grown rack {i}", [(len(weights) + i, w)])] for i, w in enumerate(grown)]
    total = lambda rack: sum(w for _, w in rack)
    tree = F.array(*[branch(f"region {r}" if r < len(places) - len(grown) else f"grown region {r - len(places) + len(grown)}",
                            sum(total(rack) for _, rack in region), [branch(name, total(rack), [leaf(*s) for s in rack]) for name, rack in region])
                     for r, region in enumerate(places)])

    def drawn(nodes: Column, then) -> Column:
        """``then`` of the node that wins, which is looked up once."""
        def wait(node: Column, i: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(key, node["name"]), 11).cast("double")
            return F.struct((-F.log((bits + 0.5) / float(1 << 53)) / node["weight"]).alias("wait"), i.alias("i"))

        return F.get(F.transform(F.array(F.array_min(F.transform(nodes, wait))["i"]), lambda i: then(F.get(nodes, i))), 0)

    return drawn(tree, lambda region: drawn(region["kids"], lambda rack: drawn(rack["kids"], lambda shard: shard["shard"])))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each shard within one task, in the order of the scan."""
    seen: dict[int, int] = {}
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        rank = np.zeros(len(shard), np.int64)
        order = np.argsort(shard, kind="stable")
        values, starts, counts = np.unique(shard[order], return_index=True, return_counts=True)
        for v, s, c in zip(values.tolist(), starts.tolist(), counts.tolist()):
            rank[order[s:s + c]] = np.arange(seen.get(v, 0), seen.get(v, 0) + c)
            seen[v] = seen.get(v, 0) + c
        yield batch.append_column("rank", pa.array(rank))


def tree_shards(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, grow: float = 1.0) -> DataFrame:
    """Place every row of ``docs`` (``doc_id``, ``text``; more columns are ignored).

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The law is ``key``. ``size`` is the text's
    UTF-8 bytes plus 16; a null text counts as empty (checksum 0). Rows with equal or null ids go to one shard, each
    with its own slot. Slots number a shard's rows from 0 without gaps: tasks number their own rows, and a small table
    of counts per task and shard gives the offsets, so no shard is gathered in one place. ``grown_shard`` is the place
    with one more shard of weight ``grow``, in a region of its own. An empty table gives an empty result.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), weights, grown=[grow]).cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    schema = T.StructType([*placed.schema, T.StructField("rank", T.LongType())])
    rows = staged(placed.mapInArrow(_ranked, schema), run_folder(docs.sparkSession), "shards")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("rank") + F.col("offset")).alias("slot"), "grown_shard",
    )
