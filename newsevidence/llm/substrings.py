"""Removal of repeated word sequences over a compacted de Bruijn graph of word windows.

Edges are the windows of WINDOW words, nodes their overlaps of WINDOW - 1 words. Only edges that occur in several
documents matter. They are found in three steps, each a shuffle of small rows between document buckets:

1. Every window has an anchor, the least hash among its grams of GRAM words. Equal windows have equal anchors, so
   only anchors met in several documents can belong to a repeated edge.
2. Buckets send what their first document with a candidate edge has of it; equal edges meet and learn the source
   coordinate, the first (document, word) they occur at. Runs of edges under one anchor travel as one row.
3. Edges go back to their buckets. Consecutive edges whose source coordinates are consecutive too lie on one
   unbranched path of their source and are compacted to one span; where a path branches, the source changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_count, bucket_of, gram_docs, grams, mix, words_of

WINDOW, GRAM = 13, 5
#: Places of an anchor from which on its edges meet by their own code.
HOT_ANCHOR = 100_000
_LAST = (1 << 63) - 1


def _anchors(codes: np.ndarray) -> np.ndarray:
    """Least gram hash of each window (a window has WINDOW - GRAM + 1 grams), to 48 bits."""
    g = grams(codes, GRAM, seed=5)
    width, have = WINDOW - GRAM + 1, 1
    low = g
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    return (low >> np.uint64(16)).astype(np.int64)


class _Bucket:
    """Documents of one bucket in a fixed order, and the windows that lie inside one of them."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_key", "ascending"), ("text_hash", "ascending")])
        self.words = words_of(self.table.column("text"))
        w = self.words
        self.key = self.table.column("doc_key").to_numpy()
        enough = len(w.codes) >= WINDOW
        self.doc, inside = gram_docs(w.first, WINDOW, len(w.codes))
        self.start = np.flatnonzero(inside)
        self.doc = self.doc[self.start]
        self.anchor = _anchors(w.codes)[self.start] if enough else np.zeros(0, np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First entries of the runs in which no column changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _bucket_id(table: pa.Table, n: int) -> np.ndarray:
    return np.full(n, table.column("bucket")[0].as_py() if table.num_rows else 0, np.int32)


def _first_anchors(table: pa.Table) -> pa.Table:
    """Distinct anchors of a bucket: least document, whether there are more, and in how many places."""
    b = _Bucket(table)
    run = _starts(b.anchor, b.doc)
    anchor, key = b.anchor[run], b.key[b.doc[run]]
    order = np.argsort(anchor, kind="stable")
    anchor, key = anchor[order], key[order]
    begin = _starts(anchor)
    if not len(begin):
        return pa.table({"anchor": anchor, "bucket": _bucket_id(table, 0), "low": key, "many": np.zeros(0, bool), "n": np.zeros(0, np.int32)})
    low, high = np.minimum.reduceat(key, begin), np.maximum.reduceat(key, begin)
    return pa.table({"anchor": anchor[begin], "bucket": _bucket_id(table, len(begin)), "low": low, "many": low < high,
                     "n": np.diff(np.append(begin, len(anchor))).astype(np.int32)})


_PATH = "meet long, bucket int, doc_key long, row int, at int, edges int, source_key long, source_at int, codes binary"


def _edges(docs: pa.Table, anchors: pa.Table) -> pa.Table:
    """Candidate edges of a bucket, packed into runs.

    Runs of edges in their bucket's first document that has them wait for other buckets (``codes``, no source yet);
    they meet under their anchor, or each under its own code where an anchor is very frequent. Edges of later
    documents have their source in the bucket already.
    """
    b = _Bucket(docs)
    wanted = anchors.sort_by("anchor")
    values, hot = wanted.column("anchor").to_numpy(), wanted.column("hot").to_numpy(zero_copy_only=False)
    place = np.searchsorted(values, b.anchor)
    place[place == len(values)] = 0
    pick = np.flatnonzero(values[place] == b.anchor) if len(values) else np.zeros(0, np.int64)
    start, doc, anchor, hot = b.start[pick], b.doc[pick], b.anchor[pick], hot[place[pick]] if len(values) else np.zeros(0, bool)
    edge = grams(b.words.codes, WINDOW, seed=13)[start].view(np.int64)
    at, key = (start - b.words.first[doc]).astype(np.int32), b.key[doc]
    # Rows are in document order, so a stable sort leaves the first occurrence of an edge in front.
    order = np.lexsort((edge, anchor))
    first = _starts(anchor[order], edge[order])
    source = np.zeros(len(edge), np.int64)
    source[order] = np.repeat(order[first], np.diff(np.append(first, len(edge))))
    waits = key == key[source]

    own = np.flatnonzero(waits)
    step = np.cumsum(np.append(0, np.diff(start[own]) != 1)[:len(own)])
    single = np.where(hot[own], np.arange(len(own)), -1)
    run = _starts(doc[own], anchor[own], step, single)
    ends = np.append(run, len(own)).astype(np.int32) * 8
    codes = pa.Array.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(edge[own].tobytes())])
    head = own[run]
    none = pa.nulls(len(run))
    waiting = pa.table({
        "meet": np.where(hot[head], edge[head], anchor[head]), "bucket": _bucket_id(docs, len(run)), "doc_key": key[head],
        "row": doc[head].astype(np.int32), "at": at[head], "edges": none.cast(pa.int32()), "source_key": none.cast(pa.int64()),
        "source_at": none.cast(pa.int32()), "codes": codes})

    later = np.flatnonzero(~waits)
    from_, shift = source[later], start[later] - start[source[later]]
    step = np.cumsum(np.append(0, np.diff(start[later]) != 1)[:len(later)])
    run = _starts(doc[later], doc[from_], shift, step)
    head = later[run]
    settled = pa.table({
        "meet": mix(head.astype(np.uint64)).view(np.int64), "bucket": _bucket_id(docs, len(run)), "doc_key": key[head],
        "row": doc[head].astype(np.int32), "at": at[head], "edges": np.diff(np.append(run, len(later))).astype(np.int32),
        "source_key": key[source[head]], "source_at": at[source[head]], "codes": pa.nulls(len(run), pa.binary())})
    return pa.concat_tables([waiting, settled])


_SPAN = "bucket int, doc_key long, row int, at int, edges int, source_key long, source_at int"
_SPAN_COLUMNS = ["bucket", "doc_key", "row", "at", "edges", "source_key", "source_at"]


def _sourced(table: pa.Table) -> pa.RecordBatch:
    """Give waiting edges the first (document, word) that has them; keep those that a smaller document has."""
    meet, bucket, key, row, at = (table.column(c).to_numpy() for c in ("meet", "bucket", "doc_key", "row", "at"))
    packed = table.column("codes").combine_chunks()
    length = np.diff(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]) // 8
    begin = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
    code = np.frombuffer(packed.buffers()[2], np.uint8)[begin:begin + 8 * int(length.sum())].copy().view(np.int64)
    run = np.repeat(np.arange(len(meet)), length)
    where = at[run] + (np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length))
    order = np.lexsort((where, key[run], code, meet[run]))
    first = _starts(meet[run[order]], code[order])
    source = np.zeros(len(run), np.int64)
    source[order] = np.repeat(order[first], np.diff(np.append(first, len(run))))
    from_, to = key[run[source]], where[source]
    hit = np.flatnonzero(from_ < key[run])
    shift, step = (where - to)[hit], np.cumsum(np.append(0, np.diff(hit) != 1)[:len(hit)])
    head = _starts(run[hit], from_[hit], shift, step)
    i = hit[head]
    return pa.RecordBatch.from_pydict({
        "bucket": bucket[run[i]], "doc_key": key[run[i]], "row": row[run[i]], "at": where[i].astype(np.int32),
        "edges": np.diff(np.append(head, len(hit))).astype(np.int32), "source_key": from_[i], "source_at": to[i].astype(np.int32)})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle the edges of a partition sorted by meeting place, one run of whole places at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        settled = batch.filter(pc.is_null(batch.column("codes")))
        if settled.num_rows:
            yield settled.select(_SPAN_COLUMNS)
        batch = batch.filter(pc.is_valid(batch.column("codes")))
        if not batch.num_rows:
            continue
        meet = batch.column("meet").to_numpy()
        cut = int(np.searchsorted(meet, meet[-1]))
        if cut or (held and held[-1].column("meet")[-1].as_py() != meet[-1]):
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else None
            if whole is not None and whole.num_rows:
                yield _sourced(whole)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _sourced(pa.Table.from_batches(held))


def _kept(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Cut the words under the spans of a bucket out of its documents."""
    b = _Bucket(docs)
    w = b.words
    delta = np.zeros(len(w.starts) + 1, np.int64)
    first = w.first[spans.column("row").to_numpy()]
    begin = first + spans.column("start").to_numpy()
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + spans.column("edges").to_numpy() + WINDOW - 1, -1)
    gone = np.cumsum(delta[:-1]) > 0
    texts, removed = [], []
    for i, text in enumerate(b.table.column("text").to_pylist()):
        mask = gone[w.first[i]:w.first[i + 1]]
        n = int(mask.sum())
        found = (text or "").encode().split()
        texts.append(b" ".join(compress(found, ~mask) if n else found).decode())
        removed.append(n)
    rest = {"rest": b.table.column("rest")} if "rest" in b.table.column_names else {}
    return pa.table({"doc_id": b.table.column("doc_id"), "n_words": np.diff(w.first).astype(np.int64),
                     "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string()), **rest})


def _bucketed(docs: DataFrame, *more: Column) -> DataFrame:
    count = bucket_count(docs)
    key: Column = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    return docs.select("doc_id", "text", key.alias("doc_key"), F.xxhash64("text").alias("text_hash"),
                       bucket_of(count, "doc_id", "text").alias("bucket"), *more)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Maximal runs of windows of a document that also start in a document with a smaller id.

    Columns: bucket, doc_key, row (place in the bucket), start (word), edges (windows), source_key, source_start. The
    span's windows equal those of the source from ``source_start`` on.
    """
    base = _bucketed(docs)
    anchors = base.groupBy("bucket").applyInArrow(_first_anchors, "anchor long, bucket int, low long, many boolean, n int")
    same = W.partitionBy("anchor")
    anchors = anchors.select("anchor", "bucket", (F.sum("n").over(same) > HOT_ANCHOR).alias("hot"), F.max("many").over(same).alias("many"),
                             F.min("low").over(same).alias("from"), F.max("low").over(same).alias("to"))
    anchors = anchors.where("many or from < to").select("bucket", "anchor", "hot")
    packed = base.groupBy("bucket").cogroup(anchors.groupBy("bucket")).applyInArrow(_edges, _PATH)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of each bucket only the first document with an edge is left, so a very frequent edge has few rows.
    steps = packed.repartition(partitions, "meet").sortWithinPartitions("meet").mapInArrow(_meet, _SPAN)
    # Paths of different anchors that continue each other in document and source are joined to one.
    steps = steps.withColumn("shift", F.col("at") - F.col("source_at"))
    path = W.partitionBy("bucket", "row", "source_key", "shift").orderBy("at")
    fresh = F.coalesce((F.lag(F.col("at") + F.col("edges")).over(path) < F.col("at")).cast("int"), F.lit(1))
    steps = steps.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(path))
    return steps.groupBy("bucket", "doc_key", "row", "source_key", "shift", "island").agg(
        F.min("at").alias("start"), (F.max(F.col("at") + F.col("edges")) - F.min("at")).alias("edges")).select(
        "bucket", "doc_key", "row", "start", "edges", "source_key", (F.col("start") - F.col("shift")).alias("source_start"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Cut from each row of ``docs`` (``doc_id``, ``text``) the words that documents with smaller ids have already.

    A word goes when a window of WINDOW consecutive words covers it whose word sequence also starts in a document with
    a smaller ``doc_id``; windows are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte
    (as hashes of over 100 bits). Returns ``doc_id, n_words, n_removed, kept_text``, kept words joined by one space. Null
    and short texts lose nothing; a null id counts as the largest; rows of one id do not shorten each other, and rows
    keep their number. More columns are ignored. An empty table gives an empty result.
    """
    base, spans = _bucketed(docs), repeated_spans(docs)
    return base.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept_text string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with repeated words cut out of ``text`` (and ``n_chars`` set anew where there is such a column).

    A text that loses nothing stays as it is; one that loses all its words goes. Other columns are carried along.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    base, spans = _bucketed(docs, rest), repeated_spans(docs)
    schema = T.StructType([*T.DataType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string"), base.schema["rest"]])
    kept = base.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(_kept, schema)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("rest.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return kept.where("n_removed = 0 or n_removed < n_words").select(
        *[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"rest.`{c}`") for c in docs.columns])
