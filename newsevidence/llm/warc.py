"""WARC archives with a two-level capture index.

Level one is a sparse directory with the first key of each compressed block; level two are the blocks, lines sorted by
reversed-host key. A look-up bisects the directory of one index part, range-reads the blocks that can hold the key, and
range-reads the records they point to. All files lie in one folder that every executor shares.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Payloads of at least so many bytes are stored once; copies become revisit records.
REVISIT_BYTES = 100
#: Lines of an index block, and bytes after which an archive file is closed.
BLOCK_LINES, ARCHIVE_BYTES = 256, 1 << 30
#: Size up to which the digests of repeated payloads may travel to every task.
BROADCAST_BYTES = 32 << 20
#: Records carry this date; the tables have no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: Column) -> Column:
    """Reversed-host key: ``http://www.a.org/x?y#z`` gives ``org,a,www)/x?y``.

    Scheme, user, fragment and the ports 80 and 443 are dropped, the host is lower-cased. Anything that is no such URL
    is its own key behind ``)``; null gives ``)``.
    """
    url = F.coalesce(url, F.lit(""))
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r":(80|443)?$", "")
    back = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    path = F.regexp_extract(url, parts, 2)
    path = F.when(F.substring(path, 1, 1) == "/", path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host == "", F.concat(F.lit(")"), url)).otherwise(F.concat(back, F.lit(")"), path))


def _record(kind: str, name: str, row: dict) -> bytes:
    payload = (row["html"] or "").encode()
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join((row["url"] or "urn:none").split()), f"WARC-Payload-Digest: sha256:{row['digest']}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:{row['target']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_ENTRY = "key string, page_id long, record string, kind string, keeper_id long, target string, file string, offset long, length long"
_COLUMNS = [f.split(" ")[0] for f in _ENTRY.split(", ")]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, file, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        # Each attempt of a task has files of its own; only those it reports are ever read.
                        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{file}", compression=None)
                    kind = "response" if row["target"] is None else "revisit"
                    # There is one response to a payload that others may revisit, so the payload names it.
                    name = f"sha256:{row['digest']}" if kind == "response" and row["bytes"] >= REVISIT_BYTES else f"record:{file}:{at}"
                    data = _gzip(_record(kind, name, row))
                    out.write(data)
                    found.append((row["key"], row["page_id"], name, kind, row["keeper_id"], row["target"], file, at, len(data)))
                    at += len(data)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if i in (1, 4, 7, 8) else pa.string()) for i, c in enumerate(zip(*found))], names=_COLUMNS)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one WARC record per row of ``pages`` (``page_id``, ``url``, ``html``) and return the captures.

    Payload is the html in UTF-8, null is empty. Among equal payloads of at least ``REVISIT_BYTES`` the smallest
    ``page_id`` (null last, then url) is the response and the others revisit it; all others are responses. Fully equal
    rows are as many records. Every record is a gzip member of its own. Which payloads occur again is settled on digests, counted
    by row content; responses are then written straight from a second scan, and revisits, which have no payload, from the
    counts. Payloads are neither staged nor shuffled while the table of repeated digests is within ``BROADCAST_BYTES``;
    beyond that they are joined with it. Columns: key, page_id, record, kind, keeper_id, target, file, offset, length.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    size, digest = F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest")
    counted = pages.select("page_id", "url", size, digest).where(F.col("bytes") >= REVISIT_BYTES)
    counted = staged(counted.groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("n")), folder, "counted")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("url").isNull().alias("bare"), F.col("url").alias("url"))
    again = counted.groupBy("digest", "bytes").agg(F.min(order).alias("k"), F.sum("n").alias("all"), F.min_by("n", order).alias("twins")).where(F.col("all") > 1)
    again = staged(again.select("digest", "bytes", F.col("k.id").alias("keeper_id"), F.col("k.url").alias("keeper_url"), "twins"), folder, "again")
    held = F.broadcast(again) if again.count() * 256 <= BROADCAST_BYTES else again
    known = held.withColumn("repeated", F.lit(True))
    is_keeper = F.col("page_id").eqNullSafe(F.col("keeper_id")) & F.col("url").eqNullSafe(F.col("keeper_url"))

    rows = pages.select("page_id", "url", "html", size, digest).join(known, ["digest", "bytes"], "left")
    names = ["page_id", "url", "html", "key", "digest", "bytes", "keeper_id", "target"]
    none = [F.lit(None).cast("long").alias("keeper_id"), F.lit(None).cast("string").alias("target")]
    key = url_key(F.col("url")).alias("key")
    single = rows.where(F.col("repeated").isNull() | (is_keeper & (F.col("twins") == 1))).select("page_id", "url", "html", key, "digest", "bytes", *none)
    one_of = rows.where(is_keeper & (F.col("twins") > 1)).dropDuplicates(["digest", "bytes"]).select("page_id", "url", "html", key, "digest", "bytes", *none)
    copies = counted.join(held, ["digest", "bytes"]).withColumn("copies", (F.col("n") - is_keeper.cast("long")).cast("int")).where("copies > 0")
    copies = copies.withColumn("turn", F.explode(F.sequence(F.lit(1), "copies")))
    target = F.concat(F.lit("sha256:"), "digest").alias("target")
    revisits = copies.select("page_id", "url", F.lit(None).cast("string").alias("html"), key, "digest", "bytes", "keeper_id", target)
    written = [df.select(*names).mapInArrow(_write(f"{folder}/archives"), _ENTRY) for df in (single, one_of, revisits)]
    return staged(written[0].unionByName(written[1]).unionByName(written[2]), folder, "captures")


def _index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, directory, lines, at = uuid.uuid4().hex, [], [], 0
        out, last = None, ""

        def close_block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append((first, at, len(data)))
            at, lines = at + len(data), []

        first = ""
        for batch in batches:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(f"{root}/{name}.blocks", compression=None)
                first = first if lines else row["key"]
                lines.append(json.dumps([row[c] for c in _COLUMNS]))
                last = row["key"]
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as sparse:
                sparse.write(zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.RecordBatch.from_pydict({"part": [name], "first": [directory[0][0]], "last": [last], "blocks": pa.array([len(directory)], pa.int64())})

    return run


def write_index(captures: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Sort captures by key into index parts and return ``part, first, last, blocks``, one row per part.

    Keys are range-partitioned together with the place of the record, so captures of one very frequent key spread over parts.
    """
    parts = parts or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return staged(ordered.mapInArrow(_index(f"{folder}/index"), "part string, first string, last string, blocks long"), folder, "parts")


def _route(bounds: list[tuple[str, str, str]]):
    """Parts that can hold a key. ``bounds`` has a row per index part; parts are ordered and may share border keys."""
    firsts, lasts = [b[1] for b in bounds], [b[2] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = [], []
            for key in batch.column(0).to_pylist():
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    keys.append(key)
                    parts.append(bounds[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(parts, pa.string())], names=["key", "part"])

    return run


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (after the HTTP head) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


_CAPTURE = "key string, page_id long, record string, record_type string, target_id long, target string, payload_digest string, payload binary"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, starts, directory, blocks, held, handles = None, [], [], None, (None, []), {}

        def lines(i: int) -> list[list]:
            nonlocal held
            if held[0] != i:
                blocks.seek(directory[i][1])
                held = (i, [json.loads(x) for x in zlib.decompress(blocks.read(directory[i][2])).decode().split("\n")])
            return held[1]

        def record(file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
            if file not in handles:
                if len(handles) >= 64:
                    handles.pop(next(iter(handles))).close()
                handles[file] = store.open_input_file(f"{root}/archives/{file}")
            handles[file].seek(offset)
            return parse_record(zlib.decompress(handles[file].read(length), 31))

        found, size = [], 0

        def emit() -> pa.RecordBatch:
            nonlocal found, size
            columns = list(zip(*found))
            found, size = [], 0
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["key", "page_id", "record", "record_type", "target_id", "target", "payload_digest", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for key, owner in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if owner != part:
                    if blocks is not None:
                        blocks.close()
                    with store.open_input_stream(f"{root}/index/{owner}.directory", compression=None) as sparse:
                        directory = json.loads(zlib.decompress(sparse.read()))
                    part, starts, held = owner, [d[0] for d in directory], (None, [])
                    blocks = store.open_input_file(f"{root}/index/{owner}.blocks")
                low = max(0, bisect.bisect_left(starts, key) - 1)
                for i in range(low, bisect.bisect_right(starts, key)):
                    for entry in lines(i):
                        if entry[0] != key:
                            continue
                        fields, payload = record(*entry[6:9])
                        again = fields["WARC-Type"] == "revisit"
                        target = fields["WARC-Refers-To"][len("<urn:"):-1] if again else None
                        found.append((key, entry[1], fields["WARC-Record-ID"][len("<urn:"):-1], fields["WARC-Type"],
                                      entry[4], target, fields["WARC-Payload-Digest"].removeprefix("sha256:"), None if again else payload))
                        size += len(payload)
                        if size > 4 << 20:
                            yield emit()
        if found:
            yield emit()
        for handle in [*handles.values(), *([blocks] if blocks is not None else [])]:
            handle.close()

    return run


def look_up(keys: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """All captures of the distinct values of ``keys`` (one column), read back from the archives.

    Only the bounds of the index parts reach the driver (one row per part, their number set by the writer). Columns:
    key, page_id, record, record_type, target_id, target, payload_digest (as stored), payload (null for revisits).
    Keys without a capture and null keys give no row.
    """
    bounds = sorted((tuple(r) for r in parts.select("part", "first", "last").collect()), key=lambda b: (b[1], b[2]))
    wanted = keys.toDF("key").where("key is not null").distinct()
    routed = wanted.mapInArrow(_route(bounds), "key string, part string")
    routed = routed.repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", "key")
    return routed.mapInArrow(_read(folder), _CAPTURE)


def resolved(captures: DataFrame) -> DataFrame:
    """Give every capture the size and digest of its full payload, computed from what was read back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A revisit takes both from the response
    it refers to; the join moves numbers only.
    """
    measured = captures.select(
        "page_id", "record", "record_type", "target_id", "target", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest"))
    measured = staged(measured)
    first = measured.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = measured.where("record_type = 'revisit'").select("page_id", "target_id", "target")
    kept = measured.where("record_type = 'response'").select(F.col("record").alias("target"), "payload_bytes", "payload_digest")
    kept = kept.join(again.select("target").distinct(), "target", "left_semi")
    again = again.join(kept, "target").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("target_id").alias("refers_to"))
    return first.unionByName(again)
