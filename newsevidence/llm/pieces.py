"""SentencePiece encoding and decoding through a table of distinct whitespace-marked chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
#: A run of markers with the characters up to the next one.
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries after which a task's chunk table starts anew; bounds its memory, changes no result.
TABLE_ENTRIES = 1_000_000


def crosses_marker(piece: str) -> bool:
    """Whether a piece holds a marker behind another character."""
    return MARK in piece.lstrip(MARK)


class _Chunks:
    """Distinct chunk to its ids, their number and decoded text; every chunk is segmented once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.model
        if any(crosses_marker(sp.id_to_piece(i)) for i in range(sp.get_piece_size())
               if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))):
            raise ValueError("pieces cross whitespace markers; chunks cannot be segmented apart")
        if sp.encode("  a  b ", out_type=str)[0].startswith(MARK) is False or sp.normalize("  a  b ") != f"{MARK}{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("the model's normalisation changes white space")
        self.same = all(sp.normalize(x) == MARK + x for x in ("ﬁ", "é", "é", "Ａ", "\t", "\n", "A"))
        self.table: dict[str, tuple[str, int, str]] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks of the normalised text; joined they give it back."""
        plain = MARK + text.replace(" ", MARK) if self.same and "\0" not in text else self.model.normalize(text)
        return _CHUNK.findall(plain)

    def segment(self, chunk: str) -> tuple[str, int, str]:
        sp = self.model
        # encode() puts a marker in front, so the chunk is passed without its first one.
        ids = sp.encode(chunk[1:].replace(MARK, " ")) if len(chunk) > 1 else [sp.piece_to_id(MARK)]
        # decode() drops the marker of its first piece, so a leading one is put in front and nothing is lost.
        text = sp.decode([sp.piece_to_id(MARK), *ids])
        return ",".join(map(str, ids)), len(ids), text

    def look_up(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        table = self.table
        if len(table) > TABLE_ENTRIES:
            table.clear()
        for c in set(chunks):
            if c not in table:
                table[c] = self.segment(c)
        return [table[c] for c in chunks]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Chunks(path)
        for batch in batches:
            for part in slices(batch):
                ids, counts, texts = [], [], []
                for text in part.column("text").to_pylist():
                    found = model.look_up(model.chunks(text)) if text else []
                    ids.append(",".join([f[0] for f in found]))
                    counts.append(sum([f[1] for f in found]))
                    # The first chunk's decoded form starts with the space of the added marker.
                    texts.append("".join([f[2] for f in found])[1:])
                keep = [i for i, n in enumerate(part.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in keep), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=[*(part.schema.names[i] for i in keep), "n_tokens", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every ``text`` of ``docs`` (``doc_id``, ``text``) as the library does, and decode the ids again.

    Returns ``doc_id, n_tokens, ids, decoded``; ``ids`` are decimal numbers joined by commas. No begin or end ids.
    Where no piece holds a marker behind another character, no merge can cross into the next marker, so a text is
    cut before each run of markers, each distinct chunk is segmented once into a table, and ids are put together by
    position. Tables are kept per task: a table for the whole corpus would need a shuffle of every word occurrence.
    Null and empty texts have no ids. Rows keep their number; more columns are ignored. A model whose pieces cross
    markers is refused. ``model_path`` must be readable on every executor.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(model_path), "doc_id long, n_tokens long, ids string, decoded string")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
