"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_folder, seeded, slices, staged

#: Dimensions of a vector and letters in a gram. Prototypes take languages x DIMENSIONS values, whatever the input.
DIMENSIONS, GRAM = 1024, 3
_CELLS = 1 << 21


class _Letters:
    """Code point to letter symbol; everything that is no letter is one break symbol (0)."""

    table: np.ndarray | None = None

    @classmethod
    def symbols(cls, text: str) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(cls.table[points], points, 0)


def _letter_vectors(points: np.ndarray, dim: int) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each code point."""
    out = np.empty((len(points), dim), np.int8)
    for i, p in enumerate(points.tolist()):
        bits = np.unpackbits(seeded(-(-dim // 64), 7_000_003 + p).view(np.uint8))[:dim]
        out[i] = bits.astype(np.int8) * 2 - 1
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a run of texts: letters in use, distinct grams over them, and (text, gram index) of each position.

    Runs of non-letters count as one break, so grams know where words begin and end, and no gram spans texts.
    """
    stream, owner = [], []
    for i, text in enumerate(texts):
        s = _Letters.symbols(text.lower())
        if len(s):
            s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        if s.any():
            s = np.concatenate(([0], s[int(s[0] == 0):], [0] if s[-1] else []))
            stream.append(s.astype(np.int64))
            owner.append(np.full(len(s), i, np.int32))
    if not stream:
        none = np.zeros(0, np.int64)
        return none, none.reshape(0, GRAM), none, none
    s, o = np.concatenate(stream), np.concatenate(owner)
    if int(s.max()) < 0x800:
        seen = np.zeros(0x800, bool)
        seen[s] = True
        letters = np.flatnonzero(seen)
        index = np.zeros(0x800, np.int64)
        index[letters] = np.arange(len(letters))
        codes = index[s]
    else:
        letters, codes = np.unique(s, return_inverse=True)
    n, count = len(letters), len(s) - GRAM + 1
    keys = np.zeros(count, np.int64)
    for j in range(GRAM):
        keys = keys * n + codes[j:j + count]
    inside = o[:count] == o[GRAM - 1:]
    keys, who = keys[inside], o[:count][inside]
    if n ** GRAM <= 1 << 21:
        seen = np.zeros(n ** GRAM, bool)
        seen[keys] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(n ** GRAM, np.int32)
        place[distinct] = np.arange(len(distinct))
        at = place[keys]
    else:
        distinct, at = np.unique(keys, return_inverse=True)
    parts = np.stack([distinct // n ** (GRAM - 1 - j) % n for j in range(GRAM)], axis=1)
    return letters, parts, who.astype(np.int64), at.astype(np.int64)


def _bound(letters: np.ndarray, parts: np.ndarray, dim: int) -> np.ndarray:
    """Gram vectors: the letter vectors, permuted (rotated) once per place from the end, multiplied."""
    base = _letter_vectors(letters, dim)
    out = base[parts[:, GRAM - 1]].copy()
    for j in range(GRAM - 1):
        out *= np.roll(base, GRAM - 1 - j, axis=1)[parts[:, j]]
    return out


def _bundles(groups: np.ndarray, n_groups: int, letters, parts, at, dim: int) -> np.ndarray:
    """Sum of the gram vectors of each group, in blocks of bounded size."""
    out = np.zeros((n_groups, dim), np.float32)
    width = max(256, _CELLS // max(1, n_groups))
    for lo in range(0, len(parts), width):
        hi = min(len(parts), lo + width)
        pick = slice(None) if (lo, hi) == (0, len(parts)) else (at >= lo) & (at < hi)
        counts = np.bincount(groups[pick] * (hi - lo) + at[pick] - lo, minlength=n_groups * (hi - lo))
        counts = counts.reshape(n_groups, hi - lo).astype(np.float32)
        out += counts @ _bound(letters, parts[lo:hi], dim).astype(np.float32)
    return out


def _partial(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                group = np.array([names.index(x) for x in langs])
                letters, parts, who, at = _grams(part.column("text").to_pylist())
                if len(at):
                    for name, v in zip(names, _bundles(group[who], len(names), letters, parts, at, dim).astype(np.float64)):
                        sums[name] = sums.get(name, 0) + v
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    return run


def language_prototypes(labelled: DataFrame, dim: int = DIMENSIONS) -> DataFrame:
    """``lang, vector``: the bundle of all grams of all texts of a language (``text``, ``lang``; nulls are left out).

    Tasks bundle their own rows; what is shuffled is one vector per task and language.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    sums = rows.mapInArrow(_partial(dim), "lang string, v array<double>")
    cells = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))


def _predict(names: list[str], prototypes: np.ndarray):
    dim = prototypes.shape[1] if len(names) else DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
        common = unit.mean(axis=0) if len(unit) > 1 else np.zeros(dim)
        centred = unit - common
        centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").fill_null("").to_pylist()
                letters, parts, who, at = _grams(texts)
                has = np.zeros(len(texts), bool)
                has[who] = True
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if len(at) and len(names):
                    docs = _bundles(who, len(texts), letters, parts, at, dim).astype(np.float64)
                    docs /= np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-12)
                    docs -= common
                    docs /= np.maximum(np.linalg.norm(docs, axis=1, keepdims=True), 1e-12)
                    cosine = docs @ centred.T
                    best, score = cosine.argmax(axis=1), np.clip((cosine.max(axis=1) + 1) / 2, 0, 1)
                keep = [i for i, n in enumerate(part.schema.names) if n != "text"]
                lang = [names[b] if h and names else "und" for h, b in zip(has.tolist(), best.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0))],
                    names=[*(part.schema.names[i] for i in keep), "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, train: Column, dim: int = DIMENSIONS) -> DataFrame:
    """Predict the language of every row of ``docs`` (``doc_id``, ``text``, ``lang``), learning where ``train`` holds.

    Returns ``doc_id, held_out, lang_pred, score``; ``held_out`` is the negation of ``train``, ``score`` the cosine to
    the winning prototype mapped to 0..1, after the mean of all prototypes is taken off both (what languages share
    says nothing). Texts that are null or without a letter are ``und`` with score 0, as is every text if nothing can
    be learnt. Ties go to the language that sorts first. Rows keep their number; more columns are ignored. Only
    languages x dimensions values reach the driver. An empty table gives an empty result.
    """
    marked = docs.select("doc_id", "text", "lang", (~F.coalesce(train, F.lit(False))).alias("held_out"))
    table = staged(language_prototypes(marked.where("not held_out"), dim), run_folder(docs.sparkSession), "prototypes")
    found = sorted(((r["lang"], r["vector"]) for r in table.collect()), key=lambda r: r[0])
    vectors = np.array([v for _, v in found], np.float64).reshape(len(found), dim)
    rows = marked.select("doc_id", "held_out", "text")
    return rows.mapInArrow(_predict([n for n, _ in found], vectors), "doc_id long, held_out boolean, lang_pred string, score double")
