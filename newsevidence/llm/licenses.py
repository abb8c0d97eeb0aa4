"""Licence scans: sparse TF-IDF cosine of lines, runs of words and whole files to templates, then inheritance down the
path tree."""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import run_folder, slices, staged

#: Usual notices by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "Copyright. All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    *((f"{name}-{v}.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
      for name, kind, v in (("GPL", "General", 2), ("GPL", "General", 3), ("LGPL", "Lesser General", 3), ("AGPL", "Affero General", 3))),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]
#: Full texts of licences; they are compared with whole texts only.
TEXTS: list[tuple[str, str]] = [
    (name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode())
    for name in ("Apache-2.0", "MIT", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
]
#: Stands in the texts of other licences too, so any other licence found goes before it.
_WEAK = "All-rights-reserved"
#: Least cosine of a line (header) and of a whole text (licence file).
HEADER, FILE = 0.75, 0.6
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_NAMES = r"(?i)(^|/)(licen[cs]e|copying|copyright|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Templates:
    """Weighted template vectors. A term's weight is its count times ln((1 + N) / (1 + df)) + 1; terms that no template
    has weigh 1 per occurrence, as if every text held them."""

    def __init__(self, total: int, found: dict[str, int], templates: list[tuple[str, str]] | None = None, least: float | None = None):
        self.names = [n for n, _ in (TEMPLATES if templates is None else templates)]
        counts = [Counter(terms(t)) for _, t in (TEMPLATES if templates is None else templates)]
        self.least = min(HEADER, FILE) if least is None else least
        self.idf = {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for c in counts for t in c}
        self.vectors = [{t: n * self.idf[t] for t, n in c.items()} for c in counts]
        self.norms = [math.sqrt(sum(w * w for w in v.values())) for v in self.vectors]
        self.lengths = [sum(c.values()) for c in counts]
        self.having: dict[str, list[int]] = {}
        for i, v in enumerate(self.vectors):
            for t in v:
                self.having.setdefault(t, []).append(i)
        # What lacks all of a template's heaviest terms can't reach the least cosine with the others alone.
        self.seeds: set[str] = set()
        for v, norm in zip(self.vectors, self.norms):
            rest = norm * norm
            for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
                if math.sqrt(max(rest, 0)) < self.least * norm:
                    break
                self.seeds.add(t)
                rest -= w * w

    def near(self, counts, least: float) -> list[int]:
        """Templates that any choice of these terms can reach ``least`` with: the terms in common weigh enough."""
        mass: Counter = Counter()
        for t in counts:
            for i in self.having.get(t, ()):
                mass[i] += self.vectors[i][t] ** 2
        return sorted(i for i, m in mass.items() if m >= (least * self.norms[i]) ** 2 * (1 - 1e-9))

    def best(self, text: str) -> tuple[float, int]:
        """Highest cosine to a template, and the template (the first on a tie)."""
        return self.of_counts(Counter(terms(text)), 0.0)

    def of_counts(self, counts: Counter, least: float) -> tuple[float, int]:
        near = self.near(counts, least) if counts else []
        if not near:
            return 0.0, -1
        norm = math.sqrt(sum((n * self.idf.get(t, 1.0)) ** 2 for t, n in counts.items()))
        scored = [(sum(w * counts[t] * self.idf[t] for t, w in self.vectors[i].items() if t in counts) / norm / self.norms[i], -i) for i in near]
        score, i = max(scored)
        return min(score, 1.0), -i

    def in_run(self, words: list[str], i: int) -> float:
        """Highest cosine of template ``i`` to a run of as many words, wherever lines and comments break."""
        vector, idf, n = self.vectors[i], self.idf, self.lengths[i]
        count: Counter = Counter()
        dot = square = top = 0.0
        for k, t in enumerate(words):
            for x, step in ((t, 1), (words[k - n] if k >= n else None, -1)):
                if x is not None:
                    w, c = idf.get(x, 1.0), count[x]
                    dot += step * w * vector.get(x, 0.0)
                    square += w * w * step * (2 * c + step)
                    count[x] = c + step
            if dot > top * self.norms[i] * math.sqrt(max(square, 1e-9)):
                top = dot / self.norms[i] / math.sqrt(square)
        return min(top, 1.0)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and texts that hold each template term, counted per task."""
    wanted = {t for _, text in [*TEMPLATES, *TEXTS] for t in terms(text)}
    found, total = Counter(), 0
    for batch in batches:
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                total += 1
                found.update(wanted.intersection(terms(text or "")))
    yield pa.RecordBatch.from_pydict({"term": pa.array(["", *found], pa.string()), "n": pa.array([total, *found.values()], pa.int64())})


def _judge(text: str, known: Templates, full: Templates) -> tuple:
    """Header and its score, licence of the whole text and its score; null where nothing reaches its least cosine."""
    words = terms(text)
    counts = Counter(words)
    # A licence's full text names other licences, so it goes before the notices in it.
    score, i = full.of_counts(counts, FILE)
    if score >= FILE:
        return None, None, full.names[i], score
    near = known.near(counts, min(HEADER, FILE))
    if not near:
        return None, None, None, None
    scored: dict[int, float] = {i: known.in_run(words, i) for i in near}
    for line in text.lower().split("\n"):
        score, i = known.of_counts(Counter(terms(line)), HEADER)
        if i >= 0:
            scored[i] = max(scored.get(i, 0.0), score)
    found = [(known.names[i] != _WEAK, s, -i) for i, s in scored.items() if s >= HEADER]
    best = max(found, default=None)
    score, i = known.of_counts(counts, FILE)
    return (known.names[-best[2]] if best else None, best[1] if best else None,
            known.names[i] if score >= FILE else None, score if score >= FILE else None)


def _scan(total: int, found: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, full = Templates(total, found), Templates(total, found, TEXTS, FILE)
        for batch in batches:
            for part in slices(batch):
                judged = [_judge(text or "", known, full) for text in part.column("text").to_pylist()]
                header, header_score, whole, whole_score = zip(*judged)
                keep = [i for i, n in enumerate(part.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in keep), pa.array(header, pa.string()), pa.array(header_score, pa.float64()),
                     pa.array(whole, pa.string()), pa.array(whole_score, pa.float64())],
                    names=[*(part.schema.names[i] for i in keep), "header", "header_score", "whole", "whole_score"])

    return run


def folder_of(path: Column) -> Column:
    """Everything before the last slash; no slash gives the root, the empty path."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame) -> DataFrame:
    """Find the licence of every row of ``files`` (``doc_id``, ``path``, ``text``).

    A line, or a run of as many words as a template has, whose TF-IDF cosine to the template is at least HEADER is a
    header; line breaks and comment marks don't count, and All-rights-reserved is a header only where there is no other.
    A text that reaches FILE with the full text of a licence is that licence's file, and notices in it are no headers. A file is a licence file when its whole
    text reaches FILE, or when it is named like one and has a header; it speaks for its directory and all below. A file
    takes its own header (``basis`` header), else its own whole text (file), else the licence of the nearest directory
    above it that has a licence file (inherited): of several there the highest score, then the smallest id. Document
    frequencies cover all rows; whole texts are read. Returns ``doc_id, path, license, basis, score, from_folder``,
    null where nothing is found. Null texts hold nothing, a null path lies in the root. Rows keep their number; more
    columns are ignored. An empty table gives an empty result.

    Inheritance is settled once per distinct directory, so a directory with very many files is one row there.
    """
    rows = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), "text")
    counted = rows.select("text").mapInArrow(_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in counted.collect()}  # at most one row per template term
    total = found.pop("", 0)
    schema = "doc_id long, path string, header string, header_score double, whole string, whole_score double"
    seen = staged(rows.mapInArrow(_scan(total, found), schema), run_folder(files.sparkSession), "seen")
    seen = seen.withColumn("folder", folder_of(F.col("path")))
    speaks = seen.where(F.col("whole").isNotNull() | (F.col("path").rlike(_NAMES) & F.col("header").isNotNull()))
    speaks = speaks.withColumn("l", F.coalesce("whole", "header")).withColumn("s", F.coalesce("whole_score", "header_score"))
    folders = speaks.groupBy(F.col("folder").alias("above")).agg(
        F.max_by(F.struct("l", "s"), F.struct("s", -F.coalesce("doc_id", F.lit((1 << 63) - 1)), "l")).alias("v"))
    parts = F.split("folder", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    wanted = seen.where("header is null and whole is null").select("folder").distinct()
    above = wanted.select("folder", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), chain))).alias("above"))
    nearest = above.join(folders, "above").groupBy("folder").agg(F.max_by(F.struct("above", "v"), F.length("above")).alias("n"))
    out = seen.join(nearest, "folder", "left")
    own = F.coalesce("header", "whole")
    return out.select(
        "doc_id", "path", F.coalesce(own, "n.v.l").alias("license"),
        F.when(F.col("header").isNotNull(), "header").when(F.col("whole").isNotNull(), "file").when(F.col("n").isNotNull(), "inherited").alias("basis"),
        F.when(F.col("header").isNotNull(), F.col("header_score")).otherwise(F.coalesce("whole_score", "n.v.s")).alias("score"),
        F.when(own.isNull(), F.col("n.above")).alias("from_folder"))
