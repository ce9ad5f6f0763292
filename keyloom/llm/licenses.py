"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor.

A passage of a text is a sparse vector over its words. Passages are its lines, its blocks of neighbouring lines that are not
blank (a notice broken over the lines of a comment), and of licence files the whole text. Inverse document frequencies are
counted over all lines of all texts for the templates' words; a word in no template has the weight of a word seen nowhere,
since it adds to a passage's norm alone. A passage whose cosine to some template reaches `threshold` gives its file that
license. A file without one of its own takes the license of the nearest directory above it that has one: a directory's
license is that of the best matching licence file (LICENSE, COPYING, NOTICE and the like) directly in it; what stands in
the header of another file is that file's alone. Distinct directories, not files, are joined with their ancestors."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize

THRESHOLD = 0.6
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
_WORD = re.compile(r"\w+")

# Usual notices of well-known licenses, and the heads of their files.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
}
for _name, _notices in TEMPLATES.items():
    _notices.append(f"SPDX-License-Identifier: {_name}")


def _words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _merged(counts: list[Counter]) -> Counter:
    out: Counter = Counter()
    for c in counts:
        out.update(c)
    return out


class Matcher:
    """Template vectors under given line frequencies of their words."""

    def __init__(self, templates: dict[str, list[str]], lines: int, seen: dict[str, int]):
        vocabulary = sorted({w for notices in templates.values() for n in notices for w in _words(n)})
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.idf = np.array([math.log((1 + lines) / (1 + seen.get(w, 0))) + 1 for w in vocabulary])
        self.rare = (math.log(1 + lines) + 1) ** 2
        self.names, rows = [], []
        for name in sorted(templates):
            for notice in templates[name]:
                row = np.zeros(len(vocabulary))
                for w, n in Counter(_words(notice)).items():
                    row[self.place[w]] = n * self.idf[self.place[w]]
                self.names.append(name)
                rows.append(row / np.linalg.norm(row))
        self.rows = np.array(rows)
        self.squares = {w: self.idf[i] ** 2 for w, i in self.place.items()}

    def best(self, text: str, threshold: float, whole: bool = False) -> tuple[str | None, float]:
        """The license and cosine of the best passage; equal cosines go to the first template by name. (None, best cosine) below."""
        found, top = None, 0.0
        squares = self.squares

        def look(tf: Counter):
            nonlocal found, top
            known = {w: n for w, n in tf.items() if w in squares}
            inside = sum(n * n * squares[w] for w, n in known.items())
            outside = self.rare * (sum(n * n for n in tf.values()) - sum(n * n for n in known.values()))
            norm = math.sqrt(inside + outside)
            if not known or math.sqrt(inside) / norm <= top:  # a bound on the cosine
                return
            at = np.fromiter((self.place[w] for w in known), np.int64, len(known))
            cosines = self.rows[:, at] @ (np.fromiter(known.values(), np.float64, len(known)) * self.idf[at]) / norm
            best = int(np.round(cosines, 12).argmax())
            if cosines[best] > top:
                top = float(cosines[best])
                found = self.names[best] if top >= threshold else found

        every: list[Counter] = []
        block: list[Counter] = []
        lines: dict[str, Counter] = {}

        def close():
            if len(block) > 1:
                look(_merged(block))
            block.clear()

        for line in text.split("\n"):
            if line not in lines:
                lines[line] = Counter(_words(line))
                look(lines[line])
            if lines[line]:
                block.append(lines[line])
                if whole:
                    every.append(lines[line])
            elif not line.strip():
                close()
        close()
        if whole and len(every) > 1:
            look(_merged(every))
        return found, min(top, 1.0)


def line_frequencies(docs: DataFrame, text_col: str, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of lines of all texts, and for each of `words` (a bounded list) the number of lines that have it."""
    wanted = {w: i for i, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            counts = np.zeros(len(words) + 1, np.int64)
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    counts[-1] += 1
                    for w in set(_words(line)):
                        if w in wanted:
                            counts[wanted[w]] += 1
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word long, n long")
    found = {r.word: r.n for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.get(len(words), 0), {w: found.get(i, 0) for w, i in wanted.items()}


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, license, cosine, origin, from_dir, of_file) of every row of `docs`; of_file tells licence files.

    Texts are compared whole, whatever their length. origin is "own", "inherited" (from_dir says from which directory) or "none". Null and empty texts match nothing; a null
    path has no ancestors. Repeated rows keep a result each. Ties for a directory's license go to the higher cosine, then
    to the first name."""
    templates = templates or TEMPLATES
    bounded_batches(docs.sparkSession)
    vocabulary = sorted({w for notices in templates.values() for n in notices for w in _words(n)})
    lines, seen = line_frequencies(docs, text_col, vocabulary)
    matcher = Matcher(templates, lines, seen)

    def run(batches):
        for batch in batches:
            found = [matcher.best(t or "", threshold, f) for t, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            frame = pd.DataFrame(found, columns=["license", "cosine"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(frame.license.tolist(), pa.string()), pa.array(frame.cosine.to_numpy(np.float64)), batch.column(3)], ["id", "path", "own", "cosine", "of_file"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    of_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    own = materialize(rows.withColumn("of_file", of_file).mapInArrow(run, "id long, path string, own string, cosine double, of_file boolean"), "notices")
    own = own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    best = F.min_by("own", F.struct(-F.col("cosine"), F.col("own")))
    holders = own.where("own is not null and dir is not null and of_file").groupBy("dir").agg(best.alias("license")).withColumnRenamed("dir", "above")
    dirs = own.where("own is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    chain = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above"))
    near = chain.join(holders, "above").groupBy("dir").agg(F.max_by(F.struct("license", "above"), F.length("above")).alias("near"))
    joined = own.join(near, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    license = F.coalesce("own", "near.license")
    from_dir = F.when(F.col("own").isNull(), F.col("near.above"))
    return joined.select(F.col("id").alias(id_col), "path", license.alias("license"), F.round("cosine", 6).alias("cosine"), origin.alias("origin"), from_dir.alias("from_dir"), "of_file")
