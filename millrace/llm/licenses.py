"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directories.

Every line of a whole text is a candidate header, and so is every run of up to LINES lines, over which a
header may be wrapped; in a licence file the whole text is one more. Candidates that share a term with a
template are scored, through an index from terms to templates, unless the length of the shared part
bounds the cosine below the best so far; a cosine is summed over the shared terms alone. How rare a term
is counts over all files. A file without a licence of its own takes that of the licence file in its
nearest ancestor directory, by a join of directory paths: each distinct directory once, not each file.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, join_one, stage, texts_of
from millrace.llm.decontaminate import words_of
from millrace.shipping import ship

# Headers that announce a licence, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Licensed under the ISC License."),
]
#: Base names of licence files.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-][^/]*)?$"
#: Least cosine of a match.
COSINE = 0.75
#: Lines over which a header may be wrapped.
LINES = 4


class Index:
    """Templates as unit vectors, by term. holding: how many of so many files hold each term."""

    def __init__(self, templates: Sequence[tuple[str, str]], files: int, holding: dict[bytes, int]) -> None:
        self.names = [name for name, _ in templates]
        counts = [Counter(words_of(text.encode())) for _, text in templates]
        self.rarity = {t: math.log((1 + files) / (1 + holding.get(t, 0))) + 1 for c in counts for t in c}
        self.other = math.log(1 + files) + 1  # terms of no template count as held by no file
        self.by_term: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.rarity[t]) ** 2 for t, n in c.items())) or 1.0
            for t, n in c.items():
                self.by_term[t].append((k, n * self.rarity[t] / norm))
        self.reach = {t: (r * max(y for _, y in self.by_term[t]), r * r) for t, r in self.rarity.items()}

    def best(self, words: list[bytes], least: float = 0.0) -> tuple[float, str]:
        """The greatest cosine and its licence; of equals the first template. Nothing if the cosine
        is surely below least: it is at most the share that the terms of templates have of the length."""
        counts = Counter(words)
        shared = {t: counts[t] * self.rarity[t] for t in counts.keys() & self.rarity.keys()}
        part = sum(x * x for x in shared.values())
        norm = math.sqrt(part + self.other**2 * sum(n * n for t, n in counts.items() if t not in shared)) or 1.0
        if math.sqrt(part) / norm < least - 1e-9:
            return 0.0, ""
        found: dict[int, float] = defaultdict(float)
        for t in sorted(shared):  # in a fixed order, so that sums are the same everywhere
            for k, y in self.by_term[t]:
                found[k] += shared[t] / norm * y
        return max(((c, self.names[k]) for k, c in sorted(found.items())), key=lambda m: round(m[0], 9), default=(0.0, ""))

    def scan(self, text: bytes, whole: bool) -> tuple[float, str]:
        """The best of all runs of lines, of equals the shortest and first, and of the whole text if it is
        a licence file. A run that begins or ends with a line without a term is worse than without it.

        No cosine is above the sum of the most that each word adds with any template, over the root of the
        sum of the words' squares; both sums are had for all runs at once. Runs are scored from the
        greatest of these bounds down, until no other can reach the best."""
        reach, lines = self.reach, [words_of(line) for line in text.split(b"\n")]
        shared = [[reach[w] for w in line if w in reach] for line in lines]
        n = len(lines)
        if not any(shared):
            return 0.0, ""
        most = np.concatenate([[0.0], np.cumsum([sum([r for r, _ in x]) for x in shared])])
        square = np.concatenate([[0.0], np.cumsum([sum([q for _, q in x]) + self.other**2 * (len(line) - len(x)) for line, x in zip(lines, shared, strict=True)])])
        some = np.fromiter(map(bool, shared), bool, n)
        runs = []
        for size in range(1, min(LINES, n) + 1):
            at = np.nonzero(some[: n - size + 1] & some[size - 1 :])[0]
            runs.append(((most[at + size] - most[at]) / np.sqrt(square[at + size] - square[at]), np.full(len(at), size), at))
        bound, size, first = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(-bound, kind="stable")
        found, best = (0.0, ""), (0.0, 0, 0)
        for b, s, k in zip(bound[order].tolist(), size[order].tolist(), first[order].tolist(), strict=True):
            if b < found[0] - 1e-6:
                break
            one = self.best(lines[k] if s == 1 else [w for line in lines[k : k + s] for w in line], found[0])
            if (rank := (round(one[0], 9), -s, -k)) > best:
                found, best = one, rank
        if whole:
            one = self.best([w for line in lines for w in line], found[0])
            found = one if round(one[0], 9) > best[0] else found
        return found


def _holding(texts: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many files there are, and how many hold each term of the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held[b""] += batch.num_rows
            for text in texts_of(batch):
                held.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    rows = texts.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # of the templates' terms
    holding = {bytes(r["term"]): r["n"] for r in rows}
    return holding.pop(b"", 0), holding


def scan(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, path_col: str = "path", text_col: str = "text", cosine: float = COSINE, keep: tuple[str, ...] = (), licence_file: Column | None = None) -> DataFrame:
    """path, the columns of keep, licence, cosine, origin, inherited_from for every row of files.

    origin: `header` or `file` for a licence of its own, `inherited` for that of the licence file in
    directory inherited_from, `none`. A file's own directory counts as its nearest ancestor, the root
    is ''. Of several licence files in a directory the greatest cosine counts, then the least path.
    A null text is empty; a null path has no directory and inherits nothing; repeated rows are files of
    their own. licence_file: which rows are licence files, if not by base name. keep cannot name a
    column that the result has of its own."""
    if clash := {c.lower() for c in keep} & {"path", "licence", "cosine", "origin", "inherited_from"}:
        raise ValueError(f"the result has columns {sorted(clash)} of its own")
    ship(files.sparkSession)
    path = column(path_col).cast("string")
    named = licence_file if licence_file is not None else F.coalesce(F.regexp_extract(path, "([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(path.alias("path"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"), named.alias("is_file"), *[column(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    n, holding = _holding(rows.select("text"), {t for _, text in templates for t in words_of(text.encode())})
    kept = [f"keep_{i}" for i in range(len(keep))]
    schema = rows.select("path", "is_file", *kept).schema.add("licence", "string").add("cosine", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, n, holding)
        for batch in batches:
            found = [index.scan(t, w) for t, w in zip(texts_of(batch), batch.column("is_file").to_pylist(), strict=True)]
            hit = [f if f[0] >= cosine else (f[0], None) for f in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("path", "is_file", *kept)], pa.array([h[1] for h in hit], pa.string()), pa.array(np.array([h[0] for h in hit], float))], schema.names)

    scanned = stage(rows.mapInArrow(run, schema).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licences")
    best = F.max_by(F.struct("licence", "path"), F.struct("cosine", F.transform(F.split("path", ""), lambda c: -F.ascii(c))))
    granted = scanned.filter(F.col("is_file") & F.col("licence").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("ancestor"), F.col("best.licence").alias("granted"))
    dirs = scanned.filter(F.col("dir").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("ancestor"))
    nearest = above.join(granted, "ancestor").groupBy("dir").agg(F.max_by(F.struct("granted", "ancestor"), F.length("ancestor")).alias("from"))
    own = F.col("licence").isNotNull()
    return join_one(scanned, nearest, "dir", "left").select(
        "path",
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce("licence", "from.granted").alias("licence"),
        "cosine",
        F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("from.ancestor")).alias("inherited_from"),
    )
