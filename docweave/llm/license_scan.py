"""Licences of files: TF-IDF cosine of notices to templates, and inheritance along directories.

A passage is a line with a licensing word, the whole of a licence file, or any run of neighbouring lines, as
notices are wrapped; runs go up to ``WIDEST`` times the words of the template that they are compared with. Passages become
sparse vectors: words count by frequency times ``ln((1 + files) / (1 + files with the word)) + 1``. Only
the words of the templates need file counts; these are taken over all files. Words outside the templates weigh as
if no file had them. A file has the licence of its most similar passage, if similar enough; a
file without one inherits from the licence files of the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.tables import written

THRESHOLD = 0.6
WORD = "[0-9a-z]+"
#: Wider runs of lines have too many other words to be like a template.
WIDEST = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CUE = r"licen[sc]e|copyright|all rights reserved|permission is hereby granted|without warrant"
LICENSE_FILE = r"(?:\A|/)(?:licen[sc]e|copying)[^/]*\z"

# Customary wording of licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Proprietary", "All rights reserved."),
]


def _words(text: str) -> Counter:
    return Counter(re.findall(WORD, text.lower()))


def _terms(text):
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def passages(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """``(key, path, at, passage)``: lines with a licensing word, then the whole of a licence file."""
    lower = lambda c: F.translate(c, UPPER, LOWER)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: lower(x).rlike(CUE))
    whole = F.when(lower(F.col(path)).rlike(LICENSE_FILE) & F.col(text).isNotNull(), F.array(F.col(text))).otherwise(
        F.array().cast("array<string>"))
    # one pass over the texts; the last passage of a licence file is all of it
    return files.select(key, path, F.posexplode(F.concat(lines, whole)).alias("at", "passage"))


def _run_scores(lines: list[list[str]], template: dict[str, float], size: int, rarity: dict[str, float], other: float, threshold: float) -> float:
    """The best cosine of a run of ``lines`` and a template of ``size`` words, 0 if all are below the threshold."""
    least, best = threshold * threshold - 1e-5, 0.0
    # a run's cosine is at most the root of the template's weight in it, which is at most the sum over its lines
    inside = [sum(template[w] ** 2 for w in set(line) if w in template) for line in lines]
    for i, line in enumerate(lines):
        if not inside[i]:
            continue  # without this line the run is no less like the template
        weight, n = 0.0, 0
        for j in range(i, len(lines)):
            weight, n = weight + inside[j], n + len(lines[j])
            if j > i and n > WIDEST * size:
                break
            if inside[j] and weight >= least:
                counts = Counter(w for k in range(i, j + 1) for w in lines[k])
                dot = sum(c * rarity[w] * template[w] for w, c in counts.items() if w in template)
                norm = math.sqrt(sum((c * rarity.get(w, other)) ** 2 for w, c in counts.items()))
                best = max(best, round(dot / norm, 6))
    return best if best >= threshold else 0.0


def _runs(files: DataFrame, key: str, path: str, text: str, vectors: list[tuple[str, Counter]], rarity: dict[str, float],
          other: float, threshold: float) -> DataFrame:
    """``(key, path, license, score)`` of the templates that runs of neighbouring lines are like."""
    templates = []
    for name, v in vectors:
        length = math.sqrt(sum((n * rarity[w]) ** 2 for w, n in v.items()))
        if length:
            templates.append((name, {w: n * rarity[w] / length for w, n in v.items()}, sum(v.values())))
    vocabulary = set(rarity)
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, scores = [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py()
                if raw is None:
                    continue
                # lowers A to Z only
                raw = raw.encode().lower().decode()
                known = vocabulary.intersection(word.findall(raw))
                likely = [t for t in templates if sum(x * x for w, x in t[1].items() if w in known) >= threshold * threshold - 1e-5]
                if not likely:
                    continue
                lines = [found for line in raw.split("\n") if (found := word.findall(line))]
                for name, template, size in likely:
                    score = _run_scores(lines, template, size, rarity, other, threshold)
                    if score:
                        rows.append(i)
                        names.append(name)
                        scores.append(score)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["key", "path", "license", "score"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, path, text).mapInArrow(run, f"key {kind}, path string, license string, score double").toDF(
        key, path, "license", "score")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id", path: str = "path",
         text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, path, license, score, origin, from_dir)`` for every row of ``files``.

    ``origin`` is ``own`` or ``inherited``; without any licence the last four are null. Ties go to the
    first licence by name, and the deepest directory wins. A null path is a file at the top, null and
    empty texts have no licence of their own. Rows with one key share the key's best passage. An empty
    table gives no rows; an empty list of templates no licences. Extra columns are not returned.
    """
    spark = files.sparkSession
    rows = files.select(F.col(key), F.coalesce(F.col(path), F.lit("")).alias(path), F.col(text))
    vectors = [(name, _words(t)) for name, t in templates]
    vocabulary = sorted(set().union(*(v for _, v in vectors))) if vectors else []
    known = F.array(*(F.lit(w) for w in vocabulary)) if vocabulary else F.array().cast("array<string>")
    counted = rows.select(F.explode(F.array_intersect(_terms(text), known)).alias("term")).groupBy("term").count()
    frequency = {r[0]: r[1] for r in counted.collect()}  # at most one row per template word
    total = rows.count()
    rarity = lambda w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1
    table = []
    for number, (name, v) in enumerate(vectors):
        size = math.sqrt(sum((n * rarity(w)) ** 2 for w, n in v.items()))
        table += [(w, number, name, n * rarity(w) / size) for w, n in v.items()]
    # bounded by the list of templates
    weights = spark.createDataFrame(table, "term string, template int, license string, weight double")
    rarities = spark.createDataFrame([(w, rarity(w)) for w in vocabulary], "term string, rarity double")

    found = passages(rows, key, path, text)
    # few rows, read three times
    terms = written(found.select(key, path, "at", F.explode(_terms("passage")).alias("term")).groupBy(key, path, "at", "term").agg(F.count("*").alias("n")))
    weighed = terms.join(F.broadcast(rarities), "term", "left").withColumn(
        "w", F.col("n") * F.coalesce("rarity", F.lit(math.log(1 + total) + 1)))
    norms = weighed.groupBy(key, path, "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(weights), "term").groupBy(key, path, "at", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norms, [key, path, "at"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    runs = _runs(rows, key, path, text, vectors, {w: rarity(w) for w in vocabulary}, math.log(1 + total) + 1, threshold)
    alike = scores.filter(F.col("score") >= threshold).select(key, path, "license", "score").unionByName(runs)
    best = written(alike.groupBy(key, path).agg(
        F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license")))

    parent = lambda c: F.regexp_extract(c, r"\A(.*)/[^/]*\z", 1)
    by_dir = best.filter(F.translate(path, UPPER, LOWER).rlike(LICENSE_FILE)).withColumn("from_dir", parent(path)).groupBy("from_dir").agg(
        F.max("score").alias("dir_score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("dir_license"))
    placed = written(rows.select(key, path, parent(path).alias("_dir")))
    part = F.split("_dir", "/")
    above = placed.select("_dir").distinct().select("_dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(part)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(part, F.lit(1), i), "/").alias("dir")))).alias("e")
    ).select("_dir", F.col("e.depth").alias("depth"), F.col("e.dir").alias("from_dir")).distinct()
    inherited = above.join(by_dir, "from_dir").groupBy("_dir").agg(
        F.max_by(F.struct("from_dir", "dir_license", "dir_score"), "depth").alias("up")).select("_dir", "up.*")
    joined = placed.join(best, [key, path], "left").join(inherited, "_dir", "left")
    own = F.col("license").isNotNull()
    return joined.select(
        key, path, F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", "dir_score").alias("score"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("from_dir")).alias("from_dir"))
