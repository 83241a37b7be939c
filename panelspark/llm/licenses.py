"""License scan: cosine of lines' sparse TF-IDF vectors to license notices, then inheritance along directories.

Every line of a text that shares a term with the notices is a candidate header, however common the term is; its TF-IDF
vector is compared with each notice's, terms outside the notices weigh as terms seen once. The best notice at or above
NEAR is the line's license, the best line gives the file's own. A whole text is compared as one vector with the whole
texts of licenses as well; at or above NEAR_TEXT the best of these goes before the lines. A license file is such a text,
one named so, or one whose license lines are at least half of its words; it licenses its directory. Files without a
license of their own inherit from the nearest directory above them that has one, found by joining every ancestor path.

Results for odd input: null and empty texts have no license of their own; a null path has no directory and inherits
nothing; of several license files in a directory the one with the highest cosine counts, then the first by name; rows
that repeat a path get results each by itself; other columns are left aside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, small_batches

NEAR, NEAR_TEXT = 0.5, 0.8
# Usual notices by SPDX name.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Do not redistribute."],
}
TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
NAMED = re.compile(r"(^|/)(licen[cs]e|copying|copyright|notice)[^/]*$", re.IGNORECASE)


def terms(line: str) -> Counter:
    return Counter(TERM.findall(line.lower()))


#: Licenses whose whole text is in license_texts; the others' are not at hand.
WHOLE = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def vocabulary(templates: dict[str, list[str]]) -> list[str]:
    return sorted({t for texts in templates.values() for x in texts for t in terms(x)})


VOCABULARY = sorted({*vocabulary(TEMPLATES), *vocabulary(WHOLE)})


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and how many have each term of the templates (as many figures as VOCABULARY has)."""
    known = frozenset(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                seen.update(known.intersection(TERM.findall((text or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return files.count(), {r["term"]: r["n"] for r in rows}


class Scorer:
    """Cosines of texts or lines to templates."""

    def __init__(self, total: int, df: dict[str, int], templates: dict[str, list[str]], near: float):
        self.near = near
        self.idf = {t: 1 + math.log((1 + total) / (1 + df.get(t, 0))) for t in vocabulary(templates)}
        self.rare = 1 + math.log((1 + total) / 2)
        self.names, self.vectors = [], []
        for name, texts in templates.items():
            for x in texts:
                self.names.append(name)
                self.vectors.append(self.unit(terms(x)))

    def unit(self, counts: Counter) -> dict[str, float]:
        weight = {t: n * self.idf.get(t, self.rare) for t, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weight.values()))
        return {t: w / length for t, w in weight.items()}

    def best(self, counts: Counter) -> tuple[float, str] | None:
        shared = self.idf.keys() & counts.keys()
        if not shared:
            return None
        # no cosine is above the share of the length that the shared terms make up
        inside = sum((counts[t] * self.idf[t]) ** 2 for t in shared)
        outside = self.rare**2 * (sum(n * n for n in counts.values()) - sum(counts[t] ** 2 for t in shared))
        if inside < (self.near**2 - 1e-9) * (inside + outside):
            return None
        own = self.unit(counts)
        score, name = max((sum(w * own.get(t, 0.0) for t, w in v.items()), n) for n, v in zip(self.names, self.vectors, strict=True))
        return (round(score, 9), name) if score >= self.near else None


def own_licenses(files: DataFrame) -> DataFrame:
    """path, own (license or null), score, and whether it is a license file, of files (path, text)."""
    total, df = frequencies(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        headers, bodies = Scorer(total, df, TEMPLATES, NEAR), Scorer(total, df, WHOLE, NEAR_TEXT)
        for batch in batches:
            names, scores, whole = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, covered, all_terms = None, 0, Counter()
                for line in (text or "").split("\n"):
                    counts = terms(line)
                    all_terms.update(counts)
                    if hit := headers.best(counts):
                        covered += len(line.split())
                        found = max(found or hit, hit)
                body = bodies.best(all_terms)
                found = body or found
                names.append(found[1] if found else None)
                scores.append(found[0] if found else 0.0)
                whole.append(bool(body) or bool(found) and (bool(NAMED.search(path or "")) or 2 * covered >= len(text.split())))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(whole)], ["path", "own", "score", "license_file"])

    return files.select("path", "text").mapInArrow(run, "path string, own string, score double, license_file boolean")


def scanned(files: DataFrame) -> DataFrame:
    """path, own, score, license_file, license (own or inherited) and from_directory of every row of files (path, text)."""
    files = small_batches(files).select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = cut(own_licenses(files)).withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    licensed = rows.where("license_file and path is not null").groupBy("directory").agg(F.min_by("own", F.struct((-F.col("score")).alias("s"), "path")).alias("given")).withColumnRenamed("directory", "above")
    # ancestors only of directories that need one, each once
    lacking = rows.where("own is null and path is not null").select("directory").distinct()
    split = F.split("directory", "/")
    ancestors = lacking.select("directory", F.explode(F.sequence(F.lit(0), F.size(split))).alias("depth")).select("directory", "depth", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = ancestors.join(licensed, "above").groupBy("directory").agg(F.max_by(F.struct("above", "given"), "depth").alias("n"))
    out = rows.join(nearest, "directory", "left")
    inherits = F.col("own").isNull() & F.col("path").isNotNull()
    return out.select("path", "own", "score", "license_file", F.coalesce("own", F.when(inherits, F.col("n.given"))).alias("license"), F.when(inherits, F.col("n.above")).alias("from_directory"))
