"""Line dedup by winnowing over line hashes.

Lines are what newlines separate. A run of lines counts as a repeat if it holds WORDS words or more and the same lines
start earlier, by doc_id and line. From each line on, the shortest run of WORDS words is a window; every repeat is made
of windows that repeat. In each window the smallest line hash (the leftmost of equal ones) is a fingerprint, so any two
equal windows are sure to share one at the same place; a long line is a window by itself, of short lines only some are
fingerprints. Positions of a fingerprint that occurs more than once are joined, and the match is extended both ways to all windows
around it; of equal windows the earliest stays, and every line of a later one is deleted. Shorter repeats, and runs of
blank lines alone, are left. Slices of texts delete what repeats within them before anything is shuffled, so that a
common line comes once a slice to its fingerprint. Windows are equal if two 64-bit hashes agree.

Results for odd input: null texts stay null and have no lines, empty texts one; a null doc_id comes first in order; rows
that repeat a doc_id are one document (a window is compared by its doc_id and line alone); a text of any length is taken
whole; the other columns asked for are returned unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import carried, cut, mix, same, slices, texts
from panelspark.llm.minhash import BLANK, byte_values, powers
from panelspark.llm.suffixes import BASES, SEEDS, earliest, ranks_of_ids

WORDS = 8
SLICE = 1 << 18


def line_hashes(rows: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(row, two hashes, number of words) of every line."""
    raw = [r.encode("utf-8", "surrogatepass") + b"\n" for r in rows]
    code = np.frombuffer(b"".join(raw), np.uint8)
    end = np.flatnonzero(code == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    values = []
    for seed, base in zip(SEEDS, BASES, strict=True):
        up, down = powers(1 << max(20, int(len(code)).bit_length()), base)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values(seed)[code] * up[: len(code)], dtype=np.uint64)])
        values.append(mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
    blank = BLANK[code]
    begins = np.concatenate([[0], np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))])
    row = np.searchsorted(np.cumsum([len(r) for r in raw]), start, side="right")
    return row, values, begins[end] - begins[start]


def leftmost_least(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of the smallest value, the leftmost of equal ones, from each start to each end (included)."""
    rank = np.empty(len(value), np.int64)
    order = np.argsort(value, kind="stable")
    rank[order] = np.arange(len(value))
    width = end - start + 1
    level = np.frexp(width)[1] - 1  # the largest power of two within the width
    out, least = np.empty(len(start), np.int64), rank
    for j in range(int(level.max(initial=-1)) + 1):
        mine = np.flatnonzero(level == j)
        out[mine] = np.minimum(least[start[mine]], least[end[mine] + 1 - (1 << j)])
        least = np.minimum(least[: len(least) - (1 << j)], least[1 << j :])
    return order[out]


def marks(docs: DataFrame, words: int) -> DataFrame:
    """Fingerprints (print, doc_id, windows: their hashes, lines and numbers of lines), and with print null windows to be deleted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                row, values, n_words = line_hashes(texts(part, "text"))
                so_far = np.concatenate([[0], np.cumsum(n_words)])
                end = np.searchsorted(so_far, so_far[:-1] + words) - 1
                start = np.flatnonzero((end < len(row)) & (row == row[np.minimum(end, len(row) - 1)]))
                if not len(start):
                    continue
                end = end[start]
                hashes = []
                for value, base in zip(values, BASES, strict=True):
                    up, down = powers(1 << max(20, int(len(row)).bit_length()), base)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(row)], dtype=np.uint64)])
                    hashes.append(mix((sums[end + 1] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
                line = start - np.searchsorted(row, row[start])
                first = earliest(hashes, ranks_of_ids(part)[row[start]], line)
                at = leftmost_least(values[0], start, end)
                # windows of one fingerprint lie together; those deleted here go by themselves
                order = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
                kept = int(first.sum())
                fresh = np.concatenate([[True], at[order][1:kept] != at[order][: kept - 1]]) if kept else np.empty(0, bool)
                head = np.concatenate([np.flatnonzero(fresh), np.arange(kept, len(order))])
                windows = pa.StructArray.from_arrays([*(pa.array(h[order].view(np.int64)) for h in hashes), pa.array(line[order]), pa.array((end - start + 1)[order])], ["one", "two", "line", "lines"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), windows)
                prints = pa.array(values[0][at[order[head]]].view(np.int64), mask=head >= kept)
                yield pa.RecordBatch.from_arrays([prints, part.column("doc_id").take(pa.array(row[start[order[head]]])), lists], ["print", "doc_id", "windows"])

    return docs.select("doc_id", "text").mapInArrow(work, "print long, doc_id long, windows array<struct<one: long, two: long, line: long, lines: long>>")


def later_windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, line (from 0) and lines of the windows that also start earlier."""
    found = cut(marks(docs, words))
    spread = lambda rows: rows.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.*")
    prints = found.where("print is not null")
    often = prints.groupBy("print").agg(F.count("*").alias("times")).where("times > 1").select("print")
    matched = cut(spread(prints.join(often, "print")))
    place = F.struct("doc_id", "line")
    first = matched.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("one", "two", "first")
    later = matched.join(first, ["one", "two"]).where(~same(place, F.col("first")))
    return spread(found.where("print is null")).unionByName(later.drop("first")).select("doc_id", "line", "lines")


def deduplicated(docs: DataFrame, keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """doc_id, text without the lines of later repeats, n_lines, n_removed, and the columns `keep` as struct rest."""
    docs = carried(docs, keep or [])
    gone = later_windows(docs, words).groupBy("doc_id").agg(F.collect_set(F.struct("line", "lines")).alias("windows")).withColumnRenamed("doc_id", "other")
    kind = dict(docs.dtypes)["rest"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out, lines, removed = [], [], []
                for text, windows in zip(part.column("text").to_pylist(), part.column("windows"), strict=True):
                    split = [] if text is None else text.split("\n")
                    drop: set[int] = set()
                    if windows.is_valid:
                        start, n = (windows.values.field(i).to_pylist() for i in (0, 1))
                        drop = {i for s, k in zip(start, n, strict=True) for i in range(s, s + k) if i < len(split)}
                    out.append(text if not drop else "\n".join(x for i, x in enumerate(split) if i not in drop))
                    lines.append(len(split))
                    removed.append(len(drop))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), part.column("rest")], ["doc_id", "text", "n_lines", "n_removed", "rest"])

    joined = docs.join(gone, same(F.col("doc_id"), F.col("other")), "left").drop("other")
    return joined.mapInArrow(work, f"doc_id long, text string, n_lines long, n_removed long, rest {kind}")
