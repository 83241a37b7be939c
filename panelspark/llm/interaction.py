"""How five document filters interact: what each removes, by the place it has in the order in which they are applied.

A document's outcome under any order is settled by its mask, the set of filters that it fails. So documents are counted
once, as one histogram over the 32 masks for each part and kind of label (all, good, toxic), and these histograms, as the
rows of a matrix, are multiplied by integer matrices of 32 masks by 600 outcomes (120 orders of 5 steps each): kept after the
step, removed at it, failing its filter though removed earlier, failing its filter alone. Whatever the number of documents,
the product has three rows for each part.

A filter fails a text A: of fewer than WORDS words; B: whose distinct words are less than half of its words; C: of whose
characters more than two in a hundred are among A-Z; D: that holds a symbol of SYMBOLS; E: that equals the text of a
smaller doc_id anywhere in the table. Texts are told apart by 128-bit hashes; the smallest doc_id of a text is aggregated
first and then met by text and doc_id together, so that a group of copies of any size is spread.

Results for odd input: a null text counts as empty, a null source as the empty string; a null doc_id is neither smaller nor
larger than others, so that it never fails E, and has no label; rows that repeat a doc_id count each, and don't make each
other fail E; a doc_id that repeats in labels is good or toxic if one of its rows says so; a text of any length is taken
whole; an empty table gives no rows; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, small_batches

FILTERS = "ABCDE"
WORDS = 200
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def mask_of_text(text: Column, ws: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    chars = F.length(text)
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    fails = [F.size(ws) < WORDS, 100 * F.size(F.array_distinct(ws)) < 50 * F.size(ws), 100 * capitals > 2 * chars, text != F.translate(text, SYMBOLS, "")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic (0 or 1) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    rows = cut(rows.select("doc_id", "part", mask_of_text(F.col("text"), F.col("words")).alias("mask"), F.xxhash64("text").alias("one"), F.xxhash64(F.lit(12), "text").alias("two")))
    first = rows.where("doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *((F.col(c) == 1).cast("int").alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    known = known.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # all three meet by doc_id alone, so that rows are dealt once; hashes are compared within
    alike = (F.col("r.doc_id") == F.col("f.doc_id")) & (F.col("r.one").bitwiseXOR(F.col("f.one")) == 0) & (F.col("r.two").bitwiseXOR(F.col("f.two")) == 0)
    met = rows.alias("r").join(first.alias("f"), alike, "left").join(known.alias("k"), F.col("r.doc_id") == F.col("k.doc_id"), "left")
    copy = F.col("r.doc_id").isNotNull() & F.col("f.doc_id").isNull()
    return met.select("part", (F.col("mask") + copy.cast("int") * 16).alias("mask"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def outcomes() -> dict[str, np.ndarray]:
    """Matrices of masks by outcomes: each order's five steps, order by order."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    before = np.array([sum(bit[f] for f in order[:k]) for order in ORDERS for k in range(len(FILTERS))])
    own = np.array([bit[f] for order in ORDERS for f in order])
    mask = np.arange(MASKS)[:, None]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    return {name: m.astype(np.int64) for name, m in found.items()}


def product(every: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS as matrices of parts by outcomes, of three matrices of parts by masks."""
    of, parts, steps = outcomes(), len(every), len(FILTERS)
    removed = np.vstack([every, good, toxic]) @ of["removed"]
    out = {k: every @ of[k] for k in ("kept", "redundant", "unique_fails")}
    out |= {k: removed[i * parts : (i + 1) * parts] for i, k in enumerate(("removed", "good_lost", "toxic_lost"))}
    letter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    same_filter = (letter[:, None] == np.arange(steps)).astype(np.int64)
    return out | {"shapley": (out["removed"] @ same_filter)[:, letter]}


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step (1 to 5) and COUNTS for every part, order and step."""
    counted = masks(small_batches(docs), labels).groupBy("part", "mask").agg(F.count("*").alias("every"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "every", "good", "toxic")).alias("cells"))  # 32 at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(ORDERS) * len(FILTERS)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                cells, n = batch.column("cells"), batch.num_rows
                row, flat = cells.value_parent_indices().to_numpy(), cells.flatten()
                values = dict(zip(("mask", "every", "good", "toxic"), (x.to_numpy() for x in flat.flatten()), strict=True))
                tables = []
                for name in ("every", "good", "toxic"):
                    tables.append(np.zeros((n, MASKS), np.int64))
                    tables[-1][row, values["mask"]] = values[name]
                found = product(*tables)
                columns = [batch.column("part").take(pa.array(np.repeat(np.arange(n), width))), pa.array(np.tile(np.repeat(ORDERS, len(FILTERS)), n)), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), n * len(ORDERS)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c].ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
