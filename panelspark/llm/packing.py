"""Packing tokenised documents into windows by Karmarkar-Karp multiway differencing.

Where a document is encoded it is cut into full windows, which are done, and a remainder in pieces of at most a fourth of
a window. Remainders' pieces are dealt at random into cells of about CELL documents; within a cell partial partitions
with opposing imbalances are merged, the two largest differences first, until one partition into k windows is left.
k begins as the cell's tokens over the capacity, rounded up, and rises whenever the capacity is exceeded, by as much as
the excess over the mean asks for and by 1 at least, until every window fits.

A task holds one cell, whose size doesn't depend on how long documents are: a document has one remainder at most.

Results for odd input: null or empty texts are one piece, the end id alone; a text of any length is cut as it is encoded;
rows with a null or repeated doc_id are packed each by itself; ties in size are broken by doc_id and start; an empty
table gives no rows; other columns of the input are left aside.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bpe import codec, lists
from panelspark.llm.common import BATCH_BYTES, cut, slices, whole_docs

CAPACITY = 2048
END_ID = 1
#: Remainders in a cell, on average.
CELL = 4096
#: Pieces of a remainder hold at most this part of a window: the smaller, the more equal the windows.
PART = 4
PIECE = "doc_id long, start long, length long, doc_tokens long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k groups of the sizes' indices with sums as equal as differencing makes them.

    A partial partition is a sorted list of (sum, members), the smallest sum taken off all; missing groups are empty.
    """
    if k <= 1:
        return [list(range(len(sizes)))] if k else []
    heap = [(-s, i, [(s, i, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # the largest of one meet the smallest of the other; empty groups are the smallest
        free = k - len(a)
        rest = b[: max(0, len(b) - free)]  # these must join groups of a, its smallest; b's largest among them first
        small, a = a[: len(rest)], a[len(rest) :]
        for group in b[len(rest) :]:
            insort(a, group)
        if rest:
            for (s, i, x), (t, j, y) in zip(small, reversed(rest), strict=True):
                if len(x) < len(y):
                    x, y = y, x
                x += y
                insort(a, (s + t, min(i, j), x))
        if len(a) == k and (least := a[0][0]):
            a = [(s - least, i, x) for s, i, x in a]
        tie += 1
        heapq.heappush(heap, ((a[0][0] if len(a) == k else 0) - a[-1][0], tie, a))
    groups = [x for _, _, x in heap[0][2]] if heap else []
    return groups + [[] for _ in range(k - len(groups))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Groups of the sizes' indices, none of them over the capacity (which no size is)."""
    total = sum(sizes)
    k = -(-total // capacity)
    while True:
        groups = difference(sizes, k)
        excess = max((sum(sizes[i] for i in g) for g in groups), default=0) - capacity
        if excess <= 0:
            return groups
        over_mean = excess + capacity - total / k
        k = max(k + 1, -int(-total // (capacity - over_mean)) if over_mean < capacity / 2 else 0)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, sums: bool = False) -> DataFrame:
    """Full windows and remainders' pieces of each text with its end id: their places and ids.

    ids are bytes, little-endian numbers of 16 bits where the vocabulary allows, else of 32. sums: full windows have the
    checksum of their ids (as 32-bit numbers) instead.
    """
    step = max(1, capacity // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        kind = width(vocabulary, end_id)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                row, start, length, tokens, full, raw, crc = [], [], [], [], [], [], []
                found, ends = c.encode(part.column("text"))
                found, ends = np.insert(found, ends[1:], end_id), ends + np.arange(len(ends))
                for i, (first, last) in enumerate(zip(ends, ends[1:])):
                    ids = found[first:last]
                    whole = len(ids) // capacity * capacity
                    bounds = [*range(0, whole, capacity), *range(whole, len(ids), step), len(ids)]
                    n = len(bounds) - 1
                    row += [i] * n
                    start += bounds[:-1]
                    length += [b - a for a, b in zip(bounds, bounds[1:])]
                    tokens += [len(ids)] * n
                    small = ids.astype(kind)
                    for a, b in zip(bounds, bounds[1:]):
                        full.append(a < whole)
                        summed = sums and a < whole
                        crc.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()) if summed else None)
                        raw.append(None if summed else small[a:b].tobytes())
                arrays = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, tokens)), pa.array(full, pa.bool_()), pa.array(raw, pa.binary()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "doc_tokens", "full", "raw", "ids_crc32"])

    return whole_docs(docs).mapInArrow(run, f"{PIECE}, full boolean, raw binary, ids_crc32 long")


def width(vocabulary: str, end_id: int) -> str:
    return "<u2" if max(len(codec(vocabulary).offsets) - 2, end_id) < 1 << 16 else "<u4"


def pack(rests: DataFrame, cells: int, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, sums: bool = False) -> DataFrame:
    """Remainders' pieces with sequence_id (even numbers) and offset; cells: number of cells, each packed by one task."""
    last = "ids_crc32 long" if sums else "ids array<int>"

    def cell(t: pa.Table) -> pa.Table:
        # the same order however the rows arrive, so that a repeated task gives the same windows
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("deal", "ascending")])
        base, kind = t.column("cell")[0].as_py() << 32, width(vocabulary, end_id)
        sizes = t.column("length").to_pylist()
        order, window, offset = [], [], []
        for w, group in enumerate(windows(sizes, capacity)):
            at = 0
            for i in sorted(group):
                order.append(i)
                window.append((base + w) * 2)
                offset.append(at)
                at += sizes[i]
        t = t.take(pa.array(order, pa.int64()))
        rows = [np.frombuffer(r, kind) for r in t.column("raw").to_pylist()]
        out = pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()) if sums else lists(rows)
        return pa.table([*(t.column(c) for c in ("doc_id", "start", "length", "doc_tokens")), pa.array(window, pa.int64()), pa.array(offset, pa.int64()), out], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", last.split()[0]])

    dealt = rests.select("doc_id", "start", "length", "doc_tokens", "raw", F.xxhash64("doc_id", "start", F.monotonically_increasing_id()).alias("deal"))
    return dealt.withColumn("cell", F.pmod("deal", F.lit(cells))).groupBy("cell").applyInArrow(cell, f"{PIECE}, sequence_id long, offset long, {last}")


def spelt(full: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Full windows with their ids as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = width(vocabulary, end_id)
        for batch in batches:
            ids = lists([np.frombuffer(r, kind) for r in batch.column("raw").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    return full.select(*columns, "raw").mapInArrow(run, f"{PIECE}, sequence_id long, offset long, ids array<int>")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, sums: bool = False) -> DataFrame:
    """The pieces of all documents with their ids (or the checksums of these) and places."""
    found = cut(pieces(docs, vocabulary, capacity, end_id, sums))
    full = found.where("full").withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    full = full.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32") if sums else spelt(full, vocabulary, end_id)
    cells = max(1, docs.count() // CELL)
    return full.unionByName(pack(found.where("not full"), cells, vocabulary, capacity, end_id, sums))
