"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle of a set is thrown into one of SIZE bins by hash, a bin keeps its smallest (round, hash).
Once all bins are filled the rounds end; sets with few shingles fill the rest in SIZE more rounds, of which the i-th
throws all of them into bin i, so every bin is filled for certain. Two sets agree in a bin with the probability of their
Jaccard similarity, with the concentration of independent draws.

Banding: BANDS of ROWS bins each; sets at the limit of 0.8 miss each other with probability (1 - 0.8^6)^42, 3 in a million.
Equal sets are one set from here on. Verification is exact, on all 64-bit shingles, and comes in two steps:

1. Every set is compared with its hub, the smallest set that shares a band with it. That joins nearly all of a group of
   near copies, however large, with work in proportion to its sets.
2. What is left are buckets (sets that share a band) whose sets are in more than one component. Of such a bucket every
   set outside its hub's component is compared with every other set of the bucket whose size allows a link (within a
   factor of 1.25, by classes of size). So each pair that shares a band is compared or already connected.

Groups of both steps are dealt out in blocks of bounded size; a group returns a spanning forest of its links, so that no
list of pairs arises.

Results for odd input: null and empty texts have no shingles and are linked with nothing; a null doc_id is never linked
and has itself, null, as component; rows that share a doc_id are one document; a text of any length is one set; a pair
at exactly the limit is linked; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, mix, same, slices, texts, whole_docs
from panelspark.llm.components import components

BANDS, ROWS = 42, 6
SIZE = BANDS * ROWS
#: Sets, and about how many shingles, of a block; a group is made of two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 256, 200_000
#: Texts of a slice, in bytes: a slice's arrays take some hundred times as much.
SLICE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# The white space that separates words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=4)
def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1))


def word_hashes(rows: list[str], ignore_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word."""
    raw = [r.encode("utf-8", "surrogatepass") for r in rows]
    joined = b"\n".join(raw) + b"\n"
    code = np.frombuffer(joined.lower() if ignore_case else joined, np.uint8)
    blank = BLANK[code]
    change = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = change[0::2], change[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers(1 << max(20, int(len(code)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values(0xA5A5_1234_5678_9BDF)[code] * up[: len(code)], dtype=np.uint64)])
    return np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right"), mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(rows: list[str], words: int, ignore_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as 64-bit numbers: (row, shingle), sorted by both. Shorter texts are one shingle."""
    doc, word = word_hashes(rows, ignore_case)
    if not len(word):
        return doc, word
    counts = np.bincount(doc, minlength=len(rows))
    first = np.cumsum(counts) - counts
    left = np.minimum(counts[doc], words)  # words in this text's shingles
    begins = np.arange(len(word)) - first[doc] <= counts[doc] - left
    at, left = np.flatnonzero(begins), left[begins]
    total = left.astype(np.uint64)
    for j in range(words):
        total = mix(total * np.uint64(BASE) + np.where(left > j, word[np.minimum(at + j, len(word) - 1)], np.uint64(0)))
    row = doc[at]
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (total[1:] != total[:-1])])
    return row[new], total[new]


def sketch(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """One row of SIZE filled bins for each set; sets without values keep EMPTY."""
    bins = np.full((rows, SIZE), EMPTY)
    flat = bins.reshape(-1)
    for i in range(2 * SIZE):
        if not len(row):
            break
        drawn = mix(values + np.array([i + 1], np.uint64) * np.uint64(BASE))
        place = (drawn >> np.uint64(32)) % np.uint64(SIZE) if i < SIZE else np.uint64(i - SIZE)
        np.minimum.at(flat, row * SIZE + place.astype(np.int64), (np.uint64(i) << np.uint64(54)) | (mix(drawn) >> np.uint64(10)))
        if i >= SIZE - 1 and i < 2 * SIZE - 1:
            continue
        open_rows = np.zeros(rows, bool)
        some = np.unique(row)
        open_rows[some] = (bins[some] == EMPTY).any(axis=1)
        going = open_rows[row]
        if not going.all():
            row, values = row[going], values[going]
    return bins


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that name the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                n = part.num_rows
                row, values = shingles(texts(part, "text"), words)
                counts = np.bincount(row, minlength=n)
                bins = sketch(row, values, n)
                key = np.zeros((n, BANDS), np.uint64)
                for j in range(ROWS):
                    key = mix(key * np.uint64(BASE) + bins[:, j::ROWS])
                key = mix(key + np.arange(BANDS, dtype=np.uint64) * np.uint64(BASE))
                names = []
                for seed in (0x1B873593, 0xCC9E2D51):
                    name = np.zeros(n, np.uint64)
                    np.add.at(name, row, mix(values * np.uint64(seed)))
                    names.append(pa.array(mix(name).view(np.int64)))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * BANDS)
                bands = pa.ListArray.from_arrays(ends, pa.array(key.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), *names, bands], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """docs (with text and other columns) with the array of shingles in place of the text."""
    keep = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                row, values = shingles(texts(part, "text"), words)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], [*keep, "shingles"])

    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", shingles array<long>")


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(smallest id, id) of each group of sets linked by 100 * intersection >= percent * union."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(n), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    column, which = (np.cumsum(shared) - 1)[column[shared[column]]], which[shared[column]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, which = column[order], which[order]
    step = max(256, (4 << 20) // n)  # a block of 16 MB at a time
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        block = np.zeros((n, step), np.float32)
        block[which[a:b], column[a:b] - at] = 1
        common += block @ block.T
    inter = common.astype(np.int64)
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    seen, out = np.zeros(n, bool), []
    for i in range(n):
        if seen[i]:
            continue
        member, front = np.zeros(n, bool), np.array([i])
        member[i] = True
        while len(front):
            new = linked[front].any(axis=0) & ~member
            member |= new
            front = np.flatnonzero(new)
        seen |= member
        found = ids[member]
        out += [(int(found.min()), int(x)) for x in found if x != found.min()]
    return out


def compare(grouped: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each group of grouped (group, i, j, doc_id, shingles); a group is held by one task and has two blocks at most."""
    key = ["group", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            links = forest(np.array(ids), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
            for k, doc, row in zip(keys, batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                if k != now:
                    if len(ids) > 1:
                        yield done()
                    now, ids, sets = k, [], []
                ids.append(doc)
                sets.append(row.values.to_numpy().copy())
        if len(ids) > 1:
            yield done()

    return grouped.select(*key, "doc_id", "shingles").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def blocks(sets: str, shingles: str) -> Column:
    """How many blocks so many sets of so many shingles make."""
    return F.greatest(F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1))


def dealt(rep: str, n: str) -> Column:
    return F.pmod(F.xxhash64(rep, F.lit(11)), F.col(n))


def nearest(members: DataFrame) -> DataFrame:
    """rep, best (the smallest of its hubs) and n_shingles of each set; members: band, hub, rep, n_shingles."""
    return members.groupBy("rep").agg(F.min("hub").alias("best"), F.max("n_shingles").alias("n"))


def stars(best: DataFrame) -> DataFrame:
    """Groups (group, i, j, rep) of each hub, one block of its partners a group."""
    pairs = best.withColumnRenamed("best", "hub").where("rep <> hub")
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("sets"), F.sum("n").alias("all")).select("hub", blocks("sets", "all").alias("blocks"))
    partners = pairs.join(sizes, "hub").select(F.col("hub").alias("group"), dealt("rep", "blocks").alias("i"), "rep")
    hubs = sizes.select(F.col("hub").alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.col("hub").alias("rep"))
    return partners.unionByName(hubs).withColumn("j", F.lit(0).cast("long"))


def rests(members: DataFrame, best: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Groups (group, i, j, rep) of buckets that hold several components: blocks of sets outside the hub's component against blocks of all.

    members: band, hub, rep, n_shingles; labels: rep and label of the sets that have a link.
    """
    named = members.join(best.select("rep", "best"), "rep").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    of_hub = F.max(F.when(F.col("rep") == F.col("hub"), F.col("label")))
    sign = F.sum(F.xxhash64("rep").cast("decimal(38,0)"))  # buckets of the same sets are one
    state = named.groupBy("band").agg(of_hub.alias("main"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.min("hub").alias("hub"), sign.alias("sign"), F.min((F.col("best") == F.col("hub")).cast("int")).alias("done"))
    # of two sets one is the hub, and the first step compared them if it is the other's best
    open_buckets = state.where("low <> high and (size > 2 or done = 0)").groupBy("sign", "size", "hub", "main").agg(F.min("band").alias("band"))
    # linked sets' sizes are within a factor of 100 / percent, so they are of one class of size or of two adjacent ones
    size_class = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent)) + 1e-9) if percent < 100 else F.col("n_shingles")
    some = named.select("band", "rep", "label", "n_shingles").join(open_buckets.select("band", "main"), "band")
    some = some.withColumn("size_class", size_class).withColumn("outside", F.col("label") != F.col("main"))
    # group: a bucket and a class of size; sets outside come with their own class, all sets with theirs and the adjacent ones
    outside = some.where("outside").select("band", F.col("size_class").alias("at"), "rep", "n_shingles")
    inside = some.select("band", F.explode(F.array(*(F.col("size_class") + d for d in (-1, 0, 1)))).alias("at"), "rep", "n_shingles")
    n_outside = outside.groupBy("band", "at").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("all")).select("band", "at", blocks("sets", "all").alias("rows"))
    n_inside = inside.groupBy("band", "at").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("all")).select("band", "at", blocks("sets", "all").alias("columns"))
    shape = n_outside.join(n_inside, ["band", "at"])
    group = F.xxhash64("band", "at").alias("group")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = outside.join(shape, ["band", "at"]).select(group, dealt("rep", "rows").alias("i"), to("columns").alias("j"), "rep")
    b = inside.join(shape, ["band", "at"]).select(group, to("rows").alias("i"), dealt("rep", "columns").alias("j"), "rep")
    return a.unionByName(b)  # a set may come twice to a group, which changes nothing


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept of every row of docs."""
    docs = whole_docs(docs)
    found = cut(features(docs, words))
    name = ["set_a", "set_b", "n_shingles"]
    sets = cut(found.where("n_shingles > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    thrown = sets.select("rep", "n_shingles", F.explode("bands").alias("band"))
    buckets = cut(thrown.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").select("band", "hub"))
    # a doc_id of several texts has several sets, of which the largest counts for sizes
    members = cut(thrown.join(buckets, "band").groupBy("band", "rep").agg(F.min("hub").alias("hub"), F.max("n_shingles").alias("n_shingles")))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    compared = cut(sets_of(docs.join(wanted, "doc_id"), words).where(F.size("shingles") > 0))

    def links(groups: DataFrame) -> DataFrame:
        return compare(compared.join(groups.withColumnRenamed("rep", "doc_id"), "doc_id"), percent)

    best = cut(nearest(members))
    first = cut(links(stars(best)))
    label = components(first).select(F.col("node").alias("rep"), "label")
    second = cut(links(rests(members, best, label, percent)))
    if not second.isEmpty():
        label = components(first.unionByName(second)).select(F.col("node").alias("rep"), "label")
    named = cut(sets.select(*name, "rep").join(label, "rep", "left").select(*name, F.coalesce("label", "rep").alias("label")))
    f = found.select("doc_id", *name).withColumn("known", F.col("doc_id").isNotNull())
    joined = f.join(named.withColumn("known", F.lit(True)), [*name, "known"], "left")
    # a doc_id of several rows has one component, that of the smallest
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), same(F.col("doc_id"), component).alias("kept"))
