"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A byte goes if it is covered by a string of LENGTH bytes that also starts earlier (by doc_id and place). Sorting all
suffixes would shuffle every byte's suffix; as in difference-cover construction only the suffixes of a cover sample are
ranked, and all others are resolved by a sampled suffix near them. The cover is chosen by content (a synchronising set):
in each string of LENGTH bytes the place whose GRAM bytes have the least hash (the leftmost of equals). Like an
arithmetic difference cover it holds, for any two equal strings, two places at the same offset in both, but it takes one
suffix in 35 instead of one in seven (LENGTH allows no arithmetic cover below one in ten).

Buckets are the sampled suffixes that begin with the same GRAM bytes. Within a bucket the context of a sampled suffix
is all strings resolved by it: of equal contexts the earliest stays, and all strings of the later ones go. Where a bucket
holds different contexts, at the edges of repeats, their bytes are gathered and the bucket is sorted, one bucket at a
time: its sampled suffixes by the bytes that follow, and by the bytes before them read backwards. Both orders give each
sampled suffix ranks by any length, and two strings are equal just if their sampled suffixes lie at the same offset and
tie in both ranks; so no string is compared itself. Large buckets are sorted in salted parts of bounded size, whose
earliest strings are then compared over all parts by two 64-bit hashes.

Slices of texts resolve what repeats within them before anything is shuffled, and a table of bounded size what repeats
from slice to slice of a task, so that a common passage comes about once a task to its bucket. Contexts are equal if two 64-bit hashes over different byte values agree.

Results for odd input: null texts count as empty; texts shorter than LENGTH lose nothing; a null doc_id comes first in
order; rows that repeat a doc_id are one document (their equal places are one place, and each loses what is found for
the doc_id, as far as it reaches); the other columns asked for are returned unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import carried, cut, mix, same, slices
from panelspark.llm.minhash import byte_values, powers

LENGTH, GRAM = 100, 32
#: Contexts of a bucket's part that is sorted at once; only a bucket of more comes in several.
PART = 2048
#: Contexts that a task remembers from slice to slice (a power of two; 40 bytes each).
SEEN = 1 << 18
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
BASES = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1)


class Hashes:
    """Two hashes of any stretch of a slice's bytes."""

    def __init__(self, code: np.ndarray):
        self.down, self.sums = [], []
        for seed, base in zip(SEEDS, BASES, strict=True):
            up, down = powers(1 << max(20, int(len(code)).bit_length()), base)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values(seed)[code] * up[: len(code)], dtype=np.uint64)]))
            self.down.append(down)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[which][end] - self.sums[which][start]) * self.down[which][start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, m = 1, x
    while done * 2 <= width:
        m, done = np.minimum(m[:-done], m[done:]), done * 2
    return np.minimum(m[: len(m) - (width - done)], m[width - done :]) if width > done else m


def anchors(code: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(place, first string, last string, hash) of each sampled suffix: strings are named by their starts."""
    none = np.empty(0, np.int64)
    if len(code) < length:
        return none, none, none, np.empty(0, np.uint64)
    h = Hashes(code)
    at = np.arange(len(code) - gram + 1)
    value = h.of(0, at, at + gram)
    width = length - gram + 1
    least = sliding_min(value, width)  # by string
    begin = np.concatenate([[0], ends[:-1]])
    whole = np.zeros(len(least) + 1, np.int64)
    some = ends - begin >= length
    np.add.at(whole, begin[some], 1)
    np.add.at(whole, ends[some] - length + 1, -1)
    whole = np.cumsum(whole)[:-1] > 0

    def leftmost(start: np.ndarray) -> np.ndarray:
        out = [s + (value[s[:, None] + np.arange(width)] == least[s][:, None]).argmax(axis=1) for s in np.array_split(start, len(start) // 8192 + 1)]
        return np.concatenate(out) if out else none

    new = whole & np.concatenate([[True], ~whole[:-1] | (least[1:] != least[:-1])])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, np.empty(0, np.uint64)
    stop = np.flatnonzero(whole & np.concatenate([new[1:] | ~whole[1:], [True]]))
    place = leftmost(first)
    late = np.flatnonzero(stop > place)  # equal bytes again: the rest of the run string by string
    if len(late):
        n = stop[late] - place[late]
        s = np.repeat(place[late] + 1 - np.cumsum(n) + n, n) + np.arange(n.sum())
        p = leftmost(s)
        start = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
        more, final = s[start], s[np.concatenate([start[1:], [True]])]
        place, first, stop = np.concatenate([place, p[start]]), np.concatenate([first, more]), np.concatenate([np.where(stop > place, place, stop), final])
    return place, first, stop, value[place]


def earliest(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its keys by doc and place; rows that tie in both are all first."""
    order = np.lexsort((place, doc, *keys))
    head = np.ones(len(order), bool)
    if len(order):
        differ = np.zeros(len(order) - 1, bool)
        for k in keys:
            differ |= k[order][1:] != k[order][:-1]
        head[1:] = differ
        lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        head |= (doc[order] == doc[order[lead]]) & (place[order] == place[order[lead]])
    out = np.empty(len(order), bool)
    out[order] = head
    return out


class Seen:
    """The earliest place (doc_id, a) of contexts met before. One that came again stays; others give way to new ones."""

    def __init__(self, size: int = SEEN):
        self.bucket, self.context = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.doc, self.a, self.state = (np.zeros(size, np.int64) for _ in range(3))  # state: 0 empty, 1 met once, 2 met again

    def later(self, bucket: np.ndarray, context: np.ndarray, doc: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Whether each row starts later than an equal context met before; the others are remembered."""
        slot = (mix(bucket + mix(context)) & np.uint64(len(self.state) - 1)).astype(np.int64)
        known = (self.state[slot] > 0) & (self.bucket[slot] == bucket) & (self.context[slot] == context)
        late = known & ((doc > self.doc[slot]) | (doc == self.doc[slot]) & (a > self.a[slot]))
        self.state[slot[known]] = 2
        slots, one = np.unique(np.where(~late & (known | (self.state[slot] < 2)), slot, -1), return_index=True)
        slots, one = slots[slots >= 0], one[slots >= 0]
        self.state[slots] = np.where(known[one], 2, 1)
        self.bucket[slots], self.context[slots], self.doc[slots], self.a[slots] = bucket[one], context[one], doc[one], a[one]
        return late


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document, those that overlap or touch as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = doc.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - shift)[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


def ranks_of_ids(part: pa.RecordBatch) -> np.ndarray:
    """Each row's rank by doc_id (equal for equal ids, null first)."""
    ids = [(-1 << 63) - 1 if d is None else d for d in part.column("doc_id").to_pylist()]
    ranks = {d: i for i, d in enumerate(sorted(set(ids)))}
    return np.array([ranks[d] for d in ids], np.int64)


def loaded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a slice's texts, the end of each, and each row's rank by doc_id."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64), ranks_of_ids(part)


def sampled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Sampled suffixes, and spans that repeat within a slice.

    A suffix: bucket, context, doc_id, and a (its place, then how far before it its first and last strings start).
    A span: context null, doc_id, a and b, its start and end; bucket is any number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for part in slices(batch, "text"):
                code, ends, rank = loaded(part)
                place, first, last, value = anchors(code, ends, length, gram)
                if not len(place):
                    continue
                row = np.searchsorted(ends, place, side="right")
                base = (ends - np.diff(ends, prepend=0))[row]
                context = mix(Hashes(code).of(1, first, last + length) + ((place - first) * 256 + (place - last)).astype(np.uint64))
                stays = earliest([context, value], rank[row], place - base)
                a, ids = (place - base) << 14 | (place - first) << 7 | (place - last), part.column("doc_id")
                asked = np.flatnonzero(stays & ids.is_valid().to_numpy(zero_copy_only=False)[row])  # null ids come first anyway
                stays[asked[seen.later(value[asked], context[asked], ids.fill_null(0).to_numpy()[row[asked]], a[asked])]] = False
                gone = ~stays
                doc, start, end = merged(row[gone], (first - base)[gone], (last - base)[gone] + length)
                a = a[stays]
                ids = ids.take(pa.array(np.concatenate([row[stays], doc])))
                n = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([value[stays].view(np.int64), mix((start + 1).astype(np.uint64) * np.uint64(BASES[0]) + value[:1]).view(np.int64)])),
                        pa.array(np.concatenate([context[stays].view(np.int64), np.zeros(n, np.int64)]), mask=np.arange(len(a) + n) >= len(a)),
                        ids, pa.array(np.concatenate([a, start])), pa.array(np.concatenate([np.zeros(len(a), np.int64), end])),
                    ],
                    ["bucket", "context", "doc_id", "a", "b"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, context long, doc_id long, a long, b long")


def contexts(edges: DataFrame, length: int) -> DataFrame:
    """The bytes of all strings of each sampled suffix of edges (doc_id, text, places of a, bucket, salt and split)."""
    names, types = ["bucket", "salt", "split"], "bucket long, salt long, split boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                code, ends, _ = loaded(part)
                sizes = np.diff(ends, prepend=0)
                places = part.column("places")
                n = np.diff(places.offsets.to_numpy())
                a, *rest = (places.flatten().field(i) for i in range(4))
                at, row = a.to_numpy(), np.repeat(np.arange(part.num_rows), n)
                first, end = (at >> 14) - (at >> 7 & 127), (at >> 14) - (at & 127) + length
                inside = end <= sizes[row]  # a doc_id may come with another text
                row, first, end, keep = row[inside], first[inside], end[inside], pa.array(inside)
                size = end - first
                to = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                flat = code[np.repeat(first + (ends - sizes)[row] - to[:-1], size) + np.arange(to[-1])]
                raw = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays([*(x.filter(keep) for x in rest), part.column("doc_id").take(pa.array(row)), a.filter(keep), raw], [*names, "doc_id", "a", "raw"])

    return edges.mapInArrow(run, f"{types}, doc_id long, a long, raw binary")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and salt, cut between groups alone."""
    kept: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [p for p in parts if p.num_rows]
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches() if rows else ()

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, salt = (batch.column(c).to_numpy() for c in ("bucket", "salt"))
        last = int(np.flatnonzero((bucket != bucket[-1]) | (salt != salt[-1]))[-1:].sum() + 1) if (bucket != bucket[-1]).any() or (salt != salt[-1]).any() else 0
        ended = last or (kept and (kept[-1].column("bucket")[-1].as_py(), kept[-1].column("salt")[-1].as_py()) != (bucket[0], salt[0]))
        if ended:
            yield from joined([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    yield from joined(kept)


def shared_with_previous(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows within their groups, and how many bytes each shares with the one before it (-1: of another group)."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    differ = rows[order][1:] != rows[order][:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], shared])


def ranks(order: np.ndarray, shared: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each length (at least 0) and row the rank of its first bytes of that length, ties having the same."""
    out = np.empty((len(lengths), len(order)), np.int32)
    out[:, order] = np.cumsum(shared[None, :] < lengths[:, None], axis=1)
    return out


def sorted_apart(rows: DataFrame, length: int) -> DataFrame:
    """Single strings of contexts by sorting bucket by bucket: part null with spans, or part and rest, its hashes, with a the start.

    Parts of split buckets give their earliest strings on, to be compared over all parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            raw, a = batch.column("raw"), batch.column("a").to_numpy()
            group = np.cumsum(np.concatenate([[False], (np.diff(batch.column("bucket").to_numpy()) != 0) | (np.diff(batch.column("salt").to_numpy()) != 0)]))
            to = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(a) + 1].astype(np.int64)
            code = np.frombuffer(raw.buffers()[2], np.uint8)[to[0] : to[-1]]
            to = to - to[0]
            place, back, fore = a >> 14, a >> 7 & 127, a & 127  # the first string starts `back` before the sampled place, the last `fore`
            # bytes from the sampled place on, and those before it backwards; what lies beyond the context is 0 and in no string
            after = np.zeros((len(a), length), np.uint8)
            step = np.arange(length)
            some = step[None, :] < (length - fore)[:, None]
            after[some] = code[((to[:-1] + back)[:, None] + step)[some]]
            reach = int(back.max()) + 1
            before = np.zeros((len(a), reach), np.uint8)
            step = np.arange(reach)
            some = step[None, :] < back[:, None]
            before[some] = code[((to[:-1] + back - 1)[:, None] - step)[some]]
            offsets = np.arange(reach)
            right = ranks(*shared_with_previous(after, group), length - offsets)
            left = ranks(*shared_with_previous(before, group), offsets)
            count = back - fore + 1
            row = np.repeat(np.arange(len(a)), count)
            offset = back[row] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            start = place[row] - offset
            key = ((right[offset, row].astype(np.int64) << 32 | left[offset, row]) << 7) | offset  # ranks are below 2^24
            ids = batch.column("doc_id")
            rank = np.unique(ids.fill_null(0).to_numpy(), return_inverse=True)[1] + 1
            rank[ids.is_null().to_numpy(zero_copy_only=False)] = 0
            stays = earliest([key], rank[row], start)
            # rows of one doc_id may lie apart in the batch: spans are merged by its rank
            one_of = np.zeros(rank.max() + 1, np.int64)
            one_of[rank] = np.arange(len(a))
            doc, begin, end = merged(rank[row[~stays]], start[~stays], start[~stays] + length)
            on = np.flatnonzero(stays & batch.column("split").to_numpy(zero_copy_only=False)[row])
            at = to[row[on]] + back[row[on]] - offset[on]
            h = Hashes(code)
            one, two = (h.of(i, at, at + length).view(np.int64) for i in (0, 1))
            m, k = len(on), len(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([one, np.zeros(k, np.int64)]), mask=np.arange(m + k) >= m),
                    pa.array(np.concatenate([two, mix((begin + 1).astype(np.uint64) * np.uint64(BASES[1]) + doc.astype(np.uint64)).view(np.int64)])),
                    ids.take(pa.array(np.concatenate([row[on], one_of[doc]]))),
                    pa.array(np.concatenate([start[on], begin])), pa.array(np.concatenate([np.zeros(m, np.int64), end])),
                ],
                ["part", "rest", "doc_id", "a", "b"],
            )

    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(run, "part long, rest long, doc_id long, a long, b long")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """Spans (doc_id, start, end) of docs (doc_id, text) to be removed; they may overlap."""
    bucket, rank = Window.partitionBy("bucket"), Window.partitionBy("bucket", "context").orderBy("doc_id", "a")
    found = sampled(docs, length, gram).withColumn("low", F.min("context").over(bucket)).withColumn("high", F.max("context").over(bucket))
    found = found.withColumn("nth", F.rank().over(rank)).where("context is null or nth > 1 or low <> high").select("doc_id", "a", "b", "nth", "bucket", F.col("context").isNull().alias("span"))
    found = cut(found)
    spans = found.where("span").select("doc_id", F.col("a").alias("start"), F.col("b").alias("end"))
    first, last = (F.shiftright("a", 14) - F.expr(e) for e in ("shiftright(a, 7) & 127", "a & 127"))
    whole = found.where("not span and nth > 1").select("doc_id", first.alias("start"), (last + length).alias("end"))
    edges = found.where("not span and nth = 1").select("doc_id", "a", "bucket")
    # buckets of several parts are few; written, their size is known, and Spark broadcasts them if it is small
    parts = cut(edges.groupBy("bucket").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1"))
    edges = edges.join(parts, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "a"), "parts")).withColumn("split", F.col("parts") > 1)
    edges = edges.groupBy("doc_id").agg(F.collect_list(F.struct("a", "bucket", "salt", "split")).alias("places")).withColumnRenamed("doc_id", "other")
    strings = sorted_apart(contexts(docs.select("doc_id", "text").join(edges, same(F.col("doc_id"), F.col("other"))).drop("other"), length), length)
    nth = F.rank().over(Window.partitionBy("rest", "part").orderBy("doc_id", "a"))
    apart = strings.withColumn("nth", nth).where("part is null or nth > 1")
    apart = apart.select("doc_id", F.col("a").alias("start"), F.when(F.col("part").isNull(), F.col("b")).otherwise(F.col("a") + length).alias("end"))
    return spans.unionByName(whole).unionByName(apart)


def removed(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), and the columns `keep` as struct rest.

    as_text: kept as a string, without bytes that are no characters any more (a span may begin or end within one).
    """
    docs = carried(docs, keep or [])
    kind = dict(docs.dtypes)["rest"]
    spans = repeated(docs.select("doc_id", "text"), length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc_id", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, lost, count = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                start = end = np.empty(0, np.int64)
                if found.is_valid:
                    start, end = (found.values.field(i).to_numpy() for i in (0, 1))
                    end = np.minimum(end, len(raw))
                    _, start, end = merged(np.zeros((start < end).sum(), np.int64), start[start < end], end[start < end])
                edges = [0, *np.column_stack([start, end]).reshape(-1).tolist(), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                sizes.append(len(raw))
                lost.append(len(raw) - len(left))
                count.append(len(start))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, lost, count)), pa.array(kept, pa.string() if as_text else pa.binary()), batch.column("rest")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    joined = docs.join(spans, same(F.col("doc_id"), F.col("other")), "left").drop("other")
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, rest {kind}")
