"""Toxicity by two Kneser-Ney models of words' letters, one of toxic and one of ordinary texts.

An expression is a letter (or a word's end) with up to four letters before it in the word. Each class discounts its own
counts of expressions and gives what is discounted to one shared backoff: continuation counts (how many different
letters an expression follows) over both classes, interpolated from three letters before down to none. An expression
rare in one class therefore falls back on what both know of it and says little.

A word's value is the difference of its log-likelihoods, toxic less ordinary. As a few toxic words drown in a long text,
values are normalised by length at several lengths: the mean over the whole text, and the largest mean over stretches
of 1, 8 and 32 words and over any three words. A logistic curve turns these figures into a score; it is fitted to labelled
texts under models that were counted without them (two folds).

Expressions are kept exactly (21 bits a letter) and counted over every labelled training text. A model of at most LIMIT
expressions and contexts (16 bytes each) is sent to workers. A larger one stays in Spark's tables: the corpus' different
words are joined with it, expression by expression, into one value a word, and the words' places in each text with these
values. Both ways give the same figures, and neither leaves an expression out.

Results for odd input: null, empty or blank texts have figures 0 and the score of these; where there is no labelled
training text of both kinds, every score is 0; null labels are no labels; a doc_id that repeats in labels takes its
largest label; repeated documents are scored each; a text of any length is scored whole; a score of just the cutoff is
predicted toxic; other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, mix, slices, texts, whole_docs
from panelspark.llm.minhash import powers

ORDER = 5
DISCOUNT = 0.75
CUTOFF = 0.3
#: Labelled texts whose figures the logistic curve is fitted to, at most, chosen by hash.
FITTED = 50_000
#: Expressions (and contexts) of a model that is sent to workers, at most; a larger model is joined instead.
LIMIT = 1 << 23
SLICE = 1 << 18
STRETCHES, TOP = (1, 8, 32), 3
FIGURES = ["mean", "spread", *(f"stretch_{k}" for k in STRETCHES), "top"]
BITS = np.uint64(21)
MASK = (1 << 21) - 1
END, BEFORE = 1, 2  # a word's end, and what is before its first letter; letters are their code points and 3
# What stands between words.
STOPS = np.array([*range(33), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128), 0x85, 0xA0, 0x2028, 0x2029], np.uint32)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Words:
    """The words of a slice of texts: the text of each, its different words, and the expressions of these."""

    def __init__(self, rows: list[str]):
        rows = [r.lower() for r in rows]
        lengths = np.array([len(r) + 1 for r in rows], np.int64)
        code = np.frombuffer(("\n".join(rows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.isin(code, STOPS, kind="table")
        change = np.flatnonzero(np.diff(np.concatenate([[True], stop]).astype(np.int8)))
        start, end = change[0::2], change[1::2]
        self.doc = np.searchsorted(np.cumsum(lengths), start, side="right")
        self.counts = np.bincount(self.doc, minlength=len(rows))
        up, down = powers(1 << max(20, int(len(code)).bit_length()))
        value = mix(code.astype(np.uint64) + np.uint64(3))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(code)], dtype=np.uint64)])
        name = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        self.name, first, self.word = np.unique(name, return_index=True, return_inverse=True)
        self.code, self.start, self.size = code, start[first], (end - start)[first]

    def expressions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each letter (and end) of each different word: the word, low (the letter and two before it) and high (two more)."""
        n = self.size + 1
        word = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.start[word] + step
        letters = np.where(step < self.size[word], self.code[np.minimum(at, len(self.code) - 1)].astype(np.uint64) + np.uint64(3), np.uint64(END))
        before = [np.where(step >= j, self.code[np.maximum(at - j, 0)].astype(np.uint64) + np.uint64(3), np.uint64(BEFORE)) for j in range(1, ORDER)]
        return word, letters | before[0] << BITS | before[1] << (BITS + BITS), before[2] | before[3] << BITS


def key(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit number for an expression."""
    return mix(low + mix(high + np.uint64(0x9E3779B97F4A7C15)))


def counts(labelled: DataFrame) -> DataFrame:
    """labelled (text, toxic 0 or 1, fold 0 or 1) as counts c0 to c3 (fold, and 2 if toxic) of each expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = Words(texts(part, "text"))
                kind = (part.column("toxic").to_numpy() * 2 + part.column("fold").to_numpy())[found.doc]
                times = np.zeros((4, len(found.size)), np.int64)
                np.add.at(times, (kind, found.word), 1)
                word, low, high = found.expressions()
                order = np.lexsort((low, high))
                low, high, word = low[order], high[order], word[order]
                head = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.empty(0, np.int64)
                sums = [np.add.reduceat(t[word], head) if len(head) else t[:0] for t in times]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[head].view(np.int64)) for x in (low, high)), *map(pa.array, sums)], ["low", "high", "c0", "c1", "c2", "c3"])

    rows = labelled.select("text", F.col("toxic").cast("long"), F.col("fold").cast("long")).mapInArrow(run, "low long, high long, c0 long, c1 long, c2 long, c3 long")
    return rows.groupBy("low", "high").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(4)))


def backoff(grams: DataFrame) -> DataFrame:
    """low, high4 and q, the shared probability, of each letter after up to three before it (low, and the lowest letter of high)."""
    d = DISCOUNT
    levels = [grams.groupBy("low", F.expr(f"high & {MASK}").alias("high4")).agg(F.count("*").alias("f"))]
    levels.append(levels[-1].groupBy("low").agg(F.count("*").alias("f")))
    levels.append(levels[-1].groupBy(F.expr(f"low & {(1 << 42) - 1}").alias("low")).agg(F.count("*").alias("f")))
    levels.append(levels[-1].groupBy(F.expr(f"low & {MASK}").alias("low")).agg(F.count("*").alias("f")))
    levels = [cut(level) for level in levels]
    total = levels[3].agg(F.sum("f").alias("around"), F.count("*").alias("kinds"))  # one row
    mass = lambda q: (F.greatest(F.col("f") - d, F.lit(0.0)) + d * F.col("kinds") * q) / F.col("around")
    found = levels[3].crossJoin(F.broadcast(total)).select("low", mass(1 / (F.col("kinds") + 1)).alias("q"))
    for level, bits in ((levels[2], MASK), (levels[1], (1 << 42) - 1), (levels[0], None)):
        # what is before the letter, and the same expression with one letter less before it
        context = [F.expr("shiftrightunsigned(low, 21)").alias("context"), *([F.col("high4").alias("context4")] if bits is None else [])]
        names = ["context", "context4"] if bits is None else ["context"]
        lower = F.col("low") if bits is None else F.expr(f"low & {bits}")
        rows = level.select("*", *context, lower.alias("lower"))
        around = rows.groupBy(*names).agg(F.sum("f").alias("around"), F.count("*").alias("kinds"))
        rows = rows.join(around, names).join(found.withColumnRenamed("low", "lower"), "lower")
        found = rows.select("low", *(["high4"] if bits is None else []), mass(F.col("q")).alias("q"))
    return found


def model(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each expression and each context (high, and low without its letter) the difference of log probabilities, toxic less ordinary.

    d0 is by the counts of fold 0, d1 by those of fold 1, d by both. Expressions that neither class has seen after a
    context differ by what the two classes leave to the shared backoff, which is the context's figure.
    """
    d = DISCOUNT
    grams = grams.withColumn("context", F.expr("shiftrightunsigned(low, 21)")).withColumn("high4", F.expr(f"high & {MASK}"))
    classes = {"0": ("c2", "c0"), "1": ("c3", "c1"), "": ("c2 + c3", "c0 + c1")}
    kinds = [(f"{side}{k}", expr) for k, pair in classes.items() for side, expr in zip("to", pair, strict=True)]
    by_context = cut(grams.groupBy("context", "high").agg(*(F.sum(F.expr(e)).alias(f"n_{c}") for c, e in kinds), *(F.sum(F.expr(f"cast({e} > 0 as int)")).alias(f"k_{c}") for c, e in kinds)))
    left = {c: F.when(F.col(f"n_{c}") > 0, d * F.col(f"k_{c}") / F.col(f"n_{c}")).otherwise(1.0) for c, _ in kinds}
    p = {c: F.when(F.col(f"n_{c}") > 0, F.greatest(F.expr(e) - d, F.lit(0.0)) / F.col(f"n_{c}")).otherwise(0.0) + left[c] * F.col("q") for c, e in kinds}
    ratio = lambda of: [(F.log(of[f"t{k}"]) - F.log(of[f"o{k}"])).cast("float").alias(f"d{k}") for k in classes]
    expressions = grams.join(backoff(grams), ["low", "high4"]).join(by_context, ["context", "high"]).select("low", "high", *ratio(p))
    return expressions, by_context.select(F.col("context").alias("low"), "high", *ratio(left))


class Table:
    """Values by 64-bit key: sorted keys, and where those of each of so many highest bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, nan where there is none."""
        out = np.full(len(keys), np.nan, np.float32)
        bucket = (keys >> self.shift).astype(np.int64)
        at, stop, which = self.first[bucket], self.first[bucket + 1], np.arange(len(keys))
        while len(which):
            going = at < stop
            at, stop, which = at[going], stop[going], which[going]
            hit = self.keys[at] == keys[which]
            out[which[hit]] = self.values[at[hit]]
            at, stop, which = at[~hit] + 1, stop[~hit], which[~hit]
        return out


def fetched(rows: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Keys and values of a model's table, LIMIT rows at most."""
    t = rows.toArrow()
    return key(*(t.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))), {c: t.column(c).to_numpy() for c in ("d0", "d1", "d")}


def stretches(value: np.ndarray, doc: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The largest mean of k words in a row of each text (of all its words, if fewer); 0 without words."""
    sums = np.concatenate([[0.0], np.cumsum(value)])
    out, begin = np.zeros(len(counts)), np.cumsum(counts) - counts
    short = counts < k
    few = short & (counts > 0)
    out[few] = (sums[begin + counts] - sums[begin])[few] / counts[few]
    best = np.full(len(counts), -np.inf)
    at = np.flatnonzero(doc[: len(value) - k + 1] == doc[k - 1 :]) if len(value) >= k else np.empty(0, np.int64)
    np.maximum.at(best, doc[at], (sums[at + k] - sums[at]) / k)
    return np.where(short, out, best)


def top(value: np.ndarray, doc: np.ndarray, counts: np.ndarray, k: int = TOP) -> np.ndarray:
    """The mean of the k largest values of each text (of all, if fewer); 0 without words."""
    order = np.lexsort((-value, doc))
    rank = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.bincount(doc[order], np.where(rank < k, value[order], 0.0), len(counts)) / np.maximum(np.minimum(counts, k), 1)


def figures_of(value: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """FIGURES of each text by the values of its words in order."""
    mean = np.bincount(doc, value, len(counts)) / np.maximum(counts, 1)
    return [mean, mean * np.sqrt(counts), *(stretches(value, doc, counts, k) for k in STRETCHES), top(value, doc, counts)]


def with_figures(docs: DataFrame, keep: list[str]) -> str:
    """The schema of docs' columns `keep` with FIGURES and the number of words."""
    return ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep) + "".join(f", {c} double" for c in FIGURES) + ", words long"


def figures(docs: DataFrame, tables: dict[str, tuple[Table, Table]], column: Column) -> DataFrame:
    """docs (with text) with FIGURES of each under the model that `column` names, and the number of words.

    tables: expressions and contexts of each model, sorted once here rather than in every task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tables)  # at most 2 * LIMIT * 16 bytes a model
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found, rows = Words(texts(part, "text")), part.num_rows
                which, out = np.array(part.column("model").to_pylist()), np.zeros((len(FIGURES), rows))
                word, low, high = found.expressions()
                for name, (expressions, contexts) in models.items():
                    if not (mine := which == name).any():
                        continue
                    value = expressions.get(key(low, high))
                    missing = np.flatnonzero(np.isnan(value))
                    value[missing] = contexts.get(key(low[missing] >> BITS, high[missing]))
                    np.nan_to_num(value, copy=False)
                    value = np.bincount(word, value, len(found.size))[found.word]
                    out = np.where(mine, np.array(figures_of(value, found.doc, found.counts)), out)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, out), pa.array(found.counts.astype(np.int64))], [*keep, *FIGURES, "words"])

    return docs.withColumn("model", column).mapInArrow(run, with_figures(docs, keep))


def word_values(docs: DataFrame, expressions: DataFrame, contexts: DataFrame) -> DataFrame:
    """word (64 bits of its letters) and its value under each model (d0, d1, d), for all different words of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = Words(texts(part, "text"))
                word, low, high = found.expressions()
                order = np.lexsort((low, high, word))
                word, low, high = word[order], low[order], high[order]
                head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(word) else np.empty(0, np.int64)
                times = np.diff(np.append(head, len(word)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[head].view(np.int64)) for x in (found.name[word], low, high)), pa.array(times)], ["word", "low", "high", "times"])

    parts = docs.select("text").mapInArrow(run, "word long, low long, high long, times long").groupBy("word", "low", "high").agg(F.max("times").alias("times"))
    names = ["d0", "d1", "d"]
    after = contexts.select(F.col("low").alias("context"), "high", *(F.col(c).alias(f"left_{c}") for c in names))
    parts = parts.join(expressions, ["low", "high"], "left").withColumn("context", F.expr("shiftrightunsigned(low, 21)")).join(after, ["context", "high"], "left")
    value = lambda c: F.sum(F.coalesce(F.col(c), F.col(f"left_{c}"), F.lit(0.0)).cast("double") * F.col("times")).alias(c)
    return parts.groupBy("word").agg(*map(value, names))


def joined_figures(docs: DataFrame, values: DataFrame, column: Column) -> DataFrame:
    """What `figures` returns, by joining each text's words with word_values; a text's different words come as a row each."""
    keep = [c for c in docs.columns if c != "text"]
    docs = docs.withColumn("row", F.monotonically_increasing_id())  # texts and ids may repeat
    kinds = "".join(f"{c} {dict(docs.dtypes)[c]}, " for c in [*keep, "row"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = Words(texts(part, "text"))
                place = np.arange(len(found.doc)) - np.repeat(np.cumsum(found.counts) - found.counts, found.counts)
                order = np.lexsort((place, found.word, found.doc))
                doc, word = found.doc[order], found.word[order]
                head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])) if len(doc) else np.empty(0, np.int64)
                blank = np.flatnonzero(found.counts == 0)
                rows, m = pa.array(np.concatenate([doc[head], blank])), len(head)
                names = pa.array(np.concatenate([found.name[word[head]].view(np.int64), np.zeros(len(blank), np.int64)]), mask=np.arange(m + len(blank)) >= m)
                ends = np.concatenate([head, np.full(len(blank) + 1, len(doc))]).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in [*keep, "row"]), names, places], [*keep, "row", "word", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "found", 1 << 14):
                pairs = part.column("found").flatten()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("found")).to_numpy())
                times = pc.fill_null(pc.list_value_length(pairs.field("places")), 0).to_numpy()
                doc, place = np.repeat(row, times), pairs.field("places").flatten().to_numpy()
                order = np.lexsort((place, doc))
                value, doc = np.repeat(pc.fill_null(pairs.field("value"), 0.0).to_numpy(), times)[order], doc[order]
                counts = np.bincount(doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, figures_of(value, doc, counts)), pa.array(counts.astype(np.int64))], [*keep, *FIGURES, "words"])

    rows = docs.mapInArrow(split, f"{kinds}word long, places array<int>").withColumn("model", column).join(values, "word", "left")
    value = F.when(F.col("model") == "0", F.col("d1")).when(F.col("model") == "1", F.col("d0")).otherwise(F.col("d"))  # each fold by the other's counts
    found = rows.groupBy(*keep, "row").agg(F.collect_list(F.struct(value.alias("value"), "places")).alias("found"))
    return found.mapInArrow(run, with_figures(docs, keep))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression on standardised columns by Newton's steps, each halved until the loss falls; weights of the columns as given."""
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    b = np.zeros(x.shape[1])
    pull = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    loss = lambda b: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ b)).sum() + b @ pull @ b / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(b)), x.T @ (y - p) - pull @ b)
        part = 1.0
        while part > 1e-4 and loss(b + part * step) > loss(b):
            part /= 2
        b = b + part * step
        if np.abs(part * step).max() < 1e-8:
            break
    return np.concatenate([[b[0] - (b[1:] * middle / scale).sum()], b[1:] / scale])


def scored(docs: DataFrame, labels: DataFrame, fitted: int = FITTED, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted, FIGURES and words of every text of docs."""
    docs = whole_docs(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    # a shuffle at every size: the labels grow with the corpus
    training = docs.where(~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id").withColumn("fold", fold)
    grams = cut(counts(training))
    expressions, contexts = model(grams)
    some = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(fitted)
    judged = docs.join(F.broadcast(some), "doc_id").select("text", "toxic", fold.alias("fold"))  # `fitted` rows of two numbers
    own, all_of = F.col("fold").cast("string"), F.lit("all")
    if max(grams.count(), contexts.count()) <= limit:
        (keys, values), (places, lefts) = fetched(expressions), fetched(contexts)
        tables = lambda c: (Table(keys, values[c]), Table(places, lefts[c]))
        sample, out = figures(judged, {"0": tables("d1"), "1": tables("d0")}, own), figures(docs, {"all": tables("d")}, all_of)
    else:
        valued = cut(word_values(docs, expressions, contexts))
        sample, out = joined_figures(judged, valued, own), joined_figures(docs, valued, all_of)
    sample = sample.select("toxic", *FIGURES).toArrow()
    y = sample.column("toxic").to_numpy()
    learnt = 0 < y.sum() < len(y)
    score = F.lit(0.0)
    if learnt:
        weights = logistic(np.column_stack([sample.column(c).to_numpy() for c in FIGURES]), y)
        score = 1 / (1 + F.exp(-sum((float(w) * F.col(c) for w, c in zip(weights[1:], FIGURES, strict=True)), F.lit(float(weights[0])))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= CUTOFF).cast("int").alias("predicted"), *FIGURES, "words")
