"""Quality rules with risk-controlled thresholds.

Measures of a text are compared with cutoffs, stratum by stratum (by number of words). Labelled texts whose crc32 of the
id as text leaves 2 when divided by 4 are held out. The other labelled texts lay a path of ever stricter rules: at each of
LEVELS every measure's cutoff is the strictest candidate that rejects at most that share of their good texts, if it
rejects bad ones at GAIN times the rate of good ones. A rule (all measures of a level together) is certified if the exact
binomial (Clopper-Pearson) upper bound of the share of good held-out texts it rejects, at ERROR over the number of strata
and levels (Bonferroni), is within RISK. So, with probability 1 - ERROR, no stratum loses more than RISK of its good
texts. Of certified rules the one that rejects most bad held-out texts is taken.

Results for odd input: null and empty texts have no words and fail the base rule; without labels, or with too few to
certify a rule, only the base rule rejects; null labels are no labels, a doc_id that repeats in labels takes its largest;
repeated documents are measured each; a null doc_id has no label; a text of any length is measured whole; a value equal
to a cutoff isn't rejected; other columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut, mix, slices, texts, whole_docs
from panelspark.llm.minhash import BASE, SLICE, word_hashes

RISK, ERROR, GAIN = 0.02, 0.05, 3.0
#: Shares of good texts that one measure may reject where the rules are laid out.
LEVELS = (0.0, 0.0003, 0.0006, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.006, 0.01)
#: Candidate cutoffs of each measure, all of which are shares or mean lengths; "over" rejects above, "under" below.
STEPS = 40
MEASURES = {
    "long_words": ("over", "word_chars / greatest(n_words, 1)", [6 + 0.5 * i for i in range(STEPS)]),
    "short_words": ("under", "word_chars / greatest(n_words, 1)", [1 + 0.1 * i for i in range(STEPS)]),
    "symbols": ("over", "n_symbols / greatest(word_chars, 1)", [0.005 * (i + 1) for i in range(STEPS)]),
    "repeated_lines": ("over", "n_dup_lines / greatest(n_lines, 1)", [i / STEPS for i in range(STEPS)]),
    "repeated_words": ("over", "n_repeat_words / greatest(n_words, 1)", [i / STEPS for i in range(STEPS)]),
    "capitals": ("over", "n_capitals / greatest(word_chars, 1)", [i / STEPS for i in range(1, STEPS + 1)]),
}
#: Strata: texts of at least so many words.
STRATA = [0, 100, 300, 1000]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def repeated_words(rows: list[str], size: int = 3) -> np.ndarray:
    """For each text the number of words in windows of `size` words that are found twice or more in it."""
    doc, word = word_hashes(rows, ignore_case=False)
    n = len(word) - size + 1
    if n < 1:
        return np.zeros(len(rows), np.int64)
    window = np.zeros(n, np.uint64)
    for j in range(size):
        window = mix(window * np.uint64(BASE) + word[j : j + n])
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    at = at[np.lexsort((window[at], doc[at]))]
    like_next = (window[at][1:] == window[at][:-1]) & (doc[at][1:] == doc[at][:-1])
    often = at[np.concatenate([like_next, [False]]) | np.concatenate([[False], like_next])]
    edges = np.zeros(len(word) + 1, np.int64)
    edges[often] += 1
    np.subtract.at(edges, often + size, 1)
    return np.bincount(doc[np.cumsum(edges[:-1]) > 0], minlength=len(rows))


def measure(text: str) -> list[int]:
    """COUNTS of a text, but for repeated words; bytes are split at just the white space meant here."""
    raw = text.encode("utf-8", "surrogatepass")
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    return [len(raw.split()), len(text) - blank, symbols, len(lines) - len(set(lines)), 0, len(lines), capitals]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id with the counts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                of = texts(part, "text")
                rows = np.array([measure(t) for t in of], np.int64)
                rows[:, COUNTS.index("n_repeat_words")] = repeated_words(of)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], ["doc_id", *COUNTS])

    return whole_docs(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def at_most(k: int, n: int, p: float) -> float:
    """Probability of k or fewer of n at rate p."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound of the rate, k of n being rejected, is within risk."""
    return n > 0 and k <= risk * n and at_most(k, n, risk) <= error


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    return sum((F.col("n_words") >= s).cast("int") for s in STRATA[1:])


def past(side: str, value: Column, cutoff: float) -> Column:
    return value > cutoff if side == "over" else value < cutoff


def beyond(side: str, value: str, cutoffs: Column) -> Column:
    """How many of an array of cutoffs a measure is past."""
    return F.size(F.filter(cutoffs, lambda c: past(side, F.expr(value), c)))


def paths(rows: DataFrame) -> dict[tuple[int, str], list[float | None]]:
    """For each stratum and measure the cutoff at each of LEVELS (None: rejects nothing), from labelled rows (counts, quality).

    The driver meets one count for each stratum, label, measure and number of candidates passed, a number fixed above.
    """
    passed = [beyond(side, value, F.array(*map(F.lit, steps))) for side, value, steps in MEASURES.values()]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("measure"), p.alias("passed")) for i, p in enumerate(passed)))).alias("x")
    seen = rows.select(stratum().alias("stratum"), "quality", each).groupBy("stratum", "quality", "x.measure", "x.passed").count().collect()
    out = {}
    for s in range(len(STRATA)):
        for i, (name, (side, _, steps)) in enumerate(MEASURES.items()):
            counts = {q: [0] * (STEPS + 1) for q in (0, 1)}
            for r in seen:
                if r["stratum"] == s and r["measure"] == i:
                    counts[r["quality"]][r["passed"]] += r["count"]
            ordered = sorted(steps, reverse=side == "over")  # strictest last; the m-th rejects rows that passed STEPS - m or more
            lost, hit = ([sum(counts[q][STEPS - m :]) for m in range(STEPS)] for q in (1, 0))
            n, bad = sum(counts[1]), sum(counts[0])
            useful = [m for m in range(STEPS) if hit[m] and hit[m] * n >= GAIN * lost[m] * bad]
            out[s, name] = [ordered[max(fit)] if (fit := [m for m in useful if lost[m] <= level * n]) else None for level in LEVELS]
    return out


def cutoffs(training: DataFrame, holdout: DataFrame, risk: float = RISK, error: float = ERROR) -> list[tuple[int, str, float]]:
    """(stratum, measure, cutoff) of the rule certified for each stratum; both tables: counts and quality of labelled rows."""
    path = paths(training)
    failed = []  # rules by which a measure rejects a row, always the last ones
    for name, (side, value, _) in MEASURES.items():
        never = math.inf if side == "over" else -math.inf
        by_stratum = F.array(*(F.array(*(F.lit(never if c is None else c) for c in path[s, name])) for s in range(len(STRATA))))
        failed.append(beyond(side, value, F.get(by_stratum, stratum())))
    level = F.lit(len(LEVELS)) - F.greatest(*failed)  # of the first rule that rejects a row
    seen = holdout.select(stratum().alias("stratum"), "quality", level.alias("level")).groupBy("stratum", "quality", "level").count().collect()
    tests, out = len(STRATA) * len(LEVELS), []
    for s in range(len(STRATA)):
        mine = [r for r in seen if r["stratum"] == s]
        n, best = sum(r["count"] for r in mine if r["quality"] == 1), None
        for j in range(len(LEVELS)):
            k, hit = (sum(r["count"] for r in mine if r["quality"] == q and r["level"] <= j) for q in (1, 0))
            if hit and certified(k, n, risk, error / tests):
                best = max(best or (0, 0, 0), (hit, -k, j))
        if best:
            out += [(s, name, steps[best[2]]) for (t, name), steps in path.items() if t == s and steps[best[2]] is not None]
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every text."""
    rows = cut(measured(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = cut(rows.where(~base_failed()).join(known, "doc_id"))
    chosen = cutoffs(labelled.where(~held_out(F.col("doc_id"))), labelled.where(held_out(F.col("doc_id"))), risk, error)
    rejected = F.lit(False)
    for s, name, cutoff in chosen:
        side, value, _ = MEASURES[name]
        rejected = rejected | ((stratum() == s) & past(side, F.expr(value), cutoff))
    return rows.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
