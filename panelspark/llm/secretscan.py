"""Secrets found by rules, through an inverted index of trigrams.

Each rule is a regular expression. From it a Boolean trigram query is derived (see trigrams.py), and the index holds the
postings of all trigrams that some rule asks for: documents come in blocks of about BLOCK by their key, and a posting is the list of
keys of a block's documents that hold the trigram, whatever the case of its letters. A query is answered by intersecting the
postings of each alternative's trigrams and uniting the alternatives, block by block, so that a trigram that every document
holds is as many bounded lists as there are blocks. Candidates meet their whole texts again and the rule itself is
matched there, leftmost and non-overlapping. Rules without a mandatory trigram are matched in every text.

Places of matches are counted in code points from the pieces between them. All of it is columns of Spark: no Python runs on
executors.

Results for odd input: a null text counts as empty and has no spans; a null or repeated doc_id is a document by itself, rows
that repeat both doc_id and text get the same result each; a text of any length is taken whole; an empty table gives no rows;
other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut
from panelspark.llm.trigrams import EVERYTHING, query_of

#: Documents of a block, and matches whose places are summed up at once.
BLOCK, TOGETHER = 4096, 256
SPANS = "array<struct<start: int, kind: int, stop: int>>"
NO_SPANS = f"cast(array() as {SPANS})"
NO_KEYS = "cast(array() as array<bigint>)"


@dataclass(frozen=True)
class Rule:
    """A regular expression that Spark and Python read alike; a match counts if `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds that are always looked for; counted repeats find the same as matching any length and dropping short matches.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Further secrets, of the forms that their issuers publish.
ISSUED = (
    Rule("private_key", r"-----BEGIN(?: [A-Z0-9]{1,20}){0,4} PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D/@:]{1,256}:[^\x20\x09-\x0D/@:]{1,256}@"),
)
RULES = BASE + ISSUED


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The index of docs (key, text): block, gram (a place in grams) and keys."""
    blocks = F.lit(max(1, -(-docs.count() // BLOCK))).cast("long")
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams))))
    found = low.select(F.pmod("key", blocks).alias("block"), "key", F.explode(held).alias("gram"))
    return found.groupBy("block", "gram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """key and rules (places in `rules`) of the documents whose trigrams answer a rule's query."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("of"))

    def posting(gram: str) -> Column:
        return F.coalesce(F.element_at("of", F.lit(grams.index(gram))), F.expr(NO_KEYS))

    answers = []
    for i, rule in enumerate(rules):
        query = query_of(rule.pattern)
        if query == EVERYTHING:
            continue
        united = None
        for alternative in sorted(map(sorted, query)):
            met = posting(alternative[0])
            for gram in alternative[1:]:
                met = F.array_intersect(met, posting(gram))
            united = met if united is None else F.array_union(united, met)
        answers.append(F.struct(F.lit(i).alias("rule"), united.alias("keys")))
    each = blocks.select(F.explode(F.array(*answers)).alias("a")).select("a.rule", F.explode("a.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_list("rule").alias("rules"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body speaks of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def summed(steps: Column, kind: int) -> Column:
    """Spans of matches, of which steps has the length of the piece before, their own length, and whether they count."""

    def add(so_far: Column, s: Column) -> Column:
        start = so_far.at + s.gap
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + s["size"]).alias("stop"))
        return F.struct((start + s["size"]).alias("at"), F.concat(so_far.spans, F.when(s.fits, F.array(span)).otherwise(F.expr(NO_SPANS))).alias("spans"))

    def move(so_far: Column, g: Column) -> Column:
        own = F.array(F.struct(so_far.at.alias("base"), g.spans.alias("spans")))
        return F.struct((so_far.at + g.at).alias("at"), F.concat(so_far.groups, own).alias("groups"))

    def shift(g: Column) -> Column:
        return F.transform(g.spans, lambda s: F.struct((s.start + g.base).alias("start"), s.kind.alias("kind"), (s.stop + g.base).alias("stop")))

    begun, none = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("spans")), F.expr(f"cast(array() as array<struct<base: int, spans: {SPANS}>>)")
    groups = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(TOGETHER)), lambda i: F.aggregate(F.slice(steps, i, F.lit(TOGETHER)), begun, add))
    return F.flatten(F.transform(F.aggregate(groups, F.struct(F.lit(0).alias("at"), none.alias("groups")), move).groups, shift))


def places(text: Column, rule: Rule, kind: int) -> Column:
    """Spans (start, kind, stop) of a rule's matches.

    A match starts after all pieces and matches before it. These are summed up TOGETHER matches at a time and then over
    such groups, so that a text of many matches takes no square of their number.
    """

    def steps(matches: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
        sizes = F.zip_with(matches, values, lambda m, v: F.struct(F.length(m).alias("size"), (F.length(v) >= rule.least).alias("fits")))
        before = F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), F.length)
        return F.zip_with(before, sizes, lambda gap, s: F.struct(gap.alias("gap"), s["size"].alias("size"), s.fits.alias("fits")))

    matched = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    return bound(matched, lambda m: F.when(F.size(m) > 0, bound(steps(m), lambda s: summed(s, kind))).otherwise(F.expr(NO_SPANS)))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of start, kind: a place in rules, stop; by start, then kind) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # documents that share a key only share candidates
    queries = [query_of(r.pattern) for r in rules]
    grams = sorted({g for q in queries for alternative in q for g in alternative})
    if grams:
        index = cut(postings(docs.select("key", "text"), grams))
        docs = docs.join(candidates(index, rules, grams), "key", "left")
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<int>"))
    found = []
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        at = places(F.col("text"), rule, i)
        found.append(at if query == EVERYTHING else F.when(F.array_contains("rules", i), at).otherwise(F.expr(NO_SPANS)))
    return docs.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def printed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")
