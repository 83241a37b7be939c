"""I-Match fingerprints with randomised lexicons.

The lexicon holds the terms (words in lower case, by 64-bit hash) with a document frequency from LOW documents to a share
of HIGH. Random subsets of it are drawn in FAMILIES, each nested: the first of LEVELS holds a fourth of the lexicon, the next a
fourth of that, and so on, by bits of a hash of its own. A text's distinct terms in the whole lexicon and in each subset are folded to
one hash by XOR; its fingerprint is these hashes. A text without any term of the lexicon has the hash of all its text
instead. A subset's hash survives an edit if none of the terms lost or gained is in it: large subsets tell near copies,
small ones texts that share a part. The likeness of two fingerprints is the share of equal hashes among those of which
either text has terms, each with its level as weight (the whole lexicon with 1).

No text is joined with the lexicon term by term: terms above HIGH are few (at most the mean number of a text's terms over
HIGH), those of one document alone are told to it, and all other words of texts are in the lexicon. Only the up to two
words that an edited text may have from neither document are looked up.

Results for odd input: a null text counts as empty; a null doc_id comes first in order; rows that repeat both doc_id and
text are one document and get the same result; the document after the last is the first, which may be itself; of rows
that share a doc_id the order is by hash; a text of any length is taken whole; an empty table gives no rows; other columns
are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import cut, whole_docs

LOW, HIGH = 2, 0.05
FAMILIES, LEVELS = 15, 6
NO_TERMS = "cast(array() as array<bigint>)"


def hashed(word: Column) -> Column:
    return F.when(word != "", F.xxhash64(word))


def terms(text: Column) -> Column:
    """Distinct hashes of a text's words."""
    return F.array_distinct(F.array_compact(F.transform(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), hashed)))


def first_word(text: Column) -> Column:
    """What stands before the first blank."""
    return F.regexp_extract(text, "^[^\\x20\\x09-\\x0D]*", 0)


def last_word(text: Column) -> Column:
    return F.reverse(first_word(F.reverse(text)))


def folded(found: Column) -> Column:
    """Hashes as one number of 32 bits, whatever their order; 0 for none."""
    return F.shiftright(F.aggregate(found, F.lit(0).cast("long"), lambda sofar, t: sofar.bitwiseXOR(t)), 32).cast("int")


def family(found: Column, j: int) -> Column:
    """The numbers of the j-th family's subsets, the largest first; each is drawn from the one before by two bits."""

    def smaller(of: Column, level: Column) -> Column:
        return F.filter(of, lambda t: t.bitwiseAND(F.call_function("shiftleft", F.lit(3).cast("long"), 2 * level)) == 0)

    def step(sofar: Column, level: Column) -> Column:
        return F.struct(smaller(sofar.of, level).alias("of"), F.concat(sofar.numbers, F.array(folded(sofar.of))).alias("numbers"))

    own = F.transform(found, lambda t: F.xxhash64(F.lit(j), t))
    start = F.struct(smaller(own, F.lit(0)).alias("of"), F.expr("cast(array() as array<int>)").alias("numbers"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step, lambda end: end.numbers)


def state(found: Column) -> Column:
    """The numbers of the lexicon and of each subset; joined() puts those of disjoint sets together."""
    return F.concat(F.array(folded(F.transform(found, lambda t: F.xxhash64(F.lit(-1), t)))), *(family(found, j) for j in range(FAMILIES)))


def joined(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def prints(parts: Column, whole: Column) -> Column:
    """A fingerprint of the numbers that state() gives."""
    hashes = F.transform(parts, lambda x: F.when(x != 0, F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.lit("")))
    return F.array_join(F.when(F.get(parts, F.lit(0)) != 0, hashes).otherwise(F.array(F.hex(whole))), ".")


def following(keys: DataFrame) -> DataFrame:
    """keys (doc_id, m1, m2, n_chars), distinct, with m1 and m2 of the next in order; after the last comes the first.

    Ranges of keys are numbered in order by their partitions; only one row a range meets in one task.
    """
    ranges = cut(keys.repartitionByRange("doc_id", "m1").withColumn("part", F.spark_partition_id()))
    place = F.struct("doc_id", "m1", "m2")
    inside = Window.partitionBy("part").orderBy("doc_id", "m1", "m2")
    first = ranges.groupBy("part").agg(F.min(place).alias("place"))
    whole = Window.orderBy("part")
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("part", F.coalesce(F.lead("place").over(whole), F.first("place").over(everything)).alias("after"))
    found = ranges.withColumn("next", F.lead(place).over(inside)).join(first, "part").withColumn("next", F.coalesce("next", "after"))
    return found.select("m1", "m2", "n_chars", F.col("next.m1").alias("next_m1"), F.col("next.m2").alias("next_m2"))


WEIGHTS = [1, *(level for _ in range(FAMILIES) for level in range(1, LEVELS + 1))]


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' parts (arrays; one part where the lexicon has no term)."""
    weights = F.array(*map(F.lit, WEIGHTS))
    pairs = F.zip_with(weights, F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda w, p: F.struct(w.alias("w"), p.x.alias("x"), p.y.alias("y")))
    total = lambda fits: F.aggregate(F.filter(pairs, fits), F.lit(0), lambda sofar, p: sofar + p.w)
    some, equal = total(lambda p: (p.x != "") | (p.y != "")), total(lambda p: (p.x != "") & (p.x == p.y))
    return F.when(a == b, 1.0).when((F.size(a) == 1) | (F.size(b) == 1), 0.0).otherwise(equal / some)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and likenesses (see the module's docstring).

    The edited text's second half gives way to as many characters of the next document's beginning.
    """
    docs = whole_docs(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("m1", F.xxhash64("doc_id", "text")).withColumn("m2", F.xxhash64(F.lit(8), "text", "doc_id"))
    key = ["m1", "m2"]  # 128 bits that name a doc_id with its text
    half = F.floor(F.col("n_chars") / 2).cast("int")
    order = cut(following(docs.select("doc_id", *key, F.length("text").alias("n_chars")).distinct()))
    wanted = order.select(F.col("next_m1").alias("m1"), F.col("next_m2").alias("m2"), half.alias("wanted"), F.col("m1").alias("for_m1"), F.col("m2").alias("for_m2"))
    total = docs.count()
    counted = docs.select("m1", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.min("m1").alias("m1"))
    often = F.col("df") > max(HIGH * total, float(LOW))
    counted = cut(counted.select("term", often.alias("often"), F.when(F.col("df") < LOW, F.col("m1")).alias("m1")))
    common = counted.where("often").agg(F.collect_list("term").alias("common"))  # one row
    # should two documents have one m1, each is told the other's terms as well, which it hasn't
    alone = cut(counted.where("m1 is not null").groupBy("m1").agg(F.collect_list("term").alias("alone")))
    lexicon = counted.where("not often and m1 is null").select("term")
    # all tables are dealt by m1 alone, so that texts are shuffled once; m2 is compared within
    by_m1 = lambda a, b: (F.col(f"{a}.m1") == F.col(f"{b}.m1")) & (F.col(f"{a}.m2").bitwiseXOR(F.col(f"{b}.m2")) == 0)
    lent = docs.alias("d").join(wanted.alias("w"), by_m1("d", "w")).select("d.*", "wanted", "for_m1", "for_m2").join(alone, "m1", "left")
    # the lender's id is kept so that both joins need the same columns of docs
    lent = lent.select(F.col("for_m1").alias("m1"), F.col("for_m2").alias("m2"), F.left("text", F.col("wanted")).alias("lent"), F.col("doc_id").alias("lender"), F.col("alone").alias("lender_alone")).repartition("m1").dropDuplicates(key)
    edited = docs.alias("d").join(lent.alias("l"), by_m1("d", "l")).select("d.*", "lent", "lender", "lender_alone").join(alone, "m1", "left")
    edited = edited.crossJoin(F.broadcast(common)).withColumn("n_chars", F.length("text")).withColumn("left", F.left("text", F.col("n_chars") - half))
    edited = edited.withColumn("edited", F.concat("left", "lent")).withColumn("common", F.concat("common", F.coalesce("alone", F.expr(NO_TERMS))))
    seams = F.array_distinct(F.array_compact(F.array(hashed(F.lower(F.concat(last_word(F.col("left")), first_word(F.col("lent"))))), hashed(F.lower(last_word(F.col("edited")))))))
    edited = edited.withColumn("seams", seams).withColumn("own", F.array_except(terms(F.col("text")), "common"))
    edited = edited.withColumn("other", F.array_except(terms(F.col("edited")), F.concat("common", F.coalesce("lender_alone", F.expr(NO_TERMS)), "seams")))
    edited = edited.select("doc_id", "lender", *key, F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), state(F.col("own")).alias("own"), F.xxhash64("text").alias("whole"), state(F.col("other")).alias("other"), "seams", F.xxhash64("edited").alias("other_whole"))
    compact = cut(edited)
    found = compact.select(*key, F.explode("seams").alias("term")).join(lexicon, "term").groupBy(*key).agg(F.collect_set("term").alias("known"))
    both = joined(F.col("other"), state(F.coalesce("known", F.expr(NO_TERMS))))
    # numbers up to the last step, as fingerprints in print take twice the room on disk
    rows = cut(compact.join(found, key, "left").select("doc_id", *key, "n_chars", "edited_sha256", "own", "whole", both.alias("other"), "other_whole"))
    nexts = rows.select(F.col("m1").alias("next_m1"), F.col("m2").alias("next_m2"), F.col("own").alias("next_own"), F.col("whole").alias("next_whole")).dropDuplicates(["next_m1", "next_m2"])
    after = order.select(*key, "next_m1", "next_m2").join(nexts, ["next_m1", "next_m2"]).select(*key, "next_own", "next_whole")
    rows = rows.join(after, key).select("doc_id", "n_chars", "edited_sha256", *(prints(F.col(a), F.col(b)).alias(a) for a, b in (("own", "whole"), ("other", "other_whole"), ("next_own", "next_whole"))))
    parts = lambda c: F.split(c, "[.]")
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"), likeness(parts("own"), parts("other")).alias("near_edited"), likeness(parts("own"), parts("next_own")).alias("near_next"))
