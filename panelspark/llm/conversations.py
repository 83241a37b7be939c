"""Repair of the structure of conversations.

A conversation's rows are kept (cost 0), given the role user or assistant (1), or deleted (2), and rows of empty text may be
inserted (5), so that the initials of its roles become nothing or (s?(ua)+). Rows that are blank or repeat an earlier row must
go; a truncated row that stays costs 5 more. Of the cheapest ways the one whose audit, the edits' initials in order, is
the ASCII-least is taken.

The search goes over retained rows alone. Its state is the last initial given out: none yet, s, u or a. From the end of a
conversation backwards, each state has a running minimum over the rows that may be retained next: the sum of deletions before
such a row, what has to be inserted between its initial and the state's, its own cost, and the rest's. Prefix sums of
deletions make gaps of any length one subtraction. Of equal costs the later row wins (deletions before it come first in the
audit), and for one row the lesser of the edits "IK", "IR", "K" and "R".

A conversation may hold a large share of all rows. So rows are dealt by ranges of their order, and a conversation is
the sequence of its pieces, one in each range. A piece is searched for each state that it may be left in, which gives
the costs from every state before it to every state after; pieces' costs are put together from the last to the first, which
tells each piece what follows it; then it is searched once more, and its way is taken from the state that the pieces before
it leave. Equal rows are counted before they are dealt. Rows and their texts are never gathered by conversation.
digests() alone, whose hash of a repaired conversation is one chain, reads its rows in order, batch by batch, in one task.

Results for odd input: nulls in role and text count as one blank; a null turn comes first in order and counts for no gap; a
null conv_id is a conversation by itself; rows of the same turn come in the order of role and text; roles of other initials
than s, u and a (capitals too) can be deleted or given another role only; texts of any length are taken whole; an empty table gives
no rows; other columns are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.llm.common import cut, same, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: The last initial given out.
NONE, S, U, A = range(4)
#: Initials of roles, with 4 for all others; codes of rows are initial + 5 * fault (0 none, 1 blank, 2 duplicate, 3 truncated).
INITIALS, OTHER = "sua", 4
FAR = 1 << 40
#: What is inserted after each state if nothing more is retained.
ENDS = np.array([0, 2, 1, 0]) * INSERT
BLANKS = "\\x20\\x09-\\x0D"
#: Whether an initial may follow another.
LEGAL = np.zeros((5, 5), bool)
LEGAL[S, U] = LEGAL[U, A] = LEGAL[A, U] = True
#: The edits of a retained row by their audits, least first.
EDITS = ["IK", "IR", "K", "R"]
DROP = len(EDITS)


def edits() -> tuple[np.ndarray, np.ndarray]:
    """Cost of each edit of a row, by [initial, state, edit] (FAR: not allowed), and the state after it."""
    cost, after = np.full((5, 4, len(EDITS)), FAR), np.zeros((5, 4, len(EDITS)), np.int64)
    for initial in (S, U, A, OTHER):
        for state in range(4):
            wanted = A if state == U else U  # the only initial that can follow without an insertion
            other = U if wanted == A else A
            for i, edit in enumerate(EDITS):
                given = other if edit[0] == "I" else wanted
                if edit[-1] == "R":
                    cost[initial, state, i] = REROLE + INSERT * (edit[0] == "I")
                elif initial == given:
                    cost[initial, state, i] = INSERT * (edit[0] == "I")
                elif initial == S and state == NONE and edit == "K":
                    cost[initial, state, i], given = 0, S
                after[initial, state, i] = given
    return cost, after


COST, AFTER = edits()


def searched(codes: np.ndarray, times: np.ndarray, ends: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces (rows up to each of ends, follows: cost of what comes after, by [piece, state]) the least cost from each
    state before them, by [piece, state], and the edit of each row by [row, state] (DROP: another row is retained next).

    All pieces are walked at once, from their last rows backwards.
    """
    begins = np.concatenate([[0], ends[:-1]])
    initial, fault = codes % 5, codes // 5
    dropped = DELETE * times
    sums = np.cumsum(dropped) - dropped  # deletions before each row; only differences within a piece count
    upto = np.concatenate([sums, [dropped.sum()]])
    best = upto[ends][:, None] + follows  # the running minima: deletions from the beginning, and what is retained next
    chosen = np.full((len(codes), 4), DROP, np.int8)
    by_length = np.argsort(begins - ends, kind="stable")  # longest first
    lengths = (ends - begins)[by_length]
    for back in range(1, int(lengths.max(initial=0)) + 1):
        piece = by_length[: int(np.searchsorted(-lengths, -back, side="right"))]
        row = ends[piece] - back
        may = (fault[row] != 1) & (fault[row] != 2)
        piece, row = piece[may], row[may]
        of = initial[row]
        rest = best[piece] - upto[row + 1][:, None]  # the cost of what follows the row, by the state after it
        own = COST[of] + np.take_along_axis(rest[:, None, :].repeat(4, 1), AFTER[of], 2)
        extra = TRUNCATED * (fault[row] == 3) + DELETE * (times[row] - 1)
        edit = own.argmin(2)  # the first of equal ones
        cost = np.take_along_axis(own, edit[:, :, None], 2)[:, :, 0] + (extra + upto[row])[:, None]
        better = cost < best[piece]
        chosen[row] = np.where(better, edit, DROP)
        best[piece] = np.where(better, cost, best[piece])
    return best - upto[begins][:, None], chosen


def followed(codes: np.ndarray, ends: np.ndarray, chosen: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edits taken by each piece from its state before, one for each row, the state after each row, and that after the piece."""
    begins = np.concatenate([[0], ends[:-1]])
    taken, states, state = np.full(len(codes), DROP, np.int8), np.zeros(len(codes), np.int8), state.copy()
    by_length = np.argsort(begins - ends, kind="stable")
    lengths = (ends - begins)[by_length]
    for step in range(int(lengths.max(initial=0))):
        piece = by_length[: int(np.searchsorted(-lengths, -step, side="left"))]
        row = begins[piece] + step
        edit = chosen[row, state[piece]]
        taken[row] = edit
        kept = edit != DROP
        state[piece[kept]] = AFTER[codes[row[kept]] % 5, state[piece[kept]], edit[kept]]
        states[row] = state[piece]
    return taken, states, state


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes and times of all rows of a batch of pieces, and where each piece ends."""
    rows = batch.column("rows")
    values = rows.flatten()
    ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return values.field("code").to_numpy().astype(np.int64), values.field("times").to_numpy(), ends


def audits(taken: np.ndarray, times: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The edits' initials of each piece as a string."""
    spelling = np.array([len(e) for e in EDITS] + [0])
    size = spelling[taken] + times - (taken != DROP)
    stop = np.cumsum(size)
    letters = np.full(int(stop[-1]) if len(stop) else 0, ord("D"), np.uint8)
    for i, edit in enumerate(EDITS):
        at = (stop - size)[taken == i]
        for j, letter in enumerate(edit):
            letters[at + j] = ord(letter)
    offsets = np.concatenate([[0], stop])[np.concatenate([[0], ends])]
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string())


def illegal(codes: np.ndarray, times: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Neighbours within each piece whose initials may not follow each other."""
    initial, inner = codes % 5, np.ones(len(codes), bool)
    inner[np.concatenate([[0], ends[:-1]])] = False
    before = np.concatenate([[OTHER], initial[:-1]])
    bad = inner & ~LEGAL[before, initial]
    return np.add.reduceat(bad + times - 1, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, np.int64)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of rows as they come after damage by the crc32 of conv_id and turn."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("role", "text")), (F.crc32(named.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"))


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times (equal rows), code, part and place of all rows; place is their order."""
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    rows = small_batches(rows).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), times.alias("times"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = rows.withColumn("one", F.xxhash64("role", "text")).withColumn("two", F.xxhash64(F.lit(13), "text", "role"))
    rows = rows.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    seen = rows.groupBy("conv_id", "one", "two").agg(F.min("at").alias("at"))
    # rows meet the first of their kind by their turn, too: what is said in every turn is spread
    first = same(F.col("r.conv_id"), F.col("f.conv_id")) & (F.col("r.one") == F.col("f.one")) & (F.col("r.two") == F.col("f.two")) & (F.col("r.at") == F.col("f.at"))
    rows = rows.alias("r").join(seen.alias("f"), first, "left").select("r.*", F.col("f.one").isNull().alias("again"))
    at = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (at == 0), OTHER).otherwise(at)
    blank, whole = ~F.col("text").rlike(f"[^{BLANKS}]"), F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")
    fault = F.when(blank, 1).when(F.col("again"), 2).when(~whole, 3).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "text", "times", (initial + 5 * fault).cast("int").alias("code"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, F.col("text"))
    return cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))


def pieces(rows: DataFrame) -> DataFrame:
    """conv_id, part and rows (place, code, times, in order) of every piece: at most the rows of one range."""
    return rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "code", "times"))).alias("rows"))


def with_follows(parts: DataFrame) -> DataFrame:
    """parts with follows, the least cost of all that comes after a piece, by the state in which it is left, and split: whether its conversation has other pieces."""

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, ends = flat(batch)
            matrix = np.empty((len(ends), 4, 4), np.int64)
            for left in range(4):
                only = np.full((len(ends), 4), FAR)
                only[:, left] = 0
                matrix[:, :, left] = searched(codes, times, ends, only)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * 16), pa.array(np.minimum(matrix, FAR).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), lists], ["conv_id", "part", "costs"])

    def before(p: Column, after: Column) -> Column:
        return F.array(*(F.array_min(F.zip_with(F.slice(p.costs, 4 * i + 1, 4), after, lambda a, b: a + b)) for i in range(4)))

    def step(so_far: Column, p: Column) -> Column:
        own = F.array(F.struct(p.part.alias("part"), so_far.after.alias("follows")))
        return F.struct(before(p, so_far.after).alias("after"), F.concat(so_far.out, own).alias("out"))

    end = F.array(*(F.lit(int(x)).cast("long") for x in ENDS))
    several = parts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("several"))
    known = parts.join(several, same(F.col("conv_id"), F.col("several"))).drop("several").mapInArrow(costs, "conv_id long, part int, costs array<long>")
    # one entry for each range that a conversation reaches into, put together from the last to the first
    last_first = known.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("part", "costs")))).alias("of"))
    start = F.struct(end.alias("after"), F.expr("cast(array() as array<struct<part: int, follows: array<bigint>>>)").alias("out"))
    told = last_first.select(F.col("conv_id").alias("of_conv"), F.explode(F.aggregate("of", start, step).out).alias("p")).select("of_conv", F.col("p.part").alias("of_part"), F.col("p.follows").alias("told"))
    here = same(F.col("conv_id"), F.col("of_conv")) & (F.col("part") == F.col("of_part"))
    return parts.join(told, here, "left").select("conv_id", "part", "rows", F.coalesce("told", end).alias("follows"), F.col("of_part").isNotNull().alias("split"))


PIECE = "conv_id long, part int, split boolean, entry int, cost long, audit string, edits array<struct<place: long, edit: int, state: int>>, exit int, first int, last int, illegal long"


def decided(rows: DataFrame) -> DataFrame:
    """PIECE of every piece: entry and exit are the states before and after it, cost is that of its conversation from there on, edits those of its retained rows."""
    parts, names = with_follows(pieces(rows)), [f.name for f in StructType.fromDDL(PIECE)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, times, ends = flat(batch)
            if not len(ends):
                continue
            begins = np.concatenate([[0], ends[:-1]])
            cost, chosen = searched(codes, times, ends, batch.column("follows").flatten().to_numpy().reshape(-1, 4))
            place, bad = batch.column("rows").flatten().field("place"), illegal(codes, times, ends)
            for entry in range(4):
                taken, state, after = followed(codes, ends, chosen, np.full(len(ends), entry))
                kept = np.flatnonzero(taken != DROP)
                offsets = np.searchsorted(kept, np.concatenate([[0], ends])).astype(np.int32)
                retained = pa.StructArray.from_arrays([place.take(pa.array(kept)), pa.array(taken[kept].astype(np.int32)), pa.array(state[kept].astype(np.int32))], ["place", "edit", "state"])
                columns = [batch.column("conv_id"), batch.column("part"), batch.column("split"), np.full(len(ends), entry, np.int32), cost[:, entry], audits(taken, times, ends), pa.ListArray.from_arrays(pa.array(offsets), retained), *(x.astype(np.int32) for x in (after, codes[begins] % 5, codes[ends - 1] % 5)), bad]
                out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
                yield out if entry == NONE else out.filter(batch.column("split"))

    tried = cut(parts.mapInArrow(search, PIECE))
    # the way through a conversation's pieces, from its first: one entry for each range that it reaches into
    split = tried.where("split").groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("entry", "exit"))).alias("exits"))
    in_order = split.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "exits"))).alias("of"))

    def step(so_far: Column, p: Column) -> Column:
        own = F.array(F.struct(p.part.alias("part"), so_far.state.alias("entry")))
        return F.struct(F.get(p.exits, so_far.state)["exit"].alias("state"), F.concat(so_far.out, own).alias("out"))

    start = F.struct(F.lit(NONE).alias("state"), F.expr("cast(array() as array<struct<part: int, entry: int>>)").alias("out"))
    way = in_order.select(F.col("conv_id").alias("of_conv"), F.explode(F.aggregate("of", start, step).out).alias("p")).select("of_conv", F.col("p.part").alias("of_part"), F.col("p.entry").alias("of_entry"))
    here = same(F.col("conv_id"), F.col("of_conv")) & (F.col("part") == F.col("of_part")) & (F.col("entry") == F.col("of_entry"))
    return tried.where("not split").unionByName(tried.where("split").join(way, here).select(*tried.columns))


def audited(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation, from ordered() rows and their decided() pieces."""
    fault, times = F.floor(F.col("code") / 5), F.col("times")
    faults = {"blank": F.when(fault == 1, times), "duplicate": F.when(fault == 2, times).when(fault != 1, times - 1), "truncated": F.when(fault == 3, 1)}
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(k) for k, c in faults.items()))
    # as many entries as ranges; of audits just what is returned
    whole = chosen.groupBy(F.col("conv_id").alias("of_conv")).agg(F.array_sort(F.collect_list(F.struct("part", "cost", "audit", "exit", "first", "last", "illegal"))).alias("of"))
    legal = F.array(*(F.array(*map(F.lit, row)) for row in LEGAL.tolist()))
    seams = F.zip_with(F.slice("of", F.lit(1), F.size("of") - 1), F.slice("of", F.lit(2), F.size("of") - 1), lambda a, b: F.when(F.get(F.get(legal, a["last"]), b["first"]), 0).otherwise(1))
    bad = F.aggregate(F.transform("of", lambda p: p.illegal), F.lit(0).cast("long"), lambda a, x: a + x) + F.aggregate(seams, F.lit(0), lambda a, x: a + x)
    ending = F.get(F.array(*(F.lit("I" * int(x // INSERT)) for x in ENDS)), F.element_at("of", -1)["exit"])
    whole = whole.select("of_conv", bad.alias("illegal"), F.get("of", F.lit(0)).cost.alias("cost"), F.concat(F.array_join(F.transform("of", lambda p: p.audit), ""), ending).alias("audit"))
    return counted.join(whole, same(F.col("conv_id"), F.col("of_conv"))).drop("of_conv")


def repaired(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, place, nth (both give the order), role and text of every row of the repaired conversations."""
    names, empty = F.array(F.lit(""), F.lit(""), F.lit("user"), F.lit("assistant")), F.lit("")
    row = lambda nth, role, text: F.struct(F.lit(nth).alias("nth"), role.alias("role"), text.alias("text"))
    edits = chosen.select(F.explode("edits").alias("e")).select(F.col("e.place").alias("of_place"), "e.edit", "e.state")
    own = F.when(F.col("edit").isin(EDITS.index("IR"), EDITS.index("R")), F.get(names, F.col("state"))).otherwise(F.col("role"))
    inserted = F.col("edit").isin(EDITS.index("IK"), EDITS.index("IR"))
    out = F.when(inserted, F.array(row(0, F.get(names, U + A - F.col("state")), empty), row(1, own, F.col("text")))).otherwise(F.array(row(1, own, F.col("text"))))
    kept = rows.join(edits, F.col("place") == F.col("of_place")).select("conv_id", "place", F.explode(out).alias("r"))
    # what is missing at the end comes after all places of the conversation
    left = chosen.groupBy("conv_id").agg(F.max_by("exit", "part").alias("exit"), F.max(F.get("edits", F.size("edits") - 1).place).alias("place"))
    more = F.when(F.col("exit") == S, F.array(row(2, F.lit("user"), empty), row(3, F.lit("assistant"), empty))).otherwise(F.array(row(2, F.lit("assistant"), empty)))
    ends = left.where(F.col("exit").isin(S, U)).select("conv_id", "place", F.explode(more).alias("r"))
    return kept.unionByName(ends).select("conv_id", "place", "r.*")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired() rows, role:text joined by newlines.

    A hash is one chain, so a conversation's rows are read in order by one task, which holds one batch of them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain, out = None, None, ([], [])
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if chain is None or conv_id != current:
                    if chain is not None:
                        out[0].append(current)
                        out[1].append(chain.hexdigest())
                    current, chain = conv_id, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["conv_id", "repaired_sha256"])
                out = ([], [])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([chain.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    by_conversation = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth").select("conv_id", "role", "text")
    return small_batches(by_conversation).mapInArrow(work, "conv_id long, repaired_sha256 string")


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation in rows (conv_id, turn, role, text, and times if rows come more than once)."""
    rows = ordered(rows)
    chosen = cut(decided(rows))
    hashes = digests(repaired(rows, chosen)).withColumnRenamed("conv_id", "of_conv")
    joined = audited(rows, chosen).join(hashes, same(F.col("conv_id"), F.col("of_conv")), "left").drop("of_conv")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
