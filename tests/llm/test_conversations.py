"""Conversation repair against plain search: all edits of short conversations, and a walk with audits in full for longer ones."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def choices(role, text, fault):
    yield "D", 2, None
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        yield "K", more, (role, text)
        yield "R", 1 + more, ("user", text)
        yield "R", 1 + more, ("assistant", text)


def exhaustive(rows):
    """Every choice for every row, and up to two insertions at every place."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for chosen in itertools.product(*(list(choices(*r, f)) for r, f in zip(rows, faults(rows), strict=True))):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            out = [(name, "") for name in gaps[0]]
            audit, cost = "I" * len(gaps[0]), 5 * sum(map(len, gaps))
            for (edit, price, row), gap in zip(chosen, gaps[1:], strict=True):
                audit, cost = audit + edit + "I" * len(gap), cost + price
                out += ([row] if row else []) + [(name, "") for name in gap]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                best = min(best or (cost, audit, out), (cost, audit, out))
    return best


def walked(rows):
    ways = {"n": (0, "", [])}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for state, (cost, audit, out) in ways.items():
            for edit, price, row in choices(role, text, fault):
                if row is None:
                    step = (state, (cost + price, audit + edit, out))
                elif edit == "K" and row[0][:1] == "s":
                    if state != "n":
                        continue
                    step = ("s", (cost + price, audit + edit, [*out, row]))
                elif row[0][:1] in ("u", "a"):
                    wanted = "a" if state == "u" else "u"
                    missing = [] if row[0][:1] == wanted else [(NAMES[wanted], "")]
                    step = (row[0][:1], (cost + price + 5 * len(missing), audit + "I" * len(missing) + edit, [*out, *missing, row]))
                else:
                    continue
                after[step[0]] = min(after.get(step[0], step[1]), step[1])
        ways = after
    more = {"n": [], "s": ["u", "a"], "u": ["a"], "a": []}
    return min((cost + 5 * len(more[s]), audit + "I" * len(more[s]), [*out, *((NAMES[x], "") for x in more[s])]) for s, (cost, audit, out) in ways.items())


def expected(rows, search=walked):
    """What audit() returns of a conversation's rows (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    plain = [r[1:] for r in rows]
    found, initials = faults(plain), [r[:1] for r, _ in plain]
    cost, audit, out = search(plain)
    bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), bad, cost, audit, sha)


def in_order(rows):
    """Rows of conversations, nulls as one blank."""
    of = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in of.items()}


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


ROLES = ["user", "assistant", "system", "tool", "User", "", None, "unknown"]
TEXTS = ["Yes.", "No!", "a", "b ", "Why? \n", "", " \n", None, "end.\x1c"]


def conversation(rng, c, n):
    likely = rng.random() < 0.5
    role = lambda i: ("user", "assistant")[i % 2] if likely and rng.random() < 0.8 else ROLES[int(rng.integers(len(ROLES)))]
    return [(c, None if rng.random() < 0.05 else int(rng.integers(2 * n)), role(i), TEXTS[int(rng.integers(len(TEXTS)))] if rng.random() < 0.5 else f"Text {i}.") for i in range(n)]


def test_search_equals_every_way_of_editing():
    rng = np.random.default_rng(13)
    for n in (0, 1, 2, 3):
        for _ in range(40 if n < 3 else 12):
            rows = [r[1:] for x in in_order(conversation(rng, 0, n)).values() for r in x]
            assert walked(rows) == exhaustive(rows), rows


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_audit_equals_a_plain_walk(spark, ranges):
    """Conversations from no repair to many, one that holds most rows, and one row that comes again and again."""
    rng = np.random.default_rng(ranges)
    rows = [r for c in range(150) for r in conversation(rng, c, int(rng.integers(1, 9)))]
    rows += conversation(rng, 500, 900) + [(501, i // 2, "user", "again and again.") for i in range(200)] + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None)]
    rows += [(502, 1, "user", "long. " * 50000), (502, 2, "assistant", "é🎉" * 40000 + "!"), (503, None, "assistant", "x."), (503, None, "user", "y.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("code", "part", "place", "one", "at", "again", "edits")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(conversations.audit(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {c: expected(x) for c, x in in_order(rows).items()}
    assert {c: (x, want[c]) for c, x in found.items() if x != want.get(c)} == {} and len(found) == len(want)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three? Four") for c in range(60) for t in range(4)] + [(None, 3, None, None), (7, None, "user", "x.")]
    text = lambda x: " " if x is None else str(x)
    want = []
    for c, t, role, body in rows:
        kind = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        if kind:
            body = "" if kind == 1 else re.sub("[.!?]", "", text(body)) if kind == 2 else text(body)
            want.append((c, t, "user" if kind == 4 else text(role), body, 2 if kind == 3 else 1))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, conversations.damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=order) == sorted(want, key=order)


def test_repaired_rows_and_empty_table(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", "What?"), (1, 3, "assistant", "")]
    ordered = conversations.ordered(spark.createDataFrame(rows, SCHEMA))
    chosen = conversations.decided(ordered)
    out = sorted(map(tuple, conversations.repaired(ordered, chosen).select("place", "nth", "role", "text").collect()))
    assert [r[2:] for r in out] == walked([r[2:] for r in rows])[2]
    assert conversations.audit(spark.createDataFrame([], SCHEMA)).count() == 0
