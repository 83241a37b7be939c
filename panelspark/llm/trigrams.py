"""Boolean trigram queries of regular expressions.

A query is a set of alternatives, each a set of lower-case trigrams; a text that the expression matches holds all trigrams
of one alternative at least. An alternative without trigrams stands for every text: then the expression has none that are
mandatory. Letters outside ASCII, negated and large classes, and repeats without an upper bound end a run of letters.
"""

from __future__ import annotations

import re

#: Strings that a run of letters may spell, letters of a class that are told apart, and alternatives of a query.
SPELLINGS, LETTERS, ALTERNATIVES = 64, 6, 64
EVERYTHING = frozenset([frozenset()])

Query = frozenset  # of frozensets of trigrams


def either(a: Query, b: Query) -> Query:
    """Alternatives of both, without those that ask for more than another does."""
    union = a | b
    return frozenset(x for x in union if not any(y < x for y in union))


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES:
        return min(a, b, key=len)  # the weaker query still holds
    out: Query = frozenset()
    for x in a:
        for y in b:
            out = either(out, frozenset([x | y]))
    return out


def spelled(strings: set[str]) -> Query:
    """That one of the strings occurs."""
    out: Query = frozenset()
    for s in strings:
        out = either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def of_class(items: list) -> set[str] | None:
    """The letters of a class, if they are few."""
    letters: set[str] = set()
    for kind, value in items:
        name = str(kind)
        low, high = (value, value) if name == "LITERAL" else value if name == "RANGE" else (0, 1 << 20)
        if high > 127 or high - low > 2 * LETTERS:
            return None
        letters |= {chr(c).lower() for c in range(low, high + 1)}
    return letters if len(letters) <= LETTERS else None


def of_item(kind: str, value) -> tuple[set[str] | None, Query]:
    """All strings that an item spells (None: they are many) and its query."""
    if kind == "LITERAL":
        return ({chr(value).lower()} if value < 128 else None), EVERYTHING
    if kind == "IN":
        return of_class(value), EVERYTHING
    if kind in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, EVERYTHING
    if kind == "SUBPATTERN":
        return of_sequence(value[-1])
    if kind == "BRANCH":
        strings: set[str] | None = set()
        query: Query = frozenset()
        for each in value[1]:
            own, asked = of_sequence(each)
            strings = None if strings is None or own is None else strings | own
            query = either(query, asked)
        return (strings if strings is not None and len(strings) <= SPELLINGS else None), query
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        own, asked = of_sequence(inner)
        if least == 0:
            return (own | {""} if own is not None and most == 1 else None), EVERYTHING
        return (own if least == most == 1 else None), asked
    return None, EVERYTHING


def of_sequence(items) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, EVERYTHING, True
    for kind, value in items:
        own, asked = of_item(str(kind), value)
        if own is not None and len(run) * len(own) <= SPELLINGS:
            run = {a + b for a in run for b in own}
            continue
        query, run, whole = both(query, spelled(run)), own if own is not None else {""}, False
        query = both(query, asked)
    return (run if whole else None), both(query, spelled(run))


def query_of(pattern: str) -> Query:
    """The trigram query of a regular expression, EVERYTHING if no trigram is mandatory."""
    return of_sequence(re._parser.parse(pattern))[1]
