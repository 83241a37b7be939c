"""Universes: sets of (date, id), with union, difference and intersection, and formulas of names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["date", "id"]


class Universe:
    """A lazily composed set of keys."""

    def __init__(self, frame: DataFrame):
        self.frame = frame.select(*KEYS)

    def __add__(self, other: Universe) -> Universe:
        return Universe(self.frame.union(other.frame).distinct())

    def __sub__(self, other: Universe) -> Universe:
        return Universe(self.frame.distinct().join(other.frame, KEYS, "left_anti"))

    def __mul__(self, other: Universe) -> Universe:
        return Universe(self.frame.distinct().join(other.frame, KEYS, "left_semi"))

    def of(self, panel: DataFrame) -> DataFrame:
        """The panel at the set's keys, missing ones as nulls."""
        return self.frame.join(panel, KEYS, "left")


def resolved(panel: DataFrame, ids: str | DataFrame | list, lookup: Callable[[str], Universe] | None = None) -> DataFrame:
    """The panel at a universe: the formula of one, a frame of keys, or a list of ids."""
    if isinstance(ids, str):
        return from_formula(ids, lookup).of(panel)
    if isinstance(ids, DataFrame):
        return Universe(ids).of(panel)
    return panel.where(F.col("id").isin(list(ids)))


def named(members: DataFrame, index: str = "index_id") -> Callable[[str], Universe]:
    return lambda name: Universe(members.where(F.col(index) == name))


def from_formula(formula: str, lookup: Callable[[str], Universe]) -> Universe:
    """Names joined by + - *, with parentheses; * binds more closely, equal ones from the left."""
    tokens = re.findall(r"[()+\-*]|[^()+\-*\s]+", formula)
    place = 0

    def peek() -> str | None:
        return tokens[place] if place < len(tokens) else None

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def single() -> Universe:
        token = peek()
        if token == "(":
            take()
            inside = total()
            if peek() != ")":
                raise ValueError(f"a bracket isn't closed in {formula!r}")
            take()
            return inside
        if token is None or token in ")+-*":
            raise ValueError(f"a name is missing in {formula!r}")
        return lookup(take())

    def product() -> Universe:
        out = single()
        while peek() == "*":
            take()
            out = out * single()
        return out

    def total() -> Universe:
        out = product()
        while peek() in ("+", "-"):
            out = out + product() if take() == "+" else out - product()
        return out

    out = total()
    if peek() is not None:
        raise ValueError(f"{peek()!r} isn't expected in {formula!r}")
    return out
