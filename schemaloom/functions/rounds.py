"""Steps on a state within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = 4


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once. An aggregate over nothing doesn't copy what it ends with, as a transform over one element does."""
    return F.aggregate(F.array().cast("array<int>"), x, lambda x, _: x, f)


def rounds(start: Column, going: Callable[[Column], Column], step: Callable[[Column], Column], most: int) -> Column:
    """The state after steps for as long as ``going`` holds, ``most`` at the most.

    An aggregate over an array copies its whole state after each element, also when nothing is left to do. So the steps are
    in runs, each twice as long as the one before, and a state that is done is copied once for each run, not for each step.
    """
    runs = []
    while sum(runs) < most:
        runs.append(min(FIRST << len(runs), most - sum(runs)))
    one = lambda state, _: F.when(going(state), step(state)).otherwise(state)
    run = lambda state, n: F.when(going(state), F.aggregate(F.sequence(F.lit(1), n), state, one)).otherwise(state)
    return F.aggregate(F.array(*map(F.lit, runs)), start, run)
