"""Prefix scans of small state machines over ordered rows that spread over many tasks.

A row's transition maps each of four states to the next. It is kept as one number, two bits for each
state, so transitions compose by shifts, and a running composition is a prefix scan: log2(n) rounds
of "mine after the one d rows before", d = 1, 2, 4 ..., all in one sorted window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = 4


def transition(*to: Column) -> Column:
    """The transition that maps state i to the i-th of four states."""
    code = to[0]
    for i, state in enumerate(to[1:], 1):
        code = code + state * (STATES ** i)
    return code.cast("int")


def applied(code: Column, state: Column) -> Column:
    """The state after the transition."""
    return F.call_function("shiftright", code, (state * 2).cast("int")).bitwiseAND(F.lit(3))


def composed(later: Column, earlier: Column) -> Column:
    """First `earlier`, then `later`; null when either is."""
    return transition(*[applied(later, applied(earlier, F.lit(i))) for i in range(STATES)])


def running(rows: DataFrame, keys: Sequence[str], order: str, code: str, longest: int) -> DataFrame:
    """`code` of each row composed with those of all rows before it, within each key.

    `longest` is at least the number of rows of any key; a key's rows meet in one task.
    """
    before = Window.partitionBy(*keys).orderBy(order)
    step = 1
    while step < longest:
        rows = rows.withColumn(code, F.coalesce(
            composed(F.col(code), F.lag(code, step).over(before)), F.col(code)))
        step *= 2
    return rows
