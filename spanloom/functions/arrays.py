"""Folds over long arrays.

Spark's ``aggregate`` copies its state at every step, so a fold that builds an array takes the square of its
length. Here it builds short arrays block by block, which are copied once a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def blocks(values: Column, size: int = BLOCK) -> Column:
    """The array cut into arrays of ``size``; an empty array gives an empty one."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(size)), lambda _: F.size(values) > 0)
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(size)))


def only(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_out(values: Column, state: Column, out: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The array built by a fold with the state (next, out): ``step`` adds to ``out`` and reads ``next`` only.

    ``state`` is the first ``next``, ``out`` the empty array; an array within one block is folded directly.
    """
    def part(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("next"), out.alias("out")), step)

    def join(acc: Column, block: Column) -> Column:
        return only(part(block, acc["next"]), lambda p: F.struct(p["next"].alias("next"), F.concat(acc["out"], p["out"]).alias("out")))

    whole = F.aggregate(blocks(values), F.struct(state.alias("next"), out.alias("out")), join)
    return F.when(F.size(values) <= BLOCK, part(values, state)["out"]).otherwise(whole["out"])


def running_sum(values: Column) -> Column:
    """``array<int>`` of the sums up to and with each value."""
    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["next"] + n).alias("next"), F.concat(acc["out"], F.array(acc["next"] + n)).alias("out"))

    return fold_out(values, F.lit(0), F.array().cast("array<int>"), step)
