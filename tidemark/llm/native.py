"""Column helpers for operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body).getItem(0)


def lets(values: list[Column], body: Callable[..., Column]) -> Column:
    if not values:
        return body()
    return let(values[0], lambda v: lets(values[1:], lambda *rest: body(v, *rest)))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(steps: Column, width: int = 64) -> Column:
    """For an array of longs, the sum before each element. Blocks of `width`, so long arrays don't cost their square."""

    def within(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / width).cast("int"))
        block_sums = F.transform(blocks, lambda b: total(F.slice(s, b * width + 1, width)))
        before = F.aggregate(block_sums, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(before, lambda p: F.transform(s, lambda _, i: F.get(p, F.floor(i / width).cast("int")) + total(F.slice(s, (F.floor(i / width) * width).cast("int") + 1, i % width))))

    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(steps, within))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")
