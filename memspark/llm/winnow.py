"""Winnowing as Spark expressions: rolling k-gram hashes, the least per window, the rightmost of ties.

A pick is one long: the top 36 bits are the gram's hash, the low 28 bits count down with its position,
so the least long of a window is the least hash at its rightmost place. Two texts that share a run of
k + window - 1 units share a pick of the same hash inside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 28
LOW = (1 << BITS) - 1


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def codes(hashes: Column, k: int) -> Column:
    """A long for every k-gram of an array of unit hashes: its hash above, its position (from 0, inverted) below."""

    def grams(h):
        one = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))).bitwiseAND(F.lit(~LOW)).bitwiseOR(F.lit(LOW).cast("long") - i)
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), one)).otherwise(F.array().cast("array<bigint>"))

    return let(hashes, grams)


def picks(grams: Column, window: int) -> Column:
    """The least code of every window; of fewer grams than a window, the least of all. In order, each once."""

    def least(c):
        slide = F.transform(F.sequence(F.lit(0), F.size(c) - window), lambda i: F.least(*(F.get(c, i + j) for j in range(window))))
        short = F.when(F.size(c) > 0, F.array(F.array_min(c))).otherwise(c)
        return F.when(F.size(c) > window, F.array_distinct(slide)).otherwise(short)

    return let(grams, least)


def gram_hash(code: Column) -> Column:
    return F.shiftright(code, BITS)


def position(code: Column) -> Column:
    return (F.lit(LOW).cast("long") - code.bitwiseAND(F.lit(LOW).cast("long"))).cast("int")
