"""Greedy packing of sized items into groups, natively and in plain Python.

A group ends before the item that would take it over the limit. With an overlap, the next
group starts at the earliest item of the last from which the sizes fit the overlap. Sizes
of joiners do not count and an overlap is not checked again, so a group can reach the limit
plus the overlap.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranges(sizes: Sequence[int], limit: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """(start, stop) of the groups, from prefix sums of the sizes."""
    upto = [0, *accumulate(sizes)]
    start = 0
    for k in range(len(sizes)):
        if k > start and upto[k + 1] - upto[start] > limit:
            yield start, k
            start = min(k, max(start, bisect_left(upto, upto[k] - overlap)))
            # items of size zero at the boundary belong to the overlap as well
    if start < len(sizes):
        yield start, len(sizes)


def group_numbers(sizes: Column, limit: int) -> Column:
    """The group of each item, without overlap: the fold's array grows by groups, not by items."""
    state = F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("open"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, size: Column) -> Column:
        opens = s.open.isNull() | (s.open + size > limit)
        total = F.when(opens, size.cast("long")).otherwise(s.open + size)
        return F.struct((s.k + 1).alias("k"), total.alias("open"), F.when(opens, F.array_append(s.starts, s.k)).otherwise(s.starts).alias("starts"))

    def numbered(s: Column) -> Column:
        return F.flatten(F.transform(s.starts, lambda at, n: F.array_repeat(n, F.coalesce(F.get(s.starts, n + 1), s.k) - at)))

    return F.aggregate(sizes, state, step, numbered)


def group_sums(sizes: Column, limit: int) -> Column:
    """The sum of each group, without overlap: the fold's array grows by groups, not by items."""
    state = F.struct(F.lit(None).cast("long").alias("open"), F.array().cast("array<bigint>").alias("closed"))

    def step(s: Column, size: Column) -> Column:
        over = s.open + size > limit  # null, so not over, while no group is open
        total = F.when(over, size.cast("long")).otherwise(F.coalesce(s.open, F.lit(0)) + size)
        return F.struct(total.alias("open"), F.when(over, F.array_append(s.closed, s.open)).otherwise(s.closed).alias("closed"))

    return F.aggregate(sizes, state, step, lambda s: F.when(s.open.isNull(), s.closed).otherwise(F.array_append(s.closed, s.open)))
