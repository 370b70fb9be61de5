"""Operations on stored arrays; every one gives a new array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer than any array.
_ALL = 1 << 30


def push(arr: Column, *items: Column) -> Column:
    return F.concat(arr, F.array(*items))


def unshift(arr: Column, *items: Column) -> Column:
    return F.concat(F.array(*items), arr)


def pop(arr: Column) -> Column:
    """Without the last element; an empty array stays."""
    return F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0)))


def shift(arr: Column) -> Column:
    return F.slice(arr, 2, _ALL)


def splice(arr: Column, index: int, remove: int, *items: Column) -> Column:
    """Without `remove` elements from index (from the end if negative, clamped), with items there."""
    n = F.size(arr)
    at = F.least(F.lit(index), n) if index >= 0 else F.greatest(n + index, F.lit(0))
    head, tail = F.slice(arr, F.lit(1), at), F.slice(arr, at + 1 + max(remove, 0), F.lit(_ALL))
    return F.concat(head, F.array(*items), tail) if items else F.concat(head, tail)


def sort(arr: Column, by: str = "value", descending: bool = False) -> Column:
    """By value, or by: "string" compares elements as text."""
    out = F.array_sort(arr) if by == "value" else F.transform(F.array_sort(F.transform(arr, lambda x: F.struct(x.cast("string").alias("k"), x.alias("x")))), lambda s: s["x"])
    return F.reverse(out) if descending else out


def reverse(arr: Column) -> Column:
    return F.reverse(arr)


def shuffle(arr: Column, seed: int) -> Column:
    return F.shuffle(arr, F.lit(seed))


def insert(arr: Column, index: int, item: Column) -> Column:
    return splice(arr, index, 0, item)
