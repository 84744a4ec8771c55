"""Edits of ordered lists, as expressions over array columns. Rows count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_yet_in(new: Column, current: Column) -> Column:
    """New entries that the list lacks; repeats among them stay."""
    return F.filter(new, lambda x: ~F.array_contains(current, x))


def insert_at(current: Column, new: Column, row: Column) -> Column:
    """The list with new entries before that row; a row outside it means the end."""
    n = F.size(current)
    at = F.when((row >= 0) & (row <= n), row).otherwise(n)
    return F.concat(F.slice(current, F.lit(1), at), new, F.slice(current, at + 1, n))


def add_entries(current: Column, new: Column, row: Column) -> Column:
    return insert_at(current, not_yet_in(new, current), row)


def without_rows(current: Column, rows: Column) -> Column:
    return F.filter(current, lambda x, i: ~F.array_contains(rows, i))


def without(current: Column, entry: Column) -> Column:
    """The list without any occurrence of an entry."""
    return F.filter(current, lambda x: ~x.eqNullSafe(entry))


def swapped(current: Column, rows: Column, step: int) -> Column:
    """The list with its one selected row moved by step (-1 or 1); unchanged for other selections and beyond the ends."""
    at = F.get(rows, 0)
    to = at + step
    legal = (F.size(rows) == 1) & (to >= 0) & (to < F.size(current)) & (at >= 0) & (at < F.size(current))
    return F.when(legal, F.transform(current, lambda x, i: F.when(i == at, F.get(current, to)).when(i == to, F.get(current, at)).otherwise(x))).otherwise(current)


def used_recently(current: Column, entry: Column, most: int = 10) -> Column:
    """The list with an entry at its front, at most so long."""
    return F.slice(F.array_prepend(F.array_remove(current, entry), entry), 1, most)


def all_used_recently(current: Column, entries: Column, most: int = 10) -> Column:
    """The list after each of the entries was used in turn."""
    latest = F.array_distinct(F.reverse(entries))
    return F.slice(F.concat(latest, F.filter(current, lambda x: ~F.array_contains(latest, x))), 1, most)


def selection(rows: Column) -> Column:
    """Selected rows in order, each once."""
    return F.array_sort(F.array_distinct(rows))


def given(options: Column, names: list[str] | None = None) -> Column:
    """The entries of a map that have a value, and of those the ones with known names."""
    return F.map_filter(options, lambda k, v: v.isNotNull() & (F.lit(True) if names is None else k.isin(*names)))
