"""Edits of a form's list items (arrays): add, remove and move, within the bounds of the list's cardinality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def added(items: Column, new: Column, most: Column) -> Column:
    """With one more item at the end, unless there are ``most`` (null: no limit)."""
    return F.when(most.isNull() | (F.size(items) < most), F.concat(items, F.array(new))).otherwise(items)


def removed(items: Column, at: Column, least: Column) -> Column:
    """Without the item at a 0-based place, unless only ``least`` are there or the place is none."""
    can = (F.size(items) > least) & (at >= 0) & (at < F.size(items))
    return F.when(can, F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))).otherwise(items)


def moved(items: Column, at: Column, to: Column) -> Column:
    """The item at ``at`` put at ``to``, the others in their order; unchanged where one of the places is none."""
    can = (at >= 0) & (to >= 0) & (at < F.size(items)) & (to < F.size(items))
    rest = F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))
    return F.when(can, F.concat(F.slice(rest, F.lit(1), to), F.array(F.get(items, at)), F.slice(rest, to + 1, F.size(items)))).otherwise(items)
