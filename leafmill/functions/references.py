"""References: chains of (type, value) keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

WEB = r"(?i)^https?://."
IRDI = r"^\d{4}-\d#\d{2}-[A-Z]{3}\d{3}#\d{3}\n?$"
TYPE = "array<struct<type:string,value:string>>"


def first_value(keys: Column | str) -> Column:
    """How a reference is shown: its first key's value."""
    return F.get(col(keys), 0)["value"]


def is_valid(value: Column | str, compat: bool = False) -> Column:
    """Web address or IRDI; null and empty are valid. ``compat`` knows web addresses only."""
    x = col(value)
    good = x.rlike(WEB) if compat else x.rlike(WEB) | x.rlike(IRDI)
    return F.when(x.isNull() | (x == ""), F.lit(True)).otherwise(good)


def rebuilt(keys: Column | str, value: Column | str) -> Column:
    """The chain with its last key's value replaced; a single global reference where there is no chain."""
    k = col(keys)
    n = F.size(k)
    last = F.struct(F.get(k, n - 1)["type"].alias("type"), col(value).alias("value"))
    fresh = F.array(F.struct(F.lit("GlobalReference").alias("type"), col(value).alias("value")))
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.concat(F.slice(k, 1, F.greatest(n - 1, F.lit(0))), F.array(last))).otherwise(fresh)


def shown(keys: Column | str) -> Column:
    """All keys as ``(type)value`` joined by commas."""
    return F.array_join(F.transform(col(keys), lambda k: F.concat(F.lit("("), k["type"], F.lit(")"), k["value"])), ", ")
