"""Cardinality notations: named, bare and bracketed, to one form and to bounds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: The named cardinalities, and the qualifier types that carry one.
NAMED = {"ZeroToOne": "[0..1]", "ZeroToMany": "[0..*]", "OneToMany": "[1..*]", "One": "[1]", "Zero": "[0]"}
QUALIFIERS = ("Multiplicity", "cardinality", "Cardinality", "SMT/Cardinality")
BOUNDS = r"^\[(\d+)(?:\.\.(\d+|\*))?\]$"


def normalize(value: Column | str) -> Column:
    """To ``[min..max]`` form where the notation is known; null for null and blank; else unchanged."""
    v = strip(value)
    named = F.create_map(*(F.lit(x) for x in chain.from_iterable(NAMED.items())))
    return (
        F.when(v == "", F.lit(None).cast("string"))
        .when(v.isin(*NAMED), named[v])
        .when(F.startswith(v, F.lit("[")) & F.endswith(v, F.lit("]")), v)
        .when(F.contains(v, F.lit("..")) | v.rlike(r"^\p{Nd}+$"), F.concat(F.lit("["), v, F.lit("]")))
        .otherwise(v)
    )


def bounds(value: Column | str, compat: bool = False) -> Column:
    """(min, max): ``*`` is a null max; anything that is not a cardinality is (1, 1). ``compat`` gives (1, 1) for all."""
    one = F.struct(F.lit(1).alias("min"), F.lit(1).alias("max"))
    if compat:
        return one
    v = normalize(value)
    low, high = F.regexp_extract(v, BOUNDS, 1), F.regexp_extract(v, BOUNDS, 2)
    top = F.when(high == "", low.try_cast("int")).when(high != "*", high.try_cast("int"))
    read = F.struct(low.try_cast("int").alias("min"), top.alias("max"))
    return F.when(F.coalesce(v.rlike(BOUNDS), F.lit(False)), read).otherwise(one)


def client_bounds(value: Column | str) -> Column:
    """(required, many, min, max) as a form's client has them: four notations count, any other is 0 to no limit."""
    v = F.coalesce(normalize(value), F.lit("[1]"))
    need = v.isin("[1]", "[1..*]")
    most = F.when(v.isin("[0..1]", "[1]"), 1)
    return F.struct(need.alias("required"), (F.contains(v, F.lit("*")) | F.contains(v, F.lit(".."))).alias("many"), F.when(need, 1).otherwise(0).alias("min"), most.alias("max"))


def from_qualifiers(qualifiers: Column | str) -> Column:
    """The first qualifier of a cardinality type with a non-blank value, normalised; else ``[1]``."""
    values = F.transform(F.filter(col(qualifiers), lambda q: q["type"].isin(*QUALIFIERS)), lambda q: normalize(q["value"]))
    return F.coalesce(F.get(F.filter(values, lambda v: v.isNotNull()), 0), F.lit("[1]"))
