"""The XML Schema datatypes: input type, step and bounds by name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col

# The datatypes, and for each its input type.
TEXT = "string normalizedString token language Name NCName ID IDREF ENTITY NMTOKEN gMonthDay duration yearMonthDuration dayTimeDuration hexBinary QName NOTATION".split()
INTEGERS = "integer int long short byte nonPositiveInteger negativeInteger nonNegativeInteger positiveInteger unsignedInt unsignedLong unsignedShort unsignedByte".split()
FRACTIONS = "decimal float double".split()
OTHER = {"boolean": "checkbox", "date": "date", "time": "time", "dateTime": "datetime-local", "gYear": "number", "gMonth": "number", "gDay": "number", "gYearMonth": "month", "anyURI": "url", "base64Binary": "file"}
# Bounds of the bounded types.
BOUNDS = {
    "byte": (-128, 127),
    "unsignedByte": (0, 255),
    "short": (-32768, 32767),
    "unsignedShort": (0, 65535),
    "int": (-2147483648, 2147483647),
    "unsignedInt": (0, 4294967295),
    "positiveInteger": (1, None),
    "nonNegativeInteger": (0, None),
    "negativeInteger": (None, -1),
    "nonPositiveInteger": (None, 0),
}

INPUT = {**dict.fromkeys(TEXT, "text"), **dict.fromkeys(INTEGERS + FRACTIONS, "number"), **OTHER}
STEP = {**dict.fromkeys(INTEGERS, "1"), **dict.fromkeys(FRACTIONS, "any")}
SCHEMA = "xsd string, input_type string, step string, min decimal(20,0), max decimal(20,0)"


def rows() -> list[tuple]:
    from decimal import Decimal

    d = lambda x: None if x is None else Decimal(x)
    return [(f"xs:{k}", v, STEP.get(k), *map(d, BOUNDS.get(k, (None, None)))) for k, v in INPUT.items()]


def types(spark: SparkSession) -> DataFrame:
    """The dimension table: one row a datatype (43)."""
    return spark.createDataFrame(rows(), SCHEMA)


def name(value_type: Column | str) -> Column:
    """``xsd:int`` and `` xs:int `` are ``xs:int``."""
    return F.regexp_replace(F.trim(col(value_type)), "^xsd:", "xs:")


def _lookup(table: dict, value_type: Column | str, kind: str) -> Column:
    pairs = chain.from_iterable((F.lit(f"xs:{k}"), F.lit(v).cast(kind)) for k, v in table.items())
    return F.try_element_at(F.create_map(*pairs), name(value_type))


def input_type(value_type: Column | str) -> Column:
    return F.coalesce(_lookup(INPUT, value_type, "string"), F.lit("text"))


def step(value_type: Column | str) -> Column:
    return _lookup(STEP, value_type, "string")


def lower_bound(value_type: Column | str) -> Column:
    return _lookup({k: v[0] for k, v in BOUNDS.items() if v[0] is not None}, value_type, "decimal(20,0)")


def upper_bound(value_type: Column | str) -> Column:
    return _lookup({k: v[1] for k, v in BOUNDS.items() if v[1] is not None}, value_type, "decimal(20,0)")


def input_attributes(value_type: Column | str) -> Column:
    """Step and bounds for number inputs; nulls for others."""
    number = input_type(value_type) == "number"
    fields = {"step": step, "min": lower_bound, "max": upper_bound}
    return F.struct(*(F.when(number, f(value_type)).alias(k) for k, f in fields.items()))


def enrich(df: DataFrame, value_type: str = "value_type") -> DataFrame:
    """Adds input_type, step, min, max by a join with the 43-row dimension, which is always broadcast."""
    dim = F.broadcast(types(df.sparkSession).withColumnRenamed("xsd", "__xsd"))
    out = df.join(dim, name(value_type) == F.col("__xsd"), "left").drop("__xsd")
    return out.withColumn("input_type", F.coalesce("input_type", F.lit("text")))
