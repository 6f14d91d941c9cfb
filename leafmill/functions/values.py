"""Typed coercion and conformance of raw values.

Types are found by substrings of the lower-cased type name, in a fixed order, so ``long``, ``short`` and ``byte``
are text; ``strict=True`` treats them as integers within their bounds instead. Number grammar: outer
white space, underscores between digits, ``nan`` and ``inf`` are allowed; a type suffix is not.

A column has one type, so coercion gives a struct: the typed value in its field, ``text`` where nothing fits (a
bad value is kept as text, never lost), and ``ok``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import xsd
from .text import col, strip

NUMBER = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?$"
SPECIAL = r"(?i)^[+-]?(?:nan|inf|infinity)$"
DATE = r"^(\d{4})-?(\d{2})-?(\d{2})$"
WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
CLOCK = r"^(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?$"
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def number(raw: Column | str) -> Column:
    """The double that the text denotes, or null."""
    x = strip(raw)
    sign = F.when(F.startswith(x, F.lit("-")), -1.0).otherwise(1.0)
    special = F.when(F.lower(x).rlike("nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(x.rlike(NUMBER), F.replace(x, F.lit("_"), F.lit("")).try_cast("double")).when(x.rlike(SPECIAL), special)


def date(raw: Column | str) -> Column:
    """ISO calendar dates with or without hyphens (both or none), and ISO weeks; or null."""
    x = col(raw)
    plain = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd")).when(x.rlike(r"^\d{8}$"), F.try_to_date(x, "yyyyMMdd"))
    week = x.rlike(r"^\d{4}-W\d{2}(?:-[1-7])?$|^\d{4}W\d{2}[1-7]?$")
    year, number_, day = (F.regexp_extract(x, WEEK, i) for i in (1, 2, 3))
    # The Monday of week 1 is that of the week with January 4th.
    fourth = F.try_to_date(F.concat(year, F.lit("-01-04")), "yyyy-MM-dd")
    first = F.date_trunc("week", fourth).cast("date")
    weeks = number_.try_cast("int")
    at = F.date_add(first, (weeks - 1) * 7 + F.coalesce(day.try_cast("int"), F.lit(1)) - 1)
    known = (weeks >= 1) & (F.year(F.date_add(first, (weeks - 1) * 7 + 3)) == year.try_cast("int"))
    return F.coalesce(plain, F.when(week & known, at))


def time_ok(raw: Column | str) -> Column:
    return F.regexp_replace(col(raw), "^T", "").rlike(CLOCK)


def timestamp(raw: Column | str) -> Column:
    """ISO date, or date and time; a zone is converted to the session's. Null if it is neither."""
    x = col(raw)
    day = F.regexp_extract(x, r"^(\d{4}-?W\d{2}(?:-?[1-7])?|\d{4}-?\d{2}-?\d{2})", 1)
    rest = F.substring(x, F.char_length(day) + F.lit(2), F.char_length(x))
    clock = F.regexp_replace(F.replace(rest, F.lit(","), F.lit(".")), r"^(\d{2}):?(\d{2})?:?(\d{2})?", "$1:$2:$3")
    clock = F.regexp_replace(F.regexp_replace(clock, r"^(\d{2})::", "$1:00:00"), r"^(\d{2}:\d{2}):(?!\d)", "$1:00")
    whole = F.concat(F.date_format(date(day), "yyyy-MM-dd"), F.lit(" "), clock)
    return F.when(x == day, date(day).cast("timestamp")).when(rest.rlike(CLOCK), whole.try_cast("timestamp"))


def _kind(value_type: Column | str, strict: bool) -> Column:
    t = F.coalesce(F.lower(col(value_type)), F.lit("xs:string"))
    out = F.when(F.contains(t, F.lit("int")), "int")
    if strict:
        out = out.when(t.rlike(r"(?:long|short|byte)$"), "int").when(t.rlike("duration$"), "text")
    out = out.when(t.rlike("float|double|decimal"), "float").when(F.contains(t, F.lit("bool")), "bool")
    return out.when(F.contains(t, F.lit("datetime")), "datetime").when(F.contains(t, F.lit("date")), "date").when(F.contains(t, F.lit("time")), "time").otherwise("text")


def _as_text(raw: Column, json_type: Column | None) -> Column:
    """A JSON boolean counts as 1 or 0 for number types."""
    if json_type is None:
        return raw
    return F.when(json_type == "BOOLEAN", F.when(F.lower(raw) == "true", "1").otherwise("0")).otherwise(raw)


def _once(value: Column, use) -> Column:
    """``use(value)``, the value computed once: where it is pasted in several places, plans and their code grow with each."""
    return F.get(F.transform(F.array(value), use), 0)


def conforms(raw: Column | str, value_type: Column | str, json_type: Column | None = None, strict: bool = False) -> Column:
    """Whether a value, which is neither null nor empty, is of its type. Unknown, time and text types take all."""
    x, kind = col(raw), _kind(value_type, strict)

    def number_fits(s: Column) -> Column:
        n = s["n"]
        finite = ~F.isnan(n) & (F.abs(n) != float("inf"))
        whole = finite & (F.floor(F.when(finite & (F.abs(n) < 9e15), n)).cast("double") == n) | (finite & (F.abs(n) >= 9e15))
        if strict:
            exact = n.try_cast("decimal(30,0)")
            whole = whole & F.coalesce(exact >= s["low"], F.lit(True)) & F.coalesce(exact <= s["high"], F.lit(True))
        return F.when(s["kind"] == "int", whole).otherwise(n.isNotNull())

    bounds = {"low": xsd.lower_bound(value_type), "high": xsd.upper_bound(value_type)} if strict else {}
    parsed = F.struct(number(_as_text(x, json_type)).alias("n"), kind.alias("kind"), *(v.alias(k) for k, v in bounds.items()))
    out = F.when(kind.isin("int", "float"), _once(parsed, number_fits)).when(kind == "bool", F.lower(x).isin(*TRUE, *FALSE))
    out = out.when(kind == "datetime", timestamp(x).isNotNull()).when(kind == "date", date(x).isNotNull()).otherwise(F.lit(True))
    return F.when(col(value_type).isNull(), F.lit(True)).otherwise(F.coalesce(out, F.lit(False)))


def coerce(raw: Column | str, value_type: Column | str, json_type: Column | None = None, strict: bool = False) -> Column:
    """struct(kind, long, double, bool, date, timestamp, text, ok). Null and '' are null. ``int`` goes through double
    and truncates; a value that does not fit is kept in ``text`` with ok = false only for infinities of ``int``."""
    x, kind = F.nullif(col(raw), F.lit("")), _kind(value_type, strict)

    def made(s: Column) -> Column:
        n, kind, x = s["n"], s["kind"], s["x"]
        inf = F.abs(n) == float("inf")
        as_long = F.when((kind == "int") & ~F.isnan(n) & ~inf, n.try_cast("long"))
        as_double = F.when(kind == "float", n)
        as_bool = F.when((kind == "bool") & x.isNotNull(), F.lower(x).isin(*TRUE))
        none = as_long.isNull() & as_double.isNull() & as_bool.isNull() & s["timestamp"].isNull() & s["date"].isNull()
        bad = F.coalesce((kind == "int") & inf, F.lit(False))
        fields = {"kind": kind, "long": as_long, "double": as_double, "bool": as_bool, "date": s["date"], "timestamp": s["timestamp"], "text": F.when(none, x), "ok": ~bad}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    parsed = {"x": x, "kind": kind, "n": F.when(kind.isin("int", "float"), number(_as_text(x, json_type))), "timestamp": F.when(kind == "datetime", timestamp(x)), "date": F.when(kind == "date", date(x))}
    return _once(F.struct(*(c.alias(k) for k, c in parsed.items())), made)


def coerced_text(raw: Column | str, value_type: Column | str, json_type: Column | None = None, strict: bool = False) -> Column:
    """The coerced value in canonical text: what is written back to a tree."""

    def text(c: Column) -> Column:
        return F.coalesce(c["long"].cast("string"), c["double"].cast("string"), c["bool"].cast("string"), F.date_format(c["date"], "yyyy-MM-dd"), F.date_format(c["timestamp"], "yyyy-MM-dd'T'HH:mm:ss"), c["text"])

    return _once(coerce(raw, value_type, json_type, strict), text)
