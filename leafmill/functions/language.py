"""Language maps. The stored form is an ordered array of (lang, text), because 'any language' means the first one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip

#: Preference of languages, and the languages offered for editing.
PRIORITY = ("en", "en-US", "en-GB", "de", "de-DE")
SUPPORTED = ("en", "de", "fr", "es", "it", "zh", "ja", "ko", "pt")
TYPE = "array<struct<lang:string,text:string>>"


def pick(entries: Column | str, priority: Sequence[str] = PRIORITY) -> Column:
    """The text of the first language of ``priority`` that has a non-empty text, else of the first entry that has one."""
    full = F.filter(col(entries), lambda e: e["text"] != "")

    def of(lang: str) -> Column:
        return F.get(F.filter(full, lambda e: e["lang"] == lang), 0)["text"]

    return F.coalesce(*map(of, priority), F.get(full, 0)["text"])


def without_blank(entries: Column | str) -> Column:
    """Entries whose text has more than white space."""
    return F.filter(col(entries), lambda e: e["text"].isNotNull() & (strip(e["text"]) != ""))


def replaced(old: Column | str, new: Column | str) -> Column:
    """The new map without blank entries, as a whole; the old one where nothing is left of it."""
    left = without_blank(new)
    return F.when(F.coalesce(F.size(left), F.lit(0)) > 0, left).otherwise(col(old))


def any_text(entries: Column | str) -> Column:
    """Whether any entry has a text at all; one of white space counts here."""
    return F.coalesce(F.exists(col(entries), lambda e: F.coalesce(e["text"] != "", F.lit(False))), F.lit(False))


def filled(entries: Column | str, languages: Sequence[str] = SUPPORTED) -> Column:
    """How many of the offered languages have more than white space."""
    return F.size(F.array_distinct(F.transform(F.filter(without_blank(entries), lambda e: e["lang"].isin(*languages)), lambda e: e["lang"])))
