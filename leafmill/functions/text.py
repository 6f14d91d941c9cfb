"""String functions with the exact white-space, prefix and quoting rules that template data needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trims all Unicode white space, where ``trim`` takes spaces only."""
    return F.regexp_replace(col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def contains_literal(x: Column | str, term: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` are ordinary characters. A null holds nothing."""
    return F.coalesce(F.contains(F.lower(col(x)), F.lit(term.lower())), F.lit(False))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def label(semantic: Column | str, id_short: Column | str) -> Column:
    """What a node is called: its semantic label, unless that is null or empty."""
    return F.coalesce(blank_to_null(semantic), col(id_short))


def template_number(name: Column | str) -> Column:
    """``IDTA 02006-2-0_Submodel_Nameplate`` has the number ``02006``; other names have none."""
    first = F.get(F.split(col(name), "_", 3), 0)
    return F.when(F.startswith(first, F.lit("IDTA")), F.trim(F.split_part(F.replace(first, F.lit("IDTA "), F.lit("")), F.lit("-"), F.lit(1))))


def template_title(name: Column | str) -> Column:
    """The third of at most three parts split at ``_``, else the second, else the whole name."""
    parts = F.split(col(name), "_", 3)
    return F.coalesce(F.get(parts, 2), F.get(parts, 1), col(name))


def url_quote(x: Column | str) -> Column:
    """Percent-encoding that keeps ``/`` and the unreserved characters ``~``; a space is ``%20`` and ``*`` is ``%2A``."""
    out = F.url_encode(col(x))
    for a, b in (("%2F", "/"), ("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cache_file(path: Column | str) -> Column:
    """Name of a path's cache entry."""
    return F.concat(F.md5(F.encode(col(path), "UTF-8")), F.lit(".aasx"))


def is_absolute_uri(x: Column | str) -> Column:
    """A network path, or a scheme in the first segment: not a part of the package."""
    return F.startswith(col(x), F.lit("//")) | F.contains(F.split_part(col(x), F.lit("/"), F.lit(1)), F.lit(":"))


#: The two releases of the metamodel's XML namespace.
NAMESPACE_31, NAMESPACE_30 = "https://admin-shell.io/aas/3/1", "https://admin-shell.io/aas/3/0"


def needs_older_namespace(raw: Column | str) -> Column:
    return F.contains(col(raw), F.lit(NAMESPACE_31)) & ~F.contains(col(raw), F.lit(NAMESPACE_30))


def rewrite_namespace(raw: Column | str, new: str = NAMESPACE_31, old: str = NAMESPACE_30) -> Column:
    """``new`` to ``old``, only where ``old`` does not occur."""
    x = col(raw)
    return F.when(F.contains(x, F.lit(new)) & ~F.contains(x, F.lit(old)), F.replace(x, F.lit(new), F.lit(old))).otherwise(x)


def embedded_json(html: Column | str, target: str = "react-app.embeddedData") -> Column:
    """The JSON text of the script element with that data target; null without one."""
    quoted = target.replace(".", r"\.")
    return F.nullif(F.regexp_extract(col(html), rf'(?s)<script[^>]*data-target="{quoted}"[^>]*>(.*?)</script>', 1), F.lit(""))


def html_title(html: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(html), r"(?si)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def disposition_name(header: Column | str) -> Column:
    """The file name in a Content-Disposition header."""
    return F.nullif(F.regexp_extract(col(header), r'filename="?([^";]+)"?', 1), F.lit(""))


def utf8(x: Column | str) -> Column:
    """Bytes to text; null where they are not UTF-8, so a bad blob is a null and not a failed job."""
    return F.try_validate_utf8(col(x).cast("string"))
