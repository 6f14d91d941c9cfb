"""The catalog of templates: search, sort, lookup, versions, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..landing import land


def search(templates: DataFrame, term: str | None = None, number: str | None = None, name: str = "name", title: str = "title", number_col: str = "idta_number") -> DataFrame:
    """Rows whose name or title holds ``term`` (any case, literally; empty: all) and whose number is ``number``."""
    out = templates
    if term:
        out = out.where(text.contains_literal(name, term) | text.contains_literal(title, term))
    return out.where(F.col(number_col) == number) if number is not None else out


def parse_names(entries: DataFrame, name: str = "name") -> DataFrame:
    """Adds idta_number and title, read from the name."""
    return entries.withColumn("idta_number", text.template_number(name)).withColumn("title", text.template_title(name))


def listing(items: DataFrame) -> DataFrame:
    """Catalog entries from a directory listing (name, type, contentType, path, html_url, sha): named directories only."""
    dirs = items.where("(type = 'dir' OR contentType = 'directory') AND coalesce(name, '') <> ''")
    out = dirs.select("name", F.coalesce("path", "name").alias("path"), F.coalesce("html_url", F.concat(F.lit("/"), text.url_quote(F.coalesce("path", "name")))).alias("url"), "sha")
    return parse_names(out)


def sort_key(number: Column | str = "idta_number", title: Column | str = "title", name: Column | str = "name") -> list[Column]:
    """Number ('99999' without one), then title or name, then name."""
    return [F.coalesce(text.blank_to_null(number), F.lit("99999")), F.coalesce(text.blank_to_null(title), text.col(name)), text.col(name)]


def ordered(templates: DataFrame) -> DataFrame:
    return templates.orderBy(*sort_key())


def get(templates: DataFrame, name: str, column: str = "name", order: list[Column] | None = None) -> DataFrame:
    """The first entry of exactly that name, by ``order`` (the catalog's where it has its columns, else all columns); no row
    if there is none."""
    known = {"idta_number", "title", "name"} <= {*templates.columns}
    return first_by(templates.where(F.col(column) == name), [column], order or ([*sort_key()] if known else [F.col(c) for c in templates.columns]))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order; first-wins distinct. Only minima are gathered, no group."""
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def page_roots(items: DataFrame, base: str, order: list[Column]) -> DataFrame:
    """name, path, url, type of the templates that a listing page names (name, path, content_type): directories only. A template's
    root is the second part of a path below ``published/``, else the first part of the name; entries without a root are left
    out, and of several with one root the first in ``order`` stands for all."""
    below = F.startswith(F.coalesce("path", F.lit("")), F.lit("published/"))
    root = F.when(below, F.split_part("path", F.lit("/"), F.lit(2))).otherwise(F.split_part(F.coalesce("name", F.lit("")), F.lit("/"), F.lit(1)))
    found = items.where("content_type = 'directory'").withColumn("root", root).where("root <> ''")
    path = F.concat(F.lit("published/"), "root")
    return first_by(found, ["root"], order).select(F.col("root").alias("name"), path.alias("path"), F.concat(F.lit(base), text.url_quote(path)).alias("url"), F.lit("dir").alias("type"))


def version_order(natural: bool = False) -> list[Column]:
    """Newest first: by text, or with ``natural`` by the numbers in it."""
    keys = [F.transform(F.regexp_extract_all("version", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)")).desc()] if natural else []
    return [*keys, F.desc("version")]


def versions(entries: DataFrame, natural: bool = False) -> DataFrame:
    """(template, version, ...) newest first."""
    return entries.orderBy("template", *version_order(natural))


def latest_version(entries: DataFrame) -> DataFrame:
    """One row a template: its newest version, by text."""
    return entries.groupBy("template").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "template"]), "version").alias("r")).select("template", "r.*")


def latest_file(files: DataFrame, depth: int = 3) -> DataFrame:
    """One package a template from (template, directory, name, depth): shallowest directory first, of equals the last
    directory, then the last name; deeper than ``depth`` is not looked at."""
    near = files.where((F.col("depth") <= depth) & F.endswith(F.lower("name"), F.lit(".aasx")))
    shallow = near.groupBy("template").agg(F.min("depth").alias("depth"))
    return near.join(shallow, ["template", "depth"]).groupBy("template").agg(F.max_by(F.struct("*"), F.struct("directory", "name")).alias("r")).select("r.*")


def invalidate(cache: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The cache's entries without those asked for, and (key, existed) for each key that was asked for."""
    held = cache.select(key).distinct().withColumn("existed", F.lit(True))
    told = asked.select(key).distinct().join(held, key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))
    return cache.join(asked.select(key), key, "left_anti"), told


def is_fresh(at: str, now: Column, hours: float = 24) -> Column:
    """Younger than the time to live; an entry of exactly that age is not."""
    return F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp")) < int(hours * 3_600_000_000)


def fresh(entries: DataFrame, at: str, now: Column, hours: float = 24) -> DataFrame:
    return entries.where(is_fresh(at, now, hours))


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Adds ``idx``, 0-based, within ``by``. Rows are sorted in ranges of the whole order and counted there; a range adds the
    numbers of the ranges before it, so neither a large group nor the whole table has to be one task."""
    by = by or []
    ranged = land(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "numbered")
    local = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)))
    sizes = ranged.groupBy("__range", *by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__range").alias("__r"), *(F.col(b).alias(f"__{b}") for b in by), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by), F.col("__range") == F.col("__r"))
    return local.join(sizes, same).select(*df.columns, (F.col("__before") + F.col("__k") - 1).cast("long").alias("idx"))
