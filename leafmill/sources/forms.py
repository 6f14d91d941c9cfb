"""Submitted forms: nested JSON to one row a form node, with what is present, null or empty kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..landing import dealt, land, paired, walk
from ..operators import tree

_KID = "struct<role: string, ord: int, name: string, step: string, v: variant>"
_NAMED = """transform(map_entries(coalesce(try_cast(try_element_at(m, '{role}') AS map<string, variant>), map())),
  (e, i) -> named_struct('role', '{role}', 'ord', i, 'name', e.key, 'step', concat('{sign}', e.key), 'v', e.value))"""
_LISTED = """transform(coalesce(try_cast(try_element_at(m, '{role}') AS array<variant>), array()),
  (x, i) -> named_struct('role', '{role}', 'ord', i, 'name', concat('[', i, ']'), 'step', concat('{sign}', i), 'v', x))"""
_KIDS = "concat({})".format(", ".join([_NAMED.format(role="elements", sign="."), _NAMED.format(role="statements", sign=":"), _LISTED.format(role="items", sign="["), _LISTED.format(role="annotations", sign="@")]))


#: The node's own JSON: without what its children are made of. An empty map or list of children stays.
_OWN = """to_json(map_filter(m, (k, x) -> NOT (k IN ('elements', 'statements') AND coalesce(size(try_cast(x AS map<string, variant>)), 0) > 0
  OR k IN ('items', 'annotations') AND coalesce(size(try_cast(x AS array<variant>)), 0) > 0)))"""
_TYPES = """named_struct('elements', try_cast(try_element_at(m, 'elements') AS map<string, variant>) IS NOT NULL, 'statements', try_cast(try_element_at(m, 'statements') AS map<string, variant>) IS NOT NULL,
  'object', m IS NOT NULL, 'content', schema_of_variant(try_element_at(m, 'contentType')), 'asset', schema_of_variant(try_element_at(m, 'globalAssetId')),
  'texts', forall(map_values(coalesce(try_cast(try_element_at(m, 'value') AS map<string, variant>), map())), x -> coalesce(schema_of_variant(x) = 'STRING', false)))"""


def flatten(submissions: DataFrame, whole: bool = False) -> DataFrame:
    """From (submission_id, template, form): one row a form node, the root (path '') included, of any depth.

    ``steps`` is the node's typed label, as ``operators.tree`` has it: names and places a level, whatever characters a name
    has; ``path`` is text to show. ``present`` are the node's keys: a key that is there with null differs from one that is not.
    value_raw is text, value_type its JSON type (BIGINT, DOUBLE or DECIMAL, STRING, BOOLEAN, ARRAY<..>, OBJECT<..>). A null or
    blank form is an empty one; the root of one that cannot be read has an ``error``. ``whole`` adds ``own`` (the node's JSON
    without its children, as ``renest`` needs it) and ``is`` (JSON types of its parts, as ``operators.typing`` needs them)."""
    src = dealt(submissions.select("submission_id", F.col("template").cast("string").alias("template"), F.coalesce(F.col("form").cast("string"), F.lit("")).alias("form"))).withColumn("v", F.expr("try_parse_json(form)"))
    top = src.select(
        "submission_id", "template", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_path"), F.expr("CAST(array() AS array<string>)").alias("steps"), F.lit("root").alias("role"), F.lit(0).alias("ord"), F.lit(-1).alias("depth"),
        F.expr(f"CASE WHEN v IS NULL AND trim(form) <> '' THEN '{tree.UNREADABLE}' END").alias("error"), "v",
    )

    def rows(at: DataFrame) -> DataFrame:
        at = at.withColumn("m", F.expr("try_cast(v AS map<string, variant>)"))
        scalar = lambda name: F.expr(f"try_cast(try_element_at(m, '{name}') AS string)")
        return at.select(
            "submission_id", "template", "path", "parent_path", "steps", "role", "ord", "depth", F.expr("coalesce(map_keys(m), array())").alias("present"),
            scalar("value").alias("value_raw"), json_type("value").alias("value_type"), scalar("min").alias("min_raw"), scalar("max").alias("max_raw"),
            json_type("min").alias("min_type"), json_type("max").alias("max_type"),
            scalar("contentType").alias("content_type"), scalar("globalAssetId").alias("global_asset_id"), scalar("first").alias("first"), scalar("second").alias("second"),
            F.expr("size(try_cast(try_element_at(m, 'items') AS array<variant>))").alias("n_items"), "error",
            *([F.coalesce(F.expr(_OWN), F.expr("to_json(v)")).alias("own"), F.expr(_TYPES).alias("is")] if whole else []),
            F.expr(f"CASE WHEN m IS NULL THEN CAST(array() AS array<{_KID}>) ELSE {_KIDS} END").alias("kids"),
        )

    def below(level: DataFrame) -> DataFrame:
        each = level.select("submission_id", "template", "path", "steps", "depth", F.explode_outer("kids").alias("c")).where("c IS NOT NULL")  # outer: else Spark filters by the kids' number first, and makes them twice
        path = F.expr("CASE WHEN c.role = 'items' OR path = '' THEN concat(path, c.name) ELSE concat(path, '.', c.name) END")
        return rows(each.select("submission_id", "template", path.alias("path"), F.col("path").alias("parent_path"), F.array_append("steps", F.col("c.step")).alias("steps"), "c.role", "c.ord", (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("error"), F.col("c.v").alias("v")))

    return walk(rows(top), below, "form")


def renest(rows: DataFrame, keys: tuple[str, ...] = ("submission_id",)) -> DataFrame:
    """(keys, form): nested forms again, from rows with steps, role, ord and own (JSON without children): children under ``elements`` and
    ``statements`` in maps by their names, items and annotations in lists by their places. Deepest level first, each level
    gathered by its parent's steps. ``renest(flatten(f, whole=True))`` is ``f``, but for the order of keys; forms that
    cannot be read are left out."""
    rows = rows.where("error IS NULL") if "error" in rows.columns else rows
    top = rows.agg(F.max(F.size("steps"))).first()[0]
    below: DataFrame | None = None
    by = [*keys, "up"]
    for n in range(top or 0, -1, -1):
        level = rows.where(F.size("steps") == n).select(*keys, "steps", "role", "ord", "own")
        if below is not None:
            level = paired(level, below.withColumnRenamed("up", "steps"), [*keys, "steps"], "left")
            inner = F.expr("substring(own, 2, length(own) - 2)")
            level = level.withColumn("own", F.when(F.col("parts").isNull(), F.col("own")).otherwise(F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner, F.lit("")), "parts"), F.lit("}")))).drop("parts")
        if n == 0:
            return level.select(*keys, F.col("own").alias("form"))
        name = F.substr(F.element_at("steps", -1), F.lit(2))
        quoted = F.regexp_replace(F.to_json(F.array(name)), r"^\[|\]$", "")
        named = F.col("role").isin("elements", "statements")
        level = level.select(*keys, tree.parent("steps").alias("up"), "role", "ord", F.when(named, F.concat(quoted, F.lit(":"), "own")).otherwise(F.col("own")).alias("json"))
        roles = level.groupBy(*by, "role").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"]), ",").alias("c"))
        text = F.concat(F.lit('"'), "role", F.lit('":'), F.when(F.col("role").isin("elements", "statements"), F.concat(F.lit("{"), "c", F.lit("}"))).otherwise(F.concat(F.lit("["), "c", F.lit("]"))))
        below = roles.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("parts"))
        below = land(below, "nested") if n % 8 == 0 else below
    return rows.select(*keys, F.lit("").alias("form")).limit(0)


def json_type(name: str) -> Column:
    return F.expr(f"schema_of_variant(try_element_at(m, '{name}'))")


def language_entries(json: Column) -> Column:
    """A JSON object of texts as ordered (lang, text) entries."""
    return F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(e["key"].alias("lang"), e["value"].alias("text")))
