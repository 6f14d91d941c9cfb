"""Enrichment from a dictionary of concept descriptions, by first match in key and dictionary order.

Every lookup is one or two equality joins, then a minimum by (key position, dictionary order): never a join with OR,
never a window over a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language, text


def match_keys(elements: DataFrame, concepts: DataFrame, row: list[str], keys: str = "semantic_keys") -> DataFrame:
    """(row, cd): for each element the first of its keys that is a concept's id or id_short, and of these the first
    concept in order (cd_ord). ``row`` names the columns that tell elements apart."""
    each = elements.select(*row, F.posexplode(keys).alias("pos", "k"))
    each = each.select(*row, "pos", F.col("k.value").alias("k")).where("k IS NOT NULL")
    cd = concepts.select(F.struct(*concepts.columns).alias("cd"))
    by = lambda name: each.join(cd, F.col("k") == F.col(f"cd.{name}"))
    found = by("id").unionByName(by("id_short"))
    return found.groupBy(*row).agg(F.min_by("cd", F.struct("pos", "cd.cd_ord")).alias("cd"))


def enrich(elements: DataFrame, concepts: DataFrame, row: list[str], keys: str = "semantic_keys", unit_follow_external: bool = False, ref_kind: str = "semantic_ref_kind", own_description: str = "description") -> DataFrame:
    """Adds semantic_label, semantic_description and unit in one lookup.

    Label: preferred name, else display name. Description: the element's own, else the definition, else the
    concept's. Unit: only through model references, unless ``unit_follow_external``."""
    found = match_keys(elements, concepts, row, keys)
    out = elements.join(found, row, "left")
    blank = text.blank_to_null
    label = F.coalesce(blank(language.pick("cd.preferred_name")), blank(language.pick("cd.display_name")))
    told = F.coalesce(blank(language.pick(own_description)), blank(language.pick("cd.definition")), blank(language.pick("cd.description")))
    unit = F.col("cd.unit") if unit_follow_external else F.when(F.col(ref_kind) == "ModelReference", F.col("cd.unit"))
    return out.select("*", label.alias("semantic_label"), told.alias("semantic_description"), unit.alias("unit")).drop("cd")


def suffix_candidates(ids: Column, lengths: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.char_length(ids) >= n, F.right(ids, n)))


def lookup(requests: DataFrame, concepts: DataFrame, request: str = "semantic_id") -> DataFrame:
    """(request, cd): the first concept in order whose id is, or ends with, the stripped request, or whose id_short is it.

    The suffix test is an equality join: concepts' ids are cut to the few lengths that requests have."""
    asked = requests.select(F.col(request).alias("request"), text.strip(request).alias("s")).where("coalesce(s, '') <> ''").distinct()
    cd = concepts.select(F.struct(*concepts.columns).alias("cd"))
    lengths = asked.agg(F.sort_array(F.collect_set(F.char_length("s"))).alias("ns"))
    tails = cd.select("cd", lengths.scalar().alias("ns"))
    tails = tails.select("cd", F.explode(F.array_distinct(F.transform(F.filter("ns", lambda n: n <= F.char_length(F.col("cd.id"))), lambda n: F.right(F.col("cd.id"), n)))).alias("s"))
    named = cd.select("cd", F.col("cd.id_short").alias("s"))
    found = asked.join(tails.unionByName(named), "s")
    return found.groupBy("request").agg(F.min_by("cd", "cd.cd_ord").alias("cd"))


def record(requests: DataFrame, concepts: DataFrame, request: str = "semantic_id") -> DataFrame:
    """(request, found, record): the concept of each request as JSON, with its language maps; no concept, no record."""
    held = lookup(requests, concepts, request)
    maps = {"description": "description", "displayName": "display_name", "preferredName": "preferred_name", "shortName": "short_name", "definition": "definition"}
    plain = {"id": "id", "idShort": "id_short", "unit": "unit"}
    cd = {f.name for f in concepts.schema.fields}
    spoken = lambda c: F.when(F.size(c) > 0, F.map_from_entries(F.filter(c, lambda e: e["text"].isNotNull())))
    fields = [F.col(f"cd.{v}").alias(k) for k, v in plain.items() if v in cd] + [spoken(F.col(f"cd.{v}")).alias(k) for k, v in maps.items() if v in cd]
    out = requests.select(F.col(request).alias("request")).distinct().join(held, "request", "left")
    return out.select("request", F.col("cd").isNotNull().alias("found"), F.when(F.col("cd").isNotNull(), F.to_json(F.struct(*fields))).alias("record"))
