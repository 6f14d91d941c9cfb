"""XML text of exchange-format JSON, in DataFrame functions.

A document's values are numbered like nodes of a tree: an element's label is that of the element around it and its own
place among its neighbours, which for the fields of an object is the order that the format's schema asks for. Every
element is an opening event, which sorts before all that is inside it, and a closing event, which sorts after it; the
text is all events of a document in order. A document is one row, as it is one part of a package.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NAMESPACE_30
from ..landing import dealt, walk

# The order of fields in the format's schema.
ORDER = (
    "assetAdministrationShells submodels conceptDescriptions extensions category idShort displayName description administration id kind semanticId supplementalSemanticIds qualifiers "
    "embeddedDataSpecifications isCaseOf version revision creator templateId derivedFrom assetInformation assetKind orderRelevant semanticIdListElement typeValueListElement valueTypeListElement "
    "preferredName shortName unit unitId sourceOfDefinition symbol dataType definition valueFormat valueList levelType type name referredSemanticId keys valueType min max value valueId contentType "
    "first second annotations statements entityType globalAssetId specificAssetIds externalSubjectId assetType defaultThumbnail observed direction state messageTopic messageBroker lastUpdate minInterval maxInterval "
    "inputVariables outputVariables inoutputVariables refersTo submodelElements dataSpecification dataSpecificationContent language text path"
).split()
# Elements in lists, by the list's name, where an element has no kind of its own.
ITEMS = {
    "keys": "key", "qualifiers": "qualifier", "description": "langStringTextType", "displayName": "langStringNameType", "preferredName": "langStringPreferredNameTypeIec61360",
    "shortName": "langStringShortNameTypeIec61360", "definition": "langStringDefinitionTypeIec61360", "embeddedDataSpecifications": "embeddedDataSpecification", "specificAssetIds": "specificAssetId",
    "supplementalSemanticIds": "reference", "extensions": "extension", "isCaseOf": "reference", "refersTo": "reference", "inputVariables": "operationVariable", "outputVariables": "operationVariable",
    "inoutputVariables": "operationVariable", "valueReferencePairs": "valueReferencePair", "value": "langStringTextType", "conceptDescriptions": "conceptDescription", "assetAdministrationShells": "assetAdministrationShell",
}
FIRST, LAST = -1, 1 << 30
_KID = "struct<place: int, tag: string, around: string, v: variant>"


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def escaped(x: Column) -> Column:
    """Text as XML holds it; characters that XML cannot hold become U+FFFD, and a carriage return stays one."""
    out = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "\uFFFD")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def elements(envs: DataFrame) -> DataFrame:
    """package, label, tag, text (null for an element that holds others): every element of the documents (package, env)."""
    top = dealt(envs.select("package", "env")).select(
        "package", F.expr("CAST(array() AS array<int>)").alias("label"), F.lit("environment").alias("tag"), F.lit("").alias("around"), F.expr("try_parse_json(env)").alias("v"),
    )

    def rows(at: DataFrame) -> DataFrame:
        at = at.withColumn("m", F.expr("try_cast(v AS map<string, variant>)")).withColumn("a", F.expr("try_cast(v AS array<variant>)"))
        kind = F.expr("try_cast(try_element_at(m, 'modelType') AS string)")
        # A variable's value, and a specification's content, hold one element of their own kind.
        wraps = ((F.col("tag") == "dataSpecificationContent") | ((F.col("tag") == "value") & (F.col("around") == "operationVariable"))) & kind.isNotNull()
        lower = lambda x: F.concat(F.lower(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))
        inner = F.array(F.struct(F.lit(0).alias("place"), lower(kind).alias("tag"), F.col("tag").alias("around"), F.col("v")))
        order = _map({k: i for i, k in enumerate(ORDER)})
        # A qualifier's kind comes after its semantic ids.
        place = lambda e, i: F.when((e["key"] == "kind") & (F.col("tag") == "qualifier"), ORDER.index("qualifiers")).otherwise(F.coalesce(F.try_element_at(order, e["key"]), 1000 + i))
        named = F.transform(F.map_entries("m"), lambda e, i: F.struct(place(e, i).cast("int").alias("place"), e["key"].alias("tag"), F.col("tag").alias("around"), e["value"].alias("v")))
        items = _map(ITEMS)

        def item(x: Column, i: Column) -> Column:
            own = F.try_variant_get(x, "$.modelType", "string")
            of = F.when(own.isNotNull(), lower(own)).when((F.col("tag") == "submodels") & F.try_variant_get(x, "$.keys", "variant").isNotNull(), "reference").otherwise(F.coalesce(F.try_element_at(items, F.col("tag")), F.regexp_replace("tag", "s$", "")))
            return F.struct(i.cast("int").alias("place"), of.alias("tag"), F.col("tag").alias("around"), x.alias("v"))

        kids = F.when(F.col("a").isNotNull(), F.transform("a", item)).when(wraps, inner).when(F.col("m").isNotNull(), F.filter(named, lambda e: e["tag"] != "modelType")).otherwise(F.expr(f"CAST(array() AS array<{_KID}>)"))
        kept = F.filter(kids, lambda e: e["v"].isNotNull() & ~F.is_variant_null(e["v"]) & (F.coalesce(F.size(F.try_variant_get(e["v"], "$", "array<variant>")), F.lit(1)) > 0))
        text = F.when(F.col("a").isNull() & F.col("m").isNull(), F.expr("try_cast(v AS string)"))
        return at.select("package", "label", "tag", text.alias("text"), kept.alias("kids"))

    def below(level: DataFrame) -> DataFrame:
        each = level.select("package", "label", F.explode_outer("kids").alias("c")).where("c IS NOT NULL")
        return rows(each.select("package", F.array_append("label", F.col("c.place")).alias("label"), "c.tag", "c.around", "c.v"))

    return walk(rows(top), below, "xml")


def events(found: DataFrame) -> DataFrame:
    """package, key, text: openings and closings; keys sort as the text runs. An element without children is one event."""
    root = F.size("label") == 0
    tag = F.when(root, F.concat("tag", F.lit(f' xmlns="{NAMESPACE_30}"'))).otherwise(F.col("tag"))
    open_, close = F.concat(F.lit("<"), tag, F.lit(">")), F.concat(F.lit("</"), "tag", F.lit(">"))
    at = lambda place, text: F.struct(F.array_append("label", F.lit(place)).alias("key"), text.alias("text"))
    both = F.when(F.col("text").isNotNull(), F.array(at(FIRST, F.concat(open_, escaped(F.col("text")), close)))).otherwise(F.array(at(FIRST, open_), at(LAST, close)))
    return found.select("package", F.explode(both).alias("e")).select("package", "e.*")


def documents(envs: DataFrame) -> DataFrame:
    """(package, xml) of documents (package, env): null and unreadable ones give an environment without anything in it."""
    told = events(elements(envs)).groupBy("package").agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("e"))
    return told.select("package", F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>'), F.array_join(F.transform("e", lambda x: x["text"]), "")).alias("xml"))
