"""Queries of the read path: one package a customer, with a dictionary of its own and references into it and into others."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..landing import land
from ..operators import reading
from ..sinks import packages as sink
from ..sources import packages as source
from .registry import query, table


def _ref(kind: str, *keys: tuple[str, str]) -> dict:
    return {"type": kind, "keys": [{"type": a, "value": b} for a, b in keys]}


def _element(name: str, ref: dict | None = None, kind: str = "Property", **more) -> dict:
    return {"idShort": name, "modelType": kind} | ({"semanticId": ref} if ref else {}) | more


#: @KEY, @NAME and @SEG stand for the customer's. The concept "urn:cd" comes twice in other words: by id and, later, as a short id.
ENVIRONMENT = {
    "submodels": [{
        "modelType": "Submodel", "id": "urn:s:@KEY", "idShort": "S", "submodelElements": [
            _element("Model", _ref("ModelReference", ("ConceptDescription", "urn:cd")), valueType="xs:int", value="5", valueId=_ref("ExternalReference", ("GlobalReference", "urn:v")), category="PARAMETER"),
            _element("Outer", _ref("ExternalReference", ("GlobalReference", "urn:none"), ("GlobalReference", "Second")), valueType="xs:string", value="@NAME", qualifiers=[{"type": "Cardinality", "valueType": "xs:string", "value": "ZeroToOne"}]),
            _element("Chain", _ref("ModelReference", ("Submodel", "urn:s:@KEY"), ("Property", "Model"))),
            _element("Own", _ref("ExternalReference", ("GlobalReference", "urn:cd")), "Range", valueType="xs:double", min="1", max="2", description=[{"language": "de", "text": "eigene"}]),
            _element("Box", None, "SubmodelElementCollection", value=[_element("List", None, "SubmodelElementList", typeValueListElement="SubmodelElementCollection", value=[{"modelType": "SubmodelElementCollection", "value": [_element("In", None, value="@SEG")]}])]),
        ],
    }],
    "conceptDescriptions": [
        {"modelType": "ConceptDescription", "id": "urn:cd", "idShort": "First", "embeddedDataSpecifications": [{"dataSpecificationContent": {"modelType": "DataSpecificationIec61360", "preferredName": [{"language": "fr", "text": "nom"}, {"language": "de", "text": "@SEG"}], "definition": [{"language": "en", "text": "what it is"}], "unit": "kg"}}]},
        {"modelType": "ConceptDescription", "id": "urn:cd2", "idShort": "Second", "displayName": [{"language": "en", "text": "shown"}], "description": [{"language": "en", "text": "told"}], "embeddedDataSpecifications": [{"dataSpecificationContent": {"modelType": "DataSpecificationIec61360", "preferredName": [{"language": "en", "text": ""}], "unit": "m"}}]},
        {"modelType": "ConceptDescription", "id": "Second", "idShort": "Third"},
    ],
}
ENVIRONMENT["conceptDescriptions"].reverse()  # the store's order is not that of the names


def _put(text: str) -> Column:
    out = F.lit(text)
    for name, value in (("@KEY", F.col("c_custkey").cast("string")), ("@NAME", F.col("c_name")), ("@SEG", F.col("c_mktsegment"))):
        out = F.replace(out, F.lit(name), value)
    return out


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("batch"), F.lit("aasx/data.json").alias("filename"), F.encode(_put(json.dumps(ENVIRONMENT)), "UTF-8").alias("content"))
    zips = sink.archive(files).select(F.col("batch").alias("package"), F.col("archive").alias("content"))
    return land(source.objects(source.parts(zips)), "objects")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS package, u.path, u.path_id AS semantic_id, CASE u.path WHEN 'Model' THEN c_mktsegment WHEN 'Own' THEN c_mktsegment END AS semantic_label,
  CASE u.path WHEN 'Model' THEN '{"en":"what it is"}' WHEN 'Own' THEN '{"de":"eigene"}' END AS description, CASE u.path WHEN 'Outer' THEN '[0..1]' ELSE '[1]' END AS cardinality,
  CASE u.path WHEN 'Model' THEN 'PARAMETER' END AS category, CASE u.path WHEN 'Model' THEN '5' WHEN 'Outer' THEN c_name WHEN 'Box.List[0].In' THEN c_mktsegment END AS value, CASE u.path WHEN 'Model' THEN 'urn:v' END AS value_id, CASE u.path WHEN 'Model' THEN 'kg' END AS unit,
  CASE u.path WHEN 'Model' THEN 'number' WHEN 'Own' THEN 'number' WHEN 'Outer' THEN 'text' WHEN 'Chain' THEN 'text' WHEN 'Box.List[0].In' THEN 'text' END AS input_type, CASE u.path WHEN 'Outer' THEN true ELSE false END AS qualified
  FROM customer, (VALUES ('Model', 'urn:cd'), ('Outer', 'urn:none'), ('Chain', NULL), ('Own', 'urn:cd'), ('Box', ''), ('Box.List', ''), ('Box.List[0]', ''), ('Box.List[0].In', '')) AS u(path, path_id0),
  LATERAL (SELECT CASE WHEN u.path = 'Chain' THEN concat('urn:s:', c_custkey) ELSE nullif(u.path_id0, '') END AS path_id) v""".replace("u.path_id AS", "v.path_id AS"))
def package_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's record, with labels from its package's dictionary: by model reference, by the second key of an external one,
    where the store's first match (a concept of that id, without a label) goes before a later short id."""
    out = reading.records(_objects(spark, sf_dir))
    return out.select("package", "path", "semantic_id", "semantic_label", "description", "cardinality", "category", "value", "value_id", "unit", "input_type", F.col("qualifiers").isNotNull().alias("qualified"))


#: Chains of one to four keys, and some that lead nowhere; @NEXT is another customer's key.
CHAINS = {
    "submodel": [("Submodel", "urn:s:@KEY")], "concept": [("ConceptDescription", "urn:cd2")], "property": [("Submodel", "urn:s:@KEY"), ("Property", "Model")], "list": [("Submodel", "urn:s:@KEY"), ("SubmodelElementCollection", "Box"), ("SubmodelElementList", "List")],
    "item": [("Submodel", "urn:s:@KEY"), ("SubmodelElementCollection", "Box"), ("SubmodelElementList", "List"), ("SubmodelElementCollection", "0")], "other": [("Submodel", "urn:s:0"), ("SubmodelElementCollection", "Box")],
    "lost": [("Submodel", "urn:s:none"), ("Property", "Model")], "lost child": [("Submodel", "urn:s:@KEY"), ("Property", "Nobody"), ("Property", "x")], "lost item": [("Submodel", "urn:s:@KEY"), ("SubmodelElementCollection", "Box"), ("SubmodelElementList", "List"), ("SubmodelElementCollection", "7")], "none": [],
}


@query("""SELECT CAST(c_custkey AS VARCHAR) AS package, u.name, u.kind, CASE WHEN u.kind IS NULL THEN NULL WHEN u.name = 'other' THEN (SELECT CAST(min(c_custkey) AS VARCHAR) FROM customer WHERE c_custkey = 0) ELSE CAST(c_custkey AS VARCHAR) END AS target, u.path, CAST(u.dangling AS INTEGER) AS dangling
  FROM customer, (VALUES ('submodel', 'Submodel', '', NULL), ('concept', 'ConceptDescription', '', NULL), ('property', 'Property', 'Model', NULL), ('list', 'SubmodelElementList', 'Box.List', NULL), ('item', 'SubmodelElementCollection', 'Box.List[0]', NULL),
    ('other', 'SubmodelElementCollection', 'Box', NULL), ('lost', NULL, NULL, 0), ('lost child', NULL, NULL, 1), ('lost item', NULL, NULL, 3), ('none', NULL, NULL, 0)) AS u(name, kind, path, dangling)""")
def reference_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains walked through submodels, collections and lists, into the own package and into another one; lost ones say at which key."""
    each = [F.struct(F.lit(name).alias("name"), F.from_json(_put(json.dumps([{"type": a, "value": b} for a, b in keys])), "array<struct<type:string,value:string>>").alias("keys")) for name, keys in CHAINS.items()]
    refs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("package"), F.explode(F.array(*each)).alias("e"))
    refs = refs.select("package", "e.name", "e.keys", F.concat_ws("/", "package", "e.name").alias("ref"))
    out = reading.resolve(refs.select("ref", "package", "keys"), _objects(spark, sf_dir))
    return out.select("package", F.split_part("ref", F.lit("/"), F.lit(2)).alias("name"), "kind", F.col("target_package").alias("target"), "path", "dangling")
