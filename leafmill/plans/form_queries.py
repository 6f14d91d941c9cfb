"""Validation and hydration queries: one template, and one submitted form for each customer."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cardinality, language, references
from ..landing import paired
from ..operators import hydrate, tree, typing, validate
from ..sources import forms
from .registry import query, table

TEMPLATE = {
    "elements": [
        {"idShort": "Name", "modelType": "Property", "valueType": "xs:string", "cardinality": "[1]"},
        {"idShort": "Rank", "modelType": "Property", "valueType": "xs:int", "cardinality": "[0..1]", "value": "0"},
        {"idShort": "Title", "modelType": "MultiLanguageProperty", "cardinality": "[1]", "value": {"en": "none"}},
        {"idShort": "Note", "modelType": "MultiLanguageProperty", "cardinality": "[0..1]", "value": {}},
        {"idShort": "Limit", "modelType": "Range", "valueType": "xs:int", "cardinality": "[0..1]", "min": "1", "max": "9"},
        {"idShort": "Site", "modelType": "ReferenceElement", "cardinality": "[0..1]", "value": "http://old", "keys": [{"type": "Submodel", "value": "http://old"}, {"type": "Property", "value": "p"}]},
        {"idShort": "Orders", "modelType": "SubmodelElementList", "cardinality": "[1..12]", "typeValueListElement": "SubmodelElementCollection",
         "items": [{"modelType": "SubmodelElementCollection", "elements": [{"idShort": "Status", "modelType": "Property", "valueType": "xs:string", "cardinality": "[1]", "value": "?"}, {"idShort": "Priority", "modelType": "Property", "valueType": "xs:string", "cardinality": "[0..1]", "value": "0"}]}]},
        {"idShort": "Manual", "modelType": "File", "cardinality": "[0..1]", "contentType": "application/pdf", "value": "/old.pdf"},
    ]
}


def _flat(spark: SparkSession, name: str, template: dict) -> DataFrame:
    return tree.flatten(spark.createDataFrame([(name, json.dumps(template))], "template string, doc string"))


def _nodes(spark: SparkSession) -> DataFrame:
    return _flat(spark, "customer", TEMPLATE)


def _value(name: str, x: Column) -> Column:
    return F.concat(F.lit(f'"{name}":{{"value":'), x, F.lit("}"))


def _text(x: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(submission_id, template, form). By the customer's key, names are missing, null or empty, ranks are not numbers, and so on."""
    k = F.col("c_custkey")
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    item = F.concat(F.lit('{"elements":{'), _value("Status", _text(status)), F.lit("}}"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))).alias("o"))
    listed = F.array_join(F.coalesce(F.transform("o", lambda o: o["x"]), F.array().cast("array<string>")), ",")
    name = F.when(k % 10 == 1, F.lit(None)).when(k % 10 == 2, _value("Name", F.lit("null"))).when(k % 10 == 3, _value("Name", F.lit('""'))).otherwise(_value("Name", _text(F.col("c_name"))))
    rank = F.when(k % 4 == 1, _value("Rank", F.lit('"12.7"'))).when(k % 4 == 2, _value("Rank", F.lit('" 1_2 "'))).when(k % 4 == 3, _value("Rank", F.lit("true")))
    title = F.when(k % 7 == 0, _value("Title", F.lit('{"en":"","de":null}'))).otherwise(_value("Title", F.concat(F.lit('{"de":'), _text(F.col("c_mktsegment")), F.lit(',"fr":" "}'))))
    note = F.when(k % 6 == 0, _value("Note", F.lit("{}")))
    limit = F.when(k % 9 == 0, F.lit('"Limit":{"min":"x","max":"2.5"}')).when(k % 9 == 1, F.lit('"Limit":{"min":"3"}'))
    site = F.when(k % 8 == 0, _value("Site", F.lit('"nope"'))).when(k % 8 == 1, _value("Site", F.lit('"https://new"')))
    form = F.concat(F.lit('{"elements":{'), F.concat_ws(",", name, rank, title, note, limit, site, F.concat(F.lit('"Orders":{"items":['), listed, F.lit("]}"))), F.lit("}}"))
    both = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return both.select(k.cast("string").alias("submission_id"), F.lit("customer").alias("template"), form.alias("form"))


_C = "c AS (SELECT CAST(c_custkey AS VARCHAR) AS submission_id, c_custkey AS k, * FROM customer), o AS (SELECT CAST(o_custkey AS VARCHAR) AS submission_id, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT c.submission_id, count(i) AS n FROM c LEFT JOIN o USING (submission_id) GROUP BY 1)"
_FOUND = f"""WITH {_C} SELECT submission_id, 'error' AS severity, 'Name' AS field, 'required' AS code FROM c WHERE k % 10 = 1 UNION ALL SELECT submission_id, 'error', 'Name', 'required_value' FROM c WHERE k % 10 IN (2, 3)
  UNION ALL SELECT submission_id, 'error', 'Rank', 'type_mismatch' FROM c WHERE k % 4 = 1 UNION ALL SELECT submission_id, 'error', 'Title', 'required_translation' FROM c WHERE k % 7 = 0
  UNION ALL SELECT submission_id, 'warning', 'Note', 'recommended_value' FROM c WHERE k % 6 = 0 UNION ALL SELECT submission_id, 'error', unnest(['Limit.min', 'Limit.max']), 'type_mismatch' FROM c WHERE k % 9 = 0
  UNION ALL SELECT submission_id, 'error', 'Site', 'invalid_reference' FROM c WHERE k % 8 = 0 UNION ALL SELECT submission_id, 'error', 'Orders', 'min_items' FROM n WHERE n = 0 UNION ALL SELECT submission_id, 'error', 'Orders', 'max_items' FROM n WHERE n > 12
  UNION ALL SELECT submission_id, 'error', concat('Orders[', i, '].Status'), 'required_value' FROM o WHERE o_orderstatus = 'P'"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.run(_nodes(spark), forms.flatten(submissions(spark, sf_dir)))


@query(_FOUND)
def validate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("submission_id", "severity", "field", "code")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS submission_id, count(*) FILTER (WHERE severity = 'error') = 0 AS valid, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM customer LEFT JOIN ({_FOUND}) f ON CAST(c_custkey AS VARCHAR) = f.submission_id GROUP BY c_custkey")
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.verdicts(submissions(spark, sf_dir), _findings(spark, sf_dir))


@query(f"""WITH {_C} SELECT submission_id, 'Name' AS path, CASE WHEN k % 10 IN (0, 4, 5, 6, 7, 8, 9) THEN c_name WHEN k % 10 = 3 THEN NULL END AS value, CAST(NULL AS VARCHAR) AS spoken, CAST(NULL AS VARCHAR) AS lo, CAST(NULL AS VARCHAR) AS hi FROM c
  UNION ALL SELECT submission_id, 'Rank', CASE k % 4 WHEN 0 THEN '0' WHEN 1 THEN '12' WHEN 2 THEN '12' ELSE '1' END, NULL, NULL, NULL FROM c
  UNION ALL SELECT submission_id, 'Title', NULL, CASE WHEN k % 7 = 0 THEN 'en=none' ELSE concat('de=', c_mktsegment) END, NULL, NULL FROM c UNION ALL SELECT submission_id, 'Note', NULL, '', NULL, NULL FROM c
  UNION ALL SELECT submission_id, 'Limit', NULL, NULL, CASE k % 9 WHEN 0 THEN 'x' WHEN 1 THEN '3' ELSE '1' END, CASE k % 9 WHEN 0 THEN '2' ELSE '9' END FROM c
  UNION ALL SELECT submission_id, 'Site', CASE k % 8 WHEN 0 THEN 'nope' WHEN 1 THEN 'https://new' ELSE 'http://old' END, NULL, NULL, NULL FROM c
  UNION ALL SELECT submission_id, 'Orders', NULL, NULL, NULL, NULL FROM c UNION ALL SELECT submission_id, 'Manual', '/old.pdf', NULL, NULL, NULL FROM c
  UNION ALL SELECT submission_id, concat('Orders[', i, ']'), NULL, NULL, NULL, NULL FROM o UNION ALL SELECT submission_id, concat('Orders[', i, '].Priority'), '0', NULL, NULL, NULL FROM o
  UNION ALL SELECT submission_id, concat('Orders[', i, '].Status'), CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, NULL, NULL, NULL FROM o""")
def hydrate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms merged into the template: every node of every result."""
    subs = submissions(spark, sf_dir)
    merged = hydrate.merge(subs, _nodes(spark), forms.flatten(subs))
    spoken = F.array_join(F.transform("languages", lambda e: F.concat(e["lang"], F.lit("="), e["text"])), ";")
    return merged.select("submission_id", "path", "value", spoken.alias("spoken"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@query(f"""WITH {_C} SELECT submission_id, CASE WHEN k % 10 IN (0, 4, 5, 6, 7, 8, 9) THEN c_name END AS name, n AS n_orders, '0' AS priority FROM c JOIN n USING (submission_id)""")
def hydrate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged forms as JSON documents again, read by path."""
    subs = submissions(spark, sf_dir)
    docs = hydrate.to_documents(hydrate.merge(subs, _nodes(spark), forms.flatten(subs)))
    read = lambda p: F.get_json_object("doc", p)
    n = F.coalesce(F.json_array_length(read("$.elements[6].items")), F.lit(0)).cast("long")
    return docs.select("submission_id", read("$.elements[0].value").alias("name"), n.alias("n_orders"), F.coalesce(read("$.elements[6].items[0].elements[1].value"), F.lit("0")).alias("priority"))


@query("SELECT o_orderkey, 'Required field ''Lines'' is missing' AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def v_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forms of one required list, absent where the order has no lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    both = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    form = F.when(F.col("n").isNull(), '{"elements":{}}').otherwise('{"elements":{"Lines":{"items":[{}]}}}')
    subs = both.select(F.col("o_orderkey").cast("string").alias("submission_id"), F.lit("order").alias("template"), form.alias("form"))
    nodes = _flat(spark, "order", {"elements": [{"idShort": "Lines", "modelType": "SubmodelElementList", "cardinality": "[1..*]"}]})
    return validate.run(nodes, forms.flatten(subs)).where("code = 'required'").select(F.col("submission_id").cast("long").alias("o_orderkey"), "message")


@query("SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) > 5 THEN 'max_items' ELSE 'min_items' END AS code FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5 OR count(*) < 2")
def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cardinality.bounds(F.lit("[2..5]"))
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    code = F.when(F.col("n") > b["max"], "max_items").when(F.col("n") < b["min"], "min_items")
    return n.select("l_orderkey", "n", code.alias("code")).where("code is not null")


@query("SELECT source, CASE WHEN count(*) FILTER (WHERE lang = 'en' AND n_chars > 4000) = 0 THEN 'required_translation' ELSE 'ok' END AS code FROM documents GROUP BY source")
def v_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.when((F.col("lang") == "en") & (F.col("n_chars") > 4000), F.lit("x"))).alias("en"))
    entries = F.array(F.struct(F.lit("en").alias("lang"), F.col("en").alias("text")))
    return docs.select("source", F.when(language.any_text(entries), "ok").otherwise("required_translation").alias("code"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'range_order' AS code FROM lineitem WHERE l_discount > l_tax")
def v_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").cast("string").alias("min_raw"), F.col("l_tax").cast("string").alias("max_raw"), F.lit(True).alias("present_node"), F.lit("Range").alias("model_type"), F.lit("").alias("path"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", validate.range_order()["code"].alias("code")).where("code is not null")


@query("SELECT page_id, url FROM pages WHERE page_id % 2 = 0")
def v_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").where(~references.is_valid(raw)).select("page_id", "url")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN source ELSE CAST(quality AS VARCHAR) END AS value, l.doc_id IS NULL AS kept FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def hydrate_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag of presence decides, not the value: what is absent keeps the old value."""
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("quality"))
    both = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("template"), "doc_id", "source").join(new, "doc_id", "left")
    doc = F.concat(F.lit('{"elements":[{"idShort":"V","modelType":"Property","valueType":"xs:string","value":'), _text(F.col("source")), F.lit("}]}"))
    form = F.when(F.col("quality").isNull(), '{"elements":{}}').otherwise(F.concat(F.lit('{"elements":{'), _value("V", _text(F.col("quality"))), F.lit("}}")))
    nodes = tree.flatten(both.select("template", doc.alias("doc")))
    subs = both.select(F.col("template").alias("submission_id"), "template", form.alias("form"))
    merged = hydrate.merge(subs, nodes, forms.flatten(subs))
    return merged.select(F.col("submission_id").cast("long").alias("doc_id"), "value", (F.col("value") == tree.field("value")).alias("kept"))


@query("""WITH t AS (SELECT source, lang, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY ALL),
  n AS (SELECT source, string_agg(concat(lang, '=', b), ';' ORDER BY lang) FILTER (WHERE b % 3 > 0) AS new, string_agg(concat(lang, '=', a), ';' ORDER BY lang) AS old FROM t WHERE lang IN ('en', 'de') GROUP BY source)
  SELECT source, coalesce(new, old) AS merged FROM n""")
def hydrate_multilang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new map replaces the old one as a whole, without blank entries; if nothing is left, the old one stays."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de"))
    each = docs.groupBy("source", "lang").agg(F.min("doc_id").cast("string").alias("a"), F.max("doc_id").alias("b"))
    each = each.withColumn("n", F.when(F.col("b") % 3 == 0, " ").otherwise(F.col("b").cast("string")))
    entry = lambda c: F.array_sort(F.collect_list(F.struct("lang", F.col(c).alias("text"))))  # noqa: E731  two languages
    maps = each.groupBy("source").agg(entry("a").alias("old"), entry("n").alias("new"))
    return maps.select("source", F.array_join(F.transform(language.replaced("old", "new"), lambda e: F.concat(e["lang"], F.lit("="), e["text"])), ";").alias("merged"))


@query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role FROM conversations), f AS (SELECT conv_id - 1 AS conv_id, ord FROM t)
  SELECT f.conv_id, f.ord, coalesce(t.role, z.role) AS role, t.role IS NULL AS cloned FROM f JOIN t z ON z.conv_id = f.conv_id AND z.ord = 0 LEFT JOIN t ON t.conv_id = f.conv_id AND t.ord = f.ord""")
def hydrate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next conversation's turns are the form over a conversation's: surplus turns go, missing ones are clones of the first."""
    turns = table(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    item = lambda x: F.concat(F.lit('{"modelType":"Property","valueType":"xs:string","value":"'), x["role"], F.lit('"}'))
    doc = F.concat(F.lit('{"elements":[{"idShort":"Turns","modelType":"SubmodelElementList","items":['), F.array_join(F.transform("t", item), ","), F.lit("]}]}"))
    docs = listed.select(F.col("conv_id").cast("string").alias("template"), doc.alias("doc"))
    form = F.concat(F.lit('{"elements":{"Turns":{"items":['), F.array_join(F.transform("t", lambda x: F.lit("{}")), ","), F.lit("]}}}"))
    subs = listed.select((F.col("conv_id") - 1).cast("string").alias("submission_id"), (F.col("conv_id") - 1).cast("string").alias("template"), form.alias("form"))
    items = hydrate.instances(subs, tree.flatten(docs), forms.flatten(subs)).where("role = 'items'")
    return items.select(F.col("submission_id").cast("long").alias("conv_id"), F.col("ord").cast("long").alias("ord"), tree.field("value").alias("role"), "cloned")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'xs:int' WHEN 1 THEN 'xs:string' END AS value_type, CASE p_size % 4 WHEN 2 THEN 'application/octet-stream' END AS content_type, p_size % 4 < 3 AS made FROM part")
def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items of an empty list, by the kind it declares; a kind that cannot be made gives none."""
    form = F.col("p_size") % 4
    kind = F.when(form < 2, "Property").when(form == 2, "File").otherwise("Capability")
    made = hydrate.prototype(kind, F.when(form == 0, "xs:int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.get_json_object(made, "$.valueType").alias("value_type"), F.get_json_object(made, "$.contentType").alias("content_type"), made.isNotNull().alias("made"))


#: One required element of each kind whose rules the customers' template has not.
KINDS = {
    "elements": [
        {"idShort": "Limit", "modelType": "Range", "valueType": "xs:int", "cardinality": "[1]", "min": "1", "max": "9"},
        {"idShort": "Manual", "modelType": "File", "cardinality": "[1]", "contentType": "application/pdf", "value": "/old.pdf"},
        {"idShort": "Raw", "modelType": "Blob", "cardinality": "[0..1]", "contentType": "text/plain", "value": "old"},
        {"idShort": "Site", "modelType": "ReferenceElement", "cardinality": "[1]", "value": "http://old"},
        {"idShort": "Owner", "modelType": "Entity", "cardinality": "[0..1]", "globalAssetId": "urn:old", "statements": [{"idShort": "State", "modelType": "Property", "valueType": "xs:string", "cardinality": "[0..1]", "value": "on"}]},
        {"idShort": "Link", "modelType": "RelationshipElement", "cardinality": "[1]", "first": "urn:1", "second": "urn:2"},
        {"idShort": "Noted", "modelType": "AnnotatedRelationshipElement", "cardinality": "[0..1]", "first": "urn:1", "second": "urn:2", "annotations": [{"idShort": "Why", "modelType": "Property", "valueType": "xs:string", "value": "because"}]},
    ]
}


def kind_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as forms of these kinds: by the size, bounds, paths, references and sides are missing, empty or new."""
    k = F.col("p_size")
    limit = F.when(k % 3 == 0, '"Limit":{"min":"2"}').when(k % 3 == 1, '"Limit":{"min":"2","max":""}').otherwise('"Limit":{"min":"2","max":"3"}')
    manual = F.when(k % 4 == 0, '"Manual":{"value":""}').when(k % 4 == 1, '"Manual":{"contentType":"a/b"}').otherwise('"Manual":{"value":"/new.pdf"}')
    raw = F.when(k % 2 == 0, '"Raw":{"value":"","contentType":"c/d"}').otherwise('"Raw":{"value":"new"}')
    site = F.when(k % 5 == 0, '"Site":{"value":null}').otherwise('"Site":{"value":"https://new"}')
    owner = F.when(k % 6 == 0, '"Owner":{"statements":{"State":{"value":"off"}}}').otherwise('"Owner":{"globalAssetId":"urn:new"}')
    link = F.when(k % 7 == 0, '"Link":{"first":"urn:9","second":""}').otherwise('"Link":{"first":"urn:9","second":"urn:8"}')
    noted = F.when(k % 8 == 0, '"Noted":{"annotations":[{"value":"so"},{"value":"surplus"}]}').otherwise('"Noted":{"second":"urn:7"}')
    form = F.concat(F.lit('{"elements":{'), F.concat_ws(",", limit, manual, raw, site, owner, link, noted), F.lit("}}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("submission_id"), F.lit("kinds").alias("template"), form.alias("form"))


@query("""SELECT p_partkey, f.field, 'required_value' AS code FROM part, (VALUES ('Limit', 3), ('Manual', 4), ('Site', 5), ('Link', 7)) AS f(field, m)
  WHERE CASE field WHEN 'Limit' THEN p_size % 3 < 2 WHEN 'Manual' THEN p_size % 4 < 2 ELSE p_size % m = 0 END""")
def validate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges, files, references and relations that are required and lack a part."""
    found = validate.run(_flat(spark, "kinds", KINDS), forms.flatten(kind_submissions(spark, sf_dir)))
    return found.select(F.col("submission_id").cast("long").alias("p_partkey"), "field", "code")


@query("""SELECT p_partkey, u.path, CASE u.path WHEN 'Manual' THEN CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN '/old.pdf' ELSE '/new.pdf' END WHEN 'Raw' THEN CASE WHEN p_size % 2 = 0 THEN 'old' ELSE 'new' END
    WHEN 'Site' THEN CASE WHEN p_size % 5 = 0 THEN 'http://old' ELSE 'https://new' END WHEN 'Owner.State' THEN CASE WHEN p_size % 6 = 0 THEN 'off' ELSE 'on' END WHEN 'Noted.Why' THEN CASE WHEN p_size % 8 = 0 THEN 'so' ELSE 'because' END END AS value,
  CASE u.path WHEN 'Manual' THEN CASE WHEN p_size % 4 = 1 THEN 'a/b' ELSE 'application/pdf' END WHEN 'Raw' THEN CASE WHEN p_size % 2 = 0 THEN 'c/d' ELSE 'text/plain' END END AS content_type,
  CASE WHEN u.path = 'Owner' THEN CASE WHEN p_size % 6 = 0 THEN 'urn:old' ELSE 'urn:new' END END AS asset, CASE u.path WHEN 'Link' THEN 'urn:9' WHEN 'Noted' THEN 'urn:1' END AS one,
  CASE u.path WHEN 'Link' THEN CASE WHEN p_size % 7 = 0 THEN 'urn:2' ELSE 'urn:8' END WHEN 'Noted' THEN CASE WHEN p_size % 8 = 0 THEN 'urn:2' ELSE 'urn:7' END END AS two
  FROM part, (VALUES ('Limit'), ('Manual'), ('Raw'), ('Site'), ('Owner'), ('Owner.State'), ('Link'), ('Noted'), ('Noted.Why')) AS u(path)""")
def hydrate_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind takes from a form and what it keeps; annotations are matched by place, surplus ones are left."""
    subs = kind_submissions(spark, sf_dir)
    merged = hydrate.merge(subs, _flat(spark, "kinds", KINDS), forms.flatten(subs))
    return merged.select(F.col("submission_id").cast("long").alias("p_partkey"), "path", "value", "content_type", F.col("global_asset_id").alias("asset"), F.col("first").alias("one"), F.col("second").alias("two"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'first item' WHEN 1 THEN 'prototype' END AS origin, CASE p_size % 3 WHEN 0 THEN p_brand END AS value, CASE p_size % 3 WHEN 1 THEN 'xs:int' END AS value_type FROM part WHERE p_size % 3 < 2""")
def item_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new items of a list are made from: the first item, else a typed prototype, else nothing."""
    k = F.col("p_size") % 3
    item = F.concat(F.lit('{"modelType":"Property","value":'), _text(F.col("p_brand")), F.lit("}"))
    own = F.when(k == 0, F.concat(F.lit('"items":['), item, F.lit("]"))).when(k == 1, '"typeValueListElement":"Property","valueTypeListElement":"xs:int","items":[]').otherwise('"items":[]')
    doc = F.concat(F.lit('{"elements":[{"idShort":"L","modelType":"SubmodelElementList",'), own, F.lit("}]}"))
    made = hydrate.item_templates(tree.flatten(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("template"), doc.alias("doc"))))
    return made.select(F.col("template").cast("long").alias("p_partkey"), "origin", tree.field("value").alias("value"), tree.field("valueType").alias("value_type"))


#: Names that read like paths: a collection ``a`` with a property ``a``, beside properties called ``a.a`` and ``a[0]``.
DOTTED = {
    "elements": [
        {"idShort": "a", "modelType": "SubmodelElementCollection", "cardinality": "[1]", "elements": [{"idShort": "a", "modelType": "Property", "valueType": "xs:string", "cardinality": "[1]", "value": "inner"}]},
        {"idShort": "a.a", "modelType": "Property", "valueType": "xs:string", "cardinality": "[0..1]", "value": "outer"},
        {"idShort": "a[0]", "modelType": "Property", "valueType": "xs:string", "cardinality": "[1]", "value": "zero"},
    ]
}


def dotted_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as forms: by the size, the value is that of the inner node, of the one whose name reads like its path, or of both."""
    k, v = F.col("p_size") % 4, _text(F.col("p_name"))
    outer, zero = F.concat(F.lit('"a.a":{"value":'), v, F.lit("}")), F.lit('"a[0]":{"value":"z"}')
    inner = F.concat(F.lit('"a":{"elements":{"a":{"value":'), v, F.lit("}}}"))
    body = F.when(k == 0, F.concat_ws(",", outer, F.lit('"a":{"elements":{}}'), zero)).when(k == 1, F.concat_ws(",", inner, zero)).when(k == 2, F.concat_ws(",", outer, inner)).otherwise(outer)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("submission_id"), F.lit("dotted").alias("template"), F.concat(F.lit('{"elements":{'), body, F.lit("}}")).alias("form"))


@query("""SELECT p_partkey, 'a.a' AS field, 'Required field ''a'' is missing' AS message FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'a[0]', 'Required field ''a[0]'' is missing' FROM part WHERE p_size % 4 >= 2
  UNION ALL SELECT p_partkey, 'a', 'Required field ''a'' is missing' FROM part WHERE p_size % 4 = 3""")
def validate_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form's key ``a.a`` is not the node ``a`` in ``a``, nor is ``a[0]`` an item."""
    found = validate.run(_flat(spark, "dotted", DOTTED), forms.flatten(dotted_submissions(spark, sf_dir)))
    return found.select(F.col("submission_id").cast("long").alias("p_partkey"), "field", "message")


@query("""SELECT p_partkey, u.place, CASE u.place WHEN '0/0' THEN CASE WHEN p_size % 4 IN (1, 2) THEN p_name ELSE 'inner' END WHEN '1' THEN CASE WHEN p_size % 4 <> 1 THEN p_name ELSE 'outer' END WHEN '2' THEN CASE WHEN p_size % 4 < 2 THEN 'z' ELSE 'zero' END END AS value
  FROM part, (VALUES ('0'), ('0/0'), ('1'), ('2')) AS u(place)""")
def hydrate_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a node, each with its own value; nodes are told apart by their places."""
    subs = dotted_submissions(spark, sf_dir)
    merged = hydrate.merge(subs, _flat(spark, "dotted", DOTTED), forms.flatten(subs))
    place = F.array_join(F.transform("sort", lambda x: x["ord"].cast("string")), "/")
    return merged.select(F.col("submission_id").cast("long").alias("p_partkey"), place.alias("place"), "value")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size < 50 THEN p_size % 12 END AS BIGINT) AS levels, CASE WHEN p_size < 50 THEN p_name END AS value, p_size = 50 AS unreadable FROM part""")
def forms_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of up to 11 levels by the part's size, and of 600 levels, beyond what is parsed, for size 50: no node is lost without an error."""
    n = F.when(F.col("p_size") == 50, 600).otherwise(F.col("p_size") % 12)
    form = F.concat(F.repeat(F.lit('{"elements":{"n":'), n), F.lit('{"value":'), _text(F.col("p_name")), F.lit("}"), F.repeat(F.lit("}}"), n))
    nodes = forms.flatten(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("submission_id"), F.lit("deep").alias("template"), form.alias("form")))
    one = nodes.groupBy(F.col("submission_id").alias("p_partkey")).agg(F.max("depth").alias("d"), F.max_by("value_raw", "depth").alias("value"), F.max("error").alias("error"))
    return one.select("p_partkey", F.when(F.col("error").isNull(), F.col("d") + 1).cast("long").alias("levels"), "value", F.col("error").isNotNull().alias("unreadable"))


@query("""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS template, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) SELECT template, '0' AS top, CAST(1 AS BIGINT) AS n FROM t UNION ALL SELECT template, '1', 1 FROM t UNION ALL SELECT template, '2', 1 + 3 * n FROM t""")
def tree_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the subtree below each element at the top, by labels of ancestors."""
    from .tree_queries import customer_templates

    nodes = tree.flatten(customer_templates(spark, sf_dir))
    below = tree.subtrees(nodes, nodes.where("depth = 0").select("template", F.col("sort").alias("top")))
    return below.groupBy("template", F.element_at("top", 1)["ord"].cast("string").alias("top")).agg(F.count(F.lit(1)).alias("n"))


#: A template with the types that a client tells apart, an entity and a list of numbers.
CLIENT = {
    "elements": [
        {"idShort": "N", "modelType": "Property", "valueType": "xs:int", "cardinality": "[1]"}, {"idShort": "O", "modelType": "Property", "valueType": "xs:double", "cardinality": "[0..1]"}, {"idShort": "B", "modelType": "Property", "valueType": "xs:boolean", "cardinality": "[0..1]"},
        {"idShort": "E", "modelType": "Entity", "cardinality": "[0..1]", "statements": [{"idShort": "S", "modelType": "Property", "valueType": "xs:string", "cardinality": "[1]"}]},
        {"idShort": "L", "modelType": "SubmodelElementList", "cardinality": "[1..*]", "items": [{"modelType": "Property", "valueType": "xs:integer", "cardinality": "[1]"}]},
        {"idShort": "F", "modelType": "File", "cardinality": "[1]"}, {"idShort": "C", "modelType": "Capability", "cardinality": "[1]"},
    ]
}


def client_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as forms: values by the part's size, as numbers, texts, booleans and nulls."""
    k, part = F.col("p_size"), lambda name, x: F.concat(F.lit(f'"{name}":'), x)
    n = F.when(k % 7 == 0, '{"value":"12.7"}').when(k % 7 == 1, '{"value":""}').when(k % 7 == 2, '{"value":" 0x1F "}').when(k % 7 == 3, '{"value":null}').when(k % 7 == 4, "{}").when(k % 7 == 5, F.concat(F.lit('{"value":"'), k.cast("string"), F.lit('"}'))).otherwise('{"value":true}')
    o = F.when(k % 3 == 0, "{}").when(k % 3 == 1, '{"value":"1e3"}').otherwise('{"value":"x"}')
    b = F.when(k % 2 == 0, '{"value":"true"}').otherwise('{"value":false}')
    e = F.when(k % 5 == 0, '{"globalAssetId":"","statements":{}}').when(k % 5 == 1, '{"globalAssetId":5,"statements":{"S":{"value":""}}}').when(k % 5 == 2, '{"globalAssetId":"a"}').otherwise('{"statements":{"S":{"value":1}}}')
    items = F.when(k % 4 == 0, '{"items":[]}').when(k % 4 == 1, '{"items":[{"value":"1"},{"value":"a"}]}').when(k % 4 == 2, '{"items":{}}')
    f = F.when(k % 6 == 0, '{"value":""}').otherwise('{"value":"/f","contentType":"a/b"}')
    form = F.concat(F.lit('{"elements":{'), F.concat_ws(",", part("N", n), part("O", o), part("B", b), part("E", e), part("L", items), part("F", f)), F.lit("}}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("submission_id"), F.lit("client").alias("template"), form.alias("form"))


@query("""SELECT p_partkey, 'N' AS field, 'value' AS part, 'invalid_type' AS code FROM part WHERE p_size % 7 IN (0, 4) UNION ALL SELECT p_partkey, 'O', 'value', 'invalid_type' FROM part WHERE p_size % 3 = 2
  UNION ALL SELECT p_partkey, 'B', 'value', 'invalid_type' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'E.S', '', 'required' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'E', 'globalAssetId', 'invalid_type' FROM part WHERE p_size % 5 = 1
  UNION ALL SELECT p_partkey, 'E', 'statements', 'invalid_type' FROM part WHERE p_size % 5 = 2 UNION ALL SELECT p_partkey, 'E.S', 'value', 'invalid_type' FROM part WHERE p_size % 5 > 2
  UNION ALL SELECT p_partkey, 'L', 'items', CASE WHEN p_size % 4 = 0 THEN 'too_small' ELSE 'invalid_type' END FROM part WHERE p_size % 4 IN (0, 2) UNION ALL SELECT p_partkey, 'L[1]', 'value', 'invalid_type' FROM part WHERE p_size % 4 = 1
  UNION ALL SELECT p_partkey, 'L', '', 'required' FROM part WHERE p_size % 4 = 3 UNION ALL SELECT p_partkey, 'F', 'value', 'invalid_type' FROM part WHERE p_size % 6 = 0""")
def client_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the client refuses, in elements, statements and items: not what validation finds."""
    found = typing.run(_flat(spark, "client", CLIENT), forms.flatten(client_submissions(spark, sf_dir), whole=True))
    return found.select(F.col("submission_id").cast("long").alias("p_partkey"), "field", "part", "code")


@query("SELECT CAST(c_custkey AS VARCHAR) AS submission_id, true AS same FROM customer UNION ALL SELECT concat('p', p_partkey), true FROM part")
def forms_renested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms taken apart and put together again, of both kinds: maps by name, lists by place."""
    subs = submissions(spark, sf_dir).unionByName(client_submissions(spark, sf_dir).withColumn("submission_id", F.concat(F.lit("p"), "submission_id")))
    back = forms.renest(forms.flatten(subs, whole=True)).withColumnRenamed("form", "back")
    same = F.expr("to_json(try_parse_json(form)) = to_json(try_parse_json(back))")
    return paired(subs, back, ["submission_id"], "left").select("submission_id", F.coalesce(same, F.lit(False)).alias("same"))


@query("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS template, string_agg(concat('{"elements":{"Priority":{"value":"', o_orderpriority, '"},"Status":{"value":"', o_orderstatus, '"}}}'), ',' ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey)
  SELECT CAST(c_custkey AS VARCHAR) AS template, concat('{"elements":{"Name":{"value":"', c_name, '"},"Orders":{"items":[', coalesce(x, ''), ']},"Segment":{"value":"', c_mktsegment, '"}}}') AS form FROM customer LEFT JOIN o ON CAST(c_custkey AS VARCHAR) = o.template""")
def default_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form that a template's editor starts with."""
    from .tree_queries import customer_templates

    return tree.default_documents(tree.flatten(customer_templates(spark, sf_dir))).select("template", F.expr("to_json(try_parse_json(form))").alias("form"))
