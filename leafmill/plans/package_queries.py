"""Package queries: documents written as packages and archives, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..landing import dealt, land, paired
from ..operators import hydrate, tree
from ..sinks import packages as sink
from ..sinks import report
from ..sources import forms
from ..sources import packages as source
from .registry import SQL, query, table
from .tree_queries import customer_templates


@query(SQL["tree_flatten"])
def package_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's document as a package, unzipped, decoded and flattened: the nodes are those of the document."""
    docs = customer_templates(spark, sf_dir)
    files = docs.select(F.col("template").alias("package"), sink.package("doc", "template").alias("content"))
    found = source.objects(land(source.parts(files), "parts")).where("kind = 'submodel'")
    nodes = tree.flatten(found.select(F.col("package").alias("template"), "doc"))
    return nodes.select("template", "path", "parent_path", "role", F.col("depth").cast("long").alias("depth"), "model_type", tree.field("value").alias("value"))


@query("SELECT format, count(*) AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'aasx' WHEN 1 THEN 'json' END AS format FROM customer) WHERE format IS NOT NULL GROUP BY format")
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.when(F.col("template").cast("long") % 3 == 0, "aasx").when(F.col("template").cast("long") % 3 == 1, "json").otherwise("pdf")
    done = sink.export(customer_templates(spark, sf_dir).select("doc", F.col("template").alias("name"), form.alias("format")))
    return done.where("length(content) > 2").groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS batch, concat('/', p_type, '_', i, '.json') AS part FROM part, (VALUES (0), (1)) AS u(i)""")
def export_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files a request in one archive, listed by reading it."""
    part = table(spark, sf_dir, "part")
    files = part.select(F.col("p_partkey").cast("string").alias("batch"), "p_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"), F.encode(F.to_json(F.struct("p_name")), "UTF-8").alias("content"))
    named = files.select("batch", report.batch_name(F.col("p_type"), F.col("idx"), F.lit("json")).alias("filename"), "content")
    zips = sink.archive(named)
    return source.parts(zips.select(F.col("batch").alias("package"), F.col("archive").alias("content"))).select(F.col("package").alias("batch"), "part")


@query("SELECT c_custkey, 'BadZipFile' AS error FROM customer WHERE c_custkey % 2 = 0")
def package_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no archive becomes a row with an error."""
    odd = F.when(F.col("c_custkey") % 2 != 0, '{"elements":[]}')  # Python makes a package of every row that it gets, whatever is asked around it
    content = F.coalesce(sink.package(odd, "c_name"), F.encode("c_name", "UTF-8"))
    files = dealt(table(spark, sf_dir, "customer")).select(F.col("c_custkey").cast("string").alias("package"), content.alias("content"))
    bad = source.parts(files).where("error is not null")
    return bad.select(F.col("package").cast("long").alias("c_custkey"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


def _xml_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package, content): for each customer an XML part with an operation, a blob and a file, a concept, and the file."""
    name = F.replace(F.replace("c_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    prop = lambda id_: f"<property><idShort>{id_}</idShort><valueType>xs:string</valueType><value>"
    text = F.concat(
        F.lit('<environment xmlns="https://admin-shell.io/aas/3/0"><submodels><submodel><id>urn:s</id><idShort>S</idShort><submodelElements><operation><idShort>Op</idShort><inputVariables><operationVariable><value>' + prop("In")), name,
        F.lit("</value></property></value></operationVariable></inputVariables><outputVariables><operationVariable><value>" + prop("Out")), "c_mktsegment",
        F.lit("</value></property></value></operationVariable></outputVariables></operation><blob><idShort>Raw</idShort><value>"), F.base64(F.encode("c_name", "UTF-8")),
        F.lit("</value><contentType>text/plain</contentType></blob><file><idShort>Doc</idShort><value>../files/a.txt</value></file></submodelElements></submodel></submodels><conceptDescriptions><conceptDescription><id>urn:"), "c_mktsegment",
        F.lit("</id><idShort>C</idShort></conceptDescription></conceptDescriptions></environment>"),
    )
    files = F.array(F.struct(F.lit("aasx/data.xml").alias("filename"), F.encode(text, "UTF-8").alias("content")), F.struct(F.lit("files/a.txt").alias("filename"), F.encode("c_name", "UTF-8").alias("content")))
    each = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("batch"), F.explode(files).alias("f")).select("batch", "f.*")
    return sink.archive(each).select(F.col("batch").alias("package"), F.col("archive").alias("content"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS template, u.path, CASE u.path WHEN 'Op.In' THEN c_name WHEN 'Op.Out' THEN c_mktsegment WHEN 'Raw' THEN c_name WHEN 'Doc' THEN '/files/a.txt' END AS value FROM customer, (VALUES ('Op'), ('Op.In'), ('Op.Out'), ('Raw'), ('Doc')) AS u(path)""")
def package_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations, blobs and files out of XML packages, files by the names of the parts they stand for."""
    parts = land(source.parts(_xml_packages(spark, sf_dir)), "parts")
    nodes = tree.flatten(source.objects(parts).where("kind = 'submodel'").select(F.col("package").alias("template"), "doc"))
    stored = source.supplementary(nodes.withColumn("base", F.lit("/aasx/data.xml")), parts).select(F.col("package").alias("template"), "path", "stored")
    return paired(nodes, stored, ["template", "path"], "left").select("template", "path", F.coalesce("stored", tree.field("value")).alias("value"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS package, 'submodel' AS kind, 'urn:s' AS id, c_name AS held FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'concept', concat('urn:', c_mktsegment), NULL FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'part', '/files/a.txt', c_name FROM customer""")
def package_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packages read, written and read again: submodels, concepts and files are all there."""
    parts = land(source.parts(_xml_packages(spark, sf_dir)), "parts")
    again = land(source.parts(sink.packages(source.objects(parts), parts)), "parts")
    objects = source.objects(again).select("package", "kind", "id", F.get_json_object("doc", "$.elements[1].value").alias("held"))
    return objects.union(again.where("part = '/files/a.txt'").select("package", F.lit("part"), "part", F.decode("content", "UTF-8")))


@query("SELECT c_custkey, c_custkey % 3 < 2 AS ok, CASE WHEN c_custkey % 3 = 2 THEN 'unknown format' END AS error FROM customer")
def export_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of the export: all is made, nothing is kept."""
    form = F.when(F.col("template").cast("long") % 3 == 0, "aasx").when(F.col("template").cast("long") % 3 == 1, "json").otherwise("pdf")
    done = sink.verify(customer_templates(spark, sf_dir).select("template", "doc", F.col("template").alias("name"), form.alias("format")))
    return done.select(F.col("template").cast("long").alias("c_custkey"), "ok", "error")


@query(SQL["tree_flatten"])
def package_xml_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's document as an XML part that is made in DataFrame functions, zipped, read and flattened again."""
    docs = customer_templates(spark, sf_dir).select(F.col("template").alias("package"), F.lit("/made").alias("part"), F.lit(0).alias("ord"), F.lit("submodel").alias("kind"), F.concat(F.lit("urn:"), "template").alias("id"), F.lit(None).cast("string").alias("id_short"), "doc", "doc", F.lit(None).cast("string").alias("error"))
    found = land(docs.toDF("package", "part", "ord", "kind", "id", "id_short", "doc", "source", "error"), "made")
    none = source.parts(found.select("package", F.lit(b"").alias("content")).limit(0))
    again = source.objects(land(source.parts(sink.packages(found, none, "xml")), "parts")).where("kind = 'submodel'")
    nodes = tree.flatten(again.select(F.col("package").alias("template"), "doc"))
    return nodes.select("template", "path", "parent_path", "role", F.col("depth").cast("long").alias("depth"), "model_type", tree.field("value").alias("value"))


def _rich_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package, env, content): for each customer an environment with fields our trees do not know: chains of keys, ids of values and
    list elements, qualifiers with semantic ids, fields of no format."""
    name = F.regexp_replace(F.to_json(F.array("c_name")), r"^\[|\]$", "")
    chain = lambda *keys: '{"type":"ModelReference","keys":[' + ",".join('{"type":"%s","value":"%s"}' % k for k in keys) + "]}"
    two = chain(("Submodel", "urn:a"), ("Property", "p"))
    env = F.concat(
        F.lit('{"submodels":[{"modelType":"Submodel","id":"urn:s","semanticId":' + two + ',"own":{"k":[1,2.5]},"submodelElements":[{"idShort":"Name","modelType":"Property","valueType":"xs:string","valueId":' + two + ',"qualifiers":[{"type":"Q","valueType":"xs:string","value":"v","semanticId":' + two + '}],"value":'), name,
        F.lit('},{"idShort":"Link","modelType":"RelationshipElement","first":' + two + ',"second":' + two + '},{"idShort":"Ref","modelType":"ReferenceElement","value":' + two + '},{"idShort":"List","modelType":"SubmodelElementList","semanticIdListElement":' + two + ',"orderRelevant":false,"typeValueListElement":"Property","value":[{"modelType":"Property","valueType":"xs:double","value":"1.50"}]}]}],"conceptDescriptions":[{"modelType":"ConceptDescription","id":"urn:'), "c_mktsegment",
        F.lit('","isCaseOf":[' + two + "]}]}"),
    )
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("package"), env.alias("env"))
    files = base.select(F.col("package").alias("batch"), F.lit("aasx/data.json").alias("filename"), F.encode("env", "UTF-8").alias("content"))
    return paired(base, sink.archive(files).select(F.col("batch").alias("package"), F.col("archive").alias("content")), ["package"])


@query("SELECT c_custkey, true AS json_same, true AS xml_same FROM customer")
def package_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole stores written as JSON, and as XML, and read again: nothing that came is lost or changed."""
    packages = land(_rich_packages(spark, sf_dir), "packages")
    parts = land(source.parts(packages.select("package", "content")), "parts")
    found = land(source.objects(parts), "objects")
    as_xml = land(source.parts(sink.packages(found, parts, "xml")), "parts")
    plain = lambda c: F.expr(f"to_json(try_parse_json({c}))")  # noqa: E731  keys in order
    stores = paired(paired(packages, sink.stores(found).withColumnRenamed("env", "j"), ["package"]), sink.stores(source.objects(as_xml)).withColumnRenamed("env", "x"), ["package"])
    # XML has texts only: the numbers of a field of no format come back as such.
    texts = F.replace("env", F.lit('"k":[1,2.5]'), F.lit('"k":{"k":"2.5"}'))
    return stores.select(F.col("package").cast("long").alias("c_custkey"), (plain("env") == plain("j")).alias("json_same"), (F.expr("to_json(try_parse_json(x))") == F.to_json(F.try_parse_json(texts))).alias("xml_same"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'p' END AS last_key, 'urn:a' AS first_key, 'p' AS value_id, 'p' AS qualifier_id, '1.50' AS item FROM customer""")
def package_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms merged into packages that were read: what a form has is edited in place, all else is as it came."""
    packages = land(_rich_packages(spark, sf_dir), "packages")
    docs = land(source.objects(source.parts(packages.select("package", "content"))).where("kind = 'submodel'").select(F.col("package").alias("template"), "doc"), "objects")
    k, said = F.col("c_custkey"), F.regexp_replace(F.to_json(F.array("c_mktsegment")), r"^\[|\]$", "")
    form = F.concat(F.lit('{"elements":{'), F.concat_ws(",", F.when(k % 3 == 0, F.concat(F.lit('"Name":{"value":'), said, F.lit("}"))), F.when(k % 2 == 0, '"Ref":{"value":"new"}')), F.lit("}}"))
    subs = table(spark, sf_dir, "customer").select(k.cast("string").alias("submission_id"), k.cast("string").alias("template"), form.alias("form"))
    done = hydrate.to_documents(hydrate.merge(subs, tree.flatten(docs), forms.flatten(subs)))
    out = done.withColumn("j", sink.exchange_json("doc", "template").cast("string"))
    at = lambda p: F.get_json_object("j", f"$.submodels[0].submodelElements{p}")
    return out.select(F.col("submission_id").cast("long").alias("c_custkey"), at("[0].value").alias("name"), at("[2].value.keys[1].value").alias("last_key"), at("[2].value.keys[0].value").alias("first_key"), at("[0].valueId.keys[1].value").alias("value_id"), at("[0].qualifiers[0].semanticId.keys[1].value").alias("qualifier_id"), at("[3].value[0].value").alias("item"))
