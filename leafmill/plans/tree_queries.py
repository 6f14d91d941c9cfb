"""Tree queries, over one template a customer: two properties and the list of the customer's orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, tree
from ..sinks import report
from .registry import query, table


def _prop(name: str, value, kind: str = "xs:string", **more):
    fields = {"idShort": F.lit(name), "modelType": F.lit("Property"), "valueType": F.lit(kind), "value": value, **{k: F.lit(v) for k, v in more.items()}}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def customer_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(template, doc): a document holds one customer's orders, in order of their keys."""
    items = F.struct(F.lit("SubmodelElementCollection").alias("modelType"), F.array(_prop("Status", F.col("o_orderstatus")), _prop("Priority", F.col("o_orderpriority"))).alias("elements"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", items.alias("x")))).alias("o"))
    both = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    listed = F.coalesce(F.transform("o", lambda o: F.to_json(o["x"])), F.array().cast("array<string>"))
    lists = F.concat(F.lit('{"idShort":"Orders","modelType":"SubmodelElementList","cardinality":"[1..*]","typeValueListElement":"SubmodelElementCollection","items":['), F.array_join(listed, ","), F.lit("]}"))
    name, segment = F.to_json(_prop("Name", F.col("c_name"), cardinality="[1]", semanticLabel="Customer")), F.to_json(_prop("Segment", F.col("c_mktsegment"), unit="seg"))
    doc = F.concat(F.lit('{"elements":['), name, F.lit(","), segment, F.lit(","), lists, F.lit("]}"))
    return both.select(F.col("c_custkey").cast("string").alias("template"), doc.alias("doc"))


_ITEMS = "SELECT CAST(o_custkey AS VARCHAR) AS template, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"""WITH o AS ({_ITEMS}), c AS (SELECT CAST(c_custkey AS VARCHAR) AS template, c_name, c_mktsegment FROM customer)
  SELECT template, 'Name' AS path, '' AS parent_path, 'elements' AS role, CAST(0 AS BIGINT) AS depth, 'Property' AS model_type, c_name AS value FROM c UNION ALL SELECT template, 'Segment', '', 'elements', 0, 'Property', c_mktsegment FROM c
  UNION ALL SELECT template, 'Orders', '', 'elements', 0, 'SubmodelElementList', NULL FROM c UNION ALL SELECT template, concat('Orders[', i, ']'), 'Orders', 'items', 1, 'SubmodelElementCollection', NULL FROM o
  UNION ALL SELECT template, concat('Orders[', i, '].Status'), concat('Orders[', i, ']'), 'elements', 2, 'Property', o_orderstatus FROM o UNION ALL SELECT template, concat('Orders[', i, '].Priority'), concat('Orders[', i, ']'), 'elements', 2, 'Property', o_orderpriority FROM o""")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.flatten(customer_templates(spark, sf_dir))
    return nodes.select("template", "path", "parent_path", "role", F.col("depth").cast("long").alias("depth"), "model_type", tree.field("value").alias("value"))


@query(f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS template, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)
  SELECT template, 'Name' AS path, 'Customer' AS semantic_label, '[1]' AS cardinality, CAST(NULL AS VARCHAR) AS list_type, CAST(NULL AS BIGINT) AS item_count FROM c
  UNION ALL SELECT template, 'Segment', NULL, '[1]', NULL, NULL FROM c UNION ALL SELECT template, 'Orders', NULL, '[1..*]', 'SubmodelElementCollection', n FROM c""")
def tree_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = tree.previewed(customer_templates(spark, sf_dir))
    return shown.select("template", "path", "semantic_label", "cardinality", "list_type", F.col("item_count").cast("long").alias("item_count"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS template, CAST(3 AS BIGINT) AS n_elements, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_items FROM customer""")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tree.child_counts(tree.flatten(customer_templates(spark, sf_dir)))
    return counts.groupBy("template").agg(F.sum(F.when(F.col("parent_path") == "", F.col("n"))).alias("n_elements"), F.coalesce(F.sum(F.when(F.col("parent_path") == "Orders", F.col("n"))), F.lit(0)).alias("n_items"))


@query(f"""WITH o AS (SELECT template, string_agg(concat(o_orderstatus, '/', o_orderpriority), ',' ORDER BY i) AS orders FROM ({_ITEMS}) GROUP BY template)
  SELECT CAST(c_custkey AS VARCHAR) AS template, c_name AS name, c_mktsegment AS segment, coalesce(o.orders, '') AS orders FROM customer LEFT JOIN o ON CAST(c_custkey AS VARCHAR) = o.template""")
def tree_renest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken apart and put together again, then read."""
    docs = tree.renest(tree.flatten(customer_templates(spark, sf_dir)))
    item = lambda x: F.concat(F.get_json_object(x, "$.elements[0].value"), F.lit("/"), F.get_json_object(x, "$.elements[1].value"))
    orders = F.transform(F.from_json(F.get_json_object("doc", "$.elements[2].items"), "array<string>"), item)
    return docs.select("template", F.get_json_object("doc", "$.elements[0].value").alias("name"), F.get_json_object("doc", "$.elements[1].value").alias("segment"), F.array_join(orders, ",").alias("orders"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS template, u.p AS schema_path FROM customer, unnest(CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN ['Name', 'Segment', 'Orders', 'Orders[]', 'Orders[].Status', 'Orders[].Priority'] ELSE ['Name', 'Segment', 'Orders'] END) AS u(p)""")
def item_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that describe: a list's first item stands for all."""
    return tree.schema_paths(tree.flatten(customer_templates(spark, sf_dir))).select("template", "schema_path")


@query(f"""WITH o AS ({_ITEMS}) SELECT CAST(c_custkey AS VARCHAR) AS template, u.p AS path, CASE u.p WHEN 'Name' THEN c_name WHEN 'Segment' THEN c_mktsegment END AS value FROM customer, (VALUES ('Name'), ('Segment'), ('Orders')) AS u(p)
  UNION ALL SELECT template, concat('Orders[', i, ']', u.p), CASE u.p WHEN '.Status' THEN o_orderstatus WHEN '.Priority' THEN o_orderpriority END FROM o, (VALUES (''), ('.Status'), ('.Priority')) AS u(p)""")
def form_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.default_form(tree.flatten(customer_templates(spark, sf_dir))).select("template", "path", "value")


@query(f"""WITH o AS ({_ITEMS}), c AS (SELECT CAST(c_custkey AS VARCHAR) AS template, * FROM customer)
  SELECT template, 'Name' AS path, 'Customer' AS label, c_name AS shown FROM c UNION ALL SELECT template, 'Segment', 'Segment', concat(c_mktsegment, ' seg') FROM c UNION ALL SELECT template, 'Orders', 'Orders', NULL FROM c
  UNION ALL SELECT template, concat('Orders[', i, ']'), concat('Item ', i + 1), NULL FROM o UNION ALL SELECT template, concat('Orders[', i, '].Status'), 'Status', o_orderstatus FROM o UNION ALL SELECT template, concat('Orders[', i, '].Priority'), 'Priority', o_orderpriority FROM o""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rows(tree.flatten(customer_templates(spark, sf_dir))).select("template", "path", "label", "shown")


@query("SELECT p_partkey, concat(p_type, '_', row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1, CASE p_size % 3 WHEN 0 THEN '.json' ELSE '.aasx' END) AS filename FROM (SELECT *, p_size % 3 AS k FROM part)  WHERE k < 3")
def batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default names in a batch: the template, the 0-based place of the request, the format."""
    numbered = catalog.numbered(table(spark, sf_dir, "part"), [F.col("p_partkey")], ["p_type"])
    form = F.when(F.col("p_size") % 3 == 0, "json").otherwise("aasx")
    return numbered.select("p_partkey", report.batch_name(F.col("p_type"), F.col("idx"), form).alias("filename"))


@query("SELECT p_partkey, p_name AS label, concat(p_size, ' mm') AS shown FROM part WHERE p_partkey % 7 > 0 UNION ALL SELECT p_partkey, p_brand, '—' FROM part WHERE p_partkey % 7 = 0")
def report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.col("p_partkey") % 7 == 0
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(blank, "").otherwise(F.col("p_name")).alias("semantic"), "p_brand", F.when(~blank, F.col("p_size").cast("string")).alias("v"))
    return part.select("p_partkey", text.label("semantic", "p_brand").alias("label"), report.shown(F.col("v"), F.lit("mm")).alias("shown"))
