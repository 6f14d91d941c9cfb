"""Queries over language maps and a dictionary of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, text
from ..operators import dictionary, hydrate
from .registry import query, table


def _entries(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("lang"), v.alias("text")) for k, v in pairs])


# A dictionary of the brands and types: a third of the types are found by id_short, brands by id.
_CONCEPTS_SQL = """SELECT row_number() OVER (ORDER BY k) AS cd_ord, * FROM (
  SELECT DISTINCT concat('urn:', p_brand) AS id, p_brand AS id_short, p_brand AS k FROM part UNION ALL SELECT DISTINCT concat('urn:', p_type), p_type, concat('Z', p_type) FROM part WHERE p_type <> 'PROMO')"""


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    each = part.select(F.concat(F.lit("urn:"), "p_brand").alias("id"), F.col("p_brand").alias("id_short"), F.col("p_brand").alias("cd_ord"))
    kinds = part.where("p_type <> 'PROMO'").select(F.concat(F.lit("urn:"), "p_type").alias("id"), F.col("p_type").alias("id_short"), F.concat(F.lit("Z"), "p_type").alias("cd_ord"))
    out = each.union(kinds).distinct()
    is_brand = F.startswith("id_short", F.lit("Brand"))
    return out.select(
        "id", "id_short", "cd_ord",
        _entries(("de", F.when(is_brand, F.concat(F.lit("Marke "), "id_short"))), ("fr", F.concat(F.lit("fr "), "id_short"))).alias("preferred_name"),
        _entries(("en", F.concat(F.lit("Name "), "id_short"))).alias("display_name"),
        _entries(("en", F.when(is_brand, F.concat(F.lit("Definition of "), "id_short")))).alias("definition"),
        _entries(("it", F.concat(F.lit("About "), "id_short"))).alias("description"),
        F.when(is_brand, "kg").otherwise("mm").alias("unit"),
    )


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with two keys: the type's id_short, then the brand's id; every fifth has a description of its own."""
    keys = F.array(F.struct(F.lit("GlobalReference").alias("type"), F.col("p_type").alias("value")), F.struct(F.lit("GlobalReference").alias("type"), F.concat(F.lit("urn:"), "p_brand").alias("value")))
    own = _entries(("en", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Own "), "p_name"))))
    kind = F.when(F.col("p_partkey") % 2 == 0, "ModelReference").otherwise("ExternalReference")
    return table(spark, sf_dir, "part").select("p_partkey", keys.alias("semantic_keys"), own.alias("description"), kind.alias("semantic_ref_kind"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type END AS concept FROM part")
def dictionary_multikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary.match_keys(_elements(spark, sf_dir), _concepts(spark, sf_dir), ["p_partkey"])
    return found.select("p_partkey", F.col("cd.id_short").alias("concept"))


@query("""SELECT p_partkey, CASE WHEN b THEN concat('Marke ', c) ELSE concat('fr ', c) END AS semantic_label,
  CASE WHEN p_partkey % 5 = 0 THEN concat('Own ', p_name) WHEN b THEN concat('Definition of ', c) ELSE concat('About ', c) END AS semantic_description,
  CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN b THEN 'kg' ELSE 'mm' END END AS unit
  FROM (SELECT p_partkey, p_name, p_type = 'PROMO' AS b, CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type END AS c FROM part)""")
def dictionary_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dictionary.enrich(_elements(spark, sf_dir), _concepts(spark, sf_dir), ["p_partkey"])
    return out.select("p_partkey", "semantic_label", "semantic_description", "unit")


@query("""SELECT request, arg_min(id, n) AS concept FROM (SELECT DISTINCT o_orderpriority AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 9 ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END AS n FROM orders) c
  JOIN (VALUES ('URGENT'), (' HIGH '), ('T'), ('SPECIFIED'), ('none')) AS r(request) ON ends_with(c.id, trim(request)) GROUP BY request""")
def dictionary_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.left("o_orderpriority", F.lit(1)).cast("int")
    cds = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("id"), F.lit("-").alias("id_short"), F.when(rank == 1, 9).otherwise(rank).alias("cd_ord")).distinct()
    asked = spark.createDataFrame([(x,) for x in ("URGENT", " HIGH ", "T", "SPECIFIED", "none")], "semantic_id string")
    return dictionary.lookup(asked, cds).select("request", F.col("cd.id").alias("concept"))


@query("SELECT s_suppkey, concat(n_name, ' / ', r_name) AS label, CASE WHEN s_nationkey % 3 = 0 THEN r_name ELSE n_name END AS shown FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def label_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimension joins; a blank label falls back to the next."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    semantic = F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.col("n_name"))
    return out.select("s_suppkey", F.concat("n_name", F.lit(" / "), "r_name").alias("label"), text.label(semantic, "r_name").alias("shown"))


_PICK = "SELECT source, arg_min(CASE WHEN n_chars % 4 = 0 THEN '' ELSE concat(lang, n_chars) END, doc_id) AS t, lang FROM documents GROUP BY source, lang"


@query(f"""SELECT source, coalesce(max(nullif(t, '')) FILTER (WHERE lang = 'en'), max(nullif(t, '')) FILTER (WHERE lang = 'de'), arg_min(nullif(t, ''), lang) FILTER (WHERE t <> '')) AS picked,
  count(*) FILTER (WHERE t <> '') AS filled FROM ({_PICK}) GROUP BY source""")
def language_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language map for each source: at most one entry a language, however many documents there are."""
    docs = table(spark, sf_dir, "documents")
    said = F.when(F.col("n_chars") % 4 == 0, "").otherwise(F.concat("lang", F.col("n_chars").cast("string")))
    one = docs.groupBy("source", "lang").agg(F.min_by(said, "doc_id").alias("text"))
    maps = one.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("lang", "text"))).alias("entries"))
    return maps.select("source", language.pick("entries").alias("picked"), language.filled("entries").cast("long").alias("filled"))


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN 'Property' WHEN 'error' THEN 'BasicEventElement' WHEN 'view' THEN 'File' ELSE 'Capability' END AS model_type, count(*) AS n FROM events GROUP BY event_type")
def kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "Property").when(F.col("event_type") == "error", "BasicEventElement").when(F.col("event_type") == "view", "File").otherwise("Capability")
    made = F.get_json_object(hydrate.prototype(kind, F.lit("xs:string")), "$.modelType")  # null for kinds that cannot be made
    return table(spark, sf_dir, "events").groupBy("event_type", F.coalesce(made, kind).alias("model_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT request, found, label FROM (SELECT DISTINCT p_type AS request, p_type <> 'PROMO' AS found, CASE WHEN p_type <> 'PROMO' THEN concat('fr ', p_type) END AS label FROM part
  UNION ALL SELECT DISTINCT concat(' urn:', p_brand), true, concat('fr ', p_brand) FROM part UNION ALL SELECT 'none of them', false, NULL)""")
def concept_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts asked for by id, end of id, or short id, as JSON records."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_type").alias("semantic_id")).union(part.select(F.concat(F.lit(" urn:"), "p_brand"))).union(spark.createDataFrame([("none of them",)], "s string"))
    return dictionary.record(asked, _concepts(spark, sf_dir)).select("request", "found", F.get_json_object("record", "$.preferredName.fr").alias("label"))
