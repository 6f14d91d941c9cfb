"""Catalog queries: search, lookup, order, versions, names, addresses, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from .registry import query, table


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(table(spark, sf_dir, "part"), "BOLT", name="p_name", title="p_type").select("p_partkey", "p_name", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'STANDARD' AND contains(lower(p_name), 'a')")
def catalog_number_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(table(spark, sf_dir, "part"), "A", "STANDARD", name="p_name", title="p_name", number_col="p_type").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042' LIMIT 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.get(table(spark, sf_dir, "customer"), "Customer#000000042", "c_name").select("c_custkey", "c_name")


@query("SELECT count(*) AS total FROM part WHERE contains(lower(p_name), 'bolt')")
def catalog_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search(table(spark, sf_dir, "part"), "bolt", name="p_name", title="p_name").agg(F.count(F.lit(1)).alias("total"))


@query("""SELECT p_partkey, p_type, idx FROM (SELECT p_partkey, p_type,
  row_number() OVER (PARTITION BY p_type ORDER BY coalesce(nullif(CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END, ''), '99999'), p_name, p_partkey) - 1 AS idx FROM part)""")
def catalog_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("number", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")))
    order = catalog.sort_key("number", "p_name", "p_name")[:2]
    return catalog.numbered(part, [*order, F.col("p_partkey")], ["p_type"]).select("p_partkey", "p_type", "idx")


_NAMES = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('IDTA ', lpad(CAST(p_partkey AS VARCHAR), 5, '0'), '-1-0_Submodel_', p_name) WHEN 2 THEN concat('A_B_', p_name, '_', p_brand) ELSE concat('IDTA ', p_size, '-2_', p_name) END AS name FROM part"


@query(f"""SELECT p_partkey, CASE WHEN starts_with(name, 'IDTA') THEN trim(split_part(replace(split_part(name, '_', 1), 'IDTA ', ''), '-', 1)) END AS idta_number,
  CASE WHEN len(s) > 2 THEN array_to_string(s[3:], '_') ELSE coalesce(s[2], s[1]) END AS title FROM (SELECT *, string_split(name, '_') AS s FROM ({_NAMES}))""")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    form, key = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    name = F.when(form == 0, F.col("p_name")).when(form == 1, F.concat(F.lit("IDTA "), F.lpad(key, 5, "0"), F.lit("-1-0_Submodel_"), "p_name"))
    name = name.when(form == 2, F.concat(F.lit("A_B_"), "p_name", F.lit("_"), "p_brand")).otherwise(F.concat(F.lit("IDTA "), F.col("p_size").cast("string"), F.lit("-2_"), "p_name"))
    return catalog.parse_names(part.select("p_partkey", name.alias("name"))).select("p_partkey", "idta_number", "title")


@query("SELECT p_type, max(p_brand) AS version FROM part GROUP BY p_type")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("template"), F.col("p_brand").alias("version"))
    return catalog.latest_version(part).select(F.col("template").alias("p_type"), "version")


@query("""SELECT template, version, row_number() OVER (PARTITION BY template ORDER BY version DESC) - 1 AS place_text,
  row_number() OVER (PARTITION BY template ORDER BY CAST(replace(version, 'Brand#', '') AS INTEGER) DESC) - 1 AS place_natural
  FROM (SELECT DISTINCT p_type AS template, p_brand AS version FROM part)""")
def version_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select(F.col("p_type").alias("template"), F.col("p_brand").alias("version")).distinct()
    by_text = catalog.numbered(entries, catalog.version_order(), ["template"]).withColumnRenamed("idx", "place_text")
    return catalog.numbered(by_text, catalog.version_order(natural=True), ["template"]).withColumnRenamed("idx", "place_natural")


@query("""SELECT template, directory, name, depth FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY depth, directory DESC, name DESC) AS r FROM (
  SELECT p_type AS template, p_brand AS directory, concat(p_name, '-', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '.AASX' WHEN p_partkey % 3 = 1 THEN '.aasx' ELSE '.pdf' END) AS name, p_size % 7 AS depth FROM part)
  WHERE depth <= 3 AND lower(name) LIKE '%.aasx') WHERE r = 1""")
def package_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".AASX").when(F.col("p_partkey") % 3 == 1, ".aasx").otherwise(".pdf")
    files = table(spark, sf_dir, "part").select(F.col("p_type").alias("template"), F.col("p_brand").alias("directory"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), suffix).alias("name"), (F.col("p_size") % 7).alias("depth"))
    return catalog.latest_file(files)


@query("SELECT host, min(page_id) AS page_id FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) GROUP BY host")
def first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return catalog.first_by(pages, ["host"], [F.col("page_id")]).select("host", "page_id")


@query("SELECT page_id, concat(md5(url), '.aasx') AS cache_name FROM pages")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.cache_file("url").alias("cache_name"))


@query("SELECT page_id, replace(url_encode(concat(url, ' ~*é')), '%2F', '/') AS quoted FROM pages")
def url_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_quote(F.concat("url", F.lit(" ~*é"))).alias("quoted"))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def ttl_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar().cast("timestamp")
    return catalog.fresh(events, "ts", now).select("event_id")


@query("SELECT count(*) FILTER (WHERE ts > m - INTERVAL 24 HOUR) AS hits, count(*) FILTER (WHERE ts <= m - INTERVAL 24 HOUR) AS cleared FROM events, (SELECT max(ts) AS m FROM events)")
def cache_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar().cast("timestamp")
    fresh = events.select(catalog.is_fresh("ts", now).alias("fresh"))
    return fresh.agg(F.count_if("fresh").alias("hits"), F.count_if(~F.col("fresh")).alias("cleared"))


@query("SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN concat('published/', r_name) ELSE r_name END AS path, r_name AS name, concat('/', replace(url_encode(CASE WHEN r_regionkey % 2 = 0 THEN concat('published/', r_name) ELSE r_name END), '%2F', '/')) AS url, r_name AS title FROM region WHERE r_regionkey <> 3")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    path = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("published/"), "r_name"))
    kind = F.when(F.col("r_regionkey") == 3, "file").when(F.col("r_regionkey") % 2 == 0, "dir").otherwise("other")
    content = F.when((F.col("r_regionkey") % 2 == 1) & (F.col("r_regionkey") != 3), "directory")
    items = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), kind.alias("type"), content.alias("contentType"), path.alias("path"), none.alias("html_url"), none.alias("sha"))
    return catalog.listing(items).select("path", "name", "url", "title")


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS existed FROM part WHERE p_partkey % 5 = 0")
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth part is asked to go from a cache that lacks every third."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    return catalog.invalidate(part.where("p_partkey % 3 <> 0"), part.where("p_partkey % 5 = 0"), "p_partkey")[1]


@query("SELECT count(*) AS n FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def cache_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    return catalog.invalidate(part.where("p_partkey % 3 <> 0"), part.where("p_partkey % 5 = 0"), "p_partkey")[0].agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), r AS (SELECT DISTINCT CASE page_id % 4 WHEN 1 THEN host WHEN 2 THEN 'Submodel ' || host END AS root FROM i WHERE page_id % 4 IN (1, 2))
  SELECT root AS name, concat('published/', root) AS path, concat('https://x/tree/', replace(url_encode(concat('published/', root)), '%2F', '/')) AS url FROM r""")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page's entries to templates: roots from paths or names, files and entries without a root left out, each root once."""
    host, k = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)), F.col("page_id") % 4
    items = table(spark, sf_dir, "pages").select(
        "page_id", F.when(k == 1, F.concat(host, F.lit("/1/0"))).when(k == 2, "ignored").when(k == 3, "").otherwise(host).alias("name"),
        F.when(k == 2, F.concat(F.lit("published/Submodel "), host, F.lit("/2"))).when(k == 1, F.concat(F.lit("other/"), host)).alias("path"), F.when(k == 0, "file").otherwise("directory").alias("content_type"),
    )
    return catalog.page_roots(items, "https://x/tree/", [F.col("page_id")]).select("name", "path", "url")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('p', page_id, '.aasx') WHEN 1 THEN concat('q ', page_id, '.json') END AS filename FROM pages""")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names out of download headers."""
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    header = F.when(k == 0, F.concat(F.lit("attachment; filename=p"), n, F.lit(".aasx"))).when(k == 1, F.concat(F.lit('attachment; filename="q '), n, F.lit('.json"'))).otherwise("inline")
    return table(spark, sf_dir, "pages").select("page_id", text.disposition_name(header).alias("filename"))
