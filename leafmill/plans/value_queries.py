"""Value queries: conformance, coercion, datatypes, cardinalities, references, namespaces, page fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cardinality, lists, references, text, values, xsd
from ..operators import tree
from ..operators import validate
from .registry import query, table

# How texts that are hard to read as numbers are made from the part table, in both languages.
_RAW_SQL = """CASE p_size % 10 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN concat(' ', p_size, ' ') WHEN 2 THEN concat(p_size, '.7') WHEN 3 THEN concat(p_size, 'd') WHEN 4 THEN '1_000'
  WHEN 5 THEN 'nan' WHEN 6 THEN 'inf' WHEN 7 THEN concat(p_size, 'e1') WHEN 8 THEN concat('0x', p_size) ELSE concat(p_size, '.0') END"""
_NUMBER = r"regexp_matches(trim(raw), '^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+)?)?|\.[0-9]+)([eE][+-]?[0-9]+)?$')"
_DOUBLE = "TRY_CAST(replace(trim(raw), '_', '') AS DOUBLE)"


def _raw() -> Column:
    size = F.col("p_size").cast("string")
    made = (size, F.concat(F.lit(" "), size, F.lit(" ")), F.concat(size, F.lit(".7")), F.concat(size, F.lit("d")), F.lit("1_000"), F.lit("nan"), F.lit("inf"), F.concat(size, F.lit("e1")), F.concat(F.lit("0x"), size), F.concat(size, F.lit(".0")))
    return F.element_at(F.array(*made), (F.col("p_size") % 10 + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", _raw().alias("raw"))


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {_RAW_SQL} AS raw FROM part) WHERE {_NUMBER} AND {_DOUBLE} = floor({_DOUBLE})")
def conformance_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).where(values.conforms("raw", F.lit("xs:int"))).select("p_partkey")


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {_RAW_SQL} AS raw FROM part) WHERE {_NUMBER} OR raw IN ('nan', 'inf')")
def conformance_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).where(values.conforms("raw", F.lit("xs:double"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size % 6 IN (0, 1, 2, 3)")
def conformance_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("TRUE", "Yes", "0", "no", "t", "on"))), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").where(values.conforms(raw, F.lit("xs:boolean"))).select("p_partkey")


_DATES_SQL = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(o_orderdate, '%Y-02-30') END"""


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-'02-30'")
    raw = F.element_at(F.array(*[F.date_format("o_orderdate", k) for k in kinds]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 < 2")
def conformance_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).where(values.conforms("raw", F.lit("xs:date"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)")
def conformance_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).where(values.conforms("raw", F.lit("xs:dateTime"))).select("o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE {_DATES_SQL} END AS value FROM orders")
def coerce_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir).select("o_orderkey", values.coerced_text("raw", F.lit("xs:date")).alias("value"))


@query(f"""SELECT p_partkey, CASE WHEN {_NUMBER} THEN CAST(trunc({_DOUBLE}) AS BIGINT) END AS as_long, CASE WHEN NOT {_NUMBER} THEN raw END AS as_text, raw <> 'inf' AS ok
  FROM (SELECT p_partkey, {_RAW_SQL} AS raw FROM part)""")
def coerce_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = values.coerce("raw", F.lit("xs:integer"))
    return _parts(spark, sf_dir).select("p_partkey", c["long"].alias("as_long"), c["text"].alias("as_text"), c["ok"].alias("ok"))


@query("SELECT p_partkey, p_size % 3 = 0 AS as_bool FROM part")
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("Yes", "no", "maybe"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", values.coerce(raw, F.lit("xs:boolean"))["bool"].alias("as_bool"))


_XSD_NAMES = [f"xs:{k}" for k in xsd.INPUT] + ["xs:unknown"]
# By the names' own words and the sizes of the machine types, not from the library's table.
@query(f"""WITH n AS (SELECT p_partkey, replace(([{", ".join(f"'{n}'" for n in _XSD_NAMES)}])[p_partkey % 44 + 1], 'xs:', '') AS t FROM part),
  k AS (SELECT *, starts_with(t, 'unsigned') AS u, CASE lower(replace(t, 'unsigned', '')) WHEN 'byte' THEN 8 WHEN 'short' THEN 16 WHEN 'int' THEN 32 WHEN 'long' THEN 64 END AS bits FROM n),
  m AS (SELECT *, bits IS NOT NULL OR contains(lower(t), 'integer') AS whole, t IN ('decimal', 'float', 'double') AS part FROM k)
  SELECT p_partkey, CASE WHEN whole OR part OR t IN ('gYear', 'gMonth', 'gDay') THEN 'number' ELSE coalesce(CASE t WHEN 'boolean' THEN 'checkbox' WHEN 'dateTime' THEN 'datetime-local' WHEN 'gYearMonth' THEN 'month' WHEN 'anyURI' THEN 'url'
    WHEN 'base64Binary' THEN 'file' WHEN 'date' THEN 'date' WHEN 'time' THEN 'time' END, 'text') END AS input_type, CASE WHEN whole THEN '1' WHEN part THEN 'any' END AS step,
  CAST(CASE WHEN bits < 64 THEN CASE WHEN u THEN 0 ELSE -(2 ** (bits - 1)) END WHEN t = 'nonNegativeInteger' THEN 0 WHEN t = 'positiveInteger' THEN 1 END AS BIGINT) AS lo,
  CAST(CASE WHEN bits < 64 THEN 2 ** (bits - CASE WHEN u THEN 0 ELSE 1 END) - 1 WHEN t = 'negativeInteger' THEN -1 WHEN t = 'nonPositiveInteger' THEN 0 END AS BIGINT) AS hi FROM m""")
def xsd_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, _XSD_NAMES)), (F.col("p_partkey") % len(_XSD_NAMES) + 1).cast("int"))
    typed = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.replace(names, F.lit("xs:"), F.lit("xsd:"))).alias("value_type"))
    return xsd.enrich(typed).select("p_partkey", "input_type", "step", F.col("min").cast("long").alias("lo"), F.col("max").cast("long").alias("hi"))


@query("""SELECT p_partkey, card, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM part JOIN (VALUES
  (0, '[0..1]', 0, 1), (1, '[0..*]', 0, NULL), (2, '[1..*]', 1, NULL), (3, '[3]', 3, 3), (4, '[2..5]', 2, 5), (5, NULL, 1, 1), (6, 'weird', 1, 1), (7, '[0]', 0, 0), (8, '[1..*]', 1, NULL)) AS t(k, card, lo, hi) ON p_size % 9 = k""")
def cardinality_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("0..1", "ZeroToMany", "OneToMany", "3", "[2..5]", "", "weird", "Zero", " [1..*] "))), (F.col("p_size") % 9 + 1).cast("int"))
    b = cardinality.bounds(raw)
    return table(spark, sf_dir, "part").select("p_partkey", cardinality.normalize(raw).alias("card"), b["min"].cast("long").alias("lo"), b["max"].cast("long").alias("hi"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '[1..*]' WHEN 1 THEN '[0..1]' ELSE '[1]' END AS card FROM part")
def cardinality_from_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cardinality qualifier that is not blank decides."""
    one = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    size = F.col("p_size") % 3
    first = F.when(size == 0, "OneToMany").when(size == 1, " ").otherwise("")
    second = F.when(size == 1, "0..1")
    listed = F.array(one("Other", F.col("p_brand")), one("Multiplicity", first), one("SMT/Cardinality", second))
    return table(spark, sf_dir, "part").select("p_partkey", cardinality.from_qualifiers(listed).alias("card"))


@query("SELECT page_id, page_id % 4 < 2 AS valid FROM pages")
def reference_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("page_id") % 4
    raw = F.when(form == 0, F.col("url")).when(form == 1, "0173-1#02-AAO677#002").when(form == 2, F.concat(F.lit("ftp://"), "url")).otherwise("0173-1#02-aao677#002")
    return table(spark, sf_dir, "pages").select("page_id", references.is_valid(raw).alias("valid"))


@query("""SELECT page_id, array_to_string(list_append(s[:len(s) - 1], 'new'), '|') AS rebuilt, s[1] AS shown FROM (SELECT page_id, string_split(url, '/') AS s FROM pages)""")
def reference_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.transform(F.split("url", "/", -1), lambda x: F.struct(F.lit("GlobalReference").alias("type"), x.alias("value")))
    pages = table(spark, sf_dir, "pages").select("page_id", keys.alias("keys"))
    new = F.array_join(F.transform(references.rebuilt("keys", F.lit("new")), lambda k: k["value"]), "|")
    return pages.select("page_id", new.alias("rebuilt"), references.first_value("keys").alias("shown"))


@query("""SELECT page_id, page_id % 3 < 2 AS absolute, CASE WHEN page_id % 5 = 0 THEN replace(url, 'http', 'https') ELSE url END AS rewritten FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'https', 'http') ELSE replace(url, 'http:', 'https:') END AS url FROM pages)""")
def uri_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute addresses told from package parts; one prefix for another only where the other does not occur."""
    pages = table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.replace("url", F.lit("https"), F.lit("http"))).otherwise(F.replace("url", F.lit("http:"), F.lit("https:"))))
    form = F.col("page_id") % 3
    path = F.when(form == 0, F.col("url")).when(form == 1, F.concat(F.lit("//"), F.split_part("url", F.lit("//"), F.lit(2)))).otherwise(F.concat(F.lit("/"), F.col("url")))
    return pages.select("page_id", text.is_absolute_uri(path).alias("absolute"), text.rewrite_namespace("url", "http", "https").alias("rewritten"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tree.field("k", "props").alias("k"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '') AS title FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.html_title("html").alias("title"))


@query("SELECT page_id, i AS ord, concat('item', i) AS name FROM pages, unnest(range(0, page_id % 4)) AS u(i)")
def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing embedded as JSON in a page's script element, exploded; pages without one give no rows."""
    names = F.transform(F.sequence(F.lit(1), F.greatest(F.col("page_id") % 4, F.lit(1))), lambda i: F.struct(F.concat(F.lit("item"), (i - 1).cast("string")).alias("name")))
    tree = F.to_json(F.struct(F.struct(F.struct(names.alias("items")).alias("tree")).alias("payload")))
    page = F.concat("html", F.when(F.col("page_id") % 4 > 0, F.concat(F.lit('<script type="application/json" data-target="react-app.embeddedData">'), tree, F.lit("</script>"))).otherwise(""))
    json = F.get_json_object(text.embedded_json(page), "$.payload.tree.items")
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.from_json(json, "array<struct<name:string>>")).alias("ord", "x"))
    return each.select("page_id", F.col("ord").cast("long").alias("ord"), "x.name")


@query("SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '.AASX' ELSE '.aasx' END AS filename, doc_id % 3 > 0 AND n_chars <= 5000 AS success, CASE WHEN doc_id % 3 = 0 THEN 'File must be an .aasx file' WHEN n_chars > 5000 THEN 'File is too large' END AS error FROM documents")
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "documents").withColumn("filename", F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".AASX").otherwise(".aasx")))
    return validate.gate_uploads(uploads, "filename", F.col("n_chars"), 5000).select("doc_id", "filename", "success", "error")


@query("""SELECT p_partkey, p_size % 6 IN (1, 2) AS required, p_size % 6 IN (0, 2, 3, 4) AS many, CASE WHEN p_size % 6 IN (1, 2) THEN 1 ELSE 0 END AS least, CASE WHEN p_size % 6 IN (0, 1) THEN 1 END AS most FROM part""")
def client_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a form's client reads cardinalities: other notations than four are 0 to no limit."""
    raw = F.element_at(F.array(*map(F.lit, ("[0..1]", "One", "OneToMany", "0..*", "[2..5]", "odd"))), (F.col("p_size") % 6 + 1).cast("int"))
    b = cardinality.client_bounds(raw)
    return table(spark, sf_dir, "part").select("p_partkey", b["required"].alias("required"), b["many"].alias("many"), b["min"].alias("least"), b["max"].alias("most"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN '1' WHEN p_size % 3 = 2 THEN 'any' END AS step, CASE p_size % 3 WHEN 0 THEN -128 WHEN 1 THEN 0 END AS lo FROM part WHERE p_size % 4 > 0
  UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size % 4 = 0""")
def input_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step and bounds, for number inputs only."""
    number = F.element_at(F.array(*map(F.lit, ("xs:byte", "xsd:nonNegativeInteger", "xs:double"))), (F.col("p_size") % 3 + 1).cast("int"))
    a = xsd.input_attributes(F.when(F.col("p_size") % 4 == 0, "xs:string").otherwise(number))
    return table(spark, sf_dir, "part").select("p_partkey", a["step"].alias("step"), a["min"].cast("int").alias("lo"))


@query("""WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS l, max(conv_id % 4) AS k FROM conversations GROUP BY conv_id)
  SELECT conv_id, array_to_string(CASE WHEN len(l) < 6 THEN list_append(l, -1) ELSE l END, ',') AS added, array_to_string(CASE WHEN len(l) > 2 AND k < len(l) THEN list_concat(l[1:k], l[k + 2:]) ELSE l END, ',') AS removed,
  array_to_string(CASE WHEN k < len(l) THEN list_concat([l[k + 1]], list_concat(l[1:k], l[k + 2:])) ELSE l END, ',') AS moved FROM t""")
def list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as a form's list of 2 to 6 items: one more, one less, one moved to the front."""
    of = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("long"))).alias("l"))
    items, at = F.col("l"), (F.col("conv_id") % 4).cast("int")
    edits = {"added": lists.added(items, F.lit(-1).cast("long"), F.lit(6)), "removed": lists.removed(items, at, F.lit(2)), "moved": lists.moved(items, at, F.lit(0))}
    return of.select("conv_id", *(F.array_join(v.cast("array<string>"), ",").alias(k) for k, v in edits.items()))
