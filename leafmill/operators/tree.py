"""Trees as rows: flatten, preview, re-nest.

A template is a JSON document whose nodes hold ordered children under role keys. ``flatten`` makes one row a node, level by
level: each step takes the children of one level of all documents apart, and carries on only nodes that have some.
Schemas cannot recurse, so a node's own fields stay JSON and are read by column functions.

A node has two typed labels beside its path, which is text to show and may be ambiguous. ``sort`` is its place: (role, ord)
a level, so labels are unique, sort in pre-order, and start with the labels of all ancestors. ``steps`` are what forms
know it by: a name or a place a level, told apart by their first character, whatever characters a name has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cardinality
from ..landing import dealt, land, paired, walk

#: The keys that hold children.
ROLES = ("elements", "items", "statements", "annotations", "inputVariables", "outputVariables", "inoutputVariables")
COLLECTION, LIST, ENTITY = "SubmodelElementCollection", "SubmodelElementList", "Entity"
ITEM_TEMPLATE = 99
#: What is no JSON, or beyond what its parser takes (1,000 nested values, the bytes of one variant, a key twice).
UNREADABLE = "ValueError: no JSON document, or one that is too deep or too large"

PLACE = "struct<role: int, ord: int>"
_KID = f"struct<role: string, ord: int, place: {PLACE}, name: string, v: variant, error: string>"
_CHILD = """transform(coalesce(try_cast(try_element_at(m, '{role}') AS array<variant>), array()), (x, i) -> named_struct('role', '{role}', 'ord', i,
  'place', named_struct('role', {k}, 'ord', i), 'name', try_variant_get(x, '$.idShort', 'string'), 'v', x, 'error', CAST(NULL AS STRING)))"""
_TEMPLATE = f"""array(named_struct('role', 'itemTemplate', 'ord', 0, 'place', named_struct('role', {ITEM_TEMPLATE}, 'ord', 0), 'name', CAST(NULL AS STRING),
  'v', try_element_at(m, 'itemTemplate'), 'error', CAST(NULL AS STRING)))"""
_MAP = "coalesce(try_cast(v AS map<string, variant>), map())"
# By the role: an item's place, a name, or, without one, the place.
_STEP = """CASE c.role WHEN 'items' THEN concat('[', c.ord) WHEN 'itemTemplate' THEN '[' WHEN 'annotations' THEN concat('@', c.ord)
  WHEN 'elements' THEN coalesce(concat('.', c.name), concat('#', c.ord)) WHEN 'statements' THEN coalesce(concat(':', c.name), concat(';', c.ord)) ELSE concat('<', c.place.role, '<', c.ord) END"""
_PATH = """CASE WHEN c.role = 'items' THEN concat(path, '[', c.ord, ']') WHEN c.role = 'itemTemplate' THEN concat(path, '[]')
  WHEN path = '' THEN coalesce(c.name, concat('[', c.ord, ']')) ELSE concat(path, '.', coalesce(c.name, concat('[', c.ord, ']'))) END"""


def _kids(roles: tuple[str, ...]) -> str:
    """The children of the map ``m``, as an array; null ones are left out."""
    parts = [_CHILD.format(role=r, k=k) for k, r in enumerate(ROLES) if r in roles] + ([_TEMPLATE] if "items" in roles else [])
    return f"filter(concat({', '.join(parts)}), x -> x.v IS NOT NULL AND NOT is_variant_null(x.v))"


def _there(role: str) -> str:
    return f"size(filter(coalesce(try_cast(try_element_at(m, '{role}') AS array<variant>), array()), x -> x IS NOT NULL AND NOT is_variant_null(x)))"


def flatten(templates: DataFrame, depth: int | None = None, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """From (template, doc): template, path, parent_path, parent_kind, role, ord, depth, sort and steps (see above),
    shown (reached through collections only), walked (through collections and lists only), id_short,
    model_type, own (the node's JSON without its children; ``node`` is the same), n_elements and n_items (its children), error.

    Null children and null or blank documents are left out; a document that cannot be read is one row with an ``error`` and
    nothing else. ``depth`` and ``roles`` end the walk early: below that depth, and under other roles, nothing is read."""
    src = dealt(templates.select(F.col("template").cast("string").alias("template"), F.col("doc").cast("string").alias("doc"))).withColumn("v", F.expr("try_parse_json(doc)"))
    bad = f"array(named_struct('role', CAST(NULL AS STRING), 'ord', CAST(NULL AS INT), 'place', CAST(NULL AS {PLACE}), 'name', CAST(NULL AS STRING), 'v', CAST(NULL AS VARIANT), 'error', '{UNREADABLE}'))"
    top = src.withColumn("m", F.expr(_MAP)).select(
        "template", F.lit("").alias("path"), F.lit(None).cast("string").alias("model_type"), F.lit(-1).alias("depth"), F.expr(f"CAST(array() AS array<{PLACE}>)").alias("sort"), F.expr("CAST(array() AS array<string>)").alias("steps"),
        F.lit(True).alias("shown"), F.lit(True).alias("walked"), F.expr(f"CASE WHEN v IS NULL AND trim(doc) <> '' THEN {bad} ELSE {_kids(roles)} END").alias("kids"),
    )

    def below(level: DataFrame) -> DataFrame:
        each = level.select("template", "path", "model_type", "depth", "sort", "steps", "shown", "walked", F.explode_outer("kids").alias("c")).where("c IS NOT NULL")  # outer: else Spark filters by the kids' number first, and makes them twice
        at = each.select(
            "template", F.expr(f"CASE WHEN c.error IS NULL THEN {_PATH} END").alias("path"), F.expr("CASE WHEN c.error IS NULL THEN path END").alias("parent_path"), F.col("model_type").alias("parent_kind"), "c.role", "c.ord", F.expr("CASE WHEN c.error IS NULL THEN depth + 1 END").alias("depth"),
            F.expr("CASE WHEN c.error IS NULL THEN array_append(sort, c.place) END").alias("sort"), F.expr(f"CASE WHEN c.error IS NULL THEN array_append(steps, {_STEP}) END").alias("steps"), F.expr("shown AND c.role = 'elements'").alias("shown"),
            F.expr("walked AND c.role IN ('elements', 'items', 'itemTemplate')").alias("walked"), "c.error", F.col("c.v").alias("v"), F.expr("try_cast(c.v AS map<string, variant>)").alias("m"),
        )
        scalar = lambda k: F.expr(f"try_cast(try_element_at(m, '{k}') AS string)")
        kids = f"CASE WHEN m IS NOT NULL AND depth < {depth if depth is not None else 1 << 30} THEN {_kids(roles)} ELSE CAST(array() AS array<{_KID}>) END"
        fields = ("template", "path", "parent_path", "parent_kind", "role", "ord", "depth", "sort", "steps", "shown", "walked", scalar("idShort").alias("id_short"), scalar("modelType").alias("model_type"), own_fields().alias("own"))
        return at.select(*fields, F.expr(_there("elements")).alias("n_elements"), F.expr(_there("items")).alias("n_items"), "error", F.expr(kids).alias("kids"))

    return walk(below(top), below, "tree").withColumn("node", F.col("own"))


def unreadable(nodes: DataFrame) -> DataFrame:
    """template, error: the documents that could not be read."""
    return nodes.where("error IS NOT NULL").select("template", "error").distinct()


def prefixes(label: Column | str) -> Column:
    """The labels of a node's ancestors, from the top, its own last: a node joins its ancestors by equality on these."""
    x = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(1), F.size(x)), lambda k: F.slice(x, F.lit(1), k))


def parent(label: Column | str) -> Column:
    """The label of the node above."""
    x = F.col(label) if isinstance(label, str) else label
    return F.slice(x, F.lit(1), F.size(x) - 1)


def is_below(label: Column, top: Column) -> Column:
    """Whether a node is a descendant: between the top's label and that of whatever comes after its whole subtree."""
    return (label > top) & (F.slice(label, F.lit(1), F.size(top)) == top)


def subtrees(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes at and below each of ``tops`` (template, sort as ``top``), with the top's label: every node meets its ancestors by
    equality, so a subtree of any size is spread over all tasks and no pairs are made but those of the result."""
    each = nodes.where("error IS NULL").withColumn("top", F.explode(prefixes("sort")))
    return paired(each, tops.select("template", "top").distinct(), ["template", "top"])


def field(name: str, node: str = "node") -> Column:
    """A scalar of the node, as text; null where it is absent or null."""
    return F.get_json_object(node, f"$.{name}")


def own_fields() -> Column:
    """The JSON of a parsed node (a map ``m``) without its children."""
    drop = ", ".join(f"'{r}'" for r in ROLES)
    return F.expr(f"to_json(map_filter(m, (k, x) -> NOT (k IN ({drop}) AND coalesce(size(try_cast(x AS array<variant>)), 0) > 0)))")


def stated_cardinality(node: str = "node") -> Column:
    """The node's own cardinality, else that of its qualifiers, else ``[1]``."""
    listed = F.from_json(field("qualifiers", node), "array<struct<type:string,value:string>>")
    return F.coalesce(field("cardinality", node), cardinality.from_qualifiers(listed))


def child_counts(nodes: DataFrame) -> DataFrame:
    """template, parent_path, role, n: direct children. Parents are told apart by label, so of equal paths each has a row."""
    return nodes.where("error IS NULL").groupBy("template", "parent_path", "role", parent("sort").alias("parent_sort")).agg(F.count(F.lit(1)).alias("n")).drop("parent_sort")


def preview(nodes: DataFrame, max_depth: int = 2) -> DataFrame:
    """Nodes to a depth, reached through collections only, with the number of a collection's children or a list's items. Of
    nodes that ``flatten`` made to ``depth=max_depth`` under ``elements`` alone, all that is needed is there."""
    kind = F.col("model_type")
    return nodes.where((F.col("depth") <= max_depth) & F.col("shown")).select(
        "template", "path", "depth", "sort", "id_short", "model_type",
        field("semanticLabel").alias("semantic_label"), stated_cardinality().alias("cardinality"),
        F.when(kind == COLLECTION, F.col("n_elements").cast("long")).alias("child_count"), F.when(kind == LIST, field("typeValueListElement")).alias("list_type"), F.when(kind == LIST, F.col("n_items").cast("long")).alias("item_count"),
    )


def previewed(templates: DataFrame, max_depth: int = 2) -> DataFrame:
    """``preview`` of documents: nodes below that depth, and under lists, are not even read."""
    return preview(flatten(templates, max_depth, ("elements",)), max_depth)


def renest(nodes: DataFrame, keys: tuple[str, ...] = ("template",)) -> DataFrame:
    """(keys, doc): documents again, from rows with sort, role, ord, depth, own. Deepest level first: each
    level's nodes are gathered by their parent's label, in order. ``renest(flatten(x))`` is ``x``, but for the order of keys."""
    top = nodes.agg(F.max("depth")).first()[0]
    if top is None:
        return nodes.select(*keys, F.lit("").alias("doc")).limit(0)
    by = [*keys, "up"]
    below: DataFrame | None = None
    for depth in range(top, -1, -1):
        level = nodes.where((F.col("depth") == depth) & (F.col("role") != "itemTemplate")).select(*keys, "sort", parent("sort").alias("up"), "role", "ord", "own")
        if below is not None:
            level = paired(level, below.withColumnRenamed("up", "sort"), [*keys, "sort"], "left")
            inner = F.expr("substring(own, 2, length(own) - 2)")
            whole = F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inner, F.lit("")), "parts"), F.lit("}"))
            level = level.select(*by, "role", "ord", whole.alias("json"))
        else:
            level = level.select(*by, "role", "ord", F.col("own").alias("json"))
        roles = level.groupBy(*by, "role").agg(F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("c"))
        text = F.concat(F.lit('"'), F.col("role"), F.lit('":['), F.array_join(F.transform("c", lambda x: x["json"]), ","), F.lit("]"))
        below = roles.select(*by, "role", text.alias("t")).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "t"))), lambda x: x["t"]), ",").alias("parts"))
        if (top - depth) % 8 == 7:
            below = land(below, "nested")  # plans stay short, however deep the trees
    return below.select(*keys, F.concat(F.lit("{"), "parts", F.lit("}")).alias("doc"))


def any_item(steps: Column | str) -> Column:
    """Steps in which any item stands for all."""
    return F.transform(steps, lambda s: F.when(F.startswith(s, F.lit("[")), F.lit("[")).otherwise(s))


def schema_paths(nodes: DataFrame) -> DataFrame:
    """The nodes that describe, with ``schema_steps`` (any item for all), ``parent_schema`` (the parent's) and ``schema_path``, the
    same as text with ``[]`` for any item. A list's item template is its own where it has one, else its first item."""
    one = nodes.where("error IS NULL").where(~F.exists("steps", lambda s: F.startswith(s, F.lit("[")) & ~s.isin("[", "[0")))
    one = one.withColumn("schema_steps", any_item("steps")).withColumn("parent_schema", parent("schema_steps"))
    shown = F.transform("schema_steps", lambda s: F.when(s == "[", "[]").when(s.rlike("^[#;@<]"), F.concat(F.lit("["), F.substring_index(F.substr(s, F.lit(2)), "<", -1), F.lit("]"))).otherwise(F.concat(F.lit("."), F.substr(s, F.lit(2)))))
    one = one.withColumn("schema_path", F.regexp_replace(F.array_join(shown, ""), r"^\.", ""))
    best = F.min_by(F.struct(*one.columns), F.when(F.col("steps") == F.col("schema_steps"), 0).otherwise(1))
    return one.groupBy(F.col("template").alias("__t"), F.col("schema_steps").alias("__p")).agg(best.alias("r")).select("r.*")


def default_form(nodes: DataFrame) -> DataFrame:
    """What an empty form holds: template, path, kind and the fields of that kind, null values as ''."""
    kind = F.col("model_type")
    blank = lambda name, *kinds: F.when(kind.isin(*kinds), F.coalesce(field(name), F.lit("")))
    structured = (COLLECTION, LIST, ENTITY, "Range", "MultiLanguageProperty")
    value = F.when(kind == "MultiLanguageProperty", F.coalesce(field("value"), F.lit("{}"))).when(~kind.isin(*structured), F.coalesce(field("value"), F.lit("")))
    return nodes.where("role <> 'itemTemplate'").select(
        "template", "path", "sort", "model_type", value.alias("value"), blank("contentType", "File").alias("content_type"),
        blank("min", "Range").alias("min"), blank("max", "Range").alias("max"), blank("globalAssetId", ENTITY).alias("global_asset_id"),
    )


def default_documents(nodes: DataFrame) -> DataFrame:
    """(template, form): the nested form that an empty one starts as: maps by name, lists by place, each kind's fields with the
    template's values or ''. Of two siblings of one name the later counts, as keys of a map do; nodes without a name have no key."""
    from ..sources import forms

    kind = F.col("model_type")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    text = lambda k: F.concat(F.lit(f'"{k}":'), quoted(F.coalesce(field(k), F.lit(""))))
    told = F.concat(F.lit('"value":'), F.coalesce(field("value"), F.lit("{}")))
    body = (
        F.when(kind == "MultiLanguageProperty", told).when(kind == COLLECTION, F.when(F.col("n_elements") == 0, '"elements":{}').otherwise("")).when(kind == LIST, F.when(F.col("n_items") == 0, '"items":[]').otherwise(""))
        .when(kind == "File", F.concat_ws(",", text("value"), text("contentType"))).when(kind == "Range", F.concat_ws(",", text("min"), text("max")))
        .when(kind == ENTITY, F.concat_ws(",", text("globalAssetId"), F.when(~F.coalesce(F.col("held"), F.lit(False)), '"statements":{}'))).otherwise(text("value"))
    )
    held = nodes.where("role = 'statements'").select("template", parent("sort").alias("sort"), F.lit(True).alias("held")).distinct()
    seen = nodes.where("error IS NULL").where(F.forall("steps", lambda s: s.rlike(r"^[.:\[].")))  # what a form can hold
    best = seen.groupBy("template", "steps").agg(F.max("sort").alias("sort"))  # the later of two of one name
    kept = paired(paired(seen, best, ["template", "steps", "sort"]), held, ["template", "sort"], "left")
    rows = kept.select("template", "steps", "role", "ord", F.concat(F.lit("{"), body, F.lit("}")).alias("own"))
    tops = nodes.where("error IS NULL").select("template").distinct().select("template", F.expr("CAST(array() AS array<string>)").alias("steps"), F.lit("root").alias("role"), F.lit(0).alias("ord"), F.lit("{}").alias("own"))
    return forms.renest(land(rows.unionByName(tops), "defaults"), ("template",))
