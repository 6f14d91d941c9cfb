"""What a form's client accepts: types of values, not the rules of the template's author (``operators.validate``).

A template compiles to rows: every element that a client knows, with the type its value must have. Forms are joined to these by
their typed steps, and every test is a predicate. It differs from validation where the client does: a missing element is an
error whatever its cardinality, and an empty one is not; numbers are what the client's language makes of a text
(``''`` and null are 0 where a number must be there); booleans are booleans; statements of entities are looked at; only
``[1..*]`` asks for items; bounds of lists, references and languages are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cardinality
from ..landing import land, meet, paired
from . import tree

#: Texts that are numbers to the client, after trimming; the first part in base 10.
DECIMAL, OTHER_BASE = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|Infinity)$", r"^0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"
NUMBERS = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def compiled(nodes: DataFrame) -> DataFrame:
    """template, parent_schema, step, sort, kind, held_by (the parent's part that holds it), type (int, number, bool, text), required, min_items: the
    elements, statements and items that the client looks at, under parents that it looks into."""
    seen = nodes.where("error IS NULL").where(F.forall("sort", lambda x: x["role"].isin(0, 1, 2, tree.ITEM_TEMPLATE)))
    at = tree.schema_paths(seen)
    of = F.coalesce(tree.field("valueType"), F.when(F.col("model_type") == "Range", "xs:double").otherwise("xs:string"))
    has = lambda *x: F.greatest(*(F.contains(of, F.lit(t)) for t in x)) if len(x) > 1 else F.contains(of, F.lit(x[0]))
    kind = F.col("model_type")
    number = F.when(has("int", "Integer"), "int").when(has("float", "double", "decimal"), "number").when(has("bool"), "bool").otherwise("text")
    typed = F.when(kind == "Property", number).when(kind == "Range", F.when(has("int"), "int").otherwise("number"))
    bound = cardinality.client_bounds(tree.stated_cardinality())
    stated = F.coalesce(tree.field("cardinality"), tree.stated_cardinality())
    return at.select("template", "parent_schema", "schema_steps", F.element_at("schema_steps", -1).alias("step"), "sort", kind.alias("kind"), F.col("role"), typed.alias("type"), bound["required"].alias("required"), F.when((kind == tree.LIST) & (stated == "[1..*]"), 1).otherwise(0).alias("min_items"))


def is_number(raw: Column, of: Column, whole: bool) -> Column:
    """Whether the client makes a number (a whole one) of a JSON value."""
    t = F.trim(raw)
    value = F.when(of.rlike(NUMBERS), raw.try_cast("double")).when((of == "BOOLEAN") | of.isin("VOID") | ((of == "STRING") & (t == "")), F.lit(0.0)).when((of == "STRING") & t.rlike(OTHER_BASE), F.lit(1.0)).when((of == "STRING") & t.rlike(DECIMAL), t.try_cast("double"))
    good = value.isNotNull()
    return F.coalesce(good & (value == F.floor(value)) & (F.abs(value) < float("inf")) if whole else good, F.lit(False))


def _fits(raw: Column, of: Column, kind: Column) -> Column:
    return F.when(kind == "int", is_number(raw, of, True)).when(kind == "number", is_number(raw, of, False)).when(kind == "bool", F.coalesce(of == "BOOLEAN", F.lit(False))).otherwise(F.coalesce(of == "STRING", F.lit(False)))


def rules() -> list[Column]:
    """Findings of one expected element, each null or (part, code)."""
    kind, need, of = F.col("kind"), F.col("required"), F.col("type")
    found = lambda when, part, code: F.when(when, F.struct(F.lit(part).alias("part"), F.lit(code).alias("code")))
    here = F.col("here") & F.col("is.object")
    at = lambda *k: here & kind.isin(*k)
    absent = lambda t: F.coalesce(F.col(t) == "VOID", F.lit(True))  # noqa: E731  not there, or null
    null = lambda t: F.coalesce(F.col(t) == "VOID", F.lit(False))
    known = ("Property", "MultiLanguageProperty", tree.COLLECTION, tree.LIST, "File", "Range", "ReferenceElement", tree.ENTITY)

    def typed(raw: str, t: str) -> Column:
        """Whether a value is not what its type asks for; an optional one may be missing or null."""
        missing = F.col(t).isNull()
        return F.when(~need & absent(t), False).when(missing, True).otherwise(~_fits(F.col(raw), F.col(t), of))

    optional_text = lambda t: F.coalesce(~F.col(t).isin("STRING"), F.lit(False))
    path = F.when(need, F.coalesce((F.col("value_type") != "STRING") | (F.col("value_raw") == ""), F.lit(True))).otherwise(optional_text("value_type"))
    return [
        found(kind.isin(*known) & ~F.col("here"), "", "required"), found(kind.isin(*known) & F.col("here") & ~F.col("is.object"), "", "invalid_type"),
        found(at("Property") & typed("value_raw", "value_type"), "value", "invalid_type"),
        found(at("MultiLanguageProperty") & F.col("value_type").isNotNull() & (~F.startswith("value_type", F.lit("OBJECT")) | ~F.col("is.texts")), "value", "invalid_type"),
        found(at(tree.COLLECTION) & ~F.col("is.elements"), "elements", "invalid_type"), found(at(tree.ENTITY) & ~F.col("is.statements"), "statements", "invalid_type"),
        found(at(tree.LIST) & F.col("n_items").isNull(), "items", "invalid_type"), found(at(tree.LIST) & (F.col("n_items") < F.col("min_items")), "items", "too_small"),
        found(at("File", "ReferenceElement") & path, "value", "invalid_type"), found(at("File") & optional_text("is.content"), "contentType", "invalid_type"), found(at(tree.ENTITY) & optional_text("is.asset"), "globalAssetId", "invalid_type"),
        found(at("Range") & typed("min_raw", "min_type"), "min", "invalid_type"), found(at("Range") & typed("max_raw", "max_type"), "max", "invalid_type"),
    ]


def run(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """submission_id, sort, steps (of the element), field (its path), part, code. ``forms`` is flattened with ``whole``. Of forms that
    cannot be read, see ``validate.unreadable``."""
    schema = land(compiled(nodes), "compiled")
    look = schema.select("template", F.col("schema_steps").alias("parent_schema"), F.col("kind").alias("parent_kind"))
    named = paired(schema.where("role IN ('elements', 'statements')"), look, ["template", "parent_schema"], "left")
    inside = F.coalesce(F.col("parent_kind"), F.lit(tree.COLLECTION))
    named = land(named.where(((F.col("role") == "elements") & (inside == tree.COLLECTION)) | ((F.col("role") == "statements") & (inside == tree.ENTITY))).drop("schema_steps", "parent_kind"), "named")
    items = land(schema.where("step = '['").select("template", "schema_steps", "sort", "kind", "type", "required", "min_items"), "items")
    good = forms.where("error IS NULL").withColumn("schema_steps", tree.any_item("steps"))
    mine = forms.select("submission_id", "steps", "value_raw", "value_type", "min_raw", "min_type", "max_raw", "max_type", "n_items", "is", F.lit(True).alias("__here"))
    part = F.when(F.col("role") == "elements", F.col("has.elements")).otherwise(F.col("has.statements"))
    parents = good.select("submission_id", "template", F.col("path").alias("at"), F.col("steps").alias("at_steps"), F.col("schema_steps").alias("parent_schema"), F.col("is").alias("has"))
    rows = meet(parents, named, ["template", "parent_schema"], "template", "submission_id").where(part)
    name = F.substr("step", F.lit(2))
    rows = rows.select("submission_id", F.array_append("at_steps", F.col("step")).alias("steps"), F.when(F.col("at") == "", name).otherwise(F.concat("at", F.lit("."), name)).alias("field"), "sort", "kind", "type", "required", "min_items")
    listed = meet(good.where("role = 'items'").select("submission_id", "template", "steps", F.col("path").alias("field"), "schema_steps"), items, ["template", "schema_steps"], "template", "submission_id")
    rows = paired(rows.unionByName(listed.select(*rows.columns)), mine, ["submission_id", "steps"], "left").withColumn("here", F.coalesce("__here", F.lit(False)))
    found = F.filter(F.array(*rules()), lambda x: x.isNotNull())
    return rows.select("submission_id", "sort", "steps", "field", F.explode(found).alias("f")).select("submission_id", "sort", "steps", "field", "f.*")
