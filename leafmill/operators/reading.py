"""The read path of packages: every node's record with what its package's own dictionary says, and references followed to nodes.

All joins are equalities on a package (or document) and a key: a package's dictionary is looked at by that package's nodes
only, in the order of its store, and a chain of keys is walked by one join a key, for all references at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language, references, text, xsd
from ..landing import land, meet, paired
from . import tree

_ENTRIES = "array<struct<lang:string,text:string>>"


def documents(found: DataFrame) -> DataFrame:
    """template, doc, package, id of the submodels of packages (``sources.packages.objects``): a package may hold many."""
    name = F.concat_ws("|", "package", "part", F.col("ord").cast("string"))
    return found.where("kind = 'submodel' AND error IS NULL").select(name.alias("template"), "doc", "package", "id")


def concepts(found: DataFrame) -> DataFrame:
    """The dictionaries: package, cd_ord (place in the package's store), id, id_short, unit and language maps in order."""
    of = lambda k: F.get_json_object("doc", f"$.{k}")
    maps = {"preferred_name": "preferredName", "definition": "definition", "display_name": "displayName", "description": "description"}
    return found.where("kind = 'concept' AND error IS NULL").select("package", F.struct("part", "ord").alias("cd_ord"), "id", "id_short", of("unit").alias("unit"), *[F.from_json(of(v), _ENTRIES).alias(k) for k, v in maps.items()])


def concept_of(nodes: DataFrame, cds: DataFrame) -> DataFrame:
    """(template, sort, cd): the concept of each node with keys. A model reference is followed: its chain is one key, a concept's id
    (a longer one ends in an element, which is no concept). Of an external reference the first key counts that is the id or the
    short id of a concept, and of its concepts the first of the store."""
    each = nodes.select("template", "sort", "package", "ref_kind", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "k")).select("*", F.col("k.value").alias("key")).where("key IS NOT NULL AND (ref_kind <> 'ModelReference' OR n = 1)")
    cd = cds.select(F.col("package").alias("p"), "id", "id_short", F.struct(*cds.columns).alias("cd"))
    by_id = paired(each, cd.select("p", F.col("id").alias("key"), "cd").withColumnRenamed("p", "package"), ["package", "key"])
    by_name = paired(each.where("ref_kind <> 'ModelReference'"), cd.select(F.col("p").alias("package"), F.col("id_short").alias("key"), "cd"), ["package", "key"])
    return by_id.unionByName(by_name).groupBy("template", "sort").agg(F.min_by("cd", F.struct("pos", F.col("cd.cd_ord"))).alias("cd"))


def records(found: DataFrame) -> DataFrame:
    """One row a node of every submodel of the packages: package, template, path, sort, depth and role; the common fields id_short,
    model_type, semantic_id, semantic_label, description (own, else of the concept: a language map), qualifiers (JSON), cardinality,
    category; value_type, value, value_id, unit (through model references only), and for inputs input_type, step, low, high."""
    docs = land(documents(found), "documents")
    own = paired(tree.flatten(docs.select("template", "doc")).where("error IS NULL"), docs.select("template", "package"), ["template"])
    field = tree.field
    nodes = land(own.withColumn("keys", F.from_json(field("semanticKeys"), references.TYPE)).withColumn("ref_kind", F.coalesce(field("semanticRefKind"), F.lit("ExternalReference"))), "nodes")
    out = paired(nodes, concept_of(nodes.where("size(keys) > 0"), concepts(found)), ["template", "sort"], "left")
    kind, blank = F.col("model_type"), text.blank_to_null
    label = F.coalesce(blank(language.pick("cd.preferred_name")), blank(language.pick("cd.display_name")))
    said = lambda c: F.when(F.size(c) > 0, F.to_json(F.map_from_entries(F.col(c))))
    mine = F.when(F.size(F.from_json(field("description"), "map<string,string>")) > 0, field("description"))
    of = F.when(kind == "Property", F.coalesce(field("valueType"), F.lit("xs:string"))).when(kind == "Range", F.coalesce(field("valueType"), F.lit("xs:double")))
    typed = lambda c: F.when(of.isNotNull(), c)
    limit = lambda f: F.when(kind == "Property", f(of))  # noqa: E731  a range has a step, but no bounds of its own
    return out.select(
        "package", "template", "path", "sort", "depth", "role", "id_short", "model_type", references.first_value("keys").alias("semantic_id"), label.alias("semantic_label"),
        F.coalesce(mine, said("cd.definition"), said("cd.description")).alias("description"), field("qualifiers").alias("qualifiers"), tree.stated_cardinality().alias("cardinality"), field("category").alias("category"),
        of.alias("value_type"), field("value").alias("value"), field("valueId").alias("value_id"), F.when(kind.isin("Property", "Range") & (F.col("ref_kind") == "ModelReference"), F.col("cd.unit")).alias("unit"),
        typed(xsd.input_type(of)).alias("input_type"), typed(xsd.input_attributes(of)["step"]).alias("step"), limit(xsd.lower_bound).alias("low"), limit(xsd.upper_bound).alias("high"),
    )


def resolve(refs: DataFrame, found: DataFrame, across: bool = True) -> DataFrame:
    """``refs`` (ref, package, keys) with what they lead to: kind, target_package, template, sort and path of the node (of an
    identifiable only kind and id), and dangling, the place of the first key that leads nowhere (null where all do).

    The first key is the id of a submodel, concept or shell of the package, or else (``across``) of the first other package that
    has one; each further key is the short id of a child, in a list its place. One join a key; the longest chain is the
    number of joins. A null or empty chain dangles at 0."""
    docs = land(documents(found), "documents")
    named = found.where("error IS NULL AND id IS NOT NULL").select("package", "kind", F.col("id").alias("key"), F.struct("part", "ord").alias("place"), F.concat_ws("|", "package", "part", F.col("ord").cast("string")).alias("template"))
    named = land(named.groupBy("package", "key").agg(F.min_by(F.struct("kind", "template"), "place").alias("t")), "identifiables")
    at = refs.select("ref", "package", "keys", F.get("keys", 0)["value"].alias("key"))
    own = paired(at, named, ["package", "key"], "left").withColumn("where", F.when(F.col("t").isNotNull(), F.col("package")))
    if across:
        first = land(named.groupBy("key").agg(F.min_by(F.struct("package", "t"), "package").alias("o")), "elsewhere")
        own = meet(own, first, ["key"], "key", "ref", "left").withColumn("where", F.coalesce("where", "o.package")).withColumn("t", F.coalesce("t", "o.t")).drop("o")
    names = {"submodel": "Submodel", "concept": "ConceptDescription", "shell": "AssetAdministrationShell"}
    kind = F.coalesce(*(F.when(F.col("t.kind") == k, v) for k, v in names.items()))
    place = f"CAST(NULL AS array<{tree.PLACE}>)"
    front = land(own.select("ref", "package", "keys", F.col("where").alias("target_package"), F.col("t.template").alias("template"), F.when(F.col("t.kind") == "submodel", F.expr(f"CAST(array() AS array<{tree.PLACE}>)")).otherwise(F.expr(place)).alias("sort"), F.lit("").alias("path"), kind.alias("kind"), F.when(F.col("t").isNull(), 0).alias("dangling")), "front")
    longest = front.agg(F.max(F.size("keys"))).first()[0] or 0
    if longest > 1:
        token = F.when(F.col("role") == "items", F.concat(F.lit("["), F.col("ord").cast("string"))).otherwise(F.col("id_short"))
        nodes = tree.flatten(docs.select("template", "doc")).where("error IS NULL AND role <> 'itemTemplate'").select("template", tree.parent("sort").alias("up"), token.alias("token"), F.struct("sort", "path", "model_type").alias("n"))
        nodes = land(nodes.where("token IS NOT NULL").groupBy("template", "up", "token").agg(F.min_by("n", "n.sort").alias("n")), "children")
    for i in range(1, longest):
        more = (F.size("keys") > i) & F.col("dangling").isNull()
        value = F.get("keys", i)["value"]
        step = front.withColumn("token", F.when(more, F.when(F.col("kind") == tree.LIST, F.concat(F.lit("["), value)).otherwise(value))).withColumnRenamed("sort", "up")
        step = paired(step, nodes, ["template", "up", "token"], "left")
        keep = lambda new, old: F.when(more, new).otherwise(old)  # noqa: E731, B023
        front = land(step.select("ref", "package", "keys", "target_package", "template", keep(F.col("n.sort"), F.col("up")).alias("sort"), keep(F.col("n.path"), F.col("path")).alias("path"), keep(F.col("n.model_type"), F.col("kind")).alias("kind"), F.when(more & F.col("n").isNull(), i).otherwise(F.col("dangling")).alias("dangling")), "front")
    empty = F.coalesce(F.size("keys"), F.lit(0)) < 1
    lost = empty | F.col("dangling").isNotNull()
    some = lambda c: F.when(~lost, F.col(c)).alias(c)
    return front.select("ref", "package", "keys", some("kind"), some("target_package"), some("template"), some("sort"), some("path"), F.when(empty, 0).otherwise(F.col("dangling")).alias("dangling"))


def type_matches(keys: Column | str, kind: Column | str) -> Column:
    """Whether the last key names the kind that the chain leads to."""
    return F.element_at(text.col(keys), -1)["type"] == text.col(kind)
