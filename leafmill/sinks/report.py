"""Report rows, HTML text of them, and names of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language, references, text
from ..operators import tree
from ..sources.forms import language_entries

EMPTY = "—"


def shown(value: Column, unit: Column) -> Column:
    """Value and unit. Only null and the empty text are empty: 0 and false are shown."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(EMPTY)).otherwise(F.concat_ws(" ", value, text.blank_to_null(unit)))


def display(node: str = "node") -> Column:
    """What a node's kind shows beside its label; null for nodes that only hold others."""
    kind, of = F.col("model_type"), lambda k: tree.field(k, node)
    spoken = F.array_join(F.transform(language.without_blank(language_entries(of("value"))), lambda e: F.concat(e["lang"], F.lit(": "), e["text"])), "; ")
    value = shown(of("value"), of("unit"))
    chain = F.coalesce(text.blank_to_null(references.shown(F.from_json(of("keys"), references.TYPE))), of("value"))
    return (
        F.when(kind.isin(tree.COLLECTION, tree.LIST, "Operation", "Capability"), F.lit(None).cast("string"))
        .when(kind == "MultiLanguageProperty", F.coalesce(text.blank_to_null(spoken), F.lit(EMPTY)))
        .when(kind == "Range", F.concat(shown(of("min"), F.lit(None).cast("string")), F.lit(" – "), shown(of("max"), of("unit"))))
        .when(kind == "Entity", F.concat_ws(" ", of("entityType"), of("globalAssetId")))
        .when(kind.isin("RelationshipElement", "AnnotatedRelationshipElement"), F.concat(F.coalesce(of("first"), F.lit(EMPTY)), F.lit(" → "), F.coalesce(of("second"), F.lit(EMPTY))))
        .when(kind == "ReferenceElement", F.coalesce(text.blank_to_null(chain), F.lit(EMPTY)))
        .when(kind == "BasicEventElement", F.coalesce(of("observed"), F.lit(EMPTY)))
        .otherwise(value)
    )


def rows(nodes: DataFrame) -> DataFrame:
    """template, path, depth, sort, label, model_type, shown. Items are called by their place, from 1."""
    name = F.when((F.col("role") == "items") & tree.field("semanticLabel").isNull(), F.concat(F.lit("Item "), (F.col("ord") + 1).cast("string")))
    label = F.coalesce(name, text.label(tree.field("semanticLabel"), "id_short"))
    return nodes.where("role <> 'itemTemplate'").select("template", "path", "depth", "sort", label.alias("label"), "model_type", display().alias("shown"))


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def html(reported: DataFrame) -> DataFrame:
    """(template, html): the rows of a template in order, indented by depth. A template's report is one text."""
    line = F.concat(F.lit('<tr class="d'), F.col("depth").cast("string"), F.lit('"><th>'), _escaped(F.coalesce("label", F.lit(""))), F.lit("</th><td>"), _escaped(F.coalesce("shown", F.lit(""))), F.lit("</td></tr>"))
    each = reported.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("sort", line.alias("t")))).alias("r"))
    return each.select("template", F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.lit("</table>")).alias("html"))


def batch_name(template: Column, idx: Column, form: Column) -> Column:
    return F.concat(template, F.lit("_"), idx.cast("string"), F.lit("."), form)


def export_name(template: Column, form: Column, filled: bool = False) -> Column:
    return F.concat(template, F.lit("_filled." if filled else "."), form)
