"""Packages and archives from rows, one value a row: what is written is a binary column, for any Spark sink.

What was read is written by edits: a node's fields are compared with those of its source, and only the fields that differ
are put into the source, bottom-up with its children; so all that our trees do not know survives. Nodes without a
source (made by hand, prototypes of new items) are written from their fields."""

from __future__ import annotations

import base64
import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..landing import paired
from ..sources.packages import HELD, fields
from . import xml

FORMATS = ("aasx", "json")
_TYPES = '<?xml version="1.0" encoding="utf-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="json" ContentType="application/json"/></Types>'
_RELS = '<?xml version="1.0" encoding="utf-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://admin-shell.io/aasx/relationships/{kind}" Target="{target}"/></Relationships>'


def _reference(value, keys=None, kind=None) -> dict | None:
    keys = keys or ([{"type": "GlobalReference", "value": value}] if value else None)
    return {"type": kind or "ExternalReference", "keys": keys} if keys else None


class _Number(float):
    """A JSON number that knows how it was written."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


def _load(doc: str) -> dict:
    return json.loads(doc, parse_float=_Number)


def _text(x) -> str:
    return str(x).lower() if isinstance(x, bool) else x.text if isinstance(x, _Number) else str(x)


def _from_fields(n: dict) -> dict:
    """A node's fields, without its children, as the exchange format has them."""
    kind, out = n.get("modelType"), dict(n)
    for k in ("source", "semanticKeys", "semanticRefKind", "semanticLabel", "cardinality", "unit", "keys", "itemTemplate", "encoding", "elements", "items", "statements", "annotations", "inputVariables", "outputVariables", "inoutputVariables"):
        out.pop(k, None)
    spoken = lambda m: [{"language": k, "text": v} for k, v in m.items()]
    if "semanticId" in n:
        out["semanticId"] = _reference(n["semanticId"], n.get("semanticKeys"), n.get("semanticRefKind"))
    if n.get("cardinality") and not n.get("qualifiers"):
        out["qualifiers"] = [{"type": "Cardinality", "valueType": "xs:string", "value": n["cardinality"]}]
    elif n.get("qualifiers"):
        out["qualifiers"] = [{k: _reference(v) if k == "semanticId" and isinstance(v, str) else v for k, v in q.items() if v is not None} for q in n["qualifiers"]]
    if isinstance(n.get("description"), dict):
        out["description"] = spoken(n["description"])
    if kind == "MultiLanguageProperty":
        out["value"] = spoken(n["value"] if isinstance(n.get("value"), dict) else {})
    elif kind == "Blob" and isinstance(n.get("value"), str) and n.get("encoding") != "base64":
        out["value"] = base64.b64encode(n["value"].encode()).decode()
    elif kind == "ReferenceElement":
        out["value"] = _reference(n.get("value"), n.get("keys"))
    for k in ("first", "second", "observed", "messageBroker", "valueId", "semanticIdListElement"):
        if isinstance(n.get(k), str):
            out[k] = _reference(n[k])
    if kind in ("Property", "Range"):
        out |= {k: _text(n[k]) for k in ("value", "min", "max") if n.get(k) is not None}
    return {k: v for k, v in out.items() if v is not None}


def _edited(old, new):
    """A field's new value; of a reference the type and all keys stay but the last, which has the new value, unless the
    new chain is itself one of several keys."""
    if isinstance(old, dict) and isinstance(new, dict) and old.get("keys") and new.get("keys"):
        keys = new["keys"] if len(new["keys"]) > 1 or len(old["keys"]) == 1 and new["keys"][0].get("type") != "GlobalReference" else [*old["keys"][:-1], {**old["keys"][-1], "value": new["keys"][-1]["value"]}]
        return {**old, "keys": keys}
    return new


def element(n: dict) -> dict:
    """A node as an element of the exchange format: its source with the edits, then its children."""
    new, source = _from_fields(n), n.get("source")
    if isinstance(source, dict):
        old = _from_fields(fields(source))
        out = dict(source)
        for k in {*old, *new}:
            if old.get(k) != new.get(k):
                if k in new:
                    out[k] = _edited(source.get(k), new[k])
                else:
                    out.pop(k, None)
    else:
        out = new
    for mine, theirs in (("elements", "value"), ("items", "value"), ("statements", "statements"), ("annotations", "annotations")):
        if mine in n:
            out[theirs] = [element(x) for x in n[mine]]
    for k in ("inputVariables", "outputVariables", "inoutputVariables"):
        if n.get(k):
            out[k] = [{"value": element(x)} for x in n[k]]
    return out


def exchanged(d: dict, name: str) -> dict:
    """A document as a submodel of the exchange format."""
    if isinstance(d.get("source"), dict):  # forms do not reach a submodel's own fields
        return d["source"] | {"submodelElements": [element(x) for x in d.get("elements") or []]}
    out = {"modelType": "Submodel", "id": d.get("id") or name} | {k: d[k] for k in ("idShort", "kind", "category", "qualifiers", "displayName", "extensions", "embeddedDataSpecifications", "supplementalSemanticIds") if k in d}
    if d.get("semanticId"):
        out["semanticId"] = _reference(d["semanticId"])
    if isinstance(d.get("description"), dict):
        out["description"] = [{"language": k, "text": v} for k, v in d["description"].items()]
    admin = d.get("administrationSource") or {k: v for k, v in (d.get("administration") or {}).items() if v is not None and k != "creator"}
    return out | ({"administration": admin} if admin else {}) | {"submodelElements": [element(x) for x in d.get("elements") or []]}


def environment(docs: list[tuple[str, str]], others: list[tuple[str, str]] = ()) -> dict:
    """From submodels (doc, name) and other objects (kind, their own JSON)."""
    named = {"shell": "assetAdministrationShells", "concept": "conceptDescriptions"}
    env = {named[k]: [json.loads(x) for kind, x in others if kind == k] for k in named}
    return {k: v for k, v in (env | {"submodels": [exchanged(_load(d), n) for d, n in docs]}).items() if v}


def _package(env: dict | str, more: list[tuple[str, bytes]] = ()) -> bytes:
    """An archive of the environment, as JSON, or as XML where it is text already, and more parts."""
    kind = "xml" if isinstance(env, str) else "json"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        data = env if kind == "xml" else json.dumps(env, ensure_ascii=False)
        files = {"[Content_Types].xml": _TYPES, "_rels/.rels": _RELS.format(kind="aasx-origin", target="/aasx/aasx-origin"), "aasx/aasx-origin": "", "aasx/_rels/aasx-origin.rels": _RELS.format(kind="aas-spec", target=f"/aasx/data.{kind}"), f"aasx/data.{kind}": data}
        for k, v in [*files.items(), *((n.lstrip("/"), bytes(c)) for n, c in more)]:
            z.writestr(zipfile.ZipInfo(k, (1980, 1, 1, 0, 0, 0)), v, zipfile.ZIP_DEFLATED)  # equal input, equal bytes
    return out.getvalue()


def stores(found: DataFrame) -> DataFrame:
    """package, env: the whole store of each package (``sources.packages.objects``) in the exchange format's JSON: submodels
    from their documents, shells and concepts as they came. A package is one row, as it is one file."""
    of = F.struct("part", "ord", "kind", F.coalesce("id", "id_short").alias("name"), F.when(F.col("kind") == "submodel", F.col("doc")).otherwise(F.col("source")).alias("json"))
    objects = found.where("error is null").groupBy("package").agg(F.array_sort(F.collect_list(of)).alias("objects"))

    @F.pandas_udf("string")
    def make(objects: pd.Series) -> pd.Series:
        def one(held):
            docs = [(o["json"], o["name"] or "") for o in held if o["kind"] == "submodel"]
            return json.dumps(environment(docs, [(o["kind"], o["json"]) for o in held if o["kind"] != "submodel"]), ensure_ascii=False)

        return pd.Series([one(o) for o in objects], dtype=object)

    return objects.select("package", make("objects").alias("env"))


def packages(found: DataFrame, parts: DataFrame, form: str = "json") -> DataFrame:
    """package, content: everything that was read (``sources.packages.objects`` and ``parts``), written again with its data as
    JSON or as XML, with the parts that are no data of the package itself."""
    envs = stores(found)
    data = envs if form == "json" else xml.documents(envs)
    read = found.where("error is null").select("package", "part").distinct()
    own = F.col("part").contains("_rels/") | F.col("part").isin("/[Content_Types].xml", "/aasx/aasx-origin", "/aasx/data.json", "/aasx/data.xml")
    rest = paired(parts.where(F.col("content").isNotNull() & ~own), read, ["package", "part"], "left_anti")
    files = rest.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = lambda made: pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.string()), pa.array([c for _, c in made], pa.binary())], names=["package", "content"])
        made, size = [], 0  # of texts and files, which are larger than the archive, one package's are held beside Arrow's
        for b in batches:
            for name, d, f in zip(*(b.column(i) for i in range(3)), strict=True):
                env = json.loads(d.as_py()) if form == "json" else d.as_py()
                made.append((name.as_py(), _package(env, [(x["part"], x["content"]) for x in f.as_py() or ()])))
                size += len(made[-1][1])
                if size >= HELD or len(made) >= 1000:
                    yield frame(made)
                    made, size = [], 0
        if made:
            yield frame(made)

    both = paired(data, files, ["package"], "left").select(F.col("package").cast("string").alias("package"), "env" if form == "json" else "xml", "files")
    return both.mapInArrow(run, "package string, content binary")


def package(doc: Column | str, name: Column | str) -> Column:
    """Package bytes of a document; null for null or unreadable documents."""

    @F.pandas_udf("binary")
    def make(docs: pd.Series, names: pd.Series) -> pd.Series:
        def one(d, n):
            try:
                return _package(environment([(d, n)])) if d else None
            except (ValueError, AttributeError, TypeError):
                return None

        return pd.Series([one(d, n) for d, n in zip(docs, names, strict=True)], dtype=object)

    return make(doc, name)


def exchange_json(doc: Column | str, name: Column | str) -> Column:
    """The exchange format's JSON of a document, UTF-8; null for null or unreadable documents."""

    @F.pandas_udf("binary")
    def make(docs: pd.Series, names: pd.Series) -> pd.Series:
        def one(d, n):
            try:
                return json.dumps(environment([(d, n)]), ensure_ascii=False).encode() if d else None
            except (ValueError, AttributeError, TypeError):
                return None

        return pd.Series([one(d, n) for d, n in zip(docs, names, strict=True)], dtype=object)

    return make(doc, name)


def export(docs: DataFrame) -> DataFrame:
    """(..., doc, name, format) with content: the bytes in the row's format; rows of other formats are left out."""
    known = docs.where(F.col("format").isin(*FORMATS))
    return known.withColumn("content", F.when(F.col("format") == "json", exchange_json("doc", "name")).otherwise(package("doc", "name")))


def verify(docs: DataFrame) -> DataFrame:
    """A dry run of ``export``: everything is made, nothing kept. The rows come back with ``ok`` and ``error``."""
    known = F.col("format").isin(*FORMATS)
    made = F.when(F.col("format") == "json", exchange_json("doc", "name")).when(F.col("format") == "aasx", package("doc", "name"))
    bad = F.when(~F.coalesce(known, F.lit(False)), "unknown format").when(made.isNull(), "document cannot be written")
    return docs.withColumn("error", bad).withColumn("ok", F.col("error").isNull())


def archive(files: DataFrame, key: str = "batch") -> DataFrame:
    """(batch, archive) from (batch, filename, content): a batch is one request's files, in order of their names."""
    grouped = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("filename", "content"))).alias("files"))

    @F.pandas_udf("binary")
    def make(batches: pd.Series) -> pd.Series:
        def one(entries):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for e in entries:
                    z.writestr(zipfile.ZipInfo(e["filename"], (1980, 1, 1, 0, 0, 0)), bytes(e["content"] or b""), zipfile.ZIP_DEFLATED)
            return out.getvalue()

        return batches.map(one)

    return grouped.select(key, make("files").alias("archive"))
