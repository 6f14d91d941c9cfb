"""Records, chains of keys, client types and nested forms on odd rows."""

import json

from pyspark.sql import functions as F

from leafmill.operators import reading, tree, typing
from leafmill.sources import forms
from leafmill.sources import packages as source
from tests.fixtures import GOOD, TEMPLATE, submissions, templates, with_

from .test_packages import XML, read, zipped

KEYS = "array<struct<type:string,value:string>>"


def test_records_and_chains(spark):
    two = {"submodels": [{"id": "urn:s", "idShort": "S2", "submodelElements": [{"idShort": "A", "modelType": "Property", "semanticId": {"type": "ExternalReference", "keys": [{"type": "GlobalReference", "value": None}, {"type": "GlobalReference", "value": "c"}]}}, {"idShort": "A", "modelType": "Range"}, {"modelType": "Property"}]}, {"id": "urn:t", "submodelElements": []}], "conceptDescriptions": [{"id": "c", "displayName": [{"language": "en", "text": "only here"}]}]}
    objects = source.objects(read(spark, zipped({"aasx/data.xml": XML}), zipped({"d.json": json.dumps(two)}), b"broken")).cache()
    got = {(r.package, r.path, r.sort[0].ord): r for r in reading.records(objects).collect()}
    assert len({k for k in got if k[0] == "p1"}) == 3 and got["p1", "A", 0].semantic_label == "only here" and got["p1", "A", 1].input_type == "number" and got["p1", "A", 1].low is None
    p = next(r for k, r in got.items() if k[:2] == ("p0", "P"))
    assert (p.cardinality, p.value_type, p.input_type, p.step, p.semantic_label) == ("[1]", "xs:int", "number", "1", None) and json.loads(p.qualifiers)[0]["type"] == "Cardinality"
    key = lambda *v: [("", x) for x in v]
    refs = [("a", "p0", key("urn:s", "C", "Only")), ("b", "p0", key("urn:t")), ("c", "p1", key("urn:s", "A")), ("d", "p1", None), ("e", "p1", []), ("f", "p1", key(None)), ("g", None, key("urn:sem")), ("h", "p0", key("urn:sem", "x")), ("i", "p0", key("urn:s", None)), ("j", "p1", key("urn:s", "A", "deeper")), ("a", "p0", key("urn:aas"))]
    frame = spark.createDataFrame(refs, f"ref string, package string, keys {KEYS}")
    out = sorted(((r.ref, r.kind, r.target_package, r.path, r.dangling) for r in reading.resolve(frame, objects).collect()), key=str)
    assert out == sorted([
        ("a", "Property", "p0", "C.Only", None), ("b", "Submodel", "p1", "", None), ("c", "Property", "p1", "A", None), ("d", None, None, None, 0), ("e", None, None, None, 0), ("f", None, None, None, 0), ("g", "ConceptDescription", "p0", "", None),
        ("h", None, None, None, 1), ("i", None, None, None, 1), ("j", None, None, None, 2), ("a", "AssetAdministrationShell", "p0", "", None),
    ], key=str)
    assert [r.dangling for r in reading.resolve(frame.where("ref = 'b'"), objects, across=False).collect()] == [0]
    assert reading.resolve(frame.where("false"), objects).count() == 0 and reading.records(objects.where("false")).count() == 0


def test_client_types_on_odd_forms(spark):
    nodes = tree.flatten(templates(spark))
    cases = {"good": GOOD, "null": None, "bad": "{", "scalar": "5", "year": with_(Year={"value": "12.7"}), "flag": with_(Year={"value": True}), "langs": with_(Name={"value": {"en": 5}}), "none": with_(Name={}), "item": with_(Marks={"items": [5, {"elements": {"Label": {"value": None}}}]})}
    found = {}
    for r in typing.run(nodes, forms.flatten(submissions(spark, cases), whole=True)).collect():
        found.setdefault(r.submission_id, set()).add((r.field, r.part, r.code))
    missing = {(e["idShort"], "", "required") for e in TEMPLATE["elements"] if e["idShort"] not in GOOD["elements"] and e["modelType"] in ("Property", "MultiLanguageProperty", "SubmodelElementCollection", "SubmodelElementList", "File", "Range", "ReferenceElement", "Entity")}
    inside = {("Address.Geo", "", "required")}
    item = lambda i: {(f"Marks[{i}].Code", "", "required")}
    assert found["good"] == missing | inside | item(0)  # optional ones have to be there, too
    assert found["year"] - found["good"] == {("Year", "value", "invalid_type")} and found["flag"] == found["good"] == found["none"] and found["langs"] - found["good"] == {("Name", "value", "invalid_type")}
    assert {("Marks[0]", "", "invalid_type"), ("Marks[1].Label", "value", "invalid_type")} <= found["item"] and not found.keys() & {"null", "bad", "scalar"}


def test_nested_forms_come_back(spark):
    odd = {"elements": {"a.b": {"value": 1.50}, 'q"\\': {"items": [{"elements": {}}, {"annotations": [{"value": None}, 5, None]}]}, "e": {"statements": {"s": {}}, "globalAssetId": ""}, "n": None, "x": []}, "other": [1, {"k": "v"}]}
    subs = submissions(spark, {"good": GOOD, "odd": odd, "empty": {}, "bad": "{"})
    got = {r.submission_id: json.loads(r.form) for r in forms.renest(forms.flatten(subs, whole=True)).collect()}
    assert got == {"good": GOOD, "odd": odd, "empty": {}}
    assert forms.renest(forms.flatten(subs.where("false"), whole=True)).count() == 0


def test_default_documents(spark):
    docs = tree.default_documents(tree.flatten(templates(spark)))
    got = json.loads(docs.first().form)["elements"]
    assert got["Serial"] == {"value": "S1"} and got["Note"] == {"value": {}} and got["Limits"] == {"min": "0", "max": "10"} and got["Asset"] == {"globalAssetId": "urn:a", "statements": {"State": {"value": "on"}}}
    assert [x["elements"]["Label"]["value"] for x in got["Marks"]["items"]] == ["CE", "UL"] and got["Tags"] == {"items": []} and got["Address"]["elements"]["Geo"]["elements"]["Lat"] == {"value": "1.5"}
    assert tree.default_documents(tree.flatten(templates(spark).where("false"))).where(F.lit(True)).count() == 0
