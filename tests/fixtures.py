"""One template with every kind of node, and forms for it."""

import json


def prop(name, value=None, vt="xs:string", card=None, **more):
    return {"idShort": name, "modelType": "Property", "valueType": vt} | ({"value": value} if value is not None else {}) | ({"cardinality": card} if card else {}) | more


TEMPLATE = {
    "id": "urn:t",
    "elements": [
        prop("Serial", "S1", card="[1]", semanticLabel="Serial number"),
        prop("Year", "2020", "xs:int", "[0..1]"),
        {"idShort": "Name", "modelType": "MultiLanguageProperty", "cardinality": "[1]", "value": {"en": "Pump", "de": "Pumpe"}},
        {"idShort": "Note", "modelType": "MultiLanguageProperty", "cardinality": "[0..1]", "value": {}},
        {"idShort": "Address", "modelType": "SubmodelElementCollection", "cardinality": "[1]", "elements": [
            prop("Street", card="[1]"),
            {"idShort": "Geo", "modelType": "SubmodelElementCollection", "cardinality": "[0..1]", "elements": [prop("Lat", "1.5", "xs:double", "[1]"), {"idShort": "Deep", "modelType": "SubmodelElementCollection", "cardinality": "[0..1]", "elements": [prop("Leaf", "x", card="[0..1]")]}]},
        ]},
        {"idShort": "Marks", "modelType": "SubmodelElementList", "cardinality": "[1..*]", "typeValueListElement": "SubmodelElementCollection", "items": [
            {"modelType": "SubmodelElementCollection", "elements": [prop("Label", "CE", card="[1]"), prop("Code", "7", "xs:int", "[0..1]")]},
            {"modelType": "SubmodelElementCollection", "elements": [prop("Label", "UL", card="[1]")]},
        ]},
        {"idShort": "Tags", "modelType": "SubmodelElementList", "cardinality": "[0..2]", "typeValueListElement": "Property", "valueTypeListElement": "xs:int", "items": []},
        {"idShort": "Loose", "modelType": "SubmodelElementList", "cardinality": "[0..*]", "items": []},
        {"idShort": "Manual", "modelType": "File", "cardinality": "[0..1]", "contentType": "application/pdf", "value": "/aasx/manual.pdf"},
        {"idShort": "Raw", "modelType": "Blob", "cardinality": "[0..1]", "contentType": "text/plain", "value": "old"},
        {"idShort": "Limits", "modelType": "Range", "cardinality": "[0..1]", "valueType": "xs:double", "min": "0", "max": "10"},
        {"idShort": "Ref", "modelType": "ReferenceElement", "cardinality": "[0..1]", "value": "http://a", "keys": [{"type": "Submodel", "value": "http://a"}, {"type": "Property", "value": "p"}]},
        {"idShort": "Asset", "modelType": "Entity", "cardinality": "[0..1]", "globalAssetId": "urn:a", "statements": [prop("State", "on", card="[1]")]},
        {"idShort": "Rel", "modelType": "RelationshipElement", "cardinality": "[0..1]", "first": "urn:1", "second": "urn:2"},
        {"idShort": "ARel", "modelType": "AnnotatedRelationshipElement", "cardinality": "[0..1]", "first": "urn:1", "second": "urn:2", "annotations": [prop("Why", "because")]},
        {"idShort": "Op", "modelType": "Operation", "cardinality": "[0..1]", "inputVariables": [prop("In"), None]},
        {"idShort": "Cap", "modelType": "Capability", "cardinality": "[0..1]"},
        {"idShort": "Ev", "modelType": "BasicEventElement", "cardinality": "[0..1]", "observed": "urn:o"},
    ],
}

GOOD = {"elements": {"Serial": {"value": "S9"}, "Year": {"value": "2024"}, "Name": {"value": {"en": "x"}}, "Address": {"elements": {"Street": {"value": "Main"}}}, "Marks": {"items": [{"elements": {"Label": {"value": "CE"}}}]}}}


def with_(**changes):
    """GOOD with top-level elements replaced, or dropped where the change is ``...``."""
    e = {**GOOD["elements"], **changes}
    return {"elements": {k: v for k, v in e.items() if v is not ...}}


def templates(spark):
    return spark.createDataFrame([("t", json.dumps(TEMPLATE))], "template string, doc string")


def submissions(spark, forms: dict):
    return spark.createDataFrame([(k, "t", v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in forms.items()], "submission_id string, template string, form string")
