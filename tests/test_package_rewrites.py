"""Rewrites of whole environments: nothing that was read is lost, whatever is edited, as JSON and as XML."""

import json
import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from leafmill.operators import hydrate, tree
from leafmill.sinks import packages as sink
from leafmill.sinks import xml
from leafmill.sources import forms
from leafmill.sources import packages as source

from .test_packages import read, zipped


def ref(*values, kind="ModelReference"):
    return {"type": kind, "keys": [{"type": "Submodel" if i == 0 else "Property", "value": v} for i, v in enumerate(values)]}


def random_element(rng, depth):
    kinds = ["Property", "MultiLanguageProperty", "File", "Blob", "Range", "ReferenceElement", "RelationshipElement", "Capability", "BasicEventElement", "Operation"] + (["SubmodelElementCollection", "SubmodelElementList", "Entity", "AnnotatedRelationshipElement"] if depth else [])
    kind = rng.choice(kinds)
    word = lambda: rng.choice(["a", "x.y", "a[0]", "ü <&> \"'", "  spaced ", "1.50", "007", "line\nbreak", "]]>"])
    e = {"idShort": f"e{rng.randrange(1 << 30)}", "modelType": kind, "semanticId": rng.choice([None, ref(word(), word(), word()), ref(word(), kind="ExternalReference")]), "category": rng.choice([None, "PARAMETER"])}
    e["qualifiers"] = rng.choice([None, [{"type": "Cardinality", "valueType": "xs:string", "value": "One", "kind": "TemplateQualifier", "semanticId": ref(word(), word()), "valueId": ref(word(), word())}]])
    e["extensions"] = rng.choice([None, [{"name": word(), "valueType": "xs:string", "value": word(), "refersTo": [ref(word())]}]])
    e["supplementalSemanticIds"] = rng.choice([None, [ref(word(), word())]])
    e["description"] = rng.choice([None, [{"language": "en", "text": word()}, {"language": "de", "text": word()}]])
    held = lambda: [random_element(rng, depth - 1) for _ in range(rng.choice([1, 2, 3]))]
    more = {
        "Property": lambda: {"valueType": rng.choice(["xs:string", "xs:double", "xs:int"]), "value": word(), "valueId": rng.choice([None, ref(word(), word())])},
        "MultiLanguageProperty": lambda: {"value": [{"language": "en", "text": word()}], "valueId": rng.choice([None, ref(word())])},
        "File": lambda: {"value": "/aasx/x.pdf", "contentType": "application/pdf"}, "Blob": lambda: {"value": rng.choice(["w6l0w6k=", "/w=="]), "contentType": "text/plain"}, "Range": lambda: {"valueType": "xs:double", "min": "1.0", "max": "2.50"},
        "ReferenceElement": lambda: {"value": {**ref(word(), word()), "referredSemanticId": ref(word())}}, "RelationshipElement": lambda: {"first": ref(word(), word()), "second": ref(word(), kind="ExternalReference")}, "Capability": dict,
        "BasicEventElement": lambda: {"observed": ref(word(), word()), "direction": "input", "state": "on", "messageBroker": ref(word())}, "Operation": lambda: {"inputVariables": [{"value": random_element(rng, 0)}]},
        "SubmodelElementCollection": lambda: {"value": held()}, "SubmodelElementList": lambda: {"orderRelevant": rng.random() < 0.5, "typeValueListElement": "Property", "semanticIdListElement": ref(word(), word()), "value": held()},
        "Entity": lambda: {"entityType": "SelfManagedEntity", "globalAssetId": word(), "specificAssetIds": [{"name": "n", "value": word(), "externalSubjectId": ref(word())}], "statements": held()},
        "AnnotatedRelationshipElement": lambda: {"first": ref(word(), word()), "second": ref(word()), "annotations": held()},
    }[kind]()
    return {k: v for k, v in (e | more).items() if v is not None}


def random_environment(rng):
    spec = [{"dataSpecification": ref("urn:ds", kind="ExternalReference"), "dataSpecificationContent": {"modelType": "DataSpecificationIec61360", "preferredName": [{"language": "en", "text": "Name"}], "unit": "kg", "unitId": ref("u", "v")}}]
    submodel = {"modelType": "Submodel", "id": "urn:s", "idShort": "S", "semanticId": ref("urn:sem", "urn:t"), "administration": {"version": "1", "creator": ref("c", "d")}, "submodelElements": [random_element(rng, 3) for _ in range(6)]}
    concept = {"modelType": "ConceptDescription", "id": "urn:sem", "idShort": "Sem", "embeddedDataSpecifications": spec, "isCaseOf": [ref("x", "y")]}
    shell = {"modelType": "AssetAdministrationShell", "id": "urn:a", "assetInformation": {"assetKind": "Instance", "globalAssetId": "urn:g"}, "submodels": [ref("urn:s")]}
    return {"assetAdministrationShells": [shell], "submodels": [submodel], "conceptDescriptions": [concept]}


def stored(objects):
    return {r.package: json.loads(r.env) for r in sink.stores(objects).collect()}


def test_environments_equal_after_two_rewrites(spark):
    rng = random.Random(8)
    envs = [random_environment(rng) for _ in range(12)]
    parts = read(spark, *(zipped({"aasx/data.json": json.dumps(e, ensure_ascii=False)}) for e in envs))
    objects = source.objects(parts).cache()
    assert stored(objects) == {f"p{i}": e for i, e in enumerate(envs)}
    once = source.parts(sink.packages(objects, parts, "xml")).cache()
    assert once.where("part = '/aasx/data.xml'").count() == len(envs)
    from_xml = source.objects(once).cache()
    assert stored(from_xml) == {f"p{i}": e for i, e in enumerate(envs)}
    twice = source.objects(source.parts(sink.packages(from_xml, once, "json")))
    assert stored(twice) == {f"p{i}": e for i, e in enumerate(envs)}


def test_xml_is_ordered_and_well_formed(spark):
    env = {"submodels": [{"modelType": "Submodel", "submodelElements": [{"value": "1\r\x01", "modelType": "Property", "qualifiers": [{"value": "v", "type": "t", "kind": "k", "semanticId": ref("a")}], "valueType": "xs:int", "idShort": "P", "unknown": {"b": 1}}], "id": "i", "idShort": "S"}], "conceptDescriptions": []}
    docs = spark.createDataFrame([("a", json.dumps(env)), ("b", None), ("c", "{")], "package string, env string")
    got = {r.package: ElementTree.fromstring(r.xml) for r in xml.documents(docs).collect()}
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    submodel = got["a"][0][0]
    assert [tag(x) for x in submodel] == ["idShort", "id", "submodelElements"] and len(got["b"]) == len(got["c"]) == 0
    prop = submodel[2][0]
    assert [tag(x) for x in prop] == ["idShort", "qualifiers", "valueType", "value", "unknown"] and prop[3].text == "1\r�" and prop[4][0].text == "1"
    assert [tag(x) for x in prop[1][0]] == ["semanticId", "kind", "type", "value"]


def test_edits_leave_the_rest(spark):
    keep = {"vendor": {"deep": [1, 2.5]}}
    elements = [
        {"idShort": "P", "modelType": "Property", "valueType": "xs:string", "value": "old", "qualifiers": [{"type": "T", "valueType": "xs:string", "value": "v", "semanticId": ref("q", "r")}], **keep},
        {"idShort": "N", "modelType": "Property", "valueType": "xs:double", "value": "1.50"},
        {"idShort": "R", "modelType": "ReferenceElement", "value": {**ref("urn:x", "p"), "referredSemanticId": ref("s")}},
        {"idShort": "Rel", "modelType": "RelationshipElement", "first": ref("urn:1", "a"), "second": ref("urn:2", "b"), **keep},
        {"idShort": "L", "modelType": "SubmodelElementList", "typeValueListElement": "Property", "value": [{"modelType": "Property", "valueType": "xs:string", "value": "one", **keep}]},
    ]
    env = {"submodels": [{"modelType": "Submodel", "id": "urn:s", "semanticId": ref("urn:sem", "t"), "submodelElements": elements, **keep}]}
    objects = source.objects(read(spark, zipped({"a.json": json.dumps(env)}))).cache()
    docs = objects.select(F.col("package").alias("template"), "doc")
    form = {"elements": {"P": {"value": "new"}, "R": {"value": "q"}, "Rel": {"first": "z"}, "L": {"items": [{}, {"value": "two"}]}}}
    subs = spark.createDataFrame([("s", "p0", json.dumps(form))], "submission_id string, template string, form string")
    done = hydrate.to_documents(hydrate.merge(subs, tree.flatten(docs), forms.flatten(subs)))
    whole = done.join(objects.select(F.col("package").alias("template"), F.get_json_object("doc", "$.source").alias("own")), "template")
    doc = F.concat(F.lit('{"source":'), "own", F.lit(","), F.substring("doc", 2, 1 << 30))
    got = json.loads(whole.select(sink.exchange_json(doc, F.lit("n")).cast("string").alias("j")).first().j)["submodels"][0]
    want = json.loads(json.dumps(env))["submodels"][0]
    e = want["submodelElements"]
    e[0]["value"], e[2]["value"]["keys"][1]["value"], e[3]["first"]["keys"][1]["value"] = "new", "q", "z"
    e[4]["value"].append({**e[4]["value"][0], "value": "two"})
    assert got == want
