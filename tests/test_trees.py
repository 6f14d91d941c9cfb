import json

from pyspark.sql import functions as F

from leafmill.operators import hydrate, tree, validate
from leafmill.sources import forms
from tests.fixtures import GOOD, TEMPLATE, submissions, templates, with_


def test_flatten_paths_and_order(spark):
    nodes = tree.flatten(templates(spark))
    rows = nodes.orderBy("sort").collect()
    paths = [r.path for r in rows]
    assert paths[:5] == ["Serial", "Year", "Name", "Note", "Address"]
    assert "Address.Geo.Deep.Leaf" in paths and "Marks[1].Label" in paths and "Asset.State" in paths and "ARel.Why" in paths
    assert paths.index("Address.Street") == paths.index("Address") + 1
    assert [p for p in paths if p.startswith("Op.")] == ["Op.In"]  # the null variable is dropped
    assert {r.path: r.depth for r in rows}["Address.Geo.Deep.Leaf"] == 3


def test_renest_is_the_inverse(spark):
    odd = {"elements": [{"idShort": "A", "modelType": "Property", "value": 'q"é\\'}, {"idShort": "E", "modelType": "SubmodelElementCollection", "elements": []}]}
    docs = spark.createDataFrame([("t", json.dumps(TEMPLATE)), ("u", json.dumps(odd))], "template string, doc string")
    got = {r.template: json.loads(r.doc) for r in tree.renest(tree.flatten(docs)).collect()}
    want = json.loads(json.dumps(TEMPLATE))
    want["elements"][15]["inputVariables"] = want["elements"][15]["inputVariables"][:1]
    assert got["t"]["elements"] == want["elements"] and got["u"] == odd
    assert tree.renest(tree.flatten(docs.limit(0))).collect() == []


def test_bad_documents_give_no_rows(spark):
    docs = spark.createDataFrame([("a", None), ("b", "not json"), ("c", "{}"), ("d", "")], "template string, doc string")
    nodes = tree.flatten(docs)
    assert nodes.where("error IS NULL").count() == 0
    assert [(r.template, r.error) for r in nodes.collect()] == [("b", tree.UNREADABLE)]  # null and blank ones are no documents at all


def test_preview_cuts_by_depth_and_counts(spark):
    rows = {r.path: r for r in tree.preview(tree.flatten(templates(spark))).collect()}
    assert rows["Address"].child_count == 2 and rows["Address.Geo"].child_count == 2 and "Address.Geo.Deep" in rows and "Address.Geo.Deep.Leaf" not in rows
    assert rows["Marks"].item_count == 2 and rows["Tags"].item_count == 0 and rows["Tags"].list_type == "Property"
    assert not any("[" in p or p.startswith("Asset.") for p in rows)


def findings(spark, cases, **options):
    nodes = tree.flatten(templates(spark))
    out = validate.run(nodes, forms.flatten(submissions(spark, cases)), **options)
    got = {}
    for r in out.orderBy("submission_id", "sort", "rule").collect():
        got.setdefault(r.submission_id, []).append((r.severity, r.field, r.code))
    return {k: got.get(k, []) for k in cases}


def test_validation_rules(spark):
    e = "error"
    cases = {
        "good": (GOOD, []),
        "v1": (with_(Serial=...), [(e, "Serial", "required")]),
        "v1parent": (with_(Address=...), [(e, "Address", "required")]),
        "v1child": (with_(Address={"elements": {}}), [(e, "Address.Street", "required")]),
        "v1null": (with_(Address=None), [(e, "Address.Street", "required")]),
        "v2": (with_(Marks={"items": []}), [(e, "Marks", "min_items")]),
        "v3": (with_(Tags={"items": [{}, {}, {}]}), [(e, "Tags", "max_items")]),
        "v4": (with_(Marks={"items": [{"elements": {"Label": {"value": "a"}}}, {"elements": {"Label": {"value": ""}, "Code": {"value": "x"}}}]}), [(e, "Marks[1].Label", "required_value"), (e, "Marks[1].Code", "type_mismatch")]),
        "v6": (with_(Serial={"value": ""}), [(e, "Serial", "required_value")]),
        "v7": (with_(Year={"value": "12.7"}), [(e, "Year", "type_mismatch")]),
        "v7ok": (with_(Year={"value": True}), []),
        "v8": (with_(Name={"value": {"en": ""}}), [(e, "Name", "required_translation")]),
        "v8blank": (with_(Name={"value": {"en": " "}}), []),
        "v9": (with_(Note={"value": {}}), [("warning", "Note", "recommended_value")]),
        "v11": (with_(Limits={"min": "a", "max": "b"}), [(e, "Limits.min", "type_mismatch"), (e, "Limits.max", "type_mismatch")]),
        "v11half": (with_(Limits={"min": "1"}), []),
        "v14": (with_(Ref={"value": "nope"}), [(e, "Ref", "invalid_reference")]),
        "v14irdi": (with_(Ref={"value": "0173-1#02-AAO677#002"}), []),
        "entity": (with_(Asset={"statements": {}}), []),
        "none": (None, [(e, "Serial", "required"), (e, "Name", "required"), (e, "Address", "required"), (e, "Marks", "required")]),
    }
    got = findings(spark, {k: v[0] for k, v in cases.items()})
    assert got == {k: v[1] for k, v in cases.items()}
    nodes, subs = tree.flatten(templates(spark)), submissions(spark, {"good": GOOD, "v9": cases["v9"][0], "v6": cases["v6"][0]})
    verdict = {r.submission_id: r.valid for r in validate.verdicts(subs, validate.run(nodes, forms.flatten(subs))).collect()}
    assert verdict == {"good": True, "v9": True, "v6": False}


def test_validation_compat_and_options(spark):
    assert ("error", "Year", "required") in findings(spark, {"a": with_(Year=...)}, compat=True)["a"]
    assert findings(spark, {"a": with_(Ref={"value": "0173-1#02-AAO677#002"})}, compat=True)["a"][-1][1:] in {("Ref", "invalid_reference"), ("Ev", "required")}
    assert findings(spark, {"a": with_(Limits={"min": "5", "max": "1"})}, check_range_order=True)["a"] == [("warning", "Limits", "range_order")]


def hydrated(spark, form, **options):
    nodes, subs = tree.flatten(templates(spark)), submissions(spark, {"s": form})
    merged = hydrate.merge(subs, nodes, forms.flatten(subs), **options)
    return {r.path: r for r in merged.collect()}, json.loads(hydrate.to_documents(merged).first().doc)


def test_hydration_keeps_what_is_absent(spark):
    rows, doc = hydrated(spark, {"elements": {}})
    want = {r.path for r in tree.flatten(templates(spark)).collect()}
    assert {*rows} == want and rows["Serial"].value == "S1" and rows["Manual"].content_type == "application/pdf"
    by = {e["idShort"]: e for e in doc["elements"]}
    assert by["Serial"]["semanticLabel"] == "Serial number" and by["Name"]["value"] == {"en": "Pump", "de": "Pumpe"} and by["Limits"]["max"] == 10


def test_hydration_rules(spark):
    form = {
        "elements": {
            "Serial": {"value": None}, "Year": {"value": "2024.9"}, "Name": {"value": {"en": "x", "de": " "}}, "Note": {"value": {"en": ""}},
            "Address": {"elements": {"Street": {"value": "Main"}, "Geo": {"elements": {"Lat": {"value": "bad"}}}}},
            "Manual": {"value": "/m2.pdf"}, "Raw": {"value": "", "contentType": "a/b"}, "Limits": {"min": "2"}, "Ref": {"value": "q"},
            "Asset": {"globalAssetId": "urn:b", "statements": {"State": {"value": "off"}}}, "Rel": {"first": "urn:9", "second": ""},
            "ARel": {"second": "urn:8", "annotations": [{"value": "so"}, {"value": "extra"}]}, "Nobody": {"value": "ignored"}, "Loose": {"items": [{"value": "1"}]},
            "Tags": {"items": [{"value": "4"}, {"value": "5"}]}, "Marks": {"items": [{"elements": {"Label": {"value": "new"}}}, {}, {"elements": {"Code": {"value": "8"}}}]},
        }
    }
    r, doc = hydrated(spark, form)
    assert r["Serial"].value is None and r["Year"].value == "2024" and r["Address.Street"].value == "Main" and r["Address.Geo.Lat"].value == "bad"
    assert [tuple(e) for e in r["Name"].languages] == [("en", "x")] and r["Note"].languages == []
    assert (r["Manual"].value, r["Manual"].content_type) == ("/m2.pdf", "application/pdf") and (r["Raw"].value, r["Raw"].content_type) == ("old", "a/b")
    assert (r["Limits"].min, r["Limits"].max) == ("2.0", "10") and [k.value for k in r["Ref"]["keys"]] == ["http://a", "q"]
    assert r["Asset"].global_asset_id == "urn:b" and r["Asset.State"].value == "off" and (r["Rel"].first, r["Rel"].second) == ("urn:9", "urn:2")
    assert r["ARel"].second == "urn:8"
    assert (r["Tags[0]"].value, r["Tags[1]"].value) == ("4", "5") and "Loose[0]" not in r and "Nobody" not in r
    assert r["Marks[0].Label"].value == "new" and r["Marks[1].Label"].value == "UL" and r["Marks[2].Label"].value == "CE" and r["Marks[2].Code"].value == "8" and r["Marks[2]"].cloned
    by = {e["idShort"]: e for e in doc["elements"]}
    assert by["Year"]["value"] == 2024 and len(by["Marks"]["items"]) == 3 and by["Tags"]["items"][1]["value"] == 5 and "value" not in by["Serial"]
    short, _ = hydrated(spark, {"elements": {"Marks": {"items": [{}]}}})
    assert "Marks[1]" not in short and short["Marks[0].Label"].value == "CE"


def test_hydration_is_idempotent(spark):
    form = {"elements": {"Serial": {"value": "Z"}, "Marks": {"items": [{"elements": {"Label": {"value": "n"}}}, {}, {}]}}}
    _, once = hydrated(spark, form)
    docs = spark.createDataFrame([("t", json.dumps(once))], "template string, doc string")
    subs = submissions(spark, {"s": form})
    twice = json.loads(hydrate.to_documents(hydrate.merge(subs, tree.flatten(docs), forms.flatten(subs))).first().doc)
    assert twice == once


def test_compat_erases(spark):
    r, _ = hydrated(spark, {"elements": {"Manual": {}, "Serial": {}}}, compat=True)
    assert r["Manual"].content_type is None and r["Serial"].value is None and r["Year"].value == "2020"


def test_default_form(spark):
    rows = {r.path: r for r in tree.default_form(tree.flatten(templates(spark))).collect()}
    assert rows["Address.Street"].value == "" and rows["Serial"].value == "S1" and rows["Limits"].max == "10" and rows["Address"].value is None


def test_empty_tables(spark):
    nodes, subs = tree.flatten(templates(spark)), submissions(spark, {"s": GOOD}).where("false")
    assert validate.run(nodes, forms.flatten(subs)).count() == 0 and hydrate.merge(subs, nodes, forms.flatten(subs)).count() == 0
    assert hydrate.merge(submissions(spark, {"s": GOOD}), nodes.where("false"), forms.flatten(submissions(spark, {"s": GOOD}))).where(F.lit(True)).count() == 0


def test_deep_and_unreadable_documents(spark):
    """Every level is there, or the document is one row with an error, in trees, forms, findings and results."""

    def nested(n):
        doc = {"idShort": "n", "modelType": "Property", "value": "x"}
        for _ in range(n - 1):
            doc = {"idShort": "n", "modelType": "SubmodelElementCollection", "elements": [doc]}
        return json.dumps({"elements": [doc]})

    docs = spark.createDataFrame([("ok", nested(12)), ("far", nested(600))], "template string, doc string")
    nodes = tree.flatten(docs)
    assert nodes.where("template = 'ok'").count() == 12 and [(r.template, r.error) for r in tree.unreadable(nodes).collect()] == [("far", tree.UNREADABLE)]
    form = lambda n: '{"elements":{"n":' * n + '{"value":"y"}' + "}}" * n
    subs = spark.createDataFrame([("a", "ok", form(12)), ("b", "ok", form(600)), ("c", "far", form(1)), ("d", "ok", "{")], "submission_id string, template string, form string")
    flat = forms.flatten(subs)
    assert {r.submission_id: (r.d, r.e) for r in flat.groupBy("submission_id").agg(F.max("depth").alias("d"), F.max("error").alias("e")).collect()} == {"a": (11, None), "b": (-1, tree.UNREADABLE), "c": (0, None), "d": (-1, tree.UNREADABLE)}
    found = {(r.submission_id, r.code, r.message) for r in validate.run(nodes, flat).collect()}
    assert found == {("b", "unreadable", "Form cannot be read"), ("c", "unreadable", "Template cannot be read"), ("d", "unreadable", "Form cannot be read")}
    done = {r.submission_id: (r.doc, r.error) for r in hydrate.to_documents(hydrate.merge(subs, nodes, flat)).collect()}
    assert '"value":"y"' in done["a"][0] and done["a"][1] is None and all(done[k][0] is None and done[k][1] for k in "bcd")


def test_labels_tell_nodes_apart(spark):
    twins = {"elements": [{"idShort": "a", "modelType": "Property", "value": "1"}, {"idShort": "a", "modelType": "Property", "value": "2"}, {"modelType": "Property", "value": "3"}, {"idShort": "[2]", "modelType": "Property", "value": "4"}]}
    docs = spark.createDataFrame([("t", json.dumps(twins))], "template string, doc string")
    nodes = tree.flatten(docs)
    assert json.loads(tree.renest(nodes).first().doc) == twins and nodes.select("sort").distinct().count() == 4
    assert [tuple(r.steps) for r in nodes.orderBy("sort").collect()] == [(".a",), (".a",), ("#2",), (".[2]",)]
    both = nodes.alias("x").join(tree.flatten(templates(spark)).alias("y"), F.lit(True))
    assert both.where(tree.is_below(F.col("x.sort"), F.col("x.sort"))).count() == 0
    whole = tree.flatten(templates(spark))
    pairs = whole.alias("x").join(whole.alias("y"), F.expr("y.path = 'Address'")).where(tree.is_below(F.col("x.sort"), F.col("y.sort"))).select("x.path").collect()
    assert sorted(r.path for r in pairs) == ["Address.Geo", "Address.Geo.Deep", "Address.Geo.Deep.Leaf", "Address.Geo.Lat", "Address.Street"]
    under = tree.subtrees(whole, whole.where("path = 'Address'").select("template", F.col("sort").alias("top")))
    assert under.count() == 6


def test_hot_templates_are_spread(spark, monkeypatch):
    """The join by hand: broadcast off, a hot template over several copies of its rows, equal results."""
    from leafmill import landing

    nodes, subs = tree.flatten(templates(spark)), submissions(spark, {str(i): GOOD for i in range(40)} | {"bad": with_(Serial=...)})
    flat = forms.flatten(subs)
    plain = sorted(map(str, validate.run(nodes, flat).collect())), sorted((r.submission_id, r.path, str(r.value)) for r in hydrate.merge(subs, nodes, flat).collect())
    monkeypatch.setattr(landing, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(landing, "HOT", 7)
    spread = sorted(map(str, validate.run(nodes, flat).collect())), sorted((r.submission_id, r.path, str(r.value)) for r in hydrate.merge(subs, nodes, flat).collect())
    assert plain == spread and len(plain[0]) == 1
