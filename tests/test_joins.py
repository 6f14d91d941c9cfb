"""Joins of tables that both grow shuffle both sides, however few bytes their files have."""

import json
import re

from pyspark.sql import functions as F

from leafmill.landing import land
from leafmill.operators import hydrate, tree, typing, validate
from leafmill.plans import form_queries, package_queries
from leafmill.sinks import packages as sink
from leafmill.sources import forms
from leafmill.sources import packages as source
from tests.fixtures import GOOD, submissions, templates, with_
from tests.test_packages import read, zipped


def merged(df, *keys):
    """The number of sort-merge joins on these keys in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"SortMergeJoin(?:\(.*\))? \[" + ", ".join(k + r"#\d+" for k in keys) + r"\]", plan))


def test_subtrees(spark):
    nodes = tree.flatten(templates(spark))
    under = tree.subtrees(nodes, nodes.where("depth = 0").select("template", F.col("sort").alias("top")))
    assert merged(under, "template", "top") == 1 and under.count() > nodes.count() / 2


def test_default_documents(spark, monkeypatch):
    landed, land = {}, tree.land
    monkeypatch.setattr(tree, "land", lambda df, name: landed.setdefault(name, df) and land(df, name))
    docs = tree.default_documents(tree.flatten(templates(spark)))
    assert merged(landed["defaults"], "template", "steps", "sort") == merged(landed["defaults"], "template", "sort") == 1
    assert merged(docs, "template", "steps") == 4 and docs.count() == 1


def test_renest(spark):
    docs = tree.renest(tree.flatten(templates(spark)))
    assert merged(docs, "template", "sort") == 3 and docs.count() == 1


def test_form_renest(spark):
    rows = forms.flatten(submissions(spark, {"s": GOOD}), whole=True)
    back = forms.renest(rows)
    assert merged(back, "submission_id", "steps") == 3 and back.count() == 1
    assert merged(form_queries.forms_renested(spark, "/root/testdata/sf0.001"), "submission_id") == 1


def test_validation(spark):
    flat = forms.flatten(submissions(spark, {"s": GOOD, "t": with_(Serial=...)}))
    found = validate.run(tree.flatten(templates(spark)), flat)
    assert merged(found, "submission_id", "steps") == 1 and found.count() == 1


def test_client_typing(spark):
    flat = forms.flatten(submissions(spark, {"s": GOOD}), whole=True)
    found = typing.run(tree.flatten(templates(spark)), flat)
    assert merged(found, "submission_id", "steps") == 1 and found.count() > 0


def test_hydration(spark, monkeypatch):
    landed, land = {}, hydrate.land
    monkeypatch.setattr(hydrate, "land", lambda df, name: landed.setdefault(name, []).append(df) or land(df, name))
    subs = submissions(spark, {"s": GOOD})
    done = hydrate.merge(subs, tree.flatten(templates(spark)), forms.flatten(subs))
    assert merged(landed["merged"][0], "submission_id", "steps") == 1 and done.count() > 0
    assert merged(landed["level"][0], "submission_id") == 1  # without the bad ones
    assert merged(landed["level"][1], "submission_id", "steps") == 2  # lists, and what forms ask of them: for clones and prototypes


def test_packages(spark):
    part = json.dumps({"submodels": [{"modelType": "Submodel", "id": "urn:s", "submodelElements": []}]})
    parts = land(read(spark, zipped({"aasx/data.json": part, "files/a.txt": "x"})), "parts")
    found = land(source.objects(parts), "objects")
    again = sink.packages(found, parts)
    assert merged(again, "package") == merged(again, "package", "part") == 1 and source.parts(again).count() == 6
    same = package_queries.package_lossless(spark, "/root/testdata/sf0.001")
    assert merged(same, "package") == 2
