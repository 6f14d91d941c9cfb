"""The stages, chained by brute-force versions on a small corpus."""

import random

import pytest

import corpus_pipeline
from leafmill.llm import decontam, line_dedup, quality_classifier

from .test_near_dedup import brute


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice(["water", "green", "stone", "river", "light", "house"]) + str(rng.randrange(40))
    rows = [(i, " ".join(word() for _ in range(30)) + "\nshared footer line\n" + " ".join(word() for _ in range(30))) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(5)] + [(70 + i, " ".join(rng.choice(["!!buy", "$$$", "click"]) for _ in range(50))) for i in range(30)]
    return rows, "How many apples does Anna have if she buys 12 apples and eats 3 of them today?"


@pytest.fixture
def data(spark, tmp_path):
    rows, question = corpus()
    rows += [(200, f"{rows[0][1][:200]} Intro. {question}"), (201, rows[1][1].replace("\n", " ", 1))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 70), 0) for d, _ in rows if d < 100], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_stages_take_effect_in_order(spark, data):
    sf, docs = data
    got = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), docs.schema)
        assert now.columns == docs.columns
        got.append({r.doc_id: r.text for r in now.collect()})
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {d: t for d, t in texts.items() if model.score(quality_classifier.indicators(t)) >= 0.5}
    assert got[0] == good and not any(70 <= d < 100 for d in good) and {*range(60)} <= {*good}
    assert all("shared footer line" not in t.split("\n") for t in got[1].values()) and {*got[1]} == {*good}
    comp = brute(sorted(got[1].items()), 5)
    assert {*got[2]} == {d for d, (n, c) in comp.items() if d == c}
    assert {*got[2]} - {*got[3]} == {200}
    run = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in run} == {*got[3]}
    assert sum(r.length for r in run) == sum({r.doc_id: r.doc_tokens for r in run}.values())


def test_empty_corpus(spark, data, tmp_path):
    sf, docs = data
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert line_dedup.clean_documents(docs.where("false")).columns == docs.columns == decontam.clean_documents(docs.where("false"), spark.read.parquet(f"{sf}/benchmark.parquet")).columns


def test_odd_rows(spark, data, tmp_path):
    """Nulls, repeated ids and columns of clashing names in every stage."""
    sf, docs = data
    good = [r.text for r in docs.where("doc_id < 3").collect()]
    rows = [(None, good[0]), (None, None), (300, None), (300, ""), (301, good[1]), (301, good[1]), (302, good[2]), (302, "stone42 " * 3 + good[2][:120])]
    more = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, "k", "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, th string, doc string")
    now = docs.selectExpr("*", "7L AS id", "'k' AS th", "'x' AS doc").unionByName(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf)
        assert out.columns == now.columns
        now = spark.createDataFrame(out.collect(), now.schema)
    left = [(r.doc_id, r.text) for r in now.collect()]
    # Null ids are never dropped as copies; the copies of documents 0 and 1 go, as rows of equal id and text do together.
    assert sum(d is None and t is not None for d, t in left) == 1 and not any(d == 301 for d, _ in left)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).select("doc_id").distinct().count() == len({d for d, _ in left})
