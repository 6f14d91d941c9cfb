"""Texts of a megabyte without a rest: every operator has to end, in time that grows with the text."""

import time

import pytest

from leafmill.llm import chat_quotes, decontam, line_dedup, lm_score, near_dedup, packing, quality_classifier, quality_rules, token_counts, token_store

MB = 1_000_000
TEXTS = ["1." * (MB // 2), "a'" * (MB // 2), ">" * MB, "A" * MB + "b", "ha " * (MB // 3), "a 1 " * (MB // 4), "x\n" * (MB // 2), "", None]
LIMIT = 150


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int")


def timed(frame):
    began = time.time()
    rows = frame.collect()
    assert time.time() - began < LIMIT
    return rows


def test_quality_rules(docs):
    got = {r.doc_id: r for r in timed(quality_rules.judge(docs))}
    assert got[3].n_words == 1 and got[4].n_words == MB // 3 == got[4].n_repeat_words and got[6].n_dup_lines == MB // 2 - 1
    assert not got[3].fail_bits & 16 and got[2].n_symbols == MB


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "ha " * 30), (2, "a 1 " * 10), (3, "1.1.1"), (4, "some question of ten words that is not there now")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in timed(decontam.contaminated(docs, items))) == [(4, 1), (5, 2)]


def test_quotes(spark):
    rows = [(1, i, "u", t) for i, t in enumerate(TEXTS)] + [(1, 20, "u", "> ha ha ha\n> ha"), (1, 21, "u", "\n".join("> " + "a 1 " * 50 for _ in range(2000)))]
    got = {r.turn: r for r in timed(chat_quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))}
    assert got[20].reply_to == 4 and got[21].reply_to == 5 and got[2].own_text == "" and len(got) == len(rows)


def test_token_operators(spark, docs, tmp_path):
    store = timed(token_store.encode_and_read(docs, path=f"{tmp_path}/store"))
    counts = timed(token_counts.count_tokens(token_counts.line_sections(docs)))
    pieces = timed(packing.pack(docs))
    assert len(store) == len(TEXTS) and sum(r.n_tokens - 1 for r in store) == sum(r.tokens for r in counts)
    assert {r.doc_id for r in pieces} == {*range(len(TEXTS))}


def test_dedup_operators(docs):
    assert {r.doc_id: r.n_dropped for r in timed(line_dedup.dedup_lines(docs))} == dict.fromkeys(range(len(TEXTS)), 0)
    assert all(r.kept for r in timed(near_dedup.near_duplicates(docs, k=2)))


def test_models(docs, labels):
    assert len(timed(lm_score.score(docs, labels))) == len(TEXTS) == len(timed(quality_classifier.classify(docs, labels)))
