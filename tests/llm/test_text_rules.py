import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.llm import line_dedup, quality_rules
from leafmill.llm.sql import OP1

from .odd import ROWS, frame, plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    under = {p for i, k in enumerate(windows) if many[k] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len({*lines}), len(under)


def test_measurements_against_python(spark):
    got = quality_rules.judge(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(d, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]) for d, t in ROWS for m in [measured(t)]]
    assert plain(got) == plain(want)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_rules_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    rows = [(i, t) for i, (d, t) in enumerate(ROWS)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, base_failed, kept, fail_bits FROM ({OP1})").fetchall()}
    got = {r.doc_id: (r.base_failed, r.kept, r.fail_bits) for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert got == want


def test_policies_and_ablations_come_from_the_ledger(spark):
    ledger = quality_rules.ledger(quality_rules.measure(frame(spark))).cache()
    bits = [r.fail_bits for r in ledger.collect()]
    for p in quality_rules.POLICIES:
        m = quality_rules.mask(p)
        assert quality_rules.apply_policy(ledger, p).where("kept").count() == sum(b & m == 0 for b in bits)
    for r in quality_rules.ablations(ledger).collect():
        m = next(quality_rules.mask(p) for p in quality_rules.POLICIES if p.version == r.version)
        bit = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule)
        want = (len(bits), sum(b & bit > 0 for b in bits), sum(b & m > 0 for b in bits), sum(b & m == bit for b in bits), sum(b & m == 0 and b & bit > 0 for b in bits))
        assert (r.n_docs, r.n_failed, r.n_rejected, r.n_only, r.n_added) == want


def dropped(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    many = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if many[key(x)] < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_lines_against_python(spark, least):
    rows = [*ROWS, *[(20 + i, f"own {i}\n\tSHARED Line \nother {i % 2}\n\nÀ shared") for i in range(11)], (20, "own 0\n\tSHARED Line \nother 0\n\nÀ shared")]
    docs = frame(spark, rows)
    got = line_dedup.dedup_lines(docs, least).withColumn("kept_text", F.sha2("kept_text", 256)).collect()
    assert plain(got) == plain(dropped(rows, least))
    clean = line_dedup.clean_documents(docs, least)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    want = {h for *_, h in dropped(rows, least)}
    assert {hashlib.sha256((r.text or "").encode()).hexdigest() for r in clean.collect()} == want
    assert clean.where("doc_id = 3").first().text is None
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
