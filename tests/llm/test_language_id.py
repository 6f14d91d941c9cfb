import random
import time
import zlib

import numpy as np
import pytest

from leafmill.llm import language_id as lid

from .odd import ROWS, SCHEMA

SOUNDS = {"xa": ["sta", "ren", "mio", "lel"], "xb": ["grü", "tsch", "ach", "eng"], "xc": ["да", "не", "про", "ско"]}


def text(rng, lang, words):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def frame(spark, rows):
    """(doc_id, text, lang) beside columns of the operators' own names."""
    return spark.createDataFrame([(d, t, g, "s", 1, "x") for d, t, g in rows], "doc_id long, text string, lang string, source string, score int, lang_pred string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(i, text(rng, lang := rng.choice([*SOUNDS]), rng.choice([6, 30, 200])), lang) for i in range(400)]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in lid.initial(3, units=5).items()}
    rows, y = rng.integers(60, 130, (4, lid.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = lid.gradients(w, rows, y)
    for k in w:
        for _ in range(3):
            i = tuple(int(rng.integers(0, s)) for s in w[k].shape)
            i = (int(rows[1, 3]), i[1]) if k[0] == "E" else i
            old, e, out = w[k][i], 1e-6, []
            for v in (old + e, old - e):
                w[k][i] = v
                out.append(lid.gradients(w, rows, y)[0])
            w[k][i] = old
            assert (out[0] - out[1]) / 2 / e == pytest.approx(g[k][i], abs=1e-7)


def test_hot_path_equals_the_plain_network():
    """``label`` against a loop over positions in double precision."""
    rng = np.random.default_rng(1)
    w = lid.initial(4)
    rows = rng.integers(0, 256, (3, lid.LENGTH)).astype(np.uint8)
    sign = lambda x: x / (1 + np.abs(x))
    for r, got in zip(rows, lid.label(w, rows).transpose(2, 1, 0), strict=True):
        logits = np.tile(w["bias"].astype(float), (lid.LENGTH, 1))
        for d, order in (("f", range(lid.LENGTH)), ("b", reversed(range(lid.LENGTH)))):
            h = np.zeros(lid.UNITS)
            for t in order:
                a, z = (0.5 + 0.5 * sign(w[f"E{d}{k}"][r[t]].astype(float) + h @ w[f"U{d}{k}"]) for k in "rz")
                c = sign(w[f"E{d}n"][r[t]] + a * (h @ w[f"U{d}n"]))
                h = c + z * (h - c)
                logits[t] += h @ w[f"W{d}"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        assert np.abs(p / p.sum(axis=1, keepdims=True) - got).max() < 1e-4


def test_held_out_accuracy_and_what_is_learned_from(spark, rows):
    docs = frame(spark, rows)
    model = lid.train(docs, steps=120)
    got = {r.doc_id: r for r in lid.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(r.held_out == held(d) and 0 <= r.score <= 1 for d, r in got.items())
    assert np.mean([got[d].lang_pred == g for d, _, g in rows if held(d)]) > 0.97
    # Held-out labels, however wrong, change nothing.
    wrong = lid.train(frame(spark, [(d, t, "xz" if held(d) else g) for d, t, g in rows]), steps=120)
    assert wrong.languages == model.languages and all(np.array_equal(a, wrong.weights[k]) for k, a in model.weights.items())
    again = lid.train(docs.repartition(7), steps=120)
    assert all(np.array_equal(a, again.weights[k]) for k, a in model.weights.items())


def test_positions_of_a_mixed_text(spark, rows):
    rng = random.Random(5)
    model = lid.train(frame(spark, rows), steps=120)
    a, b = text(rng, "xa", 40) + " ", text(rng, "xc", 40)
    runs = lid.label_positions(frame(spark, [(1, a + b, None), (2, None, None)]), model).collect()
    runs = {r.doc_id: r.runs for r in runs}
    assert runs[2] == [] and runs[1][0].start == 0 and runs[1][-1].end == len((a + b).encode()) and all(x.end == y.start for x, y in zip(runs[1], runs[1][1:], strict=False))
    inside = lambda lang, lo, hi: sum(max(0, min(r.end, hi) - max(r.start, lo)) for r in runs[1] if r.lang == lang)
    n = len(a.encode())
    assert inside("xa", 0, n) > 0.9 * n and inside("xc", n, n + len(b.encode())) > 0.9 * len(b.encode())


def test_odd_rows(spark, rows):
    model = lid.train(frame(spark, rows), steps=60)
    odd = spark.createDataFrame([(d, t, "s", 1, 2, 3, "k", "d", "n") for d, t in ROWS], SCHEMA)
    got = lid.identify(odd, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in got) == sorted((str(d), not any(map(str.isalpha, t or ""))) for d, t in ROWS)
    assert all(r.lang_pred == "und" and r.score == 0 for r in lid.identify(frame(spark, [(1, "", "xa"), (2, None, "xa"), (3, "12 ½ ² _ 5!", "xa"), (4, "😀😀", None)]), model).collect())
    for few in ([], [(1, "abc", None)], [(None, "abc", "xa")], [(1, None, "xa"), (2, "", "xb")]):
        none = lid.train(frame(spark, few))
        assert not none.languages and {r.lang_pred for r in lid.identify(frame(spark, rows[:3]), none).collect()} == {"und"}
    alone = lid.train(frame(spark, [(i, f"abc {i}", "xa") for i in range(9)]), steps=5)
    assert {(r.lang_pred, round(r.score, 6)) for r in lid.identify(frame(spark, [(1, "abc", None)]), alone).collect()} == {("xa", 1.0)}


def test_long_texts(spark, rows):
    model = lid.train(frame(spark, rows), steps=60)
    rng = random.Random(7)
    long = text(rng, "xc", 300_000)
    began = time.time()
    got = {r.doc_id: r for r in lid.identify(frame(spark, [(1, long, None), (2, "x" * 3_000_000, None), (3, "1" * 3_000_000 + "x", None), (4, "7 " * 2_000_000, None)]), model).collect()}
    assert time.time() - began < 100 and got[1].lang_pred == "xc" and got[3].lang_pred != "und" and got[4].lang_pred == "und"
