import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import lm_score, quality_classifier

from .odd import ROWS, frame, plain

def test_lm_losses_against_python(spark):
    rows = [(1, "a b a b c"), (2, "a b"), (3, None), (4, ""), (None, "c c"), (2, "a b"), (5, "Z z")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = lm_score.score(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r.target_loss is None for r in got if r.n_words == 0)
    split = lambda t: (t or "").lower().split()

    def model(docs):
        one, two = Counter(w for t in docs for w in split(t)), Counter(p for t in docs for p in zip(split(t), split(t)[1:], strict=False))
        n = sum(one.values())
        p = lambda w: (one[w] + 1) / (n + sum(map(bool, map(split, docs))) + lm_score.WORDS + 1)
        return lambda v, w: -math.log(p(w) if v is None else (two[v, w] + lm_score.MU * p(w)) / (one[v] + lm_score.MU))

    for r in got:
        for i, (d, t) in enumerate(rows):
            if r.doc_id == d and r.n_words == len(split(t)) > 0:
                w, rest = split(t), rows[:i] + rows[i + 1 :]  # its own counts are left out
                target, background = model([t for d, t in rest if d == 1]), model([t for _, t in rest])
                a, b = (sum(m(*x) for x in zip([None, *w], w, strict=False)) / len(w) for m in (target, background))
                assert (r.target_loss, r.background_loss, r.loss_difference) == pytest.approx((a, b, a - b), abs=1e-5)
    assert lm_score.score(frame(spark, []), labels).count() == 0 and lm_score.score(frame(spark, rows), labels.where("false")).count() == len(rows)


def test_lm_scores_likeness_not_membership(spark):
    """Labels drawn for no reason in the texts: both groups score alike."""
    rng = random.Random(11)
    rows = [(d, " ".join(f"w{rng.randrange(3000)}" for _ in range(200))) for d in range(400)]
    labels = spark.createDataFrame([(d, int(d < 40)) for d in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r.loss_difference for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    inside, outside = [got[d] for d in range(40)], [got[d] for d in range(40, 400)]
    assert abs(np.mean(inside) - np.mean(outside)) < 0.1 and min(inside) < np.mean(outside) < max(inside)


def test_lm_counts_every_word_and_pair_apart(spark):
    """More distinct words and bigrams than any table of a fixed size should hold."""
    rows = [(d, " ".join(f"w{(d * 9000 + i) % 300_000} b{i % 7}" for i in range(10_000))) for d in range(34)]
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(34)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), labels).collect()}
    models, size = [], len({w for _, t in rows for w in t.split()})
    assert size > lm_score.WORDS and len(got) == len(rows)
    for of in ([t for d, t in rows if d % 3 == 0], [t for _, t in rows]):
        one, two = Counter(w for t in of for w in t.split()), Counter(p for t in of for p in zip(t.split(), t.split()[1:], strict=False))
        models.append((one, two, sum(one.values()), len(of)))
    for d, t in rows:
        w = t.split()
        mine, pairs = Counter(w), Counter(zip(w, w[1:], strict=False))
        for k, ((one, two, n, docs), loss) in enumerate(zip(models, (got[d].target_loss, got[d].background_loss), strict=True)):
            out = k or d % 3 == 0
            c1, c2 = (lambda x: one[x] - mine[x] * out), (lambda v, x: two[v, x] - pairs[v, x] * out)
            p = [(c1(x) + 1) / (n + docs - (len(w) + 1) * out + size + 1) for x in w]
            q = p[:1] + [(c2(v, x) + lm_score.MU * y) / (c1(v) + lm_score.MU) for v, x, y in zip(w, w[1:], p[1:], strict=False)]
            assert max(q) <= 1 and loss == pytest.approx(-sum(map(math.log, q)) / len(q), abs=1e-9)


def labelled(spark, n=400):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["water", "green", "stone", "river", "light", "house"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["!!buy", "$$$", "click", "click", "zz9"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_classifier_holds_out_and_separates(spark):
    rows, labels = labelled(spark)
    got = quality_classifier.classify(frame(spark, [*rows, *ROWS]), labels).collect()
    assert len(got) == len(rows) + len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    fixed = {*range(11)}
    mine = [r for r in got if r.doc_id is not None and r.doc_id not in fixed and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in mine]) > 0.97
    kept = quality_classifier.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark).columns and 0 < kept.count() < len(rows)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r.doc_id: r.score for r in quality_classifier.classify(frame(spark, rows), x).collect()} for x in (labels, flipped))
    assert one == two


def test_classifier_without_labels(spark):
    rows, labels = labelled(spark, 30)
    assert {r.score for r in quality_classifier.classify(frame(spark), labels.where("false")).collect()} == {0.5}
    assert all(r.predicted == 1 for r in quality_classifier.classify(frame(spark, rows), labels.where("quality = 1")).collect())
    assert quality_classifier.classify(frame(spark, []), labels).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    """Over the vocabulary and the end of a document, after any word: a row asks for one of them, and is scored by the others."""
    rows, none = [(1, "a b a c"), (2, "b a"), (3, "c")], spark.createDataFrame([], "doc_id long, quality int")
    asked = lambda w: lm_score.score(spark.createDataFrame([*rows, (10, f"a {w}")], "doc_id long, text string"), none).where("doc_id = 10").first().background_loss
    one = Counter("abac" "ba" "c")
    n, d, v = sum(one.values()), 3, lm_score.WORDS
    p = lambda c: (c + 1) / (n + d + v + 1)
    seen = sum(math.exp(-asked(w) * 2) / p(one["a"]) for w in "abc")  # p(w | a) of the three words
    rest = (1 + lm_score.MU * (p(d) + (v - 3) * p(0))) / (one["a"] + lm_score.MU)  # one document ends in a
    assert seen + rest == pytest.approx(1, abs=1e-9)


def test_dual_solution_is_the_primals(spark):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(80)]
    x, y = [rng.normal(size=len(r)) for r in rows], np.where(rng.random(80) < 0.5, 1.0, -1.0)
    w, b = quality_classifier.dual_descent(rows, x, y, 1.0, 2000)
    dense = np.zeros((80, 41))
    for i, (r, v) in enumerate(zip(rows, x, strict=True)):
        dense[i, r], dense[i, 40] = v, 1
    value = lambda u: u @ u / 2 + (np.maximum(0, 1 - y * (dense @ u)) ** 2).sum()
    u = np.zeros(41)
    for _ in range(200):  # Newton steps on the primal, which is smooth but for its second derivative
        on = y * (dense @ u) < 1
        g = u - 2 * dense[on].T @ (y[on] * (1 - y[on] * (dense[on] @ u)))
        u -= np.linalg.solve(np.eye(41) + 2 * dense[on].T @ dense[on], g)
    assert value(np.append(w[:40], b)) == pytest.approx(value(u), rel=1e-3)


def test_ratios_are_those_of_the_counts():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab" if k else "bc") for _ in range(rng.randrange(1, 9))) for k in (0, 1) * 20]
    label = np.array([0, 1] * 20)
    rows = [quality_classifier.indicators(t) for t in texts]
    model = quality_classifier.fit(rows, label)
    learn = range(40)  # under 50 rows: none is kept for the sigmoid
    sums = [[1.0] * quality_classifier.SIZE for _ in (0, 1)]
    for i in learn:
        for k in rows[i]:
            sums[label[i]][k] += 1
    total = [math.fsum(s) for s in sums]
    for k in {int(k) for r in rows for k in r}:
        want = math.log(sums[1][k] / total[1]) - math.log(sums[0][k] / total[0])
        assert model.square[k] == pytest.approx(want**2, abs=1e-9)
    pairs = {t[i : i + 2] for t in texts for i in range(len(t) - 1)}
    assert {int(k) for r in rows for k in r if k < 65536} == {ord(p[0]) << 8 | ord(p[1]) for p in pairs}


def test_fit_is_bounded_by_indicators(spark):
    rows, labels = labelled(spark, 300)
    docs = frame(spark, rows)
    all_, few = quality_classifier.train(docs, labels), quality_classifier.train(docs, labels, max_ids=10_000)
    assert (all_.square != few.square).any() and np.mean([(few.score(quality_classifier.indicators(t)) >= 0.5) == (i % 3 > 0) for i, t in rows]) > 0.95
