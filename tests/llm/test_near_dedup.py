import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import near_dedup
from leafmill.llm.shingles import shingle_sets


def brute(rows, k, percent=80):
    """component of each doc_id by comparing all pairs of full sets."""
    sets = {d: {*shingle_sets(pa.array([t], pa.string()), k)[0].tolist()} for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def mutated(rng, base, rate):
    out = []
    for w in base:
        r = rng.random()
        if r < rate / 2:
            continue
        out.append(f"n{rng.randrange(400)}" if r < rate else w)
    return out


def corpus(seed, words=150):
    """Groups of copies at all distances from their origins, chains, exact copies and lone texts."""
    rng = random.Random(seed)
    rows, d = [], 0
    for g in range(4):
        base = [f"w{rng.randrange(300)}" for _ in range(words)]
        last = base
        for i in range(40):
            last = mutated(rng, last, 0.04) if g == 3 else mutated(rng, base, rng.choice([0, 0.02, 0.05, 0.08, 0.12, 0.2]))
            rows.append((d, " ".join(last)))
            d += 1
    rows += [(d + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))) for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k"), [(1, 2), (2, 2), (3, 5)])
def test_against_all_pairs(spark, seed, k):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert got == brute(rows, k)


def test_prefix_filter_loses_no_link(spark):
    """The candidates of a group hold every linked pair with one outside member, whatever set is the centre."""
    rows = corpus(7)[:120]
    sets = {d: shingle_sets(pa.array([t]), 2)[0] for d, t in rows}
    frame = spark.createDataFrame([(d, bytearray(s.tobytes())) for d, s in sets.items()], "id long, elements binary")
    members = spark.createDataFrame([(1, d, len(sets)) for d in sets], "g long, a long, many long")
    made = bytes(near_dedup.centres(members, frame).first().centre)
    for centre in (made, sets[rows[0][0]].tobytes(), sets[rows[50][0]].tobytes(), b""):
        middle = spark.createDataFrame([(1, bytearray(centre))], "g long, centre binary")
        found = near_dedup.differences(members.select("g", "a"), middle, frame).withColumn("e", near_dedup._excess(80)).collect()
        low = min(r.e for r in found)
        placed = spark.createDataFrame([(r.g, r.a, r.e, r["diff"], r.e + low > 0) for r in found], "g long, a long, e long, diff array<long>, out boolean")
        got = {(r.a, r.b) for r in near_dedup.open_candidates(placed, 80).collect()}
        out = {r.a for r in found if r.e + low > 0}
        linked = lambda a, b: 100 * len({*sets[a].tolist()} & {*sets[b].tolist()}) >= 80 * len({*sets[a].tolist()} | {*sets[b].tolist()})
        names = [r.a for r in found]
        nearest = min(found, key=lambda r: (r.e, r.a)).a
        for a in names:
            assert a in out or a == nearest or linked(a, nearest)
            for b in names:
                if a > b and (a in out or b in out) and linked(a, b):
                    assert (a, b) in got
        assert len(got) < len(names) * (len(names) - 1) / 2


def test_a_group_of_near_copies_makes_few_candidates(spark):
    """Copies of one text with edits of their own: what is compared grows with the copies, not with their pairs."""
    rng, n = random.Random(6), 500
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        w = list(base)
        for p in rng.sample(range(60), rng.choice([0, 1, 1, 2])):
            w[p] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    sets = [shingle_sets(pa.array([t]), 5)[0] for t in texts]
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, elements binary")
    members = spark.createDataFrame([(1, i, n) for i in range(n)], "g long, a long, many long")
    found = near_dedup.differences(members.select("g", "a"), near_dedup.centres(members, frame), frame).withColumn("e", near_dedup._excess(80)).collect()
    low = min(r.e for r in found)
    placed = spark.createDataFrame([(r.g, r.a, r.e, r["diff"], r.e + low > 0) for r in found], "g long, a long, e long, diff array<long>, out boolean")
    assert near_dedup.open_candidates(placed, 80).count() < 4 * n
    got = near_dedup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), 5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([*enumerate(texts)], 5)


def test_defined_results(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text.upper()), (None, text), (3, ""), (4, None), (5, " \n"), (6, "one"), (7, "ONE"), (2, text.upper()), (8, text + " tail"), (9, "two words")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int")
    got = sorted([tuple(r) for r in near_dedup.near_duplicates(docs, 2).drop("th").collect()], key=str)
    want = [(1, 29, 1, True), (2, 29, 1, False), (None, 29, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (2, 29, 1, False), (8, 30, 1, False), (9, 1, 9, True)]
    assert got == sorted(want, key=str)
    kept = near_dedup.keep_one(docs, 2)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 9]
    assert near_dedup.near_duplicates(docs.where("false"), 2).count() == 0 and near_dedup.keep_one(docs.where("false")).count() == 0


def test_texts_of_one_id_are_all_compared(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = spark.createDataFrame([(1, one), (1, two), (2, one + " tail"), (3, two + " tail")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
