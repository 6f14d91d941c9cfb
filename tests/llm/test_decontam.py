"""Decontamination against a brute-force version: every window of every document against every window of every item."""

import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from leafmill.llm import decontam
from leafmill.llm.common import Scratch

from .odd import ROWS, frame

TOKEN = regex.compile(r"\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[%°€$£¥]")
SLOTS = ("<n>", "<c>", "<u>")
ITEMS = [(1, "What is the speed of Anna Smith if she runs 12 km in 3 hours on a flat road near Berlin?"), (2, "Short item of seven words only here"), (3, None), (4, ""), (5, "what is THE speed of anna")]


def canonical(raw):
    out = []
    for i, x in enumerate(raw):
        if regex.match(r"\p{N}", x):
            out.append("<n>")
        elif x.lower() in decontam.UNITS and i and regex.match(r"\p{N}", raw[i - 1]):
            out.append("<u>")
        elif regex.match(r"\p{Lu}[\p{Ll}\p{M}]", x) and x not in decontam.FUNCTION_WORDS and not (i and (regex.match(r"\p{N}", raw[i - 1]) or raw[i - 1].lower() in decontam.ARTICLES)):
            out.append("<c>")
        else:
            out.append(x.lower())
    return out


def key(raw, canon):
    """What windows are compared by."""
    return tuple(x.lower() for x in raw) if sum(c in SLOTS for c in canon) * 2 > len(canon) else (*canon, None)


def brute(rows, items, min_cover=0.5):
    first = {}
    for i, t in items:
        if t is not None:
            first[t] = min(i, first.get(t, i))
    out = set()
    for d, text in {(d, t) for d, t in rows if t}:
        raw = TOKEN.findall(text)
        canon, n = canonical(raw), len(raw)
        known = {size: defaultdict(list) for size in (8, 4)}
        for size, at in known.items():
            for p in range(n - size + 1):
                at[key(raw[p : p + size], canon[p : p + size])].append(p)
        for t, item in first.items():
            iraw = TOKEN.findall(t)
            m, icanon = len(iraw), canonical(iraw)
            low = [x.lower() for x in iraw]
            forms = [(iraw, icanon), (low, canonical(low)), (iraw, ["<c>"] * m)]
            met = set()  # place in the item, kind, item value, document value

            def meet(q, p, width):
                a, b = iraw[q : q + width], raw[p : p + width]
                if p < 0 or len(b) < width or any(x.lower() != y.lower() and (u != v or u not in SLOTS) for x, y, u, v in zip(a, b, icanon[q:], canon[p:], strict=False)):
                    return
                if width < 8 and sum(c not in SLOTS for c in icanon) < 4 and [x.lower() for x in a] != [x.lower() for x in b]:
                    return
                met.update((q + k, icanon[q + k] if icanon[q + k] in SLOTS else None, a[k].lower(), b[k].lower()) for k in range(width))

            if 0 < m < 4:
                if n == m and [x.lower() for x in raw] == low:
                    meet(0, 0, m)
            elif m < 8:
                for r, c in forms:
                    for p in known[4][key(r[:4], c[:4])]:
                        meet(0, p, m)
            else:
                for r, c in forms:
                    for q in range(m - 7):
                        for p in known[8][key(r[q : q + 8], c[q : q + 8])]:
                            meet(q, p, 8)
            votes = Counter(x[1:] for x in met)
            rank = lambda k, a, b: (a != b, -votes[k, a, b])
            to = {}
            for k, a, b in votes:
                to[k, a] = min(to.get((k, a), ((True, 1), "")), (rank(k, a, b), b)) if (k, a) in to else (rank(k, a, b), b)
            of = {}
            for (k, a), (r, b) in to.items():
                of[k, b] = min(of[k, b], (r, a)) if (k, b) in of else (r, a)
            fits = lambda k, a, b: k is None or (to[k, a][1] == b and of[k, b][1] == a)  # noqa: E731, B023
            covered = {p for p, *x in met if fits(*x)}
            slots = {p for p, k, *_ in met if k}
            if met and 2 * len(slots & covered) >= len(slots) and len(covered) >= min_cover * m:
                exact = {p for p, _, a, b in met if a == b} == {p for p, *_ in met}
                out.add((d, item, m, len(covered), exact))
    return sorted(out, key=str)


def found(docs, items):
    return sorted((tuple(r) for r in decontam.contaminated(docs, items).collect()), key=str)


def test_new_parameters(spark):
    items = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, doc_id string")
    asked = "Before. What is the speed of Peter Jones if she runs 7 km in 15 hours on a flat road near Paris? After."
    mixed = "What is the speed of Peter Jones if she runs 7 km in 7 hours on a flat road near Peter?"
    rows = [*ROWS, (30, "Long text " * 50 + ITEMS[0][1] + " more"), (31, asked), (32, "The weather of Anna is fine, she runs often on a road."), (33, "Short item of SEVEN words only here"), (34, mixed)]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): (r.n_tokens - r.covered, r.exact) for r in decontam.contaminated(docs, items).collect()}
    # 34 is item 1 with two pairs of values that became equal: those slots count for one of each pair only.
    assert got == {(30, 1): (0, True), (30, 5): (0, True), (31, 1): (0, False), (33, 2): (0, True), (34, 1): (2, False)}
    assert found(docs, items) == brute(rows, ITEMS)
    left = decontam.clean_documents(docs, items)
    assert left.columns == docs.columns and left.count() == len(rows) - 4
    assert decontam.contaminated(frame(spark, []), items).count() == 0 and decontam.contaminated(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("text", ["What is 17 + 25?", "Compute 12 + 30 - 7 * 5.", "Convert 12 km to miles", "John Smith bought 12 apples, Mary Jones bought 7."])
def test_copies_dense_in_slots(spark, text):
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so it was {text} and then"), (2, "What is 18 + 26? Convert 9 kg to euros. Compute 1 + 2.")], "doc_id long, text string")
    assert [(r.doc_id, r.exact) for r in decontam.contaminated(docs, items).collect()] == [(1, True)]


def test_copies_of_other_case(spark):
    text = "When did Maria meet Peter Jones in Paris, and why did Anna leave Rome for Berlin with Carl?"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(1, text.lower()), (2, "x " + text.upper()), (3, "when did she leave, and why did anna go to rome"), (4, "He asked: " + text.title())]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.exact) for r in got) == [(1, True), (2, True), (4, True)]


def test_copies_with_a_changed_slot(spark):
    item = "When did Anna pay 12 coins to the man who sold Anna the boat that Anna had seen near the old bridge of 30 stones?"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("sold Anna", "sold Ana")), (2, item.replace("30", "12")), (3, item.replace("Anna", "Maria").replace("sold Maria", "sold Mara"))]
    got = {r.doc_id: (r.n_tokens - r.covered, r.exact) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (1, False)}


def test_consistency_holds_over_all_windows_of_an_item(spark):
    """One more word between the halves shifts the second, and changes nothing for the slots of both."""
    left, right = "they asked how many small red boxes {} could carry home", "later it was said that old {} never came back again"
    items = spark.createDataFrame([(1, left.format("Anna") + " and " + right.format("Anna"))], "item_id long, text string")
    one, two = left.format("Peter"), right.format("Paul")
    docs = spark.createDataFrame([(1, f"{one} and {two}"), (2, f"{one} and then {two}"), (3, f"{one} and " + right.format("Peter"))], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens - r.covered for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_short_items_need_the_whole(spark):
    items = spark.createDataFrame([(1, "yes"), (2, "Twelve red boxes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "he said yes and left"), (2, "Yes."), (3, "twelve red boxes"), (4, "twelve red boxes stood there")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(2, 1), (3, 2)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["the", "box", "of", "Anna", "Peter", "12", "7", "km", "runs", "Near", "red", "3.5", "kg", "and", "What", "it's"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 6, 7, 8, 9, 15, 25]))) for i in range(25)] + [(90, "a 1 " * 8), (91, "ha " * 20), (92, None)]
    items.append((3, items[5][1]))
    rows = [(i, text(rng.choice([2, 6, 30]))) for i in range(20)]

    def changed(t):
        new = {w: rng.choice(words) for w in words}
        out = [new[w] if w in new and rng.random() < 0.4 and canonical([w])[0] in SLOTS else w for w in t.split()]
        if rng.random() < 0.3:
            out.insert(rng.randrange(len(out) + 1), "extra")
        t = " ".join(out)
        return rng.choice([t, t, t.lower(), t.upper(), t.title()])

    rows += [(100 + i, f"{text(5)} {changed(t)} {text(4)} {changed(t)}") for i, (_, t) in enumerate(items) if t] + [(200 + i, changed(t)) for i, (_, t) in enumerate(items) if t]
    rows += [(300, "a 2 " * 50 + "a 1 " * 9), (301, "ha " * 70), (None, rows[30][1]), (100, rows[25][1]), (100, rows[20][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, spark.createDataFrame(items, "item_id long, text string")) == brute(rows, items)


def test_recall_on_questions_asked_anew(spark):
    """Items of prose with two names and two numbers, each copied with other names and numbers."""
    rng = random.Random(5)
    names, verbs = [f"N{''.join(rng.choice('aeiou') + rng.choice('lmnr') for _ in range(2))}" for _ in range(60)], [f"w{i}o" for i in range(300)]
    verbs = [re.sub(r"\d", lambda m: "abcdefghij"[int(m.group())], v) for v in verbs]

    def item():
        w = [rng.choice(verbs) for _ in range(30)]
        for p, k in zip(rng.sample(range(30), 4), "ccnn", strict=True):
            w[p] = k
        return w

    def put(w):
        return " ".join(rng.choice(names) if x == "c" else str(rng.randrange(2, 999)) if x == "n" else x for x in w)

    made = [item() for _ in range(100)]
    items = spark.createDataFrame([(i, put(w)) for i, w in enumerate(made)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{put(item())} {put(w)} {put(item())}") for i, w in enumerate(made)] + [(1000 + i, put(item())) for i in range(100)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert len({x for x in got if x[0] == x[1]}) >= 90 and not any(d >= 1000 for d, _ in got)


def test_capitalised_nouns_are_no_names(spark):
    """Unrelated German sentences of one pattern are clean; questions asked anew with other names and numbers are found in four languages."""
    nouns = "Hund Morgen Straße Baum Haus Vater Abend Wiese Mond Wald Tisch Garten Berg Fluss Himmel Vogel Brief Zug Wagen Stein".split()
    put = lambda w: f"Der alte {w[0]} lief am {w[1]} über die {w[2]} und sah den {w[3]} hinter dem {w[4]} stehen"
    item = put(nouns[:5])
    rng = random.Random(9)
    rows = [(i, put(rng.sample(nouns[5:], 5))) for i in range(1000)]
    rows += [(2000, "Wenn Peter Braun 7 Äpfel an Carl gibt, wie viele von den Äpfeln hat er dann noch übrig, fragte sie"), (2001, "If Mary gives 7 apples to Carl and then eats some, how many apples are there left at the end"),
             (2002, "Si Marie donne 7 pommes à Luc et en mange ensuite, combien de pommes lui restent à la fin du jour"), (2003, "Si Marta le da 7 manzanas a Luis y luego come algunas, cuántas manzanas le quedan al final del día"), (2004, "x " + item)]
    items = [(1, item), (2, "Wenn Anna Schmidt 3 Äpfel an Bob gibt, wie viele von den Äpfeln hat er dann noch übrig, fragte sie"), (3, "If Anna gives 3 apples to Bob and then eats some, how many apples are there left at the end"),
             (4, "Si Anne donne 3 pommes à Paul et en mange ensuite, combien de pommes lui restent à la fin du jour"), (5, "Si Ana le da 3 manzanas a Juan y luego come algunas, cuántas manzanas le quedan al final del día")]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(2000, 2), (2001, 3), (2002, 4), (2003, 5), (2004, 1)]


def test_template_types(spark):
    row = spark.createDataFrame([("Anna paid 3.5 km and 7 euros, don't run m. What",)], "text string").select(decontam.tokens(F.col("text")).alias("raw"))
    got = row.select(decontam.template(F.col("raw")).alias("t")).first().t
    assert got == ["<c>", "paid", "<n>", "<u>", "and", "<n>", "<u>", "don't", "run", "m", "what"]


def test_texts_need_no_sorted_aggregate(spark, tmp_path):
    """Each task of such an aggregate sorts and makes code of its own, however few rows it has."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (None, ITEMS[0][1]), (2, ITEMS[0][1])])
    scratch = Scratch(spark)
    windows = scratch.table(decontam.item_windows(items), "windows")
    shared = decontam.shared_windows(docs, decontam.places(docs, windows, scratch))
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    one = shared.where("id = 1").drop("id").collect()
    assert one and shared.count() == 3 * len(one) and shared.where("id is null").count() == len(one)
