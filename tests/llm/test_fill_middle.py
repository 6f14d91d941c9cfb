import hashlib
import random
import re
import time

from leafmill.llm import fill_middle as fim

from .odd import ROWS, frame


def expected(doc_id, text):
    """Straight from the definition, on a list of units."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(("42:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return (n, "plain", None, None, text)
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_the_definition(spark):
    rng = random.Random(1)
    words = ["a", "bc", "  ", "\n", "é", "😀x", "\u2028", "<", "S>", "<S", "\xa0", "\x85", "\t\t", ">", "<M"]
    rows = ROWS + [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 3, 50, 2000])))) for i in range(20, 220)] + [(300, "x <P> y"), (301, "<M>"), (302, " \n "), (303, " lead"), (304, "tail \n")]
    made = fim.transform(frame(spark, rows))
    got = fim.restore(made).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(str((d, *expected(d, t))) for d, t in rows)
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"} and fim.transform(frame(spark, [])).count() == 0


def test_ropes_cut_and_join():
    rng = random.Random(2)
    text = "".join(rng.choice(["w", "longer", "é"]) + rng.choice([" ", "  \n"]) for _ in range(30_000))
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    rope = fim.build(text)
    assert rope.units == len(units) and rope.chars == len(text) and fim.text_of(rope) == text
    for _ in range(50):
        at = rng.randrange(len(units) + 1)
        a, b = fim.split(rope, at)
        assert (a.units, b.units, a.chars + b.chars) == (at, len(units) - at, len(text)) and fim.text_of(a) == "".join(units[:at])
        rope = fim.concat(b, a) if rng.random() < 0.3 else fim.concat(a, b)
        text = fim.text_of(rope)
        units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
        if rope.units != len(units):  # a turned text's parts met inside a unit: its ranks are no longer those of a new match
            rope = fim.build(text)
        assert rope.height < 20
        c, d = fim.split(rope, rng.randrange(len(text) + 1), by_units=False)
        assert fim.text_of(c) + fim.text_of(d) == text


def test_long_texts_end_in_time(spark):
    rows = [(i, t) for i in range(6) for t in ("a" * 3_000_000, " " * 3_000_000, "a " * 1_500_000, "\n" * 2_000_000 + "x")]
    began = time.time()
    got = fim.restore(fim.transform(frame(spark, rows))).collect()
    assert time.time() - began < 120 and sorted(r.restored for r in got) == sorted(t for _, t in rows)
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.restored) for r in got)
