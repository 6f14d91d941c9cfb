"""Quotation linking on random nested conversations against a brute-force version."""

import random
import re

import pytest

from leafmill.llm import chat_quotes

SCHEMA = "conv_id long, turn long, role string, text string, thread int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def parse(text):
    """(level, text) of the passages."""
    out = []
    for line in (text or "").replace("\r", "").split("\n"):
        marks = re.match(r"(?:[ \t]*>)*", line).group()
        level = marks.count(">")
        line = re.sub(r"^[ \t]", "", line[len(marks) :]) if level else line
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(k, "\n".join(x)) for k, x in out]


def brute(rows):
    """(conv_id, turn) -> reply_to, thread, depth, n_quotes, n_linked, and the turns of each conversation in reply order."""
    facts, orders = {}, {}
    for c in {r[0] for r in rows}:
        texts = {t: parse(x) for conv, t, _, x in rows if conv == c}
        own = {t: re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in p if k == 0).strip(" \t\n")) for t, p in texts.items()}
        runs = {}
        for t, o in own.items():
            at, n, heads = 0, len(words(o)), set()
            for unit in re.split(r"\n[\x20\x09-\x0D]*|(?<=[.!?…])[\x20\x09-\x0D]+", o):
                heads.add(at)
                at += len(words(unit))
            runs[t] = (words(o), heads - {n})
        held = lambda t, q: any(runs[t][0][h : h + len(q)] == q for h in (runs[t][1] if len(q) < 4 else range(len(runs[t][0]))))  # noqa: E731, B023
        reply, depth, thread, kids = {}, {}, {}, {}
        for t in sorted(texts):
            quoted = [(k, i, words(x)) for i, (k, x) in enumerate([p for p in texts[t] if p[0] > 0]) if words(x)]
            linked = [(k, i, min(s for s in texts if held(s, q))) for k, i, q in quoted if any(held(s, q) for s in texts)]
            linked = [x for x in linked if x[2] < t]
            reply[t] = min(linked)[2] if linked else t - 1 if t - 1 in texts else None
            depth[t], thread[t] = (0, t) if reply[t] is None else (depth[reply[t]] + 1, thread[reply[t]])
            kids.setdefault(reply[t], []).append(t)
            facts[c, t] = (reply[t], thread[t], depth[t], len(quoted), len(linked), own[t])
        order, stack = [], sorted(kids.get(None, []), reverse=True)
        while stack:
            order.append(stack.pop())
            stack.extend(sorted(kids.get(order[-1], []), reverse=True))
        orders[c] = order
    return facts, orders


def conversation(rng, c, turns, branching):
    vocabulary = [f"word{i}" for i in range(40)] + ["Yes", "no"]
    own, rows, t = {}, [], 0
    for _ in range(turns):
        t += rng.choice([1, 1, 1, 1, 2])
        lines = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))]
        text = "\n".join(lines)
        if own and rng.random() < branching:
            s = rng.choice(list(own))
            w, kind = own[s].split("\n"), rng.randrange(4)
            i = rng.randrange(len(w))
            part = {0: w, 1: w[i : i + 2], 2: [re.split(r"(?<=[.!?]) ", w[i])[-1]], 3: [" ".join(" ".join(w).split()[:3]).upper()]}[kind]
            deep = rng.choice(["> ", ">", "> > ", ">>> "])
            text = "\n".join(deep + x for x in part) + rng.choice(["\n", "\n\n", "\r\n"]) + text
            if rng.random() < 0.3:
                text += "\n> nothing of that kind\nend"
        own[t] = "\n".join(lines)
        rows.append((c, t, "user", text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [r for c in range(12) for r in conversation(rng, c, rng.randrange(1, 25), rng.choice([0.0, 0.4, 0.9]))]
    got = chat_quotes.link(frame(spark, rows)).collect()
    facts, orders = brute(rows)
    assert {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked, r.own_text) for r in got} == facts
    for c, order in orders.items():
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.turn for r in mine] == order and [r.position for r in mine] == [*range(len(mine))]


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Where is the red house?\n\nI need it."), (1, 1, "assistant", "On the hill."), (1, 2, "user", ">  On the   HILL.\nThanks."),
        (1, 3, "user", "> > Where is the red house?\n> On the hill.\nSame here."), (1, 4, "user", ">unknown words\nHm."), (1, 5, "user", "> I need it.\r\n"),
        (2, 0, "user", "> On the hill."), (2, 1, None, None), (None, 1, "user", "> x"), (3, None, "user", "a"), (4, 7, "user", ""), (2, 1, "user", "> On the hill."),
    ]
    said = frame(spark, rows)
    got = chat_quotes.link(said)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert got.count() == len(rows)
    assert [by[1, t].reply_to for t in range(6)] == [None, 0, 1, 1, 3, 0]
    assert by[1, 3].n_quotes == 2 and by[1, 3].n_linked == 2 and by[1, 4].n_linked == 0 and by[1, 2].own_text == "Thanks." and by[1, 5].own_text == ""
    assert {by[1, t].thread for t in range(6)} == {0} and [by[1, t].depth for t in range(6)] == [0, 1, 2, 2, 3, 1] and by[2, 0].reply_to is None and by[4, 7].own_text == ""
    assert [by[1, t].position for t in range(6)] == [0, 1, 2, 3, 4, 5] and by[None, 1].position is None and by[3, None].position is None
    assert sorted(r.position for r in got.where("conv_id = 2").collect()) == [0, 1, 2]
    order = [(r.conv_id, r.turn) for r in chat_quotes.conversations(got.where("conv_id = 1")).collect()]
    assert order.index((1, 1)) < order.index((1, 2)) and len(order) == 6
    assert chat_quotes.link(said.where("false")).count() == 0


def test_parts_of_a_message(spark):
    text = "First line here\nsecond line there\nthird one. It has a sentence, and more. End"
    quoted = ["> First line here\n> second line there", "> second line\n> there third one.", ">It has a sentence, and more.", "> line there", "  > > third one."]
    got = {r.turn: r for r in chat_quotes.link(frame(spark, [(1, 0, "a", text), (1, 1, "b", "x"), *((1, 2 + i, "c", q + "\nmine") for i, q in enumerate(quoted))])).collect()}
    assert [got[2 + i].reply_to for i in range(5)] == [0, 0, 0, 4, 0] and got[5].n_linked == 0


@pytest.mark.parametrize("mark", [chr(0x2028), chr(0x2029), chr(0x85)])
def test_lines_with_unicode_line_ends(spark, mark):
    rows = [(1, 0, "user", f"first{mark}second"), (1, 1, "user", "other"), (1, 2, "user", f"> first{mark}second\nYes{mark}no.")]
    got = {r.turn: r for r in chat_quotes.link(frame(spark, rows)).collect()}
    assert got[0].own_text == f"first{mark}second" and got[2].own_text == f"Yes{mark}no." and (got[2].n_linked, got[2].reply_to) == (1, 0)


def test_quotes_that_begin_inside_a_sentence(spark):
    said = "We met in the old house by the river, and later in the old house by the sea. In the end all of us went home."
    long = " ".join(f"w{i}" for i in range(3000))
    asked = ["> the old house by the sea.", "> the old house by the road.", "> by the sea.", "> old house by\n> the river, and later in", "> went home.", "> us went home. And", "> all of us went home."]
    rows = [(1, 0, "a", said), (1, 1, "b", long), *[(1, 2 + i, "c", q + "\nwhy?") for i, q in enumerate(asked)], (1, 20, "c", "> " + " ".join(f"w{i}" for i in range(7, 2990))), (2, 0, "a", "other"), (2, 1, "b", asked[0])]
    got = {(r.conv_id, r.turn): (r.n_linked, r.reply_to) for r in chat_quotes.link(frame(spark, rows)).collect()}
    assert [got[1, 2 + i][0] for i in range(len(asked))] == [1, 0, 0, 1, 0, 0, 1] and got[1, 2] == (1, 0) and got[1, 20] == (1, 1) and got[2, 1] == (0, 0)
    facts, _ = brute(rows)
    assert {k: (v[4], v[0]) for k, v in facts.items()} == got
