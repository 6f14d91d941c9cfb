"""Fill-in-middle transformation on ropes.

A text's units are ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched from the left. It becomes a rope: a balanced
tree whose leaves hold runs of units and cache how many units and code points they have, as inner nodes do for what is
below them. Two cuts at unit ranks give three subtrees, which are concatenated anew with leaves of sentinels between
them; no text is copied but that of the two leaves that are cut. The inverse splits the output's rope at the sentinels'
code points and concatenates the subtrees in the old order.

Cuts, form and order follow from the sha256 of ``42:`` and the decimal doc_id, so a retried task gives the same rows.
Each row is transformed where it lies: no shuffle, and a task holds a megabyte of text at a time, or one text.

Defined results: a null text is empty; an empty text, and one that holds a sentinel's string, stays plain; a null doc_id
is hashed as no digits (``42:``); rows of equal doc_id and text get equal results, each its own row; texts of any
length are cut as a whole (depth of a rope: the logarithm of its leaves); other columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import blocks, give_back

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units in a leaf.
LEAF = 256
#: Of 100 texts so many are rearranged, and of 100 of those so many start with the suffix.
RATE, SPM_RATE = 50, 80

_UNIT = re.compile(r"[ \t-\r]*+[^ \t-\r]++|[ \t-\r]++")
_RUN = re.compile(r"(?:[ \t-\r]*+[^ \t-\r]++){1,%d}+|[ \t-\r]++" % LEAF)
_SENTINEL = re.compile("<[PSM]>")


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf with text, or a node with two subtrees; both know their units, code points and height."""

    units: int
    chars: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None
    height: int = 0


EMPTY = Rope(0, 0, "")


def leaf(text: str, units: int | None = None) -> Rope:
    return Rope(sum(1 for _ in _UNIT.finditer(text)) if units is None else units, len(text), text) if text else EMPTY


def _join(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, None, a, b, 1 + max(a.height, b.height))


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node over two ropes whose heights differ by two at most, turned so that they differ by one."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _join(a.left, _join(a.right, b))
        return _join(_join(a.left, a.right.left), _join(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _join(_join(a, b.left), b.right)
        return _join(_join(a, b.left.left), _join(b.left.right, b.right))
    return _join(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """Both in order: the lower one is hung in where its height fits, and the way back is balanced."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _balanced(a.left, concat(a.right, b))
    if b.height > a.height + 1:
        return _balanced(concat(a, b.left), b.right)
    return _join(a, b)


def build(text: str) -> Rope:
    """Leaves of ``LEAF`` units, level by level joined in pairs. Only the last two leaves have to be counted."""
    runs = _RUN.findall(text)
    level = [leaf(r, LEAF if i < len(runs) - 2 else None) for i, r in enumerate(runs)]
    while len(level) > 1:
        level = [_join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def split(rope: Rope, at: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """The first ``at`` units (or code points) and the rest."""
    size = rope.units if by_units else rope.chars
    if at <= 0:
        return EMPTY, rope
    if at >= size:
        return rope, EMPTY
    if rope.text is not None:
        if by_units:
            for n, m in enumerate(_UNIT.finditer(rope.text), 1):
                if n == at:
                    return leaf(rope.text[: m.end()], at), leaf(rope.text[m.end() :], rope.units - at)
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    first = rope.left.units if by_units else rope.left.chars
    if at <= first:
        a, b = split(rope.left, at, by_units)
        return a, concat(b, rope.right)
    a, b = split(rope.right, at - first, by_units)
    return concat(rope.left, a), b


def text_of(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if r.text is not None:
            out.append(r.text)
        else:
            todo += (r.right, r.left)
    return "".join(out)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hash, as numbers."""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def rearrange(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle (null if plain), output."""
    rope, (h1, h2, h3, h4) = build(text), draws(doc_id)
    if not text or h3 % 100 >= RATE or _SENTINEL.search(text):
        return rope.units, "plain", None, None, text
    begin, end = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    rest, suffix = split(rope, end)
    prefix, middle = split(rest, begin)
    p, s, m = (leaf(x, 0) for x in (PREFIX, SUFFIX, MIDDLE))
    form, order = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < SPM_RATE else ("psm", (p, prefix, s, suffix, m, middle))
    out = EMPTY
    for part in order:
        out = concat(out, part)
    return rope.units, form, prefix.chars, middle.chars, text_of(out)


def restored(output: str, form: str) -> str:
    """The text, from output and form alone: the output is split at its three sentinels, which no rearranged text holds
    itself, and which cannot arise where parts meet, as only a sentinel's first sign is a ``<`` and its last a ``>``."""
    if form == "plain":
        return output
    rope, parts = build(output), {}
    for m in reversed([*_SENTINEL.finditer(output)]):
        rope, tail = split(rope, m.start(), by_units=False)
        parts[m.group()] = split(tail, m.end() - m.start(), by_units=False)[1]
    return text_of(concat(concat(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _in_blocks(of, names):
    """A mapInArrow function that gives columns ``names`` of ``of(row lists)`` for about a megabyte of text at a time."""

    def run(batches):
        import pyarrow as pa

        give_back()
        for b in batches:
            sizes = [range(len(x.as_buffer())) if x.is_valid else None for x in b.column(b.num_columns - 1)]
            for i, j in blocks(sizes):
                yield pa.RecordBatch.from_arrays(of(b.slice(i, j - i)), names)

    return run


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output."""

    def each(b):
        import pyarrow as pa

        made = [rearrange(d, t or "") for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return [b.column(0), *(pa.array([r[k] for r in made], t) for k, t in enumerate(kinds))]

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return src.mapInArrow(_in_blocks(each, names), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """``made`` (form and output, and any other columns) with the text rebuilt from these two."""
    from pyspark.sql.types import StringType, StructType

    rest = [c for c in made.columns if c not in ("form", "output", "restored")]
    src = made.select(*rest, "form", "output")

    def each(b):
        import pyarrow as pa

        back = [restored(o, f) for f, o in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
        return [*b.columns, pa.array(back, pa.string())]

    return src.mapInArrow(_in_blocks(each, [*src.columns, "restored"]), StructType([*src.schema.fields]).add("restored", StringType()))
