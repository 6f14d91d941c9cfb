"""Token counts by section, attributed through offset mappings.

A document is encoded once, as a whole; character spans are joined to the document's sections (an interval join within
a block of rows: both lists are sorted, so it is two binary searches a span): first those of its pieces, then, where
a piece is not in one section, those of its tokens. A token that lies in one section counts there. One that crosses
a boundary is allocated by a named rule:

- ``majority``: to the section that holds most of its characters, of equals the first;
- ``start``: to the section that holds its first character, else to none;
- ``share``: to all sections it touches, in proportion to its characters there.

Tokens that touch no section are counted under section null.

Defined results: sections are taken in the order of their starts and begin no earlier than the end of the section
before; a null or empty text has one empty section (by ``line_sections``) without tokens; null or repeated
doc_ids are passed through; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, blocks, encoder

RULES = ("majority", "start", "share")


def line_sections(docs: DataFrame) -> DataFrame:
    """doc_id, text, ends: a document's lines, each with its newline, as the ends of adjoining sections."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.transform(lines, lambda x: F.char_length(x) + 1).alias("n"))
    last = F.array_size("n") - 1
    sized = F.transform("n", lambda x, i: F.when(i == last, x - 1).otherwise(x).cast("long"))
    return out.select("doc_id", "text", sized.alias("lengths"))


def field_sections(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, sections from a table of spans (doc_id, name, start, end); a document's spans are gathered."""
    each = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name"))).alias("sections"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(each, "doc_id", "left")


def allocate(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per section (begin, end; sorted, disjoint): its tokens and how many of them cross; per token its share in none."""
    counts, crossing, none = np.zeros(len(begin)), np.zeros(len(begin), np.int64), np.ones(len(starts))
    if not len(begin) or not len(starts):
        return counts, crossing, none
    first = np.searchsorted(end, starts, "right")
    many = np.maximum(0, np.searchsorted(begin, ends, "left") - first)
    # One row a token and section that it may touch.
    of = np.repeat(np.arange(len(starts)), many)
    section = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]
    over = np.minimum(end[section], ends[of]) - np.maximum(begin[section], starts[of])
    of, section, over = (x[over > 0] for x in (of, section, over))
    whole = over == (ends - starts)[of]
    np.add.at(crossing, section[~whole], 1)
    if rule == "share":
        part = over / (ends - starts)[of]
        np.add.at(counts, section, part)
        return counts, crossing, none - np.bincount(of, part, len(starts))
    if rule == "majority":
        order = np.lexsort((section, -over, of))
        chosen = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
    else:
        chosen = np.flatnonzero((begin[section] <= starts[of]) & (starts[of] < end[section]))
    np.add.at(counts, section[chosen], 1)
    none[of[chosen]] = 0
    return counts, crossing, none


def block_counts(enc: Encoder, texts: list[str], doc: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section of the texts (``doc``: its text), and the tokens of none, by text.

    All texts lie on one line, one place between them. A piece of a text that lies in one section counts with all its
    tokens; only the tokens of other pieces are looked at by their offsets."""
    cut = enc.cut(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    begin, end = begin + base[doc], end + base[doc]
    pieces = [p for c in cut for p in c]
    of = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.cumsum(size) - size + of  # a place between texts for each text before
    n = np.fromiter(map(len, map(enc.ids.__getitem__, pieces)), np.int64, len(pieces)) // enc.width.itemsize
    section = np.minimum(np.searchsorted(end, at, "right"), max(len(end) - 1, 0))
    inside = (begin[section] <= at) & (at + size <= end[section]) if len(end) else np.zeros(len(pieces), bool)
    cross = np.flatnonzero(~inside)
    starts, ends, which = enc.offsets([pieces[k] for k in cross], at[cross])
    counts, crossing, none = allocate(starts, np.maximum(ends, starts + 1), begin, end, rule)
    counts += np.bincount(section[inside], n[inside], len(begin))
    return counts, crossing, np.bincount(of[cross[which]], none, len(texts))


def count_tokens(sectioned: DataFrame, rule: str = "majority", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, section (0-based, null: tokens of no section), name, start, end, tokens (double), crossing.

    ``sectioned`` has ``lengths`` (adjoining sections, from 0) or ``sections`` (start, end, name)."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    plain = "lengths" in sectioned.columns

    def run(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts, 1 << 19):
                ids, spec = b.column(0).slice(i, j - i), b.column(2).slice(i, j - i)
                many = np.array([len(x) if x.is_valid else 0 for x in spec], np.int64)
                doc = np.repeat(np.arange(j - i), many)
                if plain:
                    size = spec.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    end = np.cumsum(size)
                    end -= np.repeat(np.concatenate([[0], end])[np.cumsum(many) - many], many)
                    begin, names = end - size, pa.nulls(len(doc), pa.string())
                else:
                    flat = spec.flatten()
                    begin, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                    names = flat.field(2)
                    for k in np.flatnonzero(np.diff(doc, prepend=-1)):  # sections begin no earlier than the last one's end
                        own = slice(k, k + many[doc[k]])
                        begin[own] = np.maximum(begin[own], np.concatenate([[0], np.maximum.accumulate(end[own])[:-1]]))
                        end[own] = np.maximum(begin[own], end[own])
                counts, crossing, none = block_counts(enc, texts[i:j], doc, begin, end, rule)
                rest = np.flatnonzero(none > 1e-9)
                section = np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
                blank, text = pa.nulls(len(rest), pa.int64()), pa.nulls(len(rest), pa.string())
                cols = [
                    pa.concat_arrays([ids.take(pa.array(doc)), ids.take(pa.array(rest))]),
                    *(pa.concat_arrays([x, y]) for x, y in ((pa.array(section), blank), (names, text), (pa.array(begin), blank), (pa.array(end), blank))),
                    pa.array(np.concatenate([counts, none[rest]])),
                    pa.array(np.concatenate([crossing, np.zeros(len(rest), np.int64)])),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "section", "name", "start", "end", "tokens", "crossing"])

    src = sectioned.select("doc_id", "text", "lengths" if plain else "sections")
    return src.mapInArrow(run, "doc_id long, section long, name string, start long, end long, tokens double, crossing long")
