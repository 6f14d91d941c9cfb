"""Corpus-wide line deduplication.

Every text is split at newlines; a line's key is the line without white space (U+0020, U+0009-U+000D) at both
ends and with A-Z lower-cased. Keys are hashed to 96 bits, each document's distinct hashes are exploded and
counted, and hashes found in at least ``min_docs`` documents lose all their lines everywhere. What stays is
reassembled by position.

Texts are read twice and shuffled once; between, only hashes move. A line that is in a third of all documents is
added up before the shuffle. The frequent hashes are broadcast to the lines while they are few; if not, the join has
one row a hash on that side, so Spark can split a common line's others freely.

Defined results: a document is a row, so rows with the same or a null doc_id count as so many documents; a null
or empty text is one empty line and stays as it is (a null text comes back as the empty text from
``dedup_lines`` and as null from ``clean_documents``); a document that loses all lines keeps its row, with an
empty text; other columns are kept by ``clean_documents`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, broadcast_if_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer ASCII white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """Per line its key's hash, or null for keys of under ``min_chars`` code points."""

    def one(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b")))

    return F.transform(lines_of(text), one)


def frequent(hashed: DataFrame, min_docs: int) -> DataFrame:
    """From rows with ``hashes``: the distinct hashes (a, b) found in at least ``min_docs`` rows."""
    each = hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null").select("h.a", "h.b")
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("a", "b")


def _marked(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """doc (all columns of ``docs``), drops (0-based line positions to drop, or null)."""
    scratch = Scratch(docs.sparkSession)
    keys = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")]
    # Rows of equal id and text lose equal lines, so those two tell rows apart well enough.
    hashed = scratch.table(docs.select(*keys, _hashes(F.col("text").cast("string"), min_chars).alias("hashes")), "lines")
    lines = hashed.select("id", "th", F.posexplode("hashes").alias("pos", "h")).where("h is not null").select("id", "th", "pos", "h.a", "h.b")
    common = scratch.table(frequent(hashed, min_docs), "frequent")
    hit = lines.join(broadcast_if_small(common, 40), ["a", "b"])  # broadcast, no line is dealt by its hash
    drops = hit.groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
    whole = docs.select(F.struct("*").alias("doc"), *keys)
    same = whole["id"].eqNullSafe(drops["id"]) & (whole["th"] == drops["th"])
    return whole.join(drops, same, "left").select("doc", "drops")


def _reassembled(marked: DataFrame) -> DataFrame:
    """doc, n_dropped, kept: the text without its dropped lines (null where none is dropped)."""
    text = F.col("doc.text").cast("string")
    lines = marked.select("doc", "drops", F.when(F.col("drops").isNotNull(), lines_of(text)).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return lines.select("doc", F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"), F.when(F.col("drops").isNotNull(), kept).alias("kept"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text."""
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    return _reassembled(_marked(docs, min_docs, min_chars)).select(
        F.col("doc.doc_id").alias("doc_id"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.coalesce("kept", text).alias("kept_text"),
    )


def clean_documents(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows and columns of ``docs``; ``text``, and ``n_chars`` where there is one, of rows that lost lines anew."""
    out = _reassembled(_marked(docs, min_docs, min_chars))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    cols = []
    for f in docs.schema.fields:
        old = F.col(f"doc.`{f.name}`")
        cols.append((F.coalesce(new[f.name].cast(f.dataType), old) if f.name in new else old).alias(f.name))
    return out.select(*cols)
