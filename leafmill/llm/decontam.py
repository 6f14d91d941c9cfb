"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text's tokens are words, numbers and unit signs. Numbers, capitalised words (names; not function words, which open
sentences, and not words after an article or a number, which are common nouns where those are capitalised) and units
after a number become typed placeholders, other words are lower-cased: the template. Windows of
``WINDOW`` template tokens are hashed and hash-joined to the benchmark's, and in matching windows the slots are
compared: one benchmark value should always meet the same document value, and the other way round, over all windows
that document and item share. Where they contradict, equal values win, then the pairing met at most places of the
item, then the smaller value; the slots of the others do not count. So a question asked anew with other numbers and
names is caught, and chance agreement of placeholders is not.

A document is contaminated by an item if windows cover at least ``MIN_COVER`` of its tokens, contradicting slots left
out, and at least half of the slots in them are consistent.

A window of more than half slots is no template: it is hashed by its lower-cased tokens, values included. The benchmark's
windows are hashed as written, as lower-cased or upper-cased text has them, and as text with all words
capitalised has them; so verbatim copies are found whatever their numbers, names or case.

Short items: one of under ``WINDOW`` tokens has to be there as a whole (found by its first ``SEED`` tokens), word by word
where it has under ``SEED`` literal words; one of under ``SEED`` tokens contaminates only a document of no other tokens.
Items of equal text are one: the smallest item_id is reported.

Scale: document windows are joined while they are made and never shuffled if the benchmark's windows are
provably small enough to broadcast; otherwise both sides are shuffled by hash. After it only matches move. A window without
slots that a document repeats is one place, as are neighbouring places of one template with equal values; equal
windows of an item are one row with several offsets.

Defined results: null or wordless texts and items match nothing; rows of a null doc_id are matched like others;
rows of equal doc_id and text give one result; other columns are ignored, and kept by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, broadcast_if_small

WINDOW, SEED = 8, 4
MIN_COVER = 0.5
# Repeats of groups are possessive: Java's matcher recurses on others and runs out of stack on long tokens.
TOKEN = r"\p{N}++(?:[.,:/]\p{N}++)*+|[\p{L}\p{M}]++(?:['’][\p{L}\p{M}]++)*+|[%°€$£¥]"
NUMBER, NAME, UNIT = "<n>", "<c>", "<u>"
#: Unit words that count after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months "
    "year years meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds "
    "liter liters litre litres degree degrees dollar dollars cent cents euro euros percent % ° € $ £ ¥"
).split()
#: English words that are capitalised for opening a sentence, not for being names.
FUNCTION_WORDS = (
    "A An The This That These Those It Its He His She Her They Their We Our You Your What Which Who Whose When Where Why How If In On At By For From To Of "
    "Is Are Was Were Do Does Did Has Have Had Can Could Will Would Should May Might There Then And Or But So As After Before While Each Every All Both One Let Given Not No"
).split()

#: Articles, and prepositions that hold one, of four languages. A capitalised word after one is a noun, not a name: German has them all so.
ARTICLES = (
    "the a an der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner am im zum zur vom beim ins ans "
    "le la les un une du des au aux el los las una unos unas del al"
).split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(x: Column) -> Column:
    """Begins with a digit. Most tokens are told by their first byte."""
    return F.when(x < "a", (x >= "0") & (x < ":")).otherwise((x >= "\x80") & x.rlike(r"^\p{N}"))


def _is_name(x: Column, before: Column) -> Column:
    """Capitalised, and no function word; ``before``, the word before it, does not tell that it is a noun."""
    noun = F.coalesce(_is_number(before) | F.lower(before).isin(ARTICLES), F.lit(False))
    return (x >= "A") & ((x < "[") | (x >= "\x80")) & x.rlike(r"^\p{Lu}[\p{Ll}\p{M}]") & ~x.isin(FUNCTION_WORDS) & ~noun


def template(raw: Column) -> Column:
    """Canonical tokens, one for each raw token. ``raw`` should be a column, as it is used twice."""

    def one(x: Column, i: Column) -> Column:
        unit = _is_number(F.get(raw, i - 1)) & F.lower(x).isin(UNITS)
        return F.when(_is_number(x), NUMBER).when(unit, UNIT).when(_is_name(x, F.get(raw, i - 1)), NAME).otherwise(F.lower(x))

    return F.transform(raw, one)


def _is_slot(x: Column) -> Column:
    return x.startswith("<")  # as no token does


def _low(x: Column) -> Column:
    """The low bits of a hash, which hold the number of slots under it."""
    return x.bitwiseAND(F.lit(15).cast("long"))


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(-16).cast("long"))


def _doubled(name: str, step: int) -> Column:
    """Hashes of twice as many tokens, from those of ``step`` tokens; null where the text ends before."""
    return F.zip_with(F.col(name), F.slice(name, step + 1, F.size(name)), lambda x, y: _high(F.xxhash64(x, y)) + _low(x) + _low(y))


def _verbatim(raw: Column, salt: int) -> Column:
    return _high(F.xxhash64(F.lit(salt), F.transform(raw, F.lower)))


def hashed(rows: DataFrame, short: bool, tiny: bool) -> DataFrame:
    """Rows with raw and canon get ``hashes``: of the windows of WINDOW tokens by their first token, then (``short``)
    those of SEED tokens, each as long as the text (null at its end); of a text under SEED tokens (``tiny``) its own."""
    rest = [c for c in rows.columns if c not in ("raw", "canon")]
    one = F.transform("canon", lambda x: _high(F.xxhash64(x)) + F.when(_is_slot(x), 1).otherwise(0))
    out = rows.select(*rest, "raw", one.alias("h1"))
    for step in (1, 2, 4):
        out = out.select("*", _doubled(f"h{step}", step).alias(f"h{2 * step}"))
    sizes = (SEED, WINDOW) if short else (WINDOW,)

    def windows(size: int) -> Column:
        return F.transform(f"h{size}", lambda x, i: F.when(_low(x) * 2 > size, _verbatim(F.slice("raw", i + 1, size), size)).otherwise(x))

    out = out.select(*rest, "raw", *(windows(n).alias(f"w{n}") for n in sizes))
    made = F.concat("w8", "w4") if short else F.col("w8")
    if tiny:
        made = F.when(F.size("raw").between(1, SEED - 1), F.array(_verbatim(F.col("raw"), 1))).otherwise(made)
    return out.select(*rest, F.size("raw").alias("n"), made.alias("hashes"))


def item_windows(items: DataFrame) -> DataFrame:
    """hash, kind (WINDOW, SEED or 1: the whole), item_id, n_tokens, back (tokens of the item before the hashed ones; 0 for WINDOW),
    width, strict (word by word), fold, canon (the width's tokens), offsets (the places in the item where they stand)."""
    one = items.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    one = one.select("item_id", tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    one = one.select("item_id", "raw", F.transform("raw", F.lower).alias("fold"), template(F.col("raw")).alias("icanon"))
    kept = ("item_id", "fold", "icanon")
    lower = one.select(*kept, F.col("fold").alias("raw"))
    forms = [one.withColumn("canon", F.col("icanon")), lower.select("*", template(F.col("raw")).alias("canon")), one.withColumn("canon", F.transform("raw", lambda x: F.lit(NAME)))]
    made = None
    for form in forms:
        hashes = hashed(form.select(*kept, "raw", "canon"), True, True)
        each = hashes.select(*kept, "n", F.posexplode_outer("hashes").alias("at", "hash")).where("hash is not null")
        made = each if made is None else made.union(each)
    kind = F.when(F.col("n") < SEED, 1).when(F.col("at") < F.col("n"), WINDOW).otherwise(SEED)
    made = made.select("*", kind.alias("kind"), (F.col("at") % F.col("n")).alias("pos")).where("(kind <> 4 or n < 8 and pos = 0)")
    width = F.when(F.col("kind") == WINDOW, WINDOW).otherwise(F.col("n"))
    part = lambda c: F.slice(c, F.col("pos") + 1, width)
    made = made.select("hash", "kind", "item_id", F.col("n").alias("n_tokens"), width.alias("width"), "pos", part("fold").alias("fold"), part("icanon").alias("canon"))
    strict = (F.col("kind") != WINDOW) & (F.size(F.filter("canon", lambda x: ~_is_slot(x))) < SEED)
    return made.withColumn("strict", strict).groupBy("hash", "kind", "item_id", "n_tokens", "width", "strict", "fold", "canon").agg(F.array_sort(F.collect_set("pos")).alias("offsets"))


def places(docs: DataFrame, windows: DataFrame, scratch: Scratch) -> DataFrame:
    """id, th, hash, width, from: the first tokens of the document windows that have a hash of the benchmark."""
    known = scratch.table(windows.select("hash", "kind", "width").distinct(), "known")
    rows = {r.kind: r.rows for r in known.groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).collect()}  # three kinds at most
    base = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("raw"))
    base = hashed(base.select("*", template(F.col("raw")).alias("canon")), SEED in rows, 1 in rows)
    # Outer: for others Spark adds a filter on the array's size, and takes all the expressions of the text into it once more.
    each = base.select("id", "th", "n", F.posexplode_outer("hashes").alias("at", "hash"))
    hits = each.join(broadcast_if_small(known, 64, rows=sum(rows.values())), "hash").where(F.col("kind") == F.when(F.col("n") < SEED, 1).when(F.col("at") < F.col("n"), WINDOW).otherwise(SEED))
    pos = F.col("at") % F.col("n")
    # Windows of one hash without slots are equal, and one of them is enough.
    apart = F.when((F.col("kind") != WINDOW) | (_low(F.col("hash")) > 0), pos)
    return scratch.table(hits.groupBy("id", "th", "hash", "width", apart.alias("apart")).agg(F.min(pos).alias("from")).drop("apart"), "places")


def shared_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id, th, hash, width, dfold, dcanon: the tokens of the windows at the places ``found``."""
    at = found.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("hash", "width", "from"))).alias("at"))
    at = at.select(F.col("id").alias("i"), F.col("th").alias("t"), "at")
    need = found.select(F.col("id").alias("i"), F.col("th").alias("t")).distinct()
    text = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    # Distinct by the text too: as a value beside the keys it would need sorted aggregates.
    text = text.join(broadcast_if_small(need, 64), text["id"].eqNullSafe(need["i"]) & (text["th"] == need["t"]), "left_semi").distinct()
    both = text.join(at, text["id"].eqNullSafe(at["i"]) & (text["th"] == at["t"])).select("id", "th", "at", tokens(F.col("text")).alias("raw"))
    both = both.select("id", "th", "at", F.transform("raw", F.lower).alias("fold"), template(F.col("raw")).alias("canon"))
    part = lambda of, p: F.slice(of, p["from"] + 1, p["width"])

    def differs(p: Column, k: Column) -> Column:
        last = F.get("at", k - 1)
        return (k == 0) | (last["hash"] != p["hash"]) | (last["width"] != p["width"]) | (part("fold", last) != part("fold", p))

    both = both.withColumn("at", F.filter("at", differs))
    cut = F.transform("at", lambda p: F.struct(p["hash"].alias("hash"), p["width"].alias("width"), part("fold", p).alias("dfold"), part("canon", p).alias("dcanon")))
    return both.select("id", "th", F.explode_outer(cut).alias("w")).select("id", "th", "w.*").where(F.size("dfold") == F.col("width")).distinct()


def meetings(shared: DataFrame, windows: DataFrame) -> DataFrame:
    """id, th, item_id, n_tokens, p (place in the item), kind (of its slot, else null), item, doc (the two tokens):
    what meets in windows that agree, each meeting once."""
    sized = windows.select(F.sum(F.length(F.concat_ws(" ", "fold", "canon")) + 64 * F.col("width") + 8 * F.size("offsets") + 64)).first()[0] or 0
    side = F.broadcast(windows) if sized <= BROADCAST_BYTES else windows.hint("merge")
    both = shared.join(side, ["hash", "width"]).where(~F.col("strict") | (F.col("fold") == F.col("dfold")))
    cells = F.transform(
        F.arrays_zip("fold", "canon", "dfold", "dcanon"),
        lambda c: F.struct(F.when(_is_slot(c["canon"]), c["canon"]).alias("kind"), c["fold"].alias("item"), c["dfold"].alias("doc"), ((c["fold"] == c["dfold"]) | (_is_slot(c["canon"]) & (c["canon"] == c["dcanon"]))).alias("agrees")),
    )
    both = both.select("id", "th", "item_id", "n_tokens", "offsets", F.explode(F.array(cells)).alias("cells")).where(F.forall("cells", lambda c: c["agrees"]))
    both = both.select("id", "th", "item_id", "n_tokens", F.explode("offsets").alias("offset"), "cells").select("id", "th", "item_id", "n_tokens", "offset", F.posexplode("cells").alias("k", "c"))
    return both.select("id", "th", "item_id", "n_tokens", (F.col("offset") + F.col("k")).alias("p"), "c.kind", "c.item", "c.doc").distinct()


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """id, th, item_id, n_tokens (of the item), covered, coverage, exact (all slots have the item's own values)."""
    scratch = Scratch(docs.sparkSession)
    windows = scratch.table(item_windows(items), "windows")
    met = meetings(shared_windows(docs, places(docs, windows, scratch)), windows)
    group = ("id", "th", "item_id")
    met = met.repartition(*group).withColumn("equal", F.col("item") == F.col("doc"))
    best = (F.col("equal").desc(), F.col("votes").desc())
    met = met.withColumn("votes", F.count(F.lit(1)).over(Window.partitionBy(*group, "kind", "item", "doc")))
    met = met.withColumn("to", F.first("doc").over(Window.partitionBy(*group, "kind", "item").orderBy(*best, "doc")))
    kept = F.col("to") == F.col("doc")
    met = met.withColumn("of", F.first("item").over(Window.partitionBy(*group, "kind", "doc", kept).orderBy(*best, "item")))
    fits = F.col("kind").isNull() | (kept & (F.col("of") == F.col("item")))
    placed = met.groupBy(*group, "n_tokens", "p").agg(F.bool_or(fits).alias("fits"), F.bool_or("equal").alias("equal"), F.bool_or(F.col("kind").isNotNull()).alias("slot"))
    out = placed.groupBy(*group, "n_tokens").agg(F.count_if("fits").alias("covered"), F.every("equal").alias("exact"), F.count_if("slot").alias("slots"), F.count_if(F.col("slot") & F.col("fits")).alias("good"))
    return out.where("2 * good >= slots").drop("slots", "good").withColumn("coverage", F.col("covered") / F.col("n_tokens"))


def contaminated(docs: DataFrame, items: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, n_tokens, covered, exact."""
    found = matches(docs, items).where(F.col("coverage") >= min_cover)
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("covered").cast("long").alias("covered"), "exact")


def clean_documents(docs: DataFrame, items: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    gone = Scratch(docs.sparkSession).table(matches(docs, items).where(F.col("coverage") >= min_cover).select(F.col("id").alias("i"), F.col("th").alias("t")).distinct(), "leaks")
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    return whole.join(broadcast_if_small(gone, 64), whole["id"].eqNullSafe(gone["i"]) & (whole["th"] == gone["t"]), "left_anti").select("doc.*")
