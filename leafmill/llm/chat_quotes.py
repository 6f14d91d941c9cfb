"""Quotation linking in conversations, in DataFrame functions only.

A message's lines carry nested quote marks (``>``). Neighbouring lines of one level are a passage. A quoted passage's
words (white space apart, lower case) are hashed as one, and joined, within the conversation, to the first earlier
message whose own words hold the same run, whatever its line breaks: anywhere in it, or, of quotes of less than four words
(a mere "yes" is in many messages), from the start of a line or sentence on. The message of the shallowest, first
linked passage is what a message replies to; one without a linked quote replies to the turn before it.

Conversations are in reply order: a thread is a message that replies to none and all that follows from it; in it every
message is followed by its first reply and what that leads to, then by its other replies, each with what it leads to.
``position`` counts from 0 in a conversation; quotes are left out of the texts.

Scale: the places of a conversation's words where four words stand that begin a quote are found by a join, and only there
are runs hashed, of those quotes' lengths. The first message of each run is kept, so the last join gives one row a
quote; nothing gathers a conversation, and a row holds no more than the words of its message. Replies are followed by pointer
doubling, in as many rounds as the logarithm of the longest chain; positions are counted in ranges of the order.

Defined results: a null text is the empty text; messages of a null conv_id or turn are linked to nothing, are a thread
of their own and have no position; repeated (conv_id, turn) rows are all returned, with what their name links to, each
with its own position; a message that only quotes has an empty text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WORD, Scratch

# Possessive, as Java's matcher recurses on other repeats of groups and runs out of stack.
QUOTED = r"^[ \t]*+>"
MARKS = r"(?s)^((?:[ \t]*+>)*+)[ \t]?(.*)\z"
#: What comes before the start of a line or sentence.
BREAK = r"(\n[\x20\x09-\x0D]*+|[.!?…][\"'”’)\]]*+[\x20\x09-\x0D]++)"
START = "\x01"
#: Quotes of so many words or more may begin inside a sentence.
INSIDE = 4


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(text, START, "")), F.lit(WORD), F.lit(0))


def with_run_hashes(rows: DataFrame, longest: int, own: str | None = None) -> DataFrame:
    """Adds ``hs``: the hashes of the runs of 1, 2, 4 ... words of ``w`` by their first word, as far as ``longest`` needs
    them, and in each row no further than its column ``own`` does (null from there on). So a run of any length is hashed in one
    step, by the two of them that cover it."""
    out = rows.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h0"))
    levels = max(longest, 1).bit_length()
    for j in range(levels - 1):
        h, step = f"h{j}", 1 << j
        longer = F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
        out = out.select("*", (F.when(F.col(own) >= 2 * step, longer) if own else longer).alias(f"h{j + 1}"))
    return out.select(*rows.columns, F.array(*(f"h{j}" for j in range(levels))).alias("hs"))


def _run(at: Column, n: Column) -> Column:
    """The hash of the run of ``n`` words from ``at`` on."""
    level = F.length(F.bin(n)) - 1
    block = F.get(F.col("hs"), level)
    return F.xxhash64(F.get(block, at), F.get(block, at + n - F.pow(F.lit(2), level).cast("int")))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts: array of (level, text) in order. Level 0 is the author's own."""
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\r"), F.lit(""))
    head = messages.select(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.split(text, "\n", -1).alias("raw"))
    marks = F.transform("raw", lambda x: F.when(x.rlike(QUOTED), F.regexp_count(F.regexp_extract(x, MARKS, 1), F.lit(">"))).otherwise(0))
    words = F.transform("raw", lambda x: F.when(x.rlike(QUOTED), F.regexp_extract(x, MARKS, 2)).otherwise(x))
    lines = head.select("conv_id", "turn", "role", marks.alias("level"), words.alias("line"))
    first = F.filter(F.sequence(F.lit(0), F.size("level") - 1), lambda i: (i == 0) | (F.get("level", i) != F.get("level", i - 1)))
    lines = lines.select("*", first.alias("at"))

    def part(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("at", k + 1), F.size("level"))
        return F.struct(F.get("level", i).alias("level"), F.array_join(F.slice("line", i + 1, end - i), "\n").alias("text"))

    return lines.select("conv_id", "turn", "role", F.transform("at", part).alias("parts"))


def named(parsed: DataFrame) -> DataFrame:
    return parsed.where("conv_id is not null and turn is not null")


def quotes(parsed: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """conv_id, turn, pos, level, n (words), h, a (hash of the first words, where it may begin anywhere): every quoted passage
    with words in it; and the longest's number of words."""
    each = named(parsed).select("conv_id", "turn", F.posexplode_outer(F.filter("parts", lambda p: p["level"] > 0)).alias("pos", "p")).where("pos is not null")
    each = each.select("conv_id", "turn", "pos", "p.level", _words(F.col("p.text")).alias("w"))
    each = scratch.table(each.select("*", F.size("w").alias("n")).where("n > 0"), "quoted")
    longest = each.agg(F.max("n")).first()[0] or 0
    return scratch.table(with_run_hashes(each, longest, "n").select("conv_id", "turn", "pos", "level", "n", _run(F.lit(0), F.col("n")).alias("h"), F.when(F.col("n") >= INSIDE, _run(F.lit(0), F.lit(INSIDE))).alias("a")), "quotes"), longest


def own_text(parts: Column) -> Column:
    own = F.transform(F.filter(parts, lambda p: p["level"] == 0), lambda p: p["text"])
    return F.regexp_replace(F.btrim(F.array_join(own, "\n"), F.lit(" \t\n")), r"\n{3,}", "\n\n")


def _small(side: DataFrame, width: int) -> DataFrame:
    """With the hint to broadcast, if its counted rows of ``width`` bytes allow it."""
    return F.broadcast(side) if width * side.count() <= BROADCAST_BYTES else side.hint("merge")


def originals(parsed: DataFrame, quoted: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """conv_id, n, h, said (the first turn): runs of ``n`` own words, for the numbers of words that quotes of the conversation
    have; short ones from a line's or sentence's start, longer ones from where a quote's first words stand."""
    spoken = F.translate(own_text(F.col("parts")), START, "")
    said = named(parsed).join(_small(quoted.select("conv_id").distinct(), 32), "conv_id", "left_semi")
    said = said.select("conv_id", "turn", F.regexp_extract_all(F.regexp_replace(F.lower(spoken), BREAK, "$1" + START), F.lit(WORD), F.lit(0)).alias("marked"))
    at = F.filter(F.transform("marked", lambda x, i: F.when((i == 0) | x.startswith(START), i)), lambda i: i.isNotNull())
    said = said.select("conv_id", "turn", at.alias("at"), F.transform("marked", lambda x: F.ltrim(x, F.lit(START))).alias("w"))
    said = scratch.table(said.where(F.size("w") > 0), "said")
    first = lambda runs: runs.groupBy("conv_id", "n", "h").agg(F.min("turn").alias("said"))
    run_at = lambda n: lambda i: _run(i, n)
    fits = lambda n: lambda i: i + n <= F.size("w")

    lengths = scratch.table(quoted.where(F.col("n") < INSIDE).select("conv_id", "n").distinct(), "lengths")
    short = with_run_hashes(said, INSIDE - 1).join(_small(lengths, 32), "conv_id")
    short = short.select("conv_id", "turn", "n", F.explode_outer(F.transform(F.filter("at", fits(F.col("n"))), run_at(F.col("n")))).alias("h")).where("h is not null")

    begun = scratch.table(quoted.where(F.col("a").isNotNull()).select("conv_id", "a", "n").distinct(), "begun")
    places = F.transform(F.sequence(F.lit(0), F.size("w") - INSIDE), run_at(F.lit(INSIDE)))
    places = with_run_hashes(said.where(F.size("w") >= INSIDE), INSIDE).select("conv_id", "turn", F.size("w").alias("of"), F.posexplode_outer(places).alias("i", "a"))
    found = places.join(_small(begun, 48), ["conv_id", "a"]).where(F.col("i") + F.col("n") <= F.col("of"))
    found = scratch.table(found.groupBy("conv_id", "turn", "n").agg(F.collect_set("i").alias("is")), "begins")
    long = with_run_hashes(said.join(found, ["conv_id", "turn"]), longest, "n")
    long = long.select("conv_id", "turn", "n", F.explode_outer(F.transform(F.filter("is", fits(F.col("n"))), run_at(F.col("n")))).alias("h")).where("h is not null")
    return first(short).unionByName(first(long))


def threads(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, thread, depth, branch of messages that reply to another (conv_id, turn, reply_to): pointers are doubled until
    all end at a message that replies to none. ``branch``: the replies on the way there that are not the first to their
    message, as (-reply_to, turn); in its order, then by depth, messages are in reply order."""
    first = replies.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("first"))
    start = replies.join(first, ["conv_id", "reply_to"])
    step = F.struct((-F.col("reply_to")).alias("to"), F.col("turn").alias("turn"))
    here = F.when(F.col("turn") == F.col("first"), F.array().cast("array<struct<to:bigint,turn:bigint>>")).otherwise(F.array(step))
    now = scratch.table(start.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"), here.alias("branch")), "threads")
    done = None
    while not now.isEmpty():
        far = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"), F.col("branch").alias("before"))
        new = now.join(far if done is None else far.unionByName(done.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"), F.col("depth").alias("more"), F.col("branch").alias("before"))), ["conv_id", "thread"], "left")
        deep = F.coalesce(F.concat("before", "branch"), F.col("branch"))
        new = scratch.table(new.select("conv_id", "turn", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), deep.alias("branch"), F.col("further").isNotNull().alias("moved")), "threads")
        end = new.where("not moved").drop("moved")  # these point at a message that replies to none
        done, now = end if done is None else done.unionByName(end), new.where("moved").drop("moved")
    return done if done is not None else now


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``position``, counted in each conversation in ranges of the whole order."""
    order = ("conv_id", "thread", "branch", "depth", "turn")
    ranged = scratch.table(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ordered")
    local = ranged.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:], "role", "own_text")))
    sizes = ranged.where("conv_id is not null").groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    out = local.join(sizes, ["conv_id", "range"], "left")
    return out.withColumn("position", F.when(F.col("turn").isNotNull(), F.col("ahead") + F.col("k") - 1)).drop("range", "k", "ahead")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread (its first turn), depth (replies from there), position, n_quotes, n_linked, own_text."""
    scratch = Scratch(messages.sparkSession)
    parsed = scratch.table(passages(messages), "passages")
    quoted, longest = quotes(parsed, scratch)
    joined = quoted.join(originals(parsed, quoted, longest, scratch), ["conv_id", "n", "h"], "left").withColumn("said", F.when(F.col("said") < F.col("turn"), F.col("said")))
    best = F.min(F.when(F.col("said").isNotNull(), F.struct("level", "pos", "said")))
    place = F.struct("pos", "n", "h")
    mine = joined.groupBy("conv_id", "turn").agg(F.countDistinct(place).alias("n_quotes"), F.countDistinct(F.when(F.col("said").isNotNull(), place)).alias("n_linked"), best["said"].alias("to"))
    turns = named(parsed).select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    told = scratch.table(turns.join(mine, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left").withColumn("reply_to", F.coalesce("to", "previous")).drop("to", "previous"), "replies")
    roots = threads(told.where("reply_to is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("reply_to").cast("long").alias("reply_to")), scratch)
    out = parsed.join(told, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("branch", F.array()).alias("branch"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        own_text(F.col("parts")).alias("own_text"),
    )
    return _placed(out, scratch).select("conv_id", "turn", "role", "reply_to", "thread", "depth", "position", "n_quotes", "n_linked", "own_text")


def conversations(linked: DataFrame) -> DataFrame:
    """The messages in reply order: a conversation is a run of rows, spread over as many partitions as it needs."""
    return linked.repartitionByRange("conv_id", "position").sortWithinPartitions("conv_id", "position")
