"""MinHash near-duplicate detection with fast similarity sketches, banding and exact verification.

Sketch: Dahlgaard, Knudsen, Thorup (2017), "Fast similarity sketching". In round i every shingle is thrown into a
bin by hash i and a bin keeps the smallest value of the first round that reached it; after ``t`` rounds of random bins,
``t`` rounds aim at one bin each, so every coordinate is filled. Coordinates agree with the probability of the
Jaccard similarity, with Chernoff-type concentration.

Banding: ``rows`` coordinates make a band key. Documents of equal shingle sets are one class first, whose smallest
doc_id stands for it. A link at similarity 0.8 shares a band but with probability (1 - 0.8**8)**64 < 8e-6.

Verification never emits all pairs of a bucket. All members of a bucket are compared, on full sets, with its first
member, the leader. Where some are not linked with it, all members of the leader's buckets are compared with the
group's centre: the shingles that most of some ``SAMPLE`` members have. It need not be the set of a document, and any
set gives right results; one from the middle leaves small differences that few members share. By the triangle
inequality all members near enough to it are linked with the nearest one, without being compared; every other pair goes
through an exact prefix filter on the differences from the centre (``open_candidates``), and what passes is compared on full
sets. So of the pairs that share a band none is lost: each is compared, ruled out by sizes, or in one component.

Defined results: a document is a row; rows of a null doc_id cannot be named, they are never linked, have a null
component and are kept; rows of equal doc_id and text are kept or dropped together; documents without words
are linked with nothing; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small
from .shingles import mix, shingle_sets
from .tokens import blocks, forget

ROWS, BANDS = 8, 64
#: Members, about, that a group's centre is taken from.
SAMPLE = 16
#: Bytes of text whose shingles and sketches are in memory at once.
BLOCK = 1 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(sets: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """(documents, t) coordinates. ``sets``: the documents' distinct shingle hashes, one after the other."""
    out = np.full(len(sizes) * t, FULL, np.uint64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left, of = sets, doc
    for i in range(t):
        if not len(left):
            break
        h = mix(left, i)
        cell = of * t + ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64)
        empty = out[cell] == FULL
        np.minimum.at(out, cell[empty], h[empty])
        todo = (out.reshape(-1, t) == FULL).any(axis=1)[of]
        left, of = left[todo], of[todo]
    for b in range(t) if len(left) else ():
        cell = of * t + b
        empty = out[cell] == FULL
        if empty.any():
            np.minimum.at(out, cell[empty], mix(left[empty], t + b))
    return out.reshape(-1, t)


def band_keys(coordinates: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(documents, bands) 64-bit keys."""
    part = coordinates.reshape(len(coordinates), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64), 5), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key ^ part[:, :, r], 11 + r)
    return key.astype(np.int64)


def signatures(docs: DataFrame, k: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, th (text hash), n (distinct shingles), digest (of the whole set; null if empty), keys."""

    def run(batches):
        import pyarrow as pa

        forget()
        for b in batches:
            text = b.column(2)
            for i, j in blocks([*map(_size, text)], BLOCK):
                sets, n = shingle_sets(text.slice(i, j - i), k)
                some = n > 0
                keys = band_keys(sketch(sets, n[some], rows * bands), rows, bands)
                at = np.cumsum([0, *n])
                digests = [hashlib.blake2b(sets[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(at, at[1:], strict=False)]
                ends = np.cumsum([0, *np.where(some, bands, 0)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), pa.array(digests, pa.binary()), lists], ["doc_id", "th", "n", "digest", "keys"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, th long, n long, digest binary, keys array<long>")


def _size(scalar) -> range | None:
    """Stands for a text in ``blocks``, by its length alone."""
    return range(len(scalar.as_buffer())) if scalar.is_valid else None


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, elements: the sorted 64-bit shingle hashes (binary)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(1)
            for i, j in blocks([*map(_size, text)], BLOCK):
                sets, n = shingle_sets(text.slice(i, j - i), k)
                at = np.cumsum([0, *n])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([sets[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], ["id", "elements"])

    return docs.mapInArrow(run, "id long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (size of the intersection), either (of the union)."""

    def run(batches):
        import pyarrow as pa

        held, known = None, None
        for b in batches:
            both, either = [], []
            for x, y, key in zip(b.column(2), b.column(3), b.column(1).to_pylist(), strict=True):
                if key != held:
                    held, known = key, np.frombuffer(y.as_buffer(), np.uint64)
                own = np.frombuffer(x.as_buffer(), np.uint64)
                n = len(np.intersect1d(own, known, assume_unique=True))
                both.append(n)
                either.append(len(own) + len(known) - n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("xa"))
    two = sets.select(F.col("id").alias("b"), F.col("elements").alias("xb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long, both long, either long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, comp (smallest id reachable) for the ids of ``edges`` (a, b), by alternating large-star and small-star
    steps (Kiveris et al. 2014, "Connected components in MapReduce and beyond"); only minima are gathered by key."""

    def step(e: DataFrame, large: bool) -> DataFrame:
        around = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = around.join(low, "a")
        if large:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now, mark = scratch.table(edges.where("a <> b").select("a", "b").distinct(), "edges"), None
    while True:
        new = scratch.table(step(step(now, True), False), "edges")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def centres(members: DataFrame, sets: DataFrame) -> DataFrame:
    """g, centre: the shingles that more than half of some members of each group (g, a, many) have, chosen by a hash."""
    some = members.where(F.pmod(F.xxhash64("a", "g"), F.ceil(F.col("many") / SAMPLE)) == 0).select("g", "a")
    # A group of which the hash chose none has the set of its first member.
    some = some.union(members.groupBy("g").agg(F.min("a").alias("a"))).distinct()

    @F.pandas_udf("binary")
    def middle(lists):
        def one(held):
            x, often = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for h in held]), return_counts=True)
            return x[2 * often > len(held)].tobytes()

        return lists.map(one)

    held = some.join(sets.select(F.col("id").alias("a"), "elements"), "a").groupBy("g").agg(F.collect_list("elements").alias("held"))
    return held.select("g", middle("held").alias("centre"))


def differences(members: DataFrame, middle: DataFrame, sets: DataFrame) -> DataFrame:
    """g, a, n (size of a's set), diff (elements of only one of a's set and the centre's) of members (g, a)."""

    def cut(batches):
        for b in batches:
            sizes = [range(len(x.as_buffer()) + len(y.as_buffer())) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield from (b.slice(i, j - i) for i, j in blocks(sizes, 16 * BLOCK))

    def run(batches):
        import pyarrow as pa

        held, known = None, None
        for b in cut(batches):
            n, diffs = [], []
            for x, y, key in zip(b.column(2), b.column(3), b.column(0).to_pylist(), strict=True):
                if key != held:
                    held, known = key, np.frombuffer(y.as_buffer(), np.uint64)
                own = np.frombuffer(x.as_buffer(), np.uint64)
                n.append(len(own))
                diffs.append(np.setxor1d(own, known, assume_unique=True).view(np.int64))
            ends = np.cumsum([0, *map(len, diffs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *diffs])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), lists], ["g", "a", "n", "diff"])

    one = sets.select(F.col("id").alias("a"), F.col("elements").alias("xa"))
    joined = members.join(one, "a").join(middle, "g").select("g", "a", "xa", "centre")
    return joined.mapInArrow(run, "g long, a long, n long, diff array<long>")


def _linked(percent: int):
    return F.col("both") * 100 >= F.col("either") * percent


def _excess(percent: int):
    """By how much a member's difference from the centre exceeds its share of what a link allows, in whole numbers."""
    return F.size("diff") * (100 + percent) - F.col("n") * (100 - percent)


def open_candidates(members: DataFrame, percent: int) -> DataFrame:
    """a, b (a > b): pairs that may be linked, of members (g, a, e, diff, out) of groups, at least one of them ``out``.

    A prefix filter on the differences from the group's centre. For the sizes d of two differences, n of the sets and o
    of the differences' overlap, a link means d1 + d2 - 2 o <= rate (n1 + n2). With the excess E = d - rate n (``_excess``)
    that is 2 o >= E1 + E2, which is above 0 where one is ``out``. So a linked pair shares an element among
    the first ones of both in any common order; rare elements come first, and those are few."""
    up = 100 + percent
    sized = members.select("g", "a", "out", "e", F.size("diff").alias("d"), "diff")
    low = sized.groupBy("g").agg(F.min("e").alias("low"), F.min(F.when(F.col("out"), F.col("e"))).alias("low_out")).where("low_out is not null")
    each = sized.join(low, "g").select("g", "a", "out", "e", "d", "low", "low_out", F.explode("diff").alias("x"))
    often = each.groupBy("g", "x").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("g", "a").orderBy("f", "x")
    left = F.col("d") - F.row_number().over(order) + 1  # elements from here to the end
    placed = each.join(often, ["g", "x"]).withColumn("left", left)
    least = F.col("e") + F.when(F.col("out"), F.col("low")).otherwise(F.col("low_out"))
    placed = placed.where((F.col("f") > 1) & (F.col("left") * (2 * up) >= least)).select("g", "x", "a", "out", "e", "left")
    one, two = placed.where("out").alias("u"), placed.alias("m")
    fits = F.least("u.left", "m.left") * (2 * up) >= F.col("u.e") + F.col("m.e")
    once = F.when(F.col("m.out"), F.col("u.a") > F.col("m.a")).otherwise(F.lit(True))
    met = one.join(two, (F.col("u.g") == F.col("m.g")) & (F.col("u.x") == F.col("m.x")) & once & fits)
    return met.select(F.greatest("u.a", "m.a").alias("a"), F.least("u.a", "m.a").alias("b")).distinct()


def linked_classes(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, names: DataFrame) -> DataFrame:
    """id, comp of every linked id. ``members``: key, id, the ids of each band key; ``sets_of`` makes the full sets
    (id, elements) of the ids it is given; ``names``: c, id, the names of ids that are not their own."""
    leaders = members.groupBy("key").agg(F.min("id").alias("l"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "l")
    pairs = scratch.table(members.join(leaders, "key").where("id <> l").select(F.col("id").alias("a"), F.col("l").alias("b")).distinct(), "pairs")
    sets = scratch.table(sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "sets")
    first = scratch.table(verified(pairs, sets), "verified").withColumn("yes", _linked(percent))
    # Groups that are not settled by their leader. The leader is a member like others.
    groups = first.groupBy("b").agg(F.count(F.lit(1)).alias("many"), F.count_if(~F.col("yes")).alias("far")).where("far > 0 and many > 1").select("b", "many")
    left = first.join(groups, "b").select(F.col("b").alias("g"), "a", "yes", F.col("many") + 1).union(groups.select("b", "b", F.lit(True), F.col("many") + 1)).toDF("g", "a", "by_leader", "many")
    left = scratch.table(left, "open")
    middle = scratch.table(centres(left, sets), "centres")
    second = differences(left.select("g", "a"), middle, sets).join(left.select("g", "a", "by_leader"), ["g", "a"]).withColumn("e", _excess(percent))
    second = scratch.table(second, "differences")
    # |A - B| is at most the sum of both differences from the centre: two whose excesses add up to 0 or less are linked.
    nearest = second.groupBy("g").agg(F.min(F.struct("e", "a")).alias("c"))
    second = second.join(nearest, "g").withColumn("core", F.col("e") + F.col("c.e") <= 0)
    # Where one of those is linked with the leader, they and all that are linked with the leader are one component.
    both = second.groupBy("g").agg(F.bool_or(F.col("core") & F.col("by_leader")).alias("one"))
    second = scratch.table(second.join(both, "g").select("g", "a", "e", "diff", "core", F.col("c.a").alias("p"), (~(F.col("core") | (F.col("by_leader") & F.col("one")))).alias("out")), "placed")
    inside = second.select("g", "a", "e", "diff", "out")
    third = scratch.table(verified(open_candidates(inside, percent), sets), "verified").withColumn("yes", _linked(percent))
    links = first.where("yes").select("a", "b").union(second.where("core").select("a", F.col("p").alias("b"))).union(third.where("yes").select("a", "b"))
    if not names.isEmpty():
        for end in ("a", "b"):
            links = links.join(names.select(F.col("c").alias(end), "id"), end, "left").withColumn(end, F.coalesce("id", end)).select("a", "b")
    return components(links, scratch)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    sig = scratch.table(signatures(docs, k), "sketches")
    named = sig.where("doc_id is not null and digest is not null")
    classes = scratch.table(named.groupBy("digest", "n").agg(F.min("doc_id").alias("id"), F.min_by("th", "doc_id").alias("th")), "classes")
    # Classes are compared by a number of their own: the doc_id, or a hash where another class has that doc_id.
    first = classes.groupBy("id").agg(F.min("digest").alias("least"))
    own = F.when(F.col("digest") == F.col("least"), F.col("id")).otherwise(F.xxhash64("digest", "id"))
    classes = scratch.table(classes.join(first, "id").select("digest", "id", "th", own.alias("c")), "numbered")
    single = named.join(classes.select("digest", "id", "c"), "digest").where("doc_id = id").dropDuplicates(["digest"])
    members = single.select(F.explode("keys").alias("key"), F.col("c").alias("id"))

    def sets_of(ids: DataFrame) -> DataFrame:
        need = classes.join(ids.select(F.col("id").alias("c")), "c", "left_semi").select("id", "th", "c")
        text = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
        return full_sets(text.join(broadcast_if_small(need, 64), ["id", "th"]).select(F.col("c").alias("id"), "text").dropDuplicates(["id"]), k)

    # Rows of one doc_id with different texts are different documents of one name: links meet in the name.
    comp = linked_classes(members, sets_of, percent, scratch, classes.where("c <> id").select("c", "id"))
    names = classes.join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    # Rows without words have no class; joined, they would all be one task.
    some = sig.where("digest is not null").join(names, "digest", "left").select("doc_id", "th", "n", "comp")
    out = some.unionByName(sig.where("digest is null").select("doc_id", "th", "n", F.lit(None).cast("long").alias("comp")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are near-duplicates of a document of smaller id."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "th").distinct()
    gone = Scratch(docs.sparkSession).table(gone, "dropped")
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    return whole.join(broadcast_if_small(gone, 64), ["id", "th"], "left_anti").select("doc.*")
