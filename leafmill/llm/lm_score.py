"""Cross-entropy difference scoring with matched n-gram models.

Two bigram models of the same order, smoothing and vocabulary: the target, counted on documents of labelled quality 1,
and the background, counted on all documents. A document's score is the mean over its words of the loss under
the target less the loss under the background (Moore and Lewis 2010); lower is more like the target. A document's own
words, bigrams and end are taken out of the counts that it is scored by, so that a document of the target is scored
like any other: by the rest of it, not by having been counted.

Words and bigrams are counted exactly, by 64-bit hashes; nothing is pruned and no table has a fixed size. Texts are
cut into blocks of about ``BLOCK`` words, coded once. Each block sends its distinct words and bigrams with their own
counts to buckets by hash (as many as the corpus needs, ``BUCKET`` words each), where they are added up, and a bucket
sends each block the totals of what the block asked for. So a common word or bigram is one entry a block, a task
holds one block or one bucket, and what is gathered grows with the corpus.

p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU);  p(w) = (c(w) + 1) / (N + D + V + 1); a document's first word has p(w). V
is the number of distinct words of all documents, ``WORDS`` at least (a small corpus leaves room for unseen words), D the
number of documents with words: their ends are an event as words are, so all sums to 1; a score counts the words' loss.
For a document, c, N and D are those of all other rows (other rows of its text stay in); V is the corpus's, whatever row is scored.

Defined results: a document without words has null losses; null or repeated doc_ids are passed through; without
labels the target is empty and its model uniform; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small
from .shingles import mix, word_hashes
from .tokens import blocks

WORDS, MU = 1 << 18, 200.0
#: Words of a block of documents, and words of the corpus for each bucket of counts.
BLOCK, BUCKET = 1 << 20, 1 << 20


def _ranges(text):
    return blocks([range(len(x.as_buffer())) if x.is_valid else None for x in text])


def _packed(values: np.ndarray) -> bytes:
    """Compressed, first bytes of all values first."""
    import pyarrow as pa

    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(scalar, kind=np.int64) -> np.ndarray:
    import pyarrow as pa

    held = scalar.as_buffer()
    size = int.from_bytes(held[:8])
    planes = np.frombuffer(pa.decompress(held[8:], size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def coded(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row a block of documents: block, ids, n (words of each), chosen (whether in the target), names (the distinct
    words' hashes), codes (the words, as places in names), and the numbers of words and of documents with words, of all and
    of the target. ``target``: the
    distinct doc_ids of the target."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made, held = TaskContext.get().partitionId() << 32, []

        def row():
            words, n, chosen = (np.concatenate([x[k] for x in held]) for k in range(3))
            ids = pa.concat_arrays([x[3] for x in held])
            names, codes, often = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-often)  # frequent words have small codes, which pack well
            rank = np.empty(len(names), np.int32)
            rank[order] = np.arange(len(names), dtype=np.int32)
            cells = [_packed(x) for x in (n, chosen, names[order], rank[codes])]
            at = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            out = [pa.array([made]), at, *(pa.array([x], pa.binary()) for x in cells), *(pa.array([int(x)]) for x in (len(words), n[chosen].sum(), (n > 0).sum(), (n[chosen] > 0).sum()))]
            return pa.RecordBatch.from_arrays(out, ["block", "ids", "n", "chosen", "names", "codes", "words", "target_words", "docs", "target_docs"])

        for b in batches:
            for i, j in _ranges(b.column(1)):
                held.append((*word_hashes(b.column(1).slice(i, j - i)), b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False), b.column(0).slice(i, j - i)))
                if sum(len(x[0]) + len(x[1]) for x in held) >= BLOCK:
                    yield row()
                    made, held = made + 1, []
        if held:
            yield row()

    mark = target.select(F.col("doc_id").alias("m"), F.lit(True).alias("chosen"))
    src = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    src = src.join(broadcast_if_small(mark, 40), src["id"] == mark["m"], "left").select(F.col("id").cast("long").alias("id"), "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    return src.mapInArrow(run, "block long, ids array<long>, n binary, chosen binary, names binary, codes binary, words long, target_words long, docs long, target_docs long")


def _entries(names: np.ndarray, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a word is its text's first; the hashes of the distinct bigrams; the bigrams of the other words, as places in them."""
    head = np.zeros(len(codes), bool)
    head[(np.cumsum(n) - n)[n > 0]] = True
    wide = codes.astype(np.int64)
    tail = np.flatnonzero(~head)
    pairs, at = np.unique(wide[tail - 1] * len(names) + wide[tail], return_inverse=True)
    first, second = np.divmod(pairs, max(len(names), 1))
    return head, mix(mix(names[first], 3) ^ names[second], 4), at


def _own(row: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """For each place, how often its row has its key."""
    _, back, often = np.unique(row * max(size, 1) + keys, return_inverse=True, return_counts=True)
    return often[back]


def _dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The buckets (ranges of hashes) that have keys, and the places of their keys in order of the hashes."""
    order = np.argsort(keys, kind="stable")
    of = ((keys[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    ends = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    return [(k, order[ends[k] : ends[k + 1]]) for k in range(buckets) if ends[k] < ends[k + 1]]


def counts(rows: DataFrame, buckets: int) -> DataFrame:
    """kind (0: words, 1: bigrams), bucket, block, target, background (the totals of the block's keys in the bucket), keys (the bucket's distinct keys)."""

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            for block, *cells in zip(*(b.column(i) for i in range(5)), strict=True):
                n, chosen, names, codes = (_unpacked(x, k) for x, k in zip(cells, (np.int64, bool, np.uint64, np.int32), strict=True))
                head, pairs, at = _entries(names, codes, n)
                mine = np.repeat(chosen, n)
                for kind, keys, used, on in ((0, names, codes, mine), (1, pairs, at, mine[~head])):
                    background, wanted = np.bincount(used, minlength=len(keys)), np.bincount(used[on], minlength=len(keys))
                    out = [(k, _packed(np.diff(keys[i], prepend=np.uint64(0))), *(_packed(x[i].astype(np.int32)) for x in (wanted, background))) for k, i in _dealt(keys, buckets)]
                    if out:
                        of, *data = zip(*out, strict=True)
                        ints = [pa.array([kind] * len(of), pa.int32()), pa.array(of, pa.int32()), pa.array([block.as_py()] * len(of))]
                        yield pa.RecordBatch.from_arrays([*ints, *(pa.array(x, pa.binary()) for x in data)], ["kind", "bucket", "block", "hashes", "target", "background"])

    def add(table):
        import pyarrow as pa

        parts = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in table["hashes"]]
        ends = np.cumsum([0, *map(len, parts)])
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        out = {c: table[c] for c in ("kind", "bucket", "block")}
        for c in ("target", "background"):
            total = np.bincount(at, np.concatenate([_unpacked(x, np.int32) for x in table[c]]), len(keys)).astype(np.int64)
            out[c] = pa.array([_packed(total[at[i:j]]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
        return pa.table(out | {"keys": pa.array([len(keys)] * len(parts), pa.int64())})

    asked = rows.select("block", "n", "chosen", "names", "codes").mapInArrow(ask, "kind int, bucket int, block long, hashes binary, target binary, background binary")
    return asked.groupBy("kind", "bucket").applyInArrow(add, "kind int, bucket int, block long, target binary, background binary, keys long")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats a word), loss_difference."""
    scratch = Scratch(docs.sparkSession)
    target = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    rows = scratch.table(coded(docs, target), "blocks")
    sums = [x or 0 for x in rows.agg(*(F.sum(c) for c in ("target_words", "words", "target_docs", "docs"))).first()]
    numbers = [sums[0] + sums[2] + 1, sums[1] + sums[3] + 1]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sums[1] // BUCKET))
    counted = scratch.table(counts(rows, buckets), "counts")
    vocabulary = max(WORDS, counted.where("kind = 0").groupBy("bucket").agg(F.first("keys").alias("keys")).agg(F.sum("keys")).first()[0] or 0)

    def finish(left, right):
        import pyarrow as pa

        n, chosen, names, codes = (_unpacked(left[c][0], k) for c, k in (("n", np.int64), ("chosen", bool), ("names", np.uint64), ("codes", np.int32)))
        head, pairs, at = _entries(names, codes, n)
        tail, row = np.flatnonzero(~head), np.repeat(np.arange(len(n)), n)
        own_words, own_pairs = _own(row, codes, len(names)), _own(row[tail], at, len(pairs))
        got = {(k, b): i for i, (k, b) in enumerate(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), strict=True))}
        ends = np.cumsum([0, *n])
        out, mean = [left["ids"][0].values, pa.array(n)], []
        for c, total, inside in (("target", numbers[0], chosen), ("background", numbers[1], np.ones(len(n), bool))):
            one, two = np.zeros(len(names)), np.zeros(len(pairs))
            for kind, keys, held in ((0, names, one), (1, pairs, two)):
                for bucket, places in _dealt(keys, buckets):
                    held[places] = _unpacked(right[c][got[kind, bucket]])
            counted_in = inside[row]
            words = one[codes] - own_words * counted_in
            p = (words + 1) / (total + vocabulary - ((n + 1) * inside)[row])
            p[tail] = (two[at] - own_pairs * counted_in[tail] + MU * p[tail]) / (words[tail - 1] + MU)
            s = np.concatenate([[0.0], np.cumsum(-np.log(p))])
            mean.append((s[ends[1:]] - s[ends[:-1]]) / np.maximum(n, 1))
        out += [pa.array(x, mask=n == 0) for x in (*mean, mean[0] - mean[1])]
        return pa.Table.from_arrays(out, ["doc_id", "n_words", "target_loss", "background_loss", "loss_difference"])

    both = rows.select("block", "ids", "n", "chosen", "names", "codes").groupBy("block").cogroup(counted.drop("keys").groupBy("block"))
    return both.applyInArrow(finish, "doc_id long, n_words long, target_loss double, background_loss double, loss_difference double")
