"""Packing along a space-filling curve.

Every document is encoded once; the ids' hashed vectors are projected to a few dimensions by pseudo-random
directions, the projections are ranked on a grid, and the cell's Hilbert index is the document's place on the
curve. Documents are range-sorted by it, so neighbours in a sequence have similar words. Along the curve all
ids form one stream that is cut every ``length`` tokens: only the last sequence of all is padded.

No group or partition has to hold the stream: ranges are sorted in parallel, each range's token total is
added up (one number a range), and a document's place in the stream fixes its pieces on its own.

Defined results: a null text is the empty text (one piece, the end id); null and repeated doc_ids are packed as
they come (rows are told apart by an internal row id); an empty table gives no pieces; other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import CACHE_PIECES, blocks, encoder, give_back

DIMENSIONS, BITS = 4, 12
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """For every token id a vector of +-1, from a hash of the id: the same on every executor."""
    with np.errstate(over="ignore"):
        x = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.stack([((x >> np.uint64(7 * d + 3)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dimensions)], 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells (rows, dimensions), by Skilling's transform (AIP Conf. Proc. 707, 2004)."""
    x = cells.T.astype(np.int64).copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encode(docs: DataFrame, vocabulary: str, end_id: int, held: int = CACHE_PIECES) -> DataFrame:
    """doc_id, n (ids with the end id), key on the curve, ids (binary, the vocabulary's width)."""

    def run(batches):
        import pyarrow as pa

        give_back()
        enc = encoder(vocabulary, held=held)
        end = np.array([end_id], enc.width).tobytes()
        signs = directions(enc.tok.get_vocab_size())
        for b in batches:
            sizes = [range(len(x.as_buffer())) if x.is_valid else None for x in b.column(1)]
            for i, j in blocks(sizes):
                ids = [x + end for x in enc.encode([t or "" for t in b.column(1).slice(i, j - i).to_pylist()])]
                n = np.array([len(x) // enc.width.itemsize for x in ids])
                flat = signs[np.frombuffer(b"".join(ids), enc.width)]
                # The sum over a document, in units of its standard deviation under random signs times a root of its length.
                mean = np.add.reduceat(flat, np.cumsum(n) - n, axis=0) / n[:, None]
                cells = ((np.tanh(4 * mean) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(hilbert(cells)), pa.array(ids, pa.binary())], ["doc_id", "n", "key", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, key long, ids binary")


def stream_starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """row, start: for rows (row, key, n) the tokens before each in the order of (key, row)."""

    def run(batches):
        import pyarrow as pa

        total = 0
        for b in batches:
            n = b.column(1).to_numpy(False)
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - n), pa.array(ends), b.column(2)], ["row", "before", "ends", "part"])
            total = int(ends[-1]) if len(ends) else total

    ranged = rows.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    ranged = ranged.select("row", "n", F.spark_partition_id().cast("long").alias("part"))
    local = scratch.table(ranged.mapInArrow(run, "row long, before long, ends long, part long"), "starts")
    base, at = [], 0
    for r in local.groupBy("part").agg(F.max("ends").alias("n")).orderBy("part").collect():  # one number a range
        base.append((r.part, at))
        at += r.n
    bases = rows.sparkSession.createDataFrame(base, "part long, base long")
    return local.join(F.broadcast(bases), "part").select("row", (F.col("before") + F.col("base")).alias("start"))


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, payload: bool = False, held: int = CACHE_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids.
    ``held``: pieces of text whose ids a worker remembers, about 200 bytes each."""
    scratch = Scratch(docs.sparkSession)
    encoded = scratch.table(encode(docs, vocabulary, end_id, held).withColumn("row", F.monotonically_increasing_id()), "ids")
    starts = stream_starts(encoded.select("row", "key", "n"), scratch)

    def cut(batches):
        import pyarrow as pa

        width = encoder(vocabulary).width
        for b in batches:
            doc, begins = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[] for _ in range(8)]
            for d, at, raw in zip(doc, begins, b.column(2), strict=True):
                ids = np.frombuffer(raw.as_buffer(), width)
                i = 0
                while i < len(ids):
                    seq, off = divmod(at + i, length)
                    part = ids[i : i + length - off]
                    row = (d, i, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), seq, off, part.astype(np.int32) if payload else None)
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                    i += len(part)
            cols = [pa.array(o, pa.int64()) for o in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if payload else [])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

    placed = encoded.select("row", "doc_id", "ids").join(starts, "row").select("doc_id", "start", "ids")
    return placed.mapInArrow(cut, PIECE + (", ids array<int>" if payload else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, ids. A sequence has at most ``length`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
