"""Token-id shards with a minimal perfect hash index from document keys to payload offsets.

Documents are dealt by ranges of their key; every task encodes its documents in key order and writes one shard,
two files: ``.ids``, the raw little-endian ids, and ``.idx``, the index: a minimal perfect hash over the distinct
keys, in levels of bit arrays, as in Limasset et al. (2017, "Fast and scalable minimal perfect hashing for massive key
sets"); a record for each of its slots (the key, its 32-bit fingerprint, its first document, how many it has);
and the end of every document's ids. A block of 64 bytes holds 480 bits and the number of set bits before them. So a
lookup reads one block a level (1.6 levels on average, whatever the size), one record, two ends and one slice of raw ids.

Shards are written through Spark's Python data source writer: a task's files count only once the driver has
committed its message, so a task that runs twice, or on an executor that is lost, leaves nothing that is read.
``manifest.json`` has a line of fixed length for each shard, in key order, and ``routes.bin`` their key ranges: tasks
that look keys up read both where they run, and nothing of the store passes through the driver.

Defined results: a null text is the empty text; rows with a null key come first and are stored, but a lookup
finds them only by a null key; repeated keys are all returned; an empty table makes a store without shards;
other columns of the input are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .common import Scratch, scratch_path
from .tokens import blocks, encoder

GAMMA = 2.0
#: Bytes of an index block, of its header, of a manifest line, and of what is read of an index at once.
BLOCK, HEAD, LINE, PAGE = 64, 4096, 512, 4096
BITS = (BLOCK - 4) * 8
#: Bytes of ids that neighbouring documents are read in at once.
RUN = 4 << 20
RECORD = np.dtype([("key", "<i8"), ("fingerprint", "<u4"), ("first", "<u4"), ("many", "<u4"), ("none", "<u4", 3)])
ROUTE = np.dtype([("first", "<i8"), ("last", "<i8"), ("keyed", "<i8"), ("nulls", "<i8")])
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


# --- minimal perfect hash ------------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over integer keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> np.uint64(32)).astype(np.uint32)


def hash_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct keys: a key is settled on the first level where it is alone in its place."""
    levels, left = [], keys
    while len(left):
        size = -(-max(64, int(GAMMA * len(left))) // BITS) * BITS
        at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def level_blocks(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Each level as rows of BLOCK bytes: the set bits before (of all levels), then BITS bits."""
    out, before = [], 0
    for bits in levels:
        rows = bits.reshape(-1, BITS)
        sums = rows.sum(1)
        ranks = (before + np.cumsum(sums) - sums).astype("<u4")
        out.append(np.concatenate([ranks[:, None].view(np.uint8), np.packbits(rows, axis=1)], axis=1))
        before += int(sums.sum())
    return out


# --- shard files ---------------------------------------------------------------------------------------------


def _open(path: str, mode: str):
    """A file in the shared folder, by whatever file system its address names."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition(":")
    if scheme in ("", "file"):
        path = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    store, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(at)
    return store.open_input_file(at)


def index_bytes(keys: np.ndarray, nulls: int, ends: np.ndarray, width: int) -> bytes:
    """Header, level blocks, records by slot, ends (a 0 first). ``keys``: of the documents after the ``nulls`` without one."""
    distinct, first, many = np.unique(keys, return_index=True, return_counts=True)
    levels = hash_levels(distinct)
    blocks_ = level_blocks(levels)
    at, sizes = HEAD, []
    for rows, bits in zip(blocks_, levels, strict=True):
        sizes.append((at, len(bits)))
        at += rows.size
    head = {"documents": len(ends), "nulls": nulls, "keys": len(distinct), "width": width, "levels": sizes, "records": at, "ends": at + RECORD.itemsize * len(distinct)}
    body = b"".join([*(rows.tobytes() for rows in blocks_), bytes(RECORD.itemsize * len(distinct)), np.concatenate([[0], ends]).astype("<i8").tobytes()])
    made = bytearray(json.dumps(head).encode().ljust(HEAD) + body)
    slots, _ = Index(memoryview(made)).slots(distinct)
    table = np.frombuffer(made, RECORD, len(distinct), at)
    table["key"][slots], table["fingerprint"][slots], table["first"][slots], table["many"][slots] = distinct, fingerprints(distinct), first + nulls, many
    return bytes(made)


class Index:
    """An index read by pages; ``bytes_read`` counts them. ``file``: an open file, or the bytes themselves."""

    def __init__(self, file):
        self.file, self.pages, self.bytes_read = file, {}, 0
        self.head = json.loads(self._bytes(0, HEAD))

    def _bytes(self, at: int, n: int) -> bytes:
        if isinstance(self.file, memoryview):
            return bytes(self.file[at : at + n])
        self.file.seek(at)
        self.bytes_read += n
        return self.file.read(n)

    def take(self, base: int, kind: np.dtype, at: np.ndarray) -> np.ndarray:
        """Items ``at`` of the array of ``kind`` (which divides BLOCK) at ``base``; pages are read once and held."""
        if not len(at):
            return np.zeros(0, kind)
        where = base + at.astype(np.int64) * kind.itemsize
        page, of = np.unique(where // PAGE, return_inverse=True)
        new = page[[p not in self.pages for p in page.tolist()]]
        for run in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1):
            if len(run):
                raw = self._bytes(int(run[0]) * PAGE, len(run) * PAGE)
                for k, p in enumerate(run.tolist()):
                    self.pages[p] = raw[k * PAGE : (k + 1) * PAGE].ljust(PAGE, b"\0")
        held = np.frombuffer(b"".join(self.pages[p] for p in page.tolist()), np.uint8)
        return held[(of * PAGE + where % PAGE)[:, None] + np.arange(kind.itemsize)].view(kind).ravel()

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, -1 for keys that no level holds (certainly absent), and the levels read for it."""
        out, read = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        for k, (base, size) in enumerate(self.head["levels"]):
            if not len(todo):
                break
            at = (mix(keys[todo], k) % np.uint64(size)).astype(np.int64)
            rows = self.take(base, np.dtype(("V", BLOCK)), at // BITS).view(np.uint8).reshape(-1, BLOCK)
            bits, place = np.unpackbits(rows[:, 4:], axis=1), at % BITS
            hit = bits[np.arange(len(at)), place] == 1
            before = rows[:, :4].copy().view("<u4").ravel() + (bits * (np.arange(BITS) < place[:, None])).sum(1)
            out[todo[hit]] = before[hit]
            read[todo] += 1
            todo = todo[~hit]
        return out, read

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key: its first document and how many; 0 documents where the fingerprint or the key differs."""
        slot, _ = self.slots(keys)
        first, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = np.flatnonzero(slot >= 0)
        rows = self.take(self.head["records"], RECORD, slot[known])
        same = (rows["fingerprint"] == fingerprints(keys[known])) & (rows["key"] == keys[known])
        first[known[same]], many[known[same]] = rows["first"][same], rows["many"][same]
        return first, many

    def bounds(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each document begin and end."""
        return tuple(self.take(self.head["ends"], np.dtype("<i8"), documents + k) for k in (0, 1))


class Shard:
    """A shard opened for reading: index pages and ids are read as they are asked for."""

    def __init__(self, path: str):
        self.index, self.file = Index(_open(path + ".idx", "r")), _open(path + ".ids", "r")
        self.width = self.index.head["width"]

    def ids(self, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each document; neighbours are read together, up to RUN bytes."""
        begin, end = begin * self.width, end * self.width
        i = 0
        while i < len(begin):
            j = i + 1
            while j < len(begin) and begin[j] == end[j - 1] and end[j] - begin[i] <= RUN:
                j += 1
            self.file.seek(int(begin[i]))
            raw = memoryview(self.file.read(int(end[j - 1] - begin[i])))
            for k in range(i, j):
                yield np.frombuffer(raw[begin[k] - begin[i] : end[k] - begin[i]], f"<u{self.width}")
            i = j


@dataclass
class ShardMessage(WriterCommitMessage):
    shard: dict | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.vocabulary, self.end_id = options["path"].rstrip("/"), options["vocabulary"], int(options["end_id"])
        self.special_as_text = options["special_as_text"] == "true"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Rows (doc_id, text) in key order. One pass; held in memory: the index, never the ids."""
        enc = encoder(self.vocabulary, self.special_as_text)
        end = np.array([self.end_id], enc.width).tobytes()
        name = f"{self.path}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        keys, ends, total, nulls, out = [], [], 0, 0, None
        for batch in iterator:
            doc, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            if out is None and len(texts):
                out = _open(name + ".ids", "w")
            nulls += doc.null_count  # they come first
            keys.append(doc.drop_null().to_numpy(False))
            for i, j in blocks(texts):
                for ids in enc.encode(texts[i:j]):
                    out.write(ids + end)
                    total += len(ids) // enc.width.itemsize + 1
                    ends.append(total)
        if out is None:
            return ShardMessage(None)
        out.close()
        keys = np.concatenate(keys)
        with _open(name + ".idx", "w") as f:
            f.write(index_bytes(keys, nulls, np.array(ends), enc.width.itemsize))
        first, last = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return ShardMessage({"name": name.rsplit("/", 1)[1], "first_key": first, "last_key": last, "documents": len(ends), "nulls": nulls, "tokens": total})

    def commit(self, messages: list) -> None:
        """The manifest: committed shards in key order, each with the number of tokens before it."""
        low = lambda k: (k is not None, k or 0)
        shards = sorted((m.shard for m in messages if m is not None and m.shard), key=lambda s: (not s["nulls"], low(s["first_key"]), low(s["last_key"]), s["name"]))
        before, routes = 0, np.zeros(len(shards), ROUTE)
        for k, s in enumerate(shards):
            s["shard"], s["start"], before = k, before, before + s["tokens"]
            routes[k] = (s["first_key"] or 0, s["last_key"] or 0, s["first_key"] is not None, s["nulls"])
        with _open(f"{self.path}/routes.bin", "w") as f:
            f.write(routes.tobytes())
        with _open(f"{self.path}/manifest.json", "w") as f:
            f.write("".join(json.dumps(s).ljust(LINE - 1) + "\n" for s in shards).encode())

    def abort(self, messages: list) -> None:
        """Nothing was committed; files of attempts are never read."""


class TokenShards(DataSource):
    """``df.write.format("token_shards").option("path", ...)``: (doc_id long, text string) to shards."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


# --- operators -----------------------------------------------------------------------------------------------


def write_store(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, special_as_text: bool = False) -> None:
    """Encodes ``docs`` (doc_id, text) into shards below ``path``. Key ranges by Spark's own range partitioner;
    the text's hash breaks ties, so that the rows of one hot key can be dealt over several shards. The strings of special
    tokens in a text give those tokens, as the library has it, or are ordinary text by ``special_as_text``."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenShards)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    options = {"path": path, "vocabulary": vocabulary, "end_id": str(end_id), "special_as_text": str(special_as_text).lower()}
    dealt.write.format("token_shards").options(**options).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard."""
    return spark.read.schema("shard long, name string, first_key long, last_key long, documents long, nulls long, tokens long, start long").json(f"{path}/manifest.json")


def lookup(keys: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """Keyed access: the documents of every distinct key of ``keys`` (doc_id), read from the shards.

    Keys are routed to shards by the store's key ranges: each key goes once to every shard whose range holds it, found by
    binary search (32 bytes a shard, read by each task). There are as many reading tasks as shards that hold keys asked for.
    Returns doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as 32-bit integers) and, on request, ids. Absent keys give no row.
    """
    spark = keys.sparkSession
    schema = ROW + (", ids array<int>" if payload else "")

    def route(batches):
        import pyarrow as pa

        with _open(f"{path}/routes.bin", "r") as f:
            routes = np.frombuffer(f.read(), ROUTE)
        keyed, unkeyed = (np.flatnonzero(routes[c]) for c in ("keyed", "nulls"))
        for b in batches:
            doc = b.column(0)
            k = doc.drop_null().to_numpy(False)
            lo, hi = np.searchsorted(routes["last"][keyed], k, "left"), np.searchsorted(routes["first"][keyed], k, "right")
            many = np.maximum(hi - lo, 0)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(keyed[np.repeat(lo, many) + step]), pa.array(np.repeat(k, many))], ["shard", "key"])
            if doc.null_count:
                yield pa.RecordBatch.from_arrays([pa.array(unkeyed), pa.nulls(len(unkeyed), pa.int64())], ["shard", "key"])

    def read(batches):
        import pyarrow as pa

        at, opened, start = None, None, 0
        for b in batches:
            shard = b.column(0).to_numpy(False)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)] if len(shard) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if at != shard[i]:
                    at = int(shard[i])
                    with _open(f"{path}/manifest.json", "r") as f:
                        f.seek(at * LINE)
                        line = json.loads(f.read(LINE))
                    opened, start = Shard(f"{path}/{line['name']}"), line["start"]
                part = b.column(1).slice(i, j - i)
                keyed = part.drop_null().to_numpy(False)
                first, many = opened.index.find(keyed)
                if part.null_count:
                    first, many = np.append(first, 0), np.append(many, opened.index.head["nulls"])
                of = np.repeat(np.arange(len(many)), many)
                documents = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[of]
                begin, end = opened.index.bounds(documents)
                names = pa.concat_arrays([pa.array(keyed, pa.int64()), pa.nulls(int(part.null_count > 0), pa.int64())]).take(pa.array(of))
                crc, ids = [], []
                for x in opened.ids(begin, end):
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                    if payload:
                        ids.append(x.astype(np.int32))
                cols = [names, pa.array(start + begin), pa.array(end - begin), pa.array(crc, pa.int64())] + ([pa.array(ids, pa.list_(pa.int32()))] if payload else [])
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(route, "shard long, key long")
    routed = Scratch(spark).table(asked, "routed")
    shards = routed.select("shard").distinct().count()
    if not shards:
        return spark.createDataFrame([], schema)
    # By number: sizes of keys say nothing about the ids behind them, so few keys must not be merged into one task.
    return routed.repartition(shards, "shard").sortWithinPartitions("shard", "key").mapInArrow(read, schema)


def encode_and_read(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes the store, then reads every document back by its key."""
    path = path or scratch_path(docs.sparkSession, "store")
    write_store(docs, path, vocabulary, end_id, special_as_text)
    return lookup(docs.select("doc_id"), path)
