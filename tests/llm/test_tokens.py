import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import packing, token_counts, token_store, tokens

from .odd import ROWS, frame, plain


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_holds_the_librarys_ids(spark, tmp_path):
    tok = library("byte_bpe_50k.json")
    path = f"file://{tmp_path}/store"
    got = token_store.encode_and_read(frame(spark), path=path).collect()
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in ROWS]
    assert plain((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == plain((d, len(x), crc(x)) for d, x in ids)
    places = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    at = 0
    for start, n, _ in places:
        assert start == at
        at += n
    keys = [d for *_, d in places if d is not None]
    assert keys == sorted(keys)
    some = token_store.lookup(spark.createDataFrame([(1,), (8,), (999,), (8,)], "doc_id long"), path, payload=True).collect()
    assert {r.doc_id: r.ids for r in some} == {d: x for d, x in ids if d in (1, 8)}
    assert token_store.encode_and_read(frame(spark, []), path=f"file://{tmp_path}/none").count() == 0


def index_of(keys, nulls=0):
    ends = np.cumsum(np.full(len(keys) + nulls, 7))
    return pa.BufferReader(token_store.index_bytes(np.sort(keys), nulls, ends, 2))


def test_index_finds_every_key_and_no_other():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    keys = np.concatenate([keys, keys[:50], [np.iinfo(np.int64).min]])
    index = token_store.Index(index_of(keys, 3))
    slots, _ = index.slots(np.unique(keys))
    assert sorted(slots) == list(range(len(np.unique(keys))))
    first, many = index.find(keys)
    stored = np.sort(keys)
    assert all(n == (stored == k).sum() and stored[f - 3] == k for k, f, n in zip(keys[::37], first[::37], many[::37], strict=True))
    assert not index.find(np.random.default_rng(2).integers(-(2**62), 2**62, 5000))[1].any()
    begin, end = index.bounds(first)
    assert (begin == 7 * first).all() and (end == begin + 7).all()


def test_a_lookup_reads_as_much_whatever_the_size():
    read = {}
    for size in (2_000, 200_000):
        keys = np.random.default_rng(size).permutation(10 * size)[:size].astype(np.int64)
        raw, found = index_of(keys), []
        for k in keys[:200]:
            index = token_store.Index(raw)
            first, many = index.find(np.array([k]))
            index.bounds(first)
            assert many[0] == 1
            found.append(index.bytes_read)
        read[size] = np.mean(found), max(found)
    assert read[200_000][0] < read[2_000][0] * 1.2 + token_store.PAGE and read[200_000][1] <= token_store.HEAD + 12 * token_store.PAGE


def test_special_token_strings(spark, tmp_path):
    tok = library("byte_bpe_50k.json")
    rows = [(1, "start <|endoftext|> end"), (2, "a.b<|endoftext|>c  <|endoftext|>"), (3, "<|endoftext|"), (4, "<|startoftext|> x<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in token_store.encode_and_read(docs, path=f"{tmp_path}/a").collect()}
    assert got == {d: crc(tok.encode(t, add_special_tokens=False).ids + [0]) for d, t in rows}
    words = library("word_bpe_49k.json")
    whole = {r.doc_id: r.ids for r in packing.pack(docs, payload=True).collect()}
    assert whole == {d: words.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    tok.encode_special_tokens = True
    got = {r.doc_id: r.ids_crc32 for r in token_store.encode_and_read(docs, path=f"file:{tmp_path}/b", special_as_text=True).collect()}
    assert got == {d: crc(tok.encode(t, add_special_tokens=False).ids + [0]) for d, t in rows}


def test_keys_at_the_ends_of_shards(spark, tmp_path):
    """A hot key over several shards, null keys, the smallest long, and keys between shards."""
    low = -(2**63)
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(40)] + [(low, "low"), (low, "lower")] + [(100 + 3 * i, "x" * i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = token_store.encode_and_read(docs, path=f"{tmp_path}/c").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tok = library("byte_bpe_50k.json")
    assert plain((r.doc_id, r.ids_crc32) for r in got) == plain((d, crc(tok.encode(t, add_special_tokens=False).ids + [0])) for d, t in rows)
    assert token_store.manifest(spark, f"{tmp_path}/c").count() > 1
    some = token_store.lookup(spark.createDataFrame([(101,), (8,), (low,), (None,)], "doc_id long"), f"{tmp_path}/c").collect()
    assert [r.doc_id for r in some if r.doc_id != low] == [None] * 40 and len(some) == 42
    one = token_store.lookup(spark.createDataFrame([(103,)], "doc_id long"), f"{tmp_path}/c")
    assert one.rdd.getNumPartitions() == 1 and [r.doc_id for r in one.collect()] == [103]  # a key is one task, whatever the store has
    assert token_store.lookup(spark.createDataFrame([], "doc_id long"), f"{tmp_path}/c").count() == 0


@pytest.mark.parametrize("length", [64, 2048])
def test_pieces_make_whole_sequences(spark, length):
    tok = library("word_bpe_49k.json")
    got = packing.pack(frame(spark), length, payload=True).collect()
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in ROWS]
    whole, held = {}, {}
    for r in got:
        assert r.length == len(r.ids) and crc(r.ids) == r.ids_crc32 and r.offset + r.length <= length
        whole.setdefault((r.doc_id, r.doc_tokens, r.sequence_id * length + r.offset - r.start), []).append((r.start, r.ids))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    joined = [(d, [i for _, part in sorted(p) for i in part]) for (d, _, _), p in whole.items()]
    assert plain(joined) == plain(ids)
    for s, p in held.items():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at == length or s == max(held)
    assert packing.pack(frame(spark, [])).count() == 0
    lined = packing.sequences(packing.pack(frame(spark), length, payload=True))
    assert lined.where(F.size("ids") > length).count() == 0


def test_hilbert_neighbours_touch():
    n, bits = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    key = packing.hilbert(cells, bits)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_by_offsets(spark, rule):
    """Line sections against the library's own offsets, token by token."""
    tok = library("byte_bpe_50k.json")
    got = token_counts.count_tokens(token_counts.line_sections(frame(spark)), rule).collect()
    want = []
    for d, t in ROWS:
        t, at, spans = t or "", 0, []
        for line in t.split("\n"):
            spans.append((at, min(at + len(line) + 1, len(t))))
            at += len(line) + 1
        count = [0.0] * len(spans)
        for a, b in tok.encode(t, add_special_tokens=False).offsets:
            over = [max(0, min(b, y) - max(a, x)) for x, y in spans]
            if rule == "share":
                count = [c + o / (b - a) for c, o in zip(count, over, strict=True)]
            elif rule == "majority":
                count[over.index(max(over))] += 1
            else:
                count[next(i for i, (x, y) in enumerate(spans) if x <= a < y)] += 1
        want += [(d, i, x, y, round(c, 6)) for i, ((x, y), c) in enumerate(zip(spans, count, strict=True))]
    assert plain((r.doc_id, r.section, r.start, r.end, round(r.tokens, 6)) for r in got) == plain(want)
    assert token_counts.count_tokens(token_counts.line_sections(frame(spark, []))).count() == 0


def test_named_sections(spark):
    docs = spark.createDataFrame([(1, "title: some words here"), (2, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, "head", 0, 6), (1, "body", 6, 16)], "doc_id long, name string, start int, end int")
    got = {r.name: r.tokens for r in token_counts.count_tokens(token_counts.field_sections(docs, spans)).collect()}
    offsets = library("byte_bpe_50k.json").encode("title: some words here").offsets
    assert got["head"] == sum(b <= 6 for _, b in offsets) and got[None] == sum(a >= 16 for a, _ in offsets)


def test_other_vocabularies_encode_texts_whole(tmp_path):
    import shutil

    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), tmp_path / "other.json")
    enc, tok = tokens.Encoder(str(tmp_path / "other.json")), library("byte_bpe_50k.json")
    texts = ["Some words, some  more.", "", "Some words, some  more.", "x" * 300]
    assert enc.cut(texts) == [[t] for t in texts]
    assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
