"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads segments of ``LENGTH`` UTF-8 bytes: one recurrent layer forwards, one backwards, each with reset and update
gates, and a linear layer that labels every position from both states. Its units use the softsign x / (1 + |x|), scaled to
0..1 for the gates: its powers need no exponentials, which is most of the time otherwise. A document's probabilities are
the mean of those of all its letter positions, so every byte of a whole text is read.

It is trained here in numpy by backpropagation through time with Adam, on a bounded sample (the documented bounds):
of each language about ``FIT_DOCS`` / languages documents, chosen by a hash of their id, ``FIT_SEGMENTS`` segments of
each, spread evenly over its whole text, equal segments once. The sample, not the corpus, goes to the driver; the weights
(some 100 KB) go to the tasks. Scoring reads each row where it lies: no shuffle, some megabytes of memory a task.

Defined results: lang_pred is ``und`` with score 0 where the text is null or has no letter (no character of the Unicode letter
categories), or where nothing could be learned; rows with a null doc_id are scored, not held out and not learned from;
of more than ``LANGUAGES`` languages the most frequent are learned; equal texts get equal results, ties go to the
language first in order; very long texts are read whole, a block of segments at a time; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import blocks, give_back

LENGTH, UNITS = 64, 8
#: Bounds of the sample: documents, segments of one, languages.
FIT_DOCS, FIT_SEGMENTS, LANGUAGES = 3000, 8, 256
#: Training: steps, segments a step, and the first rate of Adam.
STEPS, BATCH, RATE = 300, 192, 0.03
#: Segments that are read at a time.
CHUNK = 2048
UNKNOWN = "und"
_CANDIDATE = re.compile(r"[^\W\d_]")
#: Bytes of letters: ASCII letters, and all of which other letters are made.
LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_GATES = ("r", "z", "n")

Weights = dict[str, np.ndarray]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: Weights = field(default_factory=dict)


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as rows of ``LENGTH`` (zeros after a text's end), and the first row of each text. A text without
    bytes has a row of zeros."""
    rows = np.array([max(1, -(-len(t) // LENGTH)) for t in texts], np.int64)
    begin = np.cumsum(rows) - rows
    out = np.zeros((int(rows.sum()), LENGTH), np.uint8)
    flat = out.reshape(-1)
    for t, b in zip(texts, begin, strict=True):
        flat[b * LENGTH : b * LENGTH + len(t)] = np.frombuffer(t, np.uint8)
    return out, begin


def initial(languages: int, seed: int = 0, units: int = UNITS) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        for g in _GATES:
            w[f"E{d}{g}"] = (rng.standard_normal((256, units)) * 0.3).astype(np.float32)
            w[f"U{d}{g}"] = (np.linalg.qr(rng.standard_normal((units, units)))[0] * 0.7).astype(np.float32)
        w[f"E{d}z"] += 1.0  # the update gate starts by keeping the state
        w[f"W{d}"] = (rng.standard_normal((units, languages)) * 0.1).astype(np.float32)
    w["bias"] = np.zeros(languages, np.float32)
    return w


def _softsign(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


def label(w: Weights, rows: np.ndarray) -> np.ndarray:
    """Probabilities (languages, ``LENGTH``, rows) of each position. Buffers are used again and again: this is the hot path."""
    n, units = len(rows), w["Ufn"].shape[0]
    at = np.ascontiguousarray(rows.T).astype(np.intp)
    logits = np.empty((len(w["bias"]), LENGTH, n), np.float32)
    logits[:] = w["bias"][:, None, None]
    r, z, c, m, room = (np.empty((n, units), np.float32) for _ in range(5))
    for d, order in (("f", range(LENGTH)), ("b", range(LENGTH - 1, -1, -1))):
        h = np.zeros((n, units), np.float32)
        er, ez, en, ur, uz, un, out = w[f"E{d}r"], w[f"E{d}z"], w[f"E{d}n"], w[f"U{d}r"], w[f"U{d}z"], w[f"U{d}n"] * np.float32(0.5), np.ascontiguousarray(w[f"W{d}"].T)
        for t in order:
            np.take(er, at[t], axis=0, out=r, mode="clip")
            np.take(ez, at[t], axis=0, out=z, mode="clip")
            np.take(en, at[t], axis=0, out=c, mode="clip")
            r += np.matmul(h, ur, out=m)
            z += np.matmul(h, uz, out=m)
            _softsign(r, room)
            _softsign(z, room)
            np.matmul(h, un, out=m)  # gate times product is (1 + softsign) * half of it
            c += m
            m *= r
            c += m
            _softsign(c, room)
            h -= c
            h *= 0.5
            z *= h
            h += z
            h += c
            logits[:, t, :] += out @ h.T
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def gradients(w: Weights, rows: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over the letter positions of the rows, and its gradients by backpropagation through time."""
    n, dtype = len(rows), w["bias"].dtype
    at = rows.T.astype(np.intp)
    states: dict[str, list] = {"f": [], "b": []}
    kept: dict[str, np.ndarray] = {d: np.empty((LENGTH, n, w[f"U{d}n"].shape[0]), dtype) for d in "fb"}
    sign = lambda x: x / (1 + np.abs(x))
    orders = {"f": range(LENGTH), "b": range(LENGTH - 1, -1, -1)}
    for d, order in orders.items():
        h = np.zeros(kept[d].shape[1:], dtype)
        for t in order:
            sr = sign(w[f"E{d}r"][at[t]] + h @ w[f"U{d}r"])
            sz = sign(w[f"E{d}z"][at[t]] + h @ w[f"U{d}z"])
            m = h @ w[f"U{d}n"]
            c = sign(w[f"E{d}n"][at[t]] + 0.5 * (1 + sr) * m)
            states[d].append((h, sr, sz, m, c))
            h = c + 0.5 * (1 + sz) * (h - c)
            kept[d][t] = h
    logits = kept["f"] @ w["Wf"] + kept["b"] @ w["Wb"] + w["bias"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    weight = LETTER[at].astype(dtype)
    weight /= max(1.0, weight.sum())
    index = np.broadcast_to(y, at.shape)
    loss = float(-(np.log(np.take_along_axis(p, index[..., None], 2)[..., 0] + 1e-12) * weight).sum())
    np.put_along_axis(p, index[..., None], np.take_along_axis(p, index[..., None], 2) - 1, 2)
    p *= weight[..., None]
    flat = p.reshape(LENGTH * n, -1)
    g: Weights = {"bias": flat.sum(axis=0)}
    by_byte = np.argsort(at.ravel(), kind="stable")
    seen, first = np.unique(at.ravel()[by_byte], return_index=True)
    for d, order in orders.items():
        size = kept[d].shape[2]
        g[f"W{d}"] = kept[d].reshape(LENGTH * n, size).T @ flat
        out, dh = p @ w[f"W{d}"].T, np.zeros((n, size), dtype)
        u = {k: np.zeros((size, size), dtype) for k in _GATES}
        de = {k: np.empty((LENGTH, n, size), dtype) for k in _GATES}
        for t, (h, sr, sz, m, c) in zip(reversed(order), reversed(states[d]), strict=True):
            dh = dh + out[t]
            z, r = 0.5 * (1 + sz), 0.5 * (1 + sr)
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * 0.5 * (1 - np.abs(sz)) ** 2
            dr, dm = dc * m * 0.5 * (1 - np.abs(sr)) ** 2, dc * r
            u["n"] += h.T @ dm
            u["r"] += h.T @ dr
            u["z"] += h.T @ dz
            de["r"][t], de["z"][t], de["n"][t] = dr, dz, dc
            dh = dh * z + dm @ w[f"U{d}n"].T + dr @ w[f"U{d}r"].T + dz @ w[f"U{d}z"].T
        for k in _GATES:
            g[f"U{d}{k}"] = u[k]
            g[f"E{d}{k}"] = np.zeros((256, size), dtype)
            g[f"E{d}{k}"][seen] = np.add.reduceat(de[k].reshape(LENGTH * n, size)[by_byte], first, axis=0)
    return loss, g


def fit(rows: np.ndarray, y: np.ndarray, languages: int, steps: int = STEPS, seed: int = 0) -> Weights:
    """Adam over shuffled batches, with a falling rate and gradients clipped by their norm."""
    w, rng = initial(languages, seed), np.random.default_rng(seed + 1)
    one, two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    of = [np.flatnonzero(y == k) for k in range(languages)]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(0, languages, BATCH)])  # languages count alike
        _, g = gradients(w, rows[pick], y[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps)) / max(1.0, norm)
        for k, v in g.items():
            one[k] += 0.1 * (v / max(1.0, norm) - one[k])
            two[k] += 0.01 * ((v / max(1.0, norm)) ** 2 - two[k])
            w[k] -= (rate * max(1.0, norm) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _CANDIDATE.finditer(text))


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, max_docs: int = FIT_DOCS) -> DataFrame:
    """lang, segment: of each language its share of the documents, of each document some segments over its whole length."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null and text <> ''")
    known = known.where(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    many = F.count(F.lit(1)).over(Window.partitionBy())
    share = counts.select("lang", (F.lit(float(max_docs)) / many / F.col("count")).alias("share"))  # LANGUAGES rows at most
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lang, out = [], []
            for of, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, _ = segments([text.as_py().encode("utf-8", "replace")])
                for i in sorted({*np.linspace(0, len(rows) - 1, FIT_SEGMENTS).astype(int).tolist()}):
                    lang.append(of)
                    out.append(rows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "segment"])

    return chosen.select("lang", "text").mapInArrow(run, "lang string, segment binary").distinct()


def train(docs: DataFrame, max_docs: int = FIT_DOCS, steps: int = STEPS) -> Model:
    got = sample(docs, max_docs).toArrow().sort_by([("lang", "ascending"), ("segment", "ascending")])
    if not got.num_rows:
        return Model()
    rows = np.frombuffer(b"".join(got.column("segment").to_pylist()), np.uint8).reshape(-1, LENGTH)
    there = LETTER[rows].any(axis=1)
    langs = np.array(got.column("lang").to_pylist(), object)[there]
    languages = sorted({*langs.tolist()})
    if not languages:
        return Model()
    index = {x: i for i, x in enumerate(languages)}
    return Model(languages, fit(rows[there], np.array([index[x] for x in langs]), len(languages), steps))


def pooled(model: Model, texts: list[str | None]) -> np.ndarray:
    """(texts, languages): mean probabilities over the letter positions of each whole text."""
    rows, begin = segments([(t or "").encode("utf-8", "replace") for t in texts])
    total, weight = np.zeros((len(rows), len(model.languages))), np.zeros(len(rows))
    for i in range(0, len(rows), CHUNK):
        part = rows[i : i + CHUNK]
        on = LETTER[part.T].astype(np.float32)
        total[i : i + CHUNK] = (label(model.weights, part) * on).sum(axis=1).T
        weight[i : i + CHUNK] = on.sum(axis=0)
    return np.add.reduceat(total, begin, axis=0) / np.maximum(1, np.add.reduceat(weight, begin))[:, None]


def positions(model: Model, text: str) -> list[tuple[int, int, str]]:
    """The labels of a text's byte positions, as runs (start, end, language)."""
    raw = text.encode("utf-8", "replace")
    if not raw or not model.languages:
        return []
    rows, _ = segments([raw])
    best = np.concatenate([label(model.weights, rows[i : i + CHUNK]).argmax(axis=0).T.ravel() for i in range(0, len(rows), CHUNK)])[: len(raw)]
    cuts = np.flatnonzero(np.diff(best)) + 1
    return [(int(a), int(b), model.languages[best[a]]) for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]


def _scored(docs: DataFrame, model: Model, names: list[str], types: str, of) -> DataFrame:
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        give_back()
        for b in batches:
            sizes = [range(len(x.as_buffer())) if x.is_valid else None for x in b.column(1)]
            for i, j in blocks(sizes):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *of(m.value, b.column(1).slice(i, j - i).to_pylist())], ["doc_id", *names])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, {types}")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def of(model, texts):
        import pyarrow as pa

        there = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if there:
            p = pooled(model, [texts[i] for i in there])
            for i, k, v in zip(there, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[i], score[i] = model.languages[k], min(1.0, float(v))
        return [pa.array(lang, pa.string()), pa.array(score)]

    out = _scored(docs, model, ["lang_pred", "score"], "lang_pred string, score double", of)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def label_positions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, runs: each text's byte positions by label, as array<struct<start, end, lang>>."""

    def of(model, texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        return [pa.array([[{"start": a, "end": e, "lang": x} for a, e, x in positions(model, t or "")] for t in texts], kind)]

    return _scored(docs, model, ["runs"], "runs array<struct<start: long, end: long, lang: string>>", of)
