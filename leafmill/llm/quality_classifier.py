"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012, "Baselines and bigrams").

Indicators of n-grams (byte pairs and triples, single bytes at a level of density, and patterns of repeated words)
are scaled by the classes' log-count ratios; a linear hinge-loss model is fitted to them by dual coordinate
descent (Hsieh et al. 2008, L2-loss). Scores are the margin through a sigmoid fitted on documents that the model
did not see.

The fit takes at most about ``MAX_FIT`` labelled documents with ``MAX_IDS`` indicators (the documented bounds), chosen by a
hash of their id; executors turn them to indicator ids, the driver fits. Scoring reads every whole text where it lies: no shuffle,
and what is broadcast has a fixed size.

Defined results: label rows with a null doc_id or quality are ignored, of contradicting labels the larger counts;
without labels every score is 0.5, with one class alone 1 or 0; null texts are empty texts; null doc_ids are
scored and not held out; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import forget, give_back

MAX_FIT, MAX_IDS = 8000, 32_000_000
TRIPLES, LEVELS, SHAPES = 1 << 16, 10, 32
SIZE = 65536 + TRIPLES + 256 * LEVELS + SHAPES


def indicators(text: str) -> np.ndarray:
    """Sorted distinct ids of the n-grams of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    on = np.zeros(SIZE, bool)
    if len(raw):
        b = raw.astype(np.uint32)
        on[(b[:-1] << 8) | b[1:]] = True
        on[65536 + ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16))] = True
        many = np.bincount(raw, minlength=256)
        seen = np.flatnonzero(many)
        level = np.clip(np.floor(np.log2(many[seen] / len(raw)) + LEVELS), 0, LEVELS - 1).astype(int)
        on[65536 + TRIPLES + seen * LEVELS + level] = True
    words = text.split()
    n = max(1, len(words))
    twice = sum(map(str.__eq__, words, words[1:]))
    base = 65536 + TRIPLES + 256 * LEVELS
    on[base + min(9, 10 * twice // n)] = True  # words equal to the next
    on[base + 10 + min(9, 10 * len({*words}) // n)] = True  # distinct words
    on[base + 20 + min(11, int(np.log2(n)))] = True
    return np.flatnonzero(on).astype(np.int32)


@dataclass
class Model:
    """``pull``: weight times ratio, ``square``: ratio squared, by indicator; margin = sum(pull) / sqrt(sum(square)) + bias."""

    pull: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.pull[ids].sum() / np.sqrt(self.square[ids].sum() + 1e-9)) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def constant(p: float) -> Model:
    return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))


def dual_descent(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-loss hinge model: one dual variable a document, in shuffled rounds."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    rng, diagonal = np.random.default_rng(0), 1 / (2 * cost)
    norm = np.array([v @ v + 1 for v in x])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1 + diagonal * alpha[i]
            if alpha[i] == 0 and g >= 0:
                continue
            worst = max(worst, abs(g))
            new = max(0.0, alpha[i] - g / (norm[i] + diagonal))
            step, alpha[i] = (new - alpha[i]) * y[i], new
            w[rows[i]] += step * x[i]
            bias += step
        if worst < 0.01:
            break
    return w, bias


def fit(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, rounds: int = 20, alpha: float = 1.0) -> Model:
    """From indicator ids and 0/1 labels. Every fifth document is kept for the sigmoid."""
    if not len(label) or label.min() == label.max():
        return constant(float(label.mean()) if len(label) else 0.5)
    learn = np.arange(len(label)) % 5 != 0
    if label[learn].min() == label[learn].max() or len(label) < 50:
        learn[:] = True
    sums = [np.full(SIZE, alpha), np.full(SIZE, alpha)]
    for i in np.flatnonzero(learn):
        sums[label[i]][rows[i]] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    own = [rows[i] for i in np.flatnonzero(learn)]
    x = [ratio[r] / np.sqrt(ratio[r] @ ratio[r] + 1e-9) for r in own]
    w, bias = dual_descent(own, x, np.where(label[learn] == 1, 1.0, -1.0), cost, rounds)
    model = Model(w * ratio, ratio * ratio, bias, 1.0, 0.0)
    test = np.flatnonzero(~learn) if not learn.all() else np.arange(len(label))
    m, y = np.array([model.margin(rows[i]) for i in test]), label[test].astype(float)
    a, b = 1.0, 0.0
    y = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):  # Newton steps for the sigmoid, slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(p - y) @ m + 1e-3 * a, (p - y).sum()])
        v = p * (1 - p)
        h = np.array([[v @ (m * m) + 1e-3, v @ m], [v @ m, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = max(a, 1e-3), b
    return model


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, max_ids: int = MAX_IDS) -> Model:
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    n = known.count()
    if n > max_fit:  # an even choice by hash, no sort
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_fit / n))
    src = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = src.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        forget()
        for b in batches:
            ids = [indicators(t) for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["doc_id", "label", "ids"])

    made = Scratch(docs.sparkSession).table(chosen.mapInArrow(run, "doc_id long, label int, ids array<int>"), "fit")
    total = made.agg(F.sum(F.size("ids"))).first()[0] or 0
    if total > max_ids:  # long texts: fewer of them, again by hash
        made = made.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * max_ids / total))
    got = made.toArrow().sort_by("doc_id")
    lists = got.column("ids").combine_chunks()
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    model = fit([flat[a:b] for a, b in zip(at, at[1:], strict=False)], got.column("label").to_numpy().astype(int))
    del got, lists, flat, at
    give_back()  # the driver goes on without what the fit took
    return model


def classify(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, held_out, score, predicted, th (text hash)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_fit))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            scores = [model.value.score(indicators(t.as_py() or "")) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], ["doc_id", "th", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(run, "doc_id long, th long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "th")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_fit: int = MAX_FIT) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; the score is taken beside the row, nothing is joined."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_fit))

    @F.pandas_udf("double")
    def score(text):
        return text.map(lambda t: model.value.score(indicators(t or "")))

    return docs.where(score(F.col("text").cast("string")) >= threshold)
