"""Embedding whitening by matrix-free block subspace iteration.

A vector's entries become integers, x = floor(256 * c); the fit list holds each distinct integer vector once, and is written as
a table. No covariance matrix V is made: a Spark pass over the fit list gives Xᵀ(XQ) / n for the centred rows X and a
block Q of orthonormal columns; tasks send a matrix of dimensions x columns each, which are added in ``GROUPS`` groups
and then on the driver (dimensions x columns x ``GROUPS`` numbers, whatever the number of rows). There, Rayleigh-Ritz on
the block gives eigenvalues and vectors and their residuals, and QR the next block. Where the residuals show that the
eigenvalues lie too close for the block, it is doubled: a block as wide as the vectors has all residuals zero
but for rounding. The passes end when the residuals certify all k components (``TOLERANCE`` of the largest eigenvalue).

Sums, n and deviations are exact integers. Defined results: rows whose vector is null or holds null or non-finite entries
go; vectors shorter than the longest are taken as if they ended in zeros; entries beyond 2**62 are held there;
components whose eigenvalue is zero (fewer than k directions, one distinct vector) have no whitened value
and are left out; of equal eigenvalues any basis is right; a deviation that no long can hold is null and stands in
``deviation_exact`` (text), where it always does; repeated vectors count once in the fit and come back as rows each, with any vec_id, null
included; other columns are ignored; an empty table gives no rows. A vector is one row, so its length is bounded by a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Of the largest eigenvalue, what a residual may have left.
TOLERANCE = 1e-12
#: Columns of the first block besides the components asked for.
EXTRA = 12
#: Groups in which the tasks' matrices are added before the driver gets them.
GROUPS = 16
#: Passes after which the iteration is given up; a doubled block ends it long before.
PASSES = 60
#: Rows of a batch that are floating numbers at a time.
ROWS = 8192
_LIMIT = 1 << 62
VECTOR = "x array<long>"


@dataclass
class Whitening:
    """n, integer sums by dimension, unit components as columns, eigenvalues, trace, and what was certified."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(rows: DataFrame, name: str = "embedding") -> DataFrame:
    """The rows that stay, with ``x``: the entries as integers."""
    whole = F.coalesce(F.forall(name, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))) & ~F.isnan(c.cast("double"))), F.lit(False))
    held = lambda c: F.when(c.cast("double") * 256 >= float(_LIMIT), F.lit(_LIMIT)).when(c.cast("double") * 256 <= -float(_LIMIT), F.lit(-_LIMIT)).otherwise(F.floor(c.cast("double") * 256))
    return rows.where(F.col(name).isNotNull() & whole).withColumn("x", F.transform(name, held).cast("array<long>"))


def matrix(column, width: int) -> np.ndarray:
    """A list column of integers as rows of ``width``, with zeros where a list ends."""
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return flat[ends[0] : ends[-1]].reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        out[i, : b - a] = flat[a:b]
    return out


def added(rows: DataFrame, part, whole) -> object:
    """``whole`` over what ``part`` (an iterator of integer or float arrays to bytes) makes of each task's rows: first in
    groups, in the order of the tasks, then here. ``whole`` takes a list of bytes and gives bytes."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made = part(b.column(0) for b in batches if b.num_rows)
        if made is not None:
            k = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([k % GROUPS], pa.int32()), pa.array([k], pa.int32()), pa.array([made], pa.binary())], ["g", "k", "m"])

    def gather(table):
        import pyarrow as pa

        got = table.sort_by("k").column("m").to_pylist()
        return pa.table({"m": pa.array([whole(got)], pa.binary())})

    sent = rows.mapInArrow(run, "g int, k int, m binary").groupBy("g").applyInArrow(gather, "m binary").collect()
    return whole([bytes(r.m) for r in sent]) if sent else None


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and sums by dimension, as whole numbers of any size."""

    def part(columns):
        n, sums = 0, [0] * width
        for c in columns:
            x = matrix(c, width)
            n += len(x)
            # Halves of 32 bits: their sums over a batch fit in 64 bits.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            sums = [s + (h << 32) + v for s, h, v in zip(sums, high, low, strict=True)]
        return " ".join(map(str, [n, *sums])).encode() if n else None

    def whole(parts):
        return " ".join(str(sum(v)) for v in zip(*(map(int, p.split()) for p in parts), strict=True)).encode()

    got = added(fit, part, whole)
    n, *sums = map(int, got.split()) if got else [0] + [0] * width
    return n, list(sums)


def _float_sums(fit: DataFrame, width: int, mean: np.ndarray, of) -> np.ndarray | None:
    """The sum over centred rows, some at a time, of ``of(rows)``, arrays of one shape."""

    def part(columns):
        total = None
        for c in columns:
            x = matrix(c, width)
            for i in range(0, len(x), ROWS):
                made = of(x[i : i + ROWS] - mean)
                total = made if total is None else total + made
        return None if total is None else total.astype("<f8").tobytes()

    def whole(parts):
        return np.sum([np.frombuffer(p, "<f8") for p in parts], axis=0).tobytes()

    got = added(fit, part, whole)
    return None if got is None else np.frombuffer(got, "<f8").copy()


def product(fit: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """One pass: V times the block, and V's trace."""
    width = len(mean)
    got = _float_sums(fit, width, mean, lambda x: np.append(x.T @ (x @ q), (x * x).sum()))
    return got[:-1].reshape(width, q.shape[1]) / n, float(got[-1]) / n


def subspace(fit: DataFrame, n: int, mean: np.ndarray, k: int, tolerance: float = TOLERANCE, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """Vectors, values, trace, the largest residual over the largest value, passes."""
    width = len(mean)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((width, min(width, k + extra))))[0]
    before = np.inf
    for passes in range(1, PASSES + 1):
        y, trace = product(fit, n, mean, q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        q, y = q @ turn, y @ turn
        top = min(k, len(values))
        scale = max(values[0], 0.0)
        residual = float(np.linalg.norm(y[:, :top] - q[:, :top] * values[:top], axis=0).max() / scale) if scale else 0.0
        if residual <= tolerance:
            break
        if q.shape[1] == width and residual <= 100 * tolerance:  # the whole space: what is left is rounding
            break
        slow = residual > 0.05 * before
        before = residual
        nxt = np.linalg.qr(y)[0]
        if slow and q.shape[1] < width:
            # More columns, orthogonal to those there are.
            more = rng.standard_normal((width, min(width, 2 * q.shape[1]) - q.shape[1]))
            nxt = np.linalg.qr(np.hstack([nxt, more - nxt @ (nxt.T @ more)]))[0]
        q = nxt
    else:
        raise RuntimeError(f"after {PASSES} passes a residual of {residual:.3g} of the largest eigenvalue is left")
    return q[:, :top], values[:top], trace, residual, passes


def train(rows: DataFrame, k: int = 4, name: str = "embedding") -> Whitening | None:
    """The components of the distinct integer vectors; None where there is no row."""
    made = integers(rows, name).select("x")
    width = made.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        return None
    if width > 0:
        short = F.size("x") < width
        made = made.select(F.when(short, F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))).otherwise(F.col("x")).alias("x"))
    scratch = Scratch(rows.sparkSession)
    fit = scratch.table(made.distinct(), "vectors")
    n, sums = exact_sums(fit, width)
    none = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    if not width:
        return none
    mean = none.mean
    vectors, values, trace, residual, passes = subspace(fit, n, mean, min(k, width))
    there = values > max(values[0], 0.0) * 1e-13 if len(values) else np.zeros(0, bool)
    if not there.any():
        return none
    out = Whitening(n, sums, vectors[:, there], values[there], trace, residual, passes)
    project, size = out.components / np.sqrt(out.values), int(there.sum())

    def moments(x):
        w = x @ project
        return np.append(w.sum(axis=0), (w.T @ w).ravel())

    got = _float_sums(fit, width, mean, moments) / n
    # The rows are centred before the product, so the whitened values' own means are rounding; they are taken off all the same.
    covariance = got[size:].reshape(size, size) - np.outer(got[:size], got[:size])
    out.identity_error = float(np.abs(covariance - np.eye(size)).max())
    return out


def whiten(rows: DataFrame, model: Whitening | None, key: str = "vec_id", name: str = "embedding") -> DataFrame:
    """The key, component, n, deviation, deviation_exact, whitened, explained, identity_error: a row for each vector and component."""
    src = integers(rows, name).select(F.col(key).alias("__key"), "x")
    kind = src.schema["__key"].dataType.simpleString()
    out = f"`{key}` {kind}, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return src.where("false").selectExpr(f"__key AS `{key}`", "0 AS component", "0L AS n", "0L AS deviation", "'' AS deviation_exact", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    m = rows.sparkSession.sparkContext.broadcast(model)  # dimensions x components

    def run(batches):
        import pyarrow as pa

        w = m.value
        width, size, mean, project = len(w.sums), len(w.values), w.mean, w.components / np.sqrt(w.values)
        squares, top = sum(s * s for s in w.sums), max(map(abs, w.sums))
        sums = np.array(w.sums, object) if top >= 1 << 63 else np.array(w.sums, np.int64)
        names = [x.split()[0].strip("`") for x in out.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                keys, x = b.column(0).slice(i, ROWS), matrix(b.column(1).slice(i, ROWS), width)
                big = max(int(np.abs(x).max(initial=0)), 1)
                fits = big * big * width < 1 << 63 and big * top * width < 1 << 63
                y, s = (x, sums) if fits else (x.astype(object), np.array(w.sums, object))
                # sum((n x - S)^2) = n^2 sum(x^2) - 2 n sum(x S) + sum(S^2), in whole numbers of any size
                exact = [w.n * w.n * a - 2 * w.n * c + squares for a, c in zip((y * y).sum(axis=1).tolist(), (y * s).sum(axis=1).tolist(), strict=True)]
                white = (x - mean) @ project
                each = np.repeat(np.arange(len(x)), size)
                parts = [
                    keys.take(pa.array(each)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.n)),
                    pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(pa.array(each)), pa.array([str(v) for v in exact], pa.string()).take(pa.array(each)),
                    pa.array(white.ravel()), pa.array(np.tile(w.values / w.trace, len(x))), pa.array(np.full(len(each), w.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(parts, names)

    return src.mapInArrow(run, out)
