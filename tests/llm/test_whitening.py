import numpy as np
import pytest

from leafmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i if i else None, v, 1, "x", 2, 3) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, k=4):
    """numpy on all rows at once: integer vectors, exact sums, the covariance matrix and its eigenvectors."""
    width = max((len(v) for v in vectors), default=0)
    x = [tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) + (0,) * (width - len(v)) for v in vectors]
    fit = np.array(sorted(set(x)), float)
    v = np.cov(fit.T, bias=True).reshape(width, width)
    e, q = np.linalg.eigh(v)
    return x, len(fit), [sum(c) for c in zip(*set(x), strict=True)], e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def held(spark, vectors, k=4):
    ok = [v for v in vectors if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x, n, sums, e, q, trace = brute(ok, k)
    rows = frame(spark, vectors)
    model = whitening.train(rows, k)
    got = whitening.whiten(rows, model).collect()
    kept = [i if i else None for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    mean = np.array(sums) / n
    assert len(got) == len(kept) * len(model.values)
    at = {}
    for r in got:
        at.setdefault(r.component, {})[r.vec_id] = r
    for c in range(1, len(model.values) + 1):
        white = (np.array(x, float) - mean) @ q[:, c - 1] / np.sqrt(e[c - 1])
        mine = np.array([at[c][i].whitened for i in kept])
        sign = np.sign(white @ mine)
        assert np.abs(mine * sign - white).max() < 1e-6
        for i, v in zip(kept, x, strict=True):
            exact = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert at[c][i].n == n and at[c][i].deviation_exact == str(exact) and at[c][i].deviation == (exact if exact < 1 << 63 else None)
            assert at[c][i].explained == pytest.approx(e[c - 1] / trace, rel=1e-9) and at[c][i].identity_error < 1e-9
    return model


def test_close_and_distant_eigenvalues_against_numpy(spark):
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((600, 40)).astype("f4").tolist()
    model = held(spark, flat + flat[:50] + [None, [float("nan")] * 40, [None] + [0.0] * 39, [float("inf")] + [0.0] * 39])
    assert model.passes < 12 and model.residual < 1e-10
    steep = (rng.standard_normal((500, 60)) * 0.7 ** np.arange(60)).astype("f4").tolist()
    assert held(spark, steep).passes < 12  # a block narrower than the vectors is enough


def test_odd_vectors(spark):
    held(spark, [[1.0, 2.0, 3.0], [2.0], [], [0.5, -0.25, 8.0], [1.0, 2.0, 3.0], [9.0, 1.0, 1.5, 4.0], [-3.0, 2.5]], k=4)  # short ones end in zeros
    line = held(spark, [[float(i), 2.0 * i, 0.0] for i in range(30)])
    assert len(line.values) == 1  # one direction
    held(spark, [[1e6 * i, -3e6 * i * i, 5.0 * i] for i in range(400)], k=2)  # deviations beyond a long
    for few in ([], [None], [[1.0, 2.0]] * 5, [[]]):
        rows = frame(spark, few)
        assert whitening.whiten(rows, whitening.train(rows)).count() == 0
    far = frame(spark, [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]])  # held at the bounds, no failure
    got = whitening.whiten(far, whitening.train(far)).collect()
    assert len(got) >= 3 and all(np.isfinite(r.whitened) for r in got)


def test_sums_and_order_of_partitions(spark):
    """Equal whatever the partitions, but for rounding."""
    rng = np.random.default_rng(5)
    rows = frame(spark, rng.standard_normal((300, 16)).astype("f4").tolist())
    one, many = whitening.train(rows.coalesce(1)), whitening.train(rows.repartition(23))
    assert (one.n, one.sums) == (many.n, many.sums) and np.allclose(one.values, many.values, rtol=1e-12)
