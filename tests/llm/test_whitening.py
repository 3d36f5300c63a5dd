from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from packmill.llm.whitening import OFFSET, add_counts, bit_planes, op13_bit_sliced, weighted, whiten

SCHEMA = "vec_id long, label int, embedding array<double>, `row` string, n long, deviation long, d int, code int"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.lists(st.integers(0, 40), min_size=1, max_size=5), st.integers(0, 2**31))
def test_planes_give_exact_products(n, widths, seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 1 << w, n) if w else np.zeros(n, int) for w in widths], axis=1).astype(np.uint64)
    counts = np.zeros((sum(widths),) * 2, np.int64)
    for start in range(0, n, 70):
        add_counts(counts, bit_planes(x[start:start + 70], widths))
    sums, products = weighted(counts, widths)
    big = x.astype(object)
    assert sums == big.sum(axis=0).tolist()
    assert products == {(i, j): (big[:, i] * big[:, j]).sum() for i in range(len(widths)) for j in range(i, len(widths))}


def exact(rows):
    """n, S, covariance and the deviations, all in fractions."""
    x = [[int(np.floor(64 * c)) + OFFSET for c in v] for v in rows]
    distinct = sorted({tuple(v) for v in x})
    n, dims = len(distinct), range(len(x[0]))
    s = [sum(v[d] for v in distinct) for d in dims]
    cov = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in distinct), n**3) for j in dims] for i in dims]
    return n, s, np.array([[float(c) for c in r] for r in cov]), x, [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]


def check(found, rows, components=16):
    """Every row's results against the fractions."""
    n, s, cov, x, deviations = exact([v for _, v in rows])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by = {}
    for r in found:
        by.setdefault(r.row.vec_id, []).append(r)
    assert set(by) == {i for i, _ in rows} and sum(map(len, by.values())) == len(rows)
    k = min(components, len(s))
    white = []
    for (i, _), v, deviation in zip(rows, x, deviations, strict=True):
        r = by[i][0]
        assert (r.n, int(r.deviation)) == (n, deviation) and len(r.whitened) == len(r.explained) == k
        assert np.allclose(r.explained, np.maximum(values[:k], 0) / np.trace(cov), rtol=1e-6, atol=1e-12)
        white.append([np.nan if w is None else w for w in r.whitened])
        centred = np.array([float(Fraction(n * c - t, n)) for c, t in zip(v, s, strict=True)])
        for c in range(k):  # either sign
            if values[c] > 1e-9 * np.trace(cov):
                assert abs(abs(white[-1][c]) - abs(centred @ axes[:, c]) / np.sqrt(values[c])) < 1e-6
    keep = [x.index(list(t)) for t in sorted({tuple(v) for v in x})]
    y = np.array(white)[keep]
    y = y[:, ~np.isnan(y).any(axis=0)]
    y = y - y.mean(axis=0)
    error = np.abs(y.T @ y / n - np.eye(y.shape[1])).max() if y.size else 0
    assert abs(error - found[0].identity_error) < 1e-6 and found[0].identity_error < 1e-4


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, 0, None if v is None else [None if c is None else float(c) for c in v], "x", 1, 2, 3, 4)
                                for i, v in rows], SCHEMA)
    out = whiten(df, **options)
    assert out.select("row.*").columns == df.columns
    return out.collect()


@pytest.mark.parametrize("seed, dims, scale", [(0, 20, 0.2), (1, 5, 3.0), (2, 3, 2e6)])
def test_against_fractions(spark, seed, dims, scale):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(300, dims)) * scale * np.linspace(1, 3, dims)
    v[100:200] = v[0]  # a third of equal rows, which count once
    rows = [(k, r.tolist()) for k, r in enumerate(v)]
    check(run(spark, rows), rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0, -2.0]), (2, [0.5, 1.5, 2.0]), (None, [0.0, 1.0, 1.0])]
    odd = [(3, None), (4, [nan, 1, 1]), (5, [inf, 1, 1]), (6, [None, 1, 1]), (7, [1.0]), (8, [])]
    check(run(spark, rows + odd), rows)  # fewer vectors than dimensions
    same = run(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert len(same) == 2 and same[0].whitened == [None, None] and same[0].explained == [0.0, 0.0] and same[0].deviation == 0
    assert run(spark, []) == [] and run(spark, odd[:2]) == []
    far = run(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e300, 5.0])])
    # the second dimension's variance is nothing beside that of the first
    assert far[0].n == 3 and all(np.isfinite(r.whitened[0]) and r.whitened[1] is None for r in far)


def test_query(spark, tables):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 18)).astype(np.float32)
    folder = tables([], embeddings=pa.table({"vec_id": pa.array(range(200), pa.int64()), "embedding": pa.array(list(v), pa.list_(pa.float32())),
                                             "label": pa.array([0] * 200, pa.int32())}))
    got = op13_bit_sliced(spark, folder).collect()
    n, _, cov, _, deviations = exact(v.tolist())
    assert len(got) == 200 * 16 and {r.component for r in got} == set(range(1, 17))
    assert all(r.n == n and r.deviation == deviations[r.vec_id] for r in got)
    y = np.zeros((200, 16))
    for r in got:
        y[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(y.T @ y / n - np.eye(16)).max() < 1e-9
    explained = {r.component: r.explained for r in got}
    assert np.allclose([explained[k] for k in range(1, 17)], np.linalg.eigvalsh(cov)[::-1][:16] / np.trace(cov))
