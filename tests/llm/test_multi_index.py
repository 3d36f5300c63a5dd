import duckdb
import numpy as np
import pyarrow as pa
import pytest

from packmill.llm import multi_index
from packmill.llm.multi_index import OP12_SQL, fit_index, near_vectors, needed_radius, op12_multi_index, unit

SCHEMA = "vec_id long, label int, embedding array<double>, `row` string, n long, root long, h1 int, cid int"


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(k, g, unit(np.array([v], float))[0]) for k, (_, g, v) in enumerate(rows) if g is not None and usable(v)]
    v = np.array([x for _, _, x in good]) if good else np.zeros((0, 1))
    near = v @ v.T >= cosine
    for a in range(len(good)):
        for b in np.flatnonzero(near[a]).tolist():
            if a != b and good[a][1] == good[b][1]:
                links[good[a][0]] += 1
                root[find(good[a][0])] = find(good[b][0])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    own = [least.get(find(k)) for k in range(len(rows))]
    return sorted(((r[0], links[k], own[k], r[0] is not None and own[k] == r[0]) for k, r in enumerate(rows)), key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, g, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2, 3, 4)
                                for i, g, v in rows], SCHEMA)
    found = near_vectors(df, **options)
    assert found.select("row.*").columns == df.columns
    return sorted(((r.row.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=repr)


def family(seed, n=900, dims=16):
    """Random vectors, chains of near copies around the threshold, a hot group of near copies and one of equal ones."""
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(n // 3)]
    while len(rows) < 2 * n // 3:
        base = rows[rng.integers(len(rows))]
        rows.append(base * rng.uniform(0.5, 2) + rng.normal(size=dims) * np.linalg.norm(base) * rng.uniform(0, 0.08))
    while len(rows) < n:
        rows.append(rows[0] + rng.normal(size=dims) * 0.05 * (len(rows) % 2))
    order = rng.permutation(n)
    return [(int(k), int(i % 3 == 0), rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("seed, chunk, cell", [(0, 1024, 64), (1, 16, 2)])
def test_certain_recall_against_all_pairs(spark, monkeypatch, seed, chunk, cell):
    monkeypatch.setattr(multi_index, "CHUNK", chunk)
    monkeypatch.setattr(multi_index, "CELL", cell)
    rows = family(seed)
    got = run(spark, rows, recall=1)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) and max(r[1] for r in got) > 100


def test_target_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 4)
    rows = family(2)
    got, expected = run(spark, rows), brute(rows)
    assert all(a[1] <= b[1] for a, b in zip(got, expected, strict=True))  # no link that isn't one
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in expected)


def test_pairs_meet_within_the_certain_radius():
    rng = np.random.default_rng(4)
    one = unit(rng.normal(size=(4000, 24)))
    # steps along one axis are the worst case: the whole distance may cross one plane
    step = rng.normal(size=one.shape) ** 5
    step -= (step * one).sum(axis=1, keepdims=True) * one
    two = unit(0.98 * one + np.sqrt(1 - 0.98**2) * unit(step))
    exact, likely = fit_index(one, 20, recall=1), fit_index(one, 20, recall=0.9)
    assert needed_radius(exact, one, two).max() <= exact.radius
    assert likely.radius < exact.radius / 2
    own, row, cell = exact.cells(one[:200])
    visits = {(r, c) for r, c in zip(row.tolist(), cell.tolist(), strict=True)}
    assert all((k, c) in visits for k, c in enumerate(own.tolist())) and len(visits) == len(row)
    assert [cell[row == k][0] for k in range(200)] == own.tolist()  # nearest first


def test_odd_rows(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, 0, one), (1, 0, one), (None, 0, one), (2, 1, one), (3, None, one), (4, 0, None), (5, 0, [nan, 1, 1]), (6, 0, [inf, 1, 1]),
            (7, 0, [None, 1, 1]), (8, 0, [0, 0, 0]), (9, 0, [-0.0, 0, 0]), (0, 0, [2e200, 4e200, 6e200]), (-5, 1, [1e-300, 2e-300, 3e-300]),
            (None, 2, [3, 1, 1]), (20, 0, [-1, -2, -3])]
    assert run(spark, rows) == brute(rows)
    others = [(10, 0, [1.0, 2.0]), (11, 0, [1.0, 2.0]), (12, 0, [])]  # other lengths than most
    assert run(spark, rows + others) == sorted(brute(rows) + [(i, 0, i, True) for i, _, _ in others], key=repr)
    assert run(spark, []) == [] and run(spark, [(1, 0, None), (2, None, one)]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_equals_sql(spark, tables):
    rows = family(5, 400)
    folder = tables([], embeddings=pa.table({
        "vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[2].tolist() for r in rows], pa.list_(pa.float32())),
        "label": pa.array([None if k % 40 == 3 else r[1] for k, r in enumerate(rows)], pa.int32())}))
    names = ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(tuple(r) for r in op12_multi_index(spark, folder).select(*names).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    expected = sorted(db.sql(OP12_SQL).select(*names).fetchall())
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in expected) > 100
    assert sum(a == b for a, b in zip(got, expected, strict=True)) >= 0.95 * len(expected)
