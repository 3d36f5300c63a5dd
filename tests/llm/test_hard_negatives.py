import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packmill.llm.hard_negatives import OP11_SQL, _Best, hard_negatives, op11_slots

SCHEMA = "vec_id long, label int, embedding array<double>, `row` string, score long, rid long, q int"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """All windows one by one; rows are (id, label, integer vector)."""
    out = []
    for k, (anchor, label, v) in enumerate(rows):
        if anchor not in anchors:
            continue
        scored = sorted((-int(np.dot(v, w)), i, g) for n, (i, g, w) in enumerate(rows) if n != k)
        for s, positive, _ in [x for x in scored if x[2] == label][:positives]:
            window = [(i, -t) for t, i, g in scored if g != label and -low * s <= -100 * t <= -high * s]
            out += [(anchor, positive, place, i, -s, t) for place, (i, t) in enumerate(window[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, g, None if v is None else [float(x) for x in v], "x", 1, 2, 3) for i, g, v in rows], SCHEMA)


def run(spark, rows, anchors, **options):
    found = hard_negatives(frame(spark, rows), F.col("vec_id").isin(list(anchors)), **options)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed, block", [(0, 4096), (1, 7)])
def test_against_all_windows(spark, seed, block):
    rng = np.random.default_rng(seed)
    rows = [(k, int(rng.integers(4)), rng.integers(-3, 9, 6)) for k in range(400)]
    rows = [(k, g, rows[0][2] if k % 3 == 0 else v) for k, g, v in rows]  # a third of equal vectors: ties
    anchors = range(0, 400, 9)
    got = run(spark, [(k, g, v / 256) for k, g, v in rows], anchors, block=block)
    assert got == brute(rows, set(anchors)) and len(got) > 500


def test_other_limits(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(3)), rng.integers(-9, 9, 4)) for k in range(120)]
    options = {"positives": 3, "negatives": 4, "low": -50, "high": 120}
    got = run(spark, [(k, g, v / 256) for k, g, v in rows], {3, 50}, **options)
    assert got == brute(rows, {3, 50}, **options) and got


def test_odd_rows(spark):
    one, nan, inf = np.ones(3) / 256, float("nan"), float("inf")
    good = [(1, 0, one * 10), (1, 0, one * 10), (2, 0, one * 9), (3, 1, one * 5), (3, 1, one * 5), (4, 1, one)]
    odd = [(5, None, one), (None, 0, one), (6, 0, None), (7, 0, [1, nan, 1]), (8, 0, [1, inf, 1]), (9, 0, [1.0, 1.0]), (10, 0, [])]
    got = run(spark, good + odd, set(range(1, 11)))
    assert got == brute([(i, g, np.floor(256 * np.asarray(v)).astype(int)) for i, g, v in good], set(range(1, 11)))
    assert run(spark, [], {1}) == [] and run(spark, good, {77}) == [] and run(spark, [(1, 0, one)], {1}) == []
    # beyond what is held: still integers, and no score overflows
    huge = [(1, 0, [1e30]), (2, 0, [-1e30]), (3, 1, [2.0**18])]
    assert run(spark, huge, {1}) == [] and run(spark, huge, {1}, low=-200, high=100) == []


def test_null_component(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, None]), (1, 0, [1.0, 1.0]), (2, 0, [1.0, 1.0]), (3, 1, [0.5, 0.5])],
                                 "vec_id long, label int, embedding array<double>")
    assert [tuple(r) for r in hard_negatives(rows, F.col("vec_id") == 1).collect()] == [(1, 2, 1, 3, 131072, 65536)]


def test_best_keeps_least_per_key():
    rng = np.random.default_rng(0)
    best, everything = _Best(5, 3), []
    for _ in range(20):
        part = [rng.integers(0, 5, 50), rng.integers(0, 9, 50), rng.integers(0, 10**6, 50)]
        best.add(*part)
        everything += list(zip(*[x.tolist() for x in part], strict=True))
    expected = [sorted([(k, -s, i) for k, s, i in everything if k == key])[:3] for key in range(5)]
    assert sorted((k, -s, i) for k, s, i in zip(*[x.tolist() for x in best.held], strict=True)) == sorted(sum(expected, []))


def test_query_equals_sql(spark, tables):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 8)).round(2)
    vectors[100:160] = vectors[0]
    folder = tables([], embeddings=pa.table({
        "vec_id": pa.array(range(500), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())),
        "label": pa.array([None if k % 50 == 3 else k % 10 for k in range(500)], pa.int32())}))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in op11_slots(spark, folder).select(*names).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(db.sql(OP11_SQL).select(*names).fetchall()) and len(got) > 50
