import duckdb
import numpy as np
import pyarrow as pa
import pytest

from packmill.llm.hamming import OP5_SQL, nearest_codes, op5_multi_index_hashing


def brute(codes, queries, k, bits=64):
    mask = (1 << bits) - 1
    out = []
    for qid, q in sorted(set(queries)):
        near = sorted((bin((q ^ c) & mask).count("1"), i) for i, c in set(codes) if i != qid)
        out += [(qid, rank, i, d) for rank, (d, i) in enumerate(near[:k], 1)]
    return out


def run(spark, codes, queries, k, bits=64):
    frames = [spark.createDataFrame(x, "id long, code long") for x in (codes, queries)]
    return sorted(tuple(r) for r in nearest_codes(*frames, k, bits).collect())


@pytest.mark.parametrize("bits, seed", [(64, 0), (16, 1)])
def test_against_brute_force(spark, bits, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-2**62, 2**62, 6) if bits == 64 else rng.integers(0, 2**15, 6)
    codes = []
    for i in range(400):  # clusters, outliers and a third of equal codes
        code = int(centres[0]) if i % 3 == 0 else int(centres[rng.integers(6)])
        if i % 3:
            for b in rng.integers(0, bits - 1, rng.integers(0, 12)):
                code ^= 1 << int(b)
        codes.append((i, code))
    queries = [c for c in codes if c[0] % 40 < 3]
    assert run(spark, codes, queries, 7, bits) == brute(codes, queries, 7, bits)


def test_odd_rows(spark):
    codes = [(1, 5), (1, 5), (2, None), (None, 3), (3, 5)]
    assert run(spark, codes, codes, 10) == [(1, 1, 3, 0), (3, 1, 1, 0)]
    assert run(spark, [], [(1, 2)], 3) == []


def test_query_equals_sql(spark, tables):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 64)).round(3)
    vectors[50:150] = vectors[0]
    folder = tables([], embeddings=pa.table({
        "vec_id": pa.array(range(300), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float32())),
        "label": pa.array([0] * 300, pa.int32())}))
    got = sorted(tuple(r) for r in op5_multi_index_hashing(spark, folder).select(
        "query_id", "rank", "neighbor_id", "distance").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(db.sql(OP5_SQL).fetchall()) and len(got) == 30
