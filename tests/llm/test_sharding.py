import zlib
from collections import defaultdict

import numpy as np
import pytest

from packmill.llm.sharding import _cuts, hilbert_index, hilbert_shards, op3_hilbert, write_shards


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def corpus(n=500):
    rng = np.random.default_rng(5)
    return [(k, "é" * int(rng.integers(0, 60)) + "x" * (k % 7), "en" if k % 3 else "de",
             None if k % 11 == 0 else "hot" if k % 3 == 0 else f"s{k % 9}") for k in range(n)]


def check(rows, got, shards=24):
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    slots = defaultdict(list)
    for r in got:
        raw = (r.row.text or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        sizes[r.shard] += r.size
        slots[r.shard].append((r.slot, r.curve, r.text_crc32))
    for own in slots.values():
        own.sort()
        assert [s for s, _, _ in own] == list(range(len(own)))
        assert [o[1:] for o in own] == sorted(o[1:] for o in own)
    ends = [(min(o[1] for o in slots[s]), max(o[1] for o in slots[s])) for s in sorted(slots)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    part, most = sum(sizes.values()) / shards, max((r.size for r in got), default=0)
    assert all(0 <= s < shards and abs(sizes[s] - part) <= most for s in range(shards) if s in sizes)


def test_shards(docs):
    rows = corpus()
    check(rows, hilbert_shards(docs(rows)).collect())


def test_odd_rows(docs):
    rows = [(None, None), (1, ""), (1, ""), (2, "a", "en", ""), (3, "long " * 40_000, "fr", "z"), (3, "b", None, "z")]
    rows += [(7, "same", "en", "hot")] * 300
    check(rows, hilbert_shards(docs(rows)).collect())
    assert hilbert_shards(docs([])).count() == 0


def test_cells_are_cut_by_all_rows(spark):
    n, bits = 30_000, 6  # that many different combinations, each row counts
    rows = spark.range(n, numPartitions=7).selectExpr(
        "id * 7919 % 30011 * 5 AS a", "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 50 END AS b", "id * id AS c", "7L AS d")
    got = _cuts(rows, ["a", "b", "c", "d"], bits)
    for name, cuts in zip("abcd", got, strict=True):
        values = sorted(r[0] for r in rows.select(name).collect())
        # the least value up to which there are k / 64 of all rows
        assert cuts.tolist() == [values[-(-k * n // (1 << bits)) - 1] for k in range(1, 1 << bits)]
    assert [c.tolist() for c in _cuts(rows.limit(1), ["d"], bits)] == [[7] * 63]
    assert [c.tolist() for c in _cuts(rows.limit(0), ["a", "d"], bits)] == [[], []]


def test_files_can_be_skipped(spark, docs, tmp_path):
    rows = corpus(2000)
    sharded = hilbert_shards(docs(rows), shards=8)
    ranges = write_shards(sharded, str(tmp_path / "out")).collect()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000
    assert sum(r.rows for r in ranges) == 2000
    skipped = sum(not (r.lang_min <= "de" <= r.lang_max) for r in ranges)
    skipped += sum(not ((r.source_min or "") <= "s8" <= (r.source_max or "")) for r in ranges)
    assert skipped >= 4


def test_query(spark, tables):
    got = op3_hilbert(spark, tables(corpus())).collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sorted(r.doc_id for r in got) == list(range(500)) and {r.shard for r in got} == set(range(24))
