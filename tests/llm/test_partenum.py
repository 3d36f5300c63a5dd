import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from packmill.llm import common
from packmill.llm.common import SHUFFLE_CLEANUP, TIDY, Scratch, map_batches, tokens_of
from packmill.llm.components import components
from packmill.llm import partenum
from packmill.llm.partenum import _bitmap, _marked, drop_near_copies, join_shingles, op10_partenum, signatures, size_bands, sketch


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def shingles(text):
    w = tokens(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)])


def brute(rows):
    """(n_shingles, component_id) per row, by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def edited(words, rng, n):
    words = list(words)
    for k in rng.integers(0, len(words), n):
        words[k] = f"e{rng.integers(1 << 30)}"
    return words


def family(seed=1, sizes=(12, 30, 80, 300, 900), copies=25):
    """Copies of copies with edits around the threshold, so that links form chains and trees."""
    rng = np.random.default_rng(seed)
    texts = []
    for size in sizes:
        made = [[f"w{rng.integers(400)}" for _ in range(size)]]
        for _ in range(copies):
            base = made[rng.integers(len(made))]
            made.append(edited(base, rng, int(rng.integers(0, max(2, size // 40)))))
        texts += [" ".join(m) for m in made]
    order = rng.permutation(len(texts))
    return [(int(k), texts[i]) for k, i in enumerate(order)]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 900), st.integers(0, 2**31), st.booleans())
def test_sets_close_enough_share_a_signature(size, seed, swap):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    removed = rng.integers(0, len(a) // 10 + 1)
    b = np.delete(a, rng.choice(len(a), removed, replace=False))
    room = len(b) * 10 // 9 - len(a)
    if room > 0:
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, rng.integers(0, room + 1)).astype(np.uint64)]))
    same = len(np.intersect1d(a, b))
    apart = len(a) + len(b) - 2 * same
    x, y = sketch(a), sketch(b)
    assert sum(bin(int(p) & (2**64 - 1)).count("1") for p in x ^ y) <= apart
    if apart and 100 * same >= 90 * (len(a) + len(b) - same):
        one, two = (set(signatures(s, size_bands(len(s))).tolist()) for s in (a, b))
        assert one & two


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(docs, seed):
    rows = family(seed)
    found = join_shingles(docs(rows)).collect()
    got = {r.row.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert all(r.keep == (r.row.doc_id == r.component_id) for r in found)
    assert got == {r[0]: e for r, e in zip(rows, brute(rows), strict=True)}
    assert 1 < len({c for _, c in got.values()}) < len(rows)


def test_odd_rows(docs):
    rows = [(5, None), (4, ""), (4, " \t"), (3, "one"), (2, "ONE"), (None, "One"), (None, "alone here"), (8, "x y"),
            (9, "long words " * 30_000), (7, "long words " * 20_000), (1, "É a b"), (0, "é a b"), (6, "a\x00b c\x0bd")]
    rows += [(20, "one two three four five six seven eight nine ten eleven twelve thirteen")] * 50
    found = join_shingles(docs(rows)).collect()
    assert sum(r.keep for r in found if r.row.doc_id == 20) == 1 and all(r.keep for r in found if not r.n_shingles)
    got = [(r.row.doc_id, r.n_shingles, r.component_id) for r in found]
    assert sorted(got, key=repr) == sorted([(r[0], *e) for r, e in zip(rows, brute(rows), strict=True)], key=repr)
    assert join_shingles(docs([])).count() == 0


def test_bitmap_marks_all_its_keys(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-2**63, 2**63 - 1, 3000)
    bits = _bitmap(spark.createDataFrame([(int(k),) for k in keys[:1000]], "k long"), "k")
    found = _marked(bits, keys)
    assert found[:1000].all() and found[1000:].sum() < 5
    assert not _marked(_bitmap(spark.createDataFrame([], "k long"), "k"), keys).any()


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(0)
    path = rng.permutation(300).tolist()
    edges = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + k) for k in range(1, 500)] + [(2000, 2001), (2001, 2000)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    got = {r.node: r.root for r in found}
    assert got == {**{k: 0 for k in range(1, 300)}, **{1000 + k: 1000 for k in range(1, 500)}, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_query(spark, tables):
    rows = family(3, sizes=(40,), copies=10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_partenum(spark, tables(rows)).collect()}
    assert got == {r[0]: e for r, e in zip(rows, brute(rows), strict=True)}


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 900), st.integers(0, 2**31), st.sampled_from([50, 80, 95]))
def test_sets_share_a_signature_at_any_threshold(size, seed, percent):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    b = np.delete(a, rng.choice(len(a), rng.integers(0, len(a) * (100 - percent) // 100 + 1), replace=False))
    room = len(b) * 100 // percent - len(a)
    if room > 0:
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, rng.integers(0, room + 1)).astype(np.uint64)]))
    same = len(np.intersect1d(a, b))
    if len(a) + len(b) > 2 * same and 100 * same >= percent * (len(a) + len(b) - same):
        one, two = (set(signatures(s, size_bands(len(s), percent), percent).tolist()) for s in (a, b))
        assert one & two


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("size", [60, 250, 600, 900])
def test_unrelated_sets_share_no_signature(size, percent):
    rng = np.random.default_rng(size)
    seen, pairs = {}, 0
    for k in range(300):
        features = np.unique(rng.integers(0, 2**63, size + k % 20).astype(np.uint64))
        for sign in set(signatures(features, size_bands(len(features), percent), percent).tolist()):
            pairs += seen.get(sign, 0)
            seen[sign] = seen.get(sign, 0) + 1
    # of 44,850 pairs, at most one in a thousand; small sets may need the parts that hold none of their features
    assert pairs <= (300 if size == 60 else 44)


def links(rows, percent=90):
    sets = [shingles(r[1]) for r in rows]
    return [sum(k != j and bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets))
            for k, a in enumerate(sets)]


@pytest.mark.parametrize("chunk, few", [(512, 2000), (6, 2000), (6, 0)])
def test_number_of_links(docs, monkeypatch, chunk, few):
    monkeypatch.setattr(partenum, "CHUNK", chunk)
    monkeypatch.setattr(partenum, "FEW_PAIRS", few)
    rows = family(5, sizes=(30, 80, 300))
    rows += [(1000 + k, rows[3][1]) for k in range(30)] + [(2000, None), (2001, " ")]
    got = {r.row.doc_id: r.n_links for r in join_shingles(docs(rows)).collect()}
    assert got == {r[0]: n for r, n in zip(rows, links(rows), strict=True)} and max(got.values()) > 30


def test_one_document_of_each_component_stays(docs):
    rows = family(6, sizes=(30, 200)) + [(2000, None), (2000, None), (2001, ""), (None, None)]
    rows += [(rows[0][0], rows[0][1])] * 3 + [(None, rows[1][1])]
    given = docs(rows)
    kept = drop_near_copies(given)
    assert kept.columns == given.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == sorted((r.row.doc_id for r in join_shingles(given).where("keep").collect()), key=repr)
    assert drop_near_copies(docs([])).count() == 0


def test_no_key_of_a_star_fills_a_task(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(3000 + 2 * k, 3001 + 2 * k) for k in range(1000)]
    plan = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    assert {(r.node, r.root) for r in plan.collect()} == {(b, a) for a, b in edges}


def test_python_workers_get_long_rows_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = {key: spark.conf.get(key, None) for key in TIDY}
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "sequence(id, id + 499) AS signs").union(
        spark.range(0, 2, 1, 1).selectExpr("id", "sequence(id, id + 299999) AS signs"))
    found = Scratch(spark, tidy=True).table(map_batches(rows, sizes, "n long, size long")).collect()
    assert sum(r.n for r in found) == 3002  # a row beyond the bound comes as well
    # by its last row alone a batch may go beyond it
    assert len(found) >= 12 and sorted(r.size for r in found)[-3] < 2 << 20
    assert {key: spark.conf.get(key, None) for key in TIDY} == before


@pytest.mark.parametrize("many, width", [(1, 4), (50, 8), (2_000_000, 4)])
def test_packed_signatures_come_back(many, width):
    rng = np.random.default_rng(many)
    signs = rng.integers(0, 1 << partenum.SIGN_BITS, many).astype(np.uint64)
    signs[-1] = (1 << partenum.SIGN_BITS) - 1
    owners = rng.integers(0, min(many, 1 << 16), many)
    for cells in (1, 7, 408):
        parts = []
        for cell, *pack in partenum._packed(signs, owners, cells):
            parts.append(partenum._unpacked(*pack))
            assert len(parts[-1][0]) and (partenum._cells(parts[-1][0], cells) == cell).all()
            assert len(pack[1]) == (4 if len(parts[-1][0]) == 1 else width) * len(parts[-1][0])
        got, wanted = [np.concatenate(x) for x in zip(*parts, strict=True)], [signs, owners]
        assert all((a[np.lexsort(got)] == b[np.lexsort(wanted)]).all() for a, b in zip(got, wanted, strict=True))
    assert partenum._packed(signs[:0], owners[:0], 7) == []


@pytest.mark.parametrize("compared", [1 << 21, 40])
def test_signatures_of_marked_rows_that_share_them(monkeypatch, compared):
    monkeypatch.setattr(partenum, "COMPARED", compared)
    rng, cells, rows, wanted = np.random.default_rng(compared), 6, [], {}
    numbers = (3 << 33) + np.arange(60)
    rids = partenum._rids(numbers).tolist()
    assert len(set(rids)) == 60
    bits = np.zeros(partenum.MARKS // 64, np.int64)
    for rid in rids[:45]:
        place = rid % partenum.MARKS
        bits[place // 64] |= np.int64(np.uint64(1 << place % 64).astype(np.int64))
    every = rng.integers(0, 1 << partenum.SIGN_BITS, 700).astype(np.uint64)
    for start in (0, 20, 40):
        owners = np.repeat(np.arange(20), 30)
        signs = rng.choice(every, 600)
        rows += [(cell, int(numbers[start]), *pack) for cell, *pack in partenum._packed(signs, owners, cells)]
        for owner, sign in zip(owners.tolist(), signs.tolist(), strict=True):
            if start + owner < 45:
                wanted.setdefault(sign, []).append((rids[start + owner], sign))
    batch = pa.RecordBatch.from_pylist([dict(zip(("cell", "base", "least", "gaps", "owners"), r, strict=True)) for r in sorted(rows)])
    parts = [batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)]
    found = [tuple(r.values()) for b in partenum._sharing(SimpleNamespace(value=bits), cells)(parts) for r in b.to_pylist()]
    assert sorted(found) == sorted(x for own in wanted.values() if len(own) > 1 for x in own) and found


def test_full_bitmaps_cost_no_room_by_signature(spark, docs, monkeypatch):
    """On a large input every bit is set.  What is shuffled at once to find rows that share signatures stays a small part of them."""
    def shuffled():
        folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for top in folders for d, _, names in os.walk(top)
                for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    def table(self, df, *folders):
        before = shuffled()
        made = written(self, df, *folders)
        steps.append((df.columns, sum(size for name, size in shuffled().items() if name not in before)))
        return made

    rng, steps, written = np.random.default_rng(8), [], Scratch.table
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 5000, 800))) for k in range(200)]
    rows += [(500 + k, rows[k][1] + " end") for k in range(20)]
    size = sum(len(signatures(s, size_bands(len(s), 80), 80)) for s in (
        partenum.shingle_set(tokens_of(t.encode()), partenum._WordHashes(), 5) for _, t in rows))
    given = docs(rows).localCheckpoint()
    # shuffles stay to be counted; no table counts as small
    monkeypatch.setattr(common, "TIDY", {**TIDY, SHUFFLE_CLEANUP: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    monkeypatch.setattr(partenum, "_bitmap", lambda keys, key: np.full(partenum.MARKS // 64, -1, np.int64))
    monkeypatch.setattr(partenum, "AT_ONCE", 0, raising=False)
    monkeypatch.setattr(Scratch, "table", table)
    assert {r.doc_id for r in drop_near_copies(given, width=5, percent=80).collect()} == set(range(200))
    found = [n for columns, n in steps if columns == ["rid", "sign"]]
    assert found and max(found) < 3 * size, (found, size)  # bytes a signature


def test_rows_equal_in_id_and_text_leave_one(docs):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en"), (1, text, "de"), (1, text, None), (2, text, "en"), (None, "x y z"), (None, "x y z", "en"), (None, "x y z"),
            (3, " "), (3, " "), (4, None), (4, None), (5, "x y q")]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in drop_near_copies(docs(rows)).collect())
    assert got == [(False, 1), (False, 3), (False, 3), (False, 4), (False, 4), (False, 5), (True, 0)]
