import os
import random

import pytest

from packmill.llm.decontaminate import find_contamination, op9_wu_manber


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) >= 128 or c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in low).split(" ")


def brute(text, items, width):
    """(n_words, n_hit, items) by looking for every window of every item at every word."""
    own = [w for w in words(text) if w]
    hit, found = set(), set()
    for name, body in items:
        theirs = [w for w in words(body) if w]
        size = min(width, len(theirs))
        for k in range(len(theirs) - size + 1 if size else 0):
            for at in range(len(own) - size + 1):
                if own[at:at + size] == theirs[k:k + size]:
                    hit.update(range(at, at + size))
                    if name is not None:
                        found.add(str(name))
    return len(own), len(hit), sorted(found)


def corpus(seed, n_docs=40, n_items=12, vocabulary=6):
    """Texts of few different words, so that windows overlap, repeat and nearly match."""
    rng = random.Random(seed)
    made = lambda n: " ".join(rng.choice("ABCDEFghijkl"[:vocabulary * 2:2]) for _ in range(n))
    items = [(k, made(rng.randint(0, 9))) for k in range(n_items)] + [(None, made(5)), (3, made(4)), (50, None), (51, "")]
    docs = [(k, made(rng.randint(0, 60))) for k in range(n_docs)]
    for k in range(0, n_docs, 5):
        body = rng.choice(items)[1] or ""
        docs.append((1000 + k, made(7) + ", " + body.replace(" ", " -- ") + "!\n" + made(3)))
    return docs + docs[:3] + [(None, made(20)), (2000, None), (2001, ""), (2002, "?!"), (2003, "é ñ a " * 3)], items


def result(docs, rows, items, **options):
    frame = docs(rows)
    bench = frame.sparkSession.createDataFrame(items, "item_id long, text string")
    found = find_contamination(frame, bench, **options)
    return sorted(((r.row.doc_id, r.row.text, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, matcher_words", [(1, 1_000_000), (2, 1_000_000), (3, 40), (4, 15)])
def test_every_window_in_one_pass_and_in_many(docs, seed, matcher_words):
    rows, items = corpus(seed)
    got = result(docs, rows, items, width=4, matcher_words=matcher_words)
    expected = []
    for doc_id, text in rows:
        n, hit, names = brute(text, items, 4)
        expected.append((doc_id, text, n, hit, tuple(names)))
    assert got == sorted(expected, key=str)
    assert any(len(r[4]) > 2 for r in got)


def test_passes_leave_no_whole_rows_behind(docs, tmp_path):
    frame = docs([(k, f"needle in the hay {k} " + "straw " * 400) for k in range(50)])
    spark = frame.sparkSession
    bench = spark.createDataFrame([(k, f"needle in the hay {k}") for k in range(50)], "item_id long, text string")
    seen = find_contamination(frame, bench, width=5, matcher_words=60)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    tables = [p for p in seen.inputFiles() if "scratch-" in p]
    size = sum(os.path.getsize(p.removeprefix("file:").replace("///", "/")) for p in tables)
    assert "Join LeftOuter" in plan and 0 < size < 20_000
    assert [(r.n_hit, r["items"]) for r in seen.orderBy("row.doc_id").collect()] == [(5, [str(k)]) for k in range(50)]


def test_very_long_text_over_lanes(docs):
    passage = " ".join(f"p{k}" for k in range(12))
    filler = " ".join(f"f{k % 977}" for k in range(200_000))
    rows = [(1, f"{filler} {passage} {filler} {passage}"), (2, filler), (3, passage[:-3])]
    got = result(docs, rows, [(7, passage)])
    assert [r[2:] for r in got] == [(400_024, 24, ("7",)), (200_000, 0, ()), (11, 11, ("7",))]


def test_empty_tables(docs):
    frame = docs([(1, "some words of a text"), (2, None)])
    nothing = frame.sparkSession.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in find_contamination(frame, nothing).orderBy("row.doc_id").collect()] == [
        (5, 0, []), (0, 0, [])]
    some = frame.sparkSession.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_contamination(docs([]), some).count() == 0


def test_query_returns_one_row_per_document(spark):
    folder = "/root/testdata/sf0.001"
    found = op9_wu_manber(spark, folder)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found.where("contaminated <> (n_items > 0)").count() == 0
