import itertools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import packmill.llm.language
from packmill.llm.language import MOST_LANGUAGES, Field, Labeller, Tally, fit, identify_language, learned, op1_crf

SF = "/root/testdata/sf0.001"
EN = "the cat and the dog were walking with their owner through the garden of the house "
DE = "der hund und die katze gingen mit ihrem besitzer durch den garten hinter dem haus "
ROWS = [(k, (EN if k % 2 else DE) * (1 + k % 5), "en" if k % 2 else "de") for k in range(40)]


def chains(seed=0, sizes=(6, 1, 200, 64, 65, 129)):
    rng = np.random.default_rng(seed)
    field = Field(["a", "b", "c"], {})
    field.trans = rng.normal(size=(3, 3))
    return Labeller(field), [np.exp(rng.normal(size=(n, 3))) for n in sizes]


def joined(labeller, parts):
    out = np.empty((sum(map(len, parts)), 3))
    for base, part in labeller.posteriors(parts):
        out[base:base + len(part)] = part
    return out


def test_posteriors_of_all_paths():
    labeller, (short, *_) = chains()
    weight = np.zeros((6, 3))
    for path in itertools.product(range(3), repeat=6):
        p = np.mean(labeller.trans[:, path[0]]) * 0 + labeller.trans[:, path[0]].sum()
        for k, s in enumerate(path):
            p *= short[k, s] * (labeller.trans[path[k - 1], s] if k else 1)
        for k, s in enumerate(path):
            weight[k, s] += p
    assert joined(labeller, [short]) == pytest.approx(weight / weight.sum(axis=1, keepdims=True))


def test_blocks_equal_one_pass():
    labeller, parts = chains()
    expected = []
    for e in parts:
        alpha, now = [], np.full(3, 1 / 3)
        for row in e:
            now = (now @ labeller.trans) * row
            alpha.append(now := now / now.sum())
        beta, own = np.ones(3), []
        for k in range(len(e) - 1, -1, -1):
            both = alpha[k] * beta
            own.append(both / both.sum())
            beta = labeller.trans @ (e[k] * beta)
            beta /= beta.sum()
        expected += own[::-1]
    assert joined(labeller, parts) == pytest.approx(np.array(expected))


def test_code_switched_text_and_learned_transitions():
    field = fit([(t, lang) for _, t, lang in ROWS])
    assert (np.diag(field.trans) > field.trans[[0, 1], [1, 0]]).all()
    text = (EN * 3 + DE * 2).encode()
    [(lang, score, runs, sure)] = Labeller(field).label([text], True)
    assert lang == "en" and 0.5 < score < 0.7
    assert [r[0] for r in runs] == ["en", "de"] and sum(r[2] for r in runs) == len(text.split())
    assert sure > 0.95  # each word is labelled surely, though no language has all of them


def test_odd_rows(docs):
    odd = [(100, None), (101, ""), (102, "123 -- !?"), (103, "—…«»"), (104, DE * 3000), (105, EN), (105, EN), (None, DE)]
    got = identify_language(docs(ROWS + odd)).collect()
    by = {}
    for r in got:
        by.setdefault(r.row.doc_id, []).append((r.lang_pred, r.score, len(r.runs)))
    for k in (100, 101, 102, 103):
        assert by[k] == [("und", 0.0, 0)]
    assert by[104][0][0] == "de" and by[104][0][1] > 0.9 and len(by[105]) == 2 and by[None][0][0] == "de"
    assert identify_language(docs([])).count() == 0
    assert {r.lang_pred for r in identify_language(docs([(1, EN), (2, None)])).collect()} == {"und"}


def test_all_rows_and_whole_texts_teach(docs):
    signs = [chr(0x4E00 + k) for k in range(4000)]  # no two texts share any; nothing but a text itself teaches its own
    rows = [(k, f"{c} {c}{c} {c}{c}{c}", "ab"[k % 2]) for k, c in enumerate(signs[:1200])]
    rows.append((1200, " ".join(c * 9 for c in signs[1200:]), "c"))  # 28,000 characters
    more = [(2000 + k, f"{c} {c}{c}", None) for k, c in enumerate(signs[1200:])]
    got = {r.row.doc_id: r.lang_pred for r in identify_language(docs(rows + more)).collect()}
    assert [k for k, _, lang in rows if got[k] != lang] == []
    assert [k for k, *_ in more if got[k] != "c"] == []


def test_gradient_in_tasks_and_on_the_driver(docs):
    from pyspark.sql import functions as F
    rows = [*ROWS, (50, DE * 3, "en"), (51, "日本 — 日本 ΟΔΟΣ", "ja"), (52, "123 —", "none"), (53, None, "de")]
    here = fit([(t, lang) for _, t, lang in rows if t], iterations=4)
    assert here.labels == ["de", "en", "ja"]
    table = docs(rows).repartition(3)
    for most in (0, 1000):
        field = learned(table, F.lit(True), "text", "lang", iterations=4, driver_words=most)
        assert field.labels == here.labels and field.lexicon == here.lexicon
        assert field.trans == pytest.approx(here.trans)
        assert abs(field.weights - here.weights).max() < 1e-6 and abs(field.weights).max() > 0.3
    # in two batches of words, all have turns: weights of features in either are other than before
    field = learned(table, F.lit(True), "text", "lang", iterations=4, driver_words=0, batch_words=10)
    assert ((field.weights != 0) == (here.weights != 0)).all() and abs(field.weights - here.weights).max() > 0.01
    found = Labeller(field).label([t.encode() for _, t, _ in ROWS], False)
    assert [x[0] for x in found] == [lang for *_, lang in ROWS]


def test_tallies_are_handed_on(monkeypatch):
    monkeypatch.setattr(packmill.llm.language, "TALLY_ENTRIES", 3)
    texts = [EN, "One two ONE 1 —", "two", "", "— 5"]
    batches = [pa.record_batch([pa.array(["x"]), pa.array([t])], names=["lang", "text"]) for t in texts]
    parts = [b.to_pylist() for b in packmill.llm.language._tallied(batches)]
    assert len(parts) > 2
    found = Counter()
    for r in itertools.chain(*parts):
        found[r["word"]] += r["n"]
    # the sign alone has no letter, yet its text is counted
    assert found == Counter(EN.split()) + Counter({"one": 2, "two": 2, "": 4})
    tally = Tally()
    assert tally.taken() == [] and not tally.full()


def test_more_labels_than_are_learned(docs):
    rows = [(1000 + k, f"word{k} only{k} here{k}", f"label{k:03}") for k in range(500)]
    got = identify_language(docs(ROWS + rows)).select("row.doc_id", "lang_pred").collect()
    learned = {"en", "de"} | {f"label{k:03}" for k in range(MOST_LANGUAGES - 2)}
    assert len(got) == 540 and {r.lang_pred for r in got} <= learned
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id < 40)


def test_many_labels_in_larger_blocks():
    n, rng = 40, np.random.default_rng(3)
    field = Field([str(k) for k in range(n)], {})
    field.trans = rng.normal(size=(n, n))
    labeller, e = Labeller(field), np.exp(rng.normal(size=(1000, n)))
    [(base, first), *rest] = labeller.posteriors([e])
    got = np.concatenate([first, *(part for _, part in rest)])
    alpha, now = [], np.full(n, 1 / n)
    for row in e:
        now = (now @ labeller.trans) * row
        alpha.append(now := now / now.sum())
    beta, own = np.ones(n), []
    for k in range(len(e) - 1, -1, -1):
        own.append(alpha[k] * beta / (alpha[k] @ beta))
        beta = labeller.trans @ (e[k] * beta)
        beta /= beta.sum()
    assert base == 0 and got == pytest.approx(np.array(own[::-1]))


def test_prediction_ignores_other_columns(docs):
    train = "doc_id < 40"
    from pyspark.sql import functions as F
    a = identify_language(docs([*ROWS, (50, EN, "de", "x"), (51, EN, None, None)]), F.expr(train)).collect()
    seen = {r.row.doc_id: (r.lang_pred, r.score) for r in a}
    assert seen[50] == seen[51]


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op1_crf(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95


@pytest.mark.parametrize("within", ["text", None])
def test_predictions_come_in_small_batches(monkeypatch, within):
    monkeypatch.setattr(packmill.llm.language, "BATCH_BYTES", 64)
    field = fit([(text, lang) for _, text, lang in ROWS], 3)
    texts = [None, "", EN, "x" * 500, None, DE, "?", EN] * 3
    row = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)))], ["text", "k"])
    given = pa.RecordBatch.from_arrays([row] if within else [row, pa.array(texts, pa.string())], ["row", "text"][:1 if within else 2])
    shared = type("Shared", (), {"value": field})
    got = list(packmill.llm.language._predict(shared, False, within)([given]))
    assert len(got) > 6 and pa.Table.from_batches(got).column("row").combine_chunks().to_pylist() == row.to_pylist()
    found = [(r["lang_pred"], r["score"], r["certainty"]) for b in got for r in b.to_pylist()]
    alone = [Labeller(field).label([t and t.encode()], False)[0] for t in texts]
    assert [f[0] for f in found] == [a[0] for a in alone]
    assert np.allclose([f[1:] for f in found], [(a[1], a[3]) for a in alone])
