from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from packmill.llm.common import Scratch

EN = "the and of to in that is was for on with as by at from or an be this have".split()
DE = "der die und das von zu den mit ist des auf für im dem nicht ein eine als auch es".split()
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def test_stages_one_after_the_other(spark, tables):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(EN if k % 2 else DE, 60)), "en" if k % 2 else "de", f"s{k % 3}") for k in range(120)]
    copy = rows[7][1]
    rows += [(200 + k, copy + " end" * k, "en", "s1") for k in range(2)]                  # near copies of 7
    rows += [(300, None), (301, ""), (302, "123 456 --"), (None, rows[11][1], "en", "s2")]
    rows += [(400, f"{copy[::-1]} {ITEM} {rows[9][1]}", "en", "s0")]                       # a benchmark passage
    folder = tables(rows, benchmark=pa.table({"item_id": pa.array([1], pa.int64()), "text": [ITEM]}))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "sharding":
            assert result.columns == docs.columns
        docs = Scratch(spark).table(result)
        kept[name] = [r.doc_id for r in docs.collect()]
    assert set(kept["language"]) == {r[0] for r in rows} - {300, 301, 302}
    assert sorted(kept["near_copies"]) == [*range(120), 400]
    assert sorted(kept["decontamination"]) == list(range(120))
    times = Counter(kept["mixing"])
    assert set(times.values()) <= {1, 2} and len(kept["mixing"]) > 100
    assert Counter(kept["sharding"]) == times
    assert {"shard", "slot", "size"} <= set(docs.columns)


def test_run_and_empty_table(spark, tables):
    folder = tables([], benchmark=pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_near_copies_between_four_fifths_and_nine_tenths(spark, tables):
    rng = np.random.default_rng(2)
    shingles = lambda t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)}
    rows, pairs = [], []
    for k, size in enumerate([60, 150, 400, 900, 2000]):
        words = [f"w{rng.integers(10_000)}" for _ in range(size)]
        for part, low, high in ((20, 0.6, 0.8), (50, 0.8, 0.9)):
            other = list(words)
            for at in range(2, size - 8, part):  # five shingles have each of the changed words
                other[at] = f"x{rng.integers(10_000)}"
            one, two = shingles(" ".join(words)), shingles(" ".join(other))
            share = len(one & two) / len(one | two)
            assert low <= share < high
            rows += [(100 * k + part, " ".join(words)), (100 * k + part + 1, " ".join(other))]
            pairs.append((100 * k + part, share >= 0.8))
            words = [f"w{rng.integers(10_000)}" for _ in range(size)]
    docs = spark.read.parquet(f"{tables(rows)}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, None).collect()}
    assert kept == {a for a, _ in pairs} | {a + 1 for a, near in pairs if not near}


def test_clean_text_in_three_languages_stays(spark):
    spoken = {"en": "the cat and the dog were walking with their owner through the garden of the house ",
              "de": "der hund und die katze gingen mit ihrem besitzer durch den garten hinter dem haus ",
              "es": "el perro y el gato caminaban con sus amigos por las calles de una ciudad vieja "}
    rows = [(k, spoken[lang] * (1 + k % 5), lang) for k, lang in enumerate([*spoken] * 15)]
    rows += [(100, "".join(spoken.values()), None), (101, "12 34 --", "en"), (102, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == set(range(45)) | {100}
