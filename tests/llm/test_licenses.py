import re

import duckdb
import pytest

from packmill.llm.licenses import OP2_SQL, TEMPLATES, THRESHOLD, find_licenses, op2_prefix_filter

ROWS = [
    (1, "Released under the MIT License."), (2, "mit license mit license, Apache\n\nLICENSE general public license"),
    (3, None), (4, ""), (5, "İ MIT\tLicense ÉMIT License"), (None, "the mit licenses"), (7, "no notice at all"),
    (8, "Licensed under the Apache License, version two 0"), (8, "Licensed under the Apache License, version two 0"),
    (9, "word " * 30_000 + "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and documentation files"),
    (10, "licensed\nunder the apache license version 2 0"), (11, "0 2 version license apache the under licensed x y"),
]


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    w = words(lower)
    places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"),
                                               ("general public license", "gpl"))
              for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    base = {label for _, label in places}
    best, labels = 0.0, set(base)
    for line in lower.split("\n"):
        for label, t in TEMPLATES.items():
            share = len(set(words(line)) & set(t.split())) / len(set(t.split()))
            if share >= THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), best)


def fields(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


def test_against_brute_force(docs):
    got = find_licenses(docs(ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert fields(r) == pytest.approx(brute(r.row.text)), r.row.doc_id
    assert {r.labels for r in got if r.row.doc_id == 1} == {"mit,mit-release"}


def test_query_equals_sql_and_keeps_empty_tables(spark, tables):
    grant = TEMPLATES["mit-grant"]
    folder = tables(ROWS + [(12, wrapped(grant.split(), 5, "#") + " tail" * 99), (13, grant.replace(" ", " and so on and on "))])
    got = sorted(op2_prefix_filter(spark, folder).collect(), key=repr)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = [c for c in got[0].asDict()]
    expected = sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(names)} FROM ({OP2_SQL})").fetchall()), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == expected
    labels = {r.doc_id: r.labels for r in got}
    assert labels[10] == "apache,apache-2.0" and labels[12] == "mit-grant" and labels[13] == ""


def test_empty_table(docs):
    assert find_licenses(docs([])).count() == 0


def wrapped(words, width, mark):
    return "\n".join(f"{mark} " + " ".join(words[k:k + width]) for k in range(0, len(words), width))


def by_windows(text):
    """Labels and best share by the windows as stated, without any filter."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    best, labels = 0.0, set()
    for label, t in TEMPLATES.items():
        t = t.split()
        step = (len(t) + 1) // 2
        for k in range(0, max(len(w) - 2 * len(t), 0) + step, step):
            share = len(set(w[k:k + 2 * len(t)]) & set(t)) / len(set(t))
            if share >= THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
    return labels, best


def test_windows_find_wrapped_notices_and_no_scattered_words(spark, docs, tables):
    rows = []
    for k, (label, words) in enumerate(TEMPLATES.items()):
        for lead in (0, 1, 7, 40, 900):
            rows.append((1000 * k + lead, "word " * lead + wrapped(words.split(), 4, " *") + "\n * and more" * 9))
        rows.append((1000 * k + 1, " ".join(f"{w} " + "other " * 60 for w in words.split())))
    rows += [(None, None), (-1, "")]
    labels = list(TEMPLATES)
    for r in find_licenses(docs(rows), windows=True).collect():
        found, best = by_windows(r.row.text)
        assert set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")) == found - set(r.base_labels.split(","))
        assert r.score == pytest.approx(best)
        if r.row.text and "other" in r.row.text:
            assert r.score == 0
        elif r.row.text:
            assert labels[r.row.doc_id // 1000] in r.labels.split(",") and r.score == 1
    assert op2_prefix_filter(spark, tables(rows)).count() == len(rows)
    assert find_licenses(docs([]), windows=True).count() == 0
