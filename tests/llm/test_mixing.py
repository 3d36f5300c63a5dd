import math
import re
from collections import defaultdict

import numpy as np
import pytest

from packmill.llm.mixing import mix_sources, op4_entropy_balancing


def reshared(sizes):
    """Targets by repeating the rule: shares by weight, stop at the cap, hand out the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


@pytest.fixture()
def corpus():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        source = None if k % 37 == 0 else "hot" if k % 3 == 0 else f"s{k % 8}"
        rows.append((k, " ".join(["w"] * int(rng.geometric(0.02))), "en", source))
    return rows


def test_targets_rates_and_totals(spark, docs, corpus):
    got = mix_sources(docs(corpus)).select("row.doc_id", "row.source", "size", "source_size", "target", "rate",
                                           "copies", "taken").collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    sizes = defaultdict(int)
    for _, text, _, source in corpus:
        sizes[source] += len(text.split())
    expected = reshared(sizes)
    taken, weighed = defaultdict(int), defaultdict(float)
    lam = defaultdict(set)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source], rel=1e-9)
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size and abs(r.copies - r.rate) <= 1
        taken[r.source] += r.taken
        weighed[r.source] += r.rate * r.size
        if r.rate < 2:
            lam[r.source].add(round(math.log(r.rate) / r.size, 9))
    for source, target in expected.items():
        assert weighed[source] == pytest.approx(target, rel=1e-5)       # the constraint of the dual
        assert len(lam[source]) <= 1                                    # one multiplier per source
        assert abs(taken[source] - target) <= max(r.size for r in got)  # within one document
    again = {r.row.doc_id: r.taken for r in mix_sources(docs(corpus[::-1])).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_capped_source_takes_all_twice(docs):
    rows = [(1, "a b c", None, "a"), (2, "d " * 400, None, "b"), (3, "e " * 300, None, "c"), (4, "f", None, "d")]
    got = {r.row.doc_id: r for r in mix_sources(docs(rows)).collect()}
    assert got[1].target == 6 and got[1].taken == 6
    assert got[4].target == 2 and got[4].taken == 2


def test_odd_rows(docs):
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "a b", None, "x"), (3, "a b", None, "x"), (4, "é\x00ü z", None, ""),
            (5, "long " * 50_000, None, "x")]
    got = mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.row.text or ""))
        assert r.taken <= 2 * r.size
        if not r.size:
            assert r.copies == 1 and r.taken == 0
    assert len({r.taken for r in got if r.row.doc_id == 3}) == 1
    assert mix_sources(docs([])).count() == 0
    assert [r.target for r in mix_sources(docs([(1, None), (2, "", None, "q")])).collect()] == [0.0, 0.0]


def test_query(spark, tables, corpus):
    got = op4_entropy_balancing(spark, tables(corpus)).collect()
    assert len(got) == 600 and {"doc_id", "size", "source_size", "target", "taken"} <= set(got[0].asDict())
