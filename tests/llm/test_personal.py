import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from packmill.llm.boosting import Boosted, calibrated, threshold
from packmill.llm.personal import KINDS, base_spans, find_personal, luhn, op7_boosted_trees, redacted

BASE = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    """The base patterns as they are stated."""
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == 2 and 16 <= len(digits) <= 19 and luhn(digits) or kind == 3 and 8 <= len(digits) <= 15)
            if good:
                out.append((kind, *m.span()))
    return out


ODD = ["a@b.c@d.e", "x@y", "a.b@c..d", "@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4532015112830366 x",
       "4532-0151 1283-0366", "12 4532015112830366", "+1 (555) 010-9999.", "+1 2", "++12345678", "é a@bé.com ü+49 30 1234567",
       "1.2.3", "", "a@b.co" * 3, "9" * 500, "0000.0.0.0", "+12345678 +1234567890123456"]


@pytest.mark.parametrize("text", ODD)
def test_base_patterns(text):
    assert base_spans(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.+- (02é", max_size=40))
def test_base_patterns_on_any_text(text):
    assert base_spans(text) == plain(text)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted().fit(x[:1000], y[:1000])
    margin = model.margin(x[1000:])
    assert np.mean((margin > 0) == y[1000:]) > 0.9
    a, b = calibrated(margin, y[1000:])
    p = 1 / (1 + np.exp(-(a * margin + b)))
    assert abs(p.mean() - y[1000:].mean()) < 0.01
    least = threshold(p, y[1000:], 0.95)
    assert y[1000:][p >= least].mean() >= 0.95


def corpus(n=240):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        area, line = rng.integers(200, 999), rng.integers(1000, 9999)
        digits = "45" + "".join(map(str, rng.integers(0, 10, 13)))
        card = next(digits + c for c in "0123456789" if luhn(digits + c))
        texts = [f"some words call +1 ({area}) 555-{line} now and then", f"write to user.{k}@mail{k % 9}.example.com or not",
                 f"seen at {rng.integers(256)}.{rng.integers(256)}.1.{k % 250} last", f"paid with {card} in full",
                 f"order {line}{area}77 of 2021-03-{10 + k % 20} version 3.{k % 9}.1"]
        rows.append((k, texts[k % 5], "en", "s"))
    return rows


def test_added_spans(docs):
    probes = [(900, "please call (887) 555-1668 now"), (901, "plain words without any"), (902, "in 2021-03-12 at 10"),
              (903, None), (904, ""), (905, "call +1 (555) 555-1234 " * 2000), (906, "x"), (906, "x")]
    got = find_personal(docs(corpus() + probes)).collect()
    assert len(got) == 240 + len(probes)
    for r in got:
        text = r.row.text or ""
        assert [(KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.p is None] == plain(text)
        taken = [(s.start, s.end) for s in r.spans]
        for s in r.spans:
            if s.p is not None:
                assert sum(a < s.end and s.start < b for a, b in taken) == 1 and 0.5 <= s.p <= 1
    by = {r.row.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got}
    assert by[900] == [("phone", 12, 26)]
    assert by[901] == by[902] == by[903] == by[904] == []
    assert len(by[905]) == 2000
    assert find_personal(docs([])).count() == 0


def test_redaction(docs):
    got = {r.row.doc_id: r.redacted for r in redacted(find_personal(docs([(1, "é mail a@b.c and 1.2.3.4 x"), (2, None)]))).collect()}
    assert got == {1: "é mail <email> and <ip> x", 2: ""}


def test_query(spark, tables):
    rows = corpus(100)
    for r in op7_boosted_trees(spark, tables(rows)).collect():
        base = [f"{KINDS[k]}:{s}:{e}" for k, s, e in plain(rows[r.doc_id][1])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(k) for b in base) for k in KINDS)
        assert set(base) <= set(r.spans.split(",")) | {""}
