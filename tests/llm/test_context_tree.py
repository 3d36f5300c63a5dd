import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packmill.llm.context_tree import _GramTable, op6_context_tree, score_texts, text_grams

TEXTS = ["the cat sat on the mat", "The Cat", "on the mat the cat sat", None, "", "ÉÈ été \x00 end", "aaaa aaaa aaaa " * 40,
         "the dog\tsat\non the mat", "zebra quux the", "on the mat the cat sat"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sequence(text, depth):
    raw = b"\xff" * depth + lower(text).encode() + b"\xff"
    return [(raw[i - depth:i], raw[i]) for i in range(depth, len(raw))]


def kt(a, b):
    return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)


class Brute:
    """log P_w of one decision's context tree from its counts per full context."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for t in texts:
            for ctx, byte in sequence(t, depth):
                for node, bit in self.bits(byte):
                    self.counts[node][ctx][bit] += 1

    @staticmethod
    def bits(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def log_w(self, leaves, d):
        a, b = (sum(x[k] for x in leaves.values()) for k in (0, 1))
        if d == self.depth:
            return kt(a, b)
        kids = defaultdict(dict)
        for ctx, x in leaves.items():
            kids[ctx[len(ctx) - d - 1:]][ctx] = x
        below = sum(self.log_w(k, d + 1) for k in kids.values())
        own = kt(a, b)
        return math.log(.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))

    def log10(self, text):
        total = 0.0
        for ctx, byte in sequence(text, self.depth):
            for node, bit in self.bits(byte):
                leaves = {c: list(x) for c, x in self.counts[node].items()}
                before = self.log_w(leaves, 0) if leaves else 0.0
                leaves.setdefault(ctx, [0, 0])[bit] += 1
                total += self.log_w(leaves, 0) - before
        return total / math.log(10)


@pytest.mark.parametrize("limits", [{}, {"frequent_grams": 5, "frequent_words": 2}])
def test_probabilities_and_base(docs, limits):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    got = {r.row.doc_id: r for r in score_texts(docs(rows), F.col("doc_id") < 8, depth=2, **limits).collect()}
    brute = Brute(TEXTS[:8], 2)
    train = Counter(w for t in TEXTS[:8] for w in [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None])
    n, v = sum(train.values()), len(train)
    for k, t in enumerate(TEXTS):
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + .5) / (n + .5 * (v + 1))) for w in tokens))
        if len(t or "") < 100:
            assert r.score == pytest.approx(brute.log10(t), rel=1e-7)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len((t or "").encode()) + 1))


def test_bytes_after_a_context_sum_to_one(docs):
    """The probabilities of all 256 one-byte endings, read off from scores of texts."""
    rows = [(0, "abab abab"), (1, "")]
    probe = [(10 + k, chr(k)) for k in range(128) if not 65 <= k <= 90]
    got = {r.row.doc_id: r.score for r in score_texts(docs(rows + probe), F.col("doc_id") < 2, depth=1).collect()}
    assert 0 < sum(10 ** s for s in got.values()) < 1


def test_table_of_grams():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 5000).astype(np.uint64))
    table = _GramTable(keys[::2], np.arange(len(keys[::2]), dtype=float) + 1)
    scores, missing = table.look_up(keys)
    assert (scores[::2] == np.arange(len(keys[::2])) + 1).all() and missing.tolist() == list(range(1, len(keys), 2))
    assert [len(x) for x in text_grams([b"ab", b""], 3)] == [4, 2]


def test_nothing_to_learn(docs):
    got = score_texts(docs([(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {r.row.doc_id: r.score for r in got} == pytest.approx({1: -24 * math.log10(2), 2: -8 * math.log10(2)})
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert score_texts(docs([])).count() == 0


def test_query_learns(spark, tables):
    text = "regular words in a regular order make a text that can be foretold "
    rows = [(k, text * 3 if k % 10 else "q8#vZ!x0@Lk2$Wp9%" * 8) for k in range(100)]
    got = op6_context_tree(spark, tables(rows)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    assert max(r.bits_per_byte for r in got if r.doc_id % 10) < 1
