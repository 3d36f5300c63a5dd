import base64
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from packmill.llm.secret_scan import _ALPHABETS, BINS, ENCODINGS, KINDS, encoding_of, find_secrets, least_bin, op8_randomness_tests, randomness

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found)


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


RNG = random.Random(3)
SECRETS = [(k, f"é some words {base64.b64encode(RNG.randbytes(30)).decode()} and words", None, None) for k in range(60)]
WRITTEN = [(100 + k, f"see lib{k}SomeVeryLongNameOf{'The' * 3}ThingNumber{k % 7}AndItsSuccessor there", None, None) for k in range(60)]
ODD = [(200, None), (201, ""), (202, "Password : 'abcd1234efgh' TOKEN=short"), (203, f"AKIA{'A1' * 8} {hexes(RNG, 40)} x"),
       (204, f"api-key api_key=\"{hexes(RNG, 32)}\""), (205, "word " * 40_000 + "secret=aaaabbbbcccc"),
       (206, hexes(RNG, 64)), (206, hexes(RNG, 64)), (207, "toKen=12345678 toſen=12345678"), (208, "0" * 3000), (209, "a=b==" * 30)]


def test_against_plain_patterns_and_planted_tokens(docs):
    rows = SECRETS + WRITTEN + [(*r, None, None) for r in ODD]
    got = find_secrets(docs(rows)).collect()
    assert len(got) == len(rows)
    added = {}
    for r in got:
        base = [(s.start, s.kind, s.end) for s in r.base]
        assert base == plain(r.row.text), r.row.doc_id
        spans = [(s.start, s.kind, s.end) for s in r.spans]
        assert spans == sorted(spans) and set(base) <= set(spans)
        added.setdefault(r.row.doc_id, []).extend((r.row.text or "")[a:b] for a, k, b in spans if k == 3)
    assert sum(len(added[k]) for k in range(60)) >= 55
    assert sum(len(added[100 + k]) for k in range(60)) <= 6
    assert not any(added[k] for k in range(200, 210))
    assert find_secrets(docs([])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="tokenTOKEN=: 'aAKI0f9é", max_size=80))
def test_base_patterns_on_any_text(text):
    from packmill.llm.secret_scan import _scan
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"row": [1], "text": [text]})
    [out] = _scan([batch])
    assert [(s["start"], s["kind"], s["end"]) for s in out.column("base").to_pylist()[0]] == plain(text)


@pytest.mark.parametrize("length", [20, 40, 75, 140, 700])
@pytest.mark.parametrize("encoding", ENCODINGS)
def test_p_values_are_even_under_chance(encoding, length):
    rng = np.random.default_rng(length)
    drawn = rng.choice(list(_ALPHABETS[encoding]), (1500, length))
    p = np.array([randomness("".join(x), encoding) for x in drawn])
    for least in (0.02, 0.1, 0.5, 0.9):
        assert np.mean(p <= least) == pytest.approx(least, abs=0.05)
    assert 0 <= p.min() and p.max() <= 1


def test_p_values_of_written_tokens():
    assert randomness("ab" * 20, "hex") < 0.01 and randomness("0123456789abcdef" * 3, "hex") < 0.05


def test_encodings():
    assert encoding_of("deadbeef0123456789ab") == "hex" and encoding_of("thisIsOneWordOfManyLongWords1") == "alnum"
    assert encoding_of("justaverylongplainwordhere") is None and encoding_of("12345678901234567890123") is None
    assert encoding_of("ab+/" * 8 + "1") == "base64" and encoding_of("ABCDEFGH234567ABCDEFGHIJ") == "base32"


def test_threshold_controls_the_rate():
    even = np.full(BINS, 100)
    assert least_bin(even, 0.1) == 1
    mixed = even.copy()
    mixed[:5] += 5000
    k = least_bin(mixed, 0.1)
    assert 5 <= k < BINS and (mixed[k:] - 100).sum() / mixed[k:].sum() <= 0.1
    assert least_bin(np.zeros(BINS, int), 0.1) == BINS
    concentrated = np.zeros(BINS, int)
    concentrated[3] = 1000
    assert least_bin(concentrated, 0.1) == BINS


@pytest.mark.parametrize("written", [60, 250])
def test_realised_share_of_false_discoveries(docs, written):
    rng = random.Random(written)
    drawn = list({base64.b64encode(rng.randbytes(30)).decode() for _ in range(700)})
    drawn = [t for t in drawn if encoding_of(t) == "base64"][:500]
    false = tokens_in_bins(rng, {1: written})[1]
    rows = [(k, f"some {t} words") for k, t in enumerate(drawn)] + [(10_000 + k, f"some {t} words") for k, t in enumerate(false)]
    found = [r.row.doc_id for r in find_secrets(docs(rows), rate=0.1).collect() if r.spans]
    assert sum(k >= 10_000 for k in found) <= 0.13 * len(found)  # the estimate has an error of its own
    assert sum(k < 10_000 for k in found) > 0.9 * len(drawn)


def test_query(spark, tables):
    rows = SECRETS + [(*r, None, None) for r in ODD]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for r in op8_randomness_tests(spark, tables(rows)).collect():
        expected = [plain(t) for t in texts[r.doc_id]]
        assert (r.n_assign, r.n_access, r.n_hex) in [tuple(sum(k == j for _, k, _ in x) for j in range(3)) for x in expected]
        assert r.base_sha256 in [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x).encode()).hexdigest() for x in expected]


def tokens_in_bins(rng, wanted):
    """Tokens of 30 bytes in base 64 by the bin of their p-value, `wanted` (bin: number) of them."""
    found = {k: [] for k in wanted}
    while any(len(found[k]) < n for k, n in wanted.items()):
        token = base64.b64encode(rng.randbytes(30)).decode()
        if encoding_of(token) == "base64":
            k = min(BINS - 1, int(randomness(token, "base64") * BINS))
            if k in found and len(found[k]) < wanted[k]:
                found[k].append(token)
    return found


def test_copies_of_one_secret_are_one_draw(docs):
    rng = random.Random(5)
    found = tokens_in_bins(rng, {k: 3 for k in range(1, BINS) if k % 10 == 5 or k < 3})
    tokens = [t for k in sorted(found) for t in found[k]]
    rows = [(k, f"some words {t} here") for k, t in enumerate(tokens)]
    chosen = lambda rs: {r.row.doc_id: len(r.spans) for r in find_secrets(docs(rs)).collect()}
    once = chosen(rows)
    assert sum(once.values()) > len(rows) / 2
    copied = found[15][0]
    more = chosen(rows + [(1000 + k, f"copy {k}: {copied} here") for k in range(300)])
    # a group of copies moves nobody's threshold, and each copy gets what its token gets
    assert {k: n for k, n in more.items() if k < 1000} == once
    assert {n for k, n in more.items() if k >= 1000} == {once[tokens.index(copied)]}
