"""Secrets: base patterns, and tokens that pass a battery of randomness tests.

A token of at least 20 key characters is read in the encoding it fits (hex, base 32,
alphanumeric, base 64).  Under the hypothesis that its characters are drawn at random, a
chi-squared test of the alphabet's uniformity, a runs test about the middle of the alphabet
and a test of the serial correlation give p-values; the place of the least among those of drawn tokens counts.
Random tokens have p-values spread evenly, written ones p-values near zero.  Per encoding
and class of length, the distinct tokens of the whole corpus are counted by p-value (copies
of one token are one draw), the share of random ones is estimated from the larger p-values, and
the least threshold is taken from which on the expected share of false discoveries stays
below the wanted rate.  All occurrences of a token then meet the threshold.
"""

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from packmill.llm.common import Scratch, bundled, extended, map_batches

KINDS = ("assign", "access", "hex", "random")
FALSE_RATE = 0.1
BINS = 50
LEAST_LENGTH = 20
# tokens drawn for each encoding and length, and the greatest such length
DRAWS, LONGEST_DRAWN = 2000, 512
LENGTHS = (24, 32, 48)
ENCODINGS = ("hex", "base32", "alnum", "base64")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]++")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}+={0,2}" % LEAST_LENGTH)
_KEY_BYTES = bytes(b if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else 32 for b in range(256))

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "alnum": _DIGITS + _UPPER + _LOWER,
              "base64": _UPPER + _LOWER + _DIGITS + "+/"}
_PLACES = {name: {c: k for k, c in enumerate(letters)} for name, letters in _ALPHABETS.items()}


def encoding_of(token: str) -> str | None:
    """The narrowest encoding the token fits; None for what no encoder writes: words, numbers, rules."""
    token = token.rstrip("=")
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    if not letters or len(token) < LEAST_LENGTH:
        return None
    switches = sum(a.islower() != b.islower() for a, b in zip(token, token[1:], strict=False) if a.isalpha() and b.isalpha())
    if not digits and switches < 4:
        return None  # letters of one case, or capitalised words
    for fold in (token, token.lower()):
        if all(c in _PLACES["hex"] for c in fold):
            return "hex"
    for name in ("base32", "alnum"):
        if all(c in _PLACES[name] for c in token):
            return name
    return "base64"


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _upper_tail(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2)).astype(np.float64)


def battery(places: np.ndarray, k: int) -> np.ndarray:
    """The least p-value of the three tests, for each row of places in an alphabet of `k` letters."""
    rows, n = places.shape
    counts = np.bincount((places + k * np.arange(rows)[:, None]).ravel(), minlength=rows * k).reshape(rows, k)
    # Pearson's statistic with its exact mean and variance for n draws, as cells are few per letter
    chi = (counts ** 2).sum(axis=1) * k / n - n
    uniform = _upper_tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    above = places >= k / 2
    high = above.sum(axis=1)
    mean = 2 * high * (n - high) / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    seen = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    runs = np.where((high > 0) & (high < n), 2 * _upper_tail(np.abs(seen - mean) / spread), 2.0 ** (1 - n))
    centred = places - places.mean(axis=1, keepdims=True)
    total = (centred ** 2).sum(axis=1)
    product = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.where(total > 0, total, 1)
    serial = np.where(total > 0, 2 * _upper_tail(np.abs(product * math.sqrt(n) + 1 / math.sqrt(n))), 0.0)
    return np.minimum(np.minimum(uniform, runs), serial)


def _drawn_length(n: int) -> int:
    """The length at which tokens of `n` characters are drawn: every one up to 128, then every 16th up to LONGEST_DRAWN."""
    return n if n <= 128 else min(n // 16 * 16, LONGEST_DRAWN)


@lru_cache(maxsize=1024)
def _under_chance(encoding: str, n: int) -> np.ndarray:
    """What the battery gives for DRAWS tokens of `n` random characters, in order."""
    k = len(_ALPHABETS[encoding])
    draws = np.random.default_rng([ENCODINGS.index(encoding), n]).integers(0, k, (DRAWS, n))
    return np.sort(battery(draws, k))


def randomness(token: str, encoding: str) -> float:
    """p-value of the battery, even under chance: small if the characters are not drawn at random from the alphabet.

    The three tests depend on each other and take few values for short tokens, so their least p-value is
    compared with those of random tokens of that encoding and length; a hash of the token decides among equal ones.
    """
    token = token.rstrip("=")
    if encoding == "hex":
        token = token.lower()
    if encoding == "base64":
        token = token.replace("-", "+").replace("_", "/")
    places = np.array([[_PLACES[encoding][c] for c in token]], np.int64)
    least = battery(places, len(_ALPHABETS[encoding]))[0]
    chance = _under_chance(encoding, _drawn_length(len(token)))
    below, upto = np.searchsorted(chance, least, "left"), np.searchsorted(chance, least, "right")
    among = xxhash.xxh3_64_intdigest(token, seed=1) / 2.0 ** 64
    return float(below + among * (upto - below + 1)) / (DRAWS + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind."""
    spans = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            spans += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        spans += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return spans


def _scan(batches):
    for batch in batches:
        base, tokens = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            found, rest = base_spans(text), []
            raw = text.encode().translate(_KEY_BYTES).split()
            if raw and len(max(raw, key=len)) >= LEAST_LENGTH:
                runs = list(_TOKEN.finditer(text))
                for run in runs:
                    found += [(2, run.start() + m.start(), run.start() + m.end())
                              for m in _HEX.finditer(run[0]) if m.end() - m.start() >= 32]
                cover = bytearray(len(text))
                for _, start, end in found:
                    cover[start:end] = b"\1" * (end - start)
                for run in runs:
                    encoding = encoding_of(run[0]) if cover.find(1, run.start(), run.end()) < 0 else None
                    if encoding:
                        p = randomness(run[0], encoding)
                        size = sum(len(run[0].rstrip("=")) >= n for n in LENGTHS)
                        rest.append({"start": run.start(), "kind": 3, "end": run.end(),
                                     "class": ENCODINGS.index(encoding) * (len(LENGTHS) + 1) + size,
                                     "bin": min(BINS - 1, int(p * BINS)), "p": p,
                                     "hash": xxhash.xxh3_64_intdigest(run[0].rstrip("=")) - (1 << 63)})
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in sorted((s, k, e) for k, s, e in found)])
            tokens.append(rest)
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        token = pa.struct([*span, ("class", pa.int32()), ("bin", pa.int32()), ("p", pa.float64()),
                           ("hash", pa.int64())])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(base, pa.list_(span)), pa.array(tokens, pa.list_(token))],
                                         ["row", "base", "tokens"])


def least_bin(counts: np.ndarray, rate: float) -> int:
    """The first bin of p-values from which on the expected share of false discoveries is at
    most `rate`, given how many tokens lie in each; the number of bins if there is none.

    Random tokens fall evenly into the bins, so twice the upper half estimates how many there are, and five quarters
    of the upper four fifths do with less noise, unless written tokens reach that far.  Of the second and of the first
    with its standard error the smaller counts: the error vanishes beside many tokens.  What exceeds the
    random ones from some bin on is false.
    """
    bins = len(counts)
    half, most = float(counts[bins // 2:].sum()), float(counts[bins // 5:].sum())
    random = min(2 * (half + math.sqrt(half)), 1.25 * most)
    for k in range(1, bins // 2 + 1):
        declared = counts[k:].sum()
        if declared and 1 - random * (1 - k / bins) / declared <= rate:
            return k
    return bins


def find_secrets(docs: DataFrame, text: str = "text", rate: float = FALSE_RATE,
                 carry: tuple[str, ...] | None = None) -> DataFrame:
    """Documents (struct `row`, of the columns `carry` if given) with base and spans: arrays of start, kind (place in KINDS), end.

    Places are code points, ends exclusive; both arrays are ordered by start, then kind.
    spans has those of base and tokens that count as random at the false discovery rate of
    their encoding and length, over the distinct tokens of all rows (a token counts once however
    often it stands).  A null text counts as empty.  Tokens that overlap a base span are not tested.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = bundled(docs, carry, text=F.col(text))
    span = "start:bigint,kind:int,`end`:bigint"
    rows = scratch.table(map_batches(rows, _scan, extended(
        rows, ["text"], f"base array<struct<{span}>>, tokens array<struct<{span},class:int,bin:int,p:double,hash:bigint>>")))
    classes = len(ENCODINGS) * (len(LENGTHS) + 1)
    counts = np.zeros((classes, BINS), np.int64)
    distinct = rows.select(F.explode("tokens").alias("t")).select("t.class", "t.bin", "t.hash").distinct()
    # at most one row per class and bin
    for r in distinct.groupBy("class", "bin").count().collect():
        counts[r["class"], r["bin"]] = r["count"]
    least = F.array(*[F.lit(least_bin(counts[k], rate)) for k in range(classes)])
    chosen = F.transform(F.filter("tokens", lambda t: t["bin"] >= F.get(least, t["class"])), lambda t: F.struct(
        t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return rows.select("row", "base", F.array_sort(F.concat("base", chosen)).alias("spans"))


def op8_randomness_tests(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")
              for k, kind in enumerate(KINDS[:3])]
    return find_secrets(docs, carry=("doc_id",)).select("row.doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
                                     written("spans").alias("spans"))
