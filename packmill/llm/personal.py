"""Personal data: base patterns, and candidate spans selected by gradient-boosted trees.

Generators propose spans generously, also overlapping ones: whatever has the shape of an
address, a number in groups, dotted numbers.  Trees score each from its format and context;
they are fitted on a bounded sample of candidates, whose labels the strict rules of the
base patterns give, together with rewritten positives (numbers without their plus sign or
in other groups, addresses spelled out) and spoiled ones (failing checksums, parts too
large).  Scores are calibrated on other candidates than they were fitted on, and per kind a
threshold keeps the wanted precision.  Spans of the base patterns always stay.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packmill.llm.boosting import Boosted, calibrated, threshold
from packmill.llm.common import bundled, extended, map_batches

KINDS = ("email", "ip", "card", "phone")
# The bounds of the sample: documents drawn, and candidates kept of them.
SAMPLE_DOCUMENTS = 3000
SAMPLE_CANDIDATES = 8000
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

# generators
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,5}(?![0-9.])")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}(?: ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,24}){1,4}"
    r"| at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,24}){1,4})(?![A-Za-z0-9])")
_CUES = {
    "email": ("mail", "contact", "write", "reach", "address"), "ip": ("ip", "host", "server", "addr", "login", "from"),
    "card": ("card", "visa", "credit", "pay", "account"), "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
}
_COUNTER_CUES = ("version", "order", "id", "no", "isbn", "page", "date", "ref", "build", "release", "invoice", "serial")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; matches that fail their check are dropped."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) proposed by the generators; a number may be proposed for several kinds."""
    found = []
    if "@" in text or "(at)" in text or "[at]" in text or " dot " in text:
        found += [(0, *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        found += [(1, *m.span()) for m in _DOTTED.finditer(text)]
        for m in _NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if digits >= 12:
                found.append((2, *m.span()))
            if digits <= 16:
                found.append((3, *m.span()))
    return found


def features(kind: int, span: str, before: str, after: str) -> list[float]:
    digits = _DIGITS.sub("", span)
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g] or [0]
    context = before.lower()[-40:]
    words = re.findall(r"[a-z]+", context)[-4:]
    parts = [int(g) for g in re.findall(r"[0-9]{1,6}", span)[:6]] or [0]
    return [
        kind, len(span), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        len(set(groups)), span.count(" "), span.count("-"), span.count("."), span.count("("), span.count("/"),
        float(span[:1] == "("), float(luhn(digits)) if len(digits) >= 12 else -1.0, max(parts), len(set(digits)),
        float(span[:1] == "0"), sum(c.isalpha() for c in span), float("@" in span),
        len(span.rpartition(".")[2]) if kind == 0 else 0.0, float(" at " in span), float("(at)" in span or "[at]" in span),
        sum(any(w.startswith(c) for c in _CUES[KINDS[kind]]) for w in words),
        sum(any(w.startswith(c) for c in _COUNTER_CUES) for w in words),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("", " ", "\n", "\t", ":", "(")),
        float(after[:1] in ("", " ", "\n", "\t", ".", ",", ")", ";")),
    ]


def _without_plus(kind: int, span: str) -> str:
    """The span as the trees see it: a plus sign tells the base pattern's label, not theirs."""
    return span[1:].lstrip() if kind == 3 and span[:1] == "+" else span


def _cover(text: str, spans) -> bytearray:
    """A 1 for every character that lies in a span."""
    cover = bytearray(len(text))
    for _, start, end in spans:
        cover[start:end] = b"\1" * (end - start)
    return cover


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 48):start], text[end:end + 2]


def _examples(text: str, rng) -> list[tuple[list[float], int]]:
    """Labelled candidates of a text, and rewritten and spoiled ones."""
    out = []
    strict = set(base_spans(text))
    taken = _cover(text, strict)
    for kind, start, end in sorted(strict | set(candidates(text))):
        before, after = _around(text, start, end)
        span = text[start:end]
        yes = (kind, start, end) in strict
        if not yes and taken.find(1, start, end) >= 0:
            continue  # part of a span that is decided already
        out.append((features(kind, _without_plus(kind, span), before, after), int(yes)))
        if not yes:
            continue
        digits = _DIGITS.sub("", span)
        if kind == 0:
            name, _, domain = span.partition("@")
            out.append((features(0, f"{name} at {domain.replace('.', ' dot ')}", before, after), 1))
            out.append((features(0, f"{name}(at){domain}", before, after), 1))
            out.append((features(0, f"{name} at {domain.partition('.')[0]}", before, after), 0))
        elif kind == 1:
            parts = span.split(".")
            parts[int(rng.integers(4))] = str(int(rng.integers(256, 1000)))
            out += [(features(1, ".".join(parts), before, after), 0), (features(1, ".".join(parts[:3]), before, after), 0)]
        elif kind == 2:
            wrong = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
            sep = "- "[int(rng.integers(2))]
            out += [(features(2, wrong, before, after), 0),
                    (features(2, sep.join(digits[k:k + 4] for k in range(0, len(digits), 4)), before, after), 1),
                    (features(2, sep.join(wrong[k:k + 4] for k in range(0, len(wrong), 4)), before, after), 0)]
        elif kind == 3:
            local = digits[-10:]
            out += [(features(3, f"({local[:3]}) {local[3:6]}-{local[6:]}", before, after), 1),
                    (features(3, f"{local[:3]}-{local[3:6]}-{local[6:]}", before, after), 1),
                    (features(3, "".join(str(d) for d in rng.integers(0, 10, len(digits))), before, after), 0),
                    (features(3, f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", before, after), 0)]
    return out


class Selector:
    """Trees, calibration and thresholds per kind; None where a kind has too few examples."""

    def __init__(self, rows: list[tuple[list[float], int]], precision: float = PRECISION):
        self.models = {}
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        part = np.arange(len(rows)) % 3
        for kind in range(len(KINDS)) if len(rows) else ():
            own = x[:, 0] == kind
            fit, rest = own & (part > 0), own & (part == 0)
            if min(y[fit].sum(), (1 - y[fit]).sum(), y[rest].sum(), (1 - y[rest]).sum()) < 5:
                continue
            trees = Boosted().fit(x[fit], y[fit])
            a, b = calibrated(trees.margin(x[rest]), y[rest])
            p = 1 / (1 + np.exp(-(a * trees.margin(x[rest]) + b)))
            self.models[kind] = (trees, a, b, max(0.5, threshold(p, y[rest], precision)))

    def chosen(self, rows: list[list[float]]) -> list[float]:
        """Probability of each candidate if it is to be redacted, else 0."""
        x, out = np.array(rows), np.zeros(len(rows))
        for kind, (trees, a, b, least) in self.models.items():
            own = np.flatnonzero(x[:, 0] == kind)
            if own.size:
                p = 1 / (1 + np.exp(-(a * trees.margin(x[own]) + b)))
                out[own] = np.where(p >= least, p, 0.0)
        return out.tolist()


def _sampled(batches):
    for batch in batches:
        rows = []
        for text, seed in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist(), strict=True):
            rng = np.random.default_rng(seed & 0xFFFFFFFF)
            rows += [(x, y, (seed ^ k * 0x9E3779B97F4A7C15) % (1 << 62)) for k, (x, y) in enumerate(_examples(text or "", rng))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.int64())], ["x", "y", "place"])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])


def _found(shared):
    def found(batches):
        selector = shared.value
        for batch in batches:
            spans, rows, owner, covers = [], [], [], {}
            for place, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                strict = base_spans(text)
                spans.append([(*s, None) for s in strict])
                proposed = candidates(text)
                cover = covers[place] = _cover(text, strict) if proposed else bytearray()
                for kind, start, end in proposed:
                    if cover.find(1, start, end) < 0:
                        owner.append((place, kind, start, end))
                        rows.append(features(kind, _without_plus(kind, text[start:end]), *_around(text, start, end)))
            chances = selector.chosen(rows) if rows and selector.models else [0.0] * len(rows)
            # of overlapping candidates the likeliest counts, of equally likely ones the first
            order = sorted((k for k, p in enumerate(chances) if p > 0), key=lambda k: (owner[k][0], -chances[k], owner[k][2:], owner[k][1]))
            for k in order:
                place, kind, start, end = owner[k]
                if covers[place].find(1, start, end) < 0:
                    covers[place][start:end] = b"\1" * (end - start)
                    spans[place].append((kind, start, end, chances[k]))
            out = [[{"kind": KINDS[k], "start": s, "end": e, "p": p} for k, s, e, p in sorted(x, key=lambda z: z[:3])] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(_SPAN))], ["row", "spans"])
    return found


def find_personal(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents (struct `row`) with spans: kind, start, end (code points, end exclusive), p.

    Spans of the base patterns have no p; spans that the trees add have their probability and
    overlap neither base spans nor each other.  Order: kind as in KINDS, then start.  A null
    text counts as empty and has no spans.  Kinds with too few examples in the sample add
    nothing.  Repeated rows get the same spans.
    """
    spark = docs.sparkSession
    kept = docs.where(F.col(text).rlike("[0-9@]"))
    many = max(1, kept.count())
    draw = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 40))
    sample = kept.where(draw < int((1 << 40) * min(1.0, SAMPLE_DOCUMENTS / many))).select(F.col(text).alias("text"), draw.alias("draw"))
    rows = map_batches(sample, _sampled, extended(sample, ["text", "draw"], "x array<double>, y int, place long"))
    rows = rows.orderBy("place", "x").limit(SAMPLE_CANDIDATES).collect()
    shared = spark.sparkContext.broadcast(Selector([(r.x, r.y) for r in rows]))
    rows = bundled(docs, text=F.col(text))
    return map_batches(rows, _found(shared), extended(
        rows, ["text"], "spans array<struct<kind:string,start:bigint,`end`:bigint,p:double>>"))


def redacted(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `find_personal` with `redacted`: the text with each span replaced by its kind."""
    cut = F.aggregate(
        F.array_sort("spans", lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0)),
        F.struct(F.coalesce(F.col(f"row.`{text}`"), F.lit("")).alias("t"), F.lit(1 << 40).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], F.struct(
            F.concat(F.substring(acc["t"], F.lit(1), s["start"].cast("int")), F.lit("<"), s["kind"], F.lit(">"),
                     F.substring(acc["t"], (s["end"] + 1).cast("int"), F.lit(1 << 30))).alias("t"),
            s["start"].alias("at"))).otherwise(acc))
    return found.withColumn("redacted", cut["t"])


def op7_boosted_trees(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["p"].isNull())
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return find_personal(docs).select(
        "row.doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))

