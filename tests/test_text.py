import codecs

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packmill.functions import decode, render, text as tx


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


# per encoding how its texts look on disk: what stands in front (hex), and how the rest is written
WRITTEN = {"utf-32": {"fffe0000": "utf-32-le", "0000feff": "utf-32-be"}, "utf-16": {"fffe": "utf-16-le", "feff": "utf-16-be"},
           "utf-8-sig": {"efbbbf": "utf-8"}, "utf-8": {"": "utf-8"}, "cp1251": {"": "cp1251"}, "latin-1": {"": "latin-1"}}
PLAIN = ["utf-8", "cp1251", "latin-1"]


def expected(raw):
    """What a file comes to, from the texts that give just these bytes when they are written."""
    begins = {name: {codec: raw[len(mark) // 2:] for mark, codec in forms.items() if raw.hex().startswith(mark)}
              for name, forms in WRITTEN.items()}
    texts = {name: text for name, forms in begins.items() for codec, body in forms.items()
             if (text := body.decode(codec, "ignore")).encode(codec) == body}
    marked = [name for name in WRITTEN if name not in PLAIN and begins[name]]
    if marked:
        name = marked[0]  # the longest mark
        return (texts[name], None, name) if name in texts else (None, "encoding error (invalid BOM-marked content)", None)
    if raw.find(b"\0", 0, 8192) >= 0:
        return None, "binary file", None
    name = min(texts, key=PLAIN.index)
    return texts[name], None, name


SAMPLES = [
    b"", b"plain\n", "Привіт".encode(), codecs.BOM_UTF8 + "ok é".encode(), codecs.BOM_UTF8, codecs.BOM_UTF8 + b"\xff",
    "текст".encode("cp1251"), bytes(b for b in range(1, 256) if b != 0x98), bytes(range(1, 256)), b"\x98foo", b"a\0b",
    b"x" * 9000 + b"\0", b"x" * 8191 + b"\0", b"x" * 8192 + b"\0", "a😀b".encode("utf-16"), "a😀b".encode("utf-32"),
    codecs.BOM_UTF16_BE + "aé😀".encode("utf-16-be"), codecs.BOM_UTF32_BE + "aé😀".encode("utf-32-be"),
    codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE, codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE,
    b"\xff\xfeA", b"\xff\xfe\x00\xd8", b"\xff\xfe\x00\xdc", b"\xff\xfe\x00\xd8\x41\x00", b"\xfe\xff\xd8\x00",
    b"\xfe\xff\xd8\x00\xdc\x00", b"\xff\xfe\x00\x00\x00\xd8\x00\x00", b"\xff\xfe\x00\x00\x00\x00\x11\x00",
    b"\xff\xfe\x00\x00\xff\xff\x10\x00", b"\x00\x00\xfe\xff\x00\x00\xd8\x00", b"\x00\x00\xfe\xff\x00",
    b"\xff\xfe" + codecs.BOM_UTF16_LE + b"a\x00", codecs.BOM_UTF8 * 2 + b"a", b"\xed\xa0\x80", b"\xc0\x80",
    b"\xf4\x90\x80\x80", b"\xff\xfe\n\x00\x0a\x0d", ("é\r\n" * 50000).encode("utf-16"), ("😀" * 30000).encode("utf-32")]


def test_decoding(spark):
    got = column(spark, SAMPLES, lambda c: decode.decode_text(c), "binary")
    assert [(r.text, r.skip_reason, r.encoding) for r in got] == [expected(s) for s in SAMPLES]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.builds(lambda bom, body: bom + body, st.sampled_from(
    [b"", b"\xff\xfe", b"\xfe\xff", b"\xff\xfe\0\0", b"\0\0\xfe\xff", b"\xef\xbb\xbf"]),
    st.one_of(st.binary(max_size=12), st.lists(st.sampled_from(
        [b"\0", b"\xd8", b"\xdc", b"\xdb", b"\xdf", b"\x10", b"\x11", b"a", b"\n", b"\xff"]), max_size=12).map(b"".join))),
    min_size=100, max_size=200))
def test_random_bytes(spark, samples):
    got = column(spark, samples, lambda c: decode.decode_text(c), "binary")
    assert [(r.text, r.skip_reason, r.encoding) for r in got] == [expected(s) for s in samples]


def test_transcoded(spark):
    assert column(spark, ["utf-8", "utf-8-sig", "cp1251", "utf-16", None], decode.transcoded) == [
        False, False, True, True, None]


def test_line_counts(spark):
    texts = ["", "one", "one\n", "\n\n\n", "x\r\ny", "ü\n\nü", "tail\n \n", "\nhead"]
    assert column(spark, texts, tx.line_count) == [t.count("\n") + (t != "" and not t.endswith("\n")) for t in texts]


def test_heuristic_tokens(spark):
    texts = ["z" * n for n in range(0, 14)] + ["ß" * 1021, "日本語" * 7, "𝄞" * 3]
    assert column(spark, texts, tx.token_count) == [(len(t) * 2 + 4) // 8 for t in texts]


def test_human_bytes(spark):
    sizes = [0, 1023, 1024, 1280, 1331, 1048575, 1048576, 5 * 1024 ** 2, 3 * 1024 ** 3, 1024 * 1024 - 51, 1152, 1408]

    def python(n):
        return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024 ** 2 else f"{n / 1024 ** 2:.2f} MB"
    assert column(spark, sizes, tx.human_bytes, "long") == [python(n) for n in sizes]


def test_parse_size(spark):
    factors = {"": 1, "b": 1, "Kb": 1024, " mB ": 1024 ** 2, "\tGB": 1024 ** 3}
    good = {f"{lead}{amount}{unit}": int(float(amount) * factor) for lead in ("", " ") for amount in ("7", "3072", "2.25", "090.5")
            for unit, factor in factors.items()}
    bad = ["", " ", "kb", "7TB", "7K", "7kbb", "B7", "+7", "-7MB", "7,5MB", "7.", ".7kb", "7..5", "7 7", "0000", "0GB", "0.9", "0.0009KB", "NaN", "1e3"]
    assert {v: tx.parse_size(v) for v in good} == good
    for value in bad:
        with pytest.raises(ValueError):
            tx.parse_size(value)
    assert column(spark, [*good, *bad], tx.parse_size_col) == [*good.values(), *[None] * len(bad)]


def test_language(spark):
    assert column(spark, ["a.py", "A.PY", "x/b.tar.yml", "Makefile", "c.unknown", ".py", "d.r"], render.language) == [
        "python", "python", "yaml", "", "", "", "r"]


def test_fences(spark):
    texts = ["", "none", "`", "``` x ```", "a `````", "`a``b"]
    assert column(spark, texts, render.fence) == ["```", "```", "```", "````", "``````", "```"]


def test_blocks(spark):
    df = spark.createDataFrame([("a.md", "x\n```\ny\n```\n"), ("b", "no end"), ("e.py", "")], "p string, t string")
    text = [r[0] for r in df.select(render.file_block(F.col("p"), F.col("t"), "text")).collect()]
    assert text == ["--- START OF FILE: a.md ---\nx\n```\ny\n```\n\n--- END OF FILE: a.md ---",
                    "--- START OF FILE: b ---\nno end\n--- END OF FILE: b ---",
                    "--- START OF FILE: e.py ---\n\n--- END OF FILE: e.py ---"]
    md = [r[0] for r in df.select(render.file_block(F.col("p"), F.col("t"), "markdown")).collect()]
    assert md == ["### `a.md`\n````markdown\nx\n```\ny\n```\n````", "### `b`\n```\nno end\n```",
                  "### `e.py`\n```python\n\n```"]


def test_unknown_format():
    with pytest.raises(ValueError):
        render.check_format("xml")
