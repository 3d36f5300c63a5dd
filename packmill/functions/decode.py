"""Bytes to text, on the JVM only: no row reaches a Python worker.

A byte order mark decides first; then a NUL near the start means binary; then
UTF-8, Windows-1251 and Latin-1 are tried in this order, the last never failing.
"""

from pyspark.sql import Column, functions as F

from packmill.constants import BINARY_WINDOW, REASON_BAD_BOM, REASON_BINARY

# Windows-1251 as Python defines it: every high byte but 0x98 has a character
_HIGH = [b for b in range(0x80, 0x100) if b != 0x98]
_AS_LATIN1 = "".join(chr(b) for b in _HIGH)
_AS_CP1251 = bytes(_HIGH).decode("cp1251")

# Well-formed UTF-16 and UTF-32 after the mark, over the bytes read as Latin-1.
# The groups are possessive, so Java matches them in a loop and not recursively.
_UTF16_LE = r"(?s)^\xFF\xFE(?:.[\x00-\xD7\xE0-\xFF]|.[\xD8-\xDB].[\xDC-\xDF])*+\z"
_UTF16_BE = r"(?s)^\xFE\xFF(?:[\x00-\xD7\xE0-\xFF].|[\xD8-\xDB].[\xDC-\xDF].)*+\z"
_UTF32_LE = (r"(?s)^\xFF\xFE\x00\x00"
             r"(?:.[\x00-\xD7\xE0-\xFF]\x00\x00|..[\x01-\x10]\x00)*+\z")
_UTF32_BE = (r"(?s)^\x00\x00\xFE\xFF"
             r"(?:\x00\x00[\x00-\xD7\xE0-\xFF].|\x00[\x01-\x10]..)*+\z")


def _hex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _starts(content: Column, digits: str) -> Column:
    return F.startswith(content, _hex(digits))


def bom(content: Column) -> Column:
    """Encoding told by the byte order mark, NULL without one; the longer marks go first."""
    return (F.when(_starts(content, "FFFE0000") | _starts(content, "0000FEFF"), "utf-32")
            .when(_starts(content, "FFFE") | _starts(content, "FEFF"), "utf-16")
            .when(_starts(content, "EFBBBF"), "utf-8-sig"))


def looks_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, BINARY_WINDOW), _hex("00"))


def _latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def _is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _well_formed(content: Column) -> Column:
    """Whether bytes that start with a mark decode without an error."""
    raw = _latin1(content)
    return (F.when(_starts(content, "FFFE0000"), raw.rlike(_UTF32_LE))
            .when(_starts(content, "0000FEFF"), raw.rlike(_UTF32_BE))
            .when(_starts(content, "FFFE"), raw.rlike(_UTF16_LE))
            .when(_starts(content, "FEFF"), raw.rlike(_UTF16_BE))
            .otherwise(_is_utf8(content)))


def _tail(content: Column, start: int) -> Column:
    return F.substring(content, start, 2147483647)


def skip_reason(content: Column) -> Column:
    """Why the bytes have no text; NULL when they have."""
    return (F.when(bom(content).isNotNull(), F.when(~_well_formed(content), F.lit(REASON_BAD_BOM)))
            .when(looks_binary(content), F.lit(REASON_BINARY)))


def encoding(content: Column) -> Column:
    """Codec the text was read with, NULL when there is none."""
    plain = (F.when(_is_utf8(content), "utf-8")
             .when(F.contains(content, _hex("98")), "latin-1").otherwise("cp1251"))
    return F.when(content.isNotNull() & skip_reason(content).isNull(), F.coalesce(bom(content), plain))


def text(content: Column, enc: Column) -> Column:
    """Text of the bytes, given `encoding(content)`."""
    return (F.when(enc == "utf-8", content.cast("string"))
            .when(enc == "utf-8-sig", _tail(content, 4).cast("string"))
            .when(enc == "cp1251", F.translate(_latin1(content), _AS_LATIN1, _AS_CP1251))
            .when(enc == "latin-1", _latin1(content))
            .when((enc == "utf-16") & _starts(content, "FFFE"),
                  F.decode(_tail(content, 3), "UTF-16LE"))
            .when(enc == "utf-16", F.decode(_tail(content, 3), "UTF-16BE"))
            .when(enc == "utf-32", F.decode(content, "UTF-32")))


def transcoded(enc: Column) -> Column:
    return ~enc.startswith("utf-8")


def decode_text(content: Column) -> Column:
    """struct<text, skip_reason, encoding> of a file's bytes."""
    enc = encoding(content)
    return F.struct(text(content, enc).alias("text"), skip_reason(content).alias("skip_reason"),
                    enc.alias("encoding"))
