"""Strings the document is made of."""

from pyspark.sql import Column, functions as F

from packmill.constants import FORMATS, LANGUAGES, METHOD_OFF, RULER
from packmill.functions.paths import suffix


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unknown output format {fmt!r}; known are {', '.join(FORMATS)}")
    return fmt


def language(path: Column) -> Column:
    known = F.str_to_map(F.lit(",".join(f"{ext}:{tag}" for ext, tag in LANGUAGES.items())),
                         F.lit(","), F.lit(":"))
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit(""))


def longest_ticks(text: Column) -> Column:
    """Length of the longest run of backticks."""
    runs = F.regexp_extract_all(text, F.lit("(`+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def fence_length(ticks: Column) -> Column:
    return F.greatest(F.lit(3), ticks + 1)


def fence(text: Column) -> Column:
    """Fence that no run of backticks in the text can close."""
    return F.repeat(F.lit("`"), fence_length(longest_ticks(text)))


def file_block(path: Column, text: Column, fmt: str) -> Column:
    if check_format(fmt) == "text":
        return F.concat(F.lit("--- START OF FILE: "), path, F.lit(" ---\n"), text,
                        F.lit("\n--- END OF FILE: "), path, F.lit(" ---"))
    body = F.concat(text, F.when(text.endswith("\n"), "").otherwise("\n"))
    ticks = fence(text)
    return F.concat(F.lit("### `"), path, F.lit("`\n"), ticks, language(path), F.lit("\n"),
                    body, ticks)


def stat_lines(fmt: str, name: Column, generated_at: Column, packed: Column, skipped: Column,
               lines: Column, tokens: Column, method: Column) -> Column:
    """Statistics of the header, an array of lines."""
    label = "PROJECT CONTEXT PACK: " if fmt == "text" else "Project: "
    return F.array_compact(F.array(
        F.concat(F.lit(label), name),
        F.concat(F.lit("Generated on: "), generated_at),
        F.concat(F.lit("Total files packed: "), packed.cast("string")),
        F.when(skipped > 0, F.concat(F.lit("Skipped files: "), skipped.cast("string"),
                                     F.lit(" (marked in the tree / see warnings)"))),
        F.concat(F.lit("Total lines: "), lines.cast("string")),
        F.when(method == METHOD_OFF, F.lit("Estimated tokens: disabled")).otherwise(
            F.concat(F.lit("Estimated tokens: ~"), tokens.cast("string"), F.lit(" ("), method,
                     F.lit(")")))))


def header(fmt: str, lines: Column) -> Column:
    """Header section; like every section text it lacks the newline the writer adds."""
    if check_format(fmt) == "text":
        return F.concat(F.lit(RULER + "\n"), F.array_join(lines, "\n"), F.lit(f"\n{RULER}\n"))
    return F.concat(F.lit("# Project Context Pack\n- "), F.array_join(lines, "\n- "), F.lit("\n"))


def tree_opening(fmt: str, ticks: Column) -> Column:
    if fmt == "text":
        return F.lit(f"{RULER}\nDIRECTORY TREE\n{RULER}")
    return F.concat(F.lit("## Directory Tree\n\n"), F.repeat(F.lit("`"), ticks), F.lit("text"))


def tree_closing(fmt: str, ticks: Column) -> Column:
    """Row after the last tree line: ends the section and leaves a blank line."""
    if fmt == "text":
        return F.lit("")
    return F.concat(F.repeat(F.lit("`"), ticks), F.lit("\n"))


def files_opening(fmt: str, packed: Column) -> Column:
    """Heading of the contents.  Each block brings the blank line before it; without
    any block the document still ends in two empty lines."""
    title = f"{RULER}\nFILES CONTENT\n{RULER}" if fmt == "text" else "## Files Content"
    return F.concat(F.lit(title), F.when(packed == 0, "\n\n").otherwise(""))
