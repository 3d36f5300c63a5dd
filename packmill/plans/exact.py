"""Exact token counts of documents that are too large for one string.

The tokenizer first cuts a text into pieces with a regular expression and encodes each
piece alone.  A run of line breaks always ends a piece unless more white space with a
line break follows, so a document cut at such places has as many tokens as its parts.
The parts are a block without its closing marker, the marker with the line breaks
after it, a line of the tree, and the fixed sections.
"""

from pyspark.sql import Column, functions as F

from packmill.functions.render import fence
from packmill.functions.text import exact_token_counter

count_tokens = exact_token_counter()


def block_tokens(block: Column, text: Column, fmt: str) -> Column:
    """struct<head, inner, last>: tokens of a block up to its closing marker, and of the
    marker where another block follows and at the end of the document."""
    marker = F.lit(" ---") if fmt == "text" else fence(text)
    head = F.substring(block, F.lit(1), F.length(block) - F.length(marker))
    return F.struct(
        count_tokens(head).alias("head"),
        count_tokens(F.concat(marker, F.lit("\n\n"))).alias("inner"),
        count_tokens(F.concat(marker, F.lit("\n"))).alias("last"))


def _strict_sum(value: Column, rows: Column) -> Column:
    """Sum over `rows`, NULL as soon as one of them has no count."""
    missing = F.count_if(rows & value.isNull()) > 0
    return F.when(~missing, F.coalesce(F.sum(F.when(rows, value)), F.lit(0).cast("long")))


def sum_blocks(packed: Column) -> list[Column]:
    head, inner, last = (F.col(f"tokens.{n}") for n in ("head", "inner", "last"))
    final = F.max_by(last - inner, F.when(packed, F.col("sort_key")))
    return [(_strict_sum(head + inner, packed) + F.coalesce(final, F.lit(0).cast("long"))
             ).alias("block_tokens")]


def sum_tree() -> list[Column]:
    # in a text document a blank line follows the last line, and line breaks go together
    return [_strict_sum(count_tokens(F.concat(F.col("line"), F.lit("\n"))), F.lit(True)).alias("tree_tokens"),
            F.max_by("line", "sort_key").alias("last_line")]


def document_tokens(include_tree: bool) -> Column:
    """Tokens of the draft document, from the columns of the statistics row."""
    newline = F.lit("\n")
    blocks = F.when(F.col("packed") == 0, F.lit(0).cast("long")).otherwise(F.col("block_tokens"))
    opening = F.concat(F.col("files_opening"), F.when(F.col("packed") == 0, "\n").otherwise("\n\n"))
    total = blocks + count_tokens(F.concat(F.col("draft"), newline)) + count_tokens(opening)
    if include_tree:
        last = F.concat(F.col("last_line"), newline)
        # the closing row of a text document is empty, that of a Markdown one a fence
        ending = F.concat(last, F.col("tree_closing"), newline)
        total = (total + F.col("tree_tokens") - count_tokens(last) + count_tokens(ending)
                 + count_tokens(F.concat(F.col("tree_opening"), newline)))
    return total
