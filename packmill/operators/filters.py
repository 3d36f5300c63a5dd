"""Which entries are ignored, and by which layer."""

from pyspark.sql import Column, functions as F

from packmill.constants import (
    ALLOWED_HIDDEN_FILES, IGNORED_EXTENSIONS, IGNORED_FILE_NAMES, IGNORED_NAMES, LEFTOVER_NAME,
    TOOL_IGNORE_FILE, VCS_IGNORE_FILE)
from packmill.functions.paths import base_name
from packmill.functions.patterns import quote
from packmill.functions.text import human_bytes


def _any_of(names) -> str:
    # names are compared with lower-cased components, so mixed-case ones never match
    return "|".join(quote(n) for n in names if n == n.lower())


_NAMES = rf"(?:^|/)(?:{_any_of(IGNORED_NAMES)})/"
_HIDDEN = rf"(?:^|/)(?!(?:{_any_of(ALLOWED_HIDDEN_FILES)})(?:/|\z))\."
# the last extension, whose dot is not the first character of the name
_BINARY = rf"(?s)^.+(?:{_any_of(IGNORED_EXTENSIONS)})\z"


def ignored_name(path: Column, is_file: Column) -> Column:
    """A component is one of the ignored names; a file's own name does not count."""
    directories = F.when(is_file, F.regexp_replace(path, r"[^/]+\z", "")).otherwise(
        F.concat(path, F.lit("/")))
    return F.lower(directories).rlike(_NAMES)


def egg_info(path: Column) -> Column:
    return F.concat(F.lower(path), F.lit("/")).contains(".egg-info/")


def hidden(path: Column) -> Column:
    """A component starts with a dot and is not one of the allowed names."""
    return F.lower(path).rlike(_HIDDEN)


def builtin_reason(path: Column, is_file: Column, resolved: Column | None = None) -> Column:
    """First built-in layer that ignores the path, NULL if none does.

    Components are those of `resolved` where a link leads elsewhere; extension and name
    are the entry's own.  All of it is row by row: a file below an ignored directory is
    found by its own path, so nothing is joined.
    """
    where = path if resolved is None else F.coalesce(resolved, path)
    junk = [n for n in IGNORED_FILE_NAMES if n == n.lower()]
    return (F.when(ignored_name(where, is_file), "ignored_name")
            .when(egg_info(where), "egg_info")
            .when(hidden(where), "hidden")
            .when(is_file & F.lower(base_name(path)).rlike(_BINARY), "binary_extension")
            .when(is_file & F.lower(base_name(path)).isin(*junk), "junk_name"))


def is_leftover(path: Column, kind: Column) -> Column:
    return (path == LEFTOVER_NAME) & (kind != "dir")


def is_ignore_file(path: Column, is_file: Column) -> Column:
    """Ignore files in effect: not below an ignored or .egg-info directory, though
    hidden directories are looked into."""
    return (is_file & base_name(path).isin(VCS_IGNORE_FILE, TOOL_IGNORE_FILE)
            & ~ignored_name(path, F.lit(True)) & ~egg_info(path))


def size_reason(size: Column, limit: int | None) -> Column:
    """Skip reason of files larger than the limit; decided before any byte is read."""
    if limit is None:
        return F.lit(None).cast("string")
    return F.when(size > limit, F.concat(
        F.lit("exceeds size limit ("), human_bytes(F.lit(limit)), F.lit(")")))
