"""Lines of ignore files, rebased onto the project root and compiled to Java regexes.

Everything is a column expression over the exploded lines, so rule files of any
number of projects compile on the executors, without a Python worker.
"""

from pyspark.sql import Column, DataFrame, functions as F

# what Python calls white space and what it takes for the end of a line
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAK = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
# one unit of a glob: escaped character, character class, run of stars, any other character
TOKEN = r"(?s)(\\.|\[[!^]?\]?[^\]]*\]|\*+|.)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a break at the very end opens no further line."""
    whole = F.regexp_replace(text, rf"{LINE_BREAK}\z", "")
    return F.when(text == "", F.expr("array()").cast("array<string>")
                  ).otherwise(F.split(whole, LINE_BREAK, -1))


def is_rule(line: Column) -> Column:
    """Neither blank nor a comment."""
    return (strip(line) != "") & ~strip(line).startswith("#")


def negates(line: Column) -> Column:
    return strip(line).startswith("!")


def pattern_of(line: Column, dir_path: Column) -> Column:
    """Pattern without its '!'; NULL when nothing is left of it.

    In a nested file leading slashes only say 'this directory', which the rebased
    pattern says anyway.
    """
    bare = F.regexp_replace(strip(line), rf"^!", "")
    nested = F.regexp_replace(F.regexp_replace(bare, rf"^{SPACE}+", ""), "^/+", "")
    return F.when(dir_path == "", F.when(~bare.isin("", "/"), bare)
                  ).otherwise(F.when(nested != "", nested))


def rebased(ignore: Column, pattern: Column, dir_path: Column) -> Column:
    """The line as it would stand in the root's ignore file."""
    return F.concat(F.when(ignore, "").otherwise("!"),
                    F.when(dir_path == "", "").otherwise(F.concat(dir_path, F.lit("/"))), pattern)


def quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\](){}.^$|?*+\-#&~ ])", r"\\$1")


def _unit(token: Column) -> Column:
    """Regex of one unit of a glob."""
    size = F.length(token)
    negated = F.substring(token, 2, 1).isin("!", "^")
    start = F.when(negated, 3).otherwise(2)
    # '-' keeps its meaning between two characters, everything else is literal
    inside = F.substring(token, start, size - start)
    backwards = F.exists(
        F.regexp_extract_all(inside, F.lit("(?s)(.-.)"), 1),
        lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
    char_class = F.when(backwards, F.lit("(?!)")).otherwise(F.concat(
        F.when(negated, "[^").otherwise("["),
        F.regexp_replace(inside, r"([\\\[\]&^~])", r"\\$1"), F.lit("]")))
    return (F.when(token.startswith("\\") & (size == 2), quoted(F.substring(token, 2, 1)))
            .when(token.startswith("[") & (size > 2), char_class)
            .when(token.startswith("*"), F.lit("[^/]*"))
            .when(token == "?", F.lit("[^/]"))
            .otherwise(quoted(token)))


def _component(glob: Column) -> Column:
    units = F.transform(F.regexp_extract_all(glob, F.lit(TOKEN), 1), _unit)
    return F.when(glob == "*", F.lit("[^/]+")).otherwise(F.array_join(units, ""))


def with_regex(patterns: DataFrame) -> DataFrame:
    """Adds the anchored `regex` and `dir_only` to rows with `pattern` and `dir`.

    A slash before the end anchors the pattern; without one it may match at any
    level.  '*' and '?' stay within a component, '**' does not.  A match covers
    everything below it; with a trailing slash only that, so directories are to be
    tested with a slash at their end.  Rules of a nested file are anchored to its
    directory, whose name is literal.
    """
    in_root, pattern, core = F.col("dir") == "", F.col("pattern"), F.col("_core")
    # one column after another, so that no expression is written out many times
    rows = patterns.withColumn("dir_only", pattern.endswith("/"))
    rows = rows.withColumn("_core", F.regexp_replace(pattern, "^/|/$", ""))
    # runs of '**' count once
    rows = rows.withColumn("_core", F.regexp_replace(
        core, r"(^|/)\*\*(?:/\*\*)+(?=/|$)", r"$1**"))
    rows = rows.withColumn("_globs", F.split(core, "/", -1))
    floating = ~pattern.startswith("/") & ~core.contains("/") & (core != "**")
    rows = rows.withColumn("_prefix", F.when(~in_root, quoted(F.col("dir"))).when(
        floating, "(?:.+/)?").otherwise(""))
    only_dirs, globs = F.col("dir_only"), F.col("_globs")

    def piece(glob: Column, i: Column) -> Column:
        final = (i == F.size(globs) - 1) & ~only_dirs
        stars = (F.when(in_root & (i == 0) & final, "[^/]+(?:/.*)?")
                 .when(in_root & (i == 0), "(?:.+/)?")
                 .when(final, "/.*").otherwise("(?:/.+)?"))
        bare = in_root & ((i == 0) | ((i == 1) & (globs[0] == "**")))
        return F.when(glob == "**", stars).otherwise(F.concat(
            F.when(bare, "").otherwise("/"), _component(glob),
            F.when(final, "(?:/.*)?").otherwise("")))

    rows = rows.withColumn("regex", F.concat(
        "_prefix", F.array_join(F.transform(globs, piece), ""),
        F.when(only_dirs, "/.*").otherwise("")))
    return rows.withColumn("regex", F.when(in_root & (pattern == "**/"), ".+/.*").otherwise(
        F.col("regex"))).drop("_core", "_globs", "_prefix")


def program(rules: Column) -> Column:
    """One regex that tells whether an ordered list of rules ignores a path.

    `rules` is an array of struct<ignore, regex>; the last match decides.  An
    ignoring rule is one more alternative in front; a re-including one is a
    negative look-ahead in front of everything decided so far.
    """
    start = F.struct(F.lit("(?!)").alias("regex"), F.lit(False).alias("closed"))

    def step(acc: Column, rule: Column) -> Column:
        look = F.concat(rule["regex"], F.lit(r"\z)"))
        ignoring = F.struct(
            F.concat(F.lit("(?="), look, F.lit("|"), acc["regex"]).alias("regex"),
            F.lit(False).alias("closed"))
        # `closed`: no alternative at the top level, so no group is needed
        keeping = F.struct(
            F.concat(F.lit("(?!"), look,
                     F.when(acc["closed"], acc["regex"]).otherwise(
                         F.concat(F.lit("(?:"), acc["regex"], F.lit(")")))).alias("regex"),
            F.lit(True).alias("closed"))
        return F.when(rule["ignore"], ignoring).otherwise(keeping)

    folded = F.aggregate(rules, start, step, lambda acc: acc["regex"])
    return F.concat(F.lit("(?s)^(?:"), folded, F.lit(")"))


def ignored_by(path: Column, program_regex: Column) -> Column:
    # regexp_instr keeps its compiled pattern as long as the pattern stays the same
    # from row to row; rlike would compile it for every row
    return F.coalesce(F.regexp_instr(path, program_regex) > 0, F.lit(False))
