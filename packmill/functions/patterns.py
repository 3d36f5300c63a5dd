"""Shell globs given by the user, turned into Java regular expressions.

The patterns are options, so they are known when the plan is built: all of them
become one literal expression that Spark compiles once per task.
"""

from pyspark.sql import Column, functions as F


def quote(text: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.^$|?*+-#&~ " else c for c in text)


def _char_class(body: str) -> str:
    """Inside of '[...]': ranges and single characters; ranges that run backwards are empty."""
    negated = body.startswith("!")
    body = body[1:] if negated else body
    items, i = [], 0
    while i < len(body):
        if body[i + 1:i + 2] == "-" and i + 2 < len(body):
            low, high = body[i], body[i + 2]
            if low <= high:
                items.append(f"{quote(low)}-{quote(high)}")
            i += 3
        else:
            items.append(quote(body[i]))
            i += 1
    if not items:
        return "." if negated else "(?!)"
    # '^' is the one character that is special only at the start of a class
    return ("[^" if negated else "[") + "".join(items) + "]"


def glob_regex(pattern: str, within_name: bool = False) -> str:
    """Regex (unanchored) for a glob; `within_name` keeps wildcards inside one component."""
    out, i = [], 0
    guard = "(?!/)" if within_name else ""
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*" if within_name else ".*")
            while pattern[i + 1:i + 2] == "*":
                i += 1
        elif c == "?":
            out.append(guard + ".")
        elif c == "[":
            # a ']' right after the bracket (or its '!') belongs to the class
            first = i + 1 + (pattern[i + 1:i + 2] == "!")
            close = pattern.find("]", first + 1)
            if close < 0:
                out.append(quote(c))
            else:
                out.append(guard + _char_class(pattern[i + 1:close]))
                i = close
        else:
            out.append(quote(c))
        i += 1
    return "".join(out)


def exclude_regex(patterns) -> str | None:
    """One regex for paths hit by any pattern, themselves or through a directory above them.

    A plain glob may match the whole path (where '*' crosses '/') or the name of one
    component; a glob with a trailing slash is a literal directory at the root, of
    which only the contents match here.
    """
    choices = []
    for pattern in patterns:
        if pattern.endswith("/"):
            if pattern != "/":
                choices.append(quote(pattern[:-1]) + "/.*")
            continue
        choices.append(f"{glob_regex(pattern)}(?:/.*)?")
        if "/" not in pattern:
            choices.append(f"(?:.*/)?{glob_regex(pattern, within_name=True)}(?:/.*)?")
    return r"(?s)^(?:%s)\z" % "|".join(choices) if choices else None


def excluded(path: Column, is_dir: Column, patterns) -> Column:
    patterns = list(patterns)
    regex = exclude_regex(patterns)
    if regex is None:
        return F.lit(False)
    directories = [p[:-1] for p in patterns if p.endswith("/") and p != "/"]
    own = is_dir & path.isin(directories) if directories else F.lit(False)
    return path.rlike(regex) | own
