"""Path columns.  A path is relative to its project's root and uses '/'."""

from pyspark.sql import Column, functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Directory that holds the path; '' is the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension: its dot is neither first nor last in the name."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def depth(path: Column) -> Column:
    """Number of components; 0 for the root."""
    return F.when(path == "", 0).otherwise(F.size(parts(path)))


def ancestors(path: Column, own: bool = False) -> Column:
    """Directories above the path, the root ('') first; with `own` the path too."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    chain = F.transform(F.sequence(F.lit(0), slashes + int(own)),
                        lambda n: F.call_function("substring_index", path, F.lit("/"), n))
    root = F.array(F.lit("")) if own else F.array().cast("array<string>")
    return F.when(path == "", root).otherwise(chain)


def preorder_key(path: Column) -> Column:
    """String in whose binary order a directory is followed by all that lies below it, and
    by nothing else before `preorder_end`; the root's is ''."""
    return F.when(path == "", "").otherwise(F.concat(F.replace(path, F.lit("/"), F.lit("\0")), F.lit("\0")))


def preorder_end(path: Column) -> Column:
    """Bound that is above the keys below a directory other than the root and no key's equal."""
    return F.concat(F.replace(path, F.lit("/"), F.lit("\0")), F.lit("\1"))


def _piece(flag: Column, name: Column) -> Column:
    return F.concat(flag, F.lower(name), F.lit("\0"), name, F.lit("\0"))


def order_key(path: Column, is_dir: Column) -> Column:
    """String whose binary order is the document's and the tree's order.

    In every directory subdirectories come first, each followed by its whole
    subtree, then the rest; by lower-cased name, equal ones by name.  Every
    component becomes flag, lower-cased name, NUL, name, NUL; since a path holds
    no NUL, a shorter name sorts before its extensions and a directory before
    its contents.  The root's key is ''.
    """
    folder = parent(path)
    above = F.when(folder == "", "").otherwise(F.array_join(
        F.transform(parts(folder), lambda name: _piece(F.lit("0"), name)), ""))
    leaf = _piece(F.when(is_dir, "0").otherwise("1"), base_name(path))
    return F.when(path == "", "").otherwise(F.concat(above, leaf))
