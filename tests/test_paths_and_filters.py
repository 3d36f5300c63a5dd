import fnmatch

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from packmill.constants import LEFTOVER_NAME
from packmill.functions.paths import ancestors, base_name, depth, order_key, parent, suffix
from packmill.functions.patterns import exclude_regex, excluded
from packmill.operators.filters import builtin_reason, is_leftover, size_reason
from packmill.operators.inventory import directories, manifest


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_path_parts(spark):
    paths = ["a.tar.gz", "x/.gitignore", "x.", "A/B.PY", "noext", "..a", "d/e/f.b\n"]
    assert column(spark, paths, suffix) == [".gz", "", "", ".py", "", ".a", ".b\n"]
    assert column(spark, paths, base_name) == ["a.tar.gz", ".gitignore", "x.", "B.PY", "noext", "..a", "f.b\n"]
    assert column(spark, paths, parent) == ["", "x", "", "A", "", "", "d/e"]
    assert column(spark, ["", "a", "a/b"], depth) == [0, 1, 2]
    assert column(spark, ["", "a", "a/b/c"], ancestors) == [[], [""], ["", "a", "a/b"]]
    assert column(spark, ["", "a"], lambda p: ancestors(p, own=True)) == [[""], ["", "a"]]


def test_order_directories_first_then_names(spark):
    paths = ["w.rs", "k.rs", "lib/n.rs", "lib/m.rs", "lib/low/o.rs", "B/x", "b0", "b", "a0/x", "a/x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r.p for r in df.orderBy(order_key(F.col("p"), F.lit(False))).collect()]
    assert got == ["a/x", "a0/x", "B/x", "lib/low/o.rs", "lib/m.rs", "lib/n.rs", "b", "b0", "k.rs", "w.rs"]


LAYERS = [
    ("src/main.py", True, None), ("node_modules/x.js", True, "ignored_name"), ("BUILD/x.py", True, "ignored_name"),
    ("dist", True, None), ("env", True, None), ("build", True, None), ("venv", True, None),
    ("dist", False, "ignored_name"), ("pkg.egg-info/PKG", True, "egg_info"), ("x.EGG-INFO", True, "egg_info"),
    (".hidden/x", True, "hidden"), (".gitignore", True, None), (".EditorConfig", True, None),
    (".env.example/x", True, None), ("a/.secret", True, "hidden"), ("a.PNG", True, "binary_extension"),
    ("a.png", False, None), ("Desktop.ini", True, "junk_name"), (".env", True, "hidden"),
    ("Thumbs.db", True, "binary_extension"), ("Thumbs.db", False, None), (".DS_Store", True, "hidden"),
    ("my.build/x", True, None), ("buildx/y", True, None), ("a/..b", True, "hidden"),
    (".gitignore.bak", True, "hidden")]


def test_builtin_layers(spark):
    df = spark.createDataFrame([(p, f) for p, f, _ in LAYERS], "p string, f boolean")
    got = df.select("p", "f", builtin_reason(F.col("p"), F.col("f")).alias("r")).collect()
    assert [(r.p, r.f, r.r) for r in got] == LAYERS


def test_leftover_and_size(spark):
    assert column(spark, [LEFTOVER_NAME, f"wiki/{LEFTOVER_NAME}"],
                  lambda p: is_leftover(p, F.lit("file"))) == [True, False]
    df = spark.createDataFrame([(1024,), (1025,)], "n long")
    assert [r[0] for r in df.select(size_reason(F.col("n"), 1024)).collect()] == [
        None, "exceeds size limit (1.0 KB)"]


def covered(paths, patterns):
    """The paths that patterns leave out: each pattern names a set of entries, and what is below these goes too."""
    folders = {p[:at] for p in paths for at, c in enumerate(p) if c == "/"}
    whole = folders | set(paths)
    below = {p for p in patterns if p.endswith("/") and p[:-1] in folders}
    globs = [p for p in patterns if not p.endswith("/")]
    names = {e: e.rpartition("/")[2] for e in whole}
    fits = {x for g in globs for x in fnmatch.filter(whole | set(names.values()), g)}
    named = {e + "/" for e in whole if e in fits or names[e] in fits}
    return [p.startswith(tuple(below)) or (p + "/").startswith(tuple(named)) for p in paths]


PATHS = ["docs/deep/guide.rs", "docs", "docs/x", "a.log", "src/a.log", "build", "build/x", "x/build/y",
         "src/a_1.py", "src/b_2.py", "a-b", "a]b", "[x]", "a.log\n", "src/[x]/y", "ab/c", "src/docs/x", "a^b"]


@pytest.mark.parametrize("patterns", [
    ["docs/*"], ["*.log"], ["build/"], ["/"], ["src/"], ["[a-b]*"], ["[!a-b]*"], ["?"], ["src/?_[12].py"],
    ["[x"], ["[]x]*"], ["a[]-]b"], ["[b-a]*"], ["[!b-a]*"], ["*/a*"], ["src", "docs/"], ["a[a-b-c]b"],
    ["[[]x]"], ["**/x"], ["a[!^]b"], ["a[^-]b"], ["", "x"]])
def test_globs_match_like_fnmatch(spark, patterns):
    got = column(spark, PATHS, lambda p: excluded(p, F.lit(False), patterns))
    assert got == covered(PATHS, patterns)


def test_directory_is_kept_when_only_its_contents_match(spark):
    dirs = ["docs", "docs/deep", "build", "x/build"]
    assert column(spark, dirs, lambda p: excluded(p, F.lit(True), ["docs/*", "build/"])) == [
        False, True, True, False]
    assert exclude_regex(["/"]) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab*?[]!-/", min_size=1, max_size=6), min_size=1, max_size=3))
def test_random_globs(spark, patterns):
    paths = ["a", "b", "ab", "a/b", "a-b", "a]b", "b/a/b", "a!b", "[a]", "ab/ab/a"]
    got = column(spark, paths, lambda p: excluded(p, F.lit(False), patterns))
    assert got == covered(paths, patterns)


def test_directories_are_implied_and_listed(spark):
    df = spark.createDataFrame([("p", "a/b/c.py", "file"), ("p", "a/x.py", "file"), ("p", "empty", "dir"),
                                ("q", "r.py", "file")], "project_id string, rel_path string, kind string")
    got = {(r.project_id, r.dir): r.entries for r in directories(manifest(df)).collect()}
    assert got == {("p", ""): 1, ("p", "a"): 1, ("p", "a/b"): 1, ("p", "empty"): 0, ("q", ""): 1}
