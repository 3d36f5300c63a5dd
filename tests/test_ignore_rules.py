import re

from pyspark.sql import functions as F

from packmill.constants import TOOL_IGNORE_FILE
from packmill import PackOptions, pack_table
from packmill.operators import inventory, lookup as lookup_module, rules


def verdicts(spark, ignore_files, paths):
    files = spark.createDataFrame(
        [("p", d, n, t.encode() if isinstance(t, str) else t) for (d, n), t in ignore_files.items()],
        "project_id string, dir string, name string, content binary")
    entries = inventory.manifest(spark.createDataFrame(
        [("p", p) for p in paths], "project_id string, rel_path string"))
    programs = rules.programs(rules.rules(rules.ignore_lines(files)))
    found = rules.directory_verdicts(inventory.directories(entries), programs)
    return {r.rel_path: r.rule_ignored for r in rules.with_verdict(entries, found).collect()}


# ---- brute force: every line matched component by component, the last match decides

def component_matches(glob, name):
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        if ch == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and glob.find("]", i + 2 + (glob[i + 1:i + 2] in ("!", "^"))) > 0:
            end = glob.find("]", i + 2 + (glob[i + 1:i + 2] in ("!", "^")))
            body = glob[i + 1:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return re.fullmatch(out, name, re.S) is not None


def segments_match(globs, names):
    if not globs:
        return not names
    if globs[0] == "**":
        if len(globs) == 1:
            return bool(names)
        return any(segments_match(globs[1:], names[n:]) for n in range(len(names) + 1))
    return bool(names) and component_matches(globs[0], names[0]) and segments_match(globs[1:], names[1:])


def line_matches(line, scope, path, is_dir):
    names = path.split("/")
    above = scope.split("/") if scope else []
    if names[:len(above)] != above or len(names) == len(above):
        return False
    names = names[len(above):]
    only_dirs, pattern = line.endswith("/"), line.rstrip("/") if line != "**/" else "**"
    anchored = bool(scope) or "/" in pattern
    globs = pattern.lstrip("/").split("/")
    if not anchored and globs != ["**"]:
        globs = ["**", *globs]
    # the pattern covers the thing itself or a directory above
    for n in range(1, len(names) + 1):
        inner = n < len(names)
        if segments_match(globs, names[:n]) and (inner or is_dir or not only_dirs):
            return True
    return False


def brute(ignore_files, path):
    ordered = []
    for (scope, name), text in ignore_files.items():
        level = len(scope.split("/")) if scope else 0
        for number, line in enumerate(text.splitlines()):
            line = line.strip()
            if line and not line.startswith("#"):
                ordered.append(((level, name != ".gitignore", scope, number), scope, line))
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        state = False
        for _, scope, line in sorted(ordered):
            negated = line.startswith("!")
            if line_matches(line[1:] if negated else line, scope, "/".join(parts[:n]), n < len(parts)):
                state = not negated
        if state:
            return True
    return False


PATHS = ["a.log", "src/a.log", "src/deep/a.log", "keep.log", "src/keep.log", "data/x.txt", "src/data/x.txt", "data",
         "docs/a.md", "docs/deep/b.md", "docs/deep/er/c.md", "foo/bar/x", "bar/x", "foo/x/y/bar", "x#y", "#x",
         "!x", "a b", "f1.py", "f[1].py", "fx.py", "a.b+c", "foo", "src/foo", "foo/a", "x/y/z/foo/q", "a-b", "Äx", "q/Äx"]


CASES = [
    {("", ".gitignore"): "*.log\n!keep.log\n"}, {("", ".gitignore"): "data/\n"},
    {("", ".gitignore"): "/data\n/src/*.log\n"}, {("", ".gitignore"): "docs/*\n!docs/deep\n"},
    {("", ".gitignore"): "docs/\n!docs/deep\n"}, {("", ".gitignore"): "foo/**/bar\n"},
    {("", ".gitignore"): "**/foo\n"}, {("", ".gitignore"): "foo/**\n"}, {("", ".gitignore"): "**/deep/**\n"},
    {("", ".gitignore"): "\\#x\n\\!x\n"}, {("", ".gitignore"): "f[0-9].py\nf\\[1\\].py\n"},
    {("", ".gitignore"): "f[!0-9].py\n"}, {("", ".gitignore"): "f[^0-9].py\n"}, {("", ".gitignore"): "a.b+c\na b\n"},
    {("", ".gitignore"): "**\n!src\n!src/**\n"}, {("", ".gitignore"): "*\n!*.py\n"}, {("", ".gitignore"): "?.log\n"},
    {("", ".gitignore"): "a[-]b\nÄ*\n"}, {("src", ".gitignore"): "*.log\n"}, {("src", ".gitignore"): "/deep\n/\n!\n"},
    {("src", ".gitignore"): "**/a.log\n!a.log\n"}, {("docs", ".gitignore"): "deep/\n!deep/er\n"},
    {("", ".gitignore"): "*.log\n", ("src", ".gitignore"): "!a.log\n"},
    {("", ".gitignore"): "*.log\n", ("", TOOL_IGNORE_FILE): "!keep.log\n"},
    {("", ".gitignore"): "!keep.log\n", ("", TOOL_IGNORE_FILE): "*.log\n"},
    {("", ".gitignore"): "  *.log  \r\n\r\n# c\r\n!keep.log\r\n"}, {("", ".gitignore"): "**/**/foo\n"},
    {("", ".gitignore"): "foo/**/**/bar\n"}, {("", ".gitignore"): "a.log\n!a.log\nsrc/a.log\n!*.log\n*.md\n!docs/a.md\n"}]


def test_rules_against_brute_force(spark):
    """Every case a project of its own."""
    files = spark.createDataFrame(
        [(f"p{i}", d, n, t.encode()) for i, case in enumerate(CASES) for (d, n), t in case.items()],
        "project_id string, dir string, name string, content binary")
    entries = inventory.manifest(spark.createDataFrame(
        [(f"p{i}", p) for i in range(len(CASES)) for p in PATHS], "project_id string, rel_path string"))
    programs = rules.programs(rules.rules(rules.ignore_lines(files)))
    found = rules.directory_verdicts(inventory.directories(entries), programs)
    got = {(r.project_id, r.rel_path): r.rule_ignored for r in rules.with_verdict(entries, found).collect()}
    wrong = {(i, p): got[f"p{i}", p] for i, case in enumerate(CASES) for p in PATHS
             if got[f"p{i}", p] != brute(case, p)}
    assert not wrong and len(got) == len(CASES) * len(PATHS)


def test_rules_with_large_tables(spark, monkeypatch):
    """The way without broadcasting the whole table gives the same verdicts."""
    monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup_module, "HOT_KEYS", 2)
    files = {("", ".gitignore"): "*.log\n!keep.log\n", ("src", ".gitignore"): "!a.log\n", ("docs", ".gitignore"): "deep/\n"}
    assert verdicts(spark, files, PATHS) == {p: brute(files, p) for p in PATHS}


def test_root_slash_and_reversed_class_match_nothing(spark):
    got = verdicts(spark, {("", ".gitignore"): "/\n!\nf[9-0].py\n"}, ["f1.py", "a"])
    assert not any(got.values())


def test_byte_order_mark_and_bad_bytes(spark):
    got = verdicts(spark, {("", ".gitignore"): b"\xef\xbb\xbf*.log\n\xff\xfe\nfoo"}, ["a.log", "foo", "bar"])
    assert got == {"a.log": True, "foo": True, "bar": False}


def test_lines_split_like_python(spark):
    text = "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h\n\ni\n"
    df = spark.createDataFrame([("p", "", ".gitignore", text.encode())],
                               "project_id string, dir string, name string, content binary")
    got = [r.line for r in rules.ignore_lines(df).orderBy("line_no").collect()]
    assert got == text.splitlines()


def test_directory_name_with_special_characters_is_literal(spark):
    got = verdicts(spark, {("a[1]*", ".gitignore"): "x\n"}, ["a[1]*/x", "a1/x", "a1b/x"])
    assert got == {"a[1]*/x": True, "a1/x": False, "a1b/x": False}


def test_rule_order(spark):
    lines = spark.createDataFrame(
        [("p", d, n, i, f"{d}{n}{i}") for d in ("", "b", "a", "a/c") for n in (TOOL_IGNORE_FILE, ".gitignore")
         for i in (1, 2)], "project_id string, dir string, name string, line_no int, line string")
    got = [(r.rule_order.dir, r.rule_order.is_tool, r.rule_order.line_no)
           for r in rules.rules(lines).orderBy("rule_order").collect()]
    assert got == [(d, tool, n) for d, tool, n in sorted(
        [(d, tool, n) for d in ("", "b", "a", "a/c") for tool in (False, True) for n in (1, 2)],
        key=lambda x: (len(x[0].split("/")) if x[0] else 0, x[1], x[0], x[2]))]


def test_ignore_files_in_ignored_directories_do_not_count(spark, files):
    df = files({"build/.gitignore": "*\n", "x.egg-info/.gitignore": "*\n", ".hid/.gitignore": "*\n",
                "a/.gitignore": "*.log\n", "a/x.log": "", "b/x.log": ""})
    found = {r.dir for r in rules.ignore_files(inventory.manifest(df)).collect()}
    assert found == {".hid", "a"}


def test_opting_out(spark, files):
    df = files({".gitignore": "/drafts/\nsketch-?\n", "drafts/one.tex": "", "lib/sketch-2": "", "paper.tex": ""})

    def kept(**options):
        entries = pack_table(df, PackOptions(**options)).entries.where("ignore_reason is null")
        return {r.rel_path for r in entries.collect()}

    assert kept(respect_ignore_files=False) - kept() == {"drafts/one.tex", "lib/sketch-2"}
    assert kept() == {".gitignore", "paper.tex"}
