import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packmill import PackOptions, pack_table
from packmill.constants import LEFTOVER_NAME
from packmill.functions import text as tx
from packmill.operators import lookup as lookup_module
from packmill.operators.balance import key_bounds, part_number
from packmill.operators.durable import durable
from packmill.operators.keyset import KeySet
from packmill.plans import exact, pack as pack_module
from sample import SAMPLE

STAMP = "2026-01-01 00:00:00"


def options(**kwargs):
    return PackOptions(generated_at=STAMP, **kwargs)


def packed(doc):
    return re.findall(r"^--- START OF FILE: (.*) ---$", doc, re.M)


TREE = """sample/
├── media/
├── notes/
│   └── plan.md
├── web/
│   ├── app.ts
│   └── empty.ts
├── .gitignore
├── Dockerfile
├── pipeline.yaml
└── zeta.rs"""
ORDER = ["notes/plan.md", "web/app.ts", "web/empty.ts", ".gitignore", "Dockerfile", "pipeline.yaml", "zeta.rs"]
RULER = "=" * 80


def expected_document(fmt, tree, tokens, lines):
    stats = ["Project: sample", f"Generated on: {STAMP}", "Total files packed: 7", f"Total lines: {lines}",
             f"Estimated tokens: ~{tokens}"]
    if fmt == "text":
        head = "\n".join([RULER, "PROJECT CONTEXT PACK: sample", *stats[1:], RULER]) + "\n\n"
        if tree:
            head += f"{RULER}\nDIRECTORY TREE\n{RULER}\n{TREE}\n\n"
        head += f"{RULER}\nFILES CONTENT\n{RULER}\n\n"
        blocks = [f"--- START OF FILE: {p} ---\n{SAMPLE[p]}\n--- END OF FILE: {p} ---" for p in ORDER]
    else:
        head = "# Project Context Pack\n" + "\n".join(f"- {s}" for s in stats) + "\n\n"
        if tree:
            head += f"## Directory Tree\n\n```text\n{TREE}\n```\n\n"
        head += "## Files Content\n\n"
        tags = {".ts": "typescript", ".md": "markdown", ".yaml": "yaml", ".rs": "rust"}
        blocks = []
        for p in ORDER:
            body = SAMPLE[p] if SAMPLE[p].endswith("\n") else SAMPLE[p] + "\n"
            tag = next((t for e, t in tags.items() if p.endswith(e)), "")
            blocks.append(f"### `{p}`\n```{tag}\n{body}```")
    return head + "\n\n".join(blocks) + "\n"


@pytest.mark.parametrize("fmt", ["text", "markdown"])
@pytest.mark.parametrize("tree", [True, False])
def test_sample_document_byte_for_byte(files, document, fmt, tree):
    df = files(SAMPLE)
    doc, report = document(pack_table(df, options(output_format=fmt, include_tree=tree)))
    draft = expected_document(fmt, tree, "0 ()", 0)
    tokens = int(len(draft) / 4 + 0.5)
    want = expected_document(fmt, tree, f"{tokens} (heuristic (~4 chars/token))", draft.count("\n"))
    assert doc == want
    assert report.asDict() == {
        "project_id": "sample", "project_name": "sample", "packed_count": 7, "failed_count": 0,
        "file_size": len(want.encode()), "total_lines": want.count("\n"), "total_source_lines": 7,
        "estimated_tokens": tokens, "token_method": "heuristic (~4 chars/token)", "output_format": fmt,
        "include_tree": tree}


def test_options_are_checked():
    with pytest.raises(ValueError):
        PackOptions(output_format="xml")
    with pytest.raises(ValueError):
        PackOptions(max_file_size="12 furlongs")
    with pytest.raises(ValueError):
        PackOptions(token_counting="maybe")
    assert PackOptions(max_file_size="1.5KB").max_file_size == 1536


def test_skips_sizes_crlf_and_leftovers(files, document):
    df = files({"tiny.go": "var x", "log/huge.csv": "1,2,3\n" * 900, "raw/tape": b"ab\0cd", "dos.bat": "echo on\r\ncls\r\n",
                LEFTOVER_NAME: "from before", f"wiki/{LEFTOVER_NAME}": "a page of that name", "torn.xml": b"\xfe\xff\0a\0",
                "menu.txt": "борщ і вареники\n" * 90, "old_menu.txt": "вареники".encode("cp1251")})
    doc, report = document(pack_table(df, options(max_file_size=4096)))
    assert packed(doc) == [f"wiki/{LEFTOVER_NAME}", "dos.bat", "menu.txt", "old_menu.txt", "tiny.go"]
    assert "huge.csv  [skipped: exceeds size limit (4.0 KB)]\n" in doc
    assert "tape  [skipped: binary file]\n" in doc
    assert "torn.xml  [skipped: encoding error (invalid BOM-marked content)]\n" in doc
    assert "--- START OF FILE: dos.bat ---\necho on\r\ncls\r\n\n--- END" in doc and "\r\r\n" not in doc
    assert "Skipped files: 3 (marked in the tree / see warnings)\n" in doc
    assert "from before" not in doc and f"── {LEFTOVER_NAME}\n" not in doc.replace(f"│   └── {LEFTOVER_NAME}\n", "")
    assert (report.packed_count, report.failed_count) == (5, 3)
    assert report.file_size == len(doc.encode()) > len(doc)
    assert report.total_lines == doc.count("\n")
    pack = pack_table(df, options(max_file_size=4096))
    assert {r.rel_path: r.skip_reason for r in pack.skips.collect()}["raw/tape"] == "binary file"
    assert [r.rel_path for r in pack.facts.where("transcoded").collect()] == ["old_menu.txt"]


def test_globs_output_file_and_extra_filter(files):
    def kept(**kwargs):
        return {r.rel_path for r in pack_table(files(SAMPLE), options(**kwargs)).facts.collect()}
    assert kept() == set(ORDER)
    assert kept(exclude_patterns=["notes/*", "*.rs"]) == set(ORDER) - {"notes/plan.md", "zeta.rs"}
    assert kept(output_path="web/app.ts") == kept(output_path="web/app.ts/") == set(ORDER) - {"web/app.ts"}
    assert kept(output_path="web") == set(ORDER) - {"web/app.ts", "web/empty.ts"}
    assert kept(extra_filter="rel_path not like 'web/%'") == set(ORDER) - {"web/app.ts", "web/empty.ts"}


def test_extra_filter_is_a_layer(files):
    pack = pack_table(files(SAMPLE), options(extra_filter="case when rel_path like 'web/%' then null else true end"))
    reasons = {r.rel_path: r.ignore_reason for r in pack.entries.collect()}
    assert reasons["web/app.ts"] == "extra_filter" and reasons["zeta.rs"] is None and reasons[".env"] == "hidden"
    assert "├── web/" in [r.line for r in pack.tree.collect()]


def exchanges(plan):
    """Per exchange of a formatted plan the names of the columns that pass it."""
    lines = plan.split("\n")
    return [set(re.findall(r"([a-zA-Z_0-9]+)#\d+", lines[k + 1])) for k, line in enumerate(lines)
            if re.search(r"^\(\d+\) (Broadcast)?Exchange", line)]


def exchanged(plan):
    return set().union(*exchanges(plan))


def test_contents_travel_once(spark, files, monkeypatch):
    """Verdicts meet narrow rows, also when no table is small enough to broadcast."""
    monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup_module, "HOT_KEYS", 2)
    content = {f"d{n % 3}/f{n}.py": f"x = {n}\n" for n in range(40)}
    content |= {".gitignore": "f7.py\nf8.py\n", "d1/.gitignore": "!f7.py\n*4.py\n"}
    kept_tables = []
    monkeypatch.setattr(pack_module, "durable", lambda df: (kept_tables.append(df), durable(df))[1])
    pack = pack_table(files(content), options())
    found = {r.rel_path for r in pack.facts.collect()}
    assert found == set(content) - {"d2/f8.py", "d1/f4.py", "d1/f34.py"}

    def plan(df):
        return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    facts = plan(next(df for df in kept_tables if "adds" in df.columns))
    assert exchanged(facts) and not {"content", "text", "row"} & exchanged(facts)
    # blocks of files that ignore files drop are not in the shuffle of the document, which is its only one
    document = plan(pack.sections)
    assert "content" not in exchanged(document) and "rangepartitioning" not in document
    assert len([1 for columns in exchanges(document) if "text" in columns]) == 1
    blocks = {r.text for r in pack._texts().where(F.col("section") == pack_module.BLOCK).collect()}
    assert len(blocks) == len(found) and not any("f8.py" in b and "d2/" in b or "f34.py" in b for b in blocks)


def test_tokens_off(files, document):
    doc, report = document(pack_table(files(SAMPLE), options(token_counting="off")))
    assert "Estimated tokens: disabled\n" in doc
    assert (report.estimated_tokens, report.token_method) == (0, "disabled")


def test_empty_project(spark, document):
    df = spark.createDataFrame([("p/empty", "", "dir", None)],
                               "project_id string, rel_path string, kind string, content binary")
    for fmt in ("text", "markdown"):
        for tree in (True, False):
            doc, report = document(pack_table(df, options(output_format=fmt, include_tree=tree)))
            assert "Total files packed: 0\n" in doc and doc.endswith("\n\n\n")
            assert report.project_name == "empty" and report.total_lines == doc.count("\n")
            assert report.file_size == len(doc.encode())
            assert ("empty/\n" in doc) == tree


def test_many_projects_and_one_file_each(spark, tmp_path):
    rows = [(f"p{n % 7}", f"d{n % 3}/f{n}.py", f"x = {n}\n".encode()) for n in range(60)]
    df = spark.createDataFrame(rows, "project_id string, rel_path string, content binary")
    pack = pack_table(df, options())
    target = str(tmp_path / "docs")
    report = {r.project_id: r for r in pack.write(target, per_project=True).collect()}
    for n in range(7):
        parts = sorted((tmp_path / "docs" / f"project_id=p{n}").glob("part-*"))
        doc = "".join(p.read_text(encoding="utf-8") for p in parts)
        mine = sorted((r for r in rows if r[0] == f"p{n}"), key=lambda r: r[1].split("/"))
        assert packed(doc) == [r[1] for r in mine]
        assert report[f"p{n}"].packed_count == len(mine)
        assert report[f"p{n}"].file_size == len(doc.encode())
        assert report[f"p{n}"].total_lines == doc.count("\n")


def test_write_failure_is_an_oserror(files):
    with pytest.raises(OSError, match="cannot write"):
        pack_table(files({"a.py": "x"}), options()).write("nosuchscheme://place/o")


def brute_tree(paths, root):
    out = [root + "/"]

    def walk(prefix, entries):
        names = sorted(entries, key=lambda n: (not isinstance(entries[n], dict), n.lower(), n))
        for i, name in enumerate(names):
            last, sub = i == len(names) - 1, entries[name]
            out.append(prefix + ("└── " if last else "├── ") + name + ("/" if isinstance(sub, dict) else ""))
            if isinstance(sub, dict):
                walk(prefix + ("    " if last else "│   "), sub)
    top = {}
    for path in paths:
        here, parts = top, path.split("/")
        for part in parts[:-1]:
            here = here.setdefault(part, {})
        here[parts[-1]] = None
    walk("", top)
    return out


@pytest.mark.parametrize("small", [True, False])
def test_tree_against_recursion(spark, monkeypatch, small):
    """Also with tables too large to broadcast and one directory that owns most files."""
    if not small:
        monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup_module, "HOT_KEYS", 2)
    paths = [f"hot/f{n}" for n in range(200)] + [f"a{n % 5}/b{n % 3}/c{n % 2}/x{n}.py" for n in range(60)] + [
        "A0/q", "a0/Q", "z", "Z1/y", "hot/sub/one"]
    df = spark.createDataFrame([("p", x, b"") for x in paths], "project_id string, rel_path string, content binary")
    got = [r.line for r in pack_table(df, options()).tree.orderBy("sort_key").collect()]
    assert got == brute_tree(paths, "p")


def test_deep_nesting(spark):
    deep = "/".join(["d"] * 1100) + "/leaf.py"
    df = spark.createDataFrame([("deep", deep, b"x=1")], "project_id string, rel_path string, content binary")
    pack = pack_table(df, options())
    lines = [r.line for r in pack.tree.orderBy("sort_key").collect()]
    assert len(lines) == 1102 and lines[-1] == "    " * 1100 + "└── leaf.py"
    assert pack.report.first().packed_count == 1


# ---- exact tokens

def small_encoder():
    """Loader of a small vocabulary with the usual way of cutting a text into pieces; a
    function in a function, so that it travels to the Python workers by value."""
    def byte_pair_encoder():
        import tiktoken
        ranks = {bytes([b]): b for b in range(256)}
        for pair in (b"\n\n", b"==", b"====", b"--", b"---", b" ---", b"``", b"```", b"```\n", b" ---\n", b" ---\n\n",
                     b"```\n\n", b"\n\n\n", b"in", b"th", b"  ", b"    ", b"===\n", b"=\n", b"=\n\n", b")\n", b")\n\n"):
            ranks[pair] = len(ranks)
        pattern = (r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|"""
                   r"""\s*[\r\n]|\s+(?!\S)|\s""")
        return tiktoken.Encoding("small", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|end|>": len(ranks)})
    return byte_pair_encoder


@pytest.mark.parametrize("fmt", ["text", "markdown"])
@pytest.mark.parametrize("tree", [True, False])
def test_exact_tokens_add_up(files, document, monkeypatch, fmt, tree):
    """The sum over the parts is the count of the whole draft."""
    encoder = small_encoder()
    monkeypatch.setattr(exact, "count_tokens", tx.exact_token_counter(encoder))
    monkeypatch.setattr(pack_module.exact, "count_tokens", exact.count_tokens)
    content = {**SAMPLE, "z (1)/x).py": "a\n\n  \n", "q.md": "````\n```", "empty.txt": "", "n.txt": "\n\n", "w ": " x "}
    doc, report = document(pack_table(files(content), options(
        output_format=fmt, include_tree=tree, token_counting="exact")))
    assert report.token_method == "cl100k_base (tiktoken)"
    draft = re.sub(r"(Total lines: )\d+", r"\g<1>0", doc, count=1)
    draft = draft.replace(f"~{report.estimated_tokens} (cl100k_base (tiktoken))", "~0 ()", 1)
    assert report.estimated_tokens == len(encoder().encode(draft))


def test_special_token_falls_back(files, document, monkeypatch):
    monkeypatch.setattr(exact, "count_tokens", tx.exact_token_counter(small_encoder()))
    _, report = document(pack_table(files({"a.txt": "x <|end|> y"}), options(token_counting="exact")))
    assert report.token_method == "heuristic (~4 chars/token)" and report.estimated_tokens > 0


def test_missing_vocabulary_falls_back(files, document, monkeypatch):
    def missing():
        raise OSError("no vocabulary")
    monkeypatch.setattr(exact, "count_tokens", tx.exact_token_counter(missing))
    heuristic = document(pack_table(files(SAMPLE), options()))[1].estimated_tokens
    _, report = document(pack_table(files(SAMPLE), options(token_counting="exact")))
    assert (report.estimated_tokens, report.token_method) == (heuristic, "heuristic (~4 chars/token)")


def test_document_without_rules_needs_no_key_filter(files):
    pack = pack_table(files({"a.py": "x", "b/c.py": "y"}), options())
    pack.sections.collect()
    assert not pack._undecided and "_packed" not in pack.__dict__


def test_false_matches_of_the_key_filter_are_dropped(files, document, monkeypatch):
    content = {f"d{n % 3}/f{n}.py": f"x = {n}\n" for n in range(40)} | {".gitignore": "*7.py\nd1/\n"}
    expected, _ = document(pack_table(files(content), options()))
    monkeypatch.setattr(KeySet, "holds", lambda self: F.lit(True))
    assert document(pack_table(files(content), options()))[0] == expected
    assert "f6.py" in expected and "f27.py" not in expected


def test_key_set(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("name"), (F.col("id") % 7).alias("part"))
    held = KeySet(keys, ["name", "part"])
    others = spark.range(20000).select(F.concat(F.lit("z"), "id").alias("name"), (F.col("id") % 7).alias("part"))
    assert keys.where(held.holds()).count() == 5000
    assert others.where(held.holds()).count() < 20000 / 40
    assert others.where(KeySet(keys.where("false"), ["name", "part"]).holds()).count() == 0


def test_parts_of_equal_bytes(spark, files):
    """One project, files of mixed sizes whose names are in the order of their size."""
    content = {f"f{n:04d}.py": "x" * (10 + n * n % 3000 + (4000 if n > 350 else 0)) for n in range(400)}
    pack = pack_table(files(content), options())
    rows = pack.sections.withColumn("part", F.spark_partition_id()).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.part] += len(r.text) + 1
    assert [r.part for r in rows] == sorted(r.part for r in rows) and len(sizes) == 4
    assert max(sizes.values()) <= 1.5 * sum(sizes.values()) / len(sizes)


def test_bounds_cut_by_weight(spark):
    rows = [(f"k{n:03d}", 1) for n in range(100)] + [("k050x", 300), ("k050y", 300)]
    df = spark.createDataFrame(rows, "key string, bytes long")
    bounds = key_bounds(df, "key", "bytes", 7)
    assert bounds == sorted(bounds) and len(bounds) == 6
    number = {r.key: r.n for r in df.select("key", part_number(F.col("key"), bounds).alias("n")).collect()}
    assert all(number[k] == sum(b <= k for b in bounds) for k, _ in rows)
    assert number["k000"] == 0 and number["k050x"] < number["k050y"] and number["k099"] == 6
    assert key_bounds(df.where("false"), "key", "bytes", 7) == [] == key_bounds(df, "key", "bytes", 1)
    assert spark.range(1).select(part_number(F.lit("k"), [])).first()[0] == 0
