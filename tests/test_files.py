"""Documents as one file each."""

import os

import pytest
from pyspark.sql import functions as F

from packmill import PackOptions, pack_directory, pack_table
from packmill.sources import documents
from packmill.sources.documents import document_name

STAMP = "2026-01-01 00:00:00"


def joined(pack):
    out = {}
    for r in pack.sections.collect():
        out[r.project_id] = out.get(r.project_id, "") + r.text + "\n"
    return out


def test_a_file_for_each_project(spark, tmp_path, monkeypatch):
    """Projects that many tasks share, and several of one task."""
    monkeypatch.setattr(documents, "_BUFFER", 100)
    rows = [("big/one", f"d{n % 5}/f{n}.py", f"x = '{'é' * (n % 90)}'\n".encode()) for n in range(300)]
    rows += [(f"p{n}", "a.md", b"text") for n in range(6)] + [("big/one", ".gitignore", b"f7.py\n")]
    df = spark.createDataFrame(rows, "project_id string, rel_path string, content binary")
    pack = pack_table(df, PackOptions(generated_at=STAMP))
    target = tmp_path / "out"
    target.mkdir()
    (target / "p1.txt").write_text("an older and longer document" * 1000)
    report = {r.project_id: r.file_size for r in pack.write_files(str(target)).collect()}
    expected = joined(pack)
    assert len(pack._bounds) == 3 and set(expected) == set(report) and len(report) == 7
    found = {os.path.relpath(os.path.join(d, f), target): os.path.join(d, f) for d, _, names in os.walk(target) for f in names}
    assert set(found) == {document_name(p, ".txt") for p in report}
    for project, text in expected.items():
        whole = open(found[document_name(project, ".txt")], "rb").read()
        assert whole == text.encode() and len(whole) == report[project]
    assert "f7.py" not in expected["big/one"].split("\n\n")[-1] and os.listdir(tmp_path) == ["out"]


def test_the_file_of_a_directory(spark, write_tree):
    root = write_tree({"a.py": "x = 1\n", "lib/b.md": "text"})
    out = root / "context.md"
    out.write_text("from an earlier run")
    report = pack_directory(spark, str(root), PackOptions(generated_at=STAMP, output_format="markdown")).write_files(str(out)).first()
    text = out.read_text()
    assert text.startswith("# ") and text.endswith("\n") and "earlier" not in text and "context.md" not in text
    assert (report.packed_count, report.file_size) == (2, len(text.encode())) and sorted(os.listdir(root)) == ["a.py", "context.md", "lib"]


def test_nothing_is_left_of_a_failure(spark, files, tmp_path):
    pack = pack_table(files({"a.py": "x"}), PackOptions(generated_at=STAMP))
    blocked = tmp_path / "folder"
    (blocked / "sample.txt").mkdir(parents=True)
    with pytest.raises(OSError):
        pack.write_files(str(blocked))
    # texts that are not what the statistics say
    pack = pack_table(files({"a.py": "x"}), PackOptions(generated_at=STAMP))
    pack.__dict__["facts"] = pack.facts.withColumn("adds", F.struct("adds.lines", "adds.chars", (F.col("adds.bytes") + 1).alias("bytes")))
    with pytest.raises(OSError, match="expected"):
        pack.write_files(str(tmp_path / "other"))
    assert os.listdir(tmp_path) == ["folder"] and os.listdir(blocked) == ["sample.txt"]
    outside = pack_table(files({"a.py": "x"}, project="../up"), PackOptions(generated_at=STAMP))
    with pytest.raises(OSError):
        outside.write_files(str(tmp_path / "other"))
    assert os.listdir(tmp_path) == ["folder"]
