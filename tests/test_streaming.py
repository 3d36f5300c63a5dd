from pyspark.sql import functions as F

from packmill.options import PackOptions
from packmill.streaming.facts import file_facts, write_facts

SCHEMA = "project_id string, rel_path string, content binary"
FIRST = [("p", "src/main.py", b"print(1)\n"), ("p", "notes/wide.txt", b"\xff\xfe" + "höhe\n".encode("utf-16-le")),
         ("p", "notes/odd.txt", b"\xff\xfea"), ("p", "blob", b"a\0b"), ("p", "empty", b""), ("p", "gone", None),
         ("q", "node_modules/x.js", b"x"), ("q", "tmp/y", b"y"), ("q", "long", b"z" * 300), (None, "lost.md", b"# t")]
SECOND = [("q", "late.py", b"a\nb"), ("p", "src/main.py", b"print(2)\n")]
OPTIONS = PackOptions(exclude_patterns=("tmp/",), max_file_size=200)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stream_gives_the_rows_of_a_batch_and_each_file_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for files in (FIRST, SECOND):
        spark.createDataFrame(files, SCHEMA).repartition(3).write.mode("append").parquet(source)
        # the second call finds the first one's work, a third one nothing new
        for _ in range(2):
            arriving = spark.readStream.schema(SCHEMA).parquet(source)
            write_facts(arriving, out, progress, OPTIONS).awaitTermination()
        batch = file_facts(spark.read.parquet(source), OPTIONS)
        assert rows(spark.read.parquet(out)) == rows(batch)
    assert batch.count() == len(FIRST) + len(SECOND)


def test_facts(spark):
    got = {r.rel_path: r for r in file_facts(spark.createDataFrame(FIRST, SCHEMA), OPTIONS).collect()}
    assert (got["src/main.py"].language, got["src/main.py"].lines, got["src/main.py"].tokens) == ("python", 1, 2)
    wide = got["notes/wide.txt"]
    assert (wide.encoding, wide.transcoded, wide.lines, wide.size_bytes) == ("utf-16", True, 1, 12)
    assert got["notes/odd.txt"].skip_reason and got["blob"].skip_reason and got["long"].skip_reason
    assert (got["empty"].lines, got["empty"].tokens, got["empty"].encoding) == (0, 0, "utf-8")
    assert (got["gone"].skip_reason, got["gone"].encoding, got["gone"].lines) == (None, None, None)
    layers = {p: got[p].ignore_reason for p in ("node_modules/x.js", "tmp/y", "lost.md")}
    assert layers == {"node_modules/x.js": "ignored_name", "tmp/y": "user_glob", "lost.md": None}
    assert got["tmp/y"].encoding is None and got["tmp/y"].size_bytes == 1


def test_facts_without_rows_and_without_tokens(spark):
    assert file_facts(spark.createDataFrame([], SCHEMA)).count() == 0
    off = file_facts(spark.createDataFrame(FIRST, SCHEMA), PackOptions(token_counting="off"))
    assert off.where(F.col("tokens").isNotNull()).count() == 0 and off.where("lines is not null").count() > 0
