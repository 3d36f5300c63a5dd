"""Corpora the registered queries run on, derived from the given tables.

The expressions are plain SQL that means the same in Spark and in ANSI engines, so that
the check of the results starts from the same files.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packmill.constants import LEFTOVER_NAME, TOOL_IGNORE_FILE, VCS_IGNORE_FILE
from packmill.functions.paths import base_name, parent
from packmill.operators.inventory import directories, manifest
from packmill.sources.tables import files_from_table, url_location

_ID = "CAST(doc_id AS STRING)"
_BLOCK = "CAST(floor(doc_id / 340) AS BIGINT)"

# One source is a single project that grows with the table, the others are cut into
# projects of a fixed number of documents.
DOC_PROJECT = (f"CASE WHEN source = 'src0' THEN 'mono' "
               f"ELSE concat(source, '/repo', CAST({_BLOCK} AS STRING)) END")
DOC_BASE = f"CASE WHEN source = 'src0' THEN concat('pkg', CAST({_BLOCK} AS STRING), '/') ELSE '' END"
_DIR = (f"CASE WHEN doc_id % 17 IN (11, 12) AND {_BLOCK} % 2 = 0 THEN '' "
        "ELSE CASE CAST(floor(doc_id / 13) AS BIGINT) % 10 "
        "WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'docs/' WHEN 3 THEN 'docs/deep/' "
        "WHEN 4 THEN 'build/' WHEN 5 THEN 'Pkg/sub/' WHEN 6 THEN '.git/' WHEN 7 THEN 'ENV/' "
        "WHEN 8 THEN 'my.egg-info/' ELSE 'data/' END END")
# every name pattern meets a project (or a part of the large one) once per block
_NAME = (f"CASE doc_id % 17 WHEN 0 THEN concat('a_', {_ID}, '.py') "
         f"WHEN 1 THEN concat('B_', {_ID}, '.md') WHEN 2 THEN concat('c_', {_ID}, '.txt') "
         f"WHEN 3 THEN concat('d_', {_ID}, '.PNG') WHEN 4 THEN concat('e_', {_ID}, '.log') "
         f"WHEN 5 THEN concat('Run_', {_ID}) WHEN 6 THEN concat('f_', {_ID}, '.json') "
         f"WHEN 7 THEN concat('g_', {_ID}, '.db') WHEN 8 THEN concat('h_', {_ID}, '.tar.gz') "
         f"WHEN 9 THEN concat('i_', {_ID}, '.toml') WHEN 10 THEN '.env' "
         f"WHEN 11 THEN '{VCS_IGNORE_FILE}' "
         f"WHEN 12 THEN CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 3 = 0 THEN '{LEFTOVER_NAME}' "
         f"ELSE '{TOOL_IGNORE_FILE}' END "
         f"WHEN 13 THEN 'desktop.ini' WHEN 14 THEN 'dist' WHEN 15 THEN concat('.hid_', {_ID}) "
         f"ELSE concat('__init__', {_ID}, '.SQL') END")
DOC_PATH = f"concat({DOC_BASE}, {_DIR}, {_NAME})"

# Ignore files, by kind: lines, line break, byte order mark
RULE_KIND = (f"CASE WHEN doc_id % 17 = 11 THEN concat('G', CAST(CAST(floor(doc_id / 20) AS BIGINT) % 3 AS STRING)) "
             f"WHEN doc_id % 17 = 12 AND CAST(floor(doc_id / 20) AS BIGINT) % 3 > 0 "
             f"THEN concat('T', CAST(CAST(floor(doc_id / 20) AS BIGINT) % 3 AS STRING)) END")
RULE_LINES = {
    "G0": ["# rules", "*.log", "!e_*4.log", "/Run_*"],
    "G1": ["data/", "*.txt", "", "!c_*2.txt"],
    "G2": ["**/deep/**", "B_*[0-4].md", "*.toml", "!/i_*.toml"],
    "T1": ["*.json", "!f_*6.json", "src"],
    "T2": ["docs/*", "!docs/deep", "__init__*[!3].SQL", "Pkg/**/[a-e]_*"],
}
RULE_BREAK = {"G1": "\r\n"}
RULE_BOM = {"G2"}

PAGE_ID = "CAST(page_id AS STRING)"
CONV_PROJECT = "concat('conv_', CAST(conv_id AS STRING))"
CONV_PATH = ("concat(CASE WHEN turn % 3 = 0 THEN 'intro/' ELSE '' END, role, '/turn_', "
             "lpad(CAST(turn AS STRING), 4, '0'), '.md')")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _column(value: Column, kind: str = "string") -> Column:
    """A derived value that Spark is to compute once per row, as if it were read from a
    file table, and not again in every predicate pushed below it.  The values are never
    NULL; naming an alternative that is not deterministic is what pins them."""
    return F.coalesce(value, F.monotonically_increasing_id().cast("string").cast(kind))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: project_id, rel_path, base, doc_id, byte_kind, rule_kind, text."""
    return _as_files(_table(spark, sf_dir, "documents"), _column)


def _as_files(table: DataFrame, column) -> DataFrame:
    return table.select(
        column(F.expr(DOC_PROJECT)).alias("project_id"), column(F.expr(DOC_PATH)).alias("rel_path"),
        F.expr(DOC_BASE).alias("base"), "doc_id", (F.col("doc_id") % 11).alias("byte_kind"),
        F.expr(RULE_KIND).alias("rule_kind"), "text")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without text, for the operators on paths."""
    return documents(spark, sf_dir).drop("text")

# Letters of the texts, and letters of Windows-1251 that stand for them in its files
ACCENTED = "éèêçñóíäöüßÄÖÜÉÈÊÇ"
CYRILLIC = "абвгдежзийклмнопрс"


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes in many encodings, some broken, the text in all: adds `content`.

    It is a plain expression above the paths, so a filter on paths comes before it."""
    return _with_bytes(documents(spark, sf_dir))


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(project_id, rel_path, content) of the documents as they arrive in their folder."""
    table = f"{sf_dir}/documents.parquet"
    # a stream takes one file as its source only through a pattern; a folder of files fits it too
    arriving = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table}*")
    return _with_bytes(_as_files(arriving, lambda value: value)).select("project_id", "rel_path", "content")


def _with_bytes(docs: DataFrame) -> DataFrame:
    def hx(digits):
        return F.unhex(F.lit(digits))

    text, kind = F.col("text"), F.col("byte_kind")
    plain = text.cast("binary")
    # what the single-byte encodings lack becomes a question mark
    cyrillic = F.translate(F.regexp_replace(text, rf"[^ -~\n{ACCENTED}]", "?"), ACCENTED,
                           CYRILLIC.encode("cp1251").decode("latin-1"))
    latin = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    rule = F.lit(None).cast("string")
    for name, lines in RULE_LINES.items():
        end = RULE_BREAK.get(name, "\n")
        body = ("\ufeff" if name in RULE_BOM else "") + "".join(line + end for line in lines)
        rule = F.when(F.col("rule_kind") == name, F.lit(body)).otherwise(rule)
    content = (F.when(F.col("rule_kind").isNotNull(), rule.cast("binary"))
               .when(kind == 0, F.concat(hx("EFBBBF"), plain))
               .when(kind == 1, F.concat(hx("00"), plain))
               .when(kind == 2, F.concat(F.encode(cyrillic, "ISO-8859-1"), hx("CF")))
               .when(kind == 3, F.concat(F.encode(latin, "ISO-8859-1"), hx("98")))
               .when(kind == 4, F.concat(F.repeat(F.lit("x"), F.lit(9000)).cast("binary"), hx("00"), plain))
               .when(kind == 5, F.concat(hx("FFFE"), F.encode(text, "UTF-16LE")))
               .when(kind == 6, F.concat(hx("0000FEFF"), F.encode(text, "UTF-32")))
               .when(kind == 7, F.concat(hx("FFFE"), F.encode(text, "UTF-16LE"), hx("41")))
               .when(kind == 8, F.concat(hx("FEFF"), F.encode(text, "UTF-16BE")))
               .otherwise(plain))
    return docs.withColumn("content", content)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(project_id, rel_path, content) of all documents."""
    return document_bytes(spark, sf_dir).select("project_id", "rel_path", "content")


def ticked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with runs of backticks, every other one with a newline at its end."""
    ticks = F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int"))
    return documents(spark, sf_dir).withColumn("text", F.concat(
        F.replace(F.col("text"), F.lit("th"), ticks),
        F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of one project per host; the URL's path is the directory."""
    place = url_location(F.col("url"))
    host = F.substring_index(place, "/", 1)
    folder = F.regexp_replace(F.substring(place, F.length(host) + 1, F.length(place)), "^/+|/+$", "")
    path = F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""),
                    F.lit("p"), F.expr(PAGE_ID), F.lit(".html"))
    return files_from_table(_table(spark, sf_dir, "pages"), _column(host), _column(path), F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation a project, every turn a file."""
    return files_from_table(_table(spark, sf_dir, "conversations"), _column(F.expr(CONV_PROJECT)),
                            _column(F.expr(CONV_PATH)), F.col("text"))


# Links next to a third of the documents.  Kinds: file, out of the root, absolute,
# directory, links to links, directory, the base itself.
LINK_KIND = "CAST(floor(doc_id / 3) AS BIGINT) % 8"
LINK_NAME = f"concat({DOC_BASE}, 'links/l_', {_ID})"
LINK_TARGET = (f"CASE {LINK_KIND} WHEN 0 THEN concat('../', {_DIR}, {_NAME}) "
               f"WHEN 1 THEN concat('../../../secret_', {_ID}) WHEN 2 THEN '/etc/hostname' "
               f"WHEN 3 THEN '../src' WHEN 4 THEN concat('./l_', CAST(doc_id - 60 AS STRING)) "
               f"WHEN 5 THEN concat('../links/../links/l_', CAST(doc_id - 60 AS STRING)) "
               f"WHEN 6 THEN '../data/.' ELSE '..' END")


def linked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the documents with links and with directories that share identities:
    in every directory 'data' and 'src' are one."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(_column(F.expr(DOC_PROJECT)).alias("project_id"),
                        _column(F.expr(DOC_PATH)).alias("rel_path"),
                        F.lit("file").alias("kind"), F.lit(None).cast("string").alias("link_target"),
                        F.lit(None).cast("string").alias("dir_id"))
    links = docs.where("doc_id % 3 = 0").select(
        _column(F.expr(DOC_PROJECT)).alias("project_id"), _column(F.expr(LINK_NAME)).alias("rel_path"),
        F.lit("link").alias("kind"), F.expr(LINK_TARGET).alias("link_target"),
        F.lit(None).cast("string").alias("dir_id"))
    both = files.unionByName(links)
    path = F.col("dir")
    twins = F.concat(F.lit("twin:"), parent(path))
    dirs = directories(manifest(both)).where(path != "").select(
        "project_id", path.alias("rel_path"), F.lit("dir").alias("kind"),
        F.lit(None).cast("string").alias("link_target"),
        F.when(base_name(path).isin("data", "src"), twins).otherwise(path).alias("dir_id"))
    return both.unionByName(dirs)
