"""What the operators share: word rules, tables in the shared folder, rows carried whole."""

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from packmill.session import ship_package

# A-Z is lower-cased, everything in ASCII but letters and digits separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
                    for b in range(256))
# Spark's own setting: removes the shuffles of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Spark's own settings too: bytes of the batches in which Python workers get rows, which else hold 10,000 rows of any size,
# and rows that are read from Parquet at once.
ARROW_BYTES, READ_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
TIDY = {SHUFFLE_CLEANUP: "true", ARROW_BYTES: str(1 << 20), READ_ROWS: "512"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters of UTF-8 text, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split() if text else []


def tokens_of(text: bytes | None) -> list[bytes]:
    """Runs between ASCII white space, A-Z lower-cased.  Other control bytes belong to tokens."""
    return text.lower().split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without it gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            import tempfile
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class Scratch:
    """Intermediate tables of one operator call, written as Parquet in the shared folder.

    They survive lost executors and cut the lineage.  A table that later ones no longer
    need is removed with `drop`; those the result reads stay.  With `tidy` what was shuffled for a
    table is removed as soon as the table is written, and not when the driver collects garbage,
    and rows that hold much, like long texts and lists, are read and sent to Python workers in small batches.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, *folders: str) -> DataFrame:
        """The rows as a table; with `folders` in a folder for each value of these last columns."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = {key: self.spark.conf.get(key, None) for key in TIDY} if self.tidy else {}
        try:
            for key in before:
                self.spark.conf.set(key, TIDY[key])
            df.write.partitionBy(*folders).parquet(path)
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *tables: DataFrame, folder: str = "") -> None:
        """Removes tables, or only one folder of each, such as a=1."""
        for table in tables:
            path, files = self._place(f"{table._scratch_path}/{folder}" if folder else table._scratch_path)
            files.delete(path, True)

    def size(self, table: DataFrame) -> int:
        """Bytes of a table's files."""
        path, files = self._place(table._scratch_path)
        return files.getContentSummary(path).getLength()

    def _place(self, path: str) -> tuple:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def bundled(docs: DataFrame, carry: tuple[str, ...] | None = None, **columns: Column) -> DataFrame:
    """Input rows whole (or the columns `carry` of them) in the struct `row`, with the named
    columns the operator works on.

    Whatever else the input holds, no name can clash with the operator's own.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
                       *[c.alias(name) for name, c in columns.items()])


def unbundled(result: DataFrame) -> DataFrame:
    """The input rows of `bundled` again."""
    return result.select("row.*")


def map_batches(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """Applies `function` (an iterator of record batches to another) on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def extended(df: DataFrame, drop: list[str], fields: str) -> T.StructType:
    """The schema of `df` without the columns `drop` and with the fields of a DDL string."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    return T.StructType(kept + T.StructType.fromDDL(fields).fields)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo `parts`, is `part`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
