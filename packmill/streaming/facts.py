"""Facts of files on a stream: what a row tells without any other row."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from packmill.functions import decode, render, text as tx
from packmill.functions.paths import base_name, depth, parent, suffix
from packmill.operators import filters
from packmill.functions.patterns import excluded
from packmill.options import PackOptions


def file_facts(files: DataFrame, options: PackOptions | None = None) -> DataFrame:
    """Path, layer, encoding and measures of every file, batch or streaming alike.

    `files` has project_id, rel_path and content.  `ignore_reason` names the layer that the
    path alone meets: built-in names, the options' globs or the leftover document; ignore files
    and directories that repeat need other rows and have no say here.  Ignored files are not
    decoded: their `skip_reason`, `encoding` and measures are NULL, as are the measures of a
    file with a skip reason.  A NULL content has neither reason nor measures.  There is no
    state and no shuffle, so a stream of any length needs no watermark.
    """
    options = options or PackOptions()
    path, content, text = F.col("rel_path"), F.col("content"), F.col("text")
    reason = F.coalesce(
        filters.builtin_reason(path, F.lit(True)),
        F.when(excluded(path, F.lit(False), options.exclude_patterns), "user_glob"),
        F.when(filters.is_leftover(path, F.lit("file")), "leftover"))
    rows = files.select("project_id", "rel_path", "content", reason.alias("ignore_reason"))
    size = F.octet_length(content).cast("long")
    kept = F.col("ignore_reason").isNull()
    rows = rows.withColumns({
        "size_bytes": size, "too_big": F.when(kept, filters.size_reason(size, options.max_file_size))})
    rows = rows.withColumn("content", F.when(kept & F.col("too_big").isNull(), content))
    rows = rows.withColumns({"encoding": decode.encoding(content),
                             "skip_reason": F.coalesce("too_big", decode.skip_reason(content))})
    rows = rows.withColumn("text", decode.text(content, F.col("encoding")))
    tokens = F.lit(None).cast("long") if options.token_counting == "off" else tx.token_count(text)
    return rows.select(
        "project_id", "rel_path", base_name(path).alias("name"), parent(path).alias("parent"),
        suffix(path).alias("suffix"), depth(path).cast("long").alias("depth"),
        render.language(path).alias("language"), "ignore_reason", "size_bytes", "skip_reason", "encoding",
        decode.transcoded(F.col("encoding")).alias("transcoded"),
        tx.line_count(text).alias("lines"), tokens.cast("long").alias("tokens"),
        F.md5(text.cast("binary")).alias("text_md5"))


def write_facts(files: DataFrame, folder: str, checkpoint: str,
                options: PackOptions | None = None) -> StreamingQuery:
    """Starts a query that adds the facts of all files not yet seen to Parquet in `folder`, then ends.

    `checkpoint` remembers what was read: after a failure or with new input the same call goes on
    from there, and no file is written twice.  Both folders must be shared by all executors.
    """
    return (file_facts(files, options).writeStream.format("parquet").outputMode("append")
            .option("path", folder).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
