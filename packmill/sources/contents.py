"""Bytes of listed files."""

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from packmill.constants import REASON_PERMISSION
from packmill.functions.paths import base_name

# files are handed on in batches of about this many bytes, however many rows Spark sends
_BATCH_BYTES = 32 * 1024 * 1024
# what a value of a column holds at most
LARGEST_FILE = 2**31 - 1024


def read_file(path: str):
    """(bytes, None) or (None, reason)."""
    try:
        with open(path, "rb") as f:
            if os.fstat(f.fileno()).st_size > LARGEST_FILE:
                return None, "read error: larger than 2 GB"
            return f.read(), None
    except PermissionError:
        return None, REASON_PERMISSION
    except OSError as exc:
        return None, f"read error: {exc}"


def read_contents(rows: DataFrame, root: str, layout: str = "project") -> DataFrame:
    """Adds `content` and `read_error` to rows with project_id, rel_path and `wanted`.

    Only rows with `wanted` are opened; call it after everything that drops files.
    """
    root = os.path.realpath(root)
    single = layout == "project"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            projects, paths, wanted = (batch.column(n).to_pylist()
                                       for n in ("project_id", "rel_path", "wanted"))
            start, size, found = 0, 0, []

            def flush(end):
                part = batch.slice(start, end - start)
                return pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c for c, _ in found], pa.binary()),
                     pa.array([e for _, e in found], pa.string())],
                    names=[*batch.schema.names, "content", "read_error"])

            for i, (project, path, want) in enumerate(zip(projects, paths, wanted)):
                base = root if single else os.path.join(root, project)
                got = read_file(os.path.join(base, path)) if want else (None, None)
                found.append(got)
                size += len(got[0] or b"")
                if size >= _BATCH_BYTES:
                    yield flush(i + 1)
                    start, size, found = i + 1, 0, []
            if found:
                yield flush(batch.num_rows)

    schema = StructType([*rows.schema.fields, StructField("content", BinaryType()),
                         StructField("read_error", StringType())])
    return rows.mapInArrow(read, schema)


def read_ignore_files(listing: DataFrame, root: str, layout: str = "project") -> DataFrame:
    """Ignore files of a listing: project_id, rel_path, dir, name, content, or read_error."""
    from packmill.operators.filters import is_ignore_file
    path = F.col("rel_path")
    is_file = (F.col("kind") == "file") | ((F.col("kind") == "link") & (F.col("target_kind") == "file"))
    found = listing.where(is_ignore_file(path, is_file)).select(
        "project_id", "rel_path", F.lit(True).alias("wanted"))
    return read_contents(found, root, layout).select(
        "project_id", "rel_path", F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1).alias("dir"),
        base_name(path).alias("name"), "content", "read_error")
