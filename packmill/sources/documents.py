"""Sinks: the documents as folders of text files, or as one file each."""

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packmill.session import ship_package

# a task writes about so many bytes at a time
_BUFFER = 8 * 1024 * 1024
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_sections(sections: DataFrame, path: str, per_project: bool = False) -> None:
    """Writes sections(project_id, section, sort_key, text), which stand in document order.

    The rows are range-partitioned by that order, so any number of tasks write; the part files in name
    order are the document, byte for byte.  With `per_project` each project gets a folder
    of its own.  Failures raise OSError.
    """
    # the writer wants rows by project; any other order it would replace by that alone, and lose the order in a project
    if per_project:
        rows = sections.sortWithinPartitions("project_id", "section", "sort_key").select("project_id", "text")
    else:
        rows = sections.select("text")
    writer = rows.write.mode("overwrite").option("lineSep", "\n")
    try:
        (writer.partitionBy("project_id") if per_project else writer).text(path)
    except Exception as exc:
        raise OSError(f"cannot write the document to {path!r}: {exc}") from exc


def document_name(project: str | None, suffix: str) -> str:
    """A project's file below the folder of all; a '/' in its name makes folders."""
    parts = [p for p in (_NO_NAME if project is None else project).split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"no file can be named after the project {project!r}")
    return "/".join(parts) + suffix


class _File:
    """One project's part of a task: bytes that go to a known place of a file others write too."""

    def __init__(self, path: str, at: int):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.out, self.at, self.held, self.size = os.open(path, os.O_WRONLY | os.O_CREAT, 0o666), at, [], 0
        self.start = at

    def add(self, text: str) -> None:
        self.held.append(text.encode() + b"\n")
        self.size += len(self.held[-1])
        if self.size >= _BUFFER:
            self.flush()

    def flush(self) -> None:
        rest = memoryview(b"".join(self.held))
        while rest:
            done = os.pwrite(self.out, rest, self.at)
            rest, self.at = rest[done:], self.at + done
        self.held, self.size = [], 0

    def close(self) -> int:
        self.flush()
        os.close(self.out)
        return self.at - self.start


def _written(folder: str, suffix: str, single: str | None, offsets: dict[int, tuple[str | None, int]]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, current = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([project], pa.string()), pa.array([current.close()], pa.int64())],
                                              ["project_id", "bytes"])

        for batch in batches:
            for name, part, text in zip(*(batch.column(c).to_pylist() for c in ("project_id", "part", "text")), strict=True):
                if current is None or name != project:
                    if current is not None:
                        yield done()
                    going_on, at = offsets.get(part, (None, 0))
                    project = name
                    current = _File(os.path.join(folder, single or document_name(name, suffix)), at if at and going_on == name else 0)
                current.add(text)
        if current is not None:
            yield done()
    return write


def _moved(folder: str, target: str, suffix: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("project_id").to_pylist():
                file = document_name(name, suffix)
                os.makedirs(os.path.dirname(os.path.join(target, file)), exist_ok=True)
                os.replace(os.path.join(folder, file), os.path.join(target, file))
            yield batch
    return move


def write_files(rows: DataFrame, shares: DataFrame, sizes: DataFrame, path: str, suffix: str | None) -> None:
    """Writes rows(project_id, part, text), in document order within their parts, as one file per project.

    `shares` (project_id, part, bytes) tells how much of a project each part has, so a task knows where its bytes
    go, whoever else writes the file, and a task that runs again puts the same bytes in the same place.  `sizes` has project_id
    and file_size.  With a `suffix` the files lie in the folder `path` under their project's name; without one there
    is one project, and `path` is its file.  All executors must see the place under the same path.  The files appear when
    all of them are whole, each at once; if anything fails, OSError is raised and nothing is left of the attempt.
    """
    path = os.path.abspath(path)
    ship_package(rows.sparkSession)
    # a project that goes on in a part is the first one there, so there is one for each part at most
    shares = shares.groupBy("project_id", "part").agg(F.sum("bytes").alias("bytes"))
    before = F.expr("sum(bytes) OVER (PARTITION BY project_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    going_on = shares.withColumn("at", before).where("at > 0").select("part", "project_id", "at").collect()
    offsets = {r.part: (r.project_id, r.at) for r in going_on}
    folder = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}-{uuid.uuid4().hex}")
    try:
        single = None if suffix is not None else "document"
        written = rows.mapInArrow(_written(folder, suffix or "", single, offsets), "project_id string, bytes long")
        wrong = written.groupBy("project_id").agg(F.sum("bytes").alias("bytes")).join(
            sizes.withColumnRenamed("project_id", "_project"), F.col("project_id").eqNullSafe(F.col("_project")), "full").where(
            "NOT bytes <=> file_size").limit(1).collect()
        if wrong:
            raise OSError(f"{wrong[0].bytes} bytes were written where {wrong[0].file_size} were expected")
        if single:
            os.replace(os.path.join(folder, single), path)
        else:
            os.makedirs(path, exist_ok=True)
            sizes.select("project_id").mapInArrow(_moved(folder, path, suffix), "project_id string").count()
    except Exception as exc:
        raise OSError(f"cannot write the document to {path!r}: {exc}") from exc
    finally:
        shutil.rmtree(folder, ignore_errors=True)
