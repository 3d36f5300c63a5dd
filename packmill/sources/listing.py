"""Lists project directories on the executors, in rounds.

Spark's own file sources cannot stand in for it: they leave out names that start with
'.' or '_' and empty directories, and follow links out of the root.

The directories still to be listed are a table.  In each round tasks take their share of it and walk on from there until
they have listed so many directories; what they have met and not listed is the table of the next round, dealt out
anew.  So one deep directory, one wide one and very many projects all spread over the tasks, a chain of a thousand directories
takes one round and not a thousand, and nothing is listed on the driver.
"""

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from packmill.constants import ALLOWED_HIDDEN_FILES, IGNORED_NAMES
from packmill.operators.durable import durable
from packmill.session import ship_package

SCHEMA = ("project_id string, rel_path string, kind string, size_bytes long, link_target string, "
          "resolved_rel_path string, target_kind string, dir_id string, listing_error string")

# a directory to go on with: the project's root and the path in it as they are on disk, the identities of the directories above
_FRONTIER = "project_id string, base binary, rel binary, chain array<string>"
_ARROW = pa.schema([
    ("project_id", pa.string()), ("rel_path", pa.string()), ("kind", pa.string()), ("size_bytes", pa.int64()),
    *[(n, pa.string()) for n in ("link_target", "resolved_rel_path", "target_kind", "dir_id", "listing_error")],
    ("base", pa.binary()), ("rel", pa.binary()), ("chain", pa.list_(pa.string()))])

# directories a task lists in the first round, so that the work is soon dealt out, and in later ones
FIRST_ROUND, ROUND = 64, 5000
# rows a task hands on at a time
_ROWS = 20_000

_NAMES = frozenset(n for n in IGNORED_NAMES if n == n.lower())
_ALLOWED = frozenset(ALLOWED_HIDDEN_FILES)


def ignored_directory(name: str) -> bool:
    """The name-based layers for one directory, so that it is never listed."""
    low = name.lower()
    return low in _NAMES or low.endswith(".egg-info") or (low.startswith(".") and low not in _ALLOWED)


def _shown(path: str | None) -> str | None:
    """The path as text; bytes of a name that are no UTF-8 become replacement characters, so
    such a file is a row like others, of which no contents can be read."""
    return None if path is None else os.fsencode(path).decode("utf-8", "replace")


def _within(root: str, path: str) -> str | None:
    """Path from the resolved root, NULL outside of it."""
    rel = os.path.relpath(path, root)
    if rel == os.curdir:
        return ""
    return None if rel == os.pardir or rel.startswith(os.pardir + os.sep) else rel.replace(os.sep, "/")


def _identity(path: str) -> str | None:
    try:
        st = os.stat(path)
    except OSError:
        return None
    if st.st_dev and st.st_ino:
        return f"{st.st_dev}:{st.st_ino}"
    return os.path.realpath(path)


def _link_row(project, root, rel, full):
    try:
        target = os.readlink(full)
    except OSError:
        target = None
    place = os.path.realpath(full)
    # still a link: the links lead in circles
    resolved = None if os.path.islink(place) else _within(root, place)
    kind = "dir" if os.path.isdir(full) else "file" if os.path.isfile(full) else None
    try:
        size = os.stat(full).st_size
    except OSError:
        size = 0
    return (project, _shown(rel), "link", size, _shown(target), _shown(resolved), kind, None, None)


def list_directory(project: str, root: str, rel: str, prune: bool):
    """Rows of one directory and the names of the directories to go on with.

    The first row is the directory itself; names come as they are on disk.
    """
    full = os.path.join(root, rel) if rel else root
    rows, below, error = [], [], None
    try:
        with os.scandir(full) as found:
            for entry in found:
                path = f"{rel}/{entry.name}" if rel else entry.name
                if entry.is_symlink():
                    rows.append(_link_row(project, root, path, entry.path))
                elif entry.is_dir(follow_symlinks=False):
                    if not (prune and ignored_directory(entry.name)):
                        below.append(path)
                elif entry.is_file(follow_symlinks=False):
                    try:
                        size = entry.stat(follow_symlinks=False).st_size
                    except OSError:
                        size = 0
                    rows.append((project, _shown(path), "file", size, None, _shown(path), None, None, None))
    except OSError as exc:
        error = exc.strerror or str(exc)
    own = (project, _shown(rel), "dir", None, None, _shown(rel), None, _identity(full), error)
    return [own, *rows], below


def _projects(base: bytes) -> list[tuple]:
    """The directories of a collection, each a project to go on with."""
    with os.scandir(os.fsdecode(base)) as found:
        return [(_shown(e.name), os.fsencode(e.path), b"", []) for e in found if e.is_dir(follow_symlinks=False)]


def _batch(rows: list[tuple], going_on: list[tuple]) -> pa.RecordBatch:
    whole = [(*r, None, None, None) for r in rows] + [(f[0], *[None] * 8, *f[1:]) for f in going_on]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*whole, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _expanded(prune: bool, most: int):
    """Rows of the directories listed, and what is left to list (without a rel_path)."""
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = 0
        for batch in batches:
            queue = deque(zip(*(batch.column(c).to_pylist() for c in ("project_id", "base", "rel", "chain")), strict=True))
            rows = []
            while queue and listed < most:
                project, base, rel, chain = queue.popleft()
                listed += 1
                if project is None:
                    queue.extend(_projects(base))
                    continue
                found, below = list_directory(project, os.fsdecode(base), os.fsdecode(rel), prune)
                rows += found
                own = found[0][7]
                # a directory inside itself is not entered again
                if own is None or own not in chain:
                    chain = chain if own is None else [*chain, own]
                    queue.extend((project, base, os.fsencode(path), chain) for path in below)
                if len(rows) >= _ROWS:
                    yield _batch(rows, [])
                    rows = []
            if rows or queue:
                yield _batch(rows, list(queue))
    return expand


def read_listing(spark: SparkSession, root: str, layout: str = "project", prune: bool = True, tasks: int = 64,
                 first: int = FIRST_ROUND, most: int = ROUND) -> DataFrame:
    """Manifest of a directory tree all executors can read, kept in the checkpoint folder.

    With the layout 'collection' each directory in the root is a project, else the root is one.  `prune` leaves out what
    is below directories with built-in ignored names.  A round has as many tasks as it has directories to begin with, up to
    `tasks` or four for each core of the session.
    """
    root = os.path.realpath(root)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    ship_package(spark)
    name = os.path.basename(root) if layout == "project" else None
    frontier = spark.createDataFrame([(name, bytearray(os.fsencode(root)), bytearray(), [])], _FRONTIER)
    many, found = 1, None
    tasks = max(tasks, 4 * spark.sparkContext.defaultParallelism)
    while many:
        step = durable(frontier.repartition(min(many, tasks)).mapInArrow(_expanded(prune, first if found is None else most),
                                                                       f"{SCHEMA}, base binary, rel binary, chain array<string>"))
        rows = step.where("rel_path is not null").select(*[c.split()[0] for c in SCHEMA.split(", ")])
        found = rows if found is None else found.unionByName(rows)
        frontier = step.where("rel_path is null").select("project_id", "base", "rel", "chain")
        many = frontier.agg(F.count("*")).first()[0]
    return found
