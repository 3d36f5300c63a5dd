"""From a manifest to documents and their statistics."""

import os
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.constants import METHOD_EXACT, METHOD_HEURISTIC, METHOD_OFF
from packmill.functions import decode, render, text as tx
from packmill.functions.paths import order_key
from packmill.operators import tree
from packmill.operators.balance import key_bounds, part_number
from packmill.operators.classify import by_path_alone, classify
from packmill.operators.durable import durable
from packmill.operators.filters import size_reason
from packmill.operators.inventory import manifest
from packmill.operators.keyset import KeySet
from packmill.operators.ordering import with_position
from packmill.options import PackOptions
from packmill.plans import exact
from packmill.session import ship_package
from packmill.sources.contents import read_contents, read_ignore_files
from packmill.sources.documents import write_files, write_sections
from packmill.sources.listing import read_listing

HEADER, TREE_OPENING, TREE, TREE_CLOSING, FILES_OPENING, BLOCK = range(6)


# what a row of text adds to the document, the newline after it included
_MEASURES = {
    "lines": r"octet_length({0}) - octet_length(replace({0}, '\n', '')) + 1",
    "chars": "length({0}) + 1",
    "bytes": "octet_length({0}) + 1",
}


_KEY = ["project_id", "section", "sort_key"]


def _place() -> Column:
    """One string in the order of _KEY, NULL projects first; a project's name holds no NUL."""
    project = F.coalesce(F.concat(F.lit("1"), "project_id"), F.lit("0"))
    return F.concat(project, F.lit("\0"), F.col("section").cast("string"), F.col("sort_key"))


def _adds(name: str) -> Column:
    """struct<lines, chars, bytes> of a text column."""
    return F.struct(*[F.expr(f"CAST({sql.format(name)} AS BIGINT)").alias(measure)
                      for measure, sql in _MEASURES.items()])


class Pack:
    """The documents of all projects in `source`, a manifest or a plain table of files.

    `source` has at least project_id and rel_path, and content unless `root` tells where
    the bytes are read from.  `ignore_files` (project_id, dir, name, content) saves
    looking for them in the contents.  A path stands once in its project.

    Attributes are DataFrames, worked out when they are first asked for.  Classification
    and `facts` run jobs then, since what several results need is kept in the checkpoint
    folder: directories, verdicts on them, the tree, and one narrow row per file.
    """

    def __init__(self, source: DataFrame, options: PackOptions | None = None, *,
                 ignore_files: DataFrame | None = None, root: str | None = None,
                 layout: str = "project", warnings: DataFrame | None = None):
        self.options = options or PackOptions()
        self.source, self.ignore_files = source, ignore_files
        self.root, self.layout = root, layout
        # ignore files that could not be read: project_id, rel_path, warning
        self.warnings = warnings
        self._format = self.options.output_format

    @cached_property
    def classified(self):
        return classify(self.source, self.options, self.ignore_files)

    @property
    def entries(self) -> DataFrame:
        """All rows of the manifest, without contents, with the layer that ignores them
        (`ignore_reason`)."""
        return self.classified.entries

    @cached_property
    def _read(self) -> DataFrame:
        """Files with their text.  Of a table, all that their own path keeps: what ignore
        files say is joined to narrow rows only.  Of a directory, those that are kept."""
        limit = self.options.max_file_size
        if self.root is None:
            rows = manifest(self.source).where("is_file and rel_path <> ''").where(by_path_alone(self.options))
            rows = rows.withColumn("too_big", size_reason(F.col("size_bytes"), limit))
            rows = rows.withColumn("content", F.when(F.col("too_big").isNull(), F.col("content")))
            rows = rows.withColumn("read_error", F.lit(None).cast("string"))
        else:
            kept = self.entries.where("is_file and ignore_reason is null").withColumn(
                "too_big", size_reason(F.col("size_bytes"), limit))
            rows = read_contents(kept.withColumn("wanted", F.col("too_big").isNull()), self.root, self.layout)
        content = F.col("content")
        rows = rows.withColumn("encoding", decode.encoding(content))
        return rows.select(
            *[c for c in rows.columns if c not in ("content", "too_big", "read_error", "wanted", "encoding", "ignore_reason")],
            F.coalesce("too_big", "read_error", decode.skip_reason(content)).alias("skip_reason"),
            "encoding", decode.transcoded(F.col("encoding")).alias("transcoded"),
            decode.text(content, F.col("encoding")).alias("text"),
            order_key(F.col("rel_path"), F.lit(False)).alias("sort_key"))

    def _block(self) -> Column:
        """A file's block after the blank line that separates it."""
        return F.concat(F.lit("\n"), render.file_block(F.col("rel_path"), F.col("text"), self._format))

    @property
    def skips(self) -> DataFrame:
        """Files left out of the contents, with the reason."""
        return self.facts.where("skip_reason is not null").select("project_id", "rel_path", "skip_reason")

    @cached_property
    def facts(self) -> DataFrame:
        """One narrow row per file: skip reason, encoding and what its block adds to the
        document.  Kept in the checkpoint folder, since tree and statistics both need it
        and the contents are read but once for them."""
        rows = self._read.withColumn("row", self._block())
        tokens = F.lit(None)
        if self.options.token_counting == "exact":
            ship_package(self.source.sparkSession)
            tokens = exact.block_tokens(F.expr("substr(row, 2)"), F.col("text"), self._format)
        rows = rows.withColumns({"source_lines": tx.line_count(F.col("text")), "adds": _adds("row"),
                                 "tokens": tokens}).drop("text", "row")
        if self.root is None:
            rows = self.classified.label(rows).where("ignore_reason is null")
        return durable(rows.select(
            "project_id", "rel_path", "kind", "link_target", "skip_reason", "encoding", "transcoded",
            "sort_key", "source_lines", "adds", "tokens"))

    @cached_property
    def projects(self) -> DataFrame:
        """One row per project, empty ones included."""
        ids = self.source.select("project_id").distinct()
        return ids.withColumn("project_name", F.substring_index("project_id", "/", -1))

    @cached_property
    def tree(self) -> DataFrame:
        """Lines of the directory trees: project_id, sort_key, line."""
        classified = self.classified
        nodes = tree.directory_nodes(classified.dirs).unionByName(tree.file_nodes(self.facts))
        columns = self.source.columns
        if "link_target" in columns:
            nodes = nodes.unionByName(tree.link_nodes(classified))
        notes = None
        if "dir_id" in columns or "listing_error" in columns:
            notes = tree.directory_notes(classified)
        # needed for the statistics and as rows
        return durable(tree.tree_lines(nodes, self.projects, notes))

    @cached_property
    def stats(self) -> DataFrame:
        """One row per project with everything the header and the report tell."""
        options, fmt = self.options, self._format
        packed = "skip_reason IS NULL"

        def total(column, condition="true"):
            return F.expr(f"coalesce(sum({column}) FILTER (WHERE {condition}), 0L)")

        # sums, so a project of any size is added up before it is brought together
        sums = self.facts.groupBy("project_id").agg(
            F.expr(f"count_if({packed})").alias("packed"), F.expr(f"count_if(NOT ({packed}))").alias("skipped"),
            total("source_lines", packed).alias("source_lines"),
            *[total(f"adds.{m}", packed).alias(f"block_{m}") for m in ("lines", "chars", "bytes")],
            *(exact.sum_blocks(F.expr(packed)) if options.token_counting == "exact" else []))
        rows = self.projects.join(sums, "project_id", "left")
        if options.include_tree:
            lines = self.tree.withColumn("adds", _adds("line")).groupBy("project_id").agg(
                *[total(f"adds.{m}").alias(f"tree_{m}") for m in ("lines", "chars", "bytes")],
                F.max(render.longest_ticks(F.col("line"))).alias("ticks"),
                *(exact.sum_tree() if options.token_counting == "exact" else []))
            rows = rows.join(lines, "project_id", "left")
        else:
            zero = F.lit(0).cast("long")
            rows = rows.withColumns({"tree_lines": zero, "tree_chars": zero, "tree_bytes": zero,
                                     "ticks": F.lit(0)})
        rows = rows.na.fill(0, ["packed", "skipped", "source_lines", "block_lines", "block_chars",
                                "block_bytes"])
        stamp = (F.lit(options.generated_at) if options.generated_at is not None
                 else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        rows = rows.withColumns({
            "generated_at": stamp, "fence_length": render.fence_length(F.col("ticks")),
            "files_opening": render.files_opening(fmt, F.col("packed"))})
        if options.include_tree:
            rows = rows.withColumns({
                "tree_opening": render.tree_opening(fmt, F.col("fence_length")),
                "tree_closing": render.tree_closing(fmt, F.col("fence_length"))})

        def header(lines, tokens, method):
            return render.header(fmt, render.stat_lines(
                fmt, F.col("project_name"), F.col("generated_at"), F.col("packed"), F.col("skipped"),
                lines, tokens, method))

        fixed = ["draft", "files_opening"] + (
            ["tree_opening", "tree_closing"] if options.include_tree else [])
        # the estimate is taken from a draft whose header has no figures yet
        rows = rows.withColumn("draft", header(F.lit(0), F.lit(0), F.lit("")))

        def whole(measure, names):
            terms = [f"block_{measure}", f"tree_{measure}", *(_MEASURES[measure].format(n) for n in names)]
            return F.expr(" + ".join(terms))

        rows = rows.withColumn("total_lines", whole("lines", fixed))
        heuristic = tx.heuristic_tokens(whole("chars", fixed))
        if options.token_counting == "off":
            rows = rows.withColumns({"tokens": F.lit(0).cast("long"), "method": F.lit(METHOD_OFF)})
        elif options.token_counting == "heuristic":
            rows = rows.withColumns({"tokens": heuristic, "method": F.lit(METHOD_HEURISTIC)})
        else:
            count = exact.document_tokens(options.include_tree)
            rows = rows.withColumn("exact", count).withColumns({
                "tokens": F.coalesce("exact", heuristic),
                "method": F.when(F.col("exact").isNull(), METHOD_HEURISTIC).otherwise(METHOD_EXACT)})
        rows = rows.withColumn("header", header(F.col("total_lines"), F.col("tokens"), F.col("method")))
        return rows.withColumn("file_size", whole("bytes", ["header", *fixed[1:]]))

    @property
    def report(self) -> DataFrame:
        """Statistics record per project."""
        return self.stats.select(
            "project_id", "project_name", F.col("packed").alias("packed_count"),
            F.col("skipped").alias("failed_count"), "file_size", "total_lines",
            F.col("source_lines").alias("total_source_lines"),
            F.col("tokens").alias("estimated_tokens"), F.col("method").alias("token_method"),
            F.lit(self._format).alias("output_format"),
            F.lit(self.options.include_tree).alias("include_tree"))

    def _frame(self) -> dict[int, str]:
        """Sections made of one row of the statistics."""
        frame = {HEADER: "header", FILES_OPENING: "files_opening"}
        return frame | ({TREE_OPENING: "tree_opening", TREE_CLOSING: "tree_closing"}
                        if self.options.include_tree else {})

    @property
    def _undecided(self) -> bool:
        """Whether rows of `_read` may still turn out to be ignored, or be so by chance of the key filter."""
        return self.root is None and self.classified.joins

    @cached_property
    def _packed(self) -> KeySet:
        return KeySet(self.facts.where("skip_reason is null"), ["project_id", "rel_path"])

    def _texts(self) -> DataFrame:
        """project_id, section, sort_key, text: all rows of the documents.  Blocks of files that are ignored
        don't go beyond the scan: if directories have a say in that, files are looked up among those of `facts`
        there, by which a few others pass."""
        frame = self.stats.select("project_id", F.explode(F.array(*[
            F.struct(F.lit(n).alias("section"), F.col(c).alias("text")) for n, c in self._frame().items()])).alias("row"))
        rows = frame.select("project_id", "row.section", F.lit("").alias("sort_key"), "row.text")
        blocks = self._read
        if self._undecided:
            blocks = blocks.where(self._packed.holds())
        elif self.root is None:
            blocks = self.classified.label(blocks).where("ignore_reason is null")
        rows = rows.unionByName(blocks.where("skip_reason is null").select(
            "project_id", F.lit(BLOCK).alias("section"), "sort_key", self._block().alias("text")))
        if self.options.include_tree:
            rows = rows.unionByName(self.tree.select(
                "project_id", F.lit(TREE).alias("section"), "sort_key", F.col("line").alias("text")))
        return rows

    def _keys(self) -> DataFrame:
        """project_id, section, sort_key of the documents' rows, and the bytes they add."""
        rows = self.stats.select("project_id", F.explode(F.array(*[
            F.struct(F.lit(n).alias("section"), (F.octet_length(c) + 1).cast("long").alias("bytes"))
            for n, c in self._frame().items()])).alias("row"))
        rows = rows.select("project_id", "row.section", F.lit("").alias("sort_key"), "row.bytes")
        rows = rows.unionByName(self.facts.where("skip_reason is null").select(
            "project_id", F.lit(BLOCK).alias("section"), "sort_key", "adds.bytes"))
        if self.options.include_tree:
            rows = rows.unionByName(self.tree.select("project_id", F.lit(TREE).alias("section"), "sort_key",
                                                     (F.octet_length("line") + 1).cast("long").alias("bytes")))
        return rows

    @cached_property
    def _bounds(self) -> list[str]:
        return key_bounds(self._keys().select(_place().alias("key"), "bytes"), "key", "bytes")

    def _parts(self) -> DataFrame:
        """project_id, section, sort_key, text, part: the rows in the partition `part`, in order."""
        part = part_number(_place(), self._bounds).cast("int")
        texts = self._texts().withColumn("part", part)
        many = len(self._bounds) + 1
        if not self._undecided:
            return texts.repartitionById(many, F.col("part")).sortWithinPartitions("part", *_KEY)
        # the keys meet the texts in the one shuffle that these need anyway
        wanted = self._keys().where(F.col("section") == BLOCK).drop("bytes").withColumns(
            {"part": part, "text": F.lit(None).cast("string"), "wanted": F.lit(True)})
        rows = texts.withColumn("wanted", F.col("section") != BLOCK).unionByName(wanted)
        rows = rows.repartitionById(many, F.col("part")).sortWithinPartitions("part", *_KEY)
        met = F.max("wanted").over(Window.partitionBy("part", *_KEY))
        return rows.withColumn("wanted", met).where("wanted and text is not null").drop("wanted")

    @property
    def sections(self) -> DataFrame:
        """The documents' rows, in order: project_id, section, sort_key, text.

        Each followed by a newline, they are the documents.  They lie in partitions of about equal bytes, whose
        bounds come from `facts`, so the contents are read once for these and once for the documents.
        """
        return self._parts().drop("part")

    @property
    def numbered(self) -> DataFrame:
        """The documents' rows with their place: project_id, position, text, in any order."""
        keys = with_position(self._keys().drop("bytes"), ["project_id"], ["section", "sort_key"], "position")
        nothing = F.lit(None)
        # keys and texts meet in the one shuffle that the texts need
        rows = self._texts().withColumn("position", nothing.cast("long")).unionByName(
            keys.withColumn("text", nothing.cast("string")))
        found = rows.withColumn("position", F.max("position").over(Window.partitionBy(*_KEY)))
        return found.where("text is not null and position is not null").select("project_id", "position", "text")

    def _rest(self) -> dict:
        return {"ignore_files": self.ignore_files, "root": self.root, "layout": self.layout, "warnings": self.warnings}

    def _outside(self, path: str) -> "Pack":
        """This pack without the folder `path`, if that lies in the packed directory."""
        if self.root is None or self.options.output_path is not None:
            return self
        rel = os.path.relpath(os.path.realpath(path), os.path.realpath(self.root))
        if rel.split(os.sep)[0] in (os.curdir, os.pardir):
            return self
        project, _, below = rel.replace(os.sep, "/").partition("/")
        if self.layout == "project":
            options = replace(self.options, output_path=rel.replace(os.sep, "/"))
        elif below:
            # one project's folder; the same path of another one stays
            clash = F.col("rel_path").eqNullSafe(below) | F.startswith("rel_path", F.lit(below + "/"))
            source = self.source.where((F.col("project_id") != project) | ~clash)
            return Pack(source, self.options, **self._rest())
        else:
            source = self.source.where(F.col("project_id") != project)
            return Pack(source, self.options, **self._rest())
        return Pack(self.source, options, **self._rest())

    def write(self, path: str, per_project: bool = False) -> DataFrame:
        """Writes the documents and returns the report.  A folder inside the packed directory
        is never packed itself."""
        pack = self._outside(path)
        write_sections(pack.sections, path, per_project)
        return pack.report

    def write_files(self, path: str) -> DataFrame:
        """Writes each document as one file and returns the report.

        A pack of one directory (layout 'project') writes the file `path`; others write a file for each project, named
        after it, into the folder `path`.  Any number of tasks write a file; see `write_files` in sources/documents.py.
        """
        pack = self._outside(path)
        one = self.root is not None and self.layout == "project"
        shares = pack._keys().withColumn("part", part_number(_place(), pack._bounds).cast("int"))
        suffix = None if one else ".md" if self._format == "markdown" else ".txt"
        write_files(pack._parts(), shares, pack.report.select("project_id", "file_size"), path, suffix)
        return pack.report


def pack_table(files: DataFrame, options: PackOptions | None = None, **kwargs) -> Pack:
    """Pack of a table with project_id, rel_path and content."""
    return Pack(files, options, **kwargs)


def pack_directory(spark, root: str, options: PackOptions | None = None, layout: str = "project") -> Pack:
    """Pack of a directory all executors can read.

    With layout 'collection' every directory in `root` is a project of its own.
    """
    options = options or PackOptions()
    ship_package(spark)
    listing = read_listing(spark, root, layout)
    rules = warnings = None
    if options.respect_ignore_files:
        found = durable(read_ignore_files(listing, root, layout))
        rules = found.where("content is not null").select("project_id", "dir", "name", "content")
        warnings = found.where("content is null").select("project_id", "rel_path", F.concat(
            F.lit("ignore file not applied: "), "read_error").alias("warning"))
    return Pack(listing, options, ignore_files=rules, root=root, layout=layout, warnings=warnings)
