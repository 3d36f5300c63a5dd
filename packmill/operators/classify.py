"""All ignore layers applied to a manifest, in the order cheap to dear."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from packmill.functions.paths import preorder_end, preorder_key
from packmill.functions.patterns import excluded
from packmill.operators import filters, inventory, rules
from packmill.operators.durable import durable, measured
from packmill.operators.lookup import Lookup
from packmill.operators.ordering import in_order, running_max
from packmill.options import PackOptions


@dataclass(frozen=True)
class Classified:
    """`entries`: completed manifest, without contents, plus ignore_reason (NULL: kept).
    `dirs`: directories the traversal enters: project_id, dir, entries, repeated.
    `label`: adds ignore_reason to other rows of the manifest that have its columns; `joins`:
    whether it joins them to what is known of directories."""

    entries: DataFrame
    dirs: DataFrame
    label: Callable[[DataFrame], DataFrame]
    joins: bool


def _is_output(path: Column, options: PackOptions) -> Column:
    """The document's own path, and what lies in it if it is a folder."""
    if not options.output_path:
        return F.lit(False)
    own = options.output_path.strip("/")
    return F.coalesce((path == own) | F.startswith(path, F.lit(own + "/")), F.lit(False))


def _dir_reason(options: PackOptions):
    path = F.col("dir")
    return F.when(filters.builtin_reason(path, F.lit(False)).isNotNull() | _is_output(path, options)
                  | excluded(path, F.lit(True), options.exclude_patterns), True)


def classify(source: DataFrame, options: PackOptions, ignore_files: DataFrame | None = None) -> Classified:
    """`ignore_files` (project_id, dir, name, content) overrides those found in `source`;
    give them for large corpora, so that looking for them does not read all contents."""
    whole = inventory.manifest(source)
    entries = whole.drop("content")
    outline = entries.select("project_id", "rel_path", "parent", "kind", "dir_id").where(
        (F.col("rel_path") != "") | (F.col("kind") == "dir"))
    dirs = inventory.directories(outline.where(F.col("rel_path") != "")).unionByName(
        outline.where(F.col("rel_path") == "").select(
            "project_id", F.lit("").alias("dir"), F.lit(0).cast("long").alias("entries"))
    ).groupBy("project_id", "dir").agg(F.sum("entries").alias("entries"))
    # far fewer than files, and needed several times
    dirs = durable(dirs.where(_dir_reason(options).isNull()))

    if not options.respect_ignore_files:
        ignore_files = None
    elif ignore_files is None and "content" in source.columns and rules.has_ignore_files(entries):
        ignore_files = rules.ignore_files(whole)
    verdicts = None
    if ignore_files is not None:
        # as large as the ignore files alone; looked for once
        rule_table, found = measured(rules.rules(rules.ignore_lines(ignore_files)), rows=F.count("*"))
        if found["rows"]:
            verdicts = rules.directory_verdicts(dirs, rules.programs(rule_table))
            pruned = verdicts.directories.table.where("pruned")
            dirs = dirs.join(pruned.select("project_id", F.col("parent").alias("dir")),
                             ["project_id", "dir"], "left_anti")

    if "dir_id" in source.columns:
        repeats, dirs = _repeats(durable(dirs), outline)
    else:
        repeats, dirs = None, dirs.withColumn("repeated", F.lit(False))

    def label(rows: DataFrame) -> DataFrame:
        path, is_file, is_dir, kind = (F.col(c) for c in ("rel_path", "is_file", "is_dir", "kind"))
        rows = rows.where(path != "")
        if verdicts is not None:
            rows = rules.with_verdict(rows, verdicts)
        else:
            rows = rows.withColumns({"rule_pruned": F.lit(False), "rule_ignored": F.lit(False)})
        if repeats is not None:
            rows = repeats.join(rows, path, ["below_repeat"])
        else:
            rows = rows.withColumn("below_repeat", F.lit(None).cast("boolean"))
        parent = F.col("parent")
        outside = (kind == "link") & F.col("resolved_rel_path").isNull()
        # what holds for the directories above holds for an entry, wherever a link leads
        with_links = [F.when(kind == "link", filters.builtin_reason(parent, F.lit(False)))
                      ] if "link_target" in source.columns else []
        inherited = F.coalesce(
            *with_links,
            F.when(F.col("below_repeat"), "repeated_directory"),
            F.when(excluded(parent, F.lit(True), options.exclude_patterns), "user_glob"),
            F.when(F.col("rule_pruned"), "ignore_file"))
        met = F.coalesce(F.expr(options.extra_filter), F.lit(False)) if options.extra_filter else F.lit(True)
        own = F.coalesce(
            filters.builtin_reason(path, is_file, F.col("resolved_rel_path")),
            F.when(excluded(path, is_dir, options.exclude_patterns), "user_glob"),
            F.when(F.col("rule_ignored"), "ignore_file"),
            F.when(~met & (kind != "dir"), "extra_filter"),
            F.when(_is_output(F.coalesce(F.col("resolved_rel_path"), path), options) | _is_output(path, options),
                   "output_file"),
            F.when(filters.is_leftover(path, kind), "leftover"))
        reason = F.coalesce(inherited, F.when(outside, "outside_root").otherwise(own))
        return rows.withColumn("ignore_reason", reason).drop("rule_pruned", "rule_ignored", "below_repeat")

    return Classified(label(entries), dirs, label, verdicts is not None or repeats is not None)


def by_path_alone(options: PackOptions) -> Column:
    """Whether a row's own path keeps it.  `classify` says the same and more; as a filter of
    its own this needs no join, so Spark drops most ignored rows, contents and all, before."""
    path, is_file = F.col("rel_path"), F.col("is_file")
    return (filters.builtin_reason(path, is_file, F.col("resolved_rel_path")).isNull()
            & ~excluded(path, F.col("is_dir"), options.exclude_patterns))


def _repeats(dirs: DataFrame, outline: DataFrame) -> tuple[Lookup, DataFrame]:
    """Directories below one whose identity was met before, and `dirs` without them."""
    ids = outline.where((F.col("kind") == "dir") & F.col("dir_id").isNotNull()).select(
        "project_id", F.col("rel_path").alias("dir"), "dir_id")
    path = F.col("dir")
    repeats = inventory.repeated_directories(dirs.join(ids, ["project_id", "dir"])).select(
        "project_id", "dir", F.lit(True).alias("repeated"))
    rows = dirs.join(repeats, ["project_id", "dir"], "left").select(
        "project_id", "dir", "entries", F.coalesce("repeated", F.lit(False)).alias("repeated"),
        preorder_key(path).alias("key"))
    # the repeated directory itself stays, with a note; what is below goes
    scanned = running_max(in_order(rows, ["project_id"], ["key"]), ["project_id"],
                          F.when(F.col("repeated"), preorder_end(path)), "end", own=False)
    scanned = scanned.select("project_id", "dir", "entries", "repeated",
                             F.coalesce(F.col("end") > F.col("key"), F.lit(False)).alias("below"))
    marks = Lookup(scanned.where("repeated or below").select(
        "project_id", path.alias("parent"), "entries", F.lit(True).alias("below_repeat")),
        ["project_id", "parent"], "entries")
    return marks, durable(scanned.where("not below").drop("below"))
