"""ASCII directory trees of any number of projects, without recursion.

The place of a line is a sort key, its indentation a join with its directory: a
directory's indentation comes from the last-sibling flags of the directories above.
"""

from pyspark.sql import Column, DataFrame, functions as F

from packmill.constants import (
    BAR, BLANK, BRANCH, LAST_BRANCH, NOTE_DIR_LINK, NOTE_OUTSIDE, NOTE_REPEATED, UNREADABLE_LINK)
from packmill.functions.paths import ancestors, base_name, depth, order_key, parent
from packmill.operators.classify import Classified
from packmill.operators.durable import durable
from packmill.operators.lookup import lookup

# after a directory's line and before any child of it, whose key goes on with 0 or 1
_NOTE_KEY = "2"


def link_suffix(kind: Column, target: Column) -> Column:
    return F.when(kind == "link", F.concat(
        F.lit(" -> "), F.coalesce(target, F.lit(UNREADABLE_LINK)))).otherwise("")


def _bracketed(note: Column) -> Column:
    return F.coalesce(F.concat(F.lit("  ["), note, F.lit("]")), F.lit(""))


def _node(path: Column, is_dir: Column, label: Column) -> list[Column]:
    return [F.col("project_id"), path.alias("path"), parent(path).alias("parent"),
            is_dir.alias("is_dir"), order_key(path, is_dir).alias("sort_key"), label.alias("label")]


def directory_nodes(dirs: DataFrame) -> DataFrame:
    path = F.col("dir")
    return dirs.where(path != "").select(*_node(path, F.lit(True), F.concat(base_name(path), F.lit("/"))))


def file_nodes(files: DataFrame) -> DataFrame:
    """`files` are kept files and links to files: project_id, rel_path, kind, link_target, skip_reason."""
    path = F.col("rel_path")
    label = F.concat(base_name(path), link_suffix(F.col("kind"), F.col("link_target")),
                     _bracketed(F.concat(F.lit("skipped: "), F.col("skip_reason"))))
    return files.select(*_node(path, F.lit(False), label))


def link_nodes(classified: Classified) -> DataFrame:
    """Links that are shown but lead to no packed file: directories, the outside, nothing."""
    links = classified.entries.where(
        (F.col("kind") == "link") & F.coalesce(F.col("ignore_reason") == "outside_root", ~F.col("is_file")))
    path = F.col("rel_path")
    links = links.select("project_id", "rel_path", "parent", "link_target", "is_dir", "ignore_reason",
                         "resolved_rel_path", order_key(path, F.lit(False)).alias("sort_key"))
    identity = F.coalesce("dir_id", "dir")
    ids = classified.entries.where((F.col("kind") == "dir") & F.col("dir_id").isNotNull()).select(
        "project_id", F.col("rel_path").alias("dir"), "dir_id")
    # when the traversal first entered a directory with this identity
    first = classified.dirs.join(ids, ["project_id", "dir"], "left").groupBy(
        "project_id", identity.alias("identity")).agg(
        F.min(order_key(F.col("dir"), F.lit(True))).alias("visited"))
    targets = links.withColumnRenamed("resolved_rel_path", "dir").join(
        ids, ["project_id", "dir"], "left").withColumn("identity", identity)
    met = targets.join(first, ["project_id", "identity"], "left")
    note = (F.when(F.col("ignore_reason") == "outside_root", NOTE_OUTSIDE)
            .when(F.col("is_dir") & (F.col("visited") < F.col("sort_key")), NOTE_REPEATED)
            .when(F.col("is_dir"), NOTE_DIR_LINK))
    # few, and needed wherever the nodes are
    return durable(met.select(*_node(path, F.lit(False), F.concat(
        base_name(path), link_suffix(F.lit("link"), F.col("link_target")), _bracketed(note)))))


def siblings(nodes: DataFrame) -> DataFrame:
    """Per directory its last child and how many there are; an aggregate, so a directory
    of any width costs no single task more than its share."""
    return nodes.groupBy("project_id", F.col("parent").alias("dir")).agg(
        F.max_by("path", "sort_key").alias("last_child"), F.count("*").alias("children"))


def indentations(nodes: DataFrame, last: DataFrame) -> DataFrame:
    """Prefix of the lines inside a directory: project_id, dir, indent."""
    dirs = nodes.where("is_dir").select("project_id", F.col("path").alias("dir"), "parent")
    flags = dirs.join(last.withColumnRenamed("dir", "parent"), ["project_id", "parent"]).select(
        "project_id", F.col("dir").alias("above"),
        (F.col("dir") == F.col("last_child")).alias("is_last"))
    chain = dirs.select("project_id", "dir", F.explode(F.filter(
        ancestors(F.col("dir"), own=True), lambda d: d != "")).alias("above"))
    steps = chain.join(flags, ["project_id", "above"]).groupBy(
        "project_id", "dir").agg(F.array_sort(F.collect_list(F.struct(
            depth(F.col("above")).alias("depth"), "is_last"))).alias("steps"))
    return steps.select("project_id", "dir", F.array_join(F.transform(
        "steps", lambda s: F.when(s["is_last"], BLANK).otherwise(BAR)), "").alias("indent"))


def tree_lines(nodes: DataFrame, projects: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Lines of the trees: project_id, sort_key, line.

    `nodes` as above; `projects` has project_id and project_name; `notes` (project_id,
    dir, note) puts a remark in place of a directory's contents.
    """
    last = siblings(nodes)
    indents = indentations(nodes, last)
    inside = last.join(indents, ["project_id", "dir"], "left").withColumn(
        "indent", F.coalesce("indent", F.lit("")))
    placed = lookup(nodes, inside.withColumnRenamed("dir", "parent"), ["project_id", "parent"],
                    F.col("path"), weight="children")
    lines = placed.select("project_id", "sort_key", F.concat(
        "indent", F.when(F.col("path") == F.col("last_child"), LAST_BRANCH).otherwise(BRANCH),
        "label").alias("line"))
    roots = projects.select("project_id", F.lit("").alias("sort_key"),
                            F.concat("project_name", F.lit("/")).alias("line"))
    lines = lines.unionByName(roots)
    if notes is not None:
        key = F.concat(order_key(F.col("dir"), F.lit(True)), F.lit(_NOTE_KEY))
        lines = lines.unionByName(
            notes.join(indents, ["project_id", "dir"], "left").select(
                "project_id", key.alias("sort_key"), F.concat(
                    F.coalesce("indent", F.lit("")), F.lit(LAST_BRANCH + "["), F.col("note"),
                    F.lit("]")).alias("line")))
    return lines


def directory_notes(classified: Classified) -> DataFrame:
    """Remarks on directories whose contents are not shown."""
    repeated = classified.dirs.where("repeated").select(
        "project_id", "dir", F.lit(NOTE_REPEATED).alias("note"))
    failed = classified.entries.where(
        (F.col("kind") == "dir") & F.col("listing_error").isNotNull()
        & F.col("ignore_reason").isNull()).select(
        "project_id", F.col("rel_path").alias("dir"),
        F.concat(F.lit("Cannot access directory: "), F.col("listing_error")).alias("note"))
    return repeated.unionByName(failed)
