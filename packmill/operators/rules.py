"""Ignore files: lines, rules, and the verdict on directories and files."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from packmill.constants import TOOL_IGNORE_FILE
from packmill.functions import ignore_rules as ir
from packmill.functions.paths import ancestors, base_name, depth, parent, preorder_end, preorder_key
from packmill.operators.filters import is_ignore_file
from packmill.operators.lookup import Lookup
from packmill.operators.ordering import in_order, running_max


def ignore_files(entries: DataFrame) -> DataFrame:
    """Ignore files of a completed manifest with content: project_id, dir, name, content."""
    path = F.col("rel_path")
    return entries.where(is_ignore_file(path, F.col("is_file"))).select(
        "project_id", parent(path).alias("dir"), base_name(path).alias("name"), "content")


def has_ignore_files(entries: DataFrame) -> bool:
    """Whether there are any; reads paths only, so that a corpus without ignore files is
    spared a pass over its contents."""
    return not entries.where(is_ignore_file(F.col("rel_path"), F.col("is_file"))).select(
        "rel_path").isEmpty()


def ignore_lines(files: DataFrame) -> DataFrame:
    """Their lines; a byte order mark is dropped and malformed UTF-8 replaced."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "")
    return files.select("project_id", "dir", "name", F.posexplode(ir.split_lines(text))).select(
        "project_id", "dir", "name", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def rules(lines: DataFrame) -> DataFrame:
    """Compiled rules.  `rule_order` orders a project's rules; the last match decides:
    by depth, then the tool's file after the version control's, directory and line."""
    line, dir_path = F.col("line"), F.col("dir")
    order = F.struct(
        depth(dir_path).alias("depth"), (F.col("name") == TOOL_IGNORE_FILE).alias("is_tool"),
        dir_path.alias("dir"), F.col("line_no").alias("line_no"))
    given = lines.where(ir.is_rule(line)).select(
        "project_id", "dir", order.alias("rule_order"), (~ir.negates(line)).alias("ignore"),
        ir.pattern_of(line, dir_path).alias("pattern"))
    compiled = ir.with_regex(given.where("pattern is not null"))
    return compiled.select(
        "project_id", "dir", "rule_order",
        ir.rebased(F.col("ignore"), F.col("pattern"), dir_path).alias("line"),
        "ignore", "regex", "dir_only")


def programs(rule_table: DataFrame) -> DataFrame:
    """One regex per directory with an ignore file: project_id, scope, above (the next such
    directory above it, if any), program.

    It covers that file's rules and those of every directory above.  A list of rules
    is as long as the ignore files on one path from the root, whatever the project's size.
    """
    rule = F.struct("rule_order", "ignore", "regex")
    own = rule_table.groupBy("project_id", F.col("dir").alias("scope")).agg(
        F.collect_list(rule).alias("own_rules"))
    chain = own.select("project_id", F.col("scope").alias("below"), F.explode(
        ancestors(F.col("scope"), own=True)).alias("scope"))
    upper = F.col("scope") != F.col("below")
    merged = chain.join(own, ["project_id", "scope"]).groupBy("project_id", "below").agg(
        F.array_sort(F.flatten(F.collect_list("own_rules"))).alias("all_rules"),
        F.max_by("scope", F.when(upper, depth(F.col("scope")))).alias("above"))
    return merged.select("project_id", F.col("below").alias("scope"), "above",
                         ir.program(F.col("all_rules")).alias("program"))


@dataclass(frozen=True)
class Verdicts:
    """What rules say of the directories.

    `directories`: project_id, dir, entries, scope (the directory whose rules are in force)
    and pruned.  `programs`: one regex per scope, which no directory repeats.
    """

    directories: Lookup
    programs: Lookup


def _in_force(dirs: DataFrame, program_table: DataFrame) -> DataFrame:
    """Directories in or below one with an ignore file, with `scope`, the nearest such one.

    In the order of the tree a scope begins at its directory, and after its last one the scope
    above is in force again; the latest of these marks decides.  No directory is unfolded to
    those above it, so rows are as many as directories.
    """
    scope = F.col("scope")

    def mark(key: Column, now: Column) -> Column:
        return F.struct(key.alias("key"), now.alias("scope"))

    marks = program_table.select("project_id", F.explode(F.array_compact(F.array(
        mark(preorder_key(scope), scope),
        F.when(scope != "", mark(preorder_end(scope), F.col("above")))))).alias("mark")).select(
        "project_id", F.col("mark.key").alias("key"), "mark")
    rows = dirs.select("project_id", "dir", "entries", preorder_key(F.col("dir")).alias("key"))
    ordered = in_order(rows.unionByName(marks, allowMissingColumns=True), ["project_id"],
                       ["key", F.col("dir").isNotNull()])
    return running_max(ordered, ["project_id"], F.col("mark"), "latest").where(
        "dir is not null and latest.scope is not null").select(
        "project_id", "dir", "entries", "key", F.col("latest.scope").alias("scope"), "_chunk", "_place")


def directory_verdicts(dirs: DataFrame, program_table: DataFrame) -> Verdicts:
    """For every directory the scope in force and whether a rule prunes it.

    `dirs` has project_id, dir, entries.  A directory is pruned if it or one above it is
    ignored, each tried as it is and with a slash at its end.  What a file says holds below
    its directory, so every directory is tried once, by the rules in force there, and what
    is below an ignored one is a range of the order.  A scope near the root may hold most
    directories of a project, so joins on scopes go through a Lookup.
    """
    path, program = F.col("dir"), F.col("program")
    nearest = _in_force(dirs, program_table)
    below = nearest.groupBy("project_id", "scope").agg(F.sum(F.col("entries") + 1).alias("below"))
    programs = Lookup(program_table.drop("above").join(below, ["project_id", "scope"]), ["project_id", "scope"], "below")
    ruled = programs.join(nearest, path, ["program"])
    ignored = (path != "") & (ir.ignored_by(path, program) | ir.ignored_by(F.concat(path, F.lit("/")), program))
    ruled = ruled.withColumn("reach", F.when(ignored, preorder_end(path))).drop("program")
    ends = running_max(ruled, ["project_id"], F.col("reach"), "end")
    found = ends.select("project_id", path.alias("parent"), "entries", "scope",
                        F.coalesce(F.col("end") > F.col("key"), F.lit(False)).alias("pruned"))
    return Verdicts(Lookup(found, ["project_id", "parent"], "entries"), programs)


def with_verdict(entries: DataFrame, verdicts: Verdicts) -> DataFrame:
    """Adds `rule_pruned`, a directory above is ignored, and `rule_ignored`, the entry is.

    `entries` are rows of a completed manifest, without contents, which need not travel here.
    """
    path, program = F.col("rel_path"), F.col("program")
    found = verdicts.directories.join(entries, path, ["scope", "pruned"])
    found = verdicts.programs.join(found, path, ["program"])
    own = ir.ignored_by(path, program) | (
        F.col("is_dir") & ir.ignored_by(F.concat(path, F.lit("/")), program))
    return found.withColumn("rule_pruned", F.coalesce("pruned", F.lit(False))).withColumn(
        "rule_ignored", F.col("rule_pruned") | own).drop("scope", "program", "pruned")
