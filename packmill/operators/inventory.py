"""The manifest: one row per file, directory or link of a project.

    project_id, rel_path, kind ('file', 'dir', 'link'), size_bytes, link_target,
    resolved_rel_path (NULL: outside the root), target_kind, dir_id, listing_error
    and, for corpora kept in tables, content
"""

from pyspark.sql import DataFrame, functions as F

from packmill.functions.paths import ancestors, order_key, parent

OPTIONAL = ("link_target", "resolved_rel_path", "target_kind", "dir_id", "listing_error")


def manifest(df: DataFrame) -> DataFrame:
    """Completes a table that has at least project_id and rel_path.

    Adds `parent`, `is_dir` and `is_file`, the last two following links.
    """
    have = set(df.columns)
    if "kind" not in have:
        df = df.withColumn("kind", F.lit("file"))
    if "size_bytes" not in have:
        size = F.octet_length("content").cast("long") if "content" in have else F.lit(None).cast("long")
        df = df.withColumn("size_bytes", size)
    for name in OPTIONAL:
        if name not in have:
            df = df.withColumn(name, F.lit(None).cast("string"))
    target = F.when(F.col("kind") == "link", F.col("target_kind")).otherwise(F.col("kind"))
    return (df.withColumn("parent", parent(F.col("rel_path")))
            .withColumn("is_dir", F.coalesce(target == "dir", F.lit(False)))
            .withColumn("is_file", F.coalesce(target == "file", F.lit(False))))


def directories(entries: DataFrame) -> DataFrame:
    """Every directory below the roots: listed ones and those that some path implies.

    `entries` counts the rows directly inside.  Parents are grouped before their
    ancestors are unfolded, so this grows with the directories and not the files.
    """
    parents = entries.groupBy("project_id", F.col("parent").alias("path")).agg(
        F.count("*").alias("entries"))
    listed = entries.where(F.col("kind") == "dir").select("project_id", F.col("rel_path").alias("path"))
    known = parents.unionByName(listed.withColumn("entries", F.lit(0).cast("long")))
    chain = known.select("project_id", "path", "entries", F.explode(
        ancestors(F.col("path"), own=True)).alias("dir"))
    return chain.groupBy("project_id", "dir").agg(F.sum(F.when(
        F.col("dir") == F.col("path"), F.col("entries")).otherwise(0)).alias("entries"))


def repeated_directories(dirs: DataFrame) -> DataFrame:
    """Directories whose identity an earlier one, in traversal order, already has.

    `dirs` has project_id, dir and dir_id; rows without an identity are no repeats.
    """
    known = dirs.where(F.col("dir_id").isNotNull())
    key = order_key(F.col("dir"), F.lit(True))
    first = known.groupBy("project_id", "dir_id").agg(F.min_by("dir", key).alias("dir"))
    # joined on the directory itself, which no other row shares
    return known.join(first.select("project_id", "dir"), ["project_id", "dir"], "left_anti")
