"""Where links lead, for manifests that record only their targets."""

from pyspark.sql import Column, DataFrame, functions as F

from packmill.functions.paths import ancestors, parent, parts
from packmill.operators.durable import durable


def normalized(path: Column) -> Column:
    """Path with '.' and '..' folded; NULL if it leaves the root or is absolute."""
    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(
            F.concat(acc, F.array(part)))

    start = F.expr("array()").cast("array<string>")
    folded = F.aggregate(parts(path), start, step)
    return F.when(~path.startswith("/"), F.array_join(folded, "/"))


def link_location(path: Column, target: Column) -> Column:
    """Path a link names, seen from the root."""
    return normalized(F.when(target.startswith("/"), target).otherwise(
        F.concat_ws("/", F.when(parent(path) != "", parent(path)), target)))


def _above(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row per directory of the path in `column`, the path itself included, the root not."""
    chain = F.filter(ancestors(F.col(column), own=True), lambda d: d != "")
    return df.withColumn(out, F.explode(chain))


def _circular(next_link: DataFrame) -> DataFrame:
    """Links from which following `to` never ends; next_link: project_id, rel_path, to (a link).

    Pointer doubling: after k rounds a pointer is 2^k links ahead, so after as many rounds
    as the number of links has binary digits only circles have pointers left.
    """
    ahead, rounds = durable(next_link), 0
    limit = ahead.count().bit_length()
    while rounds <= limit:
        step = ahead.select("project_id", F.col("rel_path").alias("to"), F.col("to").alias("then"))
        ahead = durable(ahead.join(step, ["project_id", "to"]).select("project_id", "rel_path", F.col("then").alias("to")))
        rounds += 1
        if ahead.isEmpty():
            break
    return ahead.select("project_id", "rel_path")


def resolve_links(manifest: DataFrame) -> DataFrame:
    """Fills resolved_rel_path and target_kind of links from link_target.

    The first link on a path is replaced by the place where its own chain of links ends,
    which pointer doubling finds in as many rounds as the longest chain's length has binary
    digits; then the next link on the path, if there is one.  A path whose links lead in
    circles is unresolvable, as it is to the operating system.  No chain is too long.
    """
    base = manifest.drop("resolved_rel_path", "target_kind")
    path = F.col("rel_path")
    name = ["project_id", "rel_path"]
    open_ = durable(base.where(F.col("kind") == "link").select(
        *name, link_location(path, F.col("link_target")).alias("at")))
    links = open_.select("project_id", path.alias("via"))
    done = None
    while True:
        first = _above(open_.where(F.col("at").isNotNull()), "at", "via").join(links, ["project_id", "via"]).groupBy(
            *name).agg(F.min_by("via", F.length("via")).alias("to"))
        moved = durable(open_.join(first, name, "left"))
        settled = moved.where(F.col("to").isNull()).select(*name, "at")
        done = settled if done is None else done.unionByName(settled)
        waiting = moved.where(F.col("to").isNotNull())
        if waiting.isEmpty():
            break
        # links settled in earlier rounds end a chain like those settled in this one
        ends = done.select("project_id", path.alias("to"), F.col("at").alias("end"))
        circular = _circular(waiting.select(*name, "to"))
        done = done.unionByName(circular.withColumn("at", F.lit(None).cast("string")))
        ahead = durable(waiting.join(circular, name, "left_anti").select(
            *name, "to", F.substring(F.col("at"), F.length("to") + 1, F.length("at")).alias("rest")))
        placed = None
        while True:
            here = durable(ahead.join(ends, ["project_id", "to"]).select(
                *name, F.regexp_replace(F.concat("end", "rest"), "^/", "").alias("at")))
            placed = here if placed is None else placed.unionByName(here)
            on = ahead.join(ends, ["project_id", "to"], "left_anti")
            ends = ends.unionByName(here.select("project_id", path.alias("to"), F.col("at").alias("end")))
            step = ahead.select("project_id", path.alias("to"), F.col("to").alias("then"), F.col("rest").alias("own"))
            ahead = durable(on.join(step, ["project_id", "to"]).select(
                *name, F.col("then").alias("to"), F.concat("own", "rest").alias("rest")))
            if ahead.isEmpty():
                break
        open_ = durable(placed)

    # the kind of what is found; a directory may be known only from paths below it
    parents = base.select("project_id", parent(path).alias("dir")).distinct()
    things = base.where(F.col("kind") != "link").select(
        "project_id", F.col("rel_path").alias("at"), "kind").unionByName(
        parents.select("project_id", F.explode(ancestors(F.col("dir"), own=True)).alias("at"),
                       F.lit("dir").alias("kind")))
    kinds = things.groupBy("project_id", "at").agg(
        F.min("kind").alias("target_kind"))  # 'dir' before 'file'
    found = durable(done.join(kinds, ["project_id", "at"], "left").select(
        "project_id", "rel_path", F.col("at").alias("resolved_rel_path"), "target_kind"))
    plain = base.where(F.col("kind") != "link").withColumn(
        "resolved_rel_path", path).withColumn("target_kind", F.lit(None).cast("string"))
    linked = base.where(F.col("kind") == "link").join(found, ["project_id", "rel_path"], "left")
    return plain.unionByName(linked)
