"""Scopes, pruned directories and lookups by ranges of the tree's order."""

import random

from pyspark.sql import functions as F

from packmill.operators import inventory, lookup as lookup_module, rules
from packmill.operators.lookup import Lookup
from packmill.operators.ordering import in_order, running_max


def up(path):
    """The path and what is above it, the root last."""
    while path:
        yield path
        path = path.rpartition("/")[0]
    yield ""


def random_tree(seed, size):
    """Directories whose names sort on both sides of the separator."""
    rng, dirs = random.Random(seed), [""]
    while len(dirs) < size:
        path = f"{rng.choice(dirs)}/{rng.choice(['k', 'k-1', 'k 1', 'k~', 'é', 'm.n', '!', 'K'])}".lstrip("/")
        if path not in dirs:
            dirs.append(path)
    return dirs[1:]


def found_rules(spark, projects, ignore_files):
    files = spark.createDataFrame([(p, d, ".gitignore", t.encode()) for (p, d), t in ignore_files.items()],
                                  "project_id string, dir string, name string, content binary")
    entries = inventory.manifest(spark.createDataFrame(
        [(p, f"{d}/f" if d else "f") for p, dirs in projects.items() for d in dirs], "project_id string, rel_path string"))
    programs = rules.programs(rules.rules(rules.ignore_lines(files)))
    return rules.directory_verdicts(inventory.directories(entries), programs)


def test_scope_and_pruning_of_random_trees(spark):
    projects = {f"p{s}": random_tree(s, 80) for s in range(4)}
    rng, ignore_files = random.Random(5), {}
    for project, dirs in projects.items():
        for d in rng.sample(dirs, 12) + ([""] if project != "p0" else []):
            # the file names one subdirectory, as a literal pattern of its own directory
            ignore_files[project, d] = "/" + rng.choice(["k/", "m.n", "k~/", "none"]) + "\n"
    ignored = {(p, f"{d}/{t.strip().strip('/')}".lstrip("/")) for (p, d), t in ignore_files.items()}
    expected = {}
    for project, dirs in projects.items():
        for d in {a for one in dirs for a in up(one)}:
            scope = next((a for a in up(d) if (project, a) in ignore_files), None)
            if scope is not None:
                expected[project, d] = (scope, any((project, a) in ignored for a in up(d)))
    table = found_rules(spark, projects, ignore_files).directories.table
    got = {(r.project_id, r.parent): (r.scope, r.pruned) for r in table.collect()}
    assert got == expected
    assert {pruned for _, pruned in got.values()} == {True, False}


def test_deep_tree_is_not_unfolded(spark):
    """Rows that are sorted are as many as directories and marks, not as their depths."""
    deep = "/".join("d" for _ in range(400))
    ignore_files = {("p", ""): "*.log\n", ("p", "/".join(["d"] * 200)): "d/d/\n"}
    found = found_rules(spark, {"p": [deep]}, ignore_files).directories.table.collect()
    assert len(found) == 401
    by_depth = {len(r.parent.split("/")) if r.parent else 0: r for r in found}
    assert all(by_depth[n].pruned == (n >= 202) for n in range(401))
    assert all(len(by_depth[n].scope) == (0 if n < 200 else 399) for n in range(401))


def test_running_max_over_many_chunks(spark):
    rng = random.Random(3)
    data = [(g, n, rng.choice([None, rng.randrange(10_000)])) for g in ("a", "b", None) for n in range(700)]
    df = spark.createDataFrame(data, "g string, n int, v int").repartition(7)
    placed = in_order(df, ["g"], ["n"])
    for own in (True, False):
        got = {(r.g, r.n): r.m for r in running_max(placed, ["g"], F.col("v"), "m", own=own).collect()}
        expected, so_far = {}, {}
        for g, n, v in data:
            seen = so_far.get(g)
            now = max((x for x in (seen, v) if x is not None), default=None)
            expected[g, n], so_far[g] = (now if own else seen), now
        assert got == expected


def test_heavy_key_with_a_large_entry_is_spread(spark, monkeypatch):
    monkeypatch.setattr(lookup_module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lookup_module, "HOT_KEYS", 32)
    monkeypatch.setattr(lookup_module, "BROADCAST_BYTES", 32 * 50)
    rows = [("p", "hot" if n < 9000 else f"k{n % 50}", f"path{n}") for n in range(12000)] + [("p", "none", "x"), (None, "hot", "y")]
    table = [("p", "hot", 9000, "h" * 500)] + [("p", f"k{n}", 60, f"v{n}") for n in range(50)]
    entries = spark.createDataFrame(table, "project_id string, scope string, weight long, program string")
    found = Lookup(entries, ["project_id", "scope"], "weight").join(
        spark.createDataFrame(rows, "project_id string, scope string, path string"), F.col("path"), ["program"])
    values = {k: v for _, k, _, v in table}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for name in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.path, r.scope, r.program) for r in seen) == sorted(
        (path, k, values.get(k) if p else None) for p, k, path in rows)
    sizes = {}
    for r in seen:
        sizes[r.part] = sizes.get(r.part, 0) + 1
    # the key has three quarters of the rows, in some thirty places
    assert max(sizes.values()) < len(rows) / 8
