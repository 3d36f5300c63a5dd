"""Connected components of an edge table by alternating stars; nothing meets in the driver."""

from pyspark.sql import DataFrame, functions as F

from packmill.llm.common import Scratch

# A node with more than this part of all rows is joined apart from the others; there are fewer than so many.
HOT = 100


def _with_least(rows: DataFrame, key: str, least: DataFrame, many: int) -> DataFrame:
    """`rows` with the column m of least(key, m, c), where c is how many rows have the key.

    A star's root is the key of all its rows: the few heaviest keys are broadcast, so that
    no task gets the rows of one of them."""
    heavy = F.broadcast(least.where(F.col("c") * HOT > many).select(key, "m"))
    light = least.where(F.col("c") * HOT <= many).select(key, "m")
    return rows.join(heavy, key).union(rows.join(heavy, key, "left_anti").join(light, key))


def _large_star(edges: DataFrame, many: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Neighbours above a node move to the least node of its neighbourhood."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select(
        "u", F.least("u", "m").alias("m"), "c"))
    return _with_least(both.where("v > u"), "u", least, 2 * many).select(F.col("v").alias("a"), F.col("m").alias("b")), least


def _small_star(edges: DataFrame, many: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Neighbours below a node, and the node, move to the least of them.  Edges are (a, b) with a > b."""
    least = scratch.table(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")))
    moved = _with_least(edges, "a", least, many).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct(), least


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of links(a, b) that is not the least of its component.

    Edges (pairs of longs, in any direction and number) are turned into stars around the
    least node.  Groups are only ever reduced to their minimum, so a node with very many
    neighbours needs no room in one task.
    """
    edges = scratch.table(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        larger, one = _large_star(edges, before[0], scratch)
        larger = scratch.table(larger.distinct())
        last, (smaller, two) = edges, _small_star(larger, before[0], scratch)
        edges = scratch.table(smaller)
        scratch.drop(last, one, larger, two)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
