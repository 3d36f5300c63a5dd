"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Codes are cut into m segments.  If all codes whose segments lie within radius r of the
query's have been met, everything within m * (r + 1) - 1 bits has; so the radius grows
until that covers the k-th verified distance.  Rows of equal codes are one entry with its
least ids, so that copies neither fill a bucket nor multiply candidates.
"""

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.llm.common import Scratch

BITS = 64
NEIGHBOURS = 10


def sign_code(vector: Column) -> Column:
    """The signs of up to 64 numbers as the bits of a long, the first lowest."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _segments(bits: int, m: int) -> list[tuple[int, int]]:
    """(first bit, width) of m segments of about equal width."""
    ends = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _least(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The k least rows of each group.  Spark cuts groups to k rows before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, bits: int = BITS) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest other rows of each query.

    codes(id, code) and queries(id, code) hold longs whose `bits` lowest bits are the code.
    Nearest is by Hamming distance, then id; the row of the query's own id is left out.  A
    query finds fewer than k if there are no more rows.  Rows without id or code are
    neither found nor queries; of rows that repeat an id and a code one counts.
    """
    spark = codes.sparkSession
    scratch = Scratch(spark)
    whole = codes.where("id is not null and code is not null").select("id", "code").distinct()
    # per code its k + 1 least ids: enough for any query, its own row included
    entries = scratch.table(_least(whole, ["code"], ["id"], k + 1).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    many = max(2, entries.count())
    m = max(1, min(bits // 2, round(bits / max(1.0, math.log2(many)))))
    segments = _segments(bits, m)
    index = scratch.table(entries.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("first"), F.posexplode(F.array(
        *[_segment(F.col("code"), a, w) for a, w in segments])).alias("seg", "value")))
    asked = scratch.table(queries.where("id is not null and code is not null").select("id", "code").distinct())
    active = scratch.table(asked.select(F.col("code").alias("query")).distinct())
    best = done = None
    for radius in range(max(w for _, w in segments) + 1):
        probes = []
        for seg, (first, width) in enumerate(segments):
            flips = [sum(1 << b for b in c) for c in combinations(range(width), radius)]
            if flips:
                masks = F.array(*[F.lit(x).cast("long") for x in flips]) if len(flips) < 200 else F.from_json(
                    F.lit(str(flips)), "array<bigint>")
                probes.append(active.select("query", F.lit(seg).alias("seg"), _segment(F.col("query"), first, width).alias("own"),
                                            F.explode(masks).alias("flip")))
        every = probes[0]
        for p in probes[1:]:
            every = every.union(p)
        # Spark would take the probes for as small as the queries they are made of, and broadcast them
        every = every.select("query", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("value")).hint("merge")
        met = every.join(index, ["seg", "value"])
        met = met.select("query", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"), "code", "n", "first")
        met = (met if best is None else met.union(best.join(active, "query"))).distinct()
        found = scratch.table(_least(met, ["query"], ["distance", "first", "code"], k + 1))
        covered = m * (radius + 1) - 1
        enough = found.where(F.col("distance") <= covered).groupBy("query").agg(F.sum("n").alias("rows")).where(
            F.col("rows") >= k + 1).select("query")
        last = radius == max(w for _, w in segments)
        finished = found if last else found.join(enough, "query", "left_semi")
        done = finished if done is None else done.union(finished)
        if last:
            break
        active = scratch.table(active.join(enough, "query", "left_anti"))
        best = found
        if not active.head(1):
            break
    rows = done.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    pairs = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(
        _least(rows, ["query"], ["distance", "neighbor_id"], k + 1), "query").where("query_id <> neighbor_id")
    order = Window.partitionBy("query_id", "query").orderBy("distance", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))


def op5_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return nearest_codes(codes, codes.where(F.col("id") % 100 == 0))


OP5_SQL = """
WITH c AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1),
             lambda i : CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END)) AS code
           FROM (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, bit_count(xor(q.code, c.code)) AS distance
      FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10"""
