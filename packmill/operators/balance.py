"""Rows dealt into ordered partitions of about equal weight, from narrow rows that tell the weights.

Spark's own range partitioning counts rows, which may be of any size, and reads its input once more to sample it.
"""

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.operators.durable import durable

# what a partition holds at least if there are more than the session's number of them, and how many there may be:
# the driver gets one key for each
PART_BYTES = 128 * 1024 * 1024
MOST_PARTS = 20_000


def key_bounds(rows: DataFrame, key: str, weight: str, parts: int | None = None) -> list[str]:
    """The least keys of all parts but the first, if rows(key, weight) are cut in the order of their key, a string, into
    `parts` of equal weight.  A row heavier than a part makes parts that nobody is in."""
    spark = rows.sparkSession
    ordered = durable(rows.select(key, weight).orderBy(key).withColumn("_chunk", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id()))
    shares = ordered.groupBy("_chunk").agg(F.sum(weight).alias("_weight"))
    chunks = {r._chunk: r._weight for r in shares.collect()}  # one row per task of the sort
    total, before = 0, {}
    for chunk in sorted(chunks):
        before[chunk] = total
        total += chunks[chunk]
    if parts is None:
        parts = min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_BYTES)))
    if not total or parts < 2:
        return []
    start = spark.createDataFrame(list(before.items()), "_chunk int, _before long")
    within = Window.partitionBy("_chunk").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row belongs where its middle falls
    middle = 2 * (F.col("_before") + F.sum(weight).over(within)) - F.col(weight)
    part = F.least(F.floor(middle * parts / (2 * total)), F.lit(parts - 1)).alias("part")
    found = ordered.join(F.broadcast(start), "_chunk").select(key, part).groupBy("part").agg(F.min(key).alias("first")).collect()
    first = {r.part: r.first for r in found}
    bounds, following = [], None
    for number in range(parts - 1, 0, -1):
        following = first.get(number, following)
        bounds.append(following)
    return [b for b in reversed(bounds) if b is not None]


def part_number(key: Column, bounds: list[str]) -> Column:
    """How many of the bounds are no larger than the key, found in two steps."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    coarse = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<string>")
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<string>>")
    passed = F.size(F.filter(coarse, lambda b: b <= key))
    inside = F.size(F.filter(F.get(fine, passed), lambda b: b <= key))
    return F.when(passed < len(groups), passed * width + inside).otherwise(len(bounds))
