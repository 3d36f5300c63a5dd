"""Positions in an ordered result, without sorting a whole group in one task."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.operators.durable import durable


def _same(group: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group],
                  F.col("_chunk") == F.col("_share"))


def with_position(df: DataFrame, group: list[str], order: list[str | Column], out: str) -> DataFrame:
    """Adds the 1-based position of every row in its group; NULL is a group like any other.

    The rows are range-partitioned on group and order, so a large group spreads over
    many partitions; each row's place in its partition is written down together with
    the partition, and the rows that precede a partition's share of a group are added
    from a table with one row per group and partition.
    """
    placed = durable(
        df.orderBy(*group, *order)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()))
    shares = placed.groupBy(*group, "_chunk").agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_chunk").alias("_share"), "_first",
                           F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(shares, _same(group)).select(
        *df.columns, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(out))


def in_order(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """Rows spread by range, with the columns that `running_max` goes by: _chunk and _place."""
    return df.orderBy(*group, *order).withColumn("_chunk", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id())


def running_max(placed: DataFrame, group: list[str], value: Column, out: str, own: bool = True) -> DataFrame:
    """Adds the largest `value` of the rows of a group up to each one, with `own` its value too.

    `placed` comes from `in_order`.  Only a chunk is scanned in one task; what the chunks before
    it hold is added from a table with one row per group and chunk.  NULL counts for nothing.
    """
    in_chunk = Window.partitionBy(*group, "_chunk").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, 0 if own else -1)
    scanned = durable(placed.withColumn("_value", value).withColumn("_so_far", F.max("_value").over(in_chunk)))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shares = scanned.groupBy(*group, "_chunk").agg(F.max("_value").alias("_largest")).select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("_chunk").alias("_share"),
        F.max("_largest").over(before).alias("_before"))
    return scanned.join(shares, _same(group)).select(
        *placed.columns, F.greatest("_so_far", "_before").alias(out))
