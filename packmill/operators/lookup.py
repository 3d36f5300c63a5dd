"""Left join to a table with one row per key, balanced when few keys own most rows."""

from pyspark.sql import Column, DataFrame, functions as F

from packmill.operators.durable import measured

# A table is broadcast whole only if it was measured to be no larger than this.
BROADCAST_BYTES = 16 * 1024 * 1024
BROADCAST_ROWS = 200_000
# Any key beyond the heaviest HOT_KEYS owns less than 1/HOT_KEYS of all rows.
HOT_KEYS = 256


def _size(table: DataFrame) -> Column:
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in table.dtypes if kind == "string"]
    return sum(texts[1:], texts[0]).cast("long") if texts else F.lit(0).cast("long")


class Lookup:
    """A table with one row per key, materialised and measured once, for any number of joins.

    A small one is broadcast.  Otherwise only the entries of the heaviest keys are, at most
    HOT_KEYS of them and none above its share of BROADCAST_BYTES; `weight` names the table's
    column with the number of rows per key.  Rows that found theirs get a join key of their
    own, made from `spread`, a column that differs from row to row, and all keys left are
    light, so the shuffled join is balanced.  An entry above that share stays where it is but is
    repeated, the more often the more rows its key has, and each row goes to one of its places.
    The rows are read once.
    """

    def __init__(self, table: DataFrame, keys: list[str], weight: str):
        self.keys, self.weight = keys, weight
        self.table, found = measured(table, rows=F.count("*"), size=F.coalesce(F.sum(_size(table)), F.lit(0)),
                                     weight=F.coalesce(F.sum(weight), F.lit(0)))
        # a key with more rows is spread over several places
        self.share = max(1, int(found["weight"]) // HOT_KEYS)
        self.small = found["rows"] <= BROADCAST_ROWS and found["size"] <= BROADCAST_BYTES

    def join(self, rows: DataFrame, spread: Column, values: list[str]) -> DataFrame:
        """`rows` with the columns `values` of the table, NULL where no key matches."""
        table = self.table.select(*self.keys, self.weight, *values)
        if self.small:
            return rows.join(F.broadcast(table.drop(self.weight)), self.keys, "left")
        entries = table.select(*self.keys, self.weight, F.struct(*values).alias("_entry"), _size(table).alias("_size"))
        fits = F.col("_size") <= BROADCAST_BYTES // HOT_KEYS

        def heaviest(condition: Column) -> DataFrame:
            return entries.where(condition).orderBy(F.desc(self.weight)).limit(HOT_KEYS)

        hot = heaviest(fits).select(*self.keys, F.col("_entry").alias("_hot"))
        places = F.ceil(F.col(self.weight) / self.share).cast("int")
        large = heaviest(~fits & (F.col(self.weight) > self.share)).select(*self.keys, places.alias("_places"))
        *outer, last = self.keys
        probed = rows.join(F.broadcast(hot.unionByName(large, allowMissingColumns=True)), self.keys, "left")
        place = F.pmod(F.xxhash64(spread), F.col("_places")).cast("string")
        probed = probed.withColumn("_key", F.when(F.col("_hot").isNotNull(), F.concat(F.lit("\0"), spread)).when(
            F.col("_places").isNotNull(), F.concat(F.col(last), F.lit("\0"), place)).otherwise(F.col(last))).drop("_places")
        repeated = entries.drop(self.weight, "_size").join(F.broadcast(large), self.keys, "left").withColumn(
            "_place", F.explode(F.when(F.col("_places").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
                F.sequence(F.lit(0), F.col("_places") - 1))))
        repeated = repeated.select(*outer, "_entry", F.when(F.col("_place").isNull(), F.col(last)).otherwise(
            F.concat(F.col(last), F.lit("\0"), F.col("_place").cast("string"))).alias("_key"))
        found = probed.join(repeated, [*outer, "_key"], "left")
        return found.select(
            *[F.col(c) for c in rows.columns],
            *[F.coalesce(F.col("_hot")[v], F.col("_entry")[v]).alias(v) for v in values])


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, weight: str) -> DataFrame:
    """`rows` with the columns of `table`, for a table that is joined once."""
    values = [c for c in table.columns if c not in keys and c != weight]
    return Lookup(table, keys, weight).join(rows, spread, values)
