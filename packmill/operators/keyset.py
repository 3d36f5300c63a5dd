"""Which keys are among many, tested where rows are read."""

from pyspark.sql import Column, DataFrame, functions as F

# Bits for each key, and bounds of their number: 4 KB to 32 MB are sent to the tasks, however many keys there are.
# Beyond some 16 million keys more of the others pass, which costs time and no correctness.
BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28


class KeySet:
    """A Bloom filter of the values of `columns` in `keys`, with two bits a key.

    `holds` is true for every key and, while there are enough bits, for one in seventy of the others; so rows
    can be dropped on the scan, and what is left still has to meet the keys themselves.
    """

    def __init__(self, keys: DataFrame, columns: list[str]):
        self.columns = columns
        wanted = max(LEAST_BITS, min(MOST_BITS, keys.count() * BITS_PER_KEY))
        self.size = 1 << (wanted - 1).bit_length()
        places = keys.select(F.explode(F.array(*self._places())).alias("place"))
        # Spark's bitmaps hold 32,768 bits each, counted from 1
        found = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toArrow()
        bits = bytearray(self.size // 8)
        for bucket, part in zip(found.column("bucket").to_pylist(), found.column("bits").to_pylist(), strict=True):
            start = (bucket - 1) * LEAST_BITS // 8
            bits[start:start + len(part)] = part
        self.bits = bytes(bits)

    def _places(self) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(n), *self.columns), F.lit(self.size)) + 1 for n in (1, 2)]

    def _bit(self, place: Column) -> Column:
        at = place - 1
        byte = F.substring(F.lit(self.bits), F.floor(at / 8).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("long")
        return F.call_function("getbit", value, F.pmod(at, F.lit(8)).cast("int")) == 1

    def holds(self) -> Column:
        one, two = (self._bit(p) for p in self._places())
        return one & two
