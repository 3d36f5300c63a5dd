"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised into cells of about equal weight by the quantiles of all rows, the
cells' place on the curve orders the rows, and runs of the order with equal bytes become
shards.  Neighbours on the curve are neighbours in every dimension, so a shard covers a small
box of each and files can be skipped by their minima and maxima in any of them.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.llm.common import Scratch, bundled, extended, map_batches

SHARDS = 24
BITS = 10
OVERHEAD = 8
_PREFIX = 7


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows, dimensions), each below 2 ** bits."""
    x = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    zero = np.uint64(0)
    for bit in range(bits - 1, 0, -1):  # undo the rotations and reflections, from the coarsest square
        q, p = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for k in range(len(x)):
            inside = (x[k] & q) != 0
            swap = np.where(inside, zero, (x[0] ^ x[k]) & p)
            x[0] = x[0] ^ np.where(inside, p, swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):  # Gray code
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(bit)) & np.uint64(1) != 0, np.uint64((1 << bit) - 1), zero)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for part in x:
            out = (out << np.uint64(1)) | (((part ^ flip) >> np.uint64(bit)) & np.uint64(1))
    return out.astype(np.int64)


def text_sizes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _codes(docs: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a long of the same order, null first (-1 below all strings)."""
    kinds = dict(docs.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    ends = docs.agg(F.lit(0), *[f(F.col(f"`{d}`")) for d in texts for f in (F.min, F.max)]).first()[1:] if texts else ()
    common = {}
    for k, d in enumerate(texts):
        lo, hi = ((x or "").encode() for x in ends[2 * k:2 * k + 2])
        common[d] = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
    codes = []
    for d in dims:
        value = F.col(f"`{d}`")
        if d in common:  # the bytes that follow what all values share
            digits = F.hex(F.substring(value.cast("binary"), common[d] + 1, _PREFIX))
            value = F.conv(F.rpad(digits, 2 * _PREFIX, "0"), 16, 10)
        codes.append(F.coalesce(value.cast("long"), F.lit(-1)))
    return codes


def _counted(batches):
    """Adds, within the task: its number, the row's place, the sizes up to and with it."""
    part, place, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        upto = np.cumsum(np.asarray(batch.column("size"))) + size
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(place, place + n)), pa.array(upto)],
            [*batch.schema.names, "part", "place", "upto"])
        place, size = place + n, int(upto[-1]) if n else size


def _summed(rows: DataFrame, order: list[str], drop: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (less the columns `drop`) in order, with what `_counted` adds, as a table; and per
    task of the sort the sums of sizes and rows before it and the total of all."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*drop)
    ordered = scratch.table(map_batches(ordered, _counted, extended(ordered, [], "part int, place long, upto long")))
    parts = ordered.groupBy("part").agg(F.max("upto").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the sort
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ordered, parts.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                                 F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                                 F.sum("bytes").over(everything).alias("total"))


def _cuts(rows: DataFrame, names: list[str], bits: int) -> list[np.ndarray]:
    """Per dimension the codes at which cells begin: the quantiles of all rows.

    Values are counted and sorted; those at which the count passes a mark come to the driver, at
    most 2 ** bits - 1 of each dimension.
    """
    scratch, marks = Scratch(rows.sparkSession), (1 << bits) - 1
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(n).alias("code"))
                                             for k, n in enumerate(names)])).alias("value")).select("value.*")
    counts = values.groupBy("dim", "code").agg(F.count("*").alias("size"))
    ordered, parts = _summed(counts, ["dim", "code"], [], scratch)
    # every dimension counts all rows, so dimension k begins after k times as many
    each = f"(total div {len(names)})"
    passed = lambda upto: F.expr(f"least({marks}, ({upto} - dim * {each}) * {1 << bits} div {each})")
    got = ordered.join(F.broadcast(parts), "part").select(
        "dim", "code", passed("bytes_before + upto").alias("upto"), passed("bytes_before + upto - size").alias("before"))
    got = sorted(got.where("upto > before").collect())
    scratch.drop(ordered)
    return [np.repeat(np.array([r.code for r in got if r.dim == k], np.int64),
                      np.array([r.upto - r.before for r in got if r.dim == k], np.int64)) for k in range(len(names))]


def _placed(cuts: list[np.ndarray], bits: int):
    """Adds the place on the curve.  A value's cell is the middle of the cells it could have."""
    def placed(batches):
        for batch in batches:
            cells = []
            for k, cut in enumerate(cuts):
                code = np.asarray(batch.column(f"_d{k}"))
                cells.append((np.searchsorted(cut, code, "left") + np.searchsorted(cut, code, "right")) // 2)
            index = hilbert_index(np.stack(cells, axis=1), bits)
            kept = [n for n in batch.schema.names if not n.startswith("_d")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(index)], [*kept, "curve"])
    return placed


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "n_bytes"), text: str = "text",
                   key: str = "doc_id", shards: int = SHARDS, bits: int = BITS, size: Column | None = None,
                   crc: Column | None = None) -> DataFrame:
    """Documents (struct `row`) with size, text_crc32, curve, shard and slot.

    size is the UTF-8 bytes of the text (none for null) and 8, text_crc32 the unsigned crc32 of
    these bytes, unless given as columns.  dims are string or integer columns; `n_bytes`, if
    the table has no such column, stands for size.  Shards are consecutive runs of the order by curve, then
    text_crc32, then key; a row belongs to the shard in which the middle of its bytes falls
    if the bytes of all rows are cut into `shards` equal parts, so that shards differ by
    about one document, and a shard may be empty if a document is larger than a part.  slot
    numbers the rows of a shard from 0 in this order.  Nulls come first in every dimension;
    repeated rows keep each a slot of its own.  Equal texts lie together where their
    dimensions agree; a group of copies larger than a shard is cut like any run.  The input is read several times
    (ranges of the dimensions, cells, the sort), so it should be a table.
    """
    scratch = Scratch(docs.sparkSession)
    size = text_sizes(F.col(text)) if size is None else size
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) if crc is None else crc
    sized = docs.withColumn("n_bytes", size) if "n_bytes" in dims and "n_bytes" not in docs.columns else docs
    names = [f"_d{k}" for k in range(len(dims))]
    codes = [c.alias(n) for n, c in zip(names, _codes(sized, list(dims)), strict=True)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = sized.select(row, F.col(key).alias("id"), size.alias("size"), crc.alias("text_crc32"), *codes)
    cuts = _cuts(sized.select(*codes), names, bits)
    # the sort samples its input first; the row number splits rows equal in all else
    placed = map_batches(rows, _placed(cuts, bits), extended(rows, names, "curve long")).withColumn(
        "nth", F.monotonically_increasing_id())
    ordered, parts = _summed(placed, ["curve", "text_crc32", "id", "nth"], ["nth", "id"], scratch)
    shard = F.expr(f"{shards} * (2 * (bytes_before + upto) - size) div (2 * total)")
    cut = ordered.join(parts, "part").select(
        "row", "size", "text_crc32", "curve", F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("place")).alias("nth"))
    first = F.broadcast(cut.groupBy("shard").agg(F.min("nth").alias("first")))  # at most one row per shard
    return cut.join(first, "shard").select("row", "size", "text_crc32", "curve", "shard",
                                           (F.col("nth") - F.col("first")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Writes the rows as one folder per shard, in curve order, and returns per shard its
    rows, bytes and the range of each dimension, by which readers skip folders."""
    flat = sharded.select("row.*", "shard", "slot")
    flat.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
    ranges = [f(F.col(f"row.`{d}`")).alias(f"{d}_{n}") for d in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def op3_hilbert(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the texts themselves are not carried, what the shards are cut by is
    narrow = docs.select("doc_id", "source", "lang", text_sizes(F.col("text")).alias("n_bytes"),
                         F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))
    found = hilbert_shards(narrow, size=F.col("n_bytes"), crc=F.col("crc"))
    return found.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"), "curve")
