"""Hard negatives of anchors, by slot-decomposed selection.

Every positive of an anchor opens a window of scores: negatives up to a share of the positive's
score, and not below a smaller share of it.  The windows of one anchor overlap.  Their upper limits, in
falling order, cut the scores into disjoint slots, and each slot needs its k best rows only: what a window
returns are the k best of its own slot and those below it, less what lies under its lower limit.  So one pass
with a combiner per anchor and slot answers all windows, however much they overlap.

Anchors are taken in blocks of bounded size; each block is one pass over all rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.llm.common import Scratch, map_batches
from packmill.llm.vectors import finite, matrix, usual_length

GRID = 256
POSITIVES, NEGATIVES = 5, 10
# a negative has between these percentages of the positive's score
LOW, HIGH = 30, 90
# anchors of one pass: what the driver and each task hold of them is bounded
BLOCK = 4096
# scores that a task has at a time
SCORES = 4_000_000
# integers are held within this, so that scores fit longs
LARGEST = 1 << 26
_NONE = np.iinfo(np.int64).min


class _Best:
    """The k best of each key by falling score, then id."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, _NONE)
        self.held = [np.empty(0, np.int64) for _ in range(3)]

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        good = score >= self.least[key]
        new = [np.concatenate([a, b[good]]) for a, b in zip(self.held, (key, score, ident), strict=True)]
        order = np.lexsort((new[2], -new[1], new[0]))
        key = new[0][order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
        self.held = [x[order][place < self.k] for x in new]
        full = place == self.k - 1
        self.least[key[full]] = new[1][order][full]


def _scored(batches, block, length: int):
    """(labels, ids, row numbers, scores by anchor and row) of a few rows at a time."""
    anchors = block["q"]
    most = int(np.abs(anchors).max(initial=0))
    step = max(64, SCORES // max(1, len(anchors)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            q = matrix(part.column("q"), length).astype(np.int64)
            # sums of this size are exact in doubles, which multiply faster
            exact = length * most * int(np.abs(q).max(initial=0)) < 1 << 53
            scores = (anchors.astype(float) @ q.T.astype(float)).astype(np.int64) if exact else anchors @ q.T
            yield *(np.asarray(part.column(c)) for c in ("label", "id", "rid")), scores


def _best_positives(shared, length: int, k: int):
    def positives(batches):
        block = shared.value
        best = _Best(len(block["rid"]), k)
        for label, ident, rid, scores in _scored(batches, block, length):
            a, r = np.nonzero((block["label"][:, None] == label) & (block["rid"][:, None] != rid) & (scores >= best.least[:, None]))
            best.add(a, scores[a, r], ident[r])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.held], ["anchor", "score", "id"])
    return positives


def _best_by_slot(shared, length: int, k: int):
    def slots(batches):
        block = shared.value
        upper, lowest = block["upper"], block["lowest"]  # upper: falling along each anchor's row
        most = upper.shape[1]
        best = _Best(len(upper) * most, k)
        for label, ident, _, scores in _scored(batches, block, length):
            a, r = np.nonzero((scores <= upper[:, :1]) & (scores >= lowest[:, None]) & (block["label"][:, None] != label))
            score = scores[a, r]
            slot = sum((upper[a, j] >= score).astype(np.int64) for j in range(most)) - 1
            best.add(a * most + slot, score, ident[r])
        key, score, ident = best.held
        yield pa.RecordBatch.from_arrays([pa.array(key // most), pa.array((key % most).astype(np.int32)), pa.array(score), pa.array(ident)],
                                         ["anchor", "slot", "score", "id"])
    return slots


def _least(df: DataFrame, group: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "id"))
    return df.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding",
                   label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x), beyond 2^26 that number; a score is the inner product with the anchor, and
    higher ones come first, ties by the smaller key.  An anchor (`is_anchor` of the input's columns) has
    as positives its first `positives` other rows of its label, and for each of these as negatives the first `negatives`
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    Rows without key, label or vector, with a null or non-finite component, or with another number of components than most
    rows have take no part.  Rows that repeat are rows of their own: a copy of an anchor is an anchor too, and may be its
    positive.  Windows without negatives, and empty tables, give no rows.  Other columns don't matter.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v, name = F.col(f"`{vector}`"), F.col(f"`{key}`")
    group = F.col(f"`{label}`") if isinstance(label, str) else label
    given = vectors.where(name.isNotNull() & group.isNotNull())
    length = usual_length(given, v)
    near = lambda x: F.greatest(F.least(F.floor(GRID * x.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = given.where(finite(v) & (F.size(v) == length)).select(
        name.cast("long").alias("id"), group.cast("long").alias("label"), F.transform(v, near).cast("array<int>").alias("q"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    whole = scratch.table(rows.withColumn("rid", F.monotonically_increasing_id()))
    anchors = whole.where("is_anchor").drop("is_anchor")
    blocks = -(-anchors.count() // block)
    out = f"{scratch.root}/found"
    fields = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # a task's combiners cover as many rows as it can get, so that fewer candidates are shuffled
    rows = whole.drop("is_anchor").coalesce(4 * spark.sparkContext.defaultParallelism)
    for number in range(blocks):
        taken = anchors.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == number).orderBy("rid").toArrow()
        if not taken.num_rows:
            continue
        held = {c: np.asarray(taken.column(c).combine_chunks()) for c in ("id", "label", "rid")}
        held["q"] = matrix(taken.column("q").combine_chunks(), length).astype(np.int64)
        shared = spark.sparkContext.broadcast(held)
        found = map_batches(rows.select("id", "label", "q", "rid"), _best_positives(shared, length, positives), "anchor long, score long, id long")
        first = _least(found, ["anchor"], positives).collect()  # at most `positives` rows for each anchor of the block
        shared.unpersist()
        if not first:
            continue
        upper, lowest = np.full((len(held["id"]), positives), _NONE), np.full(len(held["id"]), np.iinfo(np.int64).max)
        for r in first:
            upper[r.anchor, r.place - 1] = high * r.score // 100
            lowest[r.anchor] = min(lowest[r.anchor], -(-low * r.score // 100))
        shared = spark.sparkContext.broadcast({**held, "upper": upper, "lowest": lowest})
        found = map_batches(rows.select("id", "label", "q", "rid"), _best_by_slot(shared, length, negatives), "anchor long, slot int, score long, id long")
        # per anchor at most `positives` * `negatives` entries, the best slot first
        best = _least(found, ["anchor", "slot"], negatives).groupBy("anchor").agg(F.sort_array(F.collect_list(
            F.struct(F.col("slot").alias("part"), "place", "score", "id"))).alias("best"))
        asked = spark.createDataFrame(
            [(r.anchor, int(held["id"][r.anchor]), r.id, r.place - 1, r.score, -(-low * r.score // 100)) for r in first],
            "anchor long, anchor_id long, positive_id long, slot int, positive_score long, lowest long")
        within = F.expr(f"filter(slice(filter(best, x -> x.part >= slot), 1, {negatives}), x -> x.score >= lowest)")
        answers = best.join(F.broadcast(asked), "anchor").select(
            "anchor_id", "positive_id", "positive_score", F.posexplode(within).alias("at", "n"))
        answers.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
                       "positive_score", F.col("n.score").alias("negative_score")).write.mode("append").parquet(out)
        shared.unpersist()
    spark.createDataFrame([], fields).write.mode("append").parquet(out)  # there may be no other
    scratch.drop(whole)
    return spark.read.schema(fields).parquet(out)


def op11_slots(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
      FROM r a JOIN r b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
      WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
