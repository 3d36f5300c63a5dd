"""Near copies of vectors by an inverted multi-index.

Vectors of length 1 are cut into halves, and each half has a codebook of its own; a vector's cell is the pair of
its halves' nearest codewords, so k codewords a half make a grid of k * k cells.  A vector is kept in its
own cell and visits others, nearest first, by the sum over the halves of the squared distance to the plane between its
own codeword and the other.  Two vectors meet if one of them visits the other's cell.  The way from one to the other crosses
these planes, so vectors no further apart than d always meet if both visit all cells within d / sqrt(2); far fewer suffice
in practice, so the radius is the one at which a target share of simulated pairs, just at the threshold, meet.
What meets is compared by its cosine in double precision.

Equal vectors are one class and only one of them takes part.  Full cells are cut into chunks, and
a task compares one chunk with what visits it, a batch at a time: it gives back numbers of links, and as many links as
join what is linked, never all pairs.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from packmill.llm.common import Scratch, bundled, map_batches
from packmill.llm.components import components
from packmill.llm.vectors import binaries, finite, from_binaries, matrix, usual_length

COSINE = 0.98
RECALL = 0.999
# the codebooks and the radius are fitted on about this many vectors
SAMPLE = 20_000
ROUNDS = 8
# codewords of a half, and vectors a cell should hold
MOST_CODEWORDS, CELL = 256, 64
# the radius is so many times the one that the target share of simulated pairs needs
MARGIN = 1.25
CHUNK = 1024
# so many of the fullest cells are cut into chunks; any other holds less than that part of all vectors
CUT_CELLS = 50_000


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means from k distinct points (or as many as there are)."""
    rng = np.random.default_rng(seed)
    points_ = np.unique(points, axis=0)
    words = points_[np.sort(rng.permutation(len(points_))[:k])].copy()
    for _ in range(ROUNDS):
        nearest = (2 * points @ words.T - (words * words).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, points)
        sizes = np.bincount(nearest, minlength=len(words))
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return np.unique(words, axis=0)


def plane_distances(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each point, and the distances from the planes between it and the others."""
    apart = ((points * points).sum(axis=1)[:, None] - 2 * points @ words.T + (words * words).sum(axis=1))
    own = apart.argmin(axis=1)
    between = np.sqrt(np.maximum((words * words).sum(axis=1)[:, None] - 2 * words @ words.T + (words * words).sum(axis=1), 0))
    gap = apart - apart[np.arange(len(points)), own][:, None]
    found = np.maximum(gap, 0) / (2 * np.maximum(between[own], 1e-300))
    found[np.arange(len(points)), own] = 0
    return own, found


@dataclass(frozen=True)
class Index:
    """Codebooks of the halves, and how far away the cells are that a vector visits."""

    first: np.ndarray
    second: np.ndarray
    radius: float

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each row; and (row number, cell) of all its visits, the own cell first, nearest first."""
        half = rows.shape[1] // 2
        i, one = plane_distances(rows[:, :half], self.first)
        j, two = plane_distances(rows[:, half:], self.second)
        width = len(self.second)
        r1, c1 = np.nonzero(one <= self.radius)
        r2, c2 = np.nonzero(two <= self.radius)
        n2 = np.bincount(r2, minlength=len(rows))
        starts = np.concatenate([[0], np.cumsum(n2)])[:-1]
        # every near codeword of the first half with every near one of the second
        times = n2[r1]
        row, a = np.repeat(r1, times), np.repeat(c1, times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        b = c2[starts[row] + nth]
        cost = one[row, a] ** 2 + two[row, b] ** 2
        near = cost <= self.radius ** 2
        order = np.lexsort((a[near] * width + b[near], cost[near], row[near]))
        return i * width + j, row[near][order], (a[near] * width + b[near])[order]


def needed_radius(index: Index, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least radius at which the rows of `one` and `two` meet, pair by pair."""
    half, every = one.shape[1] // 2, np.arange(len(one))
    total = [0.0, 0.0]
    for part, words in ((slice(None, half), index.first), (slice(half, None), index.second)):
        (a, from_a), (b, from_b) = (plane_distances(x[:, part], words) for x in (one, two))
        total = [total[0] + from_a[every, b] ** 2, total[1] + from_b[every, a] ** 2]
    return np.sqrt(np.minimum(*total))


def fit_index(sample: np.ndarray, codewords: int, cosine: float = COSINE, recall: float = RECALL) -> Index:
    """Codebooks from unit vectors, and the radius for the target recall: that of which a pair is certain to meet at 1."""
    half = sample.shape[1] // 2
    certain = math.sqrt(2 - 2 * cosine) / math.sqrt(2)
    index = Index(codebook(sample[:, :half], codewords, 1), codebook(sample[:, half:], codewords, 2), certain)
    if recall >= 1:
        return index
    aside = np.random.default_rng(3).normal(size=sample.shape)
    aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
    needed = needed_radius(index, sample, unit(cosine * sample + math.sqrt(1 - cosine ** 2) * aside))
    return Index(index.first, index.second, min(certain, MARGIN * float(np.quantile(needed, recall))))


# records of the shuffle: where they go (label, cell, chunk, visits), what they are
_FIELDS = "label long, cell int, chunk int, visits boolean, cid long, n long, own long, near array<int>, v binary"


def _place(shared, length: int):
    """One record per class at its own cell, with the cells it visits, and one for each visit to a chunk."""
    def chunk_of(cid, many):
        return ((cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many

    def place(batches):
        index, cut = shared.value
        for batch in batches:
            label, cid, n = (np.asarray(batch.column(c)) for c in ("label", "cid", "n"))
            rows = unit(from_binaries(batch.column("v"), "f8", length))
            own, row, cell = index.cells(rows)
            many = np.array([cut.get((a, b), 1) for a, b in zip(label.tolist(), own.tolist(), strict=True)], np.int64)
            mine = chunk_of(cid, many)
            place = (own.astype(np.int64) << 24) + mine
            visited = np.array([cut.get((a, b), 1) for a, b in zip(label[row].tolist(), cell.tolist(), strict=True)], np.int64)
            at = np.repeat(np.arange(len(row)), visited)
            chunk = np.arange(len(at)) - np.repeat(np.cumsum(visited) - visited, visited)
            # of its own cell a vector visits the later chunks only
            go = (cell[at] != own[row[at]]) | (chunk > mine[row[at]])
            at, chunk = at[go], chunk[go]
            guest = row[at]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))
            none = pa.nulls(len(guest), pa.list_(pa.int32()))
            columns = [np.concatenate(x) for x in (
                (label, label[guest]), (own.astype(np.int32), cell[at].astype(np.int32)),
                (mine.astype(np.int32), chunk.astype(np.int32)), (np.zeros(len(rows), bool), np.ones(len(guest), bool)),
                (cid, cid[guest]), (n, n[guest]), (place, place[guest]))]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.concat_arrays([near, none]), binaries(np.concatenate([rows, rows[guest]]))],
                ["label", "cell", "chunk", "visits", "cid", "n", "own", "near", "v"])
    return place


class _Chunk:
    """One chunk of a cell: its vectors, and what of them is joined so far."""

    def __init__(self, cosine: float):
        self.cosine, self.parts, self.ready = cosine, [], False

    def joined(self, linked: np.ndarray, guest: int | None) -> list[tuple[int, int]]:
        """Links that join the parts to which the `linked` vectors (and a guest) belong."""
        parts = np.unique(self.part[linked])
        ends = [int(self.cid[p]) for p in parts] + ([] if guest is None else [guest])
        if len(parts) > 1:
            self.part[np.isin(self.part, parts)] = parts[0]
        return [(x, ends[0]) for x in ends[1:]]

    def close(self):
        """Compares the chunk's own vectors, once all of them are there: numbers of links, and links."""
        self.ready = True
        self.cid, self.n, self.v = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        near = [x for p in self.parts for x in p[3]]
        self.cell_keys = np.concatenate([k * (1 << 32) + np.asarray(x, np.int64) for k, x in enumerate(near)])
        self.own = np.concatenate([p[4] for p in self.parts])
        self.part = np.arange(len(self.cid))
        numbers, links = np.zeros(len(self.cid), np.int64), []
        for start in range(0, len(self.cid), CHUNK):  # a cell that isn't cut may hold more than a chunk
            linked = self.v[start:start + CHUNK] @ self.v.T >= self.cosine
            linked[np.arange(len(linked)), start + np.arange(len(linked))] = False
            numbers[start:start + CHUNK] = linked @ self.n
            for k in np.flatnonzero(linked.any(axis=1)).tolist():
                links += self.joined(np.append(np.flatnonzero(linked[k]), start + k), None)
        return self.cid, numbers, links

    def met(self, cid, n, own, v):
        """Compares the chunk with visitors: numbers of links of both sides, and links."""
        mine, theirs, links = np.zeros(len(self.cid), np.int64), np.zeros(len(cid), np.int64), []
        linked = self.v @ v.T >= self.cosine
        for k in np.flatnonzero(linked.any(axis=0)).tolist():
            links += self.joined(np.flatnonzero(linked[:, k]), int(cid[k]))
        # a pair that also meets in the visitor's cell counts in the later of the two places
        a, b = np.nonzero(linked & (self.own[:, None] < own))
        again = np.isin(a * (1 << 32) + (own[b] >> 24), self.cell_keys)
        linked[a[again], b[again]] = False
        return linked @ n, linked.T @ self.n, links


def _compare(cosine: float, length: int):
    """Rows (a, null, number of links) and links (a, b, 0)."""
    def rows(cid, numbers, links):
        some = numbers > 0
        a = np.concatenate([cid[some], np.array([x for x, _ in links], np.int64)])
        b = pa.array([None] * int(some.sum()) + [y for _, y in links], pa.int64())
        n = np.concatenate([numbers[some], np.zeros(len(links), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])

    def compare(batches):
        key, chunk = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("label", "cell", "chunk", "visits")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if tuple(keys[start][:3]) != key:
                    if chunk is not None and chunk.parts and not chunk.ready:
                        yield rows(*chunk.close())
                    key, chunk = tuple(keys[start][:3]), _Chunk(cosine)
                cid, n, own = (np.asarray(part.column(c)) for c in ("cid", "n", "own"))
                v = from_binaries(part.column("v"), "f8", length)
                if not keys[start][3]:
                    chunk.parts.append((cid, n, v, part.column("near").to_pylist(), own))
                elif chunk.parts:  # else nobody lives here
                    if not chunk.ready:
                        yield rows(*chunk.close())
                    mine, theirs, links = chunk.met(cid, n, own, v)
                    yield rows(chunk.cid, mine, links)
                    yield rows(cid, theirs, [])
        if chunk is not None and chunk.parts and not chunk.ready:
            yield rows(*chunk.close())
    return compare


def _own_cells(shared, length: int):
    def own_cells(batches):
        index, _ = shared.value
        for batch in batches:
            own, _, _ = index.cells(unit(from_binaries(batch.column("v"), "f8", length)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(own.astype(np.int32))], ["label", "cell"])
    return own_cells


def _doubles(length: int):
    def doubles(batches):
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "v"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], binaries(matrix(batch.column("v"), length).astype(np.float64))],
                                             [*kept, "v"])
    return doubles


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, recall: float = RECALL, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (struct `row`, of the columns `carry` if given) with n_links, component_id and kept.

    Rows link if their labels are equal and not null and the cosine of their vectors is at least `cosine`; of these links
    about `recall` or more are found (all of them at 1), and no others.  n_links counts the other rows linked to directly,
    rows of equal vectors included; component_id is the smallest non-null key reachable by links, itself included; kept
    says whether that is the row's own.  Vectors that are null, zero, hold a null or non-finite component or have another
    length than most link with nothing.  Repeated rows are rows of their own that link with each other.
    A row without key takes part; its component_id is null if no key is reachable, and it isn't kept.
    An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.col(f"`{vector}`")
    length = usual_length(vectors, v)
    good = finite(v) & (F.size(v) == length) & F.exists(v, lambda x: x != 0) & F.col(f"`{label}`").isNotNull()
    # a vector's 128 bits stand for it where rows only have to find their class again
    names = ["h1", "h2"]
    hashes = {"h1": F.xxhash64(F.lit(1), F.col(f"`{label}`"), v), "h2": F.xxhash64(F.lit(2), v, F.col(f"`{label}`"))}
    rows = bundled(vectors, carry, id=F.col(f"`{key}`"), **{n: F.when(good, h) for n, h in hashes.items()})
    source = vectors.where(good).select(F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{key}`").alias("id"), v.alias("v"),
                                        *[h.alias(n) for n, h in hashes.items()])
    classes = source.groupBy("label", *names).agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    classes = classes.withColumn("cid", F.monotonically_increasing_id())
    classes = scratch.table(map_batches(classes, _doubles(length), f"label long, h1 long, h2 long, n long, least {dict(source.dtypes)['id']}, cid long, v binary"))
    many = classes.count()
    if not many:
        return rows.select("row", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    labels = classes.agg(F.approx_count_distinct("label")).first()[0]
    share = min(1.0, SAMPLE / many)
    sample = classes.where(F.pmod("h1", F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toArrow()
    sample = unit(from_binaries(sample.column("v").combine_chunks(), "f8", length)) if sample.num_rows else np.eye(1, length)
    codewords = int(min(MOST_CODEWORDS, max(2, round(math.sqrt(many / labels / CELL)))))
    index = fit_index(sample, codewords, cosine, recall)
    shared = spark.sparkContext.broadcast((index, {}))
    narrow = classes.select("label", "v")
    full = map_batches(narrow, _own_cells(shared, length), "label long, cell int").groupBy("label", "cell").agg(
        F.count("*").alias("n")).where(F.col("n") > CHUNK).orderBy(F.desc("n")).limit(CUT_CELLS).collect()
    shared.unpersist()
    shared = spark.sparkContext.broadcast((index, {(r.label, r.cell): -(-r.n // CHUNK) for r in full}))
    records = map_batches(classes.select("label", "cid", "n", "v"), _place(shared, length), _FIELDS)
    place = ["label", "cell", "chunk"]
    records = records.repartition(*place).sortWithinPartitions(*place, "visits")
    met = scratch.table(map_batches(records, _compare(cosine, length), "a long, b long, n long"))
    found = met.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    roots = components(met.where("b is not null").select("a", "b"), scratch).toDF("cid", "root")
    placed = scratch.table(classes.drop("v").join(found, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = scratch.table(placed.join(least, "root").select(
        *names, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"))
    scratch.drop(classes, met)
    result = rows.join(placed, names, "left").select(
        "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("id"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return result.select("row", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))


def op12_multi_index(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(vectors, carry=("vec_id",)).select("row.vec_id", "n_links", "component_id", "kept")


OP12_SQL = """
WITH RECURSIVE r AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v, label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x : x <> 0)) > 0 AS good
  FROM embeddings),
e AS (SELECT a.r AS a, b.r AS b FROM r a JOIN r b ON a.label = b.label AND a.r <> b.r AND a.good AND b.good AND list_cosine_similarity(a.v, b.v) >= 0.98),
c(r, q) AS (SELECT r, r FROM r UNION SELECT c.r, e.b FROM c JOIN e ON c.q = e.a),
m AS (SELECT c.r, min(t.vec_id) AS component_id FROM c JOIN r t ON c.q = t.r GROUP BY c.r)
SELECT r.vec_id, (SELECT count(*) FROM e WHERE e.a = r.r) AS n_links, m.component_id, coalesce(r.vec_id = m.component_id, false) AS kept
FROM r JOIN m ON r.r = m.r"""
