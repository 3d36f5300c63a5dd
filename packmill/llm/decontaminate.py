"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

Patterns are the windows of `width` consecutive words of each benchmark item.  A block is
the last two words of a position; a shift table says how far the search may jump, buckets
by the hash of a pattern's last block say which patterns to test where the jump is zero,
and word-by-word comparison confirms them.  The search runs over many lanes at once: long
texts are cut into lanes that overlap by a window, so that numpy advances them together.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packmill.llm.common import Scratch, bundled, extended, map_batches, utf8, words_of

WIDTH = 10
# Words of benchmark text in one matcher, and so the bound of what is broadcast at once.
# A larger benchmark is searched in several passes.
MATCHER_WORDS = 1_000_000
LANE = 1024
TABLE_BITS = 20
BATCH_BYTES = 8 << 20
_MIX = np.int64(0x9E3779B1)


class _Windows:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, patterns: np.ndarray, width: int):
        self.width, self.block = width, min(2, width)
        self.default = width - self.block + 1
        shift = np.full(1 << TABLE_BITS, self.default, np.int16)
        for end in range(self.block - 1, width):
            np.minimum.at(shift, self.hashes(patterns[:, end - self.block + 1], patterns[:, end]), width - 1 - end)
        self.shift = shift
        suffix = self.hashes(patterns[:, width - self.block], patterns[:, width - 1])
        order = np.argsort(suffix, kind="stable")
        self.order, self.patterns = order, patterns[order]
        self.starts = np.searchsorted(suffix[order], np.arange((1 << TABLE_BITS) + 1))

    @staticmethod
    def hashes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = first.astype(np.int64) * _MIX + last
        return (mixed ^ (mixed >> 17)) & ((1 << TABLE_BITS) - 1)

    def ends(self, ids: np.ndarray, pos: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Positions at which the shift is zero, for lanes from `pos` up to `limit`."""
        found = []
        while pos.size:
            last = ids[pos]
            jump = self.shift[self.hashes(ids[pos - self.block + 1], last)]
            jump = np.where(last == 0, self.width, jump)  # a word of no pattern: jump past it
            found.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            live = pos < limit
            pos, limit = pos[live], limit[live]
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def confirmed(self, ids: np.ndarray, ends: np.ndarray):
        """Pairs of end position and pattern number, in blocks of bounded size."""
        suffix = self.hashes(ids[ends - self.block + 1], ids[ends])
        counts = self.starts[suffix + 1] - self.starts[suffix]
        cut = np.searchsorted(np.cumsum(counts), np.arange(1 << 18, counts.sum() + (1 << 18), 1 << 18), "right")
        begin = 0
        for end in [*cut.tolist(), len(ends)]:
            end = max(end, begin)
            n = counts[begin:end]
            if n.size == 0 or n.sum() == 0:
                begin = end
                continue
            at = np.repeat(ends[begin:end], n)
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            which = np.repeat(self.starts[suffix[begin:end]], n) + rank
            same = ids[at - self.width + 1] == self.patterns[which, 0]
            at, which = at[same], which[same]
            for k in range(1, self.width):
                same = ids[at - self.width + 1 + k] == self.patterns[which, k]
                at, which = at[same], which[same]
            yield at, self.order[which]
            begin = end


class Matcher:
    """Search for the windows of items, given as pairs of id and list of words."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple, set]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            m = min(width, len(ids))
            for k in range(len(ids) - m + 1 if m else 0):
                windows.setdefault(m, {}).setdefault(tuple(ids[k:k + m]), set()).add(item)
        self.tables = []
        for m, found in windows.items():
            patterns = np.array(list(found), np.int32).reshape(-1, m)
            self.tables.append((_Windows(patterns, m), [tuple(i for i in x if i is not None) for x in found.values()]))

    def search(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """For documents as lists of words: their lengths, a mark per word (in an
        occurrence or not) over all of them, the ids of the items found in each."""
        get = self.vocabulary.get
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter((get(w, 0) for t in texts for w in t), np.int32, int(lengths.sum()))
        stops = np.cumsum(lengths)
        starts = stops - lengths
        cover = np.zeros(len(ids) + 1, np.int32)
        items: list[set] = [set() for _ in texts]
        for table, owners in self.tables:
            m = table.width
            lanes = np.maximum(-(-(lengths - m + 1) // LANE), 0)
            doc = np.repeat(np.arange(len(texts)), lanes)
            nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
            pos = starts[doc] + m - 1 + nth * LANE
            ends = table.ends(ids, pos, np.minimum(pos + LANE, stops[doc]))
            for at, which in table.confirmed(ids, ends):
                np.add.at(cover, at - m + 1, 1)
                np.add.at(cover, at + 1, -1)
                pairs = np.unique(np.stack([np.searchsorted(stops, at, "right"), which]), axis=1)
                for d, p in pairs.T.tolist():
                    items[d].update(owners[p])
        return lengths, np.cumsum(cover[:-1]) > 0, items


def _slices(texts: list[bytes | None]):
    """Index ranges of texts of a bounded number of bytes together (one text at least)."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or b"") > BATCH_BYTES:
            yield begin, k
            begin, size = k, 0
        size += len(text or b"")
    yield begin, len(texts)


def _scan(shared, first: bool):
    def scan(batches):
        matcher = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = utf8(batch.column("text"))
            n_words, n_hit, marks, found = [], [], [], []
            before = None if first else (batch.column("_marks").to_pylist(), batch.column("_items").to_pylist())
            for begin, end in _slices(texts):
                lengths, hit, items = matcher.search([words_of(t) for t in texts[begin:end]])
                stop = 0
                for k, n in enumerate(lengths.tolist()):
                    own = hit[stop:stop + n]
                    stop += n
                    if before:
                        if before[0][begin + k]:
                            own = own | np.unpackbits(np.frombuffer(before[0][begin + k], np.uint8), count=n).astype(bool)
                        items[k].update(before[1][begin + k])
                    n_words.append(n)
                    n_hit.append(int(own.sum()))
                    marks.append(np.packbits(own).tobytes() if n_hit[-1] else None)
                    found.append(sorted(items[k]))
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True)
                       if name not in ("n_words", "n_hit", "_marks", "_items")]
            names = [n for n in batch.schema.names if n not in ("n_words", "n_hit", "_marks", "_items")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(marks, pa.binary()), pa.array(found, pa.list_(pa.string()))],
                [*names, "n_words", "n_hit", "_marks", "_items"])
    return scan


def _added(batches):
    """The marks of all passes over a text as one."""
    for batch in batches:
        marks = [np.bitwise_or.reduce([np.frombuffer(m, np.uint8) for m in x]).tobytes() for x in batch.column("all_marks").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("t1", "t2", "_items")), pa.array(marks, pa.binary())],
                                         ["t1", "t2", "_items", "_marks"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", width: int = WIDTH,
                       matcher_words: int = MATCHER_WORDS) -> DataFrame:
    """Documents (struct `row`) with n_words, n_hit, items (sorted ids as strings).

    Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z.  A word is hit
    if it lies in an occurrence of a window of `width` consecutive words of an item; an item
    with fewer words, but not none, is one window.  Nulls and empty texts have no words and
    so neither hit nor are hit.  Items without an id mark words but are not listed; several
    items of one id count once.  Repeated rows stay as they are.

    The benchmark is broadcast in matchers of about `matcher_words` words (or one item);
    a larger one is searched in as many passes, whose marks and items add up.  All passes but the last keep
    narrow rows of the texts that are hit: their 128 bits of hash, marks and items.  Empty tables give
    no rows, or rows without hits, and the length of a text has no limit.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total = items.agg(F.coalesce(F.sum((size + 1) / 2), F.lit(0))).first()[0]  # a word has two bytes with its space
    parts = max(1, int(total // (matcher_words / 2)) + 1) if total > matcher_words else 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    body = F.col(f"`{text}`")
    result = bundled(docs, text=body, t1=F.xxhash64(F.lit(1), body), t2=F.xxhash64(F.lit(2), body))
    own = ["n_words", "n_hit", "_marks", "_items"]
    fields = "n_words long, n_hit long, _marks binary, _items array<string>"
    passes = []
    for k in range(parts):
        here = [(i, words_of(t.encode())) for i, t in items.where(part == k).where("text is not null").distinct().collect()]
        shared = spark.sparkContext.broadcast(Matcher(here, width))
        if k < parts - 1:
            texts = result.drop("row")
            hit = map_batches(texts, _scan(shared, True), extended(texts, own, fields)).where("n_hit > 0")
            passes.append(scratch.table(hit.select("t1", "t2", "_marks", "_items").dropDuplicates(["t1", "t2"])))
    if passes:
        # at most one row per text and pass
        found = reduce(DataFrame.union, passes).groupBy("t1", "t2").agg(
            F.collect_list("_marks").alias("all_marks"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
        added = scratch.table(map_batches(found, _added, extended(found, ["all_marks"], "_marks binary")))
        scratch.drop(*passes)
        result = result.join(added, ["t1", "t2"], "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    result = result.drop("t1", "t2")
    result = map_batches(result, _scan(shared, not passes), extended(result, own, fields))
    return result.select("row", "n_words", "n_hit", F.col("_items").alias("items"))


def op9_wu_manber(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark)
      WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS win
       FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
dw AS (SELECT r, k, m, array_to_string(w[k : k + m - 1], ' ') AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k
             FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hits AS (SELECT r, k, m, item_id FROM dw JOIN iw USING (m, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit
      FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, k, m FROM hits)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""
