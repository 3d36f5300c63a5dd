"""Code lengths of texts by context-tree weighting over bytes.

A byte is eight binary decisions; each has a tree of contexts, the 0 to `depth` bytes before
it.  A node's decisions are estimated by Krichevsky-Trofimov, and a node's probability is the
mean of its own estimate and the product of its children's.  Counts of all training texts
give the weight of every node, top down a probability for every byte after every context.

The model is a set of tables, built by grouping and joining.  Scoring looks up the n-grams
(context and byte) of each text: the most frequent ones, up to a fixed number, in memory,
all others by a join, so that the model may grow with the corpus.  Token counts of the
unigram base are looked up the same way.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from packmill.llm.common import Scratch, bundled, extended, held_out, map_batches, tokens_of, utf8

DEPTH = 3
# What is looked up in memory, and so the bounds of what is broadcast.
FREQUENT_GRAMS = 1 << 19
FREQUENT_WORDS = 150_000
LONGEST_FREQUENT = 64
# Stands before and after a text; UTF-8 has no such byte.
EDGE = 0xFF
BATCH_BYTES = 1 << 20
HELD_COUNTS = 100_000


def text_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (the context's bytes and the byte, oldest first) of all texts in turn, and how
    many each has: one per byte of the text, A-Z lower-cased, and one for its end."""
    edge = bytes([EDGE])
    flat = np.frombuffer(b"".join(edge * depth + t.lower() + edge for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    target = np.ones(len(flat), bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    for k in range(depth):
        target[starts + k] = False
    kind = np.uint32 if depth <= 3 else np.uint64
    grams = np.zeros(len(flat), kind)
    for k in range(depth, -1, -1):
        grams[k:] |= flat[:len(flat) - k].astype(kind) << kind(8 * k)
    return grams[target], sizes


def _slices(texts: list[bytes]):
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_BYTES or k == len(texts) - 1:
            yield begin, k + 1
            begin, size = k + 1, 0


_COUNTS = "word binary, gram long, n long, n_train long"


def _counted(depth: int):
    """Partial counts of a task: words of training texts, n-grams of all texts."""
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("n_train", pa.int64())])

    def words_out(words):
        n = pa.array(words.values(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), n, n], schema=schema)

    def merged(parts):
        if len(parts) == 1:
            return parts[0]
        grams = np.concatenate([p[0] for p in parts])
        found, back = np.unique(grams, return_inverse=True)
        return found, *(np.bincount(back, np.concatenate([p[k] for p in parts]).astype(np.float64), len(found)).astype(np.int64)
                        for k in (1, 2))

    def grams_out(found, n, n_train):
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(found), pa.binary()), pa.array(found.astype(np.int64)), pa.array(n), pa.array(n_train)], schema=schema)

    def counted(batches):
        words, parts, held = Counter(), [], 0
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            train = np.asarray(batch.column("train").to_pylist(), bool)
            for text, own in zip(texts, train.tolist(), strict=True):
                if own:
                    words.update(tokens_of(text))
                    if len(words) > HELD_COUNTS:
                        yield words_out(words)
                        words = Counter()
            for begin, end in _slices(texts):
                for own in (True, False):
                    some = [t for t, x in zip(texts[begin:end], train[begin:end].tolist(), strict=True) if x == own]
                    if some:
                        found, n = np.unique(text_grams(some, depth)[0], return_counts=True)
                        parts.append((found, n, n if own else np.zeros_like(n)))
                        held += len(found)
                if held > HELD_COUNTS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > HELD_COUNTS // 2:
                        yield grams_out(*parts[0])
                        parts, held = [], 0
        if words:
            yield words_out(words)
        if parts:
            yield grams_out(*merged(parts))
    return counted


def _lgamma(x: Column) -> Column:
    """log Gamma by Stirling's series at x + 8."""
    z = x + 8.0
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (
        1260 * z * z * z * z * z)
    return series - F.log(product)


def _estimated(nodes: DataFrame, kids: str | None) -> DataFrame:
    """Adds log_w, the node's share w of its own estimate in the mean, and the estimate p of a one."""
    zeros, ones = F.col("n0").cast("double"), F.col("n1").cast("double")
    own = _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1.0)
    nodes = nodes.withColumn("own", own).withColumn("p", (ones + 0.5) / (zeros + ones + 1.0))
    if kids is None:
        return nodes.withColumn("log_w", F.col("own")).withColumn("w", F.lit(1.0)).drop("own")
    top = F.greatest("own", kids)
    both = math.log(0.5) + top + F.log1p(F.exp(-F.abs(F.col("own") - F.col(kids))))
    return nodes.withColumn("log_w", both).withColumn("w", F.exp(math.log(0.5) + F.col("own") - F.col("log_w"))).drop("own", kids)


def gram_scores(grams: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """grams(gram, n, n_train) with `lp`, log10 of the probability of its last byte after its context."""
    step = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    byte = F.col("gram").bitwiseAND(F.lit(255))
    # a decision's node: the bits of the byte so far behind a leading one
    node = F.expr("shiftleft(1, k) | cast(shiftright(byte, 8 - k) as int)")
    bits = (grams.select("gram", F.shiftright("gram", 8).alias("ctx"), byte.alias("byte"), "n_train", step)
            .select("gram", "ctx", node.alias("node"), F.expr("shiftright(byte, 7 - k) & 1").alias("bit"), "n_train"))
    counted = bits.groupBy("ctx", "node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n_train")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("n_train")).otherwise(0)).alias("n1"))
    levels = [scratch.table(_estimated(counted, None))]
    for d in range(depth - 1, -1, -1):
        shorter = F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx")
        up = levels[0].select(shorter, "node", "n0", "n1", "log_w").groupBy("ctx", "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("kids"))
        levels.insert(0, scratch.table(_estimated(up, "kids")))
    # going down, the probability is a + b * (what the node below says)
    mixed = levels[0].select("ctx", "node", (F.col("w") * F.col("p")).alias("a"), (1 - F.col("w")).alias("b"))
    for d in range(1, depth + 1):
        above = mixed.select(F.col("ctx").alias("up"), "node", F.col("a").alias("ua"), F.col("b").alias("ub"))
        here = levels[d].withColumn("up", F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)))
        mixed = here.join(above, ["up", "node"]).select(
            "ctx", "node", (F.col("ua") + F.col("ub") * F.col("w") * F.col("p")).alias("a"),
            (F.col("ub") * (1 - F.col("w"))).alias("b"))
    one = mixed.select("ctx", "node", F.col("a").alias("one"))  # at full depth w is 1, so b is 0
    lp = F.log10(F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one")))
    scored = scratch.table(bits.join(one, ["ctx", "node"]).groupBy("gram").agg(F.sum(lp).alias("lp")).join(
        grams.select("gram", "n"), "gram"))
    scratch.drop(*levels)
    return scored


class _GramTable:
    """Hash table of n-grams in numpy: two arrays, probed for many n-grams at once."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(grams), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.scores = np.zeros(1 << bits)
        left, place = np.arange(len(grams)), self._slot(grams)
        while left.size:  # of those that meet in a free slot one stays, the others move on
            free = self.keys[place] == np.iinfo(np.uint64).max
            self.keys[place[free]] = grams[left[free]]
            stays = self.keys[place] == grams[left]
            self.scores[place[stays]] = scores[left[stays]]
            left, place = left[~stays], (place[~stays] + 1) & self.mask

    def _slot(self, grams):
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (0 where unknown) and places of the unknown."""
        grams = grams.astype(np.uint64)
        place = self._slot(grams)
        found = self.keys[place]
        out = np.where(found == grams, self.scores[place], 0.0)
        left = np.flatnonzero(found != grams)
        missing = []
        place = place[left]
        while left.size:
            gone = self.keys[place] == np.iinfo(np.uint64).max
            missing.append(left[gone])
            left, place = left[~gone], (place[~gone] + 1) & self.mask
            hit = self.keys[place] == grams[left]
            out[left[hit]] = self.scores[place[hit]]
            left, place = left[~hit], place[~hit]
        return out, np.sort(np.concatenate(missing)) if missing else np.empty(0, np.int64)


_REST_WORD = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
_REST_GRAM = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))


def _scored(shared, depth: int, end: float, end_known: bool):
    def scored(batches):
        words, grams, values = shared.value
        table = _GramTable(grams, values)
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column("text"))]
            for begin, stop in _slices(texts):
                n_tokens, n_known, base, score, rest_words, rest_grams = [], [], [], [], [], []
                found, sizes = text_grams(texts[begin:stop], depth)
                logs, missing = table.look_up(found)
                starts = np.cumsum(sizes) - sizes
                score += np.add.reduceat(logs, starts).tolist()
                owners = np.searchsorted(starts, missing, "right") - 1
                unknown: list = [[] for _ in sizes]
                for k in np.unique(owners).tolist():
                    values_, counts = np.unique(found[missing[owners == k]], return_counts=True)
                    unknown[k] = [{"gram": g, "n": n} for g, n in zip(values_.astype(np.int64).tolist(), counts.tolist(), strict=True)]
                rest_grams += unknown
                for text in texts[begin:stop]:
                    tokens = tokens_of(text)
                    get = words.get
                    logs = np.fromiter((get(t, 1.0) for t in tokens), np.float64, len(tokens))
                    known = logs < 0.5  # logarithms of probabilities; 1 stands for a word not held here
                    others = Counter(tokens[k] for k in np.flatnonzero(~known))
                    n_tokens.append(len(tokens) + 1)
                    n_known.append(int(known.sum()) + end_known)
                    base.append(float(logs[known].sum()) + end)
                    rest_words.append([{"word": w, "n": n} for w, n in others.items()])
                part = batch.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("bytes_scored"), pa.array(n_tokens, pa.int64()),
                     pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                     pa.array(rest_words, _REST_WORD), pa.array(rest_grams, _REST_GRAM)],
                    ["row", "bytes_scored", "n_tokens", "n_known", "base_score", "score", "rest_words", "rest_grams"])
    return scored


def _frequent(counts: DataFrame, most: int) -> Column:
    """Condition on n that at most `most` rows of counts meet, the largest."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    total, least = 0, 1 << 60
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # levels: a few hundred
        total += r["count"]
        if total > most:
            break
        least = r.level
    return level >= least


def score_texts(docs: DataFrame, train: Column | None = None, text: str = "text", depth: int = DEPTH,
                frequent_grams: int = FREQUENT_GRAMS, frequent_words: int = FREQUENT_WORDS,
                carry: tuple[str, ...] | None = None) -> DataFrame:
    """Documents (struct `row`, of the columns `carry` if given) with n_tokens, n_known, train_tokens, base_score, score, bytes_scored, bits_per_byte.

    Learns from the rows where `train` holds (all, if not given), a null condition meaning no.
    A null text counts as empty; an empty text still has its end, one token and one byte.
    base_score is the add-one-half unigram log10 probability of the tokens and the end, over
    the counts of the training tokens.  score is the context-tree-weighted log10 probability
    of the text's bytes, A-Z lower-cased, and its end; bits_per_byte is its code length per
    byte.  Without training rows every decision has probability one half.  Repeated rows
    count as often as they stand, and get the same scores.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    train = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), train.alias("train"))
    counts = scratch.table(map_batches(source, _counted(depth), StructType.fromDDL(_COUNTS)))
    words = scratch.table(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    grams = scratch.table(counts.where("gram is not null").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("n_train").alias("n_train")))
    scratch.drop(counts)
    texts = source.where("train").count()
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_train, v = sums.n + texts, sums.v + (texts > 0)
    share = math.log10(n_train + 0.5 * (v + 1))
    log_share = F.log10(F.col("n") + 0.5) - F.lit(share)

    scores = gram_scores(grams, depth, scratch)
    short = words.where(F.octet_length("word") <= LONGEST_FREQUENT)
    often = short.where(_frequent(short, frequent_words)).select("word", log_share.alias("lp"))
    held_words = {bytes(r.word): r.lp for r in often.collect()}
    held = scores.where(_frequent(scores, frequent_grams)).select("gram", "lp").toPandas()
    shared = spark.sparkContext.broadcast((held_words, held["gram"].to_numpy(np.int64).astype(np.uint64),
                                           held["lp"].to_numpy(np.float64)))
    rows = bundled(docs, carry, text=F.col(text), bytes_scored=F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1)
    end = math.log10(texts + 0.5) - share
    rows = map_batches(rows, _scored(shared, depth, end, texts > 0), extended(
        rows, ["text"], "n_tokens long, n_known long, base_score double, score double, "
                        "rest_words array<struct<word:binary,n:bigint>>, rest_grams array<struct<gram:bigint,n:bigint>>"))
    rows = scratch.table(rows.withColumn("rid", F.monotonically_increasing_id()))

    rest = rows.select("rid", F.inline("rest_words")).withColumnRenamed("n", "tf").join(
        words.select("word", F.col("n").alias("c")), "word", "left")
    chance = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - F.lit(share)
    rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
                                   F.sum(F.col("tf") * chance).alias("more_base"))
    deep = rows.select("rid", F.inline("rest_grams")).join(scores.select("gram", "lp"), "gram").groupBy("rid").agg(
        F.sum(F.col("n") * F.col("lp")).alias("more_score"))
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return rows.drop("rest_words", "rest_grams").join(rest, "rid", "left").join(deep, "rid", "left").select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
        F.col("bytes_scored").cast("long").alias("bytes_scored"),
        (-score * math.log2(10) / F.col("bytes_scored")).alias("bits_per_byte"))


def op6_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 1)
    found = score_texts(docs, train=~out, carry=("doc_id",))
    return found.select("row.doc_id", held_out(F.col("row.doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score", "bits_per_byte")
