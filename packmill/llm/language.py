"""Language of words and documents by a linear-chain conditional random field.

The words of a text are labelled together: character n-grams, affixes and lexicon
membership score each word, learned transitions tie neighbours, and forward-backward gives
every word its distribution over languages, also where a text switches.  A document's
language is the one with most expected words.

The field is fitted piecewise, on all words of all labelled rows: word scores on the counts
of words by language, transitions on the counts of neighbours, where half of the texts count
as they are and half as segments between segments of other texts, so that switches are seen.
The tasks count, and sum the gradient if the distinct words are many.  Scoring runs in the
tasks, over whole texts: chains are cut into blocks, whose transfer matrices are multiplied
up side by side, so that long texts take as many numpy steps as short ones.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.llm.common import Scratch, bundled, extended, held_out, map_batches, utf8

MOST_LANGUAGES = 400
# A language of more words weighs as much as one of so many; each of its words counts, for less.
EVEN_WORDS = 200_000
# Words of an artificial segment, in the mean.
SEGMENT = 25
LEXICON = 400
BUCKETS = 1 << 17
WEIGHTS = 1 << 22
# Up to so many distinct words the gradient is taken on the driver, beyond it in the tasks.
DRIVER_WORDS = 100_000
# The steps take the batches of words in turn, again and again: batches of so many words at least, and so many batches at most.
BATCH_WORDS, BATCHES = 200_000, 10
# Words of a task that sums the gradient; the gradients themselves are added up in chunks of entries.
TASK_WORDS, SLOPE_CHUNK = 100_000, 1 << 14
# What a task counts before it hands on, and characters of words, times labels, handled at once.
TALLY_ENTRIES, TALLY_BYTES = 60_000, 8 << 20
SLOPE_CHARS = 1 << 18
UNDETERMINED = "und"

BLOCK = 64
BLOCK_ENTRIES = 256
SLICE_BLOCKS = 1 << 13
BATCH_BYTES = 1 << 20
CACHED_WORDS = 300_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _split(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def _ngrams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words and the index of each feature's word.

    A space stands for a word's ends: n-grams up to three characters, and those of four
    that touch an end (affixes of three).
    """
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = codes == 32
    owner = np.cumsum(edge) - 1
    hashed, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3, 4):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(n)
        if n == 1:
            good = ~edge
        elif n == 2:
            good = ~(edge[:m] & edge[1:])
        elif n == 3:
            good = ~edge[1:m + 1]
        else:
            good = (edge[:m] | edge[3:]) & ~edge[1:m + 1] & ~edge[2:m + 2]
        mixed = value[good] * np.uint64(0x9E3779B97F4A7C15)
        hashed.append((mixed >> np.uint64(40)) % np.uint64(buckets))
        owners.append(owner[:m][good])
    return np.concatenate(hashed).astype(np.int64), np.concatenate(owners)


class Field:
    """Weights of the field; `emissions` scores words, `posteriors` whole chains."""

    def __init__(self, labels: list[str], lexicon: dict[str, list[int]]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        # as many buckets as keep the weights of many labels within WEIGHTS
        self.buckets = min(BUCKETS, 1 << (WEIGHTS // max(n, 1)).bit_length() - 1)
        self.weights = np.zeros((self.buckets + n, n))  # the last n rows: listed in the lexicon of a language
        self.trans = np.eye(n) * 2.0

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        hashed, owners = _ngrams(words, self.buckets)
        extra = [(self.buckets + k, i) for i, w in enumerate(words) for k in self.lexicon.get(w, ())]
        if extra:
            more = np.array(extra, np.int64)
            hashed, owners = np.concatenate([hashed, more[:, 0]]), np.concatenate([owners, more[:, 1]])
        return hashed, owners

    def emissions(self, words: list[str]) -> np.ndarray:
        hashed, owners = self.features(words)
        return np.stack([np.bincount(owners, self.weights[hashed, k], len(words))
                         for k in range(len(self.labels))], axis=1)


def _scaled(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


class Tally:
    """Counts of the words of labelled texts; the word "" counts the texts."""

    def __init__(self):
        self.counts: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = _split(text)
        if words:
            own = self.counts.setdefault(lang, Counter())
            own.update(words)
            own[b""] += 1
            self.size += len(text)

    def full(self) -> bool:
        return self.size >= TALLY_BYTES or sum(map(len, self.counts.values())) >= TALLY_ENTRIES

    def taken(self) -> list[tuple[str, str, int]]:
        """The counts, lower-cased, of what has a letter; the tally is empty then."""
        out = []
        for lang, own in self.counts.items():
            words = Counter()
            for raw, n in own.items():
                words[raw.decode("utf-8", "ignore").lower()] += n
            out += [(lang, w, n) for w, n in words.items() if not w or any(c.isalpha() for c in w)]
        self.__init__()
        return out


def _tallied(batches):
    tally, names = Tally(), ["lang", "word", "n"]
    types = [pa.string(), pa.string(), pa.int64()]

    def handed():
        found = list(zip(*tally.taken(), strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            tally.add(lang, text)
            if tally.size >= TALLY_BYTES:
                yield handed()
        if tally.full():
            yield handed()
    yield handed()


def _blocks(field: Field, shares: np.ndarray, batches):
    """Per block of words: their features, each feature's word, and the weighted counts of the words by label."""
    n = len(field.labels)
    chars = max(1 << 12, SLOPE_CHARS // max(n, 4))
    for batch in batches:
        words = batch.column("word").to_pylist()
        ends = np.cumsum([len(w) + 1 for w in words])
        cuts = [0, *(np.flatnonzero(np.diff(ends // chars)) + 1).tolist(), len(words)] if words else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            found = batch.column("found").slice(lo, hi - lo)
            label, count = (np.asarray(c) for c in found.flatten().flatten())
            mass = np.zeros((hi - lo, n))
            mass[np.repeat(np.arange(hi - lo), np.asarray(found.value_lengths())), label] = count * shares[label]
            hashed, owners = field.features(words[lo:hi])
            yield hashed, owners, mass


def _slope(field: Field, blocks) -> np.ndarray:
    """The gradient of the words' log loss, summed over their weighted counts."""
    weights = np.ascontiguousarray(field.weights.T)
    slope = np.zeros_like(weights)
    for hashed, owners, mass in blocks:
        chance = _scaled(np.stack([np.bincount(owners, own[hashed], len(mass)) for own in weights], axis=1))
        gap = chance * (mass.sum(axis=1) / chance.sum(axis=1))[:, None] - mass
        for own, part in zip(slope, np.ascontiguousarray(gap.T), strict=True):
            own += np.bincount(hashed, part[owners], len(own))
    return slope.T


def _slope_in_tasks(words: DataFrame, field: Field, shares: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast((field, shares))

    def sloped(batches):
        field, shares = shared.value
        flat = np.ascontiguousarray(_slope(field, _blocks(field, shares, batches))).ravel()
        for at in range(0, len(flat), SLOPE_CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([flat[at:at + SLOPE_CHUNK].tobytes()])],
                                             ["chunk", "slope"])

    def summed(table):
        total = np.sum([np.frombuffer(part.as_buffer()) for part in table.column("slope")], axis=0)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "slope": pa.array([total.tobytes()])})
    schema = "chunk long, slope binary"
    parts = map_batches(words, sloped, extended(words, words.columns, schema))
    got = sorted(parts.groupBy("chunk").applyInArrow(summed, schema).collect())
    shared.destroy()
    return np.concatenate([np.frombuffer(r.slope) for r in got]).reshape(field.weights.shape)


def _transitions(texts: np.ndarray, words: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Log chances of a word's label after its neighbour's, by the expected counts of neighbours."""
    starts = texts + (words - texts) / SEGMENT / 2  # half of the words are in texts cut into segments
    share = starts * shares / (starts * shares).sum()
    pairs = np.diag((words - starts) * shares) + np.outer(starts * shares, share)
    pairs += 0.5 / len(pairs)
    return np.log(pairs / pairs.sum(axis=1, keepdims=True))


def _fitted(labels: list[str], texts: list[int], words: list[int], lexicon: dict[str, list[int]], slopes,
            iterations: int) -> Field:
    """A field by gradient steps with per-weight scaling (Adam); slopes(field, shares) gives the function
    that returns the gradient at the field of a step, from 0."""
    field, words = Field(labels, lexicon), np.array(words, float)
    shares = np.minimum(1.0, EVEN_WORDS / words)
    size, slope_of = float((words * shares).sum()), slopes(field, shares)
    m, v = np.zeros_like(field.weights), np.zeros_like(field.weights)
    for step in range(1, iterations + 1):
        slope = slope_of(field, step - 1) / size + 1e-6 * field.weights
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        field.weights -= 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    field.trans = _transitions(np.array(texts, float), words, shares)
    return field


def _slopes_here(batches):
    def slopes(field: Field, shares: np.ndarray):
        blocks = list(_blocks(field, shares, batches))
        return lambda field, step: _slope(field, blocks)
    return slopes


_FOUND = pa.list_(pa.struct([("label", pa.int32()), ("n", pa.int64())]))


def fit(rows: list[tuple[str, str]], iterations: int = 30) -> Field | None:
    """Fits a field on (text, language) rows in memory, as `learned` does on a table of few words."""
    tally = Tally()
    for text, lang in rows:
        tally.add(lang, text.encode("utf-8", "ignore"))
    counts: dict[str, Counter] = {}
    for lang, word, n in tally.taken():
        counts.setdefault(lang, Counter())[word] = n
    texts = {lang: own.pop("") for lang, own in counts.items()}
    labels = sorted(lang for lang, own in counts.items() if own)
    if not labels:
        return None
    lexicon, found = {}, {}
    for label, lang in enumerate(labels):
        own = counts[lang]
        for word in sorted((w for w, n in own.items() if n > 1), key=lambda w: (-own[w], w))[:LEXICON]:
            lexicon.setdefault(word, []).append(label)
        for word, n in own.items():
            found.setdefault(word, []).append({"label": label, "n": n})
    batch = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), _FOUND)], ["word", "found"])
    return _fitted(labels, [texts[x] for x in labels], [sum(counts[x].values()) for x in labels], lexicon,
                   _slopes_here([batch]), iterations)


class Labeller:
    """Scores texts with a field; keeps the scores of words it has met, up to a bound."""

    def __init__(self, field: Field):
        self.field = field
        self.trans = np.exp(field.trans - field.trans.max())
        self.forget()

    def forget(self):
        self.place: dict[bytes, int] = {}
        self.used = 0
        self.scores = np.empty((1 << 12, len(self.field.labels)))

    def _learn(self, new: list[bytes]) -> None:
        words = [w.decode("utf-8", "replace").lower().replace(" ", "") or "?" for w in new]
        scores = _scaled(self.field.emissions(words))
        while len(self.scores) < self.used + len(new):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        for raw, word, score in zip(new, words, scores, strict=True):
            if any(c.isalpha() for c in word):
                self.place[raw] = self.used
                self.scores[self.used] = score
                self.used += 1
            else:
                self.place[raw] = -2  # no letter in it: no word

    def chain(self, text: bytes | None) -> np.ndarray:
        """Scaled emission scores of the words of a text."""
        words = _split(text)
        if len(self.place) > CACHED_WORDS:
            self.forget()
        parts = []
        for at in range(0, len(words), 1 << 18):
            some = words[at:at + (1 << 18)]
            get = self.place.get
            ids = np.fromiter((get(w, -1) for w in some), np.int64, len(some))
            if (ids == -1).any():
                self._learn(list(dict.fromkeys(some[k] for k in np.flatnonzero(ids == -1))))
                get = self.place.get
                for k in np.flatnonzero(ids == -1):
                    ids[k] = get(some[k])
            parts.append(self.scores[ids[ids >= 0]])
        return np.concatenate(parts) if parts else np.empty((0, len(self.field.labels)))

    def posteriors(self, chains: list[np.ndarray]):
        """Yields, over all chains in turn, slices of word distributions, and where each begins."""
        n, t = len(self.field.labels), self.trans
        lengths = np.array([len(c) for c in chains], np.int64)
        e = np.concatenate(chains)
        begins = np.cumsum(lengths) - lengths
        # blocks grow with the square of many labels, so that their matrices take no more memory a word
        block = BLOCK * max(1, n * n // BLOCK_ENTRIES)
        blocks = -(-lengths // block)
        doc = np.repeat(np.arange(len(chains)), blocks)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begins[doc] + nth * block
        size = np.minimum(block, begins[doc] + lengths[doc] - start)

        transfer = np.empty((len(start), n, n))
        for lo in range(0, len(start), SLICE_BLOCKS):
            order = lo + np.argsort(-size[lo:lo + SLICE_BLOCKS], kind="stable")
            m = np.tile(np.eye(n), (len(order), 1, 1))
            for k in range(int(size[order[0]])):
                live = int(np.searchsorted(-size[order], -k, "left"))
                part = (m[:live].reshape(-1, n) @ t).reshape(-1, n, n) * e[start[order[:live]] + k][:, None, :]
                m[:live] = part / part.max(axis=(1, 2), keepdims=True)
            transfer[order] = m

        # from block to block: one step per block of the longest chain, all chains together
        into, out = np.empty((len(start), n)), np.empty((len(start), n))
        first = np.cumsum(blocks) - blocks
        by_size = np.argsort(-blocks, kind="stable")
        now = np.full((len(chains), n), 1.0 / n)
        for k in range(int(blocks.max(initial=0))):
            live = by_size[:np.searchsorted(-blocks[by_size], -k, "left")]
            at = first[live] + k
            into[at] = now[live]
            step = np.einsum("bi,bij->bj", now[live], transfer[at])
            now[live] = step / step.sum(axis=1, keepdims=True)
        now = np.ones((len(chains), n))
        for k in range(int(blocks.max(initial=0))):
            live = by_size[:np.searchsorted(-blocks[by_size], -k, "left")]
            at = first[live] + blocks[live] - 1 - k
            out[at] = now[live]
            step = np.einsum("bij,bj->bi", transfer[at], now[live])
            now[live] = step / step.sum(axis=1, keepdims=True)

        for lo in range(0, len(start), SLICE_BLOCKS):
            order = lo + np.argsort(-size[lo:lo + SLICE_BLOCKS], kind="stable")
            base = start[lo]
            words = int(start[lo:lo + SLICE_BLOCKS][-1] + size[lo:lo + SLICE_BLOCKS][-1] - base)
            alpha = np.empty((words, n))
            now, top = into[order], int(size[order[0]])
            lives = [int(np.searchsorted(-size[order], -k, "left")) for k in range(top)]
            for k, live in enumerate(lives):
                at = start[order[:live]] + k
                step = (now[:live] @ t) * e[at]
                now[:live] = step / step.sum(axis=1, keepdims=True)
                alpha[at - base] = now[:live]
            now = out[order]
            for k in range(top - 1, -1, -1):
                at = start[order[:lives[k]]] + k
                both = alpha[at - base] * now[:lives[k]]
                alpha[at - base] = both / both.sum(axis=1, keepdims=True)
                step = (e[at] * now[:lives[k]]) @ t.T
                now[:lives[k]] = step / step.sum(axis=1, keepdims=True)
            yield int(base), alpha

    def label(self, texts: list[bytes | None], runs: bool):
        """Per text: language, score, runs of words (language, first word, words) if asked for, and certainty."""
        chains = [self.chain(t) for t in texts]
        lengths = np.array([len(c) for c in chains], np.int64)
        stops = np.cumsum(lengths)
        totals = np.zeros((len(texts), len(self.field.labels)))
        best, sure = np.empty(int(lengths.sum()), np.int32), np.zeros(len(texts))
        for base, part in self.posteriors(chains) if len(best) else ():
            owner = np.searchsorted(stops, np.arange(base, base + len(part)), "right")
            for k in range(totals.shape[1]):
                totals[:, k] += np.bincount(owner, part[:, k], len(texts))
            best[base:base + len(part)] = part.argmax(axis=1)
            sure += np.bincount(owner, part.max(axis=1), len(texts))
        out = []
        for k, n in enumerate(lengths.tolist()):
            if not n:
                out.append((UNDETERMINED, 0.0, [], 0.0))
                continue
            top = int(totals[k].argmax())
            found = []
            if runs:
                own = best[stops[k] - n:stops[k]]
                cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n]
                found = [(self.field.labels[own[a]], a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
            out.append((self.field.labels[top], min(1.0, float(totals[k, top] / n)), found, min(1.0, float(sure[k] / n))))
        return out


_RUN = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])


def _predict(shared, runs: bool, text: str | None):
    """Predictions in batches of BATCH_BYTES of text, which is the field `text` of the rows or a column beside them."""
    def predict(batches):
        field = shared.value
        labeller = Labeller(field) if field else None
        for batch in batches:
            rows = batch.column("row")
            texts = batch.column("text") if text is None else rows.field(text)
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1).tolist(), len(texts)] if len(texts) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = utf8(texts.slice(lo, hi - lo))
                found = labeller.label(part, runs) if labeller else [(UNDETERMINED, 0.0, [], 0.0)] * len(part)
                langs, scores, spans, sure = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array([[dict(zip(("lang", "first", "words"), r, strict=True)) for r in x] for x in spans], pa.list_(_RUN)),
                     pa.array(sure, pa.float64())],
                    ["row", "lang_pred", "score", "runs", "certainty"])
    return predict


def learned(docs: DataFrame, train: Column, text: str, lang: str, iterations: int = 30,
            driver_words: int = DRIVER_WORDS, batch_words: int = BATCH_WORDS) -> Field | None:
    """Fits a field on all words of the labelled rows where `train` holds.

    Up to twice `batch_words` distinct words, every step takes the gradient over all; more are dealt into
    batches, each the turn of one step.  With 30 iterations each word has three turns or more.
    """
    scratch = Scratch(docs.sparkSession)
    labelled = docs.where(train & F.col(lang).isNotNull() & (F.octet_length(F.col(text)) > 0)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    tally = map_batches(labelled, _tallied, extended(labelled, ["lang", "text"], "lang string, word string, n long"))
    tally = scratch.table(tally.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    is_word = F.col("word") != ""
    totals = tally.groupBy("lang").agg(F.sum(F.when(is_word, F.col("n"))).alias("words"),
                                       F.sum(F.when(~is_word, F.col("n"))).alias("texts")).where("words > 0")
    totals = sorted(totals.orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES).collect())
    if not totals:
        scratch.drop(tally)
        return None
    labels = [r.lang for r in totals]
    label = F.create_map(*[x for k, name in enumerate(labels) for x in (F.lit(name), F.lit(k))])[F.col("lang")]
    counts = tally.where(is_word).select("word", label.alias("label"), "n").where("label IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))
    listed = counts.where("n > 1").withColumn("nth", nth).where(F.col("nth") <= LEXICON).select("label", "nth", "word")
    lexicon: dict[str, list[int]] = {}
    for r in sorted(listed.collect()):
        lexicon.setdefault(r.word, []).append(r.label)
    words = counts.groupBy("word").agg(F.collect_list(F.struct("label", "n")).alias("found"))
    words = words.withColumn("batch", F.pmod(F.xxhash64("word"), F.lit(BATCHES)).cast("int"))
    words = scratch.table(words.repartition("batch", F.pmod(F.hash("word"), F.lit(4))), "batch")  # few files
    many = words.count()
    if many <= driver_words:
        slopes = _slopes_here(words.toArrow().to_batches())
    else:
        batches = max(1, min(BATCHES, many // batch_words))
        tasks = -(-many // (batches * TASK_WORDS))
        slopes = lambda _, shares: lambda field, step: batches * _slope_in_tasks(
            words.where(F.col("batch") % batches == step % batches).coalesce(tasks), field, shares)
    field = _fitted(labels, [r.texts for r in totals], [r.words for r in totals], lexicon, slopes, iterations)
    scratch.drop(tally, words)
    return field


def identify_language(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang",
                      runs: bool = True) -> DataFrame:
    """Documents (struct `row`) with lang_pred, score (0 to 1), runs of words by language and certainty.

    The field learns from the whole text and non-null lang of all rows where `train` holds (all, if
    not given); languages weigh alike from EVEN_WORDS words on.  A prediction uses the text alone, the whole of it.  lang_pred is a learned value;
    texts that are null or have no letter, and all texts if nothing could be learned, are
    `und` with score 0 and no runs.  score is the share of words expected in that language;
    of equal shares the first label in order counts.  certainty is the mean probability of
    each word's likeliest language: high where every word is labelled surely, in however many languages.  Repeated rows get the same prediction.
    Of more than MOST_LANGUAGES values of lang the most frequent are learned (of equally frequent ones
    the first in order); rows of the others teach nothing and are labelled like all.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learned(docs, F.lit(True) if train is None else train, text, lang))
    # a text goes to the Python workers once, within its row, if it is a column
    within = text if text in docs.columns else None
    rows = bundled(docs) if within else bundled(docs, text=F.col(text))
    return map_batches(rows, _predict(shared, runs, within), extended(
        rows, ["text"], "lang_pred string, score double, runs array<struct<lang:string,first:bigint,words:bigint>>, certainty double"))


def op1_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    found = identify_language(docs, train=~out)
    return found.select("row.doc_id", held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "lang_pred", "score",
                        F.size("runs").cast("long").alias("n_runs"))
