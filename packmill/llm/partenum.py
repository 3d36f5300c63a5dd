"""Jaccard join of word shingle sets by PartEnum signatures, its links and components.

Two sets of similar size whose Jaccard similarity is at least p percent differ in few features:
with u and v features, in at most (u + v) * (100 - p) / (100 + p), a 19th at 90 and a 9th at 80.
Sets of one size band therefore get signatures from a common scheme: the feature domain is cut
into n1 first-level parts, and each of these into n2 second-level parts, of which all subsets of
n2 - 1 are enumerated.  k differences spoil at most k / 2 first-level parts; in any other, which holds
one at most, one of the subsets agrees in both sets.

A subset that holds no feature of a set says nothing, and would be shared by sets that have nothing in
common.  There are more first-level parts than needed, so that a set may leave out the empty subsets: as long as it
has no more parts with one than there are parts to spare, a part remains in which the pair agrees in
features.  Only sets with more of them, small ones, keep theirs.

Equal sets are one class and only one of them takes part.  What shares a signature is a
candidate; a sketch whose distance never exceeds that of the sets drops most of those
that are too far apart, and the sets themselves decide.  Components come first: candidates are taken
around one or two leaders of each signature, then between the components that still share a
signature, until all such candidates have been decided.  All links lie within components; there the
classes are compared chunk by chunk, which gives every class its number of links without a row per pair.
"""

from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.llm.common import Scratch, bundled, map_batches, tokens_of, utf8
from packmill.llm.components import components

WIDTH = 3
# A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 90
# Up to this many differences, two of three second-level parts make a signature; above it, one of two.
SMALL = 24
# Below this threshold parts have so few features that it is always two of three.
LEAST_HALVED = 90
# One in so many first-level parts is to spare, at this threshold and above, and below it.
SPARE, SPARE_BELOW = 20, 6
SKETCH = 512
CACHED_WORDS = 400_000
RECENT_TEXTS = 100_000
# classes and features of a chunk of a component; two chunks are compared at a time
CHUNK, CHUNK_FEATURES = 512, 500_000
# pairs of two chunks up to this number are compared one by one, more by products of matrices
FEW_PAIRS, SLAB = 2000, 4096
# bits of the bitmaps that thin out rows before a join; their size is fixed (2 MB), so they help less as
# more keys are marked, and never change a result
MARKS = 1 << 24
# slices of the signatures, compared one after the other; each is cut into as many cells as there are shuffle partitions
TURNS, LEAST_CELLS = 8, 16
# bits of a signature that are kept: two that agree by chance make a candidate more, about which the sets decide
SIGN_BITS = 48
# signatures, and texts, of a task that are packed at a time; signatures of a cell that are compared at a time
PACKED_SIGNS, PACKED_TEXTS, COMPARED = 1 << 21, 1 << 16, 1 << 21
# slices (a power of two) of the features, in which sets are compared one after the other
SLICES = 4
# tables of fewer bytes are shuffled at once, in all slices
AT_ONCE = 32 << 20

_SETS = [f"set{k}" for k in range(SLICES)]
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _B
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(30))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[bytes], hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than `width` are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter((hashes[x] for x in words), np.uint64, len(words))
    size = min(width, len(w))
    value = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        value = _mix(value * _A + w[k:len(w) - size + 1 + k])
    return np.unique(value)


def size_bands(size: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, most differences) of the schemes a set of `size` features takes part in.

    A band reaches from its first size to 1/p^2 of it (1/0.81) at 90 percent and above, and to 1/p of it below, where
    parts have few features as it is.  A pair meets in the band of the larger set, so a set also takes part in the
    following bands that begin within its reach.
    """
    def last(first: int) -> int:
        return first * 10_000 // percent ** 2 if percent >= LEAST_HALVED else first * 100 // percent

    band, first = 0, 1
    while size > last(first):
        band, first = band + 1, last(first) + 1
    found = []
    while not found or 100 * size >= percent * first:
        found.append((band, 2 * last(first) * (100 - percent) // (100 + percent)))
        band, first = band + 1, last(first) + 1
    return found


def signatures(features: np.ndarray, bands: list[tuple[int, int]], percent: int = PERCENT) -> np.ndarray:
    out = []
    for band, most in bands:
        if not most:
            continue  # only equal sets link, and these are one class
        needed, n2 = (most + 2) // 2, 3 if most <= SMALL or percent < LEAST_HALVED else 2
        spare = needed // (SPARE if percent >= LEAST_HALVED else SPARE_BELOW)
        n1 = needed + spare
        seed = _mix(np.array([band + 1], np.uint64))
        place = _mix(features ^ seed)
        cell = (place >> np.uint64(33)) % np.uint64(n1) * np.uint64(n2) + (place & np.uint64(0xFFFF)) % np.uint64(n2)
        cell = cell.astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, cell, _mix(features + _C))
        sums, sizes = sums.reshape(n1, n2), np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        # the features of a first-level part without those of one second-level part
        rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        empty = sizes.sum(axis=1)[:, None] == sizes
        number = np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) + np.uint64(1)
        found = _mix(rest + _mix(number + seed))
        out.append(found[~empty] if empty.any(axis=1).sum() <= spare else found.ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def sketch(features: np.ndarray) -> np.ndarray:
    """Parity of the features in each of SKETCH cells: the bits in which two sketches differ
    are no more than the features in which the sets do."""
    cells = (_mix(features * _C) >> np.uint64(40)) % np.uint64(SKETCH)
    return np.packbits(np.bincount(cells.astype(np.int64), minlength=SKETCH) & 1).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


# Rows of texts, in the turn TEXTS, and of packed signatures, in the turns from 0 on.
_SIGNED = pa.schema([(c, pa.int64()) for c in ("t1", "t2", "n", "fp1", "fp2", "rid")] + [
    ("sketch", pa.list_(pa.int64())), ("cell", pa.int32()), ("base", pa.int64()), ("least", pa.int64()),
    ("gaps", pa.binary()), ("owners", pa.binary()), ("turn", pa.int32())])
_SIGNED_DDL = ("t1 long, t2 long, n long, fp1 long, fp2 long, rid long, sketch array<bigint>, "
               "cell int, base long, least long, gaps binary, owners binary, turn int")
TEXTS = -1


def _rids(numbers: np.ndarray) -> np.ndarray:
    """The numbers of texts, mixed (one to one), so that their low bits differ."""
    return _mix(numbers.astype(np.uint64)).view(np.int64)


def _cells(signs: np.ndarray, cells: int) -> np.ndarray:
    """Which of so many equal ranges each signature is in."""
    return (signs >> np.uint64(SIGN_BITS - 32)) * np.uint64(cells) >> np.uint64(32)


def _packed(signs: np.ndarray, owners: np.ndarray, cells: int) -> list[tuple[int, int, bytes, bytes]]:
    """(cell, least, gaps, owners) of each cell that has signatures: the least of them and the gaps between them, 4 bytes each
    (8 if one is too wide), and the texts they are of, 2 bytes each."""
    order = np.argsort(signs)
    signs, owners = signs[order], owners[order].astype(np.uint16)
    found, starts = np.unique(_cells(signs, cells), return_index=True)
    packed = []
    for cell, start, end in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(signs)][:len(found)], strict=True):
        gaps = np.diff(signs[start:end], prepend=signs[start])
        packed.append((cell, int(signs[start]), gaps.astype(np.uint32 if gaps.max() < 1 << 32 else np.uint64).tobytes(),
                       owners[start:end].tobytes()))
    return packed


def _unpacked(least: int, gaps: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    owners = np.frombuffer(owners, np.uint16)
    gaps = np.frombuffer(gaps, np.uint32 if len(gaps) == 4 * len(owners) else np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(least), owners


def _signed(width: int, percent: int, cells: int):
    """Sets of the texts the task has not met lately (their copies have the same), and their signatures."""
    def rows(turn: int, many: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["turn"] = pa.array(np.full(many, turn, np.int32))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(many, f.type) for f in _SIGNED],
                                          schema=_SIGNED)

    def packed(base: int, signs: list[np.ndarray]):
        owners = np.repeat(np.arange(len(signs)), [len(x) for x in signs])
        found = _packed(np.concatenate(signs), owners, TURNS * cells) if signs else []
        for turn, own in groupby(found, lambda x: x[0] // cells):
            cell, least, gaps, owners = zip(*own, strict=True)
            yield rows(turn, len(cell), cell=pa.array(cell, pa.int32()), base=pa.array([base] * len(cell), pa.int64()),
                       least=pa.array(least, pa.int64()), gaps=pa.array(gaps, pa.binary()), owners=pa.array(owners, pa.binary()))

    def signed(batches):
        hashes, recent = _WordHashes(), {}
        base, signs, size = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            keep, sizes, one, two, numbers, sketches = [], [], [], [], [], []
            keys = zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True)
            for at, (key, text) in enumerate(zip(keys, utf8(batch.column("text")), strict=True)):
                if key in recent:
                    continue
                recent[key] = None
                if len(recent) > RECENT_TEXTS:
                    del recent[next(iter(recent))]
                found = shingle_set(tokens_of(text), hashes, width)
                keep.append(at)
                sizes.append(len(found))
                one.append(int(_mix(found).sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(_mix(found * _B).sum(dtype=np.uint64).astype(np.int64)))
                numbers.append(base + len(signs))
                sketches.append(sketch(found))
                signs.append(signatures(found, size_bands(len(found), percent), percent) >> np.uint64(64 - SIGN_BITS))
                size += len(signs[-1])
                if size >= PACKED_SIGNS or len(signs) == PACKED_TEXTS:
                    yield from packed(base, signs)
                    base, signs, size = base + len(signs), [], 0
            taken = pa.array(keep, pa.int64())
            yield rows(TEXTS, len(keep), t1=batch.column("t1").take(taken), t2=batch.column("t2").take(taken),
                       n=pa.array(sizes, pa.int64()), fp1=pa.array(one, pa.int64()), fp2=pa.array(two, pa.int64()),
                       rid=pa.array(_rids(np.array(numbers, np.int64))), sketch=_lists(sketches))
        yield from packed(base, signs)
    return signed


def _bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bits (MARKS of them, whatever the input) set at the longs of a column, modulo their number."""
    place = F.pmod(F.col(key), F.lit(MARKS))
    words = keys.select((place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, int(pmod({key}, 64)))").alias("bit"))
    bits = np.zeros(MARKS // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r.word] = r.bits
    return bits


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set: true for all keys of the bitmap, and for a few others."""
    place = keys.view(np.uint64) % np.uint64(MARKS) if keys.dtype == np.uint64 else np.mod(keys, MARKS).astype(np.uint64)
    return (bits.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _wanted_texts(shared):
    """Drops texts whose hash is not marked, and those the task has met lately, so that
    neither they nor all copies are shuffled."""
    def wanted(batches):
        recent: dict[int, None] = {}
        for batch in batches:
            keep = []
            keys = np.asarray(batch.column("t1"))
            for place in np.flatnonzero(_marked(shared.value, keys)).tolist():
                key = int(keys[place])
                if key not in recent:
                    recent[key] = None
                    keep.append(place)
                    if len(recent) > RECENT_TEXTS:
                        del recent[next(iter(recent))]
            yield batch.take(pa.array(keep, pa.int64()))
    return wanted


def _sharing(firsts, cells: int):
    """(rid, sign) of the marked rows that share a signature with another one; the packed signatures come sorted by cell."""
    def compared(cell: int, packs: list[tuple]):
        parts = max(1, -(-sum(len(owners) // 2 for *_, owners in packs) // COMPARED))
        for part in range(parts):
            signs, numbers = [], []
            for base, *pack in packs:
                sign, owner = _unpacked(*pack)
                if parts > 1:
                    inside = _cells(sign, cells * parts) == cell * parts + part
                    sign, owner = sign[inside], owner[inside]
                signs.append(sign)
                numbers.append(owner.astype(np.int64) + base)
            sign, rid = np.concatenate(signs), _rids(np.concatenate(numbers))
            keep = _marked(firsts.value, rid)
            sign, rid = sign[keep], rid[keep]
            order = np.argsort(sign)
            sign, rid = sign[order], rid[order]
            same = np.concatenate([[False], sign[1:] == sign[:-1], [False]])
            shared = (same[1:] | same[:-1])[:len(sign)]
            yield pa.RecordBatch.from_arrays([pa.array(rid[shared]), pa.array(sign[shared].view(np.int64))], ["rid", "sign"])

    def sharing(batches):
        now, packs = None, []
        for batch in batches:
            for cell, *pack in zip(*[batch.column(c).to_pylist() for c in ("cell", "base", "least", "gaps", "owners")], strict=True):
                if cell != now and packs:
                    yield from compared(now, packs)
                    packs = []
                now = cell
                packs.append(pack)
        if packs:
            yield from compared(now, packs)
    return sharing


def _sets(width: int):
    def sets(batches):
        hashes = _WordHashes()
        cuts = np.arange(1, SLICES, dtype=np.uint64) * np.uint64((1 << 64) // SLICES)
        for batch in batches:
            found = [shingle_set(tokens_of(t), hashes, width) for t in utf8(batch.column("text"))]
            parts = zip(*[np.split(s, np.searchsorted(s, cuts)) for s in found], strict=True) if found else [[]] * SLICES
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *map(_lists, parts)], ["rid", *_SETS])
    return sets


def _apart(a: str, b: str) -> Column:
    """Lower bound of the number of features in which two sets differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH // 64)), F.lit(0))


def _near(n: str, m: str, apart: Column, percent: int) -> Column:
    """Whether sizes and sketches leave it open that a pair links."""
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return fits & ((100 + percent) * apart <= (100 - percent) * (F.col(n) + F.col(m)))


def _sliced(table: DataFrame, scratch: Scratch, slices: list) -> list[list]:
    """The slices that are taken at once: all of a small table, and each by itself of others."""
    return [slices] if scratch.size(table) < AT_ONCE else [[x] for x in slices]


class _Join:
    """The state of one call: candidate rows, their sets, components so far."""

    def __init__(self, scratch: Scratch, rows: DataFrame, shared: DataFrame, sets: DataFrame, percent: int):
        self.scratch, self.rows, self.shared, self.sets = scratch, rows, shared, sets
        self.percent = percent
        self.links = None
        self.roots = None
        self.tables = []

    def decide(self, pairs: DataFrame) -> None:
        """Compares the sets of pairs(x, y), each of which comes once, and joins the components of those that link.

        A slice of the sets is shuffled and gone before the next."""
        pairs, parts = self.scratch.table(pairs), []
        for some in _sliced(self.sets, self.scratch, _SETS):
            left, right = (self.sets.select(F.col("rid").alias(c), F.concat(*some).alias(f"{c}_set")) for c in ("x", "y"))
            parts.append(self.scratch.table(pairs.join(left, "x").join(right, "y").select(
                "x", "y", F.size(F.array_intersect("x_set", "y_set")).alias("same"), (F.size("x_set") + F.size("y_set")).alias("both"))))
        sums = reduce(DataFrame.union, parts).groupBy("x", "y").agg(F.sum("same").alias("same"), F.sum("both").alias("both"))
        links = (sums.where(100 * F.col("same") >= self.percent * (F.col("both") - F.col("same")))
                 .select(F.col("x").alias("a"), F.col("y").alias("b")))
        if self.links is not None:
            links = links.union(self.links)
        found = self.scratch.table(components(links, self.scratch).select(
            F.col("node").alias("a"), F.col("root").alias("b")))
        self.scratch.drop(pairs, *parts)
        self.tables.append(found)
        self.links = found  # stars around the roots say as much as all links so far
        self.roots = found.select(F.col("a").alias("rid"), F.col("b").alias("root"))

    def placed(self) -> DataFrame:
        """sign, rid, root of the signatures that several components still share."""
        rows = self.shared if self.roots is None else self.shared.join(self.roots, "rid", "left")
        root = F.col("rid") if self.roots is None else F.coalesce("root", "rid")
        rows = rows.withColumn("root", root)
        open_signs = rows.groupBy("sign").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
        return rows.join(open_signs.select("sign"), "sign")

    def nearest(self, pairs: DataFrame) -> DataFrame:
        """Of pairs(x, y), for every x the y of nearest sketch that may link."""
        pairs = pairs.distinct()
        info = self.rows.select("rid", "n", "sketch")
        pairs = pairs.join(info.toDF("x", "xn", "xs"), "x").join(info.toDF("y", "yn", "ys"), "y")
        pairs = pairs.withColumn("apart", _apart("xs", "ys")).where(_near("xn", "yn", F.col("apart"), self.percent))
        return pairs.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("best")).select("x", F.col("best.y").alias("y"))

    def around_leaders(self, order: Column) -> DataFrame:
        rows = self.placed()
        leaders = rows.groupBy("sign").agg(F.min(F.struct(order.alias("o"), "rid", "root")).alias("l")).select(
            "sign", F.col("l.rid").alias("y"), F.col("l.root").alias("y_root"))
        pairs = rows.join(leaders, "sign").where("root <> y_root").select(F.col("rid").alias("x"), "y")
        return self.nearest(pairs)

    def across(self) -> DataFrame:
        """All pairs of different components that share a signature and may link."""
        rows = self.scratch.table(self.placed().join(self.rows.select("rid", "n", "sketch"), "rid"))
        self.tables.append(rows)
        # in each signature, rows of its most frequent component meet the others only
        sizes = rows.groupBy("sign", "root").agg(F.count("*").alias("c"))
        top = sizes.groupBy("sign").agg(F.max(F.struct("c", "root")).alias("t")).select("sign", F.col("t.root").alias("top"))
        rows = rows.join(top, "sign")
        few = rows.where("root <> top").select("sign", F.col("rid").alias("x"), F.col("root").alias("x_root"),
                                               F.col("n").alias("xn"), F.col("sketch").alias("xs"))
        rest = rows.select("sign", F.col("rid").alias("y"), F.col("root").alias("y_root"), F.col("n").alias("yn"),
                           F.col("sketch").alias("ys"), "top")
        near = _near("xn", "yn", _apart("xs", "ys"), self.percent)
        # between two smaller components each pair is met from one side
        pairs = few.join(rest, "sign").where(
            (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("top")) | (F.col("x") < F.col("y"))) & near)
        return pairs.select("x", "y").distinct()


def shared_features(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets `left` with those of `right`, for the pairs that are wanted."""
    found = np.zeros(wanted.shape, np.int64)
    rows, columns = np.nonzero(wanted)
    if len(rows) <= FEW_PAIRS:
        for a, b in zip(rows.tolist(), columns.tolist(), strict=True):
            found[a, b] = len(np.intersect1d(left[a], right[b], assume_unique=True))
        return found
    one, two = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    both = np.intersect1d(one, two)  # only features on both sides count
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    places = [np.searchsorted(both, x) for x in (one, two)]
    for start in range(0, len(both), SLAB):
        size = min(SLAB, len(both) - start)
        parts = []
        for flat, owner, place, sets in zip((one, two), owners, places, (left, right), strict=True):
            dense = np.zeros((len(sets), size), np.float32)
            inside = (place >= start) & (place < start + size)
            inside[inside] = both[place[inside]] == flat[inside]
            dense[owner[inside], place[inside] - start] = 1
            parts.append(dense)
        found += (parts[0] @ parts[1].T).astype(np.int64)
    return found


def _linked(percent: int):
    """Numbers of links (rid, links) from chunks that meet: sorted by root, first and second chunk, own chunk."""
    def compared(sides: dict) -> pa.RecordBatch:
        keys = sorted(sides)
        left, right = sides[keys[0]], sides[keys[-1]]
        (lrid, ln, lw, lsketch, lsets), (rrid, rn, rw, rsketch, rsets) = ([*map(np.asarray, zip(*[x[:3] for x in side], strict=True)),
            np.stack([x[3] for x in side]).view(np.uint64), [x[4] for x in side]] for side in (left, right))
        wanted = 100 * np.minimum(ln[:, None], rn) >= percent * np.maximum(ln[:, None], rn)
        apart = sum(np.bitwise_count(lsketch[:, None, k] ^ rsketch[None, :, k]).astype(np.int64) for k in range(lsketch.shape[1]))
        both = ln[:, None] + rn
        wanted &= (100 + percent) * apart <= (100 - percent) * both
        if len(keys) == 1:
            wanted = np.triu(wanted, 1)
        same = shared_features(lsets, rsets, wanted)
        links = wanted & (100 * same >= percent * (both - same))
        rid, number = np.concatenate([lrid, rrid]), np.concatenate([links @ rw, links.T @ lw])
        return pa.RecordBatch.from_arrays([pa.array(rid[number > 0], pa.int64()), pa.array(number[number > 0], pa.int64())], ["rid", "links"])

    def linked(batches):
        key, sides = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "one", "two", "own", "rid", "n", "w")]
            sketches, sets = batch.column("sketch"), batch.column("set")
            for at, (root, one, two, own, rid, n, w) in enumerate(zip(*columns, strict=True)):
                if (root, one, two) != key:
                    # two chunks of which only one has members are nothing to compare
                    if sides and (key[1] == key[2] or len(sides) == 2):
                        yield compared(sides)
                    key, sides = (root, one, two), {}
                sides.setdefault(own, []).append((rid, n, w, np.asarray(sketches[at].values), np.asarray(sets[at].values)))
        if sides and (key[1] == key[2] or len(sides) == 2):
            yield compared(sides)
    return linked


def _link_numbers(state: _Join, weights: DataFrame) -> DataFrame:
    """rid, links: to how many rows of other classes the rows of a class are linked."""
    roots = state.roots.union(state.roots.select("root", "root").distinct())
    rows = roots.join(state.rows.select("rid", "n", "sketch"), "rid").join(weights, "rid")
    sizes = rows.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_FEATURES)).cast("int").alias("chunks"))
    rows = rows.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    rows = rows.join(state.sets.select("rid", F.concat(*_SETS).alias("set")), "rid").select(
        "root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "rid", "n", "w", "sketch", "set")
    meeting = ["root", "one", "two"]
    rows = rows.repartition(*meeting).sortWithinPartitions(*meeting, "own")
    return map_batches(rows, _linked(state.percent), "rid long, links long").groupBy("rid").agg(F.sum("links").alias("links"))


_TEXT = ["t1", "t2"]


def _named(source: DataFrame, scratch: Scratch, width: int, percent: int, links: bool) -> DataFrame:
    """Of source(id, text, t1, t2), one row per text that isn't null: t1, t2, n, n_links, and `first`, the least row of the
    component as (whether the id is null, id, t1, t2, how many rows have this id and text).  Kept in the scratch folder."""
    spark = source.sparkSession
    given = source.where(F.col("text").isNotNull())
    texts = given.groupBy(*_TEXT, "id").agg(F.count("*").alias("times")).groupBy(*_TEXT).agg(
        F.sum("times").alias("w"), F.min(F.struct(F.col("id").isNull().alias("without"), "id", "times")).alias("least"))
    cells = max(LEAST_CELLS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = scratch.table(map_batches(given.select(*_TEXT, "text"), _signed(width, percent, cells), _SIGNED_DDL), "turn")
    own = ["fp1", "fp2", "n"]
    signed = written.where(F.col("turn") == TEXTS).select(*_TEXT, *own, "rid", "sketch")
    texts = scratch.table(texts.join(signed.drop("sketch").dropDuplicates(_TEXT), _TEXT))

    least = F.min(F.struct("least.without", "least.id", *_TEXT, "least.times"))
    # a text stands in `signed` once or more: the row of its class is one of these
    classes = scratch.table(texts.where("n > 0").groupBy(*own).agg(
        F.min(F.struct("t1", "rid")).alias("row"), F.sum("w").alias("w"), least.alias("least")).select(
        *own, "row.t1", "row.rid", "w", "least"))
    # signatures are most of the data.  They lie packed in a folder for each turn, which is shuffled by cells and gone before the
    # next; a bitmap picks those of the classes' rows, and of a few others, which are dropped when rows that share one are known
    firsts = spark.sparkContext.broadcast(_bitmap(classes, "rid"))
    shares = []
    for turns in _sliced(written, scratch, list(range(TURNS))):
        packs = written.where(F.col("turn").isin(turns)).select("cell", "base", "least", "gaps", "owners")
        found = map_batches(packs.repartition("cell").sortWithinPartitions("cell"), _sharing(firsts, TURNS * cells), "rid long, sign long")
        shares.append(scratch.table(found.join(classes.select("rid"), "rid", "left_semi")))
        for turn in turns:
            scratch.drop(written, folder=f"turn={turn}")
    shared = reduce(DataFrame.union, shares)
    taking = scratch.table(signed.join(shared.select("rid").distinct(), "rid", "left_semi"))
    scratch.drop(written)
    marks = spark.sparkContext.broadcast(_bitmap(taking, "t1"))
    wanted = given.select(*_TEXT, "text")
    wanted = map_batches(wanted, _wanted_texts(marks), wanted.schema).dropDuplicates(_TEXT)
    wanted = wanted.join(taking.select("rid", *_TEXT), _TEXT).select("rid", "text")
    sets = scratch.table(map_batches(wanted, _sets(width), "rid long, " + ", ".join(f"{c} array<bigint>" for c in _SETS)))

    state = _Join(scratch, taking, shared, sets, percent)
    near = [scratch.table(state.around_leaders(order)) for order in (F.col("rid"), F.xxhash64("rid"))]
    state.decide(reduce(DataFrame.union, near).distinct())
    state.decide(state.around_leaders(F.xxhash64("root", "rid")))
    state.decide(state.across())

    roots = classes.drop("t1").join(state.roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    numbers = F.lit(None).cast("long")
    if links:
        roots = roots.join(_link_numbers(state, classes.select("rid", "w")), "rid", "left")
        numbers = F.coalesce("links", F.lit(0)) + F.col("w") - 1
    least = roots.groupBy("root").agg(F.min("least").alias("first"))
    roots = scratch.table(roots.withColumn("n_links", numbers).join(least, "root").select(*own, "n_links", "first"))
    named = scratch.table(texts.select(*_TEXT, *own).join(roots, own, "left").select(*_TEXT, "n", "n_links", "first"))
    scratch.drop(classes, texts, *shares, taking, sets, *near, roots, *state.tables)
    return named


def _hashed(docs: DataFrame, text: str, key: str, carry: tuple[str, ...] | None) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, t1, t2), and the same with texts in place of rows.  The 128 bits of t1 and t2 stand for a text."""
    body, ident = F.col(f"`{text}`"), F.col(f"`{key}`")
    columns = {"id": ident, "t1": F.xxhash64(F.lit(1), body), "t2": F.xxhash64(F.lit(2), body)}
    return bundled(docs, carry, **columns, empty=body.isNull()), docs.select(body.alias("text"), *[c.alias(n) for n, c in columns.items()])


def _is_first() -> Column:
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("id", *_TEXT)))


def join_shingles(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
                  carry: tuple[str, ...] | None = None, percent: int = PERCENT) -> DataFrame:
    """Documents (struct `row`, of the columns `carry` if given) with n_shingles, n_links and component_id, by links of
    Jaccard >= `percent` / 100 (a whole number from 1 to 99).

    Tokens are runs between ASCII white space with A-Z lower-cased; a document's set has its
    distinct shingles of `width` tokens, or the whole sequence if it has fewer.  Null texts
    and texts without tokens have no shingles and link with nothing: their component is
    their own id.  n_links counts the other rows a row links to, copies included.
    component_id is the smallest non-null id of the documents reachable by
    links; a null id takes part and gets null only if no id is reachable.  Repeated rows and
    ids are rows of one component like other copies.  keep marks one row of each component,
    one of the smallest id, and all rows without shingles.  An empty table gives an empty one, and the length of
    a text has no limit.  The input is read several times, so it should be a table.
    """
    if percent not in range(1, 100):
        raise ValueError("percent is a whole number from 1 to 99")
    rows, source = _hashed(docs, text, key, carry)
    named = _named(source, Scratch(docs.sparkSession, tidy=True), width, percent, links=True)
    found = rows.join(named.withColumn("known", F.lit(True)), _TEXT, "left").withColumn(
        "n", F.when(F.col("empty") | F.col("known").isNull(), 0).otherwise(F.col("n")))
    # of rows equal in id and text one is the first
    nth = F.row_number().over(Window.partitionBy("first").orderBy("id"))
    firsts = found.where((F.col("n") > 0) & _is_first()).withColumn("keep", nth == 1)
    others = found.where((F.col("n") == 0) | ~_is_first()).withColumn("keep", F.col("n") == 0)
    return firsts.unionByName(others).select(
        "row", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("first.id")).alias("component_id"), "keep")


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that `keep` of `join_shingles` marks, without numbers of links, which are not worked out."""
    rows, source = _hashed(docs, text, key, None)
    empty = rows.where("empty").select("row.*")
    named = _named(source, Scratch(docs.sparkSession, tidy=True), width, percent, links=False)
    # of each component the text of its first row, and all texts without shingles; a row goes through one shuffle, and those
    # equal in id and text, cut to one before, through another
    first = F.when(F.col("n") > 0, F.col("first")).alias("first")
    texts = named.where((F.col("n") == 0) | (F.struct(*_TEXT) == F.struct(*[F.col(f"first.{c}") for c in _TEXT]))).select(*_TEXT, first)
    rows = rows.where("not empty").drop("empty").join(texts, _TEXT).where(F.col("first").isNull() | _is_first())
    nth = F.row_number().over(Window.partitionBy("first").orderBy("id"))
    repeated = rows.where("first.times > 1").withColumn("nth", nth).where("nth = 1").select("row.*")
    return rows.where("first is null or first.times = 1").select("row.*").union(repeated).union(empty)


def op10_partenum(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_shingles(docs, carry=("doc_id",)).select("row.doc_id", "n_shingles", "component_id", "n_links")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([concat_ws(' ', w[k], w[k + 1], w[k + 2]) FOR k IN range(1, len(w) - 1)]) END AS f FROM d),
x AS (SELECT r, len(f) AS n, unnest(f) AS g FROM s),
p AS (SELECT a.r AS r, b.r AS q FROM x a JOIN x b ON a.g = b.g AND a.r < b.r
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT r, q FROM p UNION ALL SELECT q, r FROM p),
c(r, q) AS (SELECT r, r FROM s UNION SELECT c.r, e.q FROM c JOIN e ON c.q = e.r)
SELECT s.doc_id, CAST(len(s.f) AS BIGINT) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM s LEFT JOIN (SELECT r, count(*) AS n_links FROM e GROUP BY r) k ON s.r = k.r JOIN (SELECT c.r, min(t.doc_id) AS component_id FROM c JOIN s t ON c.q = t.r GROUP BY c.r) m ON s.r = m.r"""
