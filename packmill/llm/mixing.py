"""Mixing sources to target token weights by entropy balancing.

Among all rates r in [0, 2] under which the tokens of each source add up to its target,
the ones closest to 1 in relative entropy are r = min(2, exp(lambda * size)), one lambda
per source, the multiplier of its token constraint in the convex dual.  Each Newton
iteration is one aggregation over the histogram of sizes per source.  The rates become
copies: their whole part, and one more where a hash falls below a cut that brings each
source's tokens as near to its target as whole documents allow.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from packmill.llm.common import Scratch, bundled

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
TOLERANCE = 1e-7
ITERATIONS = 60
# A cut is searched by counting tokens in so many bins, twice; single rows are compared
# only in the one bin of a bin that holds the cut.
BINS = 4096


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _measured(docs: DataFrame, text: str, source: str, keys: list[str]) -> DataFrame:
    """row, skey (sorts by code point, null last), size, draw in [0, 1)."""
    draw = F.pmod(F.xxhash64(*[F.col(f"row.`{k}`") for k in (*keys, source, text)]), F.lit(1 << 53)) / float(1 << 53)
    name = F.col(source)
    return bundled(docs, skey=F.when(name.isNull(), "1").otherwise(F.concat(F.lit("0"), name)),
                   size=n_tokens(F.col(text))).withColumn("draw", draw)


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: skey, source_size, and more.  Adds target.

    Sources in order of their key weigh 3, 1, 2 and so on and share 150 % of all sizes; no
    target is above twice its source's size.  With one common factor t, a target is
    min(cap, weight * t), so t follows from the sources whose cap per weight is below it.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = (F.row_number().over(Window.orderBy("skey")) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(int(MOST)) * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("left", left)
    factor = F.min(F.when(F.col("left") <= F.col("ratio"), F.struct("ratio", "left"))).over(everything)["left"]
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"),
                                               F.coalesce(F.col("weight") * factor, F.lit(0.0)))).drop(
        "weight", "ratio", "left")


def _rate(size: Column, lam: Column, mean: Column) -> Column:
    return F.when(size == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(MOST), F.exp(F.least(F.greatest(lam * size / mean, F.lit(-60.0)), F.lit(1.0)))))


def balance(measured: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source: skey, source_size, target, mean, lam, full (all documents twice)."""
    # partial sums per task, so a source that owns a third of all rows costs no skew
    histogram = scratch.table(measured.groupBy("skey", "size").agg(F.count("*").alias("n")))
    sizes = histogram.groupBy("skey").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumn("mean", F.sum("source_size").over(everything) / F.sum("rows").over(everything))
    state = source_targets(sizes.drop("rows")).select(
        "*", (F.col("target") >= F.col("cap") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("lam"),
        F.lit(-1e9).alias("lo"), (F.log(F.lit(MOST)) * F.col("mean") / F.col("least")).alias("hi"),
        F.lit(1.0).alias("off")).drop("cap", "least")
    state = scratch.table(state)
    rate = _rate(F.col("size"), F.col("lam"), F.col("mean"))
    mass = F.col("n") * F.col("size") * rate
    for _ in range(ITERATIONS):
        sums = (histogram.where("size > 0").join(state.where("not full").select("skey", "lam", "mean"), "skey")
                .groupBy("skey").agg(F.sum(mass).alias("f"), F.sum(
                    F.when(rate < MOST, mass * F.col("size") / F.col("mean")).otherwise(0.0)).alias("h")))
        gap = F.col("f") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        moved = state.join(sums, "skey", "left").withColumns({"gap": gap, "lo": lo, "hi": hi})
        step = F.col("lam") - F.col("gap") / F.col("h")
        inside = (F.col("h") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        moved = moved.withColumns({
            "off": F.coalesce(F.abs(F.col("gap")) / F.col("target"), F.lit(0.0)),
            "lam": F.when(F.col("gap").isNull() | (F.col("gap") == 0), F.col("lam")).when(inside, step)
            .otherwise((F.col("lo") + F.col("hi")) / 2)}).select(*state.columns)
        last, state = state, scratch.table(moved)
        scratch.drop(last)
        if not state.where(F.col("off") > TOLERANCE).head(1):
            break
    scratch.drop(histogram)
    return state.select("skey", "source_size", "target", "mean", "lam", "full")


def _crossing(bins: DataFrame, start: str) -> DataFrame:
    """The first bin of each source at which the tokens reach the target, and the tokens before it."""
    upto = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return (bins.withColumn("upto", F.col(start) + F.sum("tokens").over(upto))
            .where(F.col("upto") >= F.col("target")).groupBy("skey", "target")
            .agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"))).alias("at"))
            .select("skey", "target", "at.bin", "at.before"))


def _cuts(measured: DataFrame, state: DataFrame, scratch: Scratch) -> DataFrame:
    """state with `cut`: documents whose draw less their rate's fraction is at most that get one copy more."""
    rate = _rate(F.col("size"), F.col("lam"), F.col("mean"))
    rated = scratch.table(measured.where("size > 0").select("skey", "size", "draw").join(
        state.where("not full and target > 0"), "skey").select(
            "skey", "target", "size", F.floor(rate).alias("whole"), (F.col("draw") - (rate - F.floor(rate))).alias("v")))
    whole = rated.groupBy("skey").agg(F.sum(F.col("whole") * F.col("size")).alias("start"))
    place = (F.col("v") + 1) * (BINS // 2)
    coarse, fine = F.floor(place), F.floor((place - F.floor(place)) * BINS)
    rest = rated.where(F.col("whole") < MOST)
    bins = rest.groupBy("skey", "target", coarse.alias("bin")).agg(F.sum("size").alias("tokens")).join(whole, "skey")
    first = scratch.table(_crossing(bins, "start"))
    inside = rest.withColumn("coarse", coarse).join(
        first.select("skey", F.col("bin").alias("coarse"), F.col("before").alias("start")), ["skey", "coarse"])
    bins = inside.groupBy("skey", "target", "coarse", "start", fine.alias("bin")).agg(F.sum("size").alias("tokens"))
    second = scratch.table(_crossing(bins, "start").join(first.select("skey", F.col("bin").alias("coarse")), "skey"))
    inside = rest.withColumns({"coarse": coarse, "fine": fine}).join(
        second.select("skey", "coarse", F.col("bin").alias("fine"), F.col("before").alias("start")),
        ["skey", "coarse", "fine"])
    rows = inside.groupBy("skey", "target", "start", "v").agg(F.sum("size").alias("tokens"))
    upto = F.col("start") + F.sum("tokens").over(Window.partitionBy("skey").orderBy("v"))
    # at the crossing row, whichever side of it is nearer; `below` keeps it out
    at = (rows.withColumn("upto", upto).where(F.col("upto") >= F.col("target")).groupBy("skey", "target")
          .agg(F.min(F.struct("v", "upto", "tokens")).alias("x"))
          .select("skey", F.when(F.col("x.upto") - F.col("target") <= F.col("target") - F.col("x.upto") + F.col("x.tokens"),
                                 F.col("x.v")).otherwise(F.col("x.v") - 1e-15).alias("cut")))
    cut = state.join(at, "skey", "left").withColumn("cut", F.coalesce("cut", F.lit(1.0)))
    kept = scratch.table(cut)
    scratch.drop(rated, first, second)
    return kept


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source",
                keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents (struct `row`) with size, source_size, target, rate, copies (0, 1 or 2) and taken.

    size counts runs between white space in the whole text; a null text has none.  Null is a
    source of its own, the last.  A document without words stays once and takes no words.
    The hash of `keys`, source and text decides the rounding, so reruns agree, and rows that
    repeat in all of these are taken alike.  Without any word all targets are 0.
    """
    scratch = Scratch(docs.sparkSession)
    measured = _measured(docs, text, source, list(keys))
    narrow = scratch.table(measured.drop("row"))
    state = _cuts(narrow, balance(narrow, scratch), scratch)
    scratch.drop(narrow)
    rate = F.when(F.col("full") & (F.col("size") > 0), F.lit(MOST)).when(
        (F.col("target") <= 0) & (F.col("size") > 0), F.lit(0.0)).otherwise(
        _rate(F.col("size"), F.col("lam"), F.col("mean")))
    # the state has one row per source; its size is known from its files, so Spark itself decides on a broadcast
    mixed = measured.join(state, "skey").withColumn("rate", rate)
    more = (F.col("size") > 0) & (F.col("rate") > 0) & (F.col("rate") < MOST) & (
        F.col("draw") - (F.col("rate") - F.floor("rate")) <= F.col("cut"))
    copies = (F.floor("rate") + more.cast("int")).cast("int")
    return mixed.withColumn("copies", copies).select(
        "row", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_entropy_balancing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("row.doc_id", "size", "source_size", "target", "taken", "rate", "copies")
