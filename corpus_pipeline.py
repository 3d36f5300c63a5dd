"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept:
documents without a recognisable language go, one document of each group of near copies
stays, documents with benchmark passages go, sources are mixed to their target weights (a
document may go or come twice), and what is left is cut into shards.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from packmill.llm.common import Scratch, unbundled
from packmill.llm.decontaminate import find_contamination
from packmill.llm.language import UNDETERMINED, identify_language
from packmill.llm.mixing import mix_sources
from packmill.llm.partenum import drop_near_copies
from packmill.llm.sharding import hilbert_shards

# A document stays if the likeliest languages of its words are so probable in the mean, be it one language or several.
LEAST_CERTAINTY = 0.5
# Near copies share four fifths of their shingles of five words.
SHINGLE_WORDS, SHARED_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify_language(docs, runs=False)
    return unbundled(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("certainty") >= LEAST_CERTAINTY)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, width=SHINGLE_WORDS, percent=SHARED_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unbundled(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs).where("copies > 0")
    return unbundled(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents and shard, slot, size (in place of any of these names)."""
    own = ("shard", "slot", "size")
    return hilbert_shards(docs).select(*[f"row.`{c}`" for c in docs.columns if c.lower() not in own], *own)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

# SQL can't express the fitted language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents.  Rows that repeat, nulls and empty texts are treated as
    each operator states: texts without letters go in the first stage already."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
