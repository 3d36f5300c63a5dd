"""Materialising an intermediate result so that lost executors cost no correctness."""

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, within the one named by spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """`durable`, and aggregates that are taken while the rows are written, without another job.

    A stage that runs again after an executor was lost may count its rows twice: use them to choose a plan, not for results.
    """
    seen = Observation()
    table = durable(df.observe(seen, *[c.alias(n) for n, c in figures.items()]))
    return table, seen.get
