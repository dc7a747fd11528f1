"""Readers of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once: in the shared checkpoint folder where the session names one, else
    in memory and on disk of the executors, from where they can be computed again."""
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named and not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()
