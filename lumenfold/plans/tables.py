"""Access to tables, and texts made from them by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are: work on each row then isn't one file's task.

    Such a table has less than a split's bytes for each core, so little is moved; larger ones stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def quoted(words) -> str:
    """Words as a list of SQL literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
