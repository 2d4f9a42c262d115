"""Append-only logs, manifests and binary files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "at timestamp, event string, source string, detail string, fields map<string,string>"


def read_log(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """JSON lines; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log, a folder a day."""
    df.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)


def read_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """(path, sha256, size, content) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def pending(chunks: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key isn't indexed yet: what a resumed build has to do."""
    return chunks.join(known.select(key), key, "left_anti")


def append_index(chunks: DataFrame, path: str, key: str = "chunk_id", refresh: bool = False) -> None:
    """Writes chunks that the index at ``path`` lacks; ``refresh`` writes it anew."""
    spark = chunks.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if refresh or not there:
        chunks.write.mode("overwrite").parquet(path)
    else:
        pending(chunks, spark.read.parquet(path), key).write.mode("append").parquet(path)
