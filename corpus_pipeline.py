"""A corpus pipeline over ``documents``: five stages, each an operator of ``lumenfold.llm``.

A stage takes what its predecessor kept, as written to Parquet and read again, and all but the last
return the columns of ``documents``. Stages decide from texts alone; labels only train the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, minhash, packing, substring, toxicity
from lumenfold.llm.common import drop_path, new_path, unused
from lumenfold.llm.queries import held_out, table, tokenizer_path

LEAST_TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is at least 0.5 go."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = unused(docs, "_score")
    return toxicity.add_score(docs, weights, out=score).where(F.col(score) < LEAST_TOXIC).select(docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, one row stays: that with the smallest id, null ids last. Rows that share an id or have none are documents of their own."""
    return minhash.one_of_each_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window of 20 words go; every document stays, its n_chars anew."""
    kept = substring.remove_repeats(docs, whole=True).select("others.*", F.col("kept_text").alias("text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the edit budget, go."""
    leak = unused(docs, "_leak")
    flagged = decontaminate.add_flag(docs, table(spark, sf_dir, "benchmark"), out=leak)
    return flagged.where(~F.col(leak)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in sequences of 2048 along the Hilbert curve."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), "byte", 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", keep_one_of_each_class),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, consistent sampling and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from its table in the shared folder; the tables before it are removed as soon as the next is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        found = stage(spark, docs, sf_dir)
        found.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    return docs
