"""Token-ID output: ORC files of ids in ascending document order, and readers of them.

A file holds one range of document ids. Its columns are run-length encoded integers; every
stripe has a row index and a Bloom filter on ``doc_id``, so a reader may take the stripes of a
file in parallel, and a lookup of a few ids reads the metadata of all stripes but the data of few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import map_batches, new_path, shuffle_width
from lumenfold.llm.encode import encoder, sliced

END_ID = 1
STRIPE_BYTES, STRIDE = 16 << 20, 10_000  # of a stripe, and rows that an entry of its index covers
FIELDS = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _encode(path: str, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc, part, start = encoder(path, kind), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at, texts in sliced(whole, "text"):
                b = whole.slice(at, len(texts))
                flat, cut = enc.flat(texts, END_ID)
                n = np.diff(cut)
                ids = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(start + cut[:-1]), pa.array(n), ids],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(cut[-1])

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, kind: str, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Encodes every whole text, appends the end id and writes ORC under ``path`` in ascending id order.

    ``kind`` names how the vocabulary splits a text: ``byte`` (byte-level, spaces kept) or
    ``word`` (white space dropped). A null or empty text is the end id alone. Null ids come
    first; repeated rows are written as often as they come, next to each other. Only the two
    named columns are read. An empty table writes no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ranged = rows.repartitionByRange(shuffle_width(spark), "doc_id", F.octet_length("text")).sortWithinPartitions("doc_id", F.octet_length("text"))
    (
        map_batches(ranged, _encode(tokenizer, kind), FIELDS)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids``, a filter that goes down to stripe statistics and Bloom filters."""
    df = spark.read.schema(FIELDS).orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    import numpy as np

    for b in batches:
        ids = b.column("ids")
        flat, off = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], names=[*b.schema.names[:4], "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = read_token_ids(spark, path)
    ends = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).orderBy("part").collect()  # a row a file
    base, rows = 0, []
    for r in ends:
        rows.append((r["part"], base))
        base += r["n"]
    starts = spark.createDataFrame(rows or [(0, 0)], "part int, base long")
    got = map_batches(files.select("doc_id", "part", "part_start", "n_tokens", "ids"), _digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return got.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_orc(docs: DataFrame, tokenizer: str, kind: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` and reads the files back as :func:`token_digest` does."""
    spark = docs.sparkSession
    path = path or new_path(spark, "orc")
    write_token_ids(docs, path, tokenizer, kind)
    return token_digest(spark, path)
