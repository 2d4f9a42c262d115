"""Shared plumbing: tables in the cluster's shared folder, global running positions.

Jobs here survive the loss of executors: lineage is cut only by Parquet tables in the
folder that ``spark.checkpoint.dir`` names, which every executor and the driver share.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.llm.encode import forget, sliced

BATCH_CONF, DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, which all executors share: ``spark.checkpoint.dir``, or the folder that ``setCheckpointDir`` was given.

    Where neither is set, a temporary folder serves a local master, whose executors are this process; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables go there")
        found = tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lumenfold/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as a Parquet table in the shared folder; returns it reread, and its path."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Removes intermediate tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by BATCH_BYTES, unless the session sets a bound of its own.

    Rows are counted by Spark's default, 10,000 a batch: of texts, tens of megabytes, which a task
    holds twice in the JVM's memory beyond its heap and again in its worker. Plans read the setting as they run.
    """
    if spark.conf.get(BATCH_CONF) == DEFAULT_BATCH:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _running(weight: str, group: str | None, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            if group is None:
                total = np.cumsum(w) + seen.get(None, 0)
                before = total - w
                if len(w):
                    seen[None] = int(total[-1])
            else:
                before, keys = np.empty(len(w), np.int64), b.column(group).to_numpy(zero_copy_only=False)
                for k in np.unique(keys):
                    at = keys == k
                    total = np.cumsum(w[at]) + seen.get(int(k), 0)
                    before[at] = total - w[at]
                    seen[int(k)] = int(total[-1])
            cols = [*b.columns, pa.array(np.full(len(w), part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def running_positions(df: DataFrame, order: list[str], weight: str, out: str, group: str | None = None) -> tuple[DataFrame, str]:
    """Adds ``out``: the sum of ``weight`` over all rows that come before, in ``order`` (within ``group``).

    Rows are range-partitioned, so that ties and hot keys still spread when ``order`` ends in
    a distinguishing column. Each task adds running sums to its own rows; the driver sees one
    total per task (and group, which must have few values), never rows.

    Nulls in ``weight`` aren't allowed; an empty table gives an empty table.
    """
    spark = df.sparkSession
    keys = ([group] if group else []) + order
    ranged = df.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])

    done, path = materialise(map_batches(ranged, _running(weight, group, to_arrow_schema(schema)), schema), "running")
    by = ["_part"] + ([group] if group else [])
    totals = done.groupBy(*by).agg(F.max(F.col("_before") + F.col(weight)).alias("n")).orderBy(*by[::-1], "_part").collect()
    base, rows = {}, []
    for r in sorted(totals, key=lambda r: (r["_part"],)):
        g = r[group] if group else None
        rows.append((r["_part"], g if group else 0, base.get(g, 0)))
        base[g] = base.get(g, 0) + r["n"]
    offsets = spark.createDataFrame(rows or [(0, 0, 0)], f"_part int, {'`' + group + '`' if group else '_none'} int, _base long")
    on = by if group else ["_part"]
    joined = done.join(F.broadcast(offsets), on)  # a row per task (and group)
    return joined.withColumn(out, F.col("_before") + F.col("_base")).drop("_part", "_before", "_base", "_none"), path


def add_column(df: DataFrame, text_col: str, name: str, kind: T.DataType, arrow: pa.DataType, make: Callable[[], Callable[[list[str | None]], list]]) -> DataFrame:
    """``df`` with a column made from its texts in Python; all other columns pass through as they are, in the same task.

    ``make`` runs once a task and returns the function from a batch's texts to its values. A column called ``name`` is replaced.
    """
    kept = df.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        f = make()
        for b in batches:
            made = [x for _, texts in sliced(b, text_col) for x in f(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow)], names=[*b.schema.names, name])

    return map_batches(kept, run, schema)
