import pyarrow as pa
from pyspark.sql import functions as F

from lumenfold.llm import common


def _rows(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows]), "bytes": pa.array([b.nbytes])})


def test_batches_are_bounded_by_bytes(spark):
    """A megabyte of text a row: a batch holds the few that fit, and every row comes."""
    own = spark.conf.get(common.BATCH_CONF)
    texts = spark.range(12).select(F.repeat(F.lit("x" * 1024), 1024).alias("text")).coalesce(1)
    try:
        spark.conf.unset(common.BATCH_CONF)
        got = common.map_batches(texts, _rows, "rows long, bytes long").collect()
        assert spark.conf.get(common.BATCH_CONF) == str(common.BATCH_BYTES)
    finally:
        spark.conf.set(common.BATCH_CONF, own)
    assert sum(r["rows"] for r in got) == 12 and len(got) > 2
    assert max(r["bytes"] for r in got) <= common.BATCH_BYTES + (1 << 21)


def test_a_bound_of_the_session_stays(spark):
    own = spark.conf.get(common.BATCH_CONF)
    common.bound_batches(spark)
    assert spark.conf.get(common.BATCH_CONF) == own
