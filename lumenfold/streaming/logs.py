"""Append-only logs read as streams: each event once, late ones kept apart, and answers met with their timing.

``keep_log`` holds what batches need of the past in a small table of recent ids, so that a batch reads what lies within the lateness, never the
log. A batch is one commit: a run that is broken off and started anew tells the same as one that wasn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.atomic import AtomicStore


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a growing folder; malformed lines are left out."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def once(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """A stream's events without those that come again within ``late``; state is kept for so long only."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def keep_batch(store: AtomicStore, rows: DataFrame, batch: tuple[str, int], key: str, at: str, late_ms: int) -> None:
    """Adds a batch to the tables ``events`` and ``late`` of a store.

    An event over ``late_ms`` older than the newest of earlier batches is late: whether it came before can't be told any more,
    and it goes to a table of its own. Of events with one key the first stays. Rows without a key or a time are late.
    """
    if store.done(*batch):
        return
    kind = rows.schema[key].dataType.simpleString()
    high = store.read("high", schema="high long").first()
    recent = store.read("recent", schema=f"{key} {kind}, ms long")
    ms, edge = F.unix_millis(at), (high["high"] - late_ms if high else -(2**62))
    rows = rows.withColumn("_late", F.col(key).isNull() | F.col(at).isNull() | (ms < edge))
    late = store.append("late", rows.where("_late").drop("_late"))
    first = F.min_by(F.struct(*rows.columns), F.struct(ms, *[F.col(c) for c in rows.columns if c not in (at, "_late") and not rows.schema[c].dataType.typeName().startswith("map")]))
    fresh = rows.where("not _late").groupBy(F.col(key).alias("_key")).agg(first.alias("r")).select("r.*").drop("_late").join(recent.select(key), key, "left_anti").select([c for c in rows.columns if c != "_late"])
    come = store.append("events", fresh)
    newest = store.staged(come).agg(F.max(ms).alias("high")).first()["high"]
    now = max(x for x in (newest, high and high["high"], edge) if x is not None)
    ids = recent.unionByName(store.staged(come).select(key, ms.alias("ms"))).where(F.col("ms") >= now - late_ms)
    store.commit(come, late, store.overwrite("recent", ids), store.overwrite("high", store.spark.createDataFrame([(now,)], "high long")), batch=batch)


def keep_log(events: DataFrame, root: str, checkpoint: str, key: str, at: str, late_ms: int):
    """A query that keeps a stream of events in the store at ``root``."""
    store = AtomicStore(events.sparkSession, root)
    return events.writeStream.foreachBatch(lambda rows, n: keep_batch(store, rows, (checkpoint, n), key, at, late_ms)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def timed_answers(answers: DataFrame, timings: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Answers (answer, at, ...) with their timing events (answer, timed_at, ...), which come within ``within`` of them: a join of two streams, or of two tables.

    An answer without timing is told, with nulls, once its time has passed on both streams; state is kept no longer than that.
    """
    a = answers.withWatermark("at", late).alias("a")
    t = timings.withWatermark("timed_at", late).withColumnRenamed("answer", "of").alias("t")
    return a.join(t, F.expr(f"a.answer = t.of and t.timed_at >= a.at and t.timed_at <= a.at + interval {within}"), "left_outer").drop("of")
