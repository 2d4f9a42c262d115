"""State with timers: a silent conversation expires by itself, incidents lapse, and batch and stream agree."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.streaming import expiring as E

FIELDS = "location string, entity string, user_status string, purpose string, date string"
TURNS = f"conversation string, turn long, at timestamp, kind string, message string, {FIELDS}"


@pytest.fixture
def rocks(spark):
    own = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    E.state_on_disk(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", own)


def streamed(spark, tmp_path, schema, files, make, name):
    """What a stream tells that is started anew for each file, from one checkpoint."""
    land, ck, out = (str(tmp_path / f"{name}-{x}") for x in ("land", "ck", "out"))
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(land)
        q = make(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(land)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def turn(c, n, minute, kind, message="", **fields):
    return (c, n, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)).to_pydatetime(), kind, message, *(fields.get(f) for f in ("location", "entity", "user_status", "purpose", "date")))


def test_a_silent_conversation_expires_by_timer(rocks, tmp_path):
    first = [turn("a", 0, 0, "ask:location", "visa?"), turn("b", 0, 1, "ask:location", "carte?"), turn("c", 0, 2, "ask:location", "caf?"), turn("c", 1, 3, "reply", "Lyon", location="Lyon")]
    second = [turn("b", 1, 20, "reply", "hm"), turn("z", 0, 100, "reply", "hello")]  # time goes on for all
    third = [turn("a", 1, 110, "reply", "Lyon", location="Lyon"), turn("z", 1, 300, "reply", "x")]
    files = [first, second, third, [turn("z", 2, 301, "reply", "y")]]
    got = streamed(rocks, tmp_path, TURNS, files, E.dialogue_stream, "turns")
    shown = lambda df: sorted((r["conversation"], r["at"], r["turn"] is None, r["turn"] or 0, r["outcome"], r["question"], r["field"], tuple(sorted(r["context"].items()))) for r in df.collect())
    want = E.dialogue(rocks.createDataFrame([r for f in files for r in f], TURNS), until=pd.Timestamp("2024-01-01 04:51"))
    assert shown(got) == shown(want)
    by = {(r["conversation"], r["outcome"]) for r in got.collect()}
    assert {("a", "silent"), ("b", "silent"), ("b", "waiting"), ("c", "resumed"), ("a", "idle")} <= by and ("c", "silent") not in by


def test_incidents_lapse(rocks, tmp_path):
    rnd = random.Random(3)
    day = lambda d: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=d)).to_pydatetime()
    rows = [(rnd.choice("st"), rnd.choice(["dns", "timeout"]), day(h), rnd.random() < 0.7) for h in sorted(rnd.sample(range(1, 24 * 60), 60))]
    rows += [("end", "dns", day(24 * 90), True)]
    files = [rows[i : i + 17] for i in range(0, len(rows), 17)] + [[("end", "dns", day(24 * 90 + 1), True)]]
    schema = "source string, kind string, at timestamp, failed boolean"
    got = streamed(rocks, tmp_path, schema, files, E.incident_stream, "incidents")
    want = E.ended_incidents(rocks.createDataFrame([r for f in files for r in f], schema), "2024-03-31 00:00:00")
    shown = lambda df: sorted(tuple(r) for r in df.collect())
    assert shown(got) == shown(want) and {r["status"] for r in got.collect()} == {"resolved", "lapsed"}


def test_a_batch_without_silence_equals_the_plain_dialogue(spark):
    from lumenfold.operators import conversation as C

    rows = [turn("a", i, 5 * i, k, m, location=v) for i, (k, m, v) in enumerate([("ask:location", "visa?", None), ("reply", "hm", None), ("reply", "Lyon", "Lyon"), ("ask:entity", "", None), ("reply", "no idea", None)])]
    df = spark.createDataFrame(rows, TURNS)
    cols = ["conversation", "turn", "outcome", "question", "field"]
    assert sorted(map(tuple, E.dialogue(df).select(*cols).collect())) == sorted(map(tuple, C.dialogue(df).select(*cols).collect()))
    assert E.dialogue(df.where(F.lit(False))).collect() == []
