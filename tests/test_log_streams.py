"""Logs as streams: replay with restarts equals the batch query."""

import datetime
import random


from lumenfold.sources.atomic import AtomicStore
from lumenfold.streaming import logs as L

SCHEMA = "id long, at timestamp, event string, fields map<string,string>"
HOUR = 3_600_000


def stamp(h):
    return (datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")


def batches():
    rnd = random.Random(5)
    out, n = [], 0
    for b in range(4):
        rows = []
        for _ in range(30):
            rows.append((n, 10 * b + rnd.randint(0, 12), f"e{n % 3}"))
            n += 1
        rows += [rnd.choice(rows) for _ in range(5)]  # told twice in one batch
        rows += [(i, h, e) for i, h, e in (out[-1][:4] if out else [])]  # and once more in the next
        rows += [(1000 + b, 10 * b - 30, "old")] if b else []
        out.append(rows)
    return out


def plain(files, late):
    """The same row by row."""
    events, lost, high = {}, [], None
    for rows in files:
        edge = -(10**9) if high is None else high - late
        for i, h, e in sorted(rows, key=lambda r: (r[1], r[0])):
            if h < edge:
                lost.append((i, h, e))
            elif i not in events:
                events[i] = (i, h, e)
        high = max([h for _, h, _ in events.values()])
    return sorted(events.values()), sorted(lost)


def test_replay_with_restarts_equals_the_batch(spark, tmp_path):
    land, root, ck = tmp_path / "land", str(tmp_path / "store"), str(tmp_path / "ck")
    land.mkdir()
    files = batches()
    for b, rows in enumerate(files):
        lines = [f'{{"id":{i},"at":"{stamp(h)}","event":"{e}","fields":{{"k":"v"}}}}' for i, h, e in rows]
        (land / f"{b}.json").write_text("\n".join([*lines, "not json"]) + "\n")
        if b == 1:
            continue  # two files at the next start are one batch
        L.keep_log(L.log_stream(spark, str(land), SCHEMA), root, ck, "id", "at", 6 * HOUR).start().awaitTermination()
    store = AtomicStore(spark, root)
    shown = lambda t: sorted((r["id"], int((r["at"] - datetime.datetime(2024, 1, 1)).total_seconds() // 3600), r["event"]) for r in store.read(t).collect())
    events, lost = plain([files[0], files[1] + files[2], files[3]], 6)
    assert shown("events") == events and shown("late") == lost and lost
    # A batch that is run again, as after a loss between the commit and the checkpoint, adds nothing.
    version = store.version()
    L.keep_batch(store, store.read("events"), (ck, 2), "id", "at", 6 * HOUR)
    assert store.version() == version
    assert store.read("recent").count() < len(events) / 2


def test_rows_without_key_or_time_are_kept_apart(spark, tmp_path):
    store = AtomicStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(None, datetime.datetime(2024, 1, 1), "a"), (1, None, "b"), (2, datetime.datetime(2024, 1, 1), "c")], "id long, at timestamp, event string")
    L.keep_batch(store, rows, ("x", 0), "id", "at", HOUR)
    L.keep_batch(store, rows.where("false"), ("x", 1), "id", "at", HOUR)
    assert [r["event"] for r in store.read("events").collect()] == ["c"] and sorted(r["event"] for r in store.read("late").collect()) == ["a", "b"]


def test_answers_meet_their_timing(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    answers = [(1, at(0), "x"), (2, at(0.5), "y"), (3, at(3), "z"), (99, at(30), "end")]
    timings = [(1, at(0.2), 1.5), (2, at(2.5), 9.0), (3, at(3.9), 2.5), (98, at(30), 0.0)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    a_schema, t_schema = "answer long, at timestamp, text string", "answer long, timed_at timestamp, total double"
    streams = []
    for name, rows, schema in (("a", answers, a_schema), ("t", timings, t_schema)):
        for r in rows:
            made([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(made([], schema).schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / name)))
    q = L.timed_answers(*streams).writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    shown = lambda df: sorted((r["answer"], r["total"]) for r in df.where("answer < 90").collect())
    assert shown(spark.table("timed")) == [(1, 1.5), (2, None), (3, 2.5)] == shown(L.timed_answers(made(answers, a_schema), made(timings, t_schema)))


def test_a_stream_tells_events_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, datetime.datetime(2024, 1, 1, i)) for i in range(6)], "id long, at timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = L.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), "id", "at", "1 day").groupBy().count().writeStream.format("memory").queryName("once").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").first()["count"] == 3
