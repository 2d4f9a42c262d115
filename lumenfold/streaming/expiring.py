"""State that ends by itself: conversations that fall silent and incidents that nothing has confirmed for long.

State is typed (a value, a map by key), and a timer on event time ends it, so that a stream's state is bounded by what is open.
The same steps, in order of time, serve batches, and a batch tells the same as a stream however its rows were cut into micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators.conversation import FIELDS, Task, step

SILENCE = 30 * 60 * 1000  # milliseconds after which a conversation that waits is given up
QUIET = 3 * 24 * 3600 * 1000  # and after which an incident that nothing confirms lapses

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_on_disk(spark: SparkSession) -> None:
    """Typed state with timers needs a store that keeps it on disk; for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _millis(at: pd.Timestamp) -> int:
    return (at - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)


# ---------------------------------------------------------------- conversations

TURN_OUT = "conversation string, turn long, at timestamp, outcome string, question string, field string, context map<string,string>"
TURN_NAMES = ["conversation", "turn", "at", "outcome", "question", "field", "context"]


def _given_up(conversation: str, task: Task, due: int) -> tuple:
    return conversation, None, pd.Timestamp(due, unit="ms"), "silent", task.question, task.field, dict(task.context)


def _turns(conversation: str, rows: pd.DataFrame, task: Task | None, due: int | None, silence: int) -> tuple[list[tuple], Task | None, int | None]:
    """Moves a task by turns in order of time; one that waits past its time is given up before the turn that comes too late."""
    out = []
    for r in rows.sort_values(["at", "turn"]).itertuples(index=False):
        at = _millis(r.at)
        if task and due is not None and at > due:
            out.append(_given_up(conversation, task, due))
            task = None
        was = task.field if task else ""
        task, outcome, question = step(task, r.kind, r.message, {f: getattr(r, f) for f in FIELDS})
        out.append((conversation, int(r.turn), r.at, outcome, question, (task.field if task else "") or was, dict(task.context) if task else {}))
        due = at + silence if task and task.field else None
    return out, task, due


class Dialogue(StatefulProcessor):
    """One task a conversation: its question and course as a value, what it has learned as a map, and a timer while it waits."""

    def __init__(self, silence: int = SILENCE):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.course = handle.getValueState("course", "question string, field string, waited int, filled string, due long")
        self.context = handle.getMapState("context", "field string", "value string")

    def _held(self) -> tuple[Task | None, int | None]:
        if not self.course.exists():
            return None, None
        task = Task()
        task.question, task.field, task.waited, filled, due = self.course.get()
        task.filled = json.loads(filled)
        task.context = {k[0]: v[0] for k, v in self.context.iterator()}
        return task, (None if due < 0 else due)

    def _keep(self, task: Task | None, due: int | None) -> None:
        self.context.clear()
        if task is None:
            self.course.clear()
            return
        self.course.update((task.question, task.field, task.waited, json.dumps(task.filled), -1 if due is None else due))
        for k, v in task.context.items():
            self.context.updateValue((k,), (v,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        task, due = self._held()
        before = due
        out, task, due = _turns(key[0], pd.concat(list(rows)), task, due, self.silence)
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        self._keep(task, due)
        yield pd.DataFrame(out, columns=TURN_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        task, due = self._held()
        if task and due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            self._keep(None, None)
            yield pd.DataFrame([_given_up(key[0], task, due)], columns=TURN_NAMES)

    def close(self) -> None:
        pass


def dialogue_stream(turns: DataFrame, silence: int = SILENCE, late: str = "10 minutes") -> DataFrame:
    """What each turn did, and a row ``silent`` for a conversation that waited past its time. ``turns`` is a stream of (conversation, turn, at, kind, message) and the fields."""
    rows = turns.select("conversation", "turn", "at", "kind", "message", *FIELDS).withWatermark("at", late)
    return rows.groupBy("conversation").transformWithStateInPandas(Dialogue(silence), TURN_OUT, "append", "EventTime")


def dialogue(turns: DataFrame, until: pd.Timestamp | None = None, silence: int = SILENCE) -> DataFrame:
    """The same over a table; what still waits is given up if its time has passed at ``until``."""
    end = None if until is None else _millis(until)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows["conversation"].iloc[0]
        out, task, due = _turns(name, rows, None, None, silence)
        if task and due is not None and end is not None and due < end:
            out.append(_given_up(name, task, due))
        return pd.DataFrame(out, columns=TURN_NAMES)

    return turns.select("conversation", "turn", "at", "kind", "message", *FIELDS).groupBy("conversation").applyInPandas(run, TURN_OUT)


# ---------------------------------------------------------------- incidents

INCIDENT_OUT = "source string, kind string, first_seen timestamp, last_seen timestamp, occurrence_count long, status string"
INCIDENT_NAMES = [x.split()[0] for x in INCIDENT_OUT.split(", ")]


class Incidents(StatefulProcessor):
    """The open incidents of a source as a map by kind; a failure opens or confirms one, a success ends all, and one that nothing confirms lapses."""

    def __init__(self, quiet: int = QUIET):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "kind string", "first long, last long, n long")

    def _ended(self, key, held: dict, kinds: list[str], status: str) -> list[tuple]:
        return [(key[0], k, *(pd.Timestamp(t, unit="ms") for t in held[k][:2]), held[k][2], status) for k in kinds]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        before, out = {last + self.quiet for _, last, _ in held.values()}, []
        for r in pd.concat(list(rows)).sort_values(["at", "failed"], kind="stable").itertuples(index=False):
            at = _millis(r.at)
            lapsed = sorted(k for k, v in held.items() if at > v[1] + self.quiet)
            out += self._ended(key, held, lapsed, "lapsed")
            for k in lapsed:
                del held[k]
            if r.failed:
                first, _, n = held.get(r.kind, (at, at, 0))
                held[r.kind] = (first, at, n + 1)
            else:
                out += self._ended(key, held, sorted(held), "resolved")
                held.clear()
        self.open.clear()
        for k, v in held.items():
            self.open.updateValue((k,), v)
        due = {last + self.quiet for _, last, _ in held.values()}
        for t in before - due:
            self.handle.deleteTimer(t)
        for t in due - before:
            self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame(out, columns=INCIDENT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        lapsed = sorted(k for k, v in held.items() if v[1] + self.quiet <= expiredTimerInfo.getExpiryTimeInMs())
        for k in lapsed:
            self.open.removeKey((k,))
        if lapsed:
            yield pd.DataFrame(self._ended(key, held, lapsed, "lapsed"), columns=INCIDENT_NAMES)

    def close(self) -> None:
        pass


def incident_stream(events: DataFrame, quiet: int = QUIET, late: str = "1 hour") -> DataFrame:
    """Incidents as they end, over a stream of (source, kind, at, failed)."""
    rows = events.select("source", "kind", "at", "failed").withWatermark("at", late)
    return rows.groupBy("source").transformWithStateInPandas(Incidents(quiet), INCIDENT_OUT, "append", "EventTime")


def ended_incidents(events: DataFrame, until: str, quiet: int = QUIET) -> DataFrame:
    """The same over a table, as windows: incidents that were resolved, or that had lapsed at ``until``. One still open isn't told."""
    ms = F.unix_millis("at")
    line = Window.partitionBy("source").orderBy(ms, "failed")
    good = events.withColumns({"_ms": ms, "_round": F.coalesce(F.count_if(~F.col("failed")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # The success that ends a round, and each kind's failures within the round, parted where nothing confirmed them for long.
    over = good.where("not failed").select("source", "_round", F.col("_ms").alias("_over"))
    one = Window.partitionBy("source", "_round", "kind").orderBy("_ms")
    apart = F.coalesce((F.col("_ms") > F.lag("_ms").over(one) + quiet).cast("int"), F.lit(0))
    bad = good.where("failed").withColumn("_apart", apart).withColumn("_part", F.sum("_apart").over(one))
    rows = bad.groupBy("source", "_round", "kind", "_part").agg(F.min("_ms").alias("first"), F.max("_ms").alias("last"), F.count("*").alias("n"))
    end = F.unix_millis(F.lit(until).cast("timestamp"))
    # What was confirmed again later had lapsed before; the last part of a round is resolved if its success came in time.
    last = F.col("_part") == F.max("_part").over(Window.partitionBy("source", "_round", "kind"))
    told = rows.withColumn("_last", last).join(over, ["source", "_round"], "left")
    status = F.when(F.col("_last") & (F.col("_over") <= F.col("last") + quiet), "resolved").when(~F.col("_last") | F.col("_over").isNotNull() | (F.col("last") + quiet < end), "lapsed")
    told = told.withColumn("status", status)
    return told.where("status is not null").select("source", "kind", F.timestamp_millis("first").alias("first_seen"), F.timestamp_millis("last").alias("last_seen"), F.col("n").alias("occurrence_count"), "status")
