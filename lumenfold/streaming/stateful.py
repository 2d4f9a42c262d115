"""Keyed state over events: incidents that open, accumulate and close, and clarifications that wait for a reply.

The same step functions serve streams (``applyInPandasWithState``) and, ordered by time, batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.functions.text import word_count
from lumenfold.operators.pages import compare
from lumenfold.operators.store import version_id
from lumenfold.sources.atomic import AtomicStore

EXPIRY = 3  # unanswered turns after which a clarification is given up
# Fixed value: words that start a different question.
PIVOT = re.compile(
    r"(?i)\b(actually|instead|forget that|never mind|nevermind|different "
    r"question|another question|new question|change of subject|"
    r"en fait|plutot|plutôt|autre question|laisse tomber|oubliez)\b"
)
ASKS = re.compile(r"(?i)\b(how|what|where|when|why|which|can i|do i|is there|comment|quoi|quel|quelle|ou|où|quand|pourquoi|est ce que)\b")


def is_new_question(message: str | None) -> bool:
    """A pivot in so many words, or a whole question: a short reply is nearly always an answer."""
    text = (message or "").strip()
    words = text.split()
    return bool(text) and bool(PIVOT.search(text) or (len(words) >= 5 and ASKS.search(text) and ("?" in text or len(words) >= 7)))


def clarify(state: tuple[str, str, int] | None, kind: str, message: str, answers: bool) -> tuple[tuple[str, str, int] | None, str]:
    """The next (question, field, turns waited), and what happened: opened, resumed, switched, waiting, expired or idle.

    ``kind`` is ``ask:<field>`` when the engine asks for a field, else a reader's message; ``answers`` tells whether a
    message fills that field.
    """
    if kind.startswith("ask:"):
        return (message, kind[4:], 0), "opened"
    if state is None:
        return None, "idle"
    if is_new_question(message):
        return None, "switched"
    if answers:
        return None, "resumed"
    question, field, waited = state
    return (None, "expired") if waited + 1 >= EXPIRY else ((question, field, waited + 1), "waiting")


CLARIFY_OUT = "conversation string, turn long, outcome string, question string, field string, waited int"
CLARIFY_STATE = "question string, field string, waited int"


def _clarify_rows(rows: pd.DataFrame, state: tuple[str, str, int] | None) -> tuple[list[tuple], tuple[str, str, int] | None]:
    out = []
    for r in rows.sort_values("turn").itertuples(index=False):
        before = state
        state, outcome = clarify(state, r.kind, r.message, bool(r.answers))
        about = state or before or (None, None, 0)
        out.append((r.conversation, int(r.turn), outcome, about[0], about[1], about[2]))
    return out, state


NAMES = [x.split()[0] for x in CLARIFY_OUT.split(", ")]


def clarifications(turns: DataFrame) -> DataFrame:
    """Outcomes of every turn (conversation, turn, kind, message, answers), each conversation by itself, in order of turn."""
    return turns.groupBy("conversation").applyInPandas(lambda rows: pd.DataFrame(_clarify_rows(rows, None)[0], columns=NAMES), CLARIFY_OUT)


def clarification_stream(turns: DataFrame) -> DataFrame:
    """The same over a stream; state is one open clarification a conversation."""

    def step(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else None
        for rows in batches:
            out, state = _clarify_rows(rows, state)
            yield pd.DataFrame(out, columns=NAMES)
        if state is None:
            if held.exists:
                held.remove()
        else:
            held.update(state)

    return turns.groupBy("conversation").applyInPandasWithState(step, CLARIFY_OUT, CLARIFY_STATE, "append", GroupStateTimeout.NoTimeout)


INCIDENT_OUT = "source string, kind string, first_seen timestamp, last_seen timestamp, occurrence_count long, current_status string"
INCIDENT_NAMES = [x.split()[0] for x in INCIDENT_OUT.split(", ")]
MICROS = pd.Timedelta(microseconds=1)


def incident_step(held: dict[str, list[int]], rows: pd.DataFrame) -> list[tuple]:
    """Moves the open incidents of one source (kind: first and last in microseconds, count) by rows (kind, at, failed), and tells each move."""
    out, epoch = [], pd.Timestamp(0)
    for r in rows.sort_values("at", kind="stable").itertuples(index=False):
        at = (r.at - epoch) // MICROS
        if r.failed:
            first, _, n = held.get(r.kind, (at, at, 0))
            held[r.kind] = [first, at, n + 1]
            moved, status = [r.kind], "open"
        else:  # a source that works again has no open incident of any kind
            moved, status = sorted(held), "resolved"
        out += [(k, epoch + held[k][0] * MICROS, epoch + held[k][1] * MICROS, held[k][2], status) for k in moved]
        if status == "resolved":
            held.clear()
    return out


def incident_stream(events: DataFrame) -> DataFrame:
    """Incidents of a stream (source, kind, at, failed), a row whenever one moves. A recovery closes all of its source, and the next failure starts anew; the state is a few kinds a source."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        for rows in batches:
            if out := incident_step(held, rows):
                yield pd.DataFrame([(key[0], *r) for r in out], columns=INCIDENT_NAMES)
        if held:
            state.update((json.dumps(held),))
        elif state.exists:
            state.remove()

    return events.groupBy("source").applyInPandasWithState(step, INCIDENT_OUT, "kinds string", "update", GroupStateTimeout.NoTimeout)


def log_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each kind in windows of a log, late ones within the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


VERSION = ["source_id", "url", "retrieved_at", "content_hash", "title", "text"]


def new_versions(fetches: DataFrame, last: DataFrame, least_words: int = 40) -> DataFrame:
    """The fetches that change their page, each with what changed since the version before it.

    What isn't usable, isn't later than the page's last version, or has the content of the version before it is left out. Only the
    last versions of pages in ``fetches`` are looked at.
    """
    usable = fetches.where((F.coalesce("title", F.lit("")) != "") & (word_count(F.col("text")) >= least_words))
    rows = usable.select(*VERSION, F.lit(True).alias("_new"))
    old = last.join(rows.select("source_id", "url").distinct(), ["source_id", "url"], "left_semi").select(*VERSION, F.lit(False).alias("_new"))
    line = Window.partitionBy("source_id", "url").orderBy("retrieved_at", "_new", "content_hash")
    before = {f"_{c}": F.lag(c).over(line) for c in ("content_hash", "title", "text", "retrieved_at")}
    late = F.col("retrieved_at") <= F.max(F.when(~F.col("_new"), F.col("retrieved_at"))).over(Window.partitionBy("source_id", "url"))
    rows = rows.unionByName(old).withColumn("_late", F.coalesce(late, F.lit(False))).where(~F.col("_new") | ~F.col("_late"))
    hash_before = F.lag("content_hash").over(line)
    kept = rows.withColumn("_hash", hash_before).where(~F.col("_new") | F.col("_hash").isNull() | (F.col("_hash") != F.col("content_hash")))
    changed = kept.withColumns(before).where("_new")  # the version before: a fetch without a change is none
    told = compare(changed, "_text", "text", "_title", "title").withColumn("version_id", version_id(F.col("retrieved_at"), F.col("content_hash")))
    previous = F.when(F.col("_content_hash").isNotNull(), version_id(F.col("_retrieved_at"), F.col("_content_hash")))
    return told.select(*VERSION, "version_id", previous.alias("previous_version"), "change_type", "severity", "affected_topics", "summary")


def store_batch(store: AtomicStore, fetches: DataFrame, batch: tuple[str, int], least_words: int = 40, buckets: int = 64) -> None:
    """Adds a batch's new versions to the history and moves the last versions, in one commit; a batch that is there already adds nothing.

    A batch reads the buckets of last versions that its pages lie in, never the history: what it reads doesn't grow with the batches before it.
    """
    if store.done(*batch):
        return
    pages = ["source_id", "url"]
    come = store.append("versions", new_versions(fetches, store.read("last", schema=_LAST), least_words), pages, buckets)
    newest = F.row_number().over(Window.partitionBy(*pages).orderBy(F.desc("retrieved_at"), F.desc("content_hash")))
    moved = store.staged(come).withColumn("_n", newest).where("_n = 1").select(*VERSION)
    store.commit(come, store.upsert("last", moved, pages, buckets), batch=batch)


_LAST = "source_id string, url string, retrieved_at timestamp, content_hash string, title string, text string"


def record_versions(spark: SparkSession, fetches: DataFrame, versions: str, checkpoint: str, least_words: int = 40):
    """A query that keeps page versions in the store at ``versions``. Batches come with (source_id, url, retrieved_at, content_hash, title, text)."""
    store = AtomicStore(spark, versions)
    return fetches.writeStream.foreachBatch(lambda rows, n: store_batch(store, rows, (checkpoint, n), least_words)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stored_versions(spark: SparkSession, versions: str) -> DataFrame:
    """The history of all pages, as last committed."""
    return AtomicStore(spark, versions).read("versions")
