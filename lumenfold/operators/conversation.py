"""Clarifications: a question waits for one missing field, and a reply fills it, changes the subject, or lets it expire.

Replies are read as columns first (place, institution, status, purpose, date); only the state itself, one small row a
conversation, is folded in Python. The same step serves batches and streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.functions.text import fold_hyphen
from lumenfold.streaming.stateful import EXPIRY, is_new_question

FIELDS = ("location", "entity", "user_status", "purpose", "date")
# What readers call themselves, and yes and no.
STATUS = {
    "student": "student", "etudiant": "student", "etudiante": "student", "worker": "worker", "employee": "worker", "salarie": "worker", "salariee": "worker", "travailleur": "worker", "visitor": "visitor", "visiteur": "visitor",
    "tourist": "visitor", "refugee": "refugee", "refugie": "refugee", "refugiee": "refugee", "intern": "intern", "stagiaire": "intern", "researcher": "researcher", "chercheur": "researcher", "family": "family", "famille": "family",
    "spouse": "family", "conjoint": "family",
}
YES = r"(?i)^\W*(yes|yeah|yep|yup|correct|right|i am|oui|si|exact|exactement|tout a fait|tout à fait)\b"
NO = r"(?i)^\W*(no|nope|not|i'm not|i am not|non|pas|ne pas)\b"


def status_of(message: Column) -> Column:
    """What a reply says of its writer's status: a word for it, yes or no; null where it says none."""
    text = F.trim(F.coalesce(message, F.lit("")))
    words = F.regexp_extract_all(fold_hyphen(text), F.lit(r"([\w]+)"), 1)
    table = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    # The first of the table that the reply holds.
    first = F.get(F.filter(F.array(*[F.lit(w) for w in STATUS]), lambda w: F.array_contains(words, w)), 0)
    return F.coalesce(F.try_element_at(table, first), F.when(text.rlike(YES), "yes").when(text.rlike(NO), "no"))


def date_of(message: Column) -> Column:
    """A reply that names a date or a year, as it was written; null for others."""
    text = F.trim(F.coalesce(message, F.lit("")))
    return F.when(text.rlike(r"\b(19|20)\d{2}\b"), text)


class Task:
    """A question that waits: plain values only, so that it fits a state store."""

    def __init__(self, raw: str | None = None):
        self.question, self.field, self.waited, self.filled, self.context = "", "", 0, [], {}
        if raw:
            self.__dict__.update(json.loads(raw))

    def dump(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    def resumed(self) -> str:
        """The question as it was; an institution is added, as it changes what is asked, a place isn't, as it only changes who answers."""
        q, name = self.question.strip(), self.context.get("entity", "")
        return f"{q} ({name})" if name and name.lower() not in q.lower() else q


def step(task: Task | None, kind: str, message: str, readings: dict[str, str | None]) -> tuple[Task | None, str, str]:
    """The next task, what happened, and the question to go on with.

    ``kind`` is ``ask:<field>`` where the engine asks for a field (``message`` is then the question that waits), else a reader's
    turn. A field that was filled is never asked for again; a task ends when it is filled, dropped for another question,
    or unanswered ``EXPIRY`` times.
    """
    message = message or ""
    if kind.startswith("ask:"):
        field = kind[4:]
        if task and field in task.filled:
            return task, "refused", task.resumed()
        new = Task()
        new.question, new.field = (task.question if task and not message else message), field
        if task and task.question == new.question:
            new.filled, new.context = task.filled, task.context
        return new, "opened", new.question
    if task is None or not task.field:
        return None, "idle", message
    if is_new_question(message):
        return None, "switched", message
    if value := readings.get(task.field):
        task.context[task.field] = value
        task.filled, task.field, task.waited = sorted({*task.filled, task.field}), "", 0
        return task, "resumed", task.resumed()
    task.waited += 1
    return (None, "expired", message) if task.waited >= EXPIRY else (task, "waiting", task.resumed())


OUT = "conversation string, turn long, outcome string, question string, field string, waited int, filled array<string>, context map<string,string>"
NAMES = ["conversation", "turn", "outcome", "question", "field", "waited", "filled", "context"]


def _rows(rows: pd.DataFrame, task: Task | None) -> tuple[pd.DataFrame, Task | None]:
    out = []
    for r in rows.sort_values("turn").itertuples(index=False):
        was = task.field if task else ""
        task, outcome, question = step(task, r.kind, r.message, {f: getattr(r, f) for f in FIELDS})
        field = (task.field if task else "") or was
        out.append((r.conversation, int(r.turn), outcome, question, field, task.waited if task else 0, list(task.filled) if task else [], dict(task.context) if task else {}))
    return pd.DataFrame(out, columns=NAMES), task


def _whole(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, turns in zip(b.column("conversation").to_pylist(), b.column("turns").to_pylist(), strict=True):
                task = None
                for r in turns:
                    was = task.field if task else ""
                    task, outcome, question = step(task, r["kind"], r["message"], r)
                    held = task or Task()
                    out.append((name, r["turn"], outcome, question, held.field or was, held.waited, list(held.filled), list(held.context.items())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def dialogue(turns: DataFrame) -> DataFrame:
    """What each turn did. ``turns`` has (conversation, turn, kind, message) and a column for each field with what the message says of it (null: nothing).

    A conversation's turns become one row, so that Python meets batches of conversations instead of being called for each.
    """
    one = F.struct("turn", "kind", "message", *FIELDS)
    whole = turns.groupBy("conversation").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return whole.mapInArrow(_whole(to_arrow_schema(T.StructType.fromDDL(OUT))), OUT)


def dialogue_stream(turns: DataFrame) -> DataFrame:
    """The same over a stream; the state is one task a conversation."""

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        task = Task(held.get[0]) if held.exists else None
        for rows in batches:
            out, task = _rows(rows, task)
            yield out
        if task is None:
            if held.exists:
                held.remove()
        else:
            held.update((task.dump(),))

    return turns.select("conversation", "turn", "kind", "message", *FIELDS).groupBy("conversation").applyInPandasWithState(run, OUT, "task string", "append", GroupStateTimeout.NoTimeout)


def retrieval_context(outcomes: DataFrame, departments: DataFrame) -> DataFrame:
    """``outcomes`` with what goes into retrieval beside the question: purpose, status, date, institution, and the place that the filled location stands for, if a département by code or name."""
    from lumenfold.operators.places import department_of

    of = lambda f: F.coalesce(F.try_element_at("context", F.lit(f)), F.lit(""))
    rows = outcomes.withColumns({"purpose": of("purpose"), "user_status": of("user_status"), "date": of("date"), "institution": of("entity"), "location": of("location"), "country": F.lit("France")})
    return department_of(rows, "location", departments)
