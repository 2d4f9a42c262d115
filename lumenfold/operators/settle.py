"""Chains of decisions as one plan each: whether gathered evidence answers a question, and what becomes of a report.

What a model said is a column; a row without a reply is one that no model was asked about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import decisions as D
from lumenfold.sources.atomic import AtomicStore

MOST, KEEP = 4000, 3000  # verdicts that the cache holds, and how many stay when it holds more


def settle(decisions: DataFrame, cache: DataFrame, replies: DataFrame) -> DataFrame:
    """One row a query: what was decided, by which stage, and what it cost.

    ``decisions`` has (query, question, chunks, should_refuse, verdict, detail), the verdict being what the evidence alone says (REFUSE,
    ANSWER or ASK_MODEL); ``cache`` (key, refuse, detail, said), one row a key; ``replies`` (query, reply, error, rate_limited). The first that can decides:
    the gate, which has refused or let nothing through; the evidence; a verdict on the same question and chunks that is remembered; a model. A model
    that can't be asked, or whose reply can't be read, refuses nothing. Only what a model said readably is worth remembering (``learned``).
    """
    rows = decisions.withColumn("key", D.verdict_key(F.col("question"), F.col("chunks")))
    rows = rows.join(cache.select("key", F.col("refuse").alias("_refuse"), F.col("detail").alias("_why"), F.col("said").alias("_said"), F.lit(True).alias("_held")), "key", "left")
    rows = rows.join(replies.select("query", "reply", "error", "rate_limited"), "query", "left")
    closed, asks = F.col("should_refuse") | (F.size("chunks") <= 0), F.col("verdict") == "ASK_MODEL"
    said, failed = D.read_verdict(F.col("reply")), F.coalesce(F.col("error"), F.lit("")) != ""
    stage = F.when(closed, "gate").when(~asks, "evidence").when(F.col("_held"), "cache").when(failed, "outage").when(said.isNull(), "unreadable").otherwise("model")
    rows = rows.withColumns({"stage": stage, "_yes": said, "_rest": F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("reply", F.lit("")), r"^[^\n]*\n?", ""), r"\s+", " "))})
    at = lambda name: F.col("stage") == name
    refused = (
        F.when(at("gate"), F.col("should_refuse")).when(at("evidence"), F.col("verdict") == "REFUSE").when(at("cache"), F.coalesce("_refuse", F.lit(False))).when(at("model"), ~F.col("_yes")).otherwise(False)
    )
    note = (
        F.when(at("evidence") & (F.col("verdict") == "ANSWER"), F.concat(F.lit("settled without a model: "), F.coalesce("detail", F.lit(""))))
        .when(at("cache"), F.coalesce("_said", F.lit("")))
        .when(at("outage"), F.concat(F.lit("unavailable ("), "error", F.lit(")")))
        .when(at("unreadable"), F.concat(F.lit("unreadable reply — kept: "), F.substring(F.coalesce("reply", F.lit("")), 1, 180)))
        .when(at("model"), F.substring("reply", 1, 300))
        .otherwise("")
    )
    by = F.when(refused & at("evidence"), "evidence").when(refused & at("gate"), "gate").when(refused, "answerability")
    called = at("outage") | at("unreadable") | at("model")
    return rows.select(
        "query", "key", "stage", refused.alias("should_refuse"), by.alias("refused_by"), note.alias("said"), F.when(at("cache"), "_why").alias("remembered"), F.when(at("model") & refused, F.col("_rest")).alias("reason"),
        called.cast("int").alias("model_calls"), at("cache").alias("cached"), F.coalesce(at("outage") & F.col("rate_limited"), F.lit(False)).alias("provider_limited"), at("model").alias("learned"),
    )


def remember(store: AtomicStore, settled: DataFrame, at: Column) -> int:
    """Adds what models said to the cache, in one commit. A cache of over MOST verdicts keeps the KEEP latest."""
    new = settled.where("learned").groupBy("key").agg(F.max_by(F.struct(F.col("should_refuse").alias("refuse"), F.coalesce("reason", F.lit("")).alias("detail"), "said", at.alias("at")), at).alias("v")).select("key", "v.*")
    held = store.read("verdicts", schema="key string, refuse boolean, detail string, said string, at timestamp")
    both = held.join(new.select("key"), "key", "left_anti").unionByName(new)
    whole = store.overwrite("verdicts", both)
    if store.staged(whole).count() > MOST:
        whole = store.overwrite("verdicts", store.staged(whole).orderBy(F.desc("at"), "key").limit(KEEP))
    return store.commit(whole)


def cached(store: AtomicStore) -> DataFrame:
    return store.read("verdicts", schema="key string, refuse boolean, detail string, said string, at timestamp").drop("at")


def triaged(reports: DataFrame, replies: DataFrame) -> DataFrame:
    """Reports with what triage made of them: (report, ...) joined to (report, reply, error).

    A report whose triage failed is still a report: it keeps its words, says why, and is untriaged.
    """
    t, both = D.read_triage(F.col("reply")), reports.join(replies.select("report", "reply", F.col("error").alias("_error")), "report", "left")
    failed = F.coalesce(F.col("_error"), F.lit("")) != ""
    why = F.when(failed, F.col("_error")).otherwise(D.triage_error(F.col("reply")))
    text = lambda c: F.when(why.isNull(), F.trim(F.coalesce(t[c], F.lit("")))).otherwise("")
    level = lambda c: F.when(text(c) == "", "untriaged").otherwise(text(c))
    notes = F.when(~failed & why.isNotNull(), F.substring(F.trim(F.coalesce("reply", F.lit(""))), 1, 500)).otherwise(text("notes"))
    return both.withColumns({"title": text("title"), "severity": level("severity"), "category": level("category"), "notes": notes, "triage_error": why}).drop("reply", "_error")


def submit(store: AtomicStore, reports: DataFrame, replies: DataFrame, delivered: DataFrame) -> DataFrame:
    """Reports from their words to their record: trimmed, triaged, numbered by day, stored, then told to somebody, and stored with how that went.

    ``reports`` has (report, at, raw_text), ``delivered`` (report, sent, problem): what the mail's transport said. The record is in the store
    before delivery counts, so a report whose delivery failed is there and says so. Returns the records of this submission.
    """
    held = store.read("reports", schema="id string")
    taken = held.where(F.col("id").rlike(r"^BUG-\d{8}-\d+$")).select(F.substring("id", 5, 8).alias("day"), F.regexp_extract("id", r"-(\d+)$", 1).cast("int").alias("n")).groupBy("day").agg(F.max("n").alias("_taken"))
    rows = triaged(reports.withColumn("raw_text", F.trim("raw_text")), replies).withColumn("day", F.date_format("at", "yyyyMMdd")).join(taken, "day", "left")
    n = F.row_number().over(Window.partitionBy("day").orderBy("at", "report")) + F.coalesce("_taken", F.lit(0))
    rows = rows.withColumn("id", F.concat(F.lit("BUG-"), "day", F.lit("-"), F.format_string("%03d", n))).drop("day", "_taken")
    record = rows.select("id", "report", "at", F.lit("open").alias("status"), "severity", "category", "title", "raw_text", "notes", "triage_error", F.lit(False).alias("emailed"), F.lit("").alias("email_error"))
    first = store.upsert("reports", record, ["id"], 16)
    store.commit(first)
    mine = store.staged(first).join(reports.select("report"), "report", "left_semi")
    told = mine.drop("emailed", "email_error").join(delivered.select("report", "sent", "problem"), "report", "left")
    told = told.select(*[c for c in record.columns if c not in ("emailed", "email_error")], F.coalesce("sent", F.lit(False)).alias("emailed"), F.coalesce("problem", F.lit("")).alias("email_error"))
    second = store.upsert("reports", told, ["id"])
    store.commit(second)
    return store.read("reports").join(mine.select("id"), "id", "left_semi")


# ---------------------------------------------------------------- addresses, labels and results


def host_name(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def same_site(a: Column, b: Column) -> Column:
    """Both addresses are of one host; two that have none are of one too."""
    return host_name(a) == host_name(b)


def is_official(url: Column, suffixes: tuple[str, ...] = (".gouv.fr",)) -> Column:
    """The host is one of the domains (given with a leading dot) or below one."""
    host = host_name(url)
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | (host == s.lstrip(".")) | F.endswith(host, F.lit(s))
    return hit


def scope_label(scope: Column, strings: dict[str, str]) -> Column:
    """A state of freshness in the reader's words; any other scope, such as a page's own text, as it is, with spaces for underscores."""
    known = F.create_map(*[x for k, v in strings.items() for x in (F.lit(k), F.lit(v))]) if strings else None
    plain = F.replace(scope, F.lit("_"), F.lit(" "))
    return plain if known is None else F.coalesce(F.try_element_at(known, F.concat(F.lit("scope_"), scope)), plain)


def write_results(store: AtomicStore, run: str, metrics: DataFrame, records: DataFrame, settings: DataFrame) -> int:
    """An evaluation's metrics, records and settings under its run, in one commit: no reader sees half a run."""
    tables = {"metrics": metrics, "records": records, "settings": settings}
    return store.commit(*[store.append(name, df.withColumn("run", F.lit(run))) for name, df in tables.items()])
