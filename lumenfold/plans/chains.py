"""Queries over chains of decisions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import claimcheck as V
from lumenfold.operators import ingest as I
from lumenfold.operators import settle as C
from lumenfold.plans.operations import JUDGED, drafts
from lumenfold.plans.tables import table
from lumenfold.sources.atomic import AtomicStore, working_dir

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# By a customer's number: every 11th was refused by the gate, evidence settles two in five, every third of the rest is remembered, every fourth can't be asked, and replies differ.
@query("""WITH c AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 11 = 0 THEN 'gate' WHEN c_custkey % 5 < 2 THEN 'evidence' WHEN c_custkey % 3 = 0 THEN 'cache' WHEN c_custkey % 4 = 1 THEN 'outage' WHEN c_custkey % 7 = 3 THEN 'unreadable' ELSE 'model' END AS stage FROM customer)
 SELECT query, stage, CASE stage WHEN 'gate' THEN query % 2 = 0 WHEN 'evidence' THEN query % 5 = 0 WHEN 'cache' THEN query % 2 = 0 WHEN 'model' THEN query % 7 = 5 ELSE false END AS should_refuse,
 CASE WHEN stage = 'gate' AND query % 2 = 0 THEN 'gate' WHEN stage = 'evidence' AND query % 5 = 0 THEN 'evidence' WHEN stage = 'cache' AND query % 2 = 0 OR stage = 'model' AND query % 7 = 5 THEN 'answerability' END AS refused_by,
 CASE stage WHEN 'evidence' THEN CASE WHEN query % 5 = 1 THEN 'settled without a model: plain' ELSE '' END WHEN 'cache' THEN 'said before' WHEN 'outage' THEN 'unavailable (too many requests)' WHEN 'unreadable' THEN 'unreadable reply — kept: perhaps'
  WHEN 'model' THEN CASE WHEN query % 7 = 5 THEN concat('**NO**', chr(10), 'It is about', chr(10), 'something else.') ELSE 'Yes.' END ELSE '' END AS said,
 CASE WHEN stage = 'model' AND query % 7 = 5 THEN 'It is about something else.' END AS reason, (stage IN ('outage', 'unreadable', 'model'))::INT AS model_calls, stage = 'outage' AND query % 8 = 1 AS provider_limited FROM c""")
def answerability_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second gate as one plan (D2): the first of gate, evidence, cache and model that can decide, with the verdicts of another session in its store."""
    c, k = table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    question, chunks = F.concat(F.lit("Où est le dossier "), k.cast("string"), F.lit(" ?")), F.array(F.concat(F.lit("b"), k), F.lit("a"))
    closed = k % 11 == 0
    decisions = c.select(
        k.alias("query"), question.alias("question"), F.when(closed & (k % 2 == 1), F.array().cast("array<string>")).otherwise(chunks).alias("chunks"), (closed & (k % 2 == 0)).alias("should_refuse"),
        F.when(k % 5 == 0, "REFUSE").when(k % 5 == 1, "ANSWER").otherwise("ASK_MODEL").alias("verdict"), F.lit("plain").alias("detail"),
    )
    store = AtomicStore(spark, working_dir(spark, "verdicts"))
    again = F.concat(F.lit("ou est LE dossier "), k.cast("string"))  # the same question by its letters
    before = c.where("c_custkey % 3 = 0").select(C.D.verdict_key(again, F.array(F.lit("a"), F.concat(F.lit("b"), k))).alias("key"), (k % 2 == 0).alias("refuse"), F.lit("as before").alias("detail"), F.lit("said before").alias("said"))
    store.commit(store.append("verdicts", before.withColumn("at", F.lit("2024-01-01").cast("timestamp"))))
    no = "**NO**\nIt is about\nsomething else."
    replies = c.select(k.alias("query"), F.when(k % 7 == 3, "perhaps").when(k % 7 == 5, no).otherwise("Yes.").alias("reply"), F.when(k % 4 == 1, "too many requests").alias("error"), (k % 8 == 1).alias("rate_limited"))
    return C.settle(decisions, C.cached(store), replies).select("query", "stage", "should_refuse", "refused_by", "said", "reason", "model_calls", "provider_limited")


@query("""WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey % 4 AS r FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY k % 2, k) AS n FROM o)
 SELECT concat('BUG-', day, '-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END) AS id, k AS report, CASE r WHEN 0 THEN 'high' ELSE 'untriaged' END AS severity, CASE r WHEN 0 THEN concat('Report ', k) ELSE '' END AS title,
 CASE r WHEN 1 THEN 'the model did not return readable JSON' WHEN 2 THEN 'rate limit' WHEN 3 THEN 'the model did not return readable JSON' END AS triage_error, CASE r WHEN 1 THEN 'no idea' ELSE '' END AS notes, k % 3 = 0 AS emailed,
 CASE WHEN k % 3 = 1 THEN 'refused' ELSE '' END AS email_error FROM n""")
def report_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from their words to their record (D19), in two submissions: even orders before odd ones."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    reports = o.select(k.alias("report"), F.to_date("o_orderdate").cast("timestamp").alias("at"), F.lit("  it is broken ").alias("raw_text"))
    reply = F.when(k % 4 == 0, F.concat(F.lit('```json\n{"title": " Report '), k.cast("string"), F.lit('", "severity": "high", "unknown": 1}\n```'))).when(k % 4 == 1, "no idea")
    replies = o.select(k.alias("report"), reply.alias("reply"), F.when(k % 4 == 2, "rate limit").alias("error"))
    sent = o.where("o_orderkey % 3 < 2").select(k.alias("report"), (k % 3 == 0).alias("sent"), F.when(k % 3 == 1, "refused").alias("problem"))
    store = AtomicStore(spark, working_dir(spark, "reports"))
    for half in (0, 1):
        C.submit(store, reports.where(F.col("report") % 2 == half), replies, sent)
    return store.read("reports").select("id", "report", "severity", "title", "triage_error", "notes", "emailed", "email_error")


@query("""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host FROM pages), q AS (SELECT *, lag(host) OVER (ORDER BY page_id) AS before FROM p)
 SELECT page_id, coalesce(host = before, false) AS same, host = 'example.com' OR ends_with(host, '.example.com') OR ends_with(host, '.org') OR host = 'org' AS official,
 CASE page_id % 4 WHEN 0 THEN 'Frais' WHEN 1 THEN 'Périmé' WHEN 2 THEN 'not cached' ELSE 'Vous êtes étudiant' END AS scope FROM q""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same site as the page before (F27), official hosts (F4), and the label of a scope (H4)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    before = p.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    scope = F.element_at(F.array(*map(F.lit, ("fresh", "stale", "not_cached", "Vous êtes étudiant"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = p.join(before, "page_id", "left")
    label = C.scope_label(scope, {"scope_fresh": "Frais", "scope_stale": "Périmé"})
    return rows.select("page_id", F.coalesce(C.same_site(F.col("url"), F.col("before")) & F.col("before").isNotNull(), F.lit(False)).alias("same"), C.is_official(F.col("url"), (".example.com", ".org")).alias("official"), label.alias("scope"))


@query("""SELECT concat('run', o_orderkey % 3) AS run, count(*) AS records, round(sum(o_totalprice), 2) AS total, CAST(o_orderkey % 3 AS INT) AS k FROM orders GROUP BY 1, 4""")
def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three evaluation runs, each in one commit."""
    store, o = AtomicStore(spark, working_dir(spark, "results")), table(spark, sf_dir, "orders")
    for n in range(3):
        records = o.where(F.col("o_orderkey") % 3 == n).select("o_orderkey", "o_totalprice")
        C.write_results(store, f"run{n}", records.agg(F.sum("o_totalprice").alias("total")), records, spark.createDataFrame([(n,)], "k int"))
    counts = store.read("records").groupBy("run").agg(F.count("*").alias("records"))
    return counts.join(store.read("metrics"), "run").join(store.read("settings"), "run").select("run", "records", F.round("total", 2).alias("total"), "k")


@query(f"WITH {JUDGED} SELECT answer, claim_no, support, CASE WHEN support IN ('supported', 'not_checked') THEN 'kept' ELSE 'removed' END AS action FROM j")
def claim_verdicts_by_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against evidence by the cosine of sentence vectors (W9, J23): each different sentence is embedded once, in a store by hash."""
    store = AtomicStore(spark, working_dir(spark, "sentences"))
    judged = V.judge(*drafts(spark, sf_dir), vectors=(store, lambda df: I.embed(df, "text", "vector", 128)))
    return judged.select("answer", F.col("claim_no").cast("long").alias("claim_no"), "support", "action")


# One claim of each kind in an answer; customers differ in the day they ask for (before or after a rule begins) and in their place.
REPAIRS = (
    "The card is sent by post to your home address.", "Validate your VLS-TS online after you arrive in France at https://made-up.fr/x.", "Validate your VLS-TS online after you arrive in France on pôrtal.fr.",
    "The tax for this permit is 225 euros (some 300 dollars abroad).", "The counter fee is 40 euros for visitors.", "The tax for this permit is 225 euros on portal.fr.",
)
PORTAL = "Validate your VLS-TS online after you arrive in France.\nThe tax for this permit is 225 euros.\nWith effect from 2026-07-01 the card is sent by post to your home address."


@query("""WITH c AS (SELECT c_custkey AS answer, c_custkey % 3 = 0 AS early, c_custkey % 2 = 1 AS elsewhere FROM customer), k AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM c)
 SELECT answer, CAST(k + 1 AS BIGINT) AS claim_no, CASE WHEN k = 0 AND early OR k = 4 AND elsewhere THEN 'unsupported' ELSE 'supported' END AS support,
 CASE k WHEN 0 THEN CASE WHEN early THEN 'removed' ELSE 'kept' END WHEN 1 THEN 'url_removed' WHEN 2 THEN 'link_corrected' WHEN 3 THEN 'clause_removed' WHEN 4 THEN CASE WHEN elsewhere THEN 'removed' ELSE 'kept' END ELSE 'kept' END AS action,
 CASE k WHEN 0 THEN 'The card is sent by post to your home address.' WHEN 1 THEN 'Validate your VLS-TS online after you arrive in France.' WHEN 2 THEN 'Validate your VLS-TS online after you arrive in France on portal.fr.' WHEN 3 THEN 'The tax for this permit is 225 euros.'
  WHEN 4 THEN 'The counter fee is 40 euros for visitors.' ELSE 'The tax for this permit is 225 euros on portal.fr.' END AS final FROM k""")
def claim_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that aren't in force yet (F10), authorities of another place (F14), addresses that no evidence gives or that are misspelt (F19, X21), and asides."""
    c, k = table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    day = F.when(k % 3 == 0, "2026-06-15").otherwise("2026-09-15").cast("date")
    answers = c.select(k.alias("answer"), F.lit("\n".join(REPAIRS)).alias("text"), F.lit("What do I need?").alias("question"), day.alias("on"), F.when(k % 2 == 1, "Rhône").otherwise("Isère").alias("place"))
    page = lambda source, title, text, area: F.struct(*[F.lit(v).alias(n) for n, v in (("source_id", source), ("url", f"https://{source}.fr/"), ("canonical_url", f"https://{source}.fr/"), ("title", title), ("text", text), ("version_id", "v1"), ("area", area), ("is_local", area != ""))])
    pages = c.select(k.alias("answer"), F.explode(F.array(page("portal", "Newcomers", PORTAL, ""), page("counter", "Counter", "The counter fee is 40 euros for visitors.", "Isere"))).alias("p")).select("answer", "p.*")
    return V.judge(answers, pages).select("answer", F.col("claim_no").cast("long").alias("claim_no"), "support", "action", "final")
