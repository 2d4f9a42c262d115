"""Queries over the store of page versions, review queues and logs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import claims as C
from lumenfold.operators import decisions as D
from lumenfold.operators import pages as P
from lumenfold.operators import registry as G
from lumenfold.operators import reports as O
from lumenfold.operators import store as S
from lumenfold.operators import telemetry as T
from lumenfold.plans.pages import CHANGED, NOTICES, notices
from lumenfold.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The last version of each page is fetched anew against the one before it: every seventh fetch fails, every fifth page has nothing to read, and hashes repeat.
LAST = f"""{CHANGED}, w AS (SELECT c.*, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS back FROM c),
 f AS (SELECT page_id, version_id, source_id, retrieved_at, names, version_id % 7 = 0 AS failed, version_id % 5 = 0 AS empty, version_id % 11 = 0 AS same_hash, first_, same_, len(add_) = 0 AND len(rem_) = 0 AND NOT title_changed AS quiet, add_, rem_ FROM w WHERE back = 1),
 g AS (SELECT *, CASE WHEN failed THEN 'kept previous version' WHEN empty THEN 'refused: no usable content, previous version kept' WHEN same_hash AND NOT first_ THEN 'unchanged' WHEN first_ THEN 'activated' WHEN same_ THEN 'unchanged' WHEN quiet THEN 'activated' ELSE 'activated · derived caches invalidated' END AS action FROM f)"""


def fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    back = Window.partitionBy("page_id").orderBy(F.desc("retrieved_at"), F.desc("version_id"))
    n = notices(spark, sf_dir).withColumns({"back": F.row_number().over(back), "url": F.concat(F.lit("https://page/"), "page_id"), "hash": F.concat(F.lit("h"), "version_id")})
    failed, empty = F.col("version_id") % 7 == 0, F.col("version_id") % 5 == 0
    before = F.lead("hash").over(back)
    rows = n.withColumn("before", before)
    digest = F.when(F.col("version_id") % 11 == 0, F.coalesce("before", "hash")).otherwise(F.col("hash"))
    fetches = rows.where("back = 1").select(
        "source_id", "url", F.col("retrieved_at").cast("timestamp").alias("retrieved_at"), digest.alias("content_hash"), F.when(empty, "").otherwise(F.col("title")).alias("title"), F.when(~failed, F.col("text")).alias("text"),
        F.when(failed, "Read timed out").alias("error"), F.lit(200).alias("status"),
    )
    active = rows.where("back = 2").select("source_id", "url", F.col("version_id").cast("string").alias("version_id"), F.col("hash").alias("content_hash"), "title", "text")
    return fetches, active


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sync(*fetched(spark, sf_dir), least_words=5)


PAGE = "regexp_extract(url, '([0-9]+)$', 1)"


@query(f"""WITH {LAST} SELECT CAST(page_id AS VARCHAR) AS page, action, CASE WHEN failed THEN 'timeout' END AS incident, NOT failed AND NOT empty AS recovered, starts_with(action, 'activated') AS stored FROM g""")
def sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fetch does to the store."""
    return synced(spark, sf_dir).select(F.expr(PAGE).alias("page"), "action", "incident", "recovered", F.startswith("action", F.lit("activated")).alias("stored"))


@query(f"""WITH {LAST}, a AS (SELECT CAST(page_id AS VARCHAR) AS page FROM w WHERE back = 2) SELECT coalesce(a.page, CAST(g.page_id AS VARCHAR)) AS page, coalesce(starts_with(action, 'activated'), false) AS moved FROM a FULL JOIN g ON a.page = CAST(g.page_id AS VARCHAR) WHERE a.page IS NOT NULL OR starts_with(action, 'activated')""")
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which version answers after a sync, and whether that moved."""
    fetches, active = fetched(spark, sf_dir)
    after = S.activated(S.sync(fetches, active, least_words=5), active)
    return after.select(F.expr(PAGE).alias("page"), F.col("version_id").contains("Z-").alias("moved"))


@query(f"""WITH {LAST} SELECT CASE WHEN failed THEN 'sync.fetch_failed' WHEN empty THEN 'version.refused' WHEN action = 'unchanged' THEN 'version.unchanged' ELSE 'version.activated' END AS event, count(*) AS n FROM g GROUP BY 1
 UNION ALL SELECT 'cache.invalidated', count(*) FROM g WHERE contains(action, 'derived') HAVING count(*) > 0""")
def sync_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a sync writes to the audit log (S20, D15); those for review are counted apart."""
    return S.audit(synced(spark, sf_dir)).where("event <> 'source.change_needs_review'").groupBy("event").agg(F.count("*").alias("n"))


@query(f"""WITH {LAST} SELECT CAST(page_id AS VARCHAR) AS page, (SELECT count(*) FROM (SELECT DISTINCT unnest(add_) AS l) WHERE len(string_split(l, ' ')) >= 5 AND NOT starts_with(l, 'voir')) AS added FROM g WHERE contains(action, 'derived')""")
def sync_claims_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a substantive change adds."""
    fetches, active = fetched(spark, sf_dir)
    moved = S.claims_moved(S.sync(fetches, active, least_words=5), active)
    return moved.groupBy(F.expr(PAGE).alias("page")).agg(F.count_if(F.col("status") == "added").alias("added"))


@query(f"""WITH {LAST} SELECT CAST(page_id AS VARCHAR) AS page, 'open' AS review_status FROM g WHERE contains(action, 'derived') AND list_has_any(names, ['eligibility', 'deadline', 'fee', 'procedure', 'immigration_rule', 'required_document', 'application_portal', 'jurisdiction', 'student_rule', 'housing_rule', 'tax_rule', 'health_rule', 'employment_rule'])""")
def changes_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that someone has to look at."""
    fetches, active = fetched(spark, sf_dir)
    s = S.sync(fetches, active, least_words=5)
    return S.review_changes(s, S.claims_moved(s, active)).select(F.expr(PAGE).alias("page"), "review_status")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('BEFORE: a', chr(10), 'BEFORE: b', chr(10), 'AFTER:  (the requirement is no longer stated)') WHEN 2 THEN concat('BEFORE: (no matching requirement was stated)', chr(10), 'AFTER:  c') ELSE concat('BEFORE: a', chr(10), 'BEFORE: b', chr(10), 'AFTER:  c') END AS told FROM part""")
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page said and says."""
    k = F.col("p_partkey") % 4
    none = F.array().cast("array<string>")
    gone, come = F.when(k % 2 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(none), F.when(k >= 2, F.array(F.lit("c"))).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", P.before_after(gone, come).alias("told"))


@query("""SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'parser_failure' WHEN 2 THEN 'healthy_rendered' ELSE 'healthy' END AS health, count(*) AS n FROM events GROUP BY ALL""")
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health that one look at a source finds."""
    k = F.col("event_id") % 4
    refused = D.refusal(F.when(k == 0, "refused: redirect to https://perfdrive.example/x"))["health"]
    e = table(spark, sf_dir, "events").select("user_id", G.check(k != 0, refused, k >= 2, k == 2).alias("health"))
    return e.groupBy("user_id", "health").agg(F.count("*").alias("n"))


@query("""SELECT url, url_key, retrieved FROM (SELECT concat('u', user_id) AS url, sha256(concat('u', user_id))[1:24] AS url_key, epoch_us(max(ts)) AS retrieved FROM events WHERE event_type <> 'error' GROUP BY user_id) WHERE TIMESTAMP '2024-01-30' - make_timestamp(retrieved) <= INTERVAL 86400 SECOND""")
def fetch_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fetches that are fresh enough to use."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").cast("timestamp").alias("retrieved_at"), (F.col("event_type") != "error").alias("ok"))
    return G.cached(e, F.lit("2024-01-30").cast("timestamp"), 86400).select("url", "url_key", F.unix_micros("retrieved_at").alias("retrieved"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'open' ELSE 'in_progress' END AS status FROM orders""")
def archived_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved reports go to the archive."""
    r = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS id", "CASE o_orderkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' ELSE 'in_progress' END AS status")
    return S.listing(S.archive_resolved(r), "id", "status")


@query("""WITH t AS (SELECT DISTINCT 1 + o_orderkey % 40 AS n FROM orders WHERE o_orderkey % 40 <> 20), c AS (SELECT count(*) AS c FROM t) SELECT '20240501' AS day, concat('BUG-20240501-', lpad(CAST(min(x) AS VARCHAR), 3, '0')) AS next_id FROM (SELECT unnest(range(c + 1, 2 * c + 2)) AS x FROM c) WHERE x NOT IN (SELECT n FROM t)""")
def next_report_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest free number of a day's reports."""
    r = table(spark, sf_dir, "orders").where("o_orderkey % 40 <> 20").selectExpr("concat('BUG-20240501-', lpad(CAST(1 + o_orderkey % 40 AS STRING), 3, '0')) AS id")
    return S.free_id(r, F.lit("2024-05-01").cast("date"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY event_type""")
def snapshots_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the last days."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return S.within_days(e, "at", F.lit("2024-01-30").cast("timestamp"), 7).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {NOTICES}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS k FROM n) SELECT page_id, version_id FROM r WHERE k = 1""")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest stored version of each page."""
    n = notices(spark, sf_dir).withColumn("url", F.col("page_id"))
    return S.latest_versions(n.withColumn("source_id", F.lit("s"))).select("page_id", "version_id")


# ------------------------------------------------------------------ small accessors of answers, reports and texts

CLASSED = "CASE c_custkey % 4 WHEN 0 THEN 'What is a visa?' WHEN 1 THEN 'How do I renew it?' WHEN 2 THEN 'How do I apply and what is the deadline?' ELSE 'Tell me of it' END"


@query("""WITH a AS (SELECT c_custkey, c_custkey % 4 AS k, 1 + c_custkey % 350 AS words FROM customer), b AS (SELECT *, CASE k WHEN 0 THEN 'micro' WHEN 1 THEN 'procedural' WHEN 2 THEN 'complex' ELSE 'standard' END AS class, CASE k WHEN 0 THEN 60 WHEN 1 THEN 180 WHEN 2 THEN 300 ELSE 120 END AS ceiling FROM a)
 SELECT c_custkey, class, words, words > ceiling AS over, concat(words, ' words, ', CASE WHEN words > ceiling THEN 'over' ELSE 'within' END, ' the ', class, ' ceiling of ', ceiling) AS told FROM b""")
def answer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against the length that their questions deserve (X11, H7)."""
    answer = F.array_join(F.array_repeat(F.lit("w"), (F.col("c_custkey") % 350 + 1).cast("int")), " ")
    check = X.length_check(F.expr(CLASSED), answer)
    return table(spark, sf_dir, "customer").select("c_custkey", check.alias("l")).select("c_custkey", F.col("l.answer_class").alias("class"), F.col("l.words").cast("long").alias("words"), "l.over", F.col("l.told").alias("told"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS refused, CASE o_orderkey % 3 WHEN 0 THEN 'Limit hit, 292s left. See' ELSE 'Rate limit of' END AS safe FROM orders""")
def reader_safe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that say they can't answer, and errors without account details."""
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "The pages DON'T COVER this.").when(k == 1, "Ces pages ne précisent pas cela.").otherwise("It takes two months.")
    error = F.when(k == 0, "Limit hit,  292s left. See https://x.y/z org_abc123").otherwise("Rate limit of req_99 \n in organization `org_Z9` Need more tokens? Upgrade\nnow")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.says_refusal(said).alias("refused"), D.reader_safe(error).alias("safe"))


@query("""WITH h AS (SELECT o_custkey AS query, o_orderkey AS doc, (o_orderkey % 97) / 100.0 AS s FROM orders), p AS (SELECT *, s >= 0.5 AS passed FROM h)
 SELECT query, round(coalesce(max(s) FILTER (passed), max(s))::DOUBLE, 6) AS best_score, count(*) AS candidates, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY passed DESC, doc) AS in_order FROM p GROUP BY query""")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score and all candidates of a gate decision (H1)."""
    from lumenfold.operators import retrieval as R

    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS query", "o_orderkey AS doc", "CAST((o_orderkey % 97) / 100.0 AS DOUBLE) AS dense_score")
    return R.gate_summary(R.gate(h, 0.5), "doc").select("query", F.round("best_score", 6).alias("best_score"), F.size("candidates").cast("long").alias("candidates"), F.array_join("candidates", ",").alias("in_order"))


@query("""WITH r AS (SELECT l_orderkey AS q, l_linenumber AS n, l_partkey % 5 AS a, l_suppkey % 5 AS b, l_discount AS s, l_partkey AS pk, l_suppkey AS sk FROM lineitem),
 k AS (SELECT q, list(a ORDER BY n, pk, sk) AS a, list(b ORDER BY n, pk, sk) AS b, max(s) AS best FROM r GROUP BY q), t AS (SELECT q, q % 5 AS segment, list_sort(a[1:3]) = list_sort(b[1:3]) AS same, q % 10 = 0 AS expects, q % 3 = 0 AS refused, best FROM k)
 SELECT segment, count(*) AS n, count(*) FILTER (same) AS agree, count(*) FILTER (refused) AS refusals, count(*) FILTER (expects AND refused) AS rightly, count(*) FILTER (NOT expects AND refused) AS wrongly, round(avg(best), 6) AS mean_best FROM t GROUP BY segment""")
def eval_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement and refusals by segment."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS q", "l_linenumber AS n", "l_partkey % 5 AS a", "l_suppkey % 5 AS b", "l_discount AS s", "l_partkey AS pk", "l_suppkey AS sk")
    ranked = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", "pk", "sk", c))), lambda x: x[c])
    q = li.groupBy("q").agg(ranked("a").alias("en"), ranked("b").alias("fr"), F.max("s").alias("best")).withColumns({"segment": F.col("q") % 5, "expects_refusal": F.col("q") % 10 == 0, "refused": F.col("q") % 3 == 0})
    return T.by_segment(q).withColumn("mean_best", F.round("mean_best", 6))


@query("""WITH k AS (SELECT l_orderkey AS q, max(l_discount * 10) AS best FROM lineitem GROUP BY 1), s AS (SELECT list(best ORDER BY best) AS v, count(*) AS n FROM k WHERE q % 10 <> 0), m AS (SELECT max(best) AS most FROM k WHERE q % 10 = 0)
 SELECT round(v[1], 6) AS least, round(v[n // 10 + 1], 6) AS p10, round((v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2, 6) AS median, round(v[n], 6) AS most, coalesce(most < v[1], false) AS separable FROM s, m""")
def gate_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores of questions that can be answered, and whether one threshold parts them from those that can't."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q")).agg(F.max(F.col("l_discount") * 10).alias("best")).withColumn("expects_refusal", F.col("q") % 10 == 0)
    out = T.calibration(q, "best", "expects_refusal")
    return out.select(*[F.round(c, 6).alias(c) for c in ("least", "p10", "median", "most")], "separable")


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS k, concat('p', o_orderkey % 6) AS page, (o_orderkey % 89) / 100.0 AS s FROM orders), f AS (SELECT q, page, min(k) AS k FROM h GROUP BY ALL)
 SELECT q, string_agg(page, ',' ORDER BY k) AS pages, round((SELECT max(s) FROM h WHERE h.q = f.q)::DOUBLE, 4) AS best_score FROM f GROUP BY q""")
def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question retrieved: its pages in order, each once, and the best score."""
    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS q", "o_orderkey AS rank", "concat('p', o_orderkey % 6) AS page", "CAST((o_orderkey % 89) / 100.0 AS DOUBLE) AS score")
    return T.retrieval_records(h, "q", "rank", "page", "score").select("q", F.array_join("pages", ",").alias("pages"), "best_score")


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'residence permit renewal, VLS-TS validation' WHEN 1 THEN 'visa extension' ELSE '' END AS label, CASE n_nationkey % 3 WHEN 2 THEN 'What?' ELSE concat('What? term', n_nationkey) END AS expanded, n_nationkey % 2 = 0 AS sure FROM nation""")
def query_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedures of a question by label, its glossary expansion, and whether its language is sure."""
    from lumenfold.functions.facts import with_facts
    from lumenfold.operators.lookup import expand, find_terms

    n = table(spark, sf_dir, "nation").withColumn("asked", F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'Renew or validate my visa' WHEN 1 THEN 'Extend my stay' ELSE 'Anything' END"))
    n = with_facts(n, "asked").withColumns({"label": O.procedure_label(F.col("f.procedures")), "text": F.lit("What?"), "says": F.when(F.col("n_nationkey") % 3 < 2, F.concat(F.lit("the long alias "), "n_nationkey")).otherwise("none")})
    found = find_terms(n, "n_nationkey", "says", table(spark, sf_dir, "nation").selectExpr("concat('term', n_nationkey) AS term", "concat('alias ', n_nationkey) AS alias"))
    sure = X.is_confident(F.when(F.col("n_nationkey") % 2 == 0, 0.6).otherwise(0.59))
    return expand(n, found, "n_nationkey", "text").select("n_nationkey", "label", "expanded", sure.alias("sure"))


@query("""WITH t AS (SELECT n_nationkey, concat('Bail ', n_nationkey) AS term, CASE WHEN n_nationkey % 2 = 0 THEN concat('official ', n_nationkey) END AS def FROM nation) SELECT term, coalesce(def, concat('own ', n_nationkey)) AS explanation, CASE WHEN def IS NULL THEN 'authored' ELSE 'official' END AS source FROM t""")
def built_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official definitions first, authored ones where there are none."""
    n = table(spark, sf_dir, "nation")
    authored = n.selectExpr("concat('Bail ', n_nationkey) AS term", "concat('own ', n_nationkey) AS explanation")
    official = n.where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS ord", "concat('r', n_nationkey) AS ref", "concat('bail ', n_nationkey) AS title", "concat('official ', n_nationkey) AS body")
    return O.build_glossary(authored, official).select("term", "explanation", "source")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ' (A', c_custkey, ')') ELSE c_name END AS label, c_custkey % 3 = 0 AS is_private, CASE WHEN c_custkey % 5 = 0 THEN 'Isère' ELSE 'Town · Isère' END AS place, CASE WHEN c_custkey % 5 = 0 THEN '38' ELSE '38' END AS number,
 CASE WHEN c_custkey % 2 = 0 THEN concat('A', c_custkey, ',Mother') ELSE 'Mother' END AS aliases FROM customer""")
def institution_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register of institutions as rows."""
    from lumenfold.sources import registries as Y

    rows = table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS code_uai", "concat(' ', c_name) AS nom", "CASE WHEN c_custkey % 2 = 0 THEN concat('A', c_custkey) END AS sigle", "CASE WHEN c_custkey % 3 = 0 THEN 'Privé' ELSE 'public' END AS statut",
        "CASE WHEN c_custkey % 5 > 0 THEN 'Town' END AS commune", "'38 - Isère' AS departement", "'Mother (0380000A)' AS universite_de_rattachement_libelle_et_uai",
    )
    return Y.institutions(rows).select(F.col("uai").cast("long").alias("c_custkey"), "label", "is_private", "place", F.col("departement_id").alias("number"), F.array_join("aliases", ",").alias("aliases"))


@query("""SELECT o_orderkey, concat('[BUGS SOURCE CHANGE][', upper(CASE WHEN o_orderkey % 2 = 0 THEN 'critical' ELSE 'high' END), '] S', o_orderkey % 5, ' — ', CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'two lines' END) AS subject,
 concat('SUMMARY', chr(10), '  T', chr(10), chr(10), 'REPRODUCTION', chr(10), '  1. a', chr(10), '  2. b') AS body, o_orderkey % 4 > 0 AS triaged FROM orders""")
def report_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects and bodies of notices."""
    o = table(spark, sf_dir, "orders")
    subject = D.change_subject(F.concat(F.lit("S"), F.col("o_orderkey") % 5), F.when(F.col("o_orderkey") % 2 == 0, "critical").otherwise("high"), F.when(F.col("o_orderkey") % 3 > 0, "two \n lines"), "BUGS")
    body = D.report_body([("SUMMARY", F.lit("T")), ("NOTES", F.lit("")), ("REPRODUCTION", F.array(F.lit("a"), F.lit("b")))])
    return o.select("o_orderkey", subject.alias("subject"), body.alias("body"), D.is_triaged(F.when(F.col("o_orderkey") % 2 == 0, "T").otherwise("U"), F.when(F.col("o_orderkey") % 4 == 0, "unreadable")).alias("triaged"))


@query(f"""WITH {NOTICES}, d AS (SELECT version_id, lag(version_id) OVER (PARTITION BY page_id ORDER BY retrieved_at, version_id) AS before FROM n), {"cl AS (SELECT version_id, source_id, position, folded, claim_id FROM (" + "SELECT n.version_id, n.source_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS raw, strip_accents(lower(unnest(string_split(text, chr(10))))) AS folded, sha256(concat(n.source_id, '|', strip_accents(lower(unnest(string_split(text, chr(10)))))))[1:16] AS claim_id FROM n) WHERE position IN (0, 1, 2))"},
 p AS (SELECT d.version_id, c.claim_id, max((c.version_id = d.version_id)::INT) AS b, max((c.version_id = d.before)::INT) AS a FROM d JOIN cl c ON c.version_id IN (d.version_id, d.before) WHERE d.before IS NOT NULL GROUP BY ALL)
 SELECT version_id, count(*) FILTER (b = 1 AND a = 0) AS added, count(*) FILTER (b = 0 AND a = 1) AS removed, count(*) FILTER (a = 1 AND b = 1) AS kept FROM p GROUP BY version_id""")
def claims_between_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that each version adds to, takes from and keeps of the one before it on its page."""
    n = notices(spark, sf_dir)
    held = C.extract(n, ["version_id", "source_id"], "source_id", "text").select("version_id", "claim_id")
    before = P.chain(n, "page_id", "retrieved_at", "version_id", "content_hash").where("previous_version is not null").select("version_id", "previous_version")
    now = before.join(held, "version_id").select("version_id", "claim_id", F.lit(1).alias("b"), F.lit(0).alias("a"))
    was = before.join(held.withColumnRenamed("version_id", "previous_version"), "previous_version").select("version_id", "claim_id", F.lit(0).alias("b"), F.lit(1).alias("a"))
    both = now.unionByName(was).groupBy("version_id", "claim_id").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.groupBy("version_id").agg(F.count_if((F.col("b") == 1) & (F.col("a") == 0)).alias("added"), F.count_if((F.col("b") == 0) & (F.col("a") == 1)).alias("removed"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("kept"))


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS asks_model, o_orderkey % 4 <> 1 AS is_now, o_orderkey % 5 > 0 AS may_ask, CASE WHEN o_orderkey % 2 = 0 THEN 'Cas A' ELSE '' END AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'a.fr' WHEN 1 THEN 'b.fr' ELSE '' END AS host,
 CASE WHEN o_orderkey % 6 = 0 THEN 'extractable: failed; authority: failed' WHEN o_orderkey % 6 = 3 THEN 'authority: failed' ELSE '' END AS why FROM orders""")
def answer_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from one value each: H2, H4, H5, H9, H15, H18, H19 and F26."""
    from lumenfold.functions.dates import asked_about, is_now
    from lumenfold.operators import retrieval as R

    k = F.col("o_orderkey")
    asked = asked_about(F.when(k % 4 == 1, "What held on 2020-01-01?").otherwise("What holds?"), F.lit("2024-05-15").cast("date"))
    level = F.when(k % 3 == 0, 3).otherwise(1)
    gate = D.promotion(F.when(k % 6 == 0, "blocked").otherwise("healthy"), F.lit(True), F.lit(True), level, F.lit(True), F.lit(True), F.lit(True))
    filled = F.when(k % 5 == 0, F.array(F.lit("location"))).otherwise(F.array(F.lit("date")))
    final, url = F.when(k % 3 == 0, "https://a.fr:80/x").otherwise(""), F.when(k % 3 == 1, "https://u@B.fr/y").otherwise("nothing")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", R.needs_model(F.when(k % 3 == 0, "ASK_MODEL").otherwise("ANSWER")).alias("asks_model"), is_now(asked).alias("is_now"), D.may_ask_for(filled, F.lit("location")).alias("may_ask"),
        X.known(F.when(k % 2 == 0, "Cas A")).alias("scope"), X.known(G.host_of(final, url)).alias("host"), D.gate_reasons(gate["failed"]).alias("why"),
    )


@query("""WITH c AS (SELECT o_custkey AS answer, concat('https://u', o_orderkey % 6) AS url, max((o_orderkey % 6 < 3 AND o_orderkey % 4 > 0)::INT) AS used FROM orders GROUP BY ALL) SELECT answer, url FROM (SELECT *, max(used) OVER (PARTITION BY answer) AS backed FROM c) WHERE used = 1 OR backed = 0""")
def citations_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that surviving claims rest on, or all."""
    from lumenfold.operators import claimcheck as K

    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS answer", "concat('https://u', o_orderkey % 6) AS url", "o_orderkey % 6 < 3 AS sure", "o_orderkey % 4 > 0 AS stays")
    judged = o.select("answer", F.when(F.col("stays"), "kept").otherwise("removed").alias("action"), F.when(F.col("sure"), F.struct(F.lit("s").alias("source_id"), F.col("url").alias("address"), F.lit("v").alias("version_id"))).alias("source"))
    return K.backing(o.select("answer", "url").distinct(), judged)


@query("""SELECT o_custkey AS answer, concat('s', o_orderkey % 5) AS source_id, concat('v', o_orderkey) AS version_id, o_orderkey % 5 = 0 AS is_local FROM orders UNION ALL
 SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'service-public' ELSE concat('F', o_orderkey % 3) END, concat(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('F', o_orderkey % 3) END, '@2024'), false FROM orders""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored versions and corpus passages as one table of evidence."""
    from lumenfold.operators import claimcheck as K

    o = table(spark, sf_dir, "orders")
    live = o.selectExpr("o_custkey AS answer", "concat('s', o_orderkey % 5) AS source_id", "'u' AS url", "'c' AS canonical_url", "'t' AS title", "'x' AS text", "concat('v', o_orderkey) AS version_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'Isère' END AS area")
    corpus = o.selectExpr("o_custkey AS answer", "CASE WHEN o_orderkey % 3 > 0 THEN concat('F', o_orderkey % 3) END AS page", "'u' AS url", "'t' AS title", "'x' AS text", "'2024' AS last_updated")
    return K.evidence_of(live, corpus).select("answer", "source_id", "version_id", "is_local")


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'blocked' ELSE 'stale' END AS health, s_suppkey % 4 = 0 OR s_suppkey % 2 = 1 AS verified, CASE WHEN s_suppkey % 4 = 0 THEN '2024-05-01' ELSE '' END AS verified_at, s_suppkey % 3 = 0 AS live FROM supplier""")
def registry_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with what checks found, and with live queries for what was promoted."""
    from lumenfold.sources import registries as Y

    r = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "'stale' AS health", "s_suppkey % 2 = 1 AS verified", "'' AS verified_at", "true AS live_query_enabled")
    checks = r.where("id % 4 < 2").selectExpr("id", "CASE WHEN id % 4 = 0 THEN 'healthy' ELSE 'blocked' END AS health")
    out = Y.with_live(Y.with_checks(r, checks, "2024-05-01"), r.where("id % 3 = 0"))
    return out.select(F.col("id").alias("s_suppkey"), "health", "verified", "verified_at", F.col("live_query_enabled").alias("live"))


@query(f"""WITH {NOTICES}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS k, count(*) OVER (PARTITION BY page_id) AS total FROM n)
 SELECT page_id, version_id FROM r WHERE NOT (total > 2 AND k > 5 AND version_id % 10 <> 0 AND retrieved_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND version_id % 3 > 0)""")
def history_after_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prune leaves: everything but what its plan marks."""
    rows = notices(spark, sf_dir).withColumns({"active": F.col("version_id") % 10 == 0, "pending": F.when(F.col("version_id") % 3 == 0, 2).otherwise(0)})
    plan = P.retention(rows, "page_id", "retrieved_at", "version_id", "active", "pending", F.lit("1998-01-01").cast("timestamp"), 5, 365)
    return P.pruned(rows, plan, "page_id", "version_id").select("page_id", "version_id")


@query("""WITH v AS (SELECT o_custkey AS answer, concat(chr(10), 'Passage ', o_orderkey % 4) AS t, o_orderkey AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY k) AS n FROM v)
 SELECT answer, count(*) AS shown, min(k) AS first FROM r WHERE n <= 4 GROUP BY answer""")
def evidence_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that a model is shown: the selected ones, four at most."""
    from lumenfold.operators import retrieval as R

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), "o_orderkey")
    return R.top(o, "query", [F.asc("o_orderkey")], R.EVIDENCE).groupBy(F.col("query").alias("answer")).agg(F.count("*").alias("shown"), F.min("o_orderkey").alias("first"))
