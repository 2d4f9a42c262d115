"""Queries over the registry of sources, places, institutions and conversations, and their SQL.

Suppliers stand in for registered sources, regions for topics, nations for départements, customers for readers and their questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens
from lumenfold.operators import conversation as V
from lumenfold.operators import entities as E
from lumenfold.operators import places as L
from lumenfold.operators import registry as G
from lumenfold.operators import store as S
from lumenfold.plans.tables import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HEALTH = "CASE s_suppkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'healthy' WHEN 2 THEN 'stale' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'changed' ELSE 'healthy_rendered' END"
TYPE = "CASE s_suppkey % 3 WHEN 0 THEN 'government' WHEN 1 THEN 'local_authority' ELSE 'university' END"
LEVEL = "CASE s_suppkey % 4 WHEN 0 THEN 'national' WHEN 1 THEN 'department' WHEN 2 THEN 'city' ELSE 'institution' END"
MODE = "CASE WHEN s_suppkey % 7 = 0 THEN 'unavailable' WHEN s_suppkey % 7 < 4 THEN 'live_query' WHEN s_suppkey % 7 = 4 THEN 'cached_only' ELSE 'sync_only' END"
PRIORITY = "CASE s_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN 'medium' ELSE 'odd' END"
SOURCES = f"""src AS (SELECT concat('s', s_suppkey) AS id, s_suppkey AS k, s_name AS name, concat('n', s_nationkey) AS entity, s_suppkey % 4 AS tp, 1 + s_suppkey % 3 AS lvl, {TYPE} AS source_type, {HEALTH} AS health, {LEVEL} AS jurisdiction, {MODE} AS mode,
 {PRIORITY} AS priority, s_suppkey % 5 > 0 AS verified, concat('d', s_nationkey % 10) AS area FROM supplier)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey) AS id", "s_suppkey AS file_order", "s_name AS name", "concat('s', s_suppkey, '.example') AS domain", "array(concat('.www', s_suppkey, '.example')) AS aliases", "array(concat('OLD', s_suppkey, '.example')) AS legacy_domains",
        "CASE WHEN s_suppkey % 4 = 0 THEN array() ELSE array(concat('topic-', s_suppkey % 4)) END AS supported_topics", "array(concat('N', s_nationkey)) AS supported_entities", "CAST(1 + s_suppkey % 3 AS INT) AS authority_level",
        f"{TYPE} AS source_type", f"{HEALTH} AS health", f"{LEVEL} AS jurisdiction", "concat('d', s_nationkey % 10) AS jurisdiction_area", f"{MODE} AS mode", f"{PRIORITY} AS refresh_priority", "s_suppkey % 5 > 0 AS verified", "s_suppkey % 2 = 0 AS render_enabled",
    )


TOPICS = """top AS (SELECT r_name AS id, r_regionkey AS r, [concat('topic_', r_regionkey % 4), concat('p', r_regionkey)] AS ps, CASE r_regionkey % 2 WHEN 0 THEN ['local_authority', 'government'] ELSE ['university', 'corpus'] END AS preferred, r_regionkey = 1 AS corpus FROM region)"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_name AS id", "r_regionkey AS file_order", "array(concat('topic_', r_regionkey % 4), concat('p', r_regionkey)) AS purposes",
        "CASE r_regionkey % 2 WHEN 0 THEN array('local_authority', 'government') ELSE array('university', 'corpus') END AS preferred", "CASE WHEN r_regionkey = 1 THEN array('corpus') ELSE array() END AS fallback",
    )


QUESTIONS = """qu AS (SELECT c_custkey AS question, CASE c_custkey % 3 WHEN 0 THEN [concat('topic_', c_custkey % 4)] WHEN 1 THEN [concat('p', c_custkey % 5), 'topic_1'] ELSE [] END AS ps, CASE WHEN c_custkey % 5 = 0 THEN concat('n', c_nationkey) END AS entity,
 CASE WHEN c_custkey % 2 = 0 THEN concat('s', c_custkey % 10) END AS authority_source FROM customer),
 hit AS (SELECT question, t.id AS topic, t.r, sum(len(q.ps) - list_position(q.ps, p) + 1) AS score FROM (SELECT *, unnest(ps) AS p FROM qu) q JOIN top t ON list_contains(t.ps, p) GROUP BY ALL)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS question", "CASE c_custkey % 3 WHEN 0 THEN array(concat('topic_', c_custkey % 4)) WHEN 1 THEN array(concat('p', c_custkey % 5), 'topic_1') ELSE array() END AS purposes",
        "CASE WHEN c_custkey % 5 = 0 THEN concat('N', c_nationkey) END AS entity", "CASE WHEN c_custkey % 2 = 0 THEN concat('s', c_custkey % 10) END AS authority_source",
    )


@query(f"""WITH {SOURCES} SELECT id, verified AND health NOT IN ('blocked', 'unavailable') AS usable, CASE priority WHEN 'critical' THEN 8 WHEN 'high' THEN 24 WHEN 'low' THEN 336 ELSE 72 END AS refresh_hours,
 concat('s', k, '.example,www', k, '.example,old', k, '.example') AS domains FROM src""")
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source may be cited, when it is due, and its hosts."""
    s = sources(spark, sf_dir)
    return s.select("id", G.usable(F.col("verified"), F.col("health")).alias("usable"), G.refresh_hours(F.col("refresh_priority")).alias("refresh_hours"), F.array_join(G.domains(F.col("domain"), F.col("aliases"), F.col("legacy_domains")), ",").alias("domains"))


@query(f"""WITH {SOURCES} SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY lvl, k) AS rank, id AS source_id FROM nation JOIN src ON entity = concat('n', n_nationkey)""")
def sources_for_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that speak for an entity, most authoritative first."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" n"), "n_nationkey").alias("entity"))
    return G.for_key(n, "entity", sources(spark, sf_dir), "supported_entities").select("n_nationkey", "rank", "source_id")


@query(f"WITH {SOURCES} SELECT id, CASE WHEN area = 'd1' THEN 'here' ELSE 'anywhere' END AS area FROM src WHERE jurisdiction = 'department'")
def sources_by_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a level, and of an area of it."""
    s = sources(spark, sf_dir)
    here = G.by_jurisdiction(s, "department", "D1 ").select("id", F.lit("here").alias("area"))
    return G.by_jurisdiction(s, "department").join(here, "id", "left").select("id", F.coalesce("area", F.lit("anywhere")).alias("area"))


@query(f"""WITH {SOURCES}, u AS (SELECT c_custkey, c_custkey % 20 AS n, CASE c_custkey % 4 WHEN 0 THEN concat('a.s', c_custkey % 20, '.example') WHEN 1 THEN concat('old', c_custkey % 20, '.example') WHEN 2 THEN concat('evils', c_custkey % 20, '.example') ELSE '10.0.0.1' END AS host FROM customer)
 SELECT c_custkey, src.id AS source_id, coalesce(verified AND health NOT IN ('blocked', 'unavailable'), false) AS authoritative FROM u LEFT JOIN src ON k = n AND c_custkey % 4 < 2""")
def authoritative_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a host's registered source may be cited (F3, J4): look-alikes and bare addresses have none."""
    host = "CASE c_custkey % 4 WHEN 0 THEN concat('a.s', c_custkey % 20, '.example') WHEN 1 THEN concat('old', c_custkey % 20, '.example') WHEN 2 THEN concat('evils', c_custkey % 20, '.example') ELSE '10.0.0.1' END AS host"
    return G.authoritative(table(spark, sf_dir, "customer").selectExpr("c_custkey", host), "host", sources(spark, sf_dir)).select("c_custkey", "source_id", "authoritative")


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'refused: only https is fetched' WHEN 2 THEN 'refused: ''evil-a.fr'' is not a registered source' WHEN 3 THEN 'refused: redirect left https' WHEN 4 THEN 'refused: redirect to ''b.fr'''
 WHEN 5 THEN 'refused: too many redirects' WHEN 6 THEN 'refused: content type ''image/png'' is not readable' WHEN 7 THEN 'refused: ''10.0.0.1'' is not a registered source' END AS refusal FROM orders""")
def fetch_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a fetch is refused."""
    k = F.col("o_orderkey") % 8
    url = F.when(k == 1, "http://a.fr/x").when(k == 2, "https://evil-a.fr/").when(k == 7, "https://10.0.0.1/").otherwise("https://www.a.fr/x")
    hops = F.when(k == 3, F.array(F.lit("https://a.fr/1"), F.lit("http://a.fr/2"))).when(k == 4, F.array(F.lit("https://b.fr/"))).when(k == 5, F.array_repeat(F.lit("https://a.fr/y"), 6))
    media = F.when(k == 6, "image/png").otherwise("text/html; charset=utf-8")
    return table(spark, sf_dir, "orders").select("o_orderkey", G.fetch_refusal(url, hops, media, F.array(F.lit("a.fr"))).alias("refusal"))


@query(f"""WITH {TOPICS}, {QUESTIONS} SELECT question, topic, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY question ORDER BY score DESC, r) AS rank FROM hit""")
def question_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a question by its purposes."""
    return G.topics_for(questions(spark, sf_dir), topics(spark, sf_dir)).withColumn("score", F.col("score").cast("long"))


@query(f"""WITH {SOURCES}, {TOPICS}, {QUESTIONS}, f AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, r) = 1),
 a AS (SELECT qu.question, qu.entity, qu.authority_source, f.topic, top.preferred, top.corpus, top.r FROM qu LEFT JOIN f USING (question) LEFT JOIN top ON top.id = f.topic),
 x AS (SELECT question, s.k, 0 AS c FROM a JOIN src s ON s.entity = a.entity UNION ALL SELECT question, s.k, 1 FROM a JOIN src s ON s.id = a.authority_source AND (s.tp = 0 OR s.tp = a.r % 4) WHERE a.r % 2 = 0
   UNION ALL SELECT question, s.k, CASE WHEN a.r % 2 = 0 THEN 3 ELSE 2 END FROM a JOIN src s ON s.source_type = CASE WHEN a.r % 2 = 0 THEN 'government' ELSE 'university' END AND (s.tp = 0 OR s.tp = a.r % 4) WHERE a.topic IS NOT NULL),
 o AS (SELECT question, k, min(c) AS c FROM x GROUP BY ALL), g AS (SELECT question, count(*) FILTER (mode <> 'unavailable') AS steps, arg_min(src.id, (c, lvl, src.k)) FILTER (mode <> 'unavailable') AS first_step, count(*) FILTER (mode = 'live_query') AS live,
   string_agg(name, ',' ORDER BY c, lvl, src.k) FILTER (mode = 'unavailable') AS unreachable, count(*) FILTER (mode = 'unavailable' AND lvl = 1) AS deciders_down FROM o JOIN src USING (k) GROUP BY question)
 SELECT a.question, a.topic, coalesce(steps, 0) AS steps, first_step, coalesce(live, 0) AS live, coalesce(unreachable, '') AS unreachable, coalesce(deciders_down, 0) AS deciders_down, coalesce(r % 2 = 0 AND authority_source IS NULL, false) AS needs_place,
  topic IS NULL OR corpus AS fall_back, coalesce(steps, 0) > 0 AS has_authority FROM a LEFT JOIN g USING (question)""")
def question_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom to ask about each question, and who can't be reached."""
    p = G.plan(questions(spark, sf_dir), topics(spark, sf_dir), sources(spark, sf_dir))
    n = lambda c: F.size(c).cast("long")
    return p.select("question", "topic", n("steps").alias("steps"), F.get("steps", 0)["source_id"].alias("first_step"), n("live_steps").alias("live"), F.array_join("unreachable", ",").alias("unreachable"), n("unreachable_deciders").alias("deciders_down"), F.coalesce("needs_place", F.lit(False)).alias("needs_place"), "fall_back", "has_authority")


@query(f"""WITH {SOURCES}, {TOPICS}, m AS (SELECT top.id AS topic, r % 2 = 0 AS needs, src.* FROM top JOIN src ON tp > 0 AND tp = r % 4), g AS (SELECT topic, count(*) AS sources, count(*) FILTER (mode = 'live_query') AS live, count(*) FILTER (mode = 'cached_only') AS cached, count(*) FILTER (mode = 'unavailable') AS unavailable,
 count(*) FILTER (mode = 'unavailable' AND lvl = 1) AS deciders_down, bool_or(mode = 'live_query' AND jurisdiction = 'department') AS local FROM m GROUP BY topic)
 SELECT top.id AS topic, coalesce(sources, 0) AS sources, coalesce(live, 0) AS live, coalesce(cached, 0) AS cached, coalesce(unavailable, 0) AS unavailable, coalesce(deciders_down, 0) AS deciders_down,
  CASE WHEN live > 0 AND (r % 2 = 1 OR coalesce(local, false)) AND deciders_down = 0 THEN 'complete' WHEN live > 0 OR cached > 0 THEN 'partial' ELSE 'missing' END AS status FROM top LEFT JOIN g ON topic = top.id""")
def coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each topic can be answered now; a body that decides it and is down is a gap."""
    return G.coverage(topics(spark, sf_dir), sources(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT mode, health, count(*) AS n FROM src GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counts(sources(spark, sf_dir), ["mode", "health"])


VERSIONS = "ve AS (SELECT concat('s', l_suppkey) AS source_id, concat('v', l_orderkey, '-', l_linenumber) AS version_id, l_shipdate AS seen, l_quantity > 40 AS real FROM lineitem)"


@query(f"""WITH {SOURCES}, {VERSIONS}, v AS (SELECT source_id, count(*) AS versions, max(seen) AS last_checked, arg_max(version_id, (seen, version_id)) AS current_version, max(seen) FILTER (real) AS last_change FROM ve GROUP BY source_id),
 c AS (SELECT source_id, count(*) AS claims, count(*) FILTER (p_partkey % 3 = 0) AS stale FROM v JOIN (SELECT p_partkey, concat('s', p_partkey % (SELECT count(*) FROM supplier)) AS source_id FROM part) USING (source_id) GROUP BY source_id)
 SELECT id, coalesce(versions, 0) AS versions, current_version, CAST(CAST(last_change AS DATE) AS VARCHAR) AS last_change, coalesce(claims, 0) AS claims, coalesce(stale, 0) AS claims_stale, coalesce(claims, 0) - coalesce(claims, 0) AS claims_dated,
  last_checked IS NULL OR last_checked + INTERVAL (CASE priority WHEN 'critical' THEN 8 WHEN 'high' THEN 24 WHEN 'low' THEN 336 ELSE 72 END) HOUR < TIMESTAMP '1998-12-01' AS due_now,
  CASE health WHEN 'blocked' THEN 'bot protection; not bypassed' WHEN 'unavailable' THEN 'could not be reached' ELSE '' END AS access_reason, CASE WHEN coalesce(stale, 0) > 0 THEN 'pending review' WHEN current_version IS NULL THEN 'unknown' ELSE 'current' END AS currentness, 'L' || lvl AS authority, coalesce(x.n, 0) AS conflicts
 FROM src LEFT JOIN v ON v.source_id = id LEFT JOIN c ON c.source_id = id
 LEFT JOIN (SELECT source_id, count(*) AS n FROM (SELECT concat('s', s_suppkey + unnest([0, 1])) AS source_id FROM supplier WHERE s_suppkey % 4 = 0) GROUP BY source_id) x ON x.source_id = id""")
def source_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each source."""
    li = table(spark, sf_dir, "lineitem")
    v = li.selectExpr("concat('s', l_suppkey) AS source_id", "concat('v', l_orderkey, '-', l_linenumber) AS version_id", "l_shipdate AS retrieved_at", "CASE WHEN l_quantity > 40 THEN 'critical' ELSE 'cosmetic' END AS change_type")
    n = F.broadcast(table(spark, sf_dir, "supplier").agg(F.count("*").alias("n")))  # one row
    latest = v.groupBy("source_id").agg(F.max_by("version_id", F.struct("retrieved_at", "version_id")).alias("version_id"))
    claims = table(spark, sf_dir, "part").crossJoin(n).select(F.concat(F.lit("s"), F.col("p_partkey") % F.col("n")).alias("source_id"), F.when(F.col("p_partkey") % 3 == 0, "stale_pending_review").otherwise("current").alias("status"), F.lit(None).cast("date").alias("effective_from")).join(latest, "source_id")
    conflicts = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").selectExpr("concat('s', s_suppkey) AS source_a", "concat('s', s_suppkey + 1) AS source_b")  # each fourth source contradicts the next
    d = G.describe(sources(spark, sf_dir), v, claims, conflicts, F.lit("1998-12-01").cast("timestamp_ntz"))
    return d.select(F.col("source_id").alias("id"), "versions", "current_version", F.col("last_change").cast("date").cast("string").alias("last_change"), "claims", "claims_stale", "claims_dated", "due_now", "access_reason", "currentness", "authority", "conflicts")


@query("""WITH e AS (SELECT o_custkey AS answer, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'unknown' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'fresh' ELSE 'live_verified' END END AS f FROM orders),
 w AS (SELECT answer, max(CASE f WHEN 'live_verified' THEN 0 WHEN 'fresh' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END) AS r, arg_min(concat('s', k % 7), k) FILTER (k % 7 > 2) AS local_source, count(DISTINCT concat(k % 7, '|u', k % 3)) AS pages FROM e GROUP BY answer)
 SELECT answer, list_extract(['live_verified', 'fresh', 'stale', 'unknown'], r::INT + 1) AS freshness, list_extract(['fresh_live', 'fresh_cached', 'fresh_stale', 'fresh_unavailable'], r::INT + 1) AS message, local_source, pages FROM w""")
def evidence_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least fresh of an answer's evidence, its message, its first local source and the versions it rests on."""
    f = "CASE o_orderkey % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'unknown' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'fresh' ELSE 'live_verified' END END AS freshness"
    e = table(spark, sf_dir, "orders").selectExpr("o_custkey AS answer", "o_orderkey AS position", f, "concat('s', o_orderkey % 7) AS source_id", "concat('u', o_orderkey % 3) AS url", "concat('v', o_orderkey) AS version_id", "CASE WHEN o_orderkey % 7 > 2 THEN 'department' ELSE 'national' END AS jurisdiction")
    used = G.versions_used(e, "answer").select("answer", "local_source", F.size("versions").cast("long").alias("pages"))
    worst = G.worst_freshness(e, "answer")
    return worst.join(used, "answer").select("answer", "freshness", G.freshness_key(F.col("freshness")).alias("message"), "local_source", "pages")


# ------------------------------------------------------------------ places

DEPTS = "de AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, replace(n_name, '_', '-') AS name, n_nationkey AS n FROM nation)"
PLACE_TEXT = """CASE c_custkey % 8 WHEN 0 THEN concat('I live in Ville-', c_nationkey, ' now') WHEN 1 THEN concat('What about ', replace(n_name, '_', '-'), ' here?') WHEN 2 THEN concat('Something near Partage-', c_nationkey % 5) WHEN 3 THEN concat('ville-', c_nationkey, ' please')
 WHEN 4 THEN concat('My préfecture is ', lpad(CAST(c_nationkey AS STRING), 2, '0')) WHEN 5 THEN 'nothing at all' WHEN 6 THEN 'no place in it' ELSE concat('Ville-', c_nationkey, ', thanks') END"""


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "lpad(CAST(n_nationkey AS STRING), 2, '0') AS code", "lower(n_name) AS id", "replace(n_name, '_', '-') AS name", "concat('r', n_regionkey) AS region", "concat('s', n_nationkey % 10) AS prefecture_source", "concat('Authority ', n_nationkey) AS prefecture_name",
        "array(concat('Ville-', n_nationkey), concat('Partage-', n_nationkey % 5)) AS cities", "n_nationkey AS file_order",
    )


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr("c_custkey", f"{PLACE_TEXT} AS text", "CASE WHEN c_custkey % 8 = 6 THEN lpad(CAST(c_nationkey AS STRING), 2, '0') END AS hint")


@query(f"""WITH {DEPTS}, c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey AS n FROM customer WHERE c_custkey % 8 NOT IN (3, 5))
 SELECT c_custkey, CASE k WHEN 0 THEN 'introduced' WHEN 1 THEN 'department' WHEN 2 THEN 'introduced' WHEN 4 THEN 'code' WHEN 6 THEN 'hint' ELSE 'name' END AS how, CASE k WHEN 0 THEN concat('Ville-', n) WHEN 2 THEN concat('Partage-', n % 5) WHEN 7 THEN concat('Ville-', n) ELSE '' END AS city,
  CASE WHEN k <> 2 THEN lpad(CAST(n AS VARCHAR), 2, '0') END AS department, CASE WHEN k = 2 THEN (SELECT string_agg(code, ',' ORDER BY code) FROM de WHERE de.n % 5 = c.n % 5) ELSE '' END AS candidates FROM c""")
def place_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each question, by the first way that finds one."""
    p = L.resolve(place_texts(spark, sf_dir), "c_custkey", "text", departments(spark, sf_dir), hint="hint")
    return p.select("c_custkey", "how", "city", "department", F.array_join("candidates", ",").alias("candidates"))


@query(f"""WITH {DEPTS}, c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey AS n FROM customer WHERE c_custkey % 8 NOT IN (5, 6))
 SELECT c_custkey, CASE k WHEN 4 THEN 'code' ELSE 'reply' END AS how, CASE WHEN k = 2 THEN NULL ELSE lpad(CAST(n AS VARCHAR), 2, '0') END AS department, k = 2 AS ambiguous FROM c""")
def place_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to the question where one is: a bare name or code is enough."""
    return L.resolve(place_texts(spark, sf_dir), "c_custkey", "text", departments(spark, sf_dir), reply=True).select("c_custkey", "how", "department", "ambiguous")


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN concat('Ville-', c_nationkey) ELSE concat('Partage-', c_nationkey % 5) END AS city FROM customer WHERE c_custkey % 8 IN (0, 2)""")
def cities_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.city_named(place_texts(spark, sf_dir), "c_custkey", "text")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN replace(n_name, '_', '-') END AS department, CASE WHEN c_custkey % 4 < 3 THEN concat('r', n_regionkey) END AS region, CASE WHEN c_custkey % 4 < 3 THEN concat('s', n_nationkey % 10) END AS authority_source,
 CASE WHEN c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 2 = 0 THEN concat('Town · ', replace(n_name, '_', '-')) ELSE replace(n_name, '_', '-') END ELSE '' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def department_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Départements by code or name, and how to say where that is."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.expr("CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(n_nationkey AS STRING), 2, '0') WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name, '_', '-') ELSE '' END")
    rows = L.department_of(c.select("c_custkey", F.translate(key, "_", "-").alias("key")), "key", departments(spark, sf_dir))
    city = F.when((F.col("c_custkey") % 2 == 0) & F.col("department").isNotNull(), "Town")
    return rows.select("c_custkey", "department", "region", "authority_source", L.place_label(city, F.col("department")).alias("label"))


@query("""WITH h AS (SELECT o_custkey AS query, o_orderkey AS doc, CASE WHEN o_custkey % 3 < 2 THEN concat('d', o_custkey % 3) END AS department, o_custkey % 4 AS p FROM orders)
 SELECT query, doc, CASE WHEN department IS NOT NULL AND doc % 5 < 2 AND concat('d', doc % 5) <> department THEN 'wrong_jurisdiction' WHEN p < 2 AND doc % 3 < 2 AND p <> doc % 3 THEN 'wrong_purpose' END AS reason FROM h""")
def relevance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages about another place or another matter."""
    o = table(spark, sf_dir, "orders")
    hits = o.selectExpr("o_custkey AS query", "o_orderkey AS doc", "CASE WHEN o_custkey % 3 < 2 THEN concat('d', o_custkey % 3) END AS department", "CASE WHEN o_custkey % 4 < 2 THEN array(o_custkey % 4) ELSE array() END AS purposes")
    pages = o.where("o_orderkey % 5 < 2").selectExpr("o_orderkey AS doc", "concat('d', o_orderkey % 5) AS department")
    about = o.selectExpr("o_orderkey AS doc", "CASE WHEN o_orderkey % 3 < 2 THEN array(o_orderkey % 3) ELSE array() END AS page_purposes")
    return L.relevance(hits, pages, about).select("query", "doc", "reason")


# ------------------------------------------------------------------ institutions

TURN_TEXT = "CASE (conv_id + turn) % 5 WHEN 0 THEN concat('can École Numéro', conv_id % 25, ' take me?') WHEN 1 THEN 'What does this school cost?' WHEN 2 THEN 'And in France then?' WHEN 3 THEN 'Is EN a good place?' ELSE 'nothing here' END"


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("concat('École Numéro', n_nationkey) AS name", "CASE WHEN n_nationkey = 3 THEN 'EN' ELSE '' END AS acronym")


@query(f"""WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, CASE (conv_id + turn) % 5 WHEN 0 THEN concat('École Numéro', conv_id % 25) WHEN 3 THEN 'École Numéro3' END AS named FROM conversations),
 b AS (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
 SELECT conv_id, turn, CASE WHEN k = 1 THEN before ELSE named END AS institution, k = 1 AND before IS NOT NULL AS from_context, k = 1 AND before IS NULL AS needs_clarification, k IN (0, 1, 3) AS about_institution FROM b""")
def institutions_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions that turns name, or take from before."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(TURN_TEXT).alias("text"))
    return E.resolve(t, "conv_id", "turn", "text", register(spark, sf_dir)).drop("text")


@query("""SELECT conv_id, turn, conv_id % 4 = 0 AS study, conv_id % 4 = 1 AS wants_current FROM conversations""")
def question_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of students, and questions about what holds now."""
    q = F.expr("CASE conv_id % 4 WHEN 0 THEN 'Où est l''Université ?' WHEN 1 THEN 'La règle a-t-elle CHANGÉ ?' ELSE 'Un visa' END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.looks_like_study(tokens(q)).alias("study"), E.wants_current(q).alias("wants_current"))


# ------------------------------------------------------------------ clarifications

#: Four turns of a conversation by its number c: the engine asks for a field, and the reader does one of six things.
TURNS = """SELECT CAST(c_custkey AS STRING) AS conversation, CAST(t AS BIGINT) AS turn, CASE t WHEN 1 THEN CASE c_custkey % 3 WHEN 0 THEN 'ask:location' WHEN 1 THEN 'ask:user_status' ELSE 'ask:entity' END WHEN 4 THEN CASE c_custkey % 3 WHEN 0 THEN 'ask:location' WHEN 1 THEN 'ask:user_status' ELSE 'ask:entity' END ELSE 'reply' END AS kind,
 CASE t WHEN 1 THEN concat('Question ', c_custkey) WHEN 4 THEN '' ELSE CASE c_custkey % 2 WHEN 0 THEN CASE WHEN t = 2 THEN 'hm' ELSE CASE c_custkey % 3 WHEN 0 THEN 'Antibes' WHEN 1 THEN 'Oui' ELSE 'École X' END END ELSE CASE WHEN c_custkey % 5 = 0 THEN 'Actually, forget that' ELSE 'hm' END END END AS message FROM customer"""


@query("""WITH c AS (SELECT c_custkey AS c, c_custkey % 3 AS f, c_custkey % 2 = 0 AS answers, c_custkey % 5 = 0 AND c_custkey % 2 = 1 AS switches, unnest([1, 2, 3, 4]) AS t FROM customer)
 SELECT CAST(c AS VARCHAR) AS conversation, CAST(t AS BIGINT) AS turn, CASE t WHEN 1 THEN 'opened' WHEN 2 THEN CASE WHEN switches THEN 'switched' ELSE 'waiting' END WHEN 3 THEN CASE WHEN switches THEN 'idle' WHEN answers THEN 'resumed' ELSE 'waiting' END ELSE CASE WHEN answers THEN 'refused' ELSE 'opened' END END AS outcome,
  CASE WHEN switches AND t IN (2, 3) THEN 'Actually, forget that' WHEN switches AND t = 4 THEN '' WHEN answers AND f = 2 AND t >= 3 THEN concat('Question ', c, ' (École X)') ELSE concat('Question ', c) END AS question,
  CASE WHEN answers AND t >= 3 THEN list_extract(['location', 'user_status', 'entity'], f + 1) ELSE '' END AS filled FROM c""")
def dialogue_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clarifications of five fields: opened, waiting, resumed, switched, and never asked again (2.11, F18, F26)."""
    turns = TURNS.replace("FROM customer", "FROM {c} LATERAL VIEW explode(array(1, 2, 3, 4)) x AS t")
    t = spark.sql(turns, c=spread(table(spark, sf_dir, "customer").select("c_custkey")))
    read = {"location": F.when(F.col("message") == "Antibes", "06"), "entity": F.when(F.col("message").startswith("École"), F.col("message")), "user_status": V.status_of(F.col("message")), "purpose": F.lit(None).cast("string"), "date": V.date_of(F.col("message"))}
    return V.dialogue(t.withColumns(read)).select("conversation", "turn", "outcome", "question", F.array_join("filled", ",").alias("filled"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'student' WHEN 1 THEN 'worker' WHEN 2 THEN 'yes' WHEN 3 THEN 'no' END AS status, CASE WHEN c_custkey % 6 = 5 THEN 'en mai 2024' END AS day FROM customer""")
def reply_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'Je suis étudiante' WHEN 1 THEN 'a worker, I think' WHEN 2 THEN 'Oui !' WHEN 3 THEN ' nope' WHEN 4 THEN 'hm' ELSE 'en mai 2024' END")
    return table(spark, sf_dir, "customer").select("c_custkey", V.status_of(m).alias("status"), V.date_of(m).alias("day"))


# ------------------------------------------------------------------ state of everything


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what the scorecard counts."""
    s = S.source_counts(sources(spark, sf_dir).withColumn("due", F.col("file_order") % 3 == 0), "s6")
    o = table(spark, sf_dir, "orders")
    claims = o.selectExpr("concat('s', o_custkey % 10) AS source_id", "concat('v', o_custkey % 100) AS version_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'superseded' ELSE 'current' END AS status", "CAST(NULL AS DATE) AS effective_from")
    active = o.where("o_custkey % 100 < 10").selectExpr("concat('s', o_custkey % 10) AS source_id", "concat('v', o_custkey % 100) AS version_id").distinct()
    m = S.claim_metrics(claims, active).selectExpr("active AS claims_active", "stale AS claims_stale", "with_effective_date AS claims_dated")
    return s.crossJoin(m).withColumns({"deep_sources": F.lit(0), "conflicts": F.lit(2), "real_changes": F.lit(0), "email_configured": F.lit(0)})  # one row each


STATE = f"""st AS (SELECT count(*) FILTER (mode = 'live_query' AND jurisdiction = 'national') AS live_national, count(*) FILTER (mode = 'live_query' AND jurisdiction = 'department') AS live_local, count(*) FILTER (mode = 'live_query' AND jurisdiction = 'institution') AS live_institution,
 count(*) FILTER (mode = 'live_query') AS live, count(*) FILTER (mode = 'live_query' AND health = 'healthy_rendered') AS live_rendered, count(*) FILTER (verified AND health NOT IN ('blocked', 'unavailable') AND k % 3 > 0) AS fresh, count(*) FILTER (health = 'blocked') AS blocked, count(*) FILTER (health = 'unavailable') AS unavailable,
 count(*) AS registered, count(*) FILTER (verified AND health NOT IN ('blocked', 'unavailable')) AS citable, count(*) FILTER (verified AND health NOT IN ('blocked', 'unavailable') AND k % 3 = 0) AS due FROM src),
 cm AS (SELECT count(*) FILTER (o_orderkey % 4 > 0) AS claims_active FROM orders WHERE o_custkey % 100 < 10)"""


@query(f"""WITH {SOURCES}, {STATE}, r AS (SELECT unnest([['national_routing', live_national || ' live_national', CASE WHEN live_national > 0 THEN 'production_verified' ELSE 'not_observed' END], ['local_jurisdiction', live_local || ' live_local', CASE WHEN live_local > 0 THEN 'production_verified' ELSE 'not_observed' END],
 ['institution_routing', live_institution || ' live_institution', CASE WHEN live_institution > 0 THEN 'production_verified' ELSE 'not_observed' END], ['live_retrieval', live || ' live', CASE WHEN live > 0 THEN 'production_verified' ELSE 'not_observed' END], ['rendered_retrieval', live_rendered || ' live_rendered', CASE WHEN live_rendered > 0 THEN 'production_verified' ELSE 'not_observed' END],
 ['freshness', fresh || ' fresh', CASE WHEN fresh > 0 THEN 'production_verified' ELSE 'not_observed' END], ['claim_provenance', claims_active || ' claims_active', CASE WHEN claims_active > 0 THEN 'production_verified' ELSE 'not_observed' END], ['effective_dates', '0 claims_dated', 'mechanism_verified'], ['historical_retrieval', '0 deep_sources', 'insufficient_history'],
 ['conflict_detection', '2 conflicts', 'production_verified'], ['change_detection', '0 real_changes', 'mechanism_verified'], ['smtp', '0 email_configured', 'not_configured'], ['watched_authority', '0 watched_usable', 'blocked'], ['blocked_sources', blocked || ' blocked', CASE WHEN blocked > 0 THEN 'blocked' ELSE 'not_observed' END],
 ['failed_sources', unavailable || ' unavailable', CASE WHEN unavailable > 0 THEN 'failed' ELSE 'not_observed' END]]) AS x FROM st, cm) SELECT x[1] AS capability, x[3] AS status, x[2] AS evidence FROM r""")
def full_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen capabilities."""
    return S.scorecard(state(spark, sf_dir))


@query(f"""WITH {SOURCES}, {STATE}, ch AS (SELECT count(*) FILTER (p_size % 4 = 0) AS changes_critical, count(*) FILTER (p_size % 4 = 1) AS changes_high, count(*) AS changes_open FROM part WHERE p_partkey % 2 = 0), inc AS (SELECT count(*) AS incidents_open FROM events WHERE event_type = 'error')
 SELECT registered, citable, live, blocked, unavailable, citable - due AS current, due, changes_critical, changes_high, changes_open, conflicts_open, incidents_open, changes_critical > 0 OR conflicts_open > 0 OR incidents_open > 0 AS needs_attention FROM st, ch, inc, (SELECT count(*) AS conflicts_open FROM customer WHERE c_custkey % 6 = 1)""")
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of sources, review and incidents in one row."""
    changes = table(spark, sf_dir, "part").selectExpr("CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'low' END AS severity", "CASE WHEN p_partkey % 2 = 0 THEN 'open' ELSE 'resolved' END AS review_status")
    incidents = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_type = 'error' THEN 'open' ELSE 'resolved' END AS current_status")
    conflicts = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 6 = 1 THEN 'open' ELSE 'resolved' END AS review_status")
    return S.snapshot(S.source_counts(sources(spark, sf_dir).withColumn("due", F.col("file_order") % 3 == 0), "s6"), changes, conflicts, incidents)


@query("""SELECT user_id AS source, count(*) AS open, string_agg(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'dns' ELSE 'timeout' END, ',' ORDER BY CASE WHEN event_id % 2 = 0 THEN 'dns' ELSE 'timeout' END) AS kinds FROM events WHERE event_type = 'error' GROUP BY user_id""")
def incidents_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "events").selectExpr("user_id AS source", "CASE WHEN event_id % 2 = 0 THEN 'dns' ELSE 'timeout' END AS kind", "CASE WHEN event_type = 'error' THEN 'open' ELSE 'resolved' END AS current_status")
    return S.open_incidents(i)
