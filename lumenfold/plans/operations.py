"""Queries over chunks, pages as HTML, telemetry, decisions, lookups and claim checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import facts as X_
from lumenfold.functions.text import fold_hyphen, fold_plain
from lumenfold.operators import chunking as K
from lumenfold.operators import claimcheck as V
from lumenfold.operators import decisions as D
from lumenfold.operators import lookup as L
from lumenfold.operators import pages as P
from lumenfold.operators import reports as O
from lumenfold.operators import retrieval as R
from lumenfold.operators import telemetry as T
from lumenfold.plans.retrieval import ANY, TOKENS
from lumenfold.plans.tables import quoted, spread, table
from lumenfold.sources import html as H
from lumenfold.sources import publications as X
from lumenfold.streaming import stateful

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ chunks and documents


@query("""WITH d AS (SELECT doc_id % 97 AS id, text, source AS segment, doc_id AS ord FROM documents),
 g AS (SELECT id, text, min(ord) AS first, list_sort(list_distinct(list(segment))) AS segments, arg_min(segment, ord) AS s, count(*) AS copies FROM d GROUP BY id, text)
 SELECT id, first, array_to_string(segments, ',') AS segments, copies, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY first) = 1 THEN CAST(id AS VARCHAR) ELSE concat(id, '@', s) END AS doc_key FROM g""")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id % 97 AS id", "text", "source AS segment", "doc_id AS ord")
    return K.deduplicate(d, "id", "text", "segment", "ord").withColumn("segments", F.array_join("segments", ","))


@query()
def chunk_lines_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunk_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query("SELECT concat(CAST(doc_id AS VARCHAR), '#000#01') AS chunk_id, concat_ws(chr(10), source, concat('Situation : ', CASE WHEN lang <> 'en' THEN lang END), concat('Section : ', lang)) AS header FROM documents".replace("concat('Situation : ', CASE WHEN lang <> 'en' THEN lang END)", "CASE WHEN lang <> 'en' THEN concat('Situation : ', lang) END"))
def chunk_id_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head = K.header(F.col("source"), F.when(F.col("lang") != "en", F.col("lang")), F.col("lang"))
    return K.check_unique(d.select(K.chunk_id(F.col("doc_id"), F.lit(0), F.lit(1)).alias("chunk_id"), head.alias("header")), "chunk_id")


@query()
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("tokens"))
    return K.batches_by_budget(d, "tokens", "doc_id", 16384, 64)


@query("""SELECT b.item_id AS query, count(*) AS pending FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40
 WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1""")
def index_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.sources.logs import pending

    left = pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id").groupBy((F.col("doc_id") % 40).alias("k")).agg(F.count("*").alias("pending"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") % 40).alias("k"))
    return b.join(left, "k").select("query", "pending")


# ------------------------------------------------------------------ pages


@query()
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.read_pages(spread(table(spark, sf_dir, "pages"))).withColumn("is_usable", H.is_usable(F.col("title"), F.col("text"))).drop("anchors")


@query()
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.link_edges(H.read_pages(table(spark, sf_dir, "pages")))


@query()
def discover_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return H.discover(H.read_pages(pages), pages.where("page_id % 10 = 0").select("page_id"))


HOST = "nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"


@query(f"""WITH h AS (SELECT page_id, url, {HOST} AS host FROM pages)
 SELECT page_id, host, coalesce((host = 'example.org' OR ends_with(host, '.example.org') OR host = 'example.net' OR ends_with(host, '.example.net')) AND NOT regexp_matches(host, '^[0-9.]+$'), false) AS allowed,
  starts_with(url, 'https://') AS secure, sha256(url)[1:20] AS page_key FROM h""")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), H.host_allowed(h, ["example.org", "example.net"]).alias("allowed"), F.col("url").startswith("https://").alias("secure"), H.page_key(F.col("url")).alias("page_key"))


@query(f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), s AS (SELECT unnest(['example.org', 'm.example.org', 'example.com', 'org']) AS domain, unnest(['o', 'mo', 'c', 'tld']) AS source_id, unnest([1, 0, 2, 3]) AS file_order)
 SELECT page_id, host, arg_min(source_id, file_order) AS source_id FROM h JOIN s ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id, host""")
def source_for_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("example.org", "o", 1), ("m.example.org", "mo", 0), ("example.com", "c", 2), ("org", "tld", 3)], "domain string, source_id string, file_order int")
    return L.for_host(table(spark, sf_dir, "pages").select("page_id", H.host(F.col("url")).alias("host")), "host", sources)


RULES = [("french", ("/fr/",), ()), ("english", ("/en/",), ()), ("mobile", (), ("m.",))]


@query(f"""WITH h AS (SELECT page_id, lower(url) AS u, {HOST} AS host FROM pages)
 SELECT page_id, CASE WHEN contains(u, '/fr/') THEN 'french' WHEN contains(u, '/en/') THEN 'english' WHEN contains(host, 'm.') THEN 'mobile' ELSE 'unknown' END AS page_type FROM h""")
def page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.page_type(F.col("url"), H.host(F.col("url")), RULES).alias("page_type"))


ERRORS = "CASE event_id % 9 WHEN 0 THEN 'Read timed out' WHEN 1 THEN 'DNS failure' WHEN 2 THEN 'redirect to https://perfdrive.example/x refused' WHEN 3 THEN 'parsed to nothing' WHEN 4 THEN 'render failed' WHEN 5 THEN 'HTTP 403' WHEN 6 THEN 'bot protection' WHEN 7 THEN 'redirect to https://new.example refused' END"


@query(f"""WITH e AS (SELECT event_id, {ERRORS} AS error FROM events)
 SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'dns' WHEN 2 THEN 'bot_wall' WHEN 3 THEN 'parser_failure' WHEN 4 THEN 'render_failure' WHEN 5 THEN 'forbidden' WHEN 6 THEN 'bot_wall' WHEN 7 THEN 'redirect_change' ELSE CASE WHEN event_id % 2 = 0 THEN 'http_error' ELSE 'unknown' END END AS kind,
  CASE WHEN event_id % 9 = 2 THEN 'blocked' ELSE 'unavailable' END AS health, CASE event_id % 9 WHEN 2 THEN 'bot protection' WHEN 7 THEN 'rebrand candidate' ELSE '' END AS note FROM e""")
def incident_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(ERRORS).alias("error"))
    r = D.refusal(F.col("error"))
    return e.select("event_id", P.incident_kind(F.col("error"), F.when(F.col("event_id") % 2 == 0, 500).otherwise(0)).alias("kind"), r["health"].alias("health"), r["note"].alias("note"))


# ------------------------------------------------------------------ telemetry


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("avg", "p50", "p95", "max")])


TRACES = ["user_id % 20 AS model", "event_type = 'error' AS rate_limited", "event_id % 13 = 0 AS empty_answer", "CAST(event_id % 36 AS DOUBLE) AS retry_after", "CASE WHEN event_id % 3 = 0 THEN 'ollama' ELSE 'hosted' END AS provider", "event_id % 7 AS claims_generated", "(event_id % 7) // 2 AS claims_supported", "CAST(event_id % 5 AS DOUBLE) AS claim_validation_time"]


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[c.replace("//", "div") for c in TRACES])


@query(f"""WITH t AS (SELECT {", ".join(TRACES)} FROM events) SELECT model, count(*) AS answers, count(*) FILTER (rate_limited) AS rate_limit_count, round(count(*) FILTER (rate_limited) / count(*), 6) AS rate_limit_share,
 coalesce(sum(retry_after) FILTER (rate_limited), 0) AS rate_limit_wait_total, coalesce(max(retry_after) FILTER (rate_limited), 0) AS rate_limit_wait_max, count(*) FILTER (provider = 'ollama') AS fallback_count, count(*) FILTER (empty_answer AND NOT rate_limited) AS empty_answers FROM t GROUP BY model""")
def provider_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.provider_health(traces(spark, sf_dir), "model").withColumn("rate_limit_share", F.round("rate_limit_share", 6))


@query(f"""WITH t AS (SELECT {", ".join(TRACES)} FROM events) SELECT model, count(*) AS answers_checked, quantile_cont(claim_validation_time, 0.5) AS validation_p50, CAST(sum(claims_generated) AS BIGINT) AS claims_generated, CAST(sum(claims_supported) AS BIGINT) AS claims_supported,
 round(CASE WHEN sum(claims_generated) > 0 THEN sum(claims_supported) / sum(claims_generated) ELSE 1 END, 6) AS supported_claim_ratio FROM t WHERE claims_generated > 0 OR claim_validation_time > 0 GROUP BY model""")
def claim_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.claim_health(traces(spark, sf_dir), "model").withColumn("supported_claim_ratio", F.round("supported_claim_ratio", 6))


@query("""SELECT k.event_type, count(e.event_id) AS n FROM (SELECT unnest(['click', 'view', 'refund', 'error']) AS event_type) k LEFT JOIN events e USING (event_type) GROUP BY 1""")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.event_counts(table(spark, sf_dir, "events"), ["click", "view", "refund", "error"], "event_type")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 5 < 4 THEN (length(text) / 20.0) <= CASE conv_id % 5 WHEN 0 THEN 5.0 WHEN 1 THEN 10.0 WHEN 2 THEN 15.0 ELSE 30.0 END END AS in_time FROM conversations""")
def within_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE conv_id % 5 WHEN 0 THEN 'micro' WHEN 1 THEN 'standard' WHEN 2 THEN 'procedural' WHEN 3 THEN 'complex' ELSE 'other' END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.within_target(kind, F.length("text") / 20.0).alias("in_time"))


STATES = ("failed", "blocked", "not_observed", "fixture_verified", "mechanism_verified", "production_verified")
STATE = lambda e: f"CASE {e} " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"


@query(f"""WITH s AS (SELECT p_partkey AS capability, {STATE("p_size % 6")} AS a, {STATE("(p_size * 7 + p_partkey) % 6")} AS b FROM part), r AS (SELECT unnest([{quoted(STATES)}]) AS s, unnest([0, 0, 1, 2, 3, 4]) AS k)
 SELECT capability, a AS previous_status, b AS new_status, CASE WHEN y.k > x.k THEN CASE WHEN x.k = 0 THEN 'recovered' ELSE 'improved' END WHEN y.k < x.k THEN 'degraded' ELSE 'changed' END AS direction,
  (a IN ('production_verified', 'mechanism_verified') AND b NOT IN ('production_verified', 'mechanism_verified')) OR (a = 'production_verified' AND b = 'mechanism_verified') AS regression
 FROM s JOIN r x ON x.s = a JOIN r y ON y.s = b WHERE a <> b""")
def capability_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return T.transitions(p.selectExpr("p_partkey AS capability", STATE("p_size % 6") + " AS status"), p.selectExpr("p_partkey AS capability", STATE("(p_size * 7 + p_partkey) % 6") + " AS status"))


@query("""WITH t AS (SELECT n_name AS topic, n_nationkey AS k FROM nation), s AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal > 0 AS live FROM supplier)
 SELECT topic, count(s_suppkey) AS sources, count(*) FILTER (live) AS live, CASE WHEN count(s_suppkey) = 0 OR count(*) FILTER (live) = 0 THEN 'missing' WHEN count(*) FILTER (live) = count(s_suppkey) THEN 'complete' ELSE 'partial' END AS status FROM t LEFT JOIN s USING (k) GROUP BY topic""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("topic"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("source_id"), (F.col("s_acctbal") > 0).alias("live"))
    return T.coverage(n.select("topic"), s.join(n, "k").select("topic", "source_id", "live"))


@query("""WITH r AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_suppkey % 5 AS a, l_partkey % 5 AS b FROM lineitem),
 t AS (SELECT q, list(a ORDER BY k) AS a, list(b ORDER BY k) AS b FROM r WHERE k <= 3 GROUP BY q)
 SELECT q, list_sort(a) = list_sort(b) AS same_set, a = b AS same_order, a[1] = b[1] AS same_top, len(list_intersect(list_distinct(a), list_distinct(b))) AS shared, len(list_distinct(list_concat(a, b))) AS either FROM t""")
def retrieval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), k.alias("k"), (F.col("l_suppkey") % 5).alias("a"), (F.col("l_partkey") % 5).alias("b"))
    both = r.select("q", "k", F.lit("fr").alias("v"), F.col("a").alias("item")).unionByName(r.select("q", "k", F.lit("en").alias("v"), F.col("b").alias("item")))
    return T.agreement(both, "q", "v", "fr", "en", "k", "item").select("q", "same_set", "same_order", "same_top", F.col("shared").cast("long").alias("shared"), F.col("either").cast("long").alias("either"))


@query("""SELECT o_orderkey, concat('BUG-', strftime(o_orderdate, '%Y%m%d'), '-', lpad(CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS VARCHAR), 3, '0')) AS report_id FROM orders""")
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "report_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 8 OR k <= 6""")
def bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bounded(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 8, 6, "user_id").select("user_id", "event_id")


# ------------------------------------------------------------------ decisions


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS refused FROM orders) SELECT k, CASE WHEN k % 11 = 0 THEN 'needs_clarification' WHEN k % 13 = 0 THEN 'conflicting_sources' WHEN k % 3 = 0 AND k % 7 = 0 THEN 'authority_unavailable' WHEN k % 5 = 0 THEN 'stale'
 WHEN NOT refused THEN CASE WHEN k % 17 = 0 THEN 'partial' WHEN k % 4 > 0 THEN 'supported' ELSE 'partial' END WHEN k % 3 = 0 THEN 'source_gap' WHEN k % 19 = 0 THEN 'wrong_source_type' WHEN k % 23 = 0 THEN 'retrieval_failure' ELSE 'not_found' END AS state FROM c""")
def answerability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    every = lambda n: k % n == 0
    c = {
        "needs_clarification": every(11), "conflicts": every(13).cast("int"), "authority_known": every(3), "authority_reachable": ~every(7), "stale": every(5), "refused": every(2),
        "missing_required": every(17), "citations": k % 4, "has_institution": every(19), "retrieved_anything": ~every(23),
    }
    return table(spark, sf_dir, "orders").select(k.alias("k"), D.answerability(c).alias("state"))


@query("""WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'healthy' WHEN 2 THEN 'stale' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'changed' ELSE 'unknown' END AS health, s_suppkey % 5 > 0 AS verified, s_acctbal > 0 AS stored, s_nationkey % 4 AS level FROM supplier)
 SELECT k, CASE WHEN health IN ('blocked', 'unavailable') THEN CASE WHEN stored THEN 'cached_only' ELSE 'unavailable' END WHEN NOT verified THEN 'unavailable' WHEN health IN ('healthy', 'stale', 'changed') AND level <= 2 AND stored THEN 'live_query' ELSE 'sync_only' END AS mode,
  (NOT verified)::INT + (health NOT IN ('healthy', 'stale', 'changed'))::INT + (level > 2)::INT + (NOT stored)::INT AS failed FROM s""")
def source_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = F.expr("CASE s_suppkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'healthy' WHEN 2 THEN 'stale' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'changed' ELSE 'unknown' END")
    yes = F.lit(True)
    p = D.promotion(health, F.col("s_suppkey") % 5 > 0, yes, F.col("s_nationkey") % 4, yes, yes, F.col("s_acctbal") > 0)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), p.alias("p")).select("k", "p.mode", F.size("p.failed").alias("failed"))


REPLIES = "CASE event_id % 6 WHEN 0 THEN 'Yes, it does.' WHEN 1 THEN ' **NO**' WHEN 2 THEN 'I think yes' WHEN 3 THEN 'no or yes' WHEN 4 THEN '' ELSE 'Please try again in 1m30.5s' END"


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS verdict, CASE WHEN event_id % 6 = 5 THEN 90.5 ELSE 10.0 END AS wait FROM events""")
def verdict_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.expr(REPLIES)
    return table(spark, sf_dir, "events").select("event_id", D.read_verdict(r).alias("verdict"), D.retry_after(r).alias("wait"))


FOLLOW = "CASE turn % 4 WHEN 0 THEN concat('And ', text) WHEN 2 THEN 'What documents do I need?' ELSE text END"


@query(f"""WITH q AS (SELECT conv_id, turn, {FOLLOW} AS asked, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user'),
 t AS (SELECT *, len(list_filter({TOKENS.replace("text", "asked")}, lambda w: w NOT IN ({quoted(D.GENERIC)}))) AS own FROM q),
 f AS (SELECT *, trim(asked) <> '' AND coalesce(previous, '') <> '' AND (own = 0 OR {" OR ".join(f"starts_with(lower(trim(asked)), '{w}')" for w in D.ELLIPTICAL)}) AS follows FROM t)
 SELECT conv_id, turn, follows, md5(CASE WHEN follows THEN concat(trim(previous), ' — ', trim(asked)) ELSE trim(asked) END) AS question FROM f""")
def followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(FOLLOW).alias("asked"), F.lag("text").over(w).alias("previous"))
    return q.select("conv_id", "turn", D.is_followup(F.col("asked"), F.col("previous")).alias("follows"), F.md5(D.followup(F.col("asked"), F.col("previous")).cast("binary")).alias("question"))


PURPOSES = {"housing": ("room", "residence permit", "flat"), "money": ("price", "fee", "cost"), "order": ("order", "ship mode", "carton box")}
P_TEXT = "concat(p_name, ' ', p_type, CASE p_partkey % 4 WHEN 0 THEN ' ship-mode fee' WHEN 1 THEN ' the price and cost of a carton_box order' WHEN 2 THEN ' flat' ELSE '' END)"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'order,money' WHEN 1 THEN 'order,money' WHEN 2 THEN 'housing' ELSE '' END AS purposes FROM part""")
def purpose_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(D.purposes(F.expr(P_TEXT), PURPOSES), ",").alias("purposes"))


@query("""WITH h AS (SELECT o_custkey AS query, o_orderkey % 4 AS page, o_orderkey % 3 AS section, o_orderpriority <> '1-URGENT' AS ok, o_orderkey AS k FROM orders),
 w AS (SELECT *, row_number() OVER (PARTITION BY query, page, section, ok ORDER BY k) AS n FROM h),
 m AS (SELECT *, coalesce(sum((ok AND n = 1)::INT) OVER (PARTITION BY query, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM w),
 s AS (SELECT *, coalesce(max((ok AND n = 1 AND taken < 2)::INT) OVER (PARTITION BY query, page, section ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM m)
 SELECT query, k, page, CASE WHEN seen = 1 THEN 'duplicate' WHEN taken >= 2 THEN 'page_full' WHEN NOT ok THEN 'irrelevant' END AS reason FROM s""")
def relevance_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS query", "o_orderkey % 4 AS page", "o_orderkey % 3 AS section", "o_orderpriority <> '1-URGENT' AS ok", "o_orderkey AS k")
    return R.select_relevant(h, "page", "section", "ok", "k", 2).select("query", "k", "page", "reason")


# ------------------------------------------------------------------ lookups


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.translate("n_name", "_", "-").alias("name"), F.col("n_regionkey").cast("string").alias("department"))
    twice = n.where("department = '1'").select("name", F.lit("9").alias("department"))
    return n.unionByName(twice).withColumn("key", fold_hyphen(F.col("name")))


@query("""SELECT c_custkey, replace(n_name, '_', '-') AS place, CASE WHEN n_regionkey = 1 THEN '1,9' ELSE CAST(n_regionkey AS VARCHAR) END AS candidates, n_regionkey = 1 AS ambiguous FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2""")
def resolve_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('I live in ', lower(translate(n_name, '_', '-')), ' now') WHEN 1 THEN concat('My town, ', translate(n_name, '_', '-'), '?') ELSE 'nowhere at all' END")
    out = L.resolve_places(c.select("c_custkey", text.alias("text")), "c_custkey", "text", _gazetteer(spark, sf_dir))
    return out.withColumn("candidates", F.array_join("candidates", ","))


ALIASES = "a AS (SELECT unnest(['metal', 'blue', 'dark red', 'red', 'lime']) AS alias, unnest(['t1', 't2', 't3', 't4', 't5']) AS term)"


@query(f"""WITH {ALIASES}, x AS (SELECT p_partkey, concat(' ', trim(regexp_replace(strip_accents(lower(concat(p_name, ' dark-red ', p_type))), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' ') AS f FROM part)
 SELECT p_partkey, term, alias FROM x JOIN a ON contains(f, concat(' ', alias, ' '))""")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("metal", "t1"), ("blue", "t2"), ("dark red", "t3"), ("red", "t4"), ("lime", "t5")], "alias string, term string")
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", F.concat_ws(" dark-red ", "p_name", "p_type").alias("text"))
    return L.find_terms(p, "p_partkey", "text", aliases)


@query("""WITH q AS (SELECT unnest(['customer#00000001', 'AB', '7', 'building']) AS query), r AS (SELECT c_name AS name, lower(c_name) AS n, CASE WHEN c_custkey % 10 = 0 THEN 'ab' ELSE '' END AS a, lower(c_mktsegment) AS more FROM customer),
 m AS (SELECT query, lower(query) AS d, * FROM q, r WHERE length(query) >= 2), t AS (SELECT query, name, n, CASE WHEN n = d OR a = d THEN 0 WHEN starts_with(n, d) THEN 1 WHEN starts_with(a, d) THEN 2 WHEN contains(n, d) THEN 3 ELSE 4 END AS tier FROM m WHERE contains(n, d) OR starts_with(a, d) OR contains(more, d))
 SELECT query, rank, name, tier FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, length(name), n, name) AS rank FROM t) WHERE rank <= 10""")
def institution_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([("customer#00000001",), ("AB",), ("7",), ("building",)], "query string")
    r = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 10 == 0, "AB").otherwise("").alias("acronym"), F.array().cast("array<string>").alias("aliases"), F.col("c_mktsegment").alias("commune"))
    return L.search_institutions(q, r)


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN 'national' WHEN 1 THEN 'department' WHEN 2 THEN 'city' ELSE 'other' END AS j, s_suppkey % 3 AS a FROM supplier)
 SELECT s_nationkey AS topic, arg_min(s_suppkey, (CASE j WHEN 'city' THEN 1 WHEN 'department' THEN 2 WHEN 'national' THEN 4 ELSE 9 END, a, s_suppkey)) AS source_id FROM s GROUP BY 1""")
def most_specific_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS source_id", "s_suppkey AS file_order", "s_nationkey AS topic", "CASE s_suppkey % 4 WHEN 0 THEN 'national' WHEN 1 THEN 'department' WHEN 2 THEN 'city' ELSE 'other' END AS jurisdiction", "s_suppkey % 3 AS authority_level")
    return L.most_specific(s, "topic").select("topic", "source_id")


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS e, s_suppkey % 10 AS d, s_suppkey % 4 AS t, CASE WHEN s_suppkey % 3 = 0 THEN 'national' ELSE 'department' END AS j FROM supplier WHERE s_acctbal > 0), q AS (SELECT c_custkey AS q, c_custkey % 4 AS t, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END AS e, c_custkey % 10 AS d, c_custkey % 2 = 0 AS w FROM customer),
 x AS (SELECT q, id, 1 AS p FROM q JOIN s ON q.e = s.e UNION ALL SELECT q, id, 2 FROM q JOIN s ON q.d = s.d AND q.t = s.t WHERE w UNION ALL SELECT q, id, 3 FROM q JOIN s ON q.t = s.t AND j = 'national'), o AS (SELECT q, id, min(p) AS p FROM x GROUP BY q, id)
 SELECT q AS question, row_number() OVER (PARTITION BY q ORDER BY p, id) AS step, id AS source_id, CASE p WHEN 1 THEN 'institution' WHEN 2 THEN 'local authority' ELSE 'national' END AS reason FROM o""")
def routing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS source_id", "s_nationkey AS entity", "s_suppkey % 10 AS department", "array(s_suppkey % 4) AS topics", "CASE WHEN s_suppkey % 3 = 0 THEN 'national' ELSE 'department' END AS jurisdiction", "CASE WHEN s_acctbal > 0 THEN 'live_query' ELSE 'unavailable' END AS mode", "s_suppkey AS file_order")
    q = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).selectExpr("c_custkey AS question", "c_custkey % 4 AS topic", "CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END AS institution", "c_custkey % 10 AS department", "c_custkey % 2 = 0 AS wants_local")
    return L.route(q, s)


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN concat('inst', length(text) % 7) END AS named FROM conversations) SELECT conv_id, turn, last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_context FROM t""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE WHEN length(text) % 3 = 0 THEN concat('inst', length(text) % 7) END AS named")
    return L.carry_forward(t, "conv_id", "turn", "named").select("conv_id", "turn", "in_context")


# ------------------------------------------------------------------ claim checks

ANSWER = "CASE o_orderkey % 6 WHEN 0 THEN concat('You must apply within ', 1 + o_orderkey % 9, ' months after arrival.') WHEN 1 THEN concat('The fee is ', 100 + o_orderkey % 90, ' euros.') WHEN 2 THEN 'Contact the CAF, which handles it.' WHEN 3 THEN 'Bring your passport and a photo.' WHEN 4 THEN concat('It opens on ', 1 + o_orderkey % 28, ' July ', 2020 + o_orderkey % 6, '.') ELSE 'Thank you:' END"


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(1 + o_orderkey % 9, ' month') ELSE '' END AS quantities, CASE o_orderkey % 6 WHEN 1 THEN CAST(100 + o_orderkey % 90 AS VARCHAR) ELSE '' END AS amounts,
 CASE o_orderkey % 6 WHEN 4 THEN concat(2020 + o_orderkey % 6, '-07-', lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0')) ELSE '' END AS dates, CASE WHEN o_orderkey % 6 = 2 THEN 'CAF' ELSE '' END AS entities, CASE WHEN o_orderkey % 6 = 0 THEN 'after_arrival' ELSE '' END AS anchors,
 CASE o_orderkey % 6 WHEN 0 THEN 'deadline' WHEN 1 THEN 'fee' WHEN 2 THEN 'authority' WHEN 3 THEN 'document' WHEN 4 THEN 'date' ELSE 'non_factual' END AS type FROM orders""")
def claim_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X_.with_facts(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(ANSWER).alias("t")), "t")
    return rows.select("o_orderkey", *[F.array_join(F.col("f")[c], ",").alias(c) for c in ("quantities", "amounts", "dates", "entities", "anchors")], F.col("f.type").alias("type"))


# An answer for each customer: its claims come from the customer's orders, its evidence from the customer's number n. The national page
# gives a fee, a local one contests it for odd n, and a page about renewal has a deadline of its own.
CLAIMS = ("concat('You must apply within ', 1 + c_custkey % 9, ' months after your arrival.')", "concat('You must apply within ', 41 + c_custkey % 9, ' months after your arrival.')", "concat('The fee is ', 100 + c_custkey % 90, ' euros for adults.')", "'Bring your passport and a photo to the office.'", "'Contact the CAF, which handles it.'", "'Thank you:'", "'Renew the permit 11 months before it expires.'", "'The weather is usually fine in spring.'")
CLAIM_OF = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(CLAIMS)) + " END"
ASKS = "CASE WHEN c_custkey % 4 = 0 THEN 'How do I validate my long-stay visa?' WHEN c_custkey % 4 = 1 THEN 'How do I renew it?' ELSE 'What do I need?' END"
PAGES = {
    "national": ("'Rules for newcomers'", "concat('You must apply within ', 1 + c_custkey % 9, ' months after your arrival in France.', chr(10), 'The fee is ', 100 + c_custkey % 90, ' euros for adults.', chr(10), 'Bring your passport and a photo to the office.')", "''"),
    "local": ("'Counter'", "concat('The fee is ', 100 + c_custkey % 90 + 5 * (c_custkey % 2), ' euros for adults.')", "'Isere'"),
    "renewal": ("'Renewal of a permit'", "'Renew the permit 11 months before it expires.'", "''"),
}
#: What becomes of each claim, by its kind k and the customer's number n.
EXPECTED = """CASE k WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN CASE WHEN n % 2 = 0 THEN 'supported' ELSE 'contradicted' END WHEN 3 THEN 'supported' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'not_checked'
 WHEN 6 THEN CASE WHEN n % 4 = 0 THEN 'contradicted' ELSE 'supported' END ELSE 'unsupported' END"""
JUDGED = f"""o AS (SELECT c_custkey AS answer, c_custkey AS n, o_orderkey, o_orderkey % 8 AS k, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS claim_no FROM orders JOIN customer ON o_custkey = c_custkey),
 j AS (SELECT *, {EXPECTED} AS support FROM o)"""


def drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Answers of customers with orders, a claim a line, and the evidence of each."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    line = table(spark, sf_dir, "orders").join(c.hint("shuffle_merge"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", F.expr(CLAIM_OF).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    answers = line.groupBy("c_custkey").agg(text.alias("text")).select(F.col("c_custkey").alias("answer"), "text", F.expr(ASKS).alias("question"), F.lit(None).cast("date").alias("on"), F.lit("Isère").alias("place"))
    page = lambda name: F.struct(F.lit(name).alias("source_id"), *[F.expr(e).alias(n) for n, e in zip(("title", "text", "area"), PAGES[name], strict=True)])
    pages = c.select(F.col("c_custkey").alias("answer"), F.explode(F.array(*map(page, PAGES))).alias("p")).select("answer", "p.*")
    url = F.concat(F.lit("https://"), "source_id", F.lit(".example/page"))
    return answers, pages.withColumns({"url": url, "canonical_url": url, "version_id": F.lit("v1"), "is_local": F.col("area") != ""})


@query(f"WITH {JUDGED} SELECT answer, claim_no, support, CASE WHEN support IN ('supported', 'not_checked') THEN 'kept' ELSE 'removed' END AS action FROM j")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.judge(*drafts(spark, sf_dir)).select("answer", F.col("claim_no").cast("long").alias("claim_no"), "support", "action")


@query(f"""WITH {JUDGED} SELECT answer, count(*) FILTER (k <> 5) AS generated, count(*) FILTER (support = 'supported') AS supported, count(*) FILTER (support IN ('unsupported', 'contradicted')) AS removed, count(*) FILTER (support = 'contradicted') AS contradicted,
 count(*) FILTER (k <> 5) > 0 AND count(*) FILTER (support = 'supported') = 0 AS needs_repair, coalesce(bool_or(k = 2 AND n % 2 = 1), false) AS conflicting FROM j GROUP BY answer""")
def answer_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validation(V.judge(*drafts(spark, sf_dir))).drop("ratio")


@query(f"""WITH {JUDGED}, t AS (SELECT *, CASE k WHEN 0 THEN concat('You must apply within ', 1 + n % 9, ' months after your arrival.') WHEN 2 THEN concat('The fee is ', 100 + n % 90, ' euros for adults.') WHEN 3 THEN 'Bring your passport and a photo to the office.' WHEN 5 THEN 'Thank you:' ELSE 'Renew the permit 11 months before it expires.' END AS line FROM j),
 s AS (SELECT answer, bool_or(support = 'supported') OR NOT bool_or(k <> 5) AS whole FROM t GROUP BY answer)
 SELECT s.answer, CASE WHEN whole THEN coalesce(string_agg(line, chr(10) ORDER BY claim_no) FILTER (support IN ('supported', 'not_checked')), '') ELSE '' END AS text FROM s JOIN t USING (answer) GROUP BY s.answer, whole""")
def checked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reassemble(V.judge(*drafts(spark, sf_dir)))


@query(f"""WITH {JUDGED}, s AS (SELECT answer, n, NOT bool_or(support = 'supported') AND bool_or(k <> 5) AS bad FROM j GROUP BY answer, n)
 SELECT answer, (bad AND n % 3 > 0)::INT AS repairs, bad AND n % 3 <> 1 AS needs_repair FROM s""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One second draft at most (D9): by the customer's number none, a good one, or another bad one."""
    answers, pages = drafts(spark, sf_dir)
    second = F.expr(f"CASE answer % 3 WHEN 1 THEN {CLAIMS[3]} WHEN 2 THEN {CLAIMS[4]} END")
    return V.check_and_repair(answers.withColumn("second", second), pages).select("answer", "repairs", "needs_repair")


@query("SELECT c_custkey AS answer, unnest(['local', 'national', 'renewal']) AS source_id, NOT (c_custkey % 4 = 0 AND unnest([false, false, true])) AS offered FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey")
def evidence_by_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers, pages = drafts(spark, sf_dir)
    return V.by_procedure(pages, answers).select("answer", "source_id", "offered")


@query("""WITH l AS (SELECT o_custkey AS a, o_orderkey AS k, o_orderkey % 3 = 1 AS h, o_orderstatus = 'F' AS kept FROM orders), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY a ORDER BY k) AS g FROM l), m AS (SELECT *, max((kept AND NOT h)::INT) OVER (PARTITION BY a, g) AS alive FROM s)
 SELECT a AS answer, string_agg(concat('line ', k), chr(10) ORDER BY k) AS text FROM m WHERE CASE WHEN h THEN alive = 1 ELSE kept END GROUP BY a""")
def rebuilt_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").selectExpr("o_custkey AS answer", "o_orderkey AS position", "concat('line ', o_orderkey) AS line", "o_orderkey % 3 = 1 AS is_heading", "o_orderstatus = 'F' AS kept")
    return V.rebuild(lines, "answer")


@query()
def clarification_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation"), "turn", F.when(F.col("role") != "user", "ask:location").otherwise("reply").alias("kind"),
        F.when(F.length("text") % 2 == 0, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("message"), (F.length("text") % 3 == 0).alias("answers"),
    )
    return stateful.clarifications(t)


# ------------------------------------------------------------------ publications and reports

XML = """CASE WHEN p_partkey % 17 = 0 THEN concat('<Publication ID="F', p_partkey, '">') WHEN p_partkey % 13 = 0 THEN '<Menu/>' ELSE concat('<Publication xmlns:dc="http://purl.org/dc/elements/1.1/" ID="', CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'N' ELSE 'Z' END, p_partkey, '"><dc:title>', p_name, '</dc:title><dc:date>modified ', CASE WHEN p_partkey % 5 = 0 THEN '0205' ELSE '2024' END, '-05-0', 1 + p_partkey % 9, '</dc:date>
 <Texte><Chapitre><Titre>', p_type, '</Titre><Paragraphe>Le <Valeur>prix</Valeur> est ', p_size, '.</Paragraphe><Liste type="numero"><Item>un</Item><Item>deux</Item></Liste><Inconnu>reste</Inconnu></Chapitre></Texte></Publication>') END"""


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xml")).alias("source_file"), F.lit("part").alias("segment"), F.expr(XML).alias("xml"))
    return X.read_publications(rows)


@query("""SELECT concat(p_partkey, '.xml') AS source_file, CASE WHEN p_partkey % 17 = 0 THEN 'failure' WHEN p_partkey % 13 = 0 THEN 'skipped' ELSE 'document' END AS status,
 CASE WHEN p_partkey % 17 > 0 AND p_partkey % 13 > 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'fiche' WHEN 1 THEN 'dossier' ELSE 'autre' END END AS doc_kind, CASE WHEN p_partkey % 17 > 0 AND p_partkey % 13 > 0 THEN trim(regexp_replace(p_name, '\\s+', ' ', 'g')) END AS title,
 CASE WHEN p_partkey % 17 > 0 AND p_partkey % 13 > 0 THEN p_partkey % 5 > 0 ELSE false END AS plausible FROM part""")
def xml_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _publications(spark, sf_dir).select("source_file", "status", "doc_kind", "title", X.is_plausible(F.col("last_updated"), F.lit("2024-06-01").cast("date")).alias("plausible"))


@query("""SELECT concat(CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'N' ELSE 'Z' END, p_partkey) AS doc_id, 0 AS section, p_type AS title, concat('Le prix est ', p_size, '.', chr(10), chr(10), '1. un', chr(10), '2. deux', chr(10), chr(10), 'reste') AS body FROM part WHERE p_partkey % 17 > 0 AND p_partkey % 13 > 0""")
def xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(_publications(spark, sf_dir)).select("doc_id", "section", "title", "body")


@query("SELECT 'Inconnu' AS tag, count(*) AS n FROM part WHERE p_partkey % 17 > 0 AND p_partkey % 13 > 0")
def xml_unknown_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unknown_tags(_publications(spark, sf_dir))


@query("""WITH h AS (SELECT o_custkey AS answer, o_orderkey AS position FROM orders)
 SELECT answer, string_agg(concat('[', position, '] T', position % 3, ' (p', position % 5, ')', CASE WHEN position % 2 = 0 THEN ' — situation: S' ELSE '' END, chr(10), 'text ', position), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY position) AS passages FROM h GROUP BY answer""")
def passage_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS answer", "o_orderkey AS position", "concat('T', o_orderkey % 3) AS title", "concat('p', o_orderkey % 5) AS page", "CASE WHEN o_orderkey % 2 = 0 THEN 'S' ELSE '' END AS situation", "concat('text ', o_orderkey) AS text")
    return O.passages(h, "answer")


@query("""WITH u AS (SELECT o_custkey AS answer, o_orderkey AS position, o_orderkey % 3 AS k, concat('https://s', o_orderkey % 4, '.gouv.fr/x') AS url FROM orders), f AS (SELECT answer, url, arg_min(position, position) AS position FROM u WHERE k < 2 GROUP BY answer, url)
 SELECT answer, row_number() OVER (PARTITION BY answer ORDER BY position) AS rank, concat('Service ', position) AS title, url FROM f QUALIFY rank <= 3""")
def official_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('Service ', o_orderkey, '\n\n', CASE WHEN o_orderkey % 3 < 2 THEN concat('- https://s', o_orderkey % 4, '.gouv.fr/x.') ELSE 'https://gouv.fr.evil.com/x' END)"
    h = table(spark, sf_dir, "orders").selectExpr("o_custkey AS answer", "o_orderkey AS position", f"{text} AS text")
    return O.service_links(h, "answer", ["gouv.fr"])


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'update date unavailable' WHEN p_size % 4 = 1 THEN 'last updated 0205-01-01 (date as published; appears mistyped)' ELSE 'last updated 2024-01-01' END AS label FROM part""")
def updated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '0205-01-01' ELSE '2024-01-01' END")
    return table(spark, sf_dir, "part").select("p_partkey", O.updated_label(day, X.is_plausible(day, F.lit("2024-06-01").cast("date"))).alias("label"))


@query("""SELECT concat('Bail ', n_nationkey) AS term, concat('r', n_nationkey) AS ref, CASE n_nationkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'unqualified' ELSE 'prefix' END AS how FROM nation""")
def official_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    official = n.selectExpr("n_nationkey AS ord", "concat('r', n_nationkey) AS ref", "concat('bail ', n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (location)' ELSE ' commercial mixte' END) AS title")
    return O.match_official(n.selectExpr("concat('Bail ', n_nationkey) AS term"), official)


@query("""SELECT 'change' AS kind, o_orderkey AS id, o_custkey AS source FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'conflict', s_suppkey, s_nationkey FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'stale_claim', p_partkey, p_size FROM part WHERE p_size < 5
 UNION ALL SELECT 'incident', event_id, user_id FROM events WHERE event_type = 'error'""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key, source, test, status: table(spark, sf_dir, name).selectExpr(f"{key} AS id", f"CAST({source} AS BIGINT) AS source", f"CASE WHEN {test} THEN '{status}' ELSE 'resolved' END AS status")
    return O.review_queue(of("orders", "o_orderkey", "o_custkey", "o_orderstatus = 'O'", "open"), of("supplier", "s_suppkey", "s_nationkey", "s_acctbal < 0", "open"), of("part", "p_partkey", "p_size", "p_size < 5", "stale_pending_review"), of("events", "event_id", "user_id", "event_type = 'error'", "open"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'resolved' ELSE lower(o_orderstatus) END AS status FROM orders""")
def status_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "lower(o_orderstatus) AS status")
    return O.set_status(o, o.where("id % 7 = 0").select("id", F.lit("resolved").alias("status")), "id", ["open", "resolved"])


@query("""WITH c AS (SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM nation) AS pages, 0 AS conflicts)
 SELECT 'log' AS capability, CASE WHEN events >= 100 THEN 'production_verified' ELSE 'mechanism_verified' END AS status, concat(events, ' events') AS evidence FROM c UNION ALL SELECT 'versions', 'mechanism_verified', concat(pages, ' pages') FROM c UNION ALL SELECT 'conflicts', 'not_observed', '0 conflicts'""")
def capability_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, pages = table(spark, sf_dir, "events").agg(F.count("*").alias("events")), table(spark, sf_dir, "nation").agg(F.count("*").alias("pages"))
    counts = events.crossJoin(pages).withColumn("conflicts", F.lit(0))  # one row each
    return O.scorecard(counts, {"log": ("events", 100), "versions": ("pages", 1000), "conflicts": ("conflicts", 1)})


@query("SELECT count(*) AS documents, CAST(CAST(min(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END) AS DATE) AS VARCHAR) AS oldest, CAST(CAST(max(CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END) AS DATE) AS VARCHAR) AS newest FROM orders")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day"), (F.col("o_orderkey") % 3 > 0).alias("ok"))
    return O.corpus_stats(o, "day", "ok")


@query("""WITH p AS (SELECT p_partkey, p_size % 4 AS d, p_partkey % 5 AS k FROM part)
 SELECT p_partkey, round(CASE k WHEN 0 THEN 4.0 + 3.0 + 6.0 WHEN 1 THEN 8.0 + 2.0 WHEN 2 THEN -8.0 WHEN 3 THEN -1.0 ELSE 0 END + CASE k WHEN 4 THEN -1.0 ELSE 1.0 END + CASE WHEN k < 2 THEN 0.5 ELSE 0 END + CASE WHEN d <= 1 THEN 0 WHEN d = 2 THEN -0.5 ELSE -2 END, 3)::DOUBLE AS score FROM p""")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("d"), (F.col("p_partkey") % 5).alias("k"))
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") + 1).cast("int"))
    path = pick("/fr/visa/page", "/fr/page", "/news/x", "/portal", "/a/b/c/d/e/f/g")
    anchor, title = pick("Visa", "titre de séjour", "", "", ""), pick("", "", "", "", "")
    kind = pick("fees", "requirements", "news", "application_portal", "unknown")
    score = D.candidate_score(path, anchor, title, kind, F.col("d"), ("visa", "titre de sejour"), ("fees",), ("news",), "fr")
    return p.select("p_partkey", F.round(score, 3).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN concat('T', o_orderkey) END AS title, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS steps, CASE WHEN o_orderkey % 3 = 2 THEN 'the model did not return readable JSON' END AS error,
 concat('[BUGS][', CASE WHEN o_orderkey % 3 < 2 THEN 'HIGH' ELSE 'UNTRIAGED' END, '] BUG-', o_orderkey, ' — ', CASE WHEN o_orderkey % 3 < 2 THEN concat('T', o_orderkey) ELSE 'New report' END) AS subject FROM orders""")
def bug_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('```json\n{"title": "T', o_orderkey, '", "severity": "high", "reproduction_steps": ["a", "b"], "other": 1}\n```') WHEN 1 THEN concat('{"title": "T', o_orderkey, '", "severity": "High", "reproduction_steps": []}') ELSE 'Sorry, no.' END""")
    t = table(spark, sf_dir, "orders").select("o_orderkey", D.read_triage(reply).alias("t"), D.triage_error(reply).alias("error"))
    subject = D.subject(F.col("t.severity"), F.concat(F.lit("BUG-"), F.col("o_orderkey").cast("string")), F.col("t.title"), "BUGS")
    return t.select("o_orderkey", "t.title", F.when(F.col("t").isNotNull(), F.size("t.reproduction_steps")).alias("steps"), "error", subject.alias("subject"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Bonjour' WHEN 1 THEN 'Bye' ELSE 'missing' END AS text FROM nation""")
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = spark.createDataFrame([("fr", "hi", "Bonjour"), ("en", "hi", "Hello"), ("en", "bye", "Bye"), ("fr", "bye", "")], "language string, key string, text string")
    rows = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "'fr' AS language", "CASE n_nationkey % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'bye' ELSE 'missing' END AS key")
    return D.translate(strings, rows, "language", "key").select("n_nationkey", "text")


@query("""WITH a AS (SELECT c_custkey AS answer, CASE WHEN c_custkey % 3 = 0 THEN concat('s', c_custkey % 10) END AS entity, CASE WHEN c_custkey % 4 = 0 THEN 'a1' END AS area, CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS conflicts FROM customer),
 e AS (SELECT o_custkey AS answer, count(*) FILTER (o_orderkey % 31 = 0) AS untraced, list(concat('s', o_orderkey % 10)) AS cited, list(CASE o_orderkey % 3 WHEN 0 THEN 'a1' WHEN 1 THEN 'a2' END) AS areas, count(*) FILTER (o_orderkey % 19 = 0) AS old FROM orders GROUP BY 1),
 c AS (SELECT o_custkey AS answer, count(*) FILTER (o_orderdate > TIMESTAMP '1998-06-01') AS lapsed FROM orders GROUP BY 1)
 SELECT answer, array_to_string(list_filter([CASE WHEN coalesce(untraced, 0) > 0 THEN 'provenance' END, CASE WHEN entity IS NOT NULL AND NOT coalesce(list_contains(cited, entity), false) THEN 'entity' END, CASE WHEN area IS NOT NULL AND coalesce(list_contains(areas, 'a2'), false) THEN 'jurisdiction' END,
  CASE WHEN coalesce(lapsed, 0) > 0 THEN 'effective_dates' END, CASE WHEN coalesce(old, 0) > 0 THEN 'freshness' END, CASE WHEN conflicts > 0 THEN 'conflicts' END], lambda x: x IS NOT NULL), ',') AS failures FROM a LEFT JOIN e USING (answer) LEFT JOIN c USING (answer)""")
def evidence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    answers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS answer", "CASE WHEN c_custkey % 3 = 0 THEN concat('s', c_custkey % 10) END AS entity", "CASE WHEN c_custkey % 4 = 0 THEN 'a1' END AS area", "CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS conflicts")
    evidence = o.selectExpr("o_custkey AS answer", "concat('s', o_orderkey % 10) AS source_id", "CASE o_orderkey % 3 WHEN 0 THEN 'a1' WHEN 1 THEN 'a2' ELSE '' END AS area", "o_orderkey % 31 > 0 AS traceable", "o_orderkey % 19 = 0 AS stale")
    claims = o.selectExpr("o_custkey AS answer", "date_add(CAST(o_orderdate AS DATE), CASE WHEN o_orderdate > TIMESTAMP'1998-06-01 00:00:00' THEN 40000 ELSE 0 END) AS effective_from", "CAST(NULL AS DATE) AS effective_until")
    got = V.validate_evidence(answers, evidence, claims, F.lit("2024-01-01").cast("date"))
    return got.select("answer", F.array_join("failures", ",").alias("failures"))


@query("""SELECT s_suppkey, concat('s', s_nationkey) AS source_id, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 3 > 0 THEN 'stale_pending_review' WHEN s_suppkey % 3 = 0 THEN 'superseded' ELSE 'current' END AS status FROM supplier""")
def claims_marked_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.operators import claims as C

    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "concat('s', s_nationkey) AS source_id", "concat('c', s_suppkey) AS claim_id", "CASE WHEN s_suppkey % 3 = 0 THEN 'superseded' ELSE 'current' END AS status")
    return C.mark_stale(s, s.where("s_suppkey % 4 = 0")).select("s_suppkey", "source_id", "status")


@query("""WITH i AS (SELECT n_nationkey, lower(replace(n_name, '_', '-')) AS slug FROM nation) SELECT n_nationkey, slug AS source_id FROM i WHERE n_nationkey % 2 = 0""")
def institution_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    register = n.select("n_nationkey", F.concat(F.lit("École "), F.translate("n_name", "_", " ")).alias("name"), F.col("n_name").alias("acronym"))
    sources = n.where("n_nationkey % 2 = 0").select(L.slug(F.col("n_name")).alias("source_id"))
    return L.by_slug(register, sources).select("n_nationkey", "source_id")


@query("""WITH q AS (SELECT conv_id, turn, length(text) AS n FROM conversations), v AS (SELECT DISTINCT conv_id % 50 AS k FROM conversations WHERE conv_id % 3 = 0)
 SELECT conv_id, turn, conv_id % 50 IN (SELECT k FROM v) AS cached FROM q""")
def verdict_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda q, c: D.verdict_key(q, F.array(c, F.lit("z")))
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", key(F.concat(F.lit("Où "), (F.col("conv_id") % 50).cast("string")), F.lit("a")).alias("key"))
    stored = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(key(F.concat(F.lit("ou, "), (F.col("conv_id") % 50).cast("string")), F.lit("a")).alias("key"), F.lit(True).alias("hit")).distinct()
    return q.join(stored, "key", "left").select("conv_id", "turn", F.coalesce("hit", F.lit(False)).alias("cached"))
