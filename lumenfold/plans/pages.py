"""Queries over versioned pages, claims and conflicts, and their SQL.

The driver's tables hold no official pages, so notices are made from ``orders`` by rule: a customer is a
page, an order is a version of it, and the order's number picks the figures in its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import dates as D
from lumenfold.functions.text import plain
from lumenfold.operators import claims as C
from lumenfold.operators import pages as P
from lumenfold.plans.retrieval import ANY, SQUEEZE
from lumenfold.plans.tables import quoted, spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TEXT = """concat('Le délai de traitement est de ', 1 + o_orderkey % 6, ' mois pour le dossier numéro ', o_orderkey % 3, chr(10),
 'Joindre un justificatif de domicile et le formulaire cerfa ', o_orderkey % 4, chr(10),
 'Les frais sont de ', 10 * (o_orderkey % 5), ' euros à compter du 1er juillet ', 2020 + o_orderkey % 6, chr(10), 'Voir https://site', o_custkey % 7, '.example/', o_orderkey % 2, chr(10), 'Bienvenue sur cette page ', o_orderkey)"""
COLUMNS = ["o_orderkey AS version_id", "o_custkey AS page_id", "concat('s', o_custkey % 10) AS source_id", "o_orderdate AS retrieved_at", f"{TEXT} AS text", "concat('Page ', o_orderstatus) AS title", "concat('h', o_orderkey % 4) AS content_hash"]
NOTICES = "n AS (SELECT " + ", ".join(COLUMNS) + " FROM orders)"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")).selectExpr(*COLUMNS)


FOLDED = lambda e: SQUEEZE(f"strip_accents(lower({e}))")
SIGNAL = lambda t: f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: {FOLDED('l')}), lambda l: len(string_split(l, ' ')) >= 3 AND {ANY('l', P.SIGNALS)})"
EXCEPT = lambda a, b: f"list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"


@query(f"WITH {NOTICES} SELECT version_id, array_to_string(list_sort(list_distinct({SIGNAL('text')})), '/') AS signals FROM n")
def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("version_id", F.array_join(F.array_sort(P.signal_lines(F.col("text"))), "/").alias("signals"))


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"contains(touched, '{plain(w).replace(chr(39), chr(39) * 2)}')::INT" for w in words)


NAMES = "list_transform(list_filter(list_reverse_sort([" + ", ".join(f"{{'hits': {_hits(w)}, 'name': '{n}'}}" for n, (w, _, _) in P.CATEGORIES.items()) + "]), lambda x: x.hits > 0), lambda x: x.name)"
NUMBERS = lambda t: f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, '\\b(\\d[\\d\\s.,/-]*)\\b'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))))"
LINKS = lambda t: f"list_sort(list_distinct(regexp_extract_all({t}, 'https?://[^\\s\"''<>]+')))"
BY_LEVEL = lambda level: "[" + quoted(n for n, (_, s, _) in P.CATEGORIES.items() if s == level) + "]"


@query(f"""WITH {NOTICES}, l AS (SELECT *, coalesce(lag(text) OVER w, '') AS old_text, coalesce(lag(title) OVER w, '') AS old_title FROM n WINDOW w AS (PARTITION BY page_id ORDER BY retrieved_at, version_id)),
 s AS (SELECT *, {SIGNAL("old_text")} AS a, {SIGNAL("text")} AS b FROM l), d AS (SELECT *, {EXCEPT("b", "a")} AS add_, {EXCEPT("a", "b")} AS rem_ FROM s),
 t AS (SELECT *, {FOLDED("array_to_string(list_concat(add_, rem_), ' ')")} AS touched, old_title <> '' AND old_title <> title AS title_changed, {NUMBERS("old_text")} <> {NUMBERS("text")} AS numbers_changed, {LINKS("old_text")} <> {LINKS("text")} AS links_changed FROM d),
 c AS (SELECT *, {NAMES} AS names, old_text = '' AS first_, {FOLDED("old_text")} = {FOLDED("text")} AND old_title = title AS same_ FROM t),
 k AS (SELECT *, CASE WHEN first_ THEN 'new' WHEN same_ THEN 'none' WHEN len(add_) = 0 AND len(rem_) = 0 AND NOT title_changed THEN 'cosmetic' WHEN {ANY("touched", P.CRITICAL)} THEN 'critical' ELSE 'substantive' END AS change_type FROM c)
 SELECT version_id, change_type, title_changed, numbers_changed, links_changed,
   CASE WHEN change_type IN ('new', 'none') THEN '' WHEN change_type = 'cosmetic' THEN 'cosmetic' ELSE array_to_string(names, ',') END AS categories,
   CASE WHEN change_type IN ('new', 'none', 'cosmetic') THEN 'low' WHEN list_has_any(names, {BY_LEVEL("critical")}) THEN 'critical' WHEN list_has_any(names, {BY_LEVEL("high")}) THEN 'high' WHEN list_has_any(names, {BY_LEVEL("medium")}) THEN 'medium' ELSE 'low' END AS severity,
   CASE WHEN change_type IN ('new', 'none') THEN '' ELSE array_to_string(add_[1:20], '/') END AS added, CASE WHEN change_type IN ('new', 'none') THEN '' ELSE array_to_string(rem_[1:20], '/') END AS removed FROM k""")
def change_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = changes(spark, sf_dir, tuple(n for n in P.FOUND if n not in ("affected_topics", "summary")))
    text = lambda c, by: F.array_join(c, by).alias(c)
    return out.select("version_id", "change_type", "title_changed", "numbers_changed", "links_changed", text("categories", ","), "severity", text("added", "/"), text("removed", "/"))


def changes(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = P.FOUND, after: DataFrame | None = None) -> DataFrame:
    """Each version of a page against the one before it; those that came later than ``after``, a row of one time, where that is given."""
    return P.compare_along(notices(spark, sf_dir), "page_id", ["retrieved_at", "version_id"], "text", "title", only, after)


#: Expected values of the notices' changes: which topics each category makes doubtful.
DOUBTS = {
    "eligibility": ["admission", "residence_permit", "housing", "health", "work"], "required_document": ["documents", "admission", "residence_permit", "housing"], "deadline": ["deadline", "admission", "taxes"],
    "fee": ["tuition", "taxes"], "procedure": ["admission", "residence_permit", "documents"], "application_portal": ["admission", "residence_permit"], "jurisdiction": ["residence_permit", "documents"],
    "student_rule": ["admission", "programmes", "housing"], "immigration_rule": ["residence_permit", "documents"], "housing_rule": ["housing"], "tax_rule": ["taxes"], "health_rule": ["health"], "employment_rule": ["work"],
    "contact": ["contact"], "address": ["contact"],
}
CHANGED = f"""{NOTICES}, l AS (SELECT *, coalesce(lag(text) OVER w, '') AS old_text, coalesce(lag(title) OVER w, '') AS old_title FROM n WINDOW w AS (PARTITION BY page_id ORDER BY retrieved_at, version_id)),
 s AS (SELECT *, {SIGNAL("old_text")} AS a, {SIGNAL("text")} AS b FROM l), d AS (SELECT *, {EXCEPT("b", "a")} AS add_, {EXCEPT("a", "b")} AS rem_ FROM s),
 t AS (SELECT *, {FOLDED("array_to_string(list_concat(add_, rem_), ' ')")} AS touched, old_title <> '' AND old_title <> title AS title_changed FROM d),
 c AS (SELECT *, {NAMES} AS names, old_text = '' AS first_, {FOLDED("old_text")} = {FOLDED("text")} AND old_title = title AS same_ FROM t),
 dt AS (SELECT unnest([{quoted(DOUBTS)}]) AS name, unnest([{", ".join("[" + quoted(v) + "]" for v in DOUBTS.values())}]) AS topics),
 real AS (SELECT version_id, source_id, retrieved_at, names FROM c WHERE NOT first_ AND NOT same_ AND (len(add_) > 0 OR len(rem_) > 0 OR title_changed))"""


@query(f"""WITH {CHANGED}, x AS (SELECT DISTINCT version_id, source_id, retrieved_at, unnest(topics) AS topic FROM (SELECT version_id, source_id, retrieved_at, unnest(names) AS name FROM real) JOIN dt USING (name))
 SELECT topic, epoch_us(max(retrieved_at)) AS invalidated_at, count(DISTINCT source_id) AS sources FROM x GROUP BY topic""")
def change_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that substantive changes make doubtful, when last, and by how many sources."""
    out = changes(spark, sf_dir, ("change_type", "affected_topics")).where(P.is_substantive(F.col("change_type")))
    rows = out.select("source_id", "retrieved_at", F.explode("affected_topics").alias("topic"))
    return rows.groupBy("topic").agg(F.unix_micros(F.max("retrieved_at").cast("timestamp")).alias("invalidated_at"), F.countDistinct("source_id").alias("sources"))


@query(f"""WITH {CHANGED}, x AS (SELECT DISTINCT version_id, source_id, retrieved_at, unnest(topics) AS topic FROM (SELECT version_id, source_id, retrieved_at, unnest(names) AS name FROM real) JOIN dt USING (name)),
 st AS (SELECT topic, max(retrieved_at) AS at FROM x GROUP BY topic), an AS (SELECT c_custkey AS answer, CASE c_custkey % 3 WHEN 0 THEN ['taxes', 'deadline'] WHEN 1 THEN ['housing'] ELSE ['nothing'] END AS topics, TIMESTAMP '1998-07-31' + INTERVAL (c_custkey % 5) DAY AS made_at FROM customer)
 SELECT answer, NOT EXISTS (SELECT 1 FROM st WHERE list_contains(an.topics, st.topic) AND st.at > an.made_at) AS valid FROM an""")
def answers_still_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose topics were not made doubtful after they were made (D12). A change that came before all answers can't; what it touched isn't looked into."""
    answers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("answer"), F.expr("CASE c_custkey % 3 WHEN 0 THEN array('taxes', 'deadline') WHEN 1 THEN array('housing') ELSE array('nothing') END").alias("topics"),
        F.expr("timestamp_ntz'1998-07-31 00:00:00' + make_dt_interval(CAST(c_custkey % 5 AS INT))").alias("made_at"),
    )
    late = changes(spark, sf_dir, ("change_type", "affected_topics"), answers.agg(F.min("made_at")))
    return P.still_valid(answers, P.invalidations(late.select("source_id", "version_id", "retrieved_at", "change_type", "affected_topics"))).select("answer", "valid")


@query(f"""WITH {NOTICES} SELECT version_id, lag(version_id) OVER w AS previous_version, row_number() OVER w AS number, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS newest_first,
 coalesce(lag(content_hash) OVER w <> content_hash, true) AS is_change FROM n WINDOW w AS (PARTITION BY page_id ORDER BY retrieved_at, version_id)""")
def version_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chain(notices(spark, sf_dir), "page_id", "retrieved_at", "version_id", "content_hash").select("version_id", "previous_version", "number", "newest_first", "is_change")


@query(f"""WITH {NOTICES}, q AS (SELECT c_custkey AS page_id, CAST(DATE '1995-01-01' + CAST(c_custkey % 900 AS INTEGER) AS DATE) AS day FROM customer)
 SELECT q.page_id, CAST(q.day AS VARCHAR) AS day, (SELECT arg_max(version_id, (retrieved_at, version_id)) FROM n WHERE n.page_id = q.page_id AND CAST(n.retrieved_at AS DATE) <= q.day) AS version_id FROM q""")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")).alias("day"))
    return P.asof(wanted, notices(spark, sf_dir).select("page_id", "retrieved_at", "version_id"), "page_id", "day", "retrieved_at", "version_id").select("page_id", F.col("day").cast("string").alias("day"), "version_id")


@query(f"""WITH {NOTICES}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS k, count(*) OVER (PARTITION BY page_id) AS total FROM n)
 SELECT page_id, version_id, CASE WHEN version_id % 3 > 0 THEN 'prune' ELSE 'kept' END AS action FROM r WHERE total > 2 AND k > 5 AND version_id % 10 <> 0 AND retrieved_at < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).withColumns({"active": F.col("version_id") % 10 == 0, "pending": F.when(F.col("version_id") % 3 == 0, 2).otherwise(0)})
    return P.retention(rows, "page_id", "retrieved_at", "version_id", "active", "pending", F.lit("1998-01-01").cast("timestamp"), 5, 365)


LATEST = "a AS (SELECT page_id, source_id, max(retrieved_at) AS seen_at, arg_max(version_id, (retrieved_at, version_id)) AS version_id FROM n GROUP BY page_id, source_id)"


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active version of each page."""
    return notices(spark, sf_dir).groupBy("page_id", "source_id").agg(F.max("retrieved_at").alias("at"), F.max_by("version_id", F.struct("retrieved_at", "version_id")).alias("version_id"))


@query(f"""WITH {NOTICES}, {LATEST}, c AS (SELECT c_custkey AS page_id, CASE c_custkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 24 WHEN 2 THEN 72 ELSE 336 END AS hours FROM customer)
 SELECT page_id, version_id, CASE WHEN seen_at IS NULL THEN 'unknown' WHEN TIMESTAMP '1998-08-01' <= seen_at + to_hours(hours * 100) THEN 'fresh' ELSE 'stale' END AS freshness,
  coalesce(TIMESTAMP '1998-08-01' > seen_at + to_hours(hours * 100), true) AS due FROM c LEFT JOIN a USING (page_id)""")
def freshness_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.expr("CASE c_custkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 24 WHEN 2 THEN 72 ELSE 336 END * 100")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), hours.alias("hours")).join(latest(spark, sf_dir), "page_id", "left")
    state = P.freshness(F.col("at"), F.lit("1998-08-01").cast("timestamp"), F.col("hours"))
    return rows.select("page_id", "version_id", state.alias("freshness"), (state != "fresh").alias("due"))


@query(f"""WITH {NOTICES}, h AS (SELECT source_id, count(*) AS versions, min(retrieved_at) AS oldest, max(retrieved_at) AS newest, max(CASE WHEN content_hash IN ('h1', 'h2') THEN retrieved_at END) AS last_change FROM n GROUP BY source_id),
 s AS (SELECT *, date_diff('day', oldest, TIMESTAMP '1998-08-03') AS days FROM h)
 SELECT source_id, versions, days, CAST(CAST(last_change AS DATE) AS VARCHAR) AS last_change, CASE WHEN versions < 3 THEN 'insufficient_history' WHEN days >= 90 THEN 'historical_mature' WHEN days >= 30 THEN 'historical_ready' ELSE 'limited_history' END AS depth FROM s""")
def history_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = notices(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("versions"), F.min("retrieved_at").alias("oldest"), F.max(F.when(F.col("content_hash").isin("h1", "h2"), F.col("retrieved_at"))).alias("last_change")
    )
    days = F.datediff(F.lit("1998-08-03").cast("date"), F.col("oldest"))
    return got.select("source_id", "versions", days.alias("days"), F.col("last_change").cast("date").cast("string").alias("last_change"), P.history_depth(F.col("versions"), days).alias("depth"))


@query(f"""WITH {NOTICES}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS k FROM n) SELECT page_id, version_id FROM r WHERE k = 2""")
def rollback_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chain(notices(spark, sf_dir), "page_id", "retrieved_at", "version_id", "content_hash").where("newest_first = 2").select("page_id", "version_id")


@query(f"""WITH {NOTICES}, {LATEST} SELECT n.page_id % 100 AS answer_id, count(*) AS used, bool_and(n.version_id = a.version_id) AS is_current FROM n JOIN a USING (page_id) GROUP BY 1""")
def answer_is_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = notices(spark, sf_dir).select("page_id", F.col("version_id").alias("used_version"))
    active = latest(spark, sf_dir).select("page_id", "version_id")
    return used.join(active, "page_id").groupBy((F.col("page_id") % 100).alias("answer_id")).agg(F.count("*").alias("used"), F.bool_and(F.col("used_version") == F.col("version_id")).alias("is_current"))


CLAIMS = f"""{NOTICES}, li AS (SELECT version_id, source_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM n),
 sq AS (SELECT *, {SQUEEZE("raw")} AS claim_text FROM li), ok AS (SELECT *, {FOLDED("claim_text")} AS folded FROM sq WHERE len(string_split(claim_text, ' ')) >= 5 AND length(claim_text) <= 400),
 cl AS (SELECT version_id, source_id, position, claim_text, folded, sha256(concat(source_id, '|', folded))[1:16] AS claim_id,
   nullif(regexp_extract(claim_text, '(?i)à\\s+compter\\s+du\\s+1er\\s+juillet\\s+(\\d{{4}})', 1), '') AS year FROM ok WHERE {ANY("folded", C.WORDS)})"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract(notices(spark, sf_dir), ["version_id", "source_id"], "source_id", "text")


@query(f"WITH {CLAIMS} SELECT version_id, source_id, position, claim_id, claim_text, coalesce(year || '-07-01', '') AS effective_from FROM cl")
def claims_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).select("version_id", "source_id", "position", "claim_id", "claim_text", F.coalesce(F.col("effective_from").cast("string"), F.lit("")).alias("effective_from"))


@query(f"""WITH {CLAIMS}, r AS (SELECT version_id, row_number() OVER w AS nth, row_number() OVER (PARTITION BY page_id ORDER BY retrieved_at DESC, version_id DESC) AS back FROM n WINDOW w AS (PARTITION BY page_id ORDER BY retrieved_at, version_id)),
 o AS (SELECT DISTINCT source_id, claim_id FROM cl JOIN r USING (version_id) WHERE nth = 1), w AS (SELECT DISTINCT source_id, claim_id FROM cl JOIN r USING (version_id) WHERE back = 1)
 SELECT coalesce(o.source_id, w.source_id) AS source_id, coalesce(o.claim_id, w.claim_id) AS claim_id, CASE WHEN o.claim_id IS NULL THEN 'added' WHEN w.claim_id IS NULL THEN 'removed' ELSE 'kept' END AS status
 FROM o FULL JOIN w ON o.source_id = w.source_id AND o.claim_id = w.claim_id""")
def claims_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each source by its pages' first and last versions."""
    n = P.chain(notices(spark, sf_dir), "page_id", "retrieved_at", "version_id", "content_hash").where("number = 1 or newest_first = 1").select("version_id", "source_id", "text", (F.col("number") == 1).alias("old"), (F.col("newest_first") == 1).alias("new"))
    c = C.extract(n, ["version_id", "source_id", "old", "new"], "source_id", "text")
    return C.diff(c.where("old"), c.where("new"), ["source_id", "claim_id"])


@query(f"WITH {CLAIMS} SELECT claim_id, min(year) AS since, count(*) FILTER (CAST(year || '-07-01' AS DATE) <= DATE '2023-01-01' OR year IS NULL) AS in_force FROM cl GROUP BY claim_id")
def claims_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims(spark, sf_dir)
    holds = D.in_force(F.col("effective_from"), F.col("effective_until"), F.lit("2023-01-01").cast("date"))
    return c.groupBy("claim_id").agg(F.min(F.year("effective_from").cast("string")).alias("since"), F.count_if(holds).alias("in_force"))


@query(f"WITH {NOTICES} SELECT version_id, array_to_string(list_sort([concat(1 + version_id % 6, ' moi'), concat(10 * (version_id % 5), ' euro')]), ', ') AS quantities FROM n")
def claim_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("version_id", F.array_join(C.quantities(F.col("text")), ", ").alias("quantities"))


#: One statement of each (topic, source): sources number their terms differently, so some contradict.
STATEMENTS = """st AS (SELECT n_nationkey * 10 + k AS claim_key, concat('t', n_nationkey) AS topic, concat('s', k) AS source_id, concat('c', lpad(CAST(n_nationkey * 10 + k AS VARCHAR), 4, '0')) AS claim_id, k,
  CASE k WHEN 0 THEN concat('Le délai pour renouveler la carte numéro ', n_nationkey, ' est de trois mois') WHEN 1 THEN concat('Le délai pour renouveler la carte numéro ', n_nationkey, ' est de ', 2 + n_nationkey % 3, ' mois')
   WHEN 2 THEN concat('Le délai pour renouveler la carte numéro ', n_nationkey, ' est de 3 mois pour les étudiants') ELSE concat('Horaires du guichet voisin zone ', n_nationkey) END AS claim_text
  FROM nation, (SELECT unnest([0, 1, 2, 3]) AS k))"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    base = "'Le délai pour renouveler la carte numéro ', n_nationkey, ' est de "
    return n.selectExpr(
        "concat('t', n_nationkey) AS topic", "concat('s', k) AS source_id", "concat('c', lpad(CAST(n_nationkey * 10 + k AS STRING), 4, '0')) AS claim_id", "k",
        f"CASE k WHEN 0 THEN concat({base}trois mois') WHEN 1 THEN concat({base}', 2 + n_nationkey % 3, ' mois') WHEN 2 THEN concat({base}3 mois pour les étudiants') ELSE concat('Horaires du guichet voisin zone ', n_nationkey) END AS claim_text",
        "CASE k WHEN 0 THEN 'national' WHEN 1 THEN 'department' ELSE 'regional' END AS jurisdiction", "CAST(1 + k % 2 AS INT) AS authority_level",
        "CAST(NULL AS DATE) AS effective_from", "CASE WHEN k = 1 AND n_nationkey % 5 = 0 THEN DATE'2020-01-01' END AS effective_until", "CAST(concat('2024-01-0', 1 + k) AS DATE) AS retrieved_at",
    )


@query(f"""WITH {STATEMENTS}, p AS (SELECT a.topic, a.claim_id AS id_a, b.claim_id AS id_b, a.k AS ka, b.k AS kb, CAST(a.topic[2:] AS INT) AS n FROM st a JOIN st b ON a.topic = b.topic AND a.claim_id < b.claim_id WHERE a.k < 3 AND b.k < 3),
 r AS (SELECT *, CASE WHEN ka = 0 AND kb = 1 THEN CASE WHEN 2 + n % 3 = 3 THEN 'additive' ELSE 'contradictory' END
   WHEN ka = 1 AND kb = 2 THEN CASE WHEN 2 + n % 3 = 3 THEN 'conditional' ELSE 'contradictory' END ELSE 'conditional' END AS relation FROM p)
 SELECT topic, id_a, id_b, relation, CASE WHEN ka = 1 THEN CASE WHEN n % 5 = 0 THEN 'b' ELSE 'a' END WHEN kb = 1 THEN CASE WHEN n % 5 = 0 THEN 'a' ELSE 'b' END ELSE 'b' END AS prefer,
  concat('CONF-', sha256(concat(id_a, '|', id_b))[1:12]) AS conflict_id FROM r""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = C.resolve(C.classify(C.pairs(statements(spark, sf_dir), "topic")), F.lit("2024-06-01").cast("date"))
    return near.select("topic", "id_a", "id_b", "relation", "prefer", C.conflict_id(F.col("id_a"), F.col("id_b")).alias("conflict_id"))


@query(f"""WITH {STATEMENTS}, p AS (SELECT a.topic, a.k AS ka, b.k AS kb, CAST(a.topic[2:] AS INT) AS n FROM st a JOIN st b ON a.topic = b.topic AND a.claim_id < b.claim_id WHERE a.k < 3 AND b.k < 3)
 SELECT topic, CASE WHEN 2 + max(n) % 3 = 3 THEN 'conditional' ELSE 'contradictory' END AS relationship, count(*) AS pairs FROM p GROUP BY topic""")
def conflict_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst relation between the statements on each topic."""
    near = C.classify(C.pairs(statements(spark, sf_dir), "topic"))
    rank = F.when(F.col("relation") == "contradictory", 3).when(F.col("relation") == "conditional", 2).when(F.col("relation") == "additive", 1).otherwise(0)
    return near.groupBy("topic").agg(F.max_by("relation", rank).alias("relationship"), F.count("*").alias("pairs"))


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat(1 + o_orderkey % 28, CASE WHEN o_orderkey % 28 = 0 THEN 'er' ELSE '' END, ' février ', 2000 + o_orderkey % 30) WHEN 1 THEN concat(31, '/', 1 + o_orderkey % 12, '/', 2000 + o_orderkey % 30) WHEN 2 THEN '2024-13-45' ELSE 'bientôt' END AS raw, o_orderkey AS k FROM orders)
 SELECT o_orderkey, CASE k % 4 WHEN 0 THEN concat(2000 + k % 30, '-02-', lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0')) WHEN 1 THEN CASE WHEN 1 + k % 12 IN (1, 3, 5, 7, 8, 10, 12) THEN concat(2000 + k % 30, '-', lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0'), '-31') ELSE '' END WHEN 2 THEN raw ELSE '' END AS iso FROM t""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(1 + o_orderkey % 28, CASE WHEN o_orderkey % 28 = 0 THEN 'er' ELSE '' END, ' février ', 2000 + o_orderkey % 30) WHEN 1 THEN concat(31, '/', 1 + o_orderkey % 12, '/', 2000 + o_orderkey % 30) WHEN 2 THEN '2024-13-45' ELSE 'bientôt' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.parse_date(raw).alias("iso"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN DATE '2023-06-30' WHEN 2 THEN DATE '2024-02-29' WHEN 3 THEN DATE '2022-12-31' ELSE DATE '2024-05-15' END AS VARCHAR) AS asked_on, o_orderkey % 5 <> 4 AS historical, o_orderkey % 5 = 1 AS about_change FROM orders""")
def asked_about_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat('What held on ', CAST(CAST(o_orderdate AS DATE) AS STRING), '?') WHEN 1 THEN 'What changed before July 2023?' WHEN 2 THEN 'Quelle règle en février 2024 ?' WHEN 3 THEN 'the rule of 2022' ELSE 'What do I need?' END")
    a = D.asked_about(q, F.lit("2024-05-15").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", F.col("a.on").cast("string").alias("asked_on"), "a.historical", "a.about_change")


@query("""WITH e AS (SELECT event_id, ts, user_id % 50 AS source, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'dns' END AS kind, event_type IN ('error', 'view') AS failed, event_type = 'signup' AS well FROM events),
 f AS (SELECT * FROM e WHERE failed OR well), i AS (SELECT *, coalesce(sum((NOT failed)::INT) OVER (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM f),
 r AS (SELECT source, island, min(ts) AS resolved_at FROM i WHERE NOT failed GROUP BY ALL)
 SELECT source, kind, CAST(island AS BIGINT) AS island, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS occurrence_count, CASE WHEN resolved_at IS NULL THEN 'open' ELSE 'resolved' END AS current_status
 FROM i LEFT JOIN r USING (source, island) WHERE failed GROUP BY source, kind, island, resolved_at""")
def incident_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id % 50 AS source", "CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'dns' END AS kind", "event_type IN ('error', 'view') AS failed", "event_type = 'signup' AS well")
    out = P.incidents(e.where("failed OR well"), "source", "kind", "ts", "failed", "event_id")
    return out.select("source", "kind", "island", F.unix_micros(F.col("first_seen").cast("timestamp")).alias("first_seen"), F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_seen"), "occurrence_count", "current_status")
