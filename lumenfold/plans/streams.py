"""Queries over logs and state that ends by time, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.harvest import Budget, Harvest
from lumenfold.plans.tables import table
from lumenfold.sources.atomic import AtomicStore, working_dir
from lumenfold.streaming import expiring, logs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ms, event_type IN ('purchase', 'signup') AS good FROM events),
 f AS (SELECT e.*, (SELECT min(s.ms) FROM e s WHERE s.good AND s.user_id = e.user_id AND s.ms > e.ms) AS cured FROM e WHERE NOT good),
 d AS (SELECT *, (ms > lag(ms) OVER w + 259200000)::INT AS apart FROM f WINDOW w AS (PARTITION BY user_id, cured, event_type ORDER BY ms)),
 p AS (SELECT *, coalesce(sum(apart) OVER (PARTITION BY user_id, cured, event_type ORDER BY ms), 0) AS part FROM d),
 g AS (SELECT user_id, event_type, cured, part, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM p GROUP BY ALL),
 s AS (SELECT *, part = max(part) OVER (PARTITION BY user_id, cured, event_type) AS newest FROM g)
 SELECT user_id AS source, event_type AS kind, first_ms, last_ms, n AS occurrence_count, CASE WHEN newest AND cured <= last_ms + 259200000 THEN 'resolved' ELSE 'lapsed' END AS status
 FROM s WHERE NOT newest OR cured IS NOT NULL OR last_ms + 259200000 < epoch_ms(TIMESTAMP '2024-01-31')""")
def incident_lapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents that were resolved, or lapsed as nothing confirmed them for three days (section 2.11)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("at"), (~F.col("event_type").isin("purchase", "signup")).alias("failed"))
    out = expiring.ended_incidents(e, "2024-01-31 00:00:00")
    return out.select("source", "kind", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), "occurrence_count", "status")


LATE = 5 * 24 * 3_600_000


@query(f"""WITH a AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 10 = 0 THEN 2 WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS b FROM events),
 r AS (SELECT *, false AS again FROM a UNION ALL SELECT event_id, event_type, ms, b + 1, true FROM a WHERE event_id % 7 = 0 AND b < 2),
 h AS (SELECT max(ms) FILTER (b = 0) - {LATE} AS one, max(ms) FILTER (b < 2) - {LATE} AS two FROM a),
 j AS (SELECT r.*, coalesce(ms < CASE b WHEN 1 THEN one WHEN 2 THEN two END, false) AS late FROM r, h)
 SELECT event_type, count(*) FILTER (NOT late AND NOT again) AS kept, count(*) FILTER (late) AS late FROM j GROUP BY event_type""")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log read as a stream that is started three times (S21): events once, stragglers apart."""
    land, root, ck = (working_dir(spark, x) for x in ("log", "log-store", "log-checkpoint"))
    b = F.when(F.col("event_id") % 10 == 0, 2).when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", b.alias("b"))
    again = e.where("event_id % 7 = 0 and b < 2").withColumn("b", F.col("b") + 1)
    for n in range(3):
        e.unionByName(again).where(F.col("b") == n).drop("b").write.mode("append").json(land)
        logs.keep_log(logs.log_stream(spark, land, "event_id long, at timestamp, event_type string"), root, ck, "event_id", "at", LATE).start().awaitTermination()
    store = AtomicStore(spark, root)
    told = store.read("events").select("event_type", F.lit(1).alias("kept"), F.lit(0).alias("late")).unionByName(store.read("late").select("event_type", F.lit(0).alias("kept"), F.lit(1).alias("late")))
    return told.groupBy("event_type").agg(F.sum("kept").alias("kept"), F.sum("late").alias("late"))


def _harvest_sql(rounds: int, per_round: int, per_source: int, per_plan: int, depth: int, least: int) -> str:
    """Each round as tables of its own: r is what may be visited, v what is."""
    score = "(CAST(substr(url, 2) AS BIGINT) * 37) % 101 - 5 * depth"
    out = ["e AS (SELECT DISTINCT l_suppkey AS source, 'u' || l_orderkey % 60 AS page, 'u' || l_partkey % 60 AS url FROM lineitem)", "o1 AS (SELECT s_nationkey AS plan, s_suppkey AS source, 'u' || s_suppkey % 60 AS url, 0 AS depth FROM supplier)"]
    for r in range(1, rounds + 1):
        offers = " UNION ALL ".join(f"SELECT * FROM o{i}" for i in range(1, r + 1))
        seen = " UNION ALL ".join(f"SELECT plan, source, url FROM v{i}" for i in range(1, r)) or "SELECT 0 AS plan, 0 AS source, '' AS url WHERE false"
        out.append(f"g{r} AS (SELECT plan, source, url, min(depth) AS depth FROM ({offers}) GROUP BY ALL), s{r} AS ({seen})")
        out.append(f"r{r} AS (SELECT *, {score} AS score, row_number() OVER (PARTITION BY plan, source ORDER BY {score} DESC, url) AS best FROM g{r} ANTI JOIN s{r} USING (plan, source, url))")
        out.append(f"k{r} AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY source, best) AS turn FROM r{r} WHERE best <= {per_round} AND best + (SELECT count(*) FROM s{r} s WHERE s.plan = r{r}.plan AND s.source = r{r}.source) <= {per_source})")
        out.append(f"v{r} AS (SELECT plan, source, url, depth, score FROM k{r} WHERE turn + (SELECT count(*) FROM s{r} s WHERE s.plan = k{r}.plan) <= {per_plan})")
        out.append(f"o{r + 1} AS (SELECT v.plan, v.source, e.url, v.depth + 1 AS depth FROM v{r} v JOIN e ON e.source = v.source AND e.page = v.url WHERE v.score >= {least} AND v.depth < {depth})")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT plan, source, url, depth, CAST(score AS DOUBLE) AS score, {r} AS round FROM v{r}" for r in range(1, rounds + 1))


@query(_harvest_sql(3, 2, 3, 40, 2, 6))
def harvest_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of a harvest (D16): a plan for each nation, whose suppliers are its sources; pages link by their orders."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat(F.lit("u"), F.col("l_orderkey") % 60).alias("page"), F.concat(F.lit("u"), F.col("l_partkey") % 60).alias("url"), F.lit("").alias("anchor")).distinct()
    s = table(spark, sf_dir, "supplier")
    entries = s.select(F.col("s_nationkey").cast("long").alias("plan"), F.col("s_suppkey").alias("position"), F.col("s_suppkey").alias("source"), F.concat(F.lit("u"), F.col("s_suppkey") % 60).alias("url"))
    work = Harvest(spark, working_dir(spark, "harvest"), links, lambda url, anchor, depth: F.substring(url, 2, 9).cast("long") * 37 % 101 - 5 * depth, Budget(2, 3, 40, 2, 6.0))
    work.begin(entries)
    return work.run(3).select("plan", "source", "url", "depth", "score", "round")
