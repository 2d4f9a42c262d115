"""Queries over stores that change in commits: keyed tables, version chains and the keyword index, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import store as S
from lumenfold.operators.keyword_index import KeywordIndex
from lumenfold.plans.retrieval import BM25
from lumenfold.plans.tables import table
from lumenfold.sources.atomic import AtomicStore, working_dir
from lumenfold.streaming import stateful

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT o_custkey AS source_id, o_orderkey AS claim, CASE WHEN o_custkey % 3 = 0 THEN 'stale' ELSE 'current' END AS status, o_orderstatus AS s FROM orders)
 SELECT source_id, count(*) AS claims, min(status) AS status, min(claim) AS first_claim FROM o WHERE source_id % 7 > 0 AND (source_id % 3 > 0 OR s <> 'O') GROUP BY source_id""")
def store_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of customers (S23): every third customer's are saved anew without open orders, every seventh customer goes; each in one commit."""
    store = AtomicStore(spark, working_dir(spark, "claims"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("claim"), "o_orderstatus", F.lit("current").alias("status"))
    store.commit(store.append("claims", rows.drop("o_orderstatus"), ["source_id"], 16))
    again = rows.where("source_id % 3 = 0 and o_orderstatus <> 'O'").drop("o_orderstatus").withColumn("status", F.lit("stale"))
    without = rows.where("source_id % 3 = 0").select("source_id").distinct()
    store.commit(store.delete("claims", without))  # a customer with open orders only has no claim left
    store.commit(store.upsert("claims", again, ["source_id"]))
    store.commit(store.delete("claims", rows.where("source_id % 7 = 0").select("source_id").distinct()))
    return store.read("claims").groupBy("source_id").agg(F.count("*").alias("claims"), F.min("status").alias("status"), F.min("claim").alias("first_claim"))


FETCHED = """f AS (SELECT o_custkey AS page, o_orderkey AS n, o_orderdate + to_seconds(o_orderkey % 86400) AS tm, 'h' || (o_orderkey // 4) % 3 AS h FROM orders WHERE o_orderkey % 9 > 0),
 d AS (SELECT *, lag(h) OVER (PARTITION BY page ORDER BY tm, h) AS prior FROM f), v AS (SELECT * FROM d WHERE prior IS NULL OR prior <> h),
 c AS (SELECT *, lag(tm) OVER w AS tm_before, lag(h) OVER w AS h_before FROM v WINDOW w AS (PARTITION BY page ORDER BY tm, h))"""


@query(f"""WITH {FETCHED} SELECT CAST(page AS VARCHAR) AS url, strftime(tm, '%Y%m%dT%H%M%SZ-') || h AS version_id, strftime(tm_before, '%Y%m%dT%H%M%SZ-') || h_before AS previous_version,
 CASE WHEN h_before IS NULL THEN 'first' ELSE 'later' END AS place FROM c""")
def store_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches of pages in batches by year (D10): each batch reads last versions only. Every ninth fetch has nothing to read."""
    store = AtomicStore(spark, working_dir(spark, "versions"))
    o = table(spark, sf_dir, "orders")
    words = F.repeat(F.concat(F.lit("mot"), (F.floor(F.col("o_orderkey") / 4) % 3).cast("string"), F.lit(" suite ")), 25)
    rows = o.select(
        F.lit("s").alias("source_id"), F.col("o_custkey").cast("string").alias("url"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 86400) * 1_000_000).alias("us"),
        F.concat(F.lit("h"), (F.floor(F.col("o_orderkey") / 4) % 3).cast("string")).alias("content_hash"), F.lit("T").alias("title"), F.when(F.col("o_orderkey") % 9 > 0, words).otherwise("").alias("text"),
    ).withColumn("retrieved_at", F.timestamp_micros("us")).drop("us")
    years = [r[0] for r in rows.select(F.year("retrieved_at").alias("y")).distinct().orderBy("y").collect()]
    for n, year in enumerate(years):
        stateful.store_batch(store, rows.where(F.year("retrieved_at") == year), ("orders", n), buckets=8)
    kept = store.read("versions")
    return kept.select("url", "version_id", "previous_version", F.when(F.col("previous_version").isNull(), "first").otherwise("later").alias("place"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE s_suppkey % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'healthy' ELSE 'unknown' END AS health, s_suppkey % 2 = 0 OR s_suppkey % 5 = 0 AS live FROM supplier""")
def store_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register whose health and live flags are written in place (S33), field by field."""
    root, s = working_dir(spark, "register"), table(spark, sf_dir, "supplier").select("s_suppkey")
    key = F.col("s_suppkey").cast("string").alias("id")
    S.save_partitioned(s.select(key, F.lit("unknown").alias("health"), (F.col("s_suppkey") % 2 == 0).alias("live")), root, ["id"])
    S.set_fields(spark, root, s.where("s_suppkey % 3 < 2").select(key, F.when(F.col("s_suppkey") % 3 == 0, "blocked").otherwise("healthy").alias("health")))
    S.set_fields(spark, root, s.where("s_suppkey % 5 = 0").select(key, F.lit(True).alias("live")))
    return S.saved(spark, root)


@query(f"WITH {BM25.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE doc_id % 10 <> 7)')} SELECT query, doc, keyword_rank, round(keyword_score, 5) AS keyword_score FROM kw WHERE keyword_rank <= 10")
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a stored index (H3, T1) after two additions, the second of which brings some documents anew, and a deletion."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = KeywordIndex(spark, working_dir(spark, "keywords"), buckets=8)
    index.add(docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" old words"))).otherwise(F.col("text"))), "doc_id", "text")
    index.add(docs.where("doc_id % 2 = 1 or doc_id % 6 = 0"), "doc_id", "text")
    index.delete(docs.where("doc_id % 10 = 7").select(F.col("doc_id").alias("doc")))
    return index.search(table(spark, sf_dir, "benchmark"), 10, "item_id", "text").withColumn("keyword_score", F.round("keyword_score", 5))
