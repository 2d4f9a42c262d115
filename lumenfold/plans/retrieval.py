"""Queries over text functions and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import retrieval as R
from lumenfold.plans.tables import quoted, spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WS = r"'[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+'"
FOLD = "strip_accents(lower(text))"
SQUEEZE = lambda e: f"trim(regexp_replace({e}, {WS}, ' ', 'g'))"


@query(f"""SELECT doc_id, md5({FOLD}) AS fold_plain, md5({SQUEEZE(FOLD)}) AS fold_ws, md5({SQUEEZE(f"replace({FOLD}, '-', ' ')")}) AS fold_hyphen,
  md5({SQUEEZE(f"translate({FOLD}, '-_', '  ')")}) AS fold_hyphen_underscore, md5({SQUEEZE(f"translate({FOLD}, '-’', ' ''')")}) AS fold_proc,
  md5({SQUEEZE(f"replace({FOLD}, '’', '''')")}) AS fold_claim, md5({SQUEEZE(f"replace({FOLD}, '''', ' ')")}) AS fold_date,
  md5(array_to_string(regexp_extract_all({FOLD}, '[a-z0-9]+'), ' ')) AS fold_key FROM documents""")
def fold_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[F.md5(f(F.col("text")).cast("binary")).alias(n) for n, f in X.FOLDS.items()])


TOKENS = f"list_filter(regexp_extract_all(regexp_replace({FOLD}, '[''’ʼ]', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1)"


@query(f"SELECT doc_id, len({TOKENS}) AS n_tokens, len(list_distinct({TOKENS})) AS n_distinct FROM documents")
def fold_tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"""WITH w AS (SELECT conv_id, turn, lower(text) AS low, regexp_extract_all(lower(text), '\\p{{L}}+') AS words FROM conversations),
 c AS (SELECT conv_id, turn, len(list_filter(words, lambda w: strip_accents(w) IN ({quoted(X.FRENCH_MARKERS)}))) AS french, len(list_filter(words, lambda w: w IN ({quoted(X.ENGLISH_MARKERS)}))) AS english,
   length(regexp_replace(low, '[^{X.FRENCH_LETTERS}]', '', 'g')) AS accented FROM w),
 s AS (SELECT *, french + least(accented, 3) * 0.75::DOUBLE AS fr FROM c)
 SELECT conv_id, turn, french, english, accented,
   CASE WHEN fr + english = 0 THEN CASE WHEN accented > 0 THEN 'fr' ELSE 'en' END WHEN fr > english THEN 'fr' ELSE 'en' END AS language,
   round(CASE WHEN fr + english = 0 THEN 0 ELSE greatest(fr, english) / (fr + english) END, 6) AS confidence FROM s""")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.language(F.col("text")).alias("l")).select("conv_id", "turn", "l.*")
    return t.withColumn("confidence", F.round("confidence", 6))


ANY = lambda e, words: "(" + " OR ".join(f"contains({e}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"
COUNT = lambda e, words: "(" + " + ".join(f"contains({e}, '{w.replace(chr(39), chr(39) * 2)}')::INT" for w in words) + ")"
QUESTION = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'How do I renew ' WHEN 1 THEN 'What is ' WHEN 2 THEN 'Comment postuler avant la deadline et aussi ' WHEN 3 THEN 'Please tell me ' ELSE 'Quand ' END"


@query(f"""WITH q AS (SELECT conv_id, turn, strip_accents(lower(concat({QUESTION}, text))) AS f FROM conversations WHERE role = 'user')
 SELECT conv_id, turn, CASE WHEN {ANY("f", X.PROCEDURAL)} AND {COUNT("f", X.COMPLEX)} >= 2 THEN 'complex' WHEN {ANY("f", X.PROCEDURAL)} THEN 'procedural'
  WHEN {" OR ".join(f"starts_with(f, '{w.replace(chr(39), chr(39) * 2)}') OR contains(f, ' {w.replace(chr(39), chr(39) * 2)}')" for w in X.MICRO)} THEN 'micro' ELSE 'standard' END AS answer_class FROM q""")
def answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.expr(QUESTION), "text").alias("q"))
    return asked.select("conv_id", "turn", X.answer_class(F.col("q")).alias("answer_class"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[^\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+')) AS n_words, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::INT AS token_estimate,
 (len(regexp_extract_all(text, '[^\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+')) >= 40) AS is_usable FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.word_count(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", n.alias("n_words"), X.token_estimate(F.col("text")).alias("token_estimate"), (n >= 40).alias("is_usable"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents), c AS (SELECT doc_id, body, body[1:420] AS cut FROM b),
 s AS (SELECT *, greatest(CASE WHEN contains(cut, '. ') THEN 420 - strpos(reverse(cut), ' .') - 1 ELSE -1 END, CASE WHEN contains(cut, chr(10)) THEN 420 - strpos(reverse(cut), chr(10)) ELSE -1 END) AS stop FROM c)
 SELECT doc_id, CASE WHEN length(body) <= 420 THEN body ELSE concat(regexp_replace(CASE WHEN stop > 210 THEN cut[1:stop + 1] ELSE cut END, '\\s+$', ''), '…') END AS excerpt FROM s""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


BM25 = f"""d AS MATERIALIZED (SELECT doc_id AS doc, {TOKENS} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
 p AS MATERIALIZED (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc, term),
 r AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, st GROUP BY term, n), m AS (SELECT avg(idf) AS mean_idf FROM r),
 q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest({TOKENS}) AS term FROM benchmark) GROUP BY query, term),
 sc AS (SELECT query, doc, sum(qtf * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS keyword_score
   FROM p JOIN q USING (term) JOIN r USING (term), m, st GROUP BY query, doc HAVING keyword_score > 0),
 kw AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(keyword_score, 9) DESC, doc) AS keyword_rank FROM sc) WHERE keyword_rank <= 25)"""


def keyword_hits(spark: SparkSession, sf_dir: str, k: int = 25) -> DataFrame:
    return R.bm25_topk(table(spark, sf_dir, "benchmark"), spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k, "item_id", "text", "doc_id", "text")


@query(f"WITH {BM25} SELECT query, doc, keyword_rank, round(keyword_score, 6) AS keyword_score FROM kw WHERE keyword_rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_hits(spark, sf_dir, 10).withColumn("keyword_score", F.round("keyword_score", 6))


COS = "greatest(0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS doc, {COS} AS dense_score FROM e a, e b WHERE a.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dense_score, 9) DESC, doc) AS dense_rank FROM s)
 SELECT query, doc, dense_rank, round(dense_score, 6) AS dense_score FROM r WHERE dense_rank <= 6""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.dense_topk(e.where("vec_id % 20 = 0"), e, 6, "vec_id", "vec_id", "embedding", "embedding").withColumn("dense_score", F.round("dense_score", 6))


#: Documents and questions borrow the vector whose number is their own, modulo how many there are.
HITS = f"""WITH {BM25}, ne AS (SELECT count(*) AS n FROM embeddings), e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 qv AS MATERIALIZED (SELECT i.item_id AS query, e.v FROM benchmark i, ne JOIN e ON e.vec_id = i.item_id % ne.n), dv AS MATERIALIZED (SELECT x.doc_id AS doc, e.v FROM documents x, ne JOIN e ON e.vec_id = x.doc_id % ne.n),
 ds AS MATERIALIZED (SELECT a.query, b.doc, {COS} AS dense_score FROM qv a, dv b),
 de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dense_score, 9) DESC, doc) AS dense_rank FROM ds) WHERE dense_rank <= 25),
 fu AS MATERIALIZED (SELECT query, doc, dense_rank, keyword_rank, coalesce(1.0 / (60 + dense_rank), 0)::DOUBLE + coalesce(1.0 / (60 + keyword_rank), 0)::DOUBLE AS fused_score,
   coalesce(de.dense_score, ds.dense_score) AS dense_score FROM de FULL JOIN kw USING (query, doc) JOIN ds USING (query, doc)),
 po AS (SELECT * FROM (SELECT f.*, x.source, row_number() OVER (PARTITION BY query ORDER BY round(fused_score, 9) DESC, round(f.dense_score, 9) DESC, doc) AS pool FROM fu f JOIN documents x ON x.doc_id = f.doc) WHERE pool <= 25),
 pl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(dense_score, 9) DESC, round(fused_score, 9) DESC, doc) AS place FROM po),
 ov AS (SELECT *, (row_number() OVER (PARTITION BY query, source ORDER BY place) > 2)::INT AS over FROM pl),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY over, place) AS position FROM ov) WHERE position <= 6)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions and documents with their vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("_n")))  # one row
    with_vec = lambda df, key: df.crossJoin(n).withColumn("vec_id", F.col(key) % F.col("_n")).join(e, "vec_id").drop("vec_id", "_n")
    return with_vec(table(spark, sf_dir, "benchmark").select("item_id"), "item_id"), with_vec(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of both searches, every candidate with its cosine."""
    asked, docs = vectors(spark, sf_dir)
    dense = R.dense_topk(asked, docs, 25, "item_id", "doc_id", "embedding", "embedding")
    both = R.rrf(dense, keyword_hits(spark, sf_dir))
    # What only the keyword search found is scored on the same scale, for its own question.
    q = asked.select(F.col("item_id").alias("query"), F.col("embedding").alias("_q"))
    d = docs.select(F.col("doc_id").alias("doc"), "source", F.col("embedding").alias("_d"))
    return both.join(d, "doc").join(q, "query").withColumn("dense_score", F.coalesce("dense_score", R.cosine(F.col("_q"), F.col("_d")))).drop("_q", "_d")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.top(fused(spark, sf_dir), "query", [F.desc(F.round("fused_score", 9)), F.desc(F.round("dense_score", 9)), F.asc("doc")], 25, "pool")
    return R.diversify(pool, [F.desc(F.round("dense_score", 9)), F.desc(F.round("fused_score", 9)), F.asc("doc")], "source", 6)


@query(HITS + " SELECT query, doc, dense_rank, keyword_rank, round(fused_score, 9) AS fused_score FROM fu")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query", "doc", "dense_rank", "keyword_rank", F.round("fused_score", 9).alias("fused_score"))


@query(HITS + " SELECT query, position, doc, source, round(dense_score, 6) AS dense_score FROM hits")
def hybrid_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query", "position", "doc", "source", F.round("dense_score", 6).alias("dense_score"))


@query(HITS + " SELECT query, doc, dense_score >= 0.25 AS passed, NOT bool_or(dense_score >= 0.25) OVER (PARTITION BY query) AS should_refuse FROM hits")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gate(hybrid(spark, sf_dir), 0.25).select("query", "doc", "passed", "should_refuse")


@query(HITS + """, g AS (SELECT query, max(dense_score) AS best, count(*) FILTER (dense_score >= 0.2) AS supporting, count(DISTINCT nullif(source, '')) AS documents FROM hits GROUP BY query)
 SELECT query, round(best, 6) AS best, supporting, documents, CASE WHEN supporting = 0 THEN 'REFUSE' WHEN best >= 0.35 AND supporting >= 5 AND documents >= 3 THEN 'ANSWER' ELSE 'ASK_MODEL' END AS verdict FROM g""")
def evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence(hybrid(spark, sf_dir), "source", 0.2, 0.35).withColumn("best", F.round("best", 6))


@query(HITS + " SELECT query, source, arg_min(doc, (-round(dense_score, 9), doc)) AS doc FROM fu JOIN documents ON doc_id = doc GROUP BY query, source")
def best_passage_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_passage(fused(spark, sf_dir), "source").select("query", "source", "doc")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six diversified passages for each benchmark question, with the decision to answer, to ask a model, or to refuse."""
    hits = R.gate(hybrid(spark, sf_dir), 0.25)
    # Over the six hits of a question, in the same pass.
    w = Window.partitionBy("query")
    over = F.max("dense_score").over(w), F.count_if(F.col("dense_score") >= 0.2).over(w), F.size(F.collect_set(F.nullif("source", F.lit(""))).over(w))
    return hits.withColumn("verdict", R.verdict(*over, decisive=0.35)).select("query", "position", "doc", "source", "dense_score", "fused_score", "passed", "should_refuse", "verdict")
