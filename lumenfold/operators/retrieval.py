"""Retrieval: BM25 postings, exact dense search, rank fusion, diversity, gate and verdicts. Everything is a batch over queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, EVIDENCE = 60, 4  # of rank fusion, and passages that a model is shown
MAX_QUERY_BYTES, MAX_ASKED = 64 << 20, 500_000  # of vectors, and rows of query terms of about 50 bytes, that are sent to all tasks
QUERY_CHUNK, DOC_CHUNK, SHARD = 1024, 8192, 1 << 16  # queries and documents scored at once, documents in a shard
CELLS, SLICE_TOKENS = 1 << 20, 1 << 18  # scores, or numbers of vectors, and tokens that a worker holds at once, some times over


def top(df: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each query; the rank filter is taken before the shuffle too."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for whole in batches:
        sizes = whole.column("t").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        slices = np.cumsum(sizes) // SLICE_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(sizes)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            b, size = whole.slice(i, j - i), sizes[i:j]
            coded = b.column("t").flatten().dictionary_encode()
            many = max(1, len(coded.dictionary))
            cell, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = pa.array(cell // many)
            yield pa.RecordBatch.from_arrays([b.column("doc").take(row), pa.array(size.astype(np.int32)).take(row), coded.dictionary.take(pa.array(cell % many)), pa.array(tf.astype(np.int64))], names=["doc", "dl", "term", "tf"])


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, dl, term, tf): how often each term occurs in each document, and the document's length in tokens. Ids are unique.

    A document's terms are counted where it lies, as arrays, so that no token travels.
    """
    t = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("t"))
    return t.mapInArrow(_count_terms, f"doc {t.schema['doc'].dataType.simpleString()}, dl int, term string, tf long")


def vocabulary(posts: DataFrame, documents: DataFrame) -> DataFrame:
    """(term, avgdl, idf): of all terms. ``documents`` has one row, n, the number of documents, those without tokens among them.

    A negative idf becomes ``EPSILON`` times the mean idf of the vocabulary.
    """
    df = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    raw = df.crossJoin(F.broadcast(documents)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # documents: one row
    whole = raw.agg(F.avg("idf").alias("mean_idf"), (F.sum("ctf") / F.max("n")).alias("avgdl"))
    return raw.crossJoin(F.broadcast(whole)).select("term", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))  # whole: one row


def write_postings(docs: DataFrame, path: str, id_col: str, text_col: str, parts: int = 64) -> None:
    """The keyword index, written anew: postings in parts by a hash of the term, and the vocabulary."""
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")
    postings(docs, id_col, text_col).select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    vocabulary(stored, docs.agg(F.count("*").alias("n"))).select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/terms")


def read_postings(spark: SparkSession, path: str, queries: DataFrame, query_text: str) -> tuple[DataFrame, DataFrame]:
    """(postings, vocabulary) of a stored index, of the terms that the queries ask for only."""
    asked = queries.select(F.explode(tokens(F.col(query_text))).alias("term")).distinct()
    return tuple(spark.read.parquet(f"{path}/{name}").drop("part").join(asked, "term", "left_semi") for name in ("postings", "terms"))


def bm25_score(queries: DataFrame, posts: DataFrame, terms: DataFrame, k: int, query_id: str, query_text: str) -> DataFrame:
    """(query, doc, keyword_score, keyword_rank): Okapi BM25 from postings and vocabulary, positive scores only, ties to the smaller doc. A term that a query repeats counts as often."""
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    # Up to so many terms of queries are sent to the postings; more meet them in a shuffle. Postings themselves are never sent.
    few = asked.count() <= MAX_ASKED
    side = F.broadcast if few else lambda df: df.hint("shuffle_merge")
    weighed = terms.join(side(asked), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = posts.join(side(weighed), "term").groupBy("query", "doc").agg(F.sum(part).alias("keyword_score")).where("keyword_score > 0")
    return top(scored.withColumn("_s", F.round("keyword_score", 9)), "query", [F.desc("_s"), F.asc("doc")], k, "keyword_rank").drop("_s")


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str, query_text: str, id_col: str, text_col: str) -> DataFrame:
    """:func:`bm25_score` over documents that have no stored index."""
    posts = postings(docs, id_col, text_col)
    return bm25_score(queries, posts, vocabulary(posts, docs.agg(F.count("*").alias("n"))), k, query_id, query_text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, floored at 0."""
    return F.greatest(F.lit(0.0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def fuse(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, doc, fused_score, dense_rank, dense_score, keyword_rank, keyword_score, sources, lists) from the rows (query, doc, kind, rank, score) of any number of ranked lists of the kinds dense and keyword.

    The fused score is the sum of weight / (60 + rank) over the lists; of a kind, the best rank and score stay.
    """
    weight = F.lit(1.0)
    for kind, w in (weights or {}).items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    return lists.groupBy("query", "doc").agg(
        F.sum(weight / (RRF_K + F.col("rank"))).alias("fused_score"), F.min(of("dense", "rank")).alias("dense_rank"), F.max(of("dense", "score")).alias("dense_score"), F.min(of("keyword", "rank")).alias("keyword_rank"),
        F.max(of("keyword", "score")).alias("keyword_score"), F.array_sort(F.collect_set("kind")).alias("sources"), F.count("*").alias("lists"),
    )


def search_many(lists: DataFrame, first: DataFrame, docs: DataFrame, document: str, limit: int = 6, pool: int = 25, per_document: int = 2) -> DataFrame:
    """The hits of a question asked in several forms: fusion over all lists picks a pool, cosine with the first form (query, vector) orders it, and documents are diversified.

    ``docs`` has (doc, vector) and the ``document`` column. Only the pool is scored anew, where no dense list did.
    """
    picked = top(fuse(lists), "query", [F.desc(F.round("fused_score", 9)), F.desc(F.round(F.coalesce("dense_score", F.lit(0.0)), 9)), F.asc("doc")], pool, "pool")
    rows = picked.join(docs.withColumnRenamed("vector", "_d"), "doc").join(first.withColumnRenamed("vector", "_q"), "query")
    rows = rows.withColumn("dense_score", F.coalesce("dense_score", cosine(F.col("_q"), F.col("_d")))).drop("_q", "_d")
    return diversify(rows, [F.desc(F.round("dense_score", 9)), F.desc(F.round("fused_score", 9)), F.asc("doc")], document, limit, per_document)


def _dense(ids: list[int], matrix: bytes, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        q = np.frombuffer(matrix, np.float64).reshape(-1, dim)
        step = max(1, CELLS // max(1, dim))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            v = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, dim)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            doc = b.column("doc").to_numpy()
            kept = min(len(doc), 4 * k + 16)  # enough of a batch for ties at the k-th place to be seen by rank
            chunk = max(1, min(QUERY_CHUNK, CELLS // len(doc)))
            for at in range(0, len(q), chunk):
                sims = np.maximum(0.0, q[at : at + chunk] @ v.T)
                part = np.argsort(-np.round(sims, 9), axis=1, kind="stable")
                rows = part[:, :kept] if kept < len(doc) else part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids[at : at + chunk], np.int64), rows.shape[1])), pa.array(doc[rows].ravel()), pa.array(np.take_along_axis(sims, rows, 1).ravel())],
                    names=["query", "doc", "dense_score"],
                )

    return run


def _dense_block(dim: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
        import numpy as np

        none = pa.table({"query": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "dense_score": pa.array([], pa.float64())})
        if not queries.num_rows or not docs.num_rows:
            return none
        q = np.asarray(queries["q"].combine_chunks().flatten(), np.float64).reshape(queries.num_rows, dim)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        search = _dense(queries["query"].to_pylist(), q.tobytes(), dim, k)
        return pa.concat_tables([none, *(pa.Table.from_batches([b]) for b in search(iter(docs.sort_by("doc").combine_chunks().to_batches(DOC_CHUNK))))])

    return run


def dense_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str, id_col: str, vec_col: str, query_vec: str) -> DataFrame:
    """(query, doc, dense_score, dense_rank): exact cosine, floored at 0, ties to the smaller doc.

    Queries of up to 64 MB go to every task as one matrix; each batch of documents gives its best of
    each query. More queries are dealt to blocks of about that size, documents to shards, and each
    block meets each shard in a task.
    """
    rows = queries.select(F.col(query_id).cast("long"), F.col(query_vec)).where(F.col(query_vec).isNotNull())
    n, dim = rows.agg(F.count("*"), F.max(F.size(query_vec))).first()
    found = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(vec_col).alias("v"))
    best = [F.desc("_s"), F.asc("doc")]
    if n * (dim or 1) * 8 > MAX_QUERY_BYTES:
        found = found.where(F.size("v") == dim)
        blocks, shards = -(-n * dim * 8 // MAX_QUERY_BYTES), max(1, -(-found.count() // SHARD))
        number = lambda name, many: F.pmod(F.xxhash64(name), F.lit(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        asked = rows.toDF("query", "q").withColumn("block", number("query", blocks)).withColumn("shard", every(shards)).groupBy("block", "shard")
        held = found.withColumn("shard", number("doc", shards)).withColumn("block", every(blocks)).groupBy("block", "shard")
        scored = asked.cogroup(held).applyInArrow(_dense_block(dim, k), "query long, doc long, dense_score double")
        return top(scored.withColumn("_s", F.round("dense_score", 9)), "query", best, k, "dense_rank").drop("_s")
    import numpy as np

    got = rows.collect()
    q = np.array([r[1] for r in got], np.float64)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(got) else np.zeros((0, 1))
    found = found.where(F.size("v") == q.shape[1]).sortWithinPartitions("doc").mapInArrow(_dense([r[0] for r in got], q.tobytes(), q.shape[1], k), "query long, doc long, dense_score double")
    return top(found.withColumn("_s", F.round("dense_score", 9)), "query", best, k, "dense_rank").drop("_s")


def rrf(dense: DataFrame, keyword: DataFrame, dense_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Full outer fusion of two ranked lists of (query, doc): the sum of weight / (60 + rank)."""
    both = dense.join(keyword, ["query", "doc"], "full_outer")
    fused = F.coalesce(dense_weight / (RRF_K + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(keyword_weight / (RRF_K + F.col("keyword_rank")), F.lit(0.0))
    names = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), F.lit("dense")), F.when(F.col("keyword_rank").isNotNull(), F.lit("keyword"))))
    return both.withColumns({"fused_score": fused, "sources": names})


def diversify(hits: DataFrame, order: list[Column], document: str, limit: int, per_document: int = 2) -> DataFrame:
    """At most ``per_document`` hits of a document in order; what overflows fills up at the end. Adds ``position``."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    within = F.row_number().over(Window.partitionBy("query", document).orderBy("_place"))
    ranked = hits.withColumn("_place", place).withColumn("_over", (within > per_document).cast("int"))
    return top(ranked, "query", [F.asc("_over"), F.asc("_place")], limit, "position").drop("_place", "_over")


def gate(hits: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Adds passed (score at least the threshold) and should_refuse (no hit of the query passed)."""
    flagged = hits.withColumn("passed", F.col("dense_score") >= threshold)
    return flagged.withColumn("should_refuse", ~F.bool_or("passed").over(Window.partitionBy("query")))


def gate_summary(gated: DataFrame, order: str) -> DataFrame:
    """(query, best_score, candidates): the best score of what passed, or of all where nothing did, and all docs, those that passed first."""
    passed = F.col("passed")
    docs = F.transform(F.array_sort(F.collect_list(F.struct((~passed).alias("n"), F.col(order).alias("o"), "doc"))), lambda x: x["doc"])
    return gated.groupBy("query").agg(F.coalesce(F.max(F.when(passed, F.col("dense_score"))), F.max("dense_score"), F.lit(0.0)).alias("best_score"), docs.alias("candidates"))


def evidence(hits: DataFrame, document: str, threshold: float = 0.35, decisive: float = 0.65, support: int = 5, documents: int = 3) -> DataFrame:
    """One verdict a query: ANSWER on strong, broad evidence, REFUSE without any, else ASK_MODEL."""
    got = hits.groupBy("query").agg(
        F.max("dense_score").alias("best"), F.count_if(F.col("dense_score") >= threshold).alias("supporting"), F.countDistinct(F.nullif(F.col(document), F.lit(""))).alias("documents")
    )
    return got.withColumn("verdict", verdict(F.col("best"), F.col("supporting"), F.col("documents"), decisive, support, documents))


def verdict(best: Column, supporting: Column, documents: Column, decisive: float = 0.65, support: int = 5, least_documents: int = 3) -> Column:
    strong = (best >= decisive) & (supporting >= support) & (documents >= least_documents)
    return F.when(supporting == 0, "REFUSE").when(strong, "ANSWER").otherwise("ASK_MODEL")


def needs_model(answer: Column) -> Column:
    return answer == "ASK_MODEL"


def best_passage(hits: DataFrame, document: str) -> DataFrame:
    """The best hit of each document of a query; ties to the smaller doc."""
    w = Window.partitionBy("query", document).orderBy(F.desc(F.round("dense_score", 9)), "doc")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select_relevant(hits: DataFrame, page: str, section: str, ok: str, order: str, per_page: int = 3) -> DataFrame:
    """Adds ``reason``: null for what is selected. Rows that fail their check take no place; of the others a section comes once and a page three times."""
    rows = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query", page, section, ok).orderBy(order)))
    first = F.col(ok) & (F.col("_n") == 1)
    rows = rows.withColumn("_m", F.sum(first.cast("int")).over(Window.partitionBy("query", page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    # The section's first acceptable row, and whether it got a place, decide what later rows of it are told.
    won = first & (F.coalesce("_m", F.lit(0)) < per_page)
    rows = rows.withColumn("_seen", F.max(won.cast("int")).over(Window.partitionBy("query", page, section).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    full = F.coalesce("_m", F.lit(0)) >= per_page
    reason = F.when(F.coalesce("_seen", F.lit(0)) == 1, "duplicate").when(full, "page_full").when(~F.col(ok), "irrelevant")
    return rows.withColumn("reason", reason).drop("_n", "_m", "_seen")
