"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import ann, decontaminate, hamerly, language, minhash, orc_tokens, packing, secrets, sharding, substring, toxicity, url_filter, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "byte", 2048, with_ids=False)


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.encode_to_orc(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "word")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries for the hosts of ``pages``, by a rule on their letters: the tables hold no list of their own.

    A third of hosts are blocked for a while, some of them twice; every seventh is allowed; each
    parent domain of two labels is blocked for a month.
    """
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    n = F.length("key") * 31 + F.ascii("key") * 7 + F.ascii(F.substr("key", F.lit(3), F.lit(1))) * 3
    hosts = hosts.withColumn("n", n.cast("int"))
    entry = lambda name, policy, action, day: F.struct(F.lit(name).alias("list_name"), F.lit(policy).alias("policy"), F.lit(action).alias("action"), day.alias("day"))
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c)
    n = F.col("n")
    blocked = hosts.where("n % 3 = 0").select("key", F.explode(F.array(
        entry("spam", "block", "add", day(n % 200)), entry("spam", "block", "remove", day(n % 200 + 60)), entry("spam", "block", "add", day(n % 200 + 90)),
    )).alias("e"))
    allowed = hosts.where("n % 7 = 0").select("key", entry("partners", "allow", "add", day(n % 100)).alias("e"))
    parents = hosts.select(F.array_join(F.slice(F.split("key", r"\."), -2, 2), ".").alias("key")).where("key like '%.%'").distinct()
    monthly = parents.select("key", F.explode(F.array(
        entry("abuse", "block", "add", day(F.length("key") * 9)), entry("abuse", "block", "remove", day(F.length("key") * 9 + 30)),
    )).alias("e"))
    return blocked.unionByName(allowed).unionByName(monthly).select("key", "e.*")


def op4_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return url_filter.judge(fetched, dated_entries(pages)).withColumn("day", F.col("day").cast("string"))


def op3_icws_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH captures AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day
  FROM pages
), hosts AS (
  SELECT DISTINCT host AS key, length(host) * 31 + ascii(host) * 7 + ascii(substr(host, 3, 1)) * 3 AS n FROM captures WHERE host IS NOT NULL
), parents AS (
  SELECT DISTINCT regexp_extract(key, '([^.]+[.][^.]+)$', 1) AS key FROM hosts
), entries AS (
  SELECT key, 'spam' AS list_name, 'block' AS policy, unnest(['add', 'remove', 'add']) AS action, unnest([n % 200, n % 200 + 60, n % 200 + 90]) AS after FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT key, 'partners', 'allow', 'add', n % 100 FROM hosts WHERE n % 7 = 0
  UNION ALL SELECT key, 'abuse', 'block', unnest(['add', 'remove']), unnest([length(key) * 9, length(key) * 9 + 30]) FROM parents WHERE key LIKE '%.%'
), dated AS (
  SELECT key, list_name, policy, action, CAST(DATE '2024-01-01' + CAST(after AS INTEGER) AS DATE) AS day FROM entries
), spans AS (
  SELECT *, min(CASE WHEN action = 'remove' THEN day END) OVER (
    PARTITION BY list_name, policy, key ORDER BY day, CASE WHEN action = 'remove' THEN 0 ELSE 1 END ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until
  FROM dated
), judged AS (
  SELECT c.page_id, s.key, s.list_name, s.policy,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.key) DESC, s.key, CASE WHEN s.policy = 'block' THEN 0 ELSE 1 END, s.list_name) AS rn
  FROM captures c JOIN spans s ON s.action = 'add' AND s.day <= c.day AND (s.until IS NULL OR c.day < s.until)
    AND (c.host = s.key OR (ends_with(c.host, '.' || s.key) AND s.key LIKE '%.%'))
)
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS day, coalesce(j.policy = 'block', false) AS blocked, j.list_name, j.key AS entry_key
FROM captures c LEFT JOIN judged j ON j.page_id = c.page_id AND j.rn = 1
"""


def op5_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_countmin_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op9_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), 50, 5)


def held_out(id_col: str = "doc_id"):
    """The fold that is never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op7_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fit(docs, labels.where(~held_out()))
    out = toxicity.score(docs, weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.clusters_with_inertia(table(spark, sf_dir, "embeddings"), 16, 3)


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds: every vector against every centroid, in integers."""
    steps = [f"""q AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM q) ORDER BY h, v LIMIT {k}
)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT q.r, any_value(q.vec_id) AS vec_id, any_value(q.v) AS v, min({{'d': list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM q, c{n} c GROUP BY q.r
)""")
        if n < rounds:
            steps.append(f"""s{n} AS (
  SELECT best.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY best.c, i
), m{n} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c
), c{n + 1} AS (
  SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_forms(table(spark, sf_dir, "documents"))


def op13_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_packing, op2_orc_token_ids, op3_icws_minhash, op4_temporal_url_lists, op5_qgram_decontamination, op6_countmin_substring, op7_toxicity_mil, op8_language_cnn, op9_pruned_graph_ann, op10_lpt_sharding, op11_hamerly_clusters, op12_spelling_variants, op13_zstd_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op4_temporal_url_lists": OP4_SQL, "op11_hamerly_clusters": _op11_sql()}
