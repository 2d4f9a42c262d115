"""Queries over ingestion, pages as HTML and searches with several phrasings, and their SQL. Files and pages are made from tables by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import ingest as I
from lumenfold.operators import retrieval as R
from lumenfold.plans.retrieval import BM25, COS, keyword_hits, vectors
from lumenfold.plans.tables import spread, table
from lumenfold.sources import html as H
from lumenfold.sources import publications as X

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ publications to chunks

#: A part number that two numbers share twice over: files 2k and 2k + 1 are one document, whose bodies differ for every third k; those of segment pro come from odd numbers.
FILE = """concat('<Publication xmlns:dc="http://purl.org/dc/elements/1.1/" ID="F', CAST(p_partkey div 2 AS STRING), '" spUrl="https://x/', p_partkey div 2, '"><dc:title>Titre ', p_partkey div 2, '</dc:title><dc:date>modified 2024-05-01</dc:date>',
 '<ListeSituations><Situation><Titre>Cas A</Titre><Texte><Chapitre><Titre>Pieces</Titre><Paragraphe>Le prix est ', CASE WHEN (p_partkey div 2) % 3 = 0 THEN p_partkey ELSE p_partkey div 2 END, '.</Paragraphe><Liste type="numero"><Item>un</Item><Item>deux</Item></Liste></Chapitre></Texte></Situation></ListeSituations>',
 '<Texte><Chapitre><Titre>Fin</Titre><Liste><Item>trois</Item></Liste></Chapitre></Texte></Publication>')"""
DOCS = """d AS (SELECT p_partkey // 2 AS k, p_partkey AS p, p_partkey % 2 AS odd, (p_partkey // 2) % 3 = 0 AS differ FROM part),
 u AS (SELECT k, differ, p, odd, CASE WHEN differ AND row_number() OVER (PARTITION BY k ORDER BY odd) = 2 THEN concat('F', k, '@pro') ELSE concat('F', k) END AS doc, CASE WHEN NOT differ THEN (SELECT string_agg(CASE WHEN x.odd = 1 THEN 'entreprendre' ELSE 'particuliers' END, ',' ORDER BY x.odd) FROM d x WHERE x.k = d.k) END AS who,
   CASE WHEN differ THEN p ELSE k END AS price, row_number() OVER (PARTITION BY k ORDER BY odd) AS nth FROM d), v AS (SELECT * FROM u WHERE differ OR nth = 1)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".xml")).alias("source_file"), F.when(F.col("p_partkey") % 2 == 0, "part").otherwise("pro").alias("segment"), F.expr(FILE).alias("xml"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ingest(files(spark, sf_dir), "3.5", F.lit("2024-06-01"), F.lit("2024-06-01").cast("date"))


@query(f"""WITH {DOCS}, t AS (SELECT *, concat('Titre ', k, chr(10), 'Situation : Cas A', chr(10), 'Section : Pieces', chr(10), chr(10), 'Le prix est ', price, '.', chr(10), chr(10), '1. un', chr(10), '2. deux') AS a, concat('Titre ', k, chr(10), 'Section : Fin', chr(10), chr(10), '- trois') AS b FROM v)
 SELECT concat(doc, '#000#01') AS chunk_id, a AS text, doc AS fiche_id, 'Cas A' AS situation, 'Pieces' AS section_path, CASE odd WHEN 0 THEN 'particuliers' ELSE 'entreprendre' END AS audience, length(a) // 4 AS token_count, false AS contains_document_list, true AS contains_numbered_procedure,
  CASE WHEN who = 'particuliers,entreprendre' THEN 'entreprendre' ELSE '' END AS also_published_for, 1 AS part_count, true AS plausible FROM t
 UNION ALL SELECT concat(doc, '#001#01'), b, doc, NULL, 'Fin', CASE odd WHEN 0 THEN 'particuliers' ELSE 'entreprendre' END, length(b) // 4, true, false, CASE WHEN who = 'particuliers,entreprendre' THEN 'entreprendre' ELSE '' END, 1, true FROM t""")
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to chunks with their metadata."""
    c = ingested(spark, sf_dir)
    return c.select("chunk_id", "text", "fiche_id", "situation", "section_path", "audience", F.col("token_count").cast("long").alias("token_count"), "contains_document_list", "contains_numbered_procedure", "also_published_for", "part_count", F.col("last_updated_is_plausible").alias("plausible"))


@query(f"""WITH {DOCS} SELECT concat(doc, '#00', n, '#01') AS chunk_id, CASE n WHEN 0 THEN 'Cas A' ELSE '' END AS situation, '' AS theme, concat('https://x/', k) AS source_url, '3.5' AS feed_version, '2024-06-01' AS ingested_at, 'fiche' AS doc_kind, '' AS last_major_update FROM v, (SELECT unnest([0, 1]) AS n)""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars only, empty for unknown."""
    return I.metadata(ingested(spark, sf_dir)).select("chunk_id", "situation", "theme", "source_url", "feed_version", "ingested_at", "doc_kind", "last_major_update")


@query(f"""WITH {DOCS} SELECT doc AS doc_id, 'Cas A' AS situations FROM v""")
def document_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The situations that a document tells apart."""
    return X.situations(I.deduplicate(X.read_publications(files(spark, sf_dir)))).select("doc_id", F.array_join("situations", ",").alias("situations"))


@query("SELECT 'skipped' AS status, 'Menu' AS reason, count(*) FILTER (p_partkey % 3 = 1) AS n FROM part UNION ALL SELECT 'failure', 'malformed XML', count(*) FILTER (p_partkey % 3 = 2) FROM part")
def rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that gave no document, by reason."""
    xml = F.expr(f"CASE p_partkey % 3 WHEN 0 THEN {FILE} WHEN 1 THEN '<Menu/>' ELSE '<Publication' END")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey")).select(F.col("p_partkey").cast("string").alias("source_file"), F.lit("part").alias("segment"), xml.alias("xml"))
    return X.rejections(X.read_publications(rows))


# ------------------------------------------------------------------ pages

PAGE = """concat('<html lang="fr-FR"><head><title> Page  ', p_partkey, ' </title><meta name="description" content="About ', p_partkey, '"></head><body><nav><a href="/menu">Menu item</a></nav><h1>Titre ', p_partkey, '</h1><p>Une ligne de ', p_type, '.</p><p>Une ligne de ', p_type, '.</p>',
 CASE WHEN p_partkey % 5 = 0 THEN '<![foo bar]]>' ELSE '' END, '<a href="/p/', p_partkey + 1, '">next one</a> <a href="http://plain.example/x">plain</a> <a href="https://site.example/p/', p_partkey * 2, '">twice</a><div class="cookie-bar">accept</div><p>2024-03-0', 1 + p_partkey % 9, '</p></body></html>')"""


def page_url(page: Column) -> Column:
    return F.concat(F.lit("https://site.example/p/"), page)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spread(table(spark, sf_dir, "part").select("p_partkey", "p_type")))


def read_pages(p: DataFrame) -> DataFrame:
    return H.read_pages(p.select(F.col("p_partkey").alias("page_id"), page_url(F.col("p_partkey")).alias("url"), F.expr(PAGE).alias("html")))


LINKS = """l AS (SELECT p_partkey AS page_id, 'https://site.example/menu' AS "to", 'Menu item' AS words, 0 AS n FROM part UNION ALL SELECT p_partkey, concat('https://site.example/p/', p_partkey + 1), 'next one', 1 FROM part WHERE p_partkey % 5 > 0
 UNION ALL SELECT p_partkey, concat('https://site.example/p/', p_partkey * 2), CASE WHEN p_partkey = 1 THEN 'next one' ELSE 'twice' END, 2 FROM part WHERE p_partkey % 5 > 0 AND p_partkey <> 1)"""


@query("""SELECT p_partkey AS page_id, concat('Page ', p_partkey) AS title, 'fr-FR' AS language, concat('About ', p_partkey) AS description, concat('Titre ', p_partkey) AS headings, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('2024-03-0', 1 + p_partkey % 9) END AS updated,
 concat('Titre ', p_partkey, chr(10), 'Une ligne de ', p_type, '.', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(chr(10), 'next one plain twice', chr(10), '2024-03-0', 1 + p_partkey % 9) END) AS text FROM part""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages (S11): furniture and repeated lines fall away; markup that can't be read ends a page."""
    return pages(spark, sf_dir).select("page_id", "title", "language", "description", F.array_join("headings", ",").alias("headings"), "updated", "text")


@query(f"""WITH {LINKS} SELECT page_id, "to", words FROM l""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages with their words, https only, in absolute form (S11d)."""
    return H.link_edges(pages(spark, sf_dir))


@query(f"""WITH {LINKS}, s AS (SELECT DISTINCT "to" FROM l WHERE page_id % 10 = 2), n AS (SELECT DISTINCT p_partkey AS page_id FROM s JOIN part ON "to" = concat('https://site.example/p/', p_partkey)),
 a AS (SELECT "to", words, 1 AS depth FROM l WHERE page_id % 10 = 2 UNION ALL SELECT "to", words, 2 FROM l JOIN n USING (page_id)) SELECT "to", min(depth) AS depth, max(words) AS words FROM a GROUP BY "to\"""")
def pages_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages within two links of some."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    ids = part.select(F.col("p_partkey").alias("page_id"))
    cores = spark.sparkContext.defaultParallelism
    read = lambda some: read_pages(part.join(some.hint("shuffle_merge"), F.col("p_partkey") == F.col("page_id"), "left_semi").repartition(cores))
    return H.discover(read, ids.where("page_id % 10 = 2"), known=ids.select("page_id", page_url(F.col("page_id")).alias("url")))


@query("""WITH s AS (SELECT n_nationkey AS k FROM nation), c AS (SELECT k, unnest(range(8)) AS child FROM s WHERE k % 2 = 0), p AS (SELECT k, child AS nth, unnest(['own', 'both']) AS w, unnest([0, 1]) AS pos FROM c WHERE child < 6),
 x AS (SELECT k, CASE w WHEN 'own' THEN concat('https://n', k, '.fr/p', nth) ELSE concat('https://n', k, '.fr/both') END AS page, nth, pos FROM p UNION ALL SELECT k, concat('https://n', k, '.fr/q', pos), 0, pos FROM (SELECT k, unnest(range(3)) AS pos FROM s WHERE k % 2 = 1)),
 o AS (SELECT k, page, min((nth, pos)) AS f FROM x GROUP BY ALL) SELECT concat('n', k) AS source, row_number() OVER (PARTITION BY k ORDER BY f) AS position, page FROM o QUALIFY position <= 5""")
def sitemap_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that sitemaps name, index files followed one level."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "concat('n', n_nationkey) AS source")
    site = F.concat(F.lit("https://n"), "k", F.lit(".fr/"))
    loc = lambda many, tail: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.concat(F.lit("<loc>"), site, tail(i), F.lit("</loc>"))), "")
    index = F.concat(F.lit("<sitemapindex>"), loc(8, lambda i: F.concat(F.lit("c"), i.cast("string"), F.lit(".xml"))), F.lit("</sitemapindex>"))
    root = n.select("source", F.concat(site, F.lit("sitemap.xml")).alias("url"), F.when(F.col("k") % 2 == 0, index).otherwise(F.concat(F.lit("<urlset>"), loc(3, lambda i: F.concat(F.lit("q"), i.cast("string"))), F.lit("</urlset>"))).alias("xml"))
    child = n.where("k % 2 = 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    own = F.concat(F.lit("<urlset><loc>"), site, F.lit("p"), "c", F.lit("</loc><loc> "), site, F.lit("both </loc></urlset>"))
    return H.sitemap_pages(root.unionByName(child.select("source", F.concat(site, F.lit("c"), "c", F.lit(".xml")).alias("url"), own.alias("xml"))), cap=5)


# ------------------------------------------------------------------ several phrasings of a question

PHRASED = f"""WITH {BM25}, ne AS (SELECT count(*) AS n FROM embeddings), e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), fo AS (SELECT item_id AS query, unnest([0, 1]) AS form FROM benchmark),
 qv AS MATERIALIZED (SELECT fo.query, fo.form, e.v FROM fo, ne JOIN e ON e.vec_id = (fo.query + fo.form) % ne.n), dv AS MATERIALIZED (SELECT x.doc_id AS doc, e.v FROM documents x, ne JOIN e ON e.vec_id = x.doc_id % ne.n),
 ds AS MATERIALIZED (SELECT a.query, a.form, b.doc, {COS} AS dense_score FROM qv a, dv b),
 de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, form ORDER BY round(dense_score, 9) DESC, doc) AS rank FROM ds) WHERE rank <= 25),
 al AS (SELECT query, doc, 'dense' AS kind, rank, dense_score AS score FROM de UNION ALL SELECT query, doc, 'keyword', keyword_rank, keyword_score FROM kw),
 fu AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS fused_score, min(rank) FILTER (kind = 'dense') AS dense_rank, max(score) FILTER (kind = 'dense') AS dense_score, min(rank) FILTER (kind = 'keyword') AS keyword_rank, count(*) AS lists FROM al GROUP BY ALL)"""


def phrased(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lists of all searches of two forms of each question, the first form's vectors, and documents."""
    asked, docs = vectors(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("_n")))  # one row
    other = table(spark, sf_dir, "benchmark").select("item_id").crossJoin(n).withColumn("vec_id", (F.col("item_id") + 1) % F.col("_n")).join(e, "vec_id").select("item_id", "embedding")
    ranked = lambda q: R.dense_topk(q, docs, 25, "item_id", "doc_id", "embedding", "embedding").select("query", "doc", F.lit("dense").alias("kind"), F.col("dense_rank").alias("rank"), F.col("dense_score").alias("score"))
    words = keyword_hits(spark, sf_dir).select("query", "doc", F.lit("keyword").alias("kind"), F.col("keyword_rank").alias("rank"), F.col("keyword_score").alias("score"))
    return ranked(asked).unionByName(ranked(other)).unionByName(words), asked, docs


@query(PHRASED + " SELECT query, doc, round(fused_score, 9) AS fused_score, dense_rank, keyword_rank, lists FROM fu")
def fused_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank fusion over any number of lists."""
    f = R.fuse(phrased(spark, sf_dir)[0])
    return f.select("query", "doc", F.round("fused_score", 9).alias("fused_score"), "dense_rank", "keyword_rank", "lists")


@query(PHRASED + """, po AS (SELECT * FROM (SELECT fu.*, row_number() OVER (PARTITION BY query ORDER BY round(fused_score, 9) DESC, round(coalesce(dense_score, 0), 9) DESC, doc) AS pool FROM fu) WHERE pool <= 25),
 rs AS (SELECT po.query, po.doc, po.fused_score, coalesce(po.dense_score, ds.dense_score) AS s, x.source FROM po JOIN ds ON ds.query = po.query AND ds.doc = po.doc AND ds.form = 0 JOIN documents x ON x.doc_id = po.doc),
 pl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, round(fused_score, 9) DESC, doc) AS place FROM rs), ov AS (SELECT *, (row_number() OVER (PARTITION BY query, source ORDER BY place) > 2)::INT AS over FROM pl)
 SELECT query, position, doc, round(s, 6) AS dense_score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY over, place) AS position FROM ov) WHERE position <= 6""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with several phrasings (T4, T3, H33): fusion picks, the first phrasing's cosine orders."""
    lists, asked, docs = phrased(spark, sf_dir)
    hits = R.search_many(lists, asked.select(F.col("item_id").alias("query"), F.col("embedding").alias("vector")), docs.select(F.col("doc_id").alias("doc"), F.col("embedding").alias("vector"), "source"), "source", 6)
    return hits.select("query", "position", "doc", F.round("dense_score", 6).alias("dense_score"))
