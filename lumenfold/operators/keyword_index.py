"""A keyword index that grows: segments of postings in slices with bounds, and a top-k that reads the slices that can win.

A segment holds the documents of one addition. Documents of like length are dealt to slices of about SLICE of them, and a term's postings
in a slice are one row, with the highest count and the shortest document among them: no document of the slice can
score higher than these two together. A query's bound on a slice is the sum over its terms. The slices with the highest bounds are scored first;
what is the k-th best score then is a threshold, and of the other slices only those whose bound reaches it are scored at all.
Results equal those of scoring everything.

Documents that go, or come anew, get a tombstone in their segment, and what they had is taken off the counts of terms. When FAN segments
of a level have gathered, they become one of the next, without their dead. Every change is one commit of an :class:`AtomicStore`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens
from lumenfold.operators.retrieval import EPSILON, K1, MAX_ASKED, B, postings, top
from lumenfold.sources.atomic import AtomicStore, Change, working_dir

SLICE = 8  # documents
SEEDS = 64  # slices of each query that are scored first
FAN = 4  # segments of a level that are merged
BUCKETS = 32  # that the tables of what is dead are dealt to
FEW = 1024  # queries whose slices are looked up in a list with each row
EXACT = 1e-6  # bounds give way to rounding by more than sums can be off


class KeywordIndex:
    """An index at ``root``. Documents have an id of the type ``id_type`` and a text; ids are unique, the last text counts."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long", buckets: int = BUCKETS):
        self.store, self.spark, self.id_type, self.buckets = AtomicStore(spark, root), spark, id_type, buckets

    # ---------------------------------------------------------------- what is stored

    def segments(self, version: int | None = None) -> list[tuple[str, int]]:
        """(name, level) of the segments."""
        return [(t.split("-")[1], int(t.split("-")[2])) for t in self.store.tables(version) if t.startswith("slices-")]

    def _all(self, kind: str, version: int) -> DataFrame | None:
        """A table of all segments, with the segment's name."""
        out = None
        for name, level in self.segments(version):
            part = self.store.read(f"{kind}-{name}-{level}", version).withColumn("segment", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    def _dead(self, version: int) -> DataFrame:
        return self.store.read("dead", version, schema=f"segment string, doc {self.id_type}, dl int")

    def _lost(self, version: int) -> DataFrame:
        return self.store.read("lost", version, schema="segment string, term string, df long, ctf long")

    # ---------------------------------------------------------------- changes

    def add(self, docs: DataFrame, id_col: str, text_col: str) -> int:
        """Adds documents as one segment; those that the index has already are replaced. One commit, and more where levels are merged."""
        rows = docs.select(F.col(id_col).cast(self.id_type).alias("doc"), F.col(text_col).alias("text"))
        old = self._gone(rows.select("doc")) if self.segments() else []
        forward = rows.select("doc", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("dl"))
        version = self.store.commit(*self._segment(forward, postings(rows.where("text is not null"), "doc", "text"), 0), *old)
        while any(sum(lv == level for _, lv in self.segments()) >= FAN for level in {lv for _, lv in self.segments()}):
            version = self._merge(min(level for level in {lv for _, lv in self.segments()} if sum(lv == level for _, lv in self.segments()) >= FAN))
        return version

    def delete(self, ids: DataFrame) -> int:
        """Takes documents out, by ``doc``."""
        return self.store.commit(*self._gone(ids.select(F.col("doc").cast(self.id_type))))

    def _segment(self, lengths: DataFrame, posts: DataFrame, level: int) -> list[Change]:
        """The tables of a new segment: documents with their lengths, postings by document, slices of postings by term, and counts of terms.

        They are read whole, so none is dealt to buckets: postings stay where their documents lie and move once, to the others of their slice.
        """
        s, name = self.store, uuid.uuid4().hex
        docs = s.append(f"docs-{name}-{level}", lengths)
        kinds = s.staged(docs).groupBy(_length_class(F.col("dl")).alias("kind")).count().collect()  # a row for each class of length, of which there are few
        many = F.coalesce(*[F.when(_length_class(F.col("dl")) == r["kind"], -(-r["count"] // SLICE)) for r in kinds], F.lit(1))
        number = F.pmod(F.xxhash64("doc"), many) * 256 + _length_class(F.col("dl"))
        by_doc = s.append(f"posts-{name}-{level}", posts.select("doc", "dl", "term", "tf"))
        each = F.array_sort(F.collect_list(F.struct("doc", F.col("tf").cast("int").alias("tf"), "dl")))
        dealt = s.staged(by_doc).withColumn("slice", number).repartition("slice")
        rows = dealt.groupBy("term", "slice").agg(each.alias("p"), F.max("tf").cast("int").alias("most"), F.min("dl").alias("shortest"))
        cut = s.append(f"slices-{name}-{level}", rows.select("term", "slice", "most", "shortest", F.size("p").alias("n"), "p"), sort=["term", "slice"])
        counts = s.staged(by_doc).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        return [docs, by_doc, cut, s.append(f"terms-{name}-{level}", counts)]

    def _gone(self, ids: DataFrame) -> list[Change]:
        """Tombstones of documents that the index has, and what goes with them from the counts."""
        version = self.store.version()
        if not self.segments(version):
            return []
        alive = self._all("docs", version).join(self._dead(version), ["segment", "doc"], "left_anti").join(ids.distinct(), "doc", "left_semi")
        dead = self.store.append("dead", alive.select("segment", "doc", "dl"), ["segment"], self.buckets)
        terms = self._all("posts", version).join(self.store.staged(dead).select("segment", "doc"), ["segment", "doc"], "left_semi").groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        return [dead, self.store.append("lost", terms, ["segment"], self.buckets)]

    def _merge(self, level: int) -> int:
        """The segments of a level as one of the next; their dead documents stay behind."""
        version = self.store.version()
        names = [n for n, lv in self.segments(version) if lv == level]
        mine = F.col("segment").isin(*names)
        dead = self._dead(version).where(mine).select("segment", "doc")
        live = lambda kind: self._all(kind, version).where(mine).join(dead, ["segment", "doc"], "left_anti").drop("segment")
        gone = [self.store.drop(f"{kind}-{n}-{level}") for n in names for kind in ("docs", "posts", "slices", "terms")]
        owners = self.spark.createDataFrame([(n,) for n in names], "segment string")
        tidy = [self.store.delete(t, owners) for t in ("dead", "lost") if t in self.store.tables(version)]
        return self.store.commit(*self._segment(live("docs"), live("posts"), level + 1), *gone, *tidy)

    # ---------------------------------------------------------------- search

    def statistics(self, version: int) -> tuple[int, float, float]:
        """(documents, mean length, mean idf over all terms) of what is alive."""
        docs = self._all("docs", version).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        dead = self._dead(version).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        n, total = docs["n"] - dead["n"], docs["t"] - dead["t"]
        # Terms of one df have one idf, so a row for each df is enough.
        spectrum = self._counts(version).groupBy("df").agg(F.count("*").alias("terms"))
        mean = spectrum.agg(F.sum(F.col("terms") * _idf(n)) / F.sum("terms")).first()[0]
        return n, total / n if n else 0.0, mean or 0.0

    def _counts(self, version: int, asked: DataFrame | None = None) -> DataFrame:
        """(term, df) of terms that live documents have."""
        rows = self._all("terms", version).select("term", "df").unionByName(self._lost(version).select("term", (-F.col("df")).alias("df")))
        rows = rows if asked is None else rows.join(asked, "term", "left_semi")
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, queries: DataFrame, k: int, query_id: str, query_text: str, version: int | None = None) -> DataFrame:
        """(query, doc, keyword_score, keyword_rank): as :func:`lumenfold.operators.retrieval.bm25_score`, from the slices that can hold one of the k best."""
        version = self.store.version() if version is None else version
        kind = queries.schema[query_id].dataType.simpleString()
        if not self.segments(version):
            return self.spark.createDataFrame([], f"query {kind}, doc {self.id_type}, keyword_score double, keyword_rank int")
        weights, average, few = self._weights(queries, query_id, query_text, version)
        seeds, wanted = self._two_rounds(weights, average, few, k, version)
        both = seeds.unionByName(self._scores(weights, average, few, wanted, version)).withColumn("_s", F.round("keyword_score", 9))
        return top(both, "query", [F.desc("_s"), F.asc("doc")], k, "keyword_rank").drop("_s")

    def _two_rounds(self, weights: DataFrame, average: float, few: bool, k: int, version: int) -> tuple[DataFrame, DataFrame]:
        """The scores in the slices with the highest bounds, and the other slices whose bound reaches the threshold that these set."""
        path = working_dir(self.spark, "keyword-bounds")
        self._bounds(weights, average, few, version).write.parquet(f"{path}/bounds")
        ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "segment", "slice"))
        bounds = self.spark.read.parquet(f"{path}/bounds")
        first = bounds.withColumn("_n", ranked).where(F.col("_n") <= SEEDS)
        self._scores(weights, average, few, first, version, F.broadcast).write.parquet(f"{path}/seeds")
        seeds = self.spark.read.parquet(f"{path}/seeds")
        least = top(seeds, "query", [F.desc("keyword_score")], k, "_n").groupBy("query").agg(F.when(F.count("*") == k, F.min("keyword_score")).otherwise(0.0).alias("least"))
        open_ = bounds.join(least, "query", "left").where(F.col("bound") + EXACT >= F.coalesce("least", F.lit(0.0)))
        return seeds, open_.join(first, ["query", "segment", "slice"], "left_anti")

    def _weights(self, queries: DataFrame, query_id: str, query_text: str, version: int) -> tuple[DataFrame, float, bool]:
        """(query, term, w) of the queries' terms, the mean length of documents, and whether weights are sent to all tasks and for FEW queries at most."""
        n, average, mean = self.statistics(version)
        asked = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
        side = F.broadcast if asked.count() <= MAX_ASKED else lambda df: df.hint("shuffle_merge")  # as for BM25: postings meet more terms in a shuffle
        idf = F.when(_idf(n) < 0, EPSILON * mean).otherwise(_idf(n))
        weighed = self._counts(version, side(asked.select("term").distinct())).join(side(asked), "term").select("query", "term", (F.col("qtf") * idf * (K1 + 1)).alias("w"))
        if side is not F.broadcast:
            return side(weighed), average, False
        got = weighed.collect()  # at most MAX_ASKED rows are sent
        return F.broadcast(self.spark.createDataFrame(got, weighed.schema)), average, len({r["query"] for r in got}) <= FEW

    def _bounds(self, weights: DataFrame, average: float, few: bool, version: int) -> DataFrame:
        """(query, segment, slice, bound), from the narrow columns of slices alone.

        Of few queries, a slice's terms meet once, before each of them becomes a row for each query that asks for it.
        """
        rows = self._all("slices", version).select("segment", "slice", "term", "most", "shortest")
        if few:
            rows = rows.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi").repartition("slice")  # a single segment is a constant, by which nothing is dealt
        rows = rows.join(weights, "term")
        part = F.greatest(F.col("w"), F.lit(0.0)) * _share(F.col("most"), F.col("shortest"), average)
        return rows.groupBy("query", "segment", "slice").agg(F.sum(part).alias("bound")).where("bound > 0")

    def _scores(self, weights: DataFrame, average: float, few: bool, slices: DataFrame, version: int, side=lambda df: df.hint("shuffle_merge")) -> DataFrame:
        """(query, doc, keyword_score) of live documents in slices, positive scores only. ``side`` says how slices of few queries meet postings, which move once or, if slices are sent to them, not at all."""
        rows = self._all("slices", version).select("segment", "slice", "term", "p")
        if few:
            asked = slices.groupBy("segment", "slice").agg(F.collect_set("query").alias("asked"))
            rows = rows.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi").join(side(asked), ["segment", "slice"])
            rows = rows.join(weights, "term").where(F.array_contains("asked", F.col("query"))).drop("asked")
        else:
            rows = rows.join(weights, "term").join(slices, ["query", "segment", "slice"], "left_semi")
        each = rows.select("query", "segment", "slice", "w", F.explode("p").alias("p")).select("query", "segment", "slice", "p.doc", (F.col("w") * _share(F.col("p.tf"), F.col("p.dl"), average)).alias("part"))
        scored = each.groupBy("query", "segment", "slice", "doc").agg(F.sum("part").alias("keyword_score")).where("keyword_score > 0")
        return scored.join(self._dead(version).select("segment", "doc"), ["segment", "doc"], "left_anti").select("query", "doc", "keyword_score")

    def postings_read(self, queries: DataFrame, k: int, query_id: str, query_text: str) -> tuple[int, int]:
        """(postings that a search scores, postings that its terms have)."""
        version = self.store.version()
        weights, average, few = self._weights(queries, query_id, query_text, version)
        every = self._all("slices", version).select("segment", "slice", "term", "n").join(weights, "term")
        first = top(self._bounds(weights, average, few, version), "query", [F.desc("bound"), "segment", "slice"], SEEDS, "_n")
        wanted = first.select("query", "segment", "slice").unionByName(self._two_rounds(weights, average, few, k, version)[1].select("query", "segment", "slice"))
        read = every.join(wanted, ["query", "segment", "slice"], "left_semi")
        return read.agg(F.sum("n")).first()[0] or 0, every.agg(F.sum("n")).first()[0] or 0


def _length_class(dl: Column) -> Column:
    """Four classes for each doubling of the length; 0 to 127."""
    return F.floor(4 * F.log2(dl + 1)).cast("int")


def _idf(n: int) -> Column:
    return F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _share(tf: Column, dl: Column, average: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / F.lit(average)))
