"""The stored keyword index against BM25 over the documents that are alive."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import keyword_index as K
from lumenfold.operators import retrieval as R

SCHEMA = "d int, t string"


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(8)
    names = [f"mot{i}" for i in range(120)]
    return lambda n: " ".join(rnd.choices(names, weights=[1 / (i + 1) for i in range(120)], k=n)), rnd


def held(index, asked, alive, k=10):
    shown = lambda df: sorted((r["query"], r["keyword_rank"], r["doc"], round(r["keyword_score"], 8)) for r in df.collect())
    got, want = shown(index.search(asked, k, "q", "t")), shown(R.bm25_topk(asked, alive, k, "q", "t", "d", "t"))
    assert got == want
    return len(got)


def test_additions_deletions_and_merges(spark, tmp_path, words):
    text, rnd = words
    index = K.KeywordIndex(spark, str(tmp_path / "ix"), "int", buckets=2)
    alive = {}
    asked = spark.createDataFrame([(i, text(5)) for i in range(6)] + [(6, "absent"), (7, "mot3 mot3 mot90"), (8, "")], "q int, t string")
    assert index.search(asked, 10, "q", "t").collect() == []
    for n in range(5):
        new = {rnd.randrange(150): text(rnd.randint(1, 80)) for _ in range(40)}
        if n == 1:
            new |= {500: "", 501: None, 502: "mot119 mot119"}
        alive |= new
        index.add(spark.createDataFrame(list(new.items()), SCHEMA), "d", "t")
        if n in (1, 3):
            dead = rnd.sample(sorted(alive), 12) + [9999]
            index.delete(spark.createDataFrame([(i,) for i in dead], "doc int"))
            alive = {i: t for i, t in alive.items() if i not in dead}
        if n in (0, 1, 4):
            assert held(index, asked, spark.createDataFrame(list(alive.items()), SCHEMA)) > 40
    assert sorted(level for _, level in index.segments()) == [0, 1]  # four became one
    assert index._dead(index.store.version()).count() < 40


def test_slices_that_cannot_win_are_not_scored(spark, tmp_path, words, monkeypatch):
    text, _ = words
    monkeypatch.setattr(K, "SEEDS", 4)
    docs = [(i, text(20)) for i in range(600)] + [(1000 + i, "mot100 mot110 mot115 " * 3) for i in range(12)]
    df, asked = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(0, "mot100 mot0 mot110 mot1")], "q int, t string")
    index = K.KeywordIndex(spark, str(tmp_path / "ix"), "int", buckets=2)
    index.add(df, "d", "t")
    assert held(index, asked, df, 5) == 5
    read, whole = index.postings_read(asked, 5, "q", "t")
    assert 0 < read < 0.5 * whole


def test_a_version_stays_as_it_was(spark, tmp_path):
    index = K.KeywordIndex(spark, str(tmp_path / "ix"), "int", buckets=2)
    asked = spark.createDataFrame([(0, "carte visa")], "q int, t string")
    first = index.add(spark.createDataFrame([(1, "carte sejour"), (2, "logement"), (3, "caf")], SCHEMA), "d", "t")
    index.add(spark.createDataFrame([(1, "logement"), (4, "visa")], SCHEMA), "d", "t")
    assert [r["doc"] for r in index.search(asked, 5, "q", "t").collect()] == [4]
    assert [r["doc"] for r in index.search(asked, 5, "q", "t", version=first).collect()] == [1]


def test_slices_meet_before_queries_multiply_them(spark, tmp_path, words, monkeypatch):
    """a posting moves once, not once for each query that asks for its term; searches of many queries give the same."""
    text, _ = words
    df, asked = spark.createDataFrame([(i, text(30)) for i in range(300)], SCHEMA), spark.createDataFrame([(i, text(6)) for i in range(5)], "q int, t string")
    index = K.KeywordIndex(spark, str(tmp_path / "ix"), "int", buckets=2)
    index.add(df.where("d < 150"), "d", "t")
    version = index.add(df.where("d >= 150"), "d", "t")
    weights, average, *few = index._weights(asked, "q", "t", version)
    bounds = index._bounds(weights, average, *few, version)
    scores = index._scores(weights, average, *few, spark.createDataFrame(bounds.collect(), bounds.schema), version)
    for found in (bounds, scores):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query" not in plan, [x[:70] for x in plan.split("Exchange ")[1:]]
    monkeypatch.setattr(K, "SEEDS", 2)
    assert held(index, asked, df) == 50
    monkeypatch.setattr(K, "FEW", 0)
    assert held(index, asked, df) == 50


def test_postings_of_a_segment_are_not_dealt_to_buckets(spark, tmp_path):
    """postings were shuffled by document, by slice and by term; now they are written where they are made and move to their slices alone."""
    index = K.KeywordIndex(spark, str(tmp_path / "k"))
    index.add(spark.range(300).select("id", F.concat(F.lit("alle mots "), (F.col("id") % 40).cast("string"), F.lit("x "), F.repeat(F.lit("y1 "), (F.col("id") % 5).cast("int"))).alias("t")), "id", "t")
    held = index.store.manifest()["tables"]
    assert {n.split("-")[0]: t["buckets"] for n, t in held.items()} == {"docs": 0, "posts": 0, "slices": 0, "terms": 0}
    slices = next(index.store.read(n) for n in held if n.startswith("slices-"))
    assert slices.count() == slices.select("term", "slice").distinct().count() and slices.where("term = 'mots'").agg(F.sum("n")).first()[0] == 300
    assert slices.where("term = 'mots'").selectExpr("count(*) = count(distinct slice) and max(n) <= 64").first()[0]
