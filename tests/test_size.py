"""What grows with the tables is never sent whole to the driver or left to one task, and is done once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens
from lumenfold.operators import claimcheck as V
from lumenfold.operators import conversation as D
from lumenfold.operators import lookup as L
from lumenfold.operators import pages as P
from lumenfold.operators import registry as G
from lumenfold.operators import retrieval as R
from lumenfold.operators import settle as C
from lumenfold.plans import intake, operations, sources
from lumenfold.plans import pages as plans_of_pages
from lumenfold.sources import html as H
from lumenfold.sources.atomic import AtomicStore

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tasks(df) -> int:
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def test_reports_of_a_busy_day_keep_their_numbers(spark, tmp_path):
    """number 1,000 of a day isn't cut to 100."""
    store = AtomicStore(spark, str(tmp_path))
    rows = spark.range(1002).select(F.col("id").alias("report"), F.lit("2024-05-01").cast("timestamp").alias("at"), F.lit("x").alias("raw_text"))
    replies = spark.createDataFrame([], "report long, reply string, error string")
    C.submit(store, rows, replies, spark.createDataFrame([], "report long, sent boolean, problem string"))
    ids = {r[0] for r in store.read("reports").select("id").collect()}
    assert len(ids) == 1002 and {"BUG-20240501-001", "BUG-20240501-1000", "BUG-20240501-1002"} <= ids


def test_texts_are_not_sent_to_a_glossary(spark, tmp_path):
    """F7."""
    spark.createDataFrame([(1, "a dark red flat"), (2, "no term")], "id long, text string").write.parquet(str(tmp_path / "t"))
    aliases = spark.createDataFrame([("dark red", "t1"), ("red", "t1"), ("flat", "t2")], "alias string, term string")
    got = L.find_terms(spark.read.parquet(str(tmp_path / "t")), "id", "text", aliases)
    assert "BuildLeft" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "t1", "dark red"), (1, "t2", "flat")]


def test_only_pages_that_are_reached_are_parsed(spark):
    """F1."""
    page = '<html><body><a href="https://a.fr/{}">one</a></body></html>'
    raw = spark.createDataFrame([(i, f"https://a.fr/{i}", page.format(i + 1)) for i in range(6)], "page_id long, url string, html string")
    asked = []

    def read(ids):
        asked.append({r[0] for r in ids.collect()})
        return H.read_pages(raw.join(ids, "page_id", "left_semi"))

    got = H.discover(read, raw.where("page_id = 0").select("page_id"), known=raw.select("page_id", "url"))
    assert sorted(map(tuple, got.collect())) == [("https://a.fr/1", 1, "one"), ("https://a.fr/2", 2, "one")] and asked == [{0}, {1}]


@pytest.mark.parametrize("make", [intake.pages, operations._publications, sources.place_texts, intake.files])
def test_rows_of_one_small_file_are_work_for_all_cores(spark, make):
    """F21, F24, F29, F22, F23."""
    assert tasks(make(spark, SF)) >= spark.sparkContext.defaultParallelism


def test_steps_of_a_route_do_not_travel(spark):
    """lists meet the questions; each source once, in order of file within its class."""
    q = spark.createDataFrame([(1, 1, 7, 3, True), (2, 1, None, 3, False), (3, None, None, 3, True)], "question long, topic long, institution long, department long, wants_local boolean")
    s = spark.createDataFrame(
        [(10, 7, 3, [1], "national", "live_query", 5), (11, 0, 3, [], "department", "live_query", 4), (12, 0, 3, [1], "department", "live_query", 2), (13, 0, 9, [1, 2], "national", "live_query", 1), (14, 7, 3, [1], "national", "unavailable", 0)],
        "source_id long, entity long, department long, topics array<long>, jurisdiction string, mode string, file_order long",
    )
    got = L.route(q, s)
    assert "Window" not in plan(got)
    near, wide = "local authority", "national"
    assert sorted(map(tuple, got.collect())) == [(1, 1, 10, "institution"), (1, 2, 12, near), (1, 3, 11, near), (1, 4, 13, wide), (2, 1, 13, wide), (2, 2, 10, wide), (3, 1, 11, near)]


def test_questions_of_one_kind_are_planned_once(spark):
    """F2."""
    got = G.plan(sources.questions(spark, SF), sources.topics(spark, SF), sources.sources(spark, SF))
    assert "_ask" in plan(got) and got.count() == sources.questions(spark, SF).count()


def test_claims_and_evidence_are_not_sent_to_the_driver(spark):
    """F3, F4, F5, F6, F8, F17."""
    text = plan(V.judge(*operations.drafts(spark, SF)))
    assert "Broadcast" not in text


def test_python_meets_batches_of_conversations(spark):
    """F25."""
    rows = [("a", 2, "reply", "Antibes", "06"), ("a", 1, "ask:location", "Q", None), ("b", 1, "reply", "hm", None)]
    turns = spark.createDataFrame(rows, "conversation string, turn long, kind string, message string, location string")
    got = D.dialogue(turns.withColumns({f: F.lit(None).cast("string") for f in D.FIELDS if f != "location"}))
    assert "FlatMapGroups" not in plan(got)
    assert sorted(map(tuple, got.select("conversation", "turn", "outcome", "filled").collect())) == [("a", 1, "opened", []), ("a", 2, "resumed", ["location"]), ("b", 1, "idle", [])]


def test_tokens_in_one_pass(spark):
    """apostrophes part words, single characters fall away, and no function is called for each token."""
    df = spark.createDataFrame([("L’été d'Ana ʼtisʼnt a 12 b2 x_y 𝒳𝒴",)], "t string").select(tokens(F.col("t")).alias("t"))
    assert df.first()[0] == ["ete", "ana", "tis", "nt", "12", "b2", "𝒳𝒴"] and "lambda" not in plan(df)


def test_white_space_and_numbers_read_as_before_by_fewer_steps(spark):
    """only what has to change is replaced, and words of numbers are looked for by their first letters."""
    from lumenfold.functions.text import squeeze
    from lumenfold.operators import claims as K

    df = spark.createDataFrame([(" a b  c\td  e \n f\u0085",)], "t string")
    assert df.select(squeeze(F.col("t"))).first()[0] == "a b c d e f"
    assert K.longest_of(["six", "sixteen", "dix"]) == "s(?:ixteen|ix)|d(?:ix)"
    n = spark.createDataFrame([(1, "s", "Frais de trois mois à compter du 1er juillet 2024\nune ligne de cinq mots frais")], "v int, s string, t string")
    got = {r["position"]: r for r in K.extract(n, ["v", "s"], "s", "t").collect()}
    assert str(got[0]["effective_from"]) == "2024-07-01" and got[1]["effective_from"] is None and got[0]["effective_until"] is None


def peak_mb(f) -> tuple[list, float]:
    """What an iterator gives, and the arrays that numpy held at once meanwhile."""
    tracemalloc.start()
    try:
        return list(f()), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_search_holds_few_scores_at_once(spark):
    """1,024 queries against a batch of 8,192 vectors took over 200 MB a worker."""
    rnd = np.random.default_rng(5)
    q, v = rnd.normal(size=(1024, 4)), rnd.normal(size=(8192, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8192)), pa.array(list(v), pa.list_(pa.float64()))], names=["doc", "v"])
    run = R._dense(list(range(1024)), q.tobytes(), 4, 1)
    got, most = peak_mb(lambda: (b.num_rows for b in run(iter([batch]))))
    assert most < 64 and sum(got) == 1024 * 20
    best = {}
    for b in run(iter([batch])):
        for i, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            best[i] = max(best.get(i, (0, 0)), (s, d))
    want = np.argmax(q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, axis=1)
    assert [best[i][1] for i in range(1024)] == want.tolist()


def test_terms_are_counted_slice_by_slice(spark):
    """So are the terms of a batch of two million tokens, documents whole."""
    docs = [[f"t{(i * 7 + j) % 50}" for j in range(2000)] if i % 3 else ([] if i % 2 else None) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(docs, pa.list_(pa.string()))], names=["doc", "t"])
    got, most = peak_mb(lambda: R._count_terms(iter([batch])))
    assert most < 24 and {n for b in got for n in b.column("dl").to_pylist()} == {2000}
    assert sorted((d, t, n) for b in got for d, t, n in zip(*(b.column(c).to_pylist() for c in ("doc", "term", "tf")), strict=True)) == sorted((i, f"t{k}", 40) for i in range(1500) if i % 3 for k in range(50))


def test_cosines_of_an_answer_are_found_in_one_row(spark, tmp_path):
    """they equal those of columns, whatever the lengths of vectors, and no vector goes along with a pair of claim and sentence."""
    vectors = {"a": [1.0, 2.0], "b": [2.0, -1.0], "c": [0.0, 0.0], "d": None, "e": [3.0], "g": [-1.0, -2.0], "h": []}
    facts = lambda x, name: F.struct(F.lit(x).alias("folded")).alias(name)
    base = spark.range(1).select(F.lit(7).alias("answer"))
    claims = [base.select("answer", F.lit(1 + i // 2).alias("claim_no"), F.lit(i % 2).alias("variant"), facts(x, "f")) for i, x in enumerate(vectors)]
    said = [base.select("answer", F.lit(i + 1).alias("place"), facts(x, "s")) for i, x in enumerate(reversed(vectors))]
    union = lambda parts: parts[0].unionByName(union(parts[1:])) if len(parts) > 1 else parts[0]
    table = spark.createDataFrame(list(vectors.items()), "t string, v array<float>")
    embed = lambda df: df.join(table, F.col("text") == F.col("t")).select("hash", "text", F.col("v").alias("vector"))
    c, s = V.with_cosines(union(claims), union(said), AtomicStore(spark, str(tmp_path)), embed)
    got = c.join(s, "answer").select(F.col("f.folded").alias("a"), F.col("s.folded").alias("b"), V.by_cosines(F.col("f"), F.col("s")).alias("x")).collect()
    pairs = table.select(F.col("t").alias("a"), F.struct(F.col("v").alias("vector")).alias("u")).crossJoin(table.select(F.col("t").alias("b"), F.struct(F.col("v").alias("vector")).alias("w")))
    want = {(r["a"], r["b"]): r["x"] for r in pairs.select("a", "b", V.by_vectors(F.col("u"), F.col("w")).alias("x")).collect()}
    assert len(got) == 49 and {(r["a"], r["b"]): round(r["x"], 12) for r in got} == {k: round(x, 12) for k, x in want.items()}
    judged = V.judge(*operations.drafts(spark, SF), vectors=(AtomicStore(spark, str(tmp_path / "j")), lambda df: df.withColumn("vector", F.array(F.lit(1.0)))))
    assert "zip_with" not in plan(judged)


def test_versions_are_compared_along_their_pages_as_in_pairs(spark):
    """what a comparison reads is found once a version, and only what is asked for."""
    texts = ["Les frais sont de 3 euros\r\nVoir https://a.fr/x", "les  FRAIS sont de 3\teuros\nvoir https://a.fr/x", None, "", "Le délai est de 2 mois\rContact au guichet ici", "Le délai est de 2 mois\nLe délai est de 4 mois", "x y"]
    rows = [(p, i, texts[(i * (p + 1) + p) % 7], [None, "T", "U"][(i + p) % 3]) for p in range(5) for i in range(7)]
    v = spark.createDataFrame(rows, "page int, at int, text string, title string")
    w = Window.partitionBy("page").orderBy("at")
    pairs = v.withColumns({"old": F.lag("text").over(w), "old_title": F.lag("title").over(w)})
    want = sorted(P.compare(pairs, "old", "text", "old_title", "title").drop("old", "old_title").collect(), key=lambda r: r[:2])
    got = P.compare_along(v, "page", ["at"], "text", "title")
    assert got.columns == [*v.columns, *P.FOUND] and sorted(got.collect(), key=lambda r: r[:2]) == want
    late = P.compare_along(v, "page", ["at"], "text", "title", ("change_type", "affected_topics"), spark.createDataFrame([(3,)], "a int"), "at")
    assert sorted((r["page"], r["at"], r["change_type"], r["affected_topics"]) for r in late.collect()) == [(r["page"], r["at"], r["change_type"], r["affected_topics"]) for r in want if r["at"] > 3]
    text = plan(plans_of_pages.answers_still_valid(spark, SF))
    assert "_after" in text and "https?" not in text and "line(s)" not in text


def test_routes_of_like_questions_are_spread_step_by_step(spark):
    """a step of questions of one kind is one run of rows; questions without an id, or with the same one, keep their rows."""
    q = spark.createDataFrame([(n % 200 if n else None, 1, None, 3, False) for n in range(400)], "question long, topic long, institution long, department long, wants_local boolean")
    s = spark.createDataFrame([(i, 0, 9, [1], "national", "live_query", i) for i in range(50)], "source_id long, entity long, department long, topics array<long>, jurisdiction string, mode string, file_order long")
    got = [tuple(r) for r in L.route(q, s).collect()]
    assert sorted(map(str, got)) == sorted(str((n % 200 if n else None, i + 1, i, "national")) for n in range(400) for i in range(50))
    runs = 1 + sum(a[1:] != b[1:] for a, b in zip(got, got[1:]))
    assert runs <= 50 * (spark.sparkContext.defaultParallelism + 1)
