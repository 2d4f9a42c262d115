"""Operators on small literal tables."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lumenfold.operators import chunking as K
from lumenfold.operators import claims as C
from lumenfold.operators import decisions as D
from lumenfold.operators import lookup as L
from lumenfold.operators import pages as P
from lumenfold.operators import retrieval as R
from lumenfold.sources import html as H
from lumenfold.sources import logs
from lumenfold.streaming import stateful as S


def test_bm25_equals_brute_force(spark):
    docs = [(0, "carte sejour carte"), (1, "sejour visa"), (2, "visa visa long"), (3, ""), (4, "logement")]
    q = [(0, "carte visa visa"), (1, "sejour"), (2, "nothing known")]
    got = {(r["query"], r["doc"]): r["keyword_score"] for r in R.bm25_topk(spark.createDataFrame(q, "q int, t string"), spark.createDataFrame(docs, "d int, t string"), 10, "q", "t", "d", "t").collect()}
    toks = {d: t.split() for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    want = {}
    for i, text in q:
        for d, t in toks.items():
            s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split())
            if s > 0:
                want[i, d] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_diversify_fills_up_with_overflow(spark):
    hits = spark.createDataFrame([(1, i, "a" if i < 4 else "b", -i) for i in range(5)], "query int, doc int, page string, score int")
    got = [r["doc"] for r in R.diversify(hits, [F.desc("score")], "page", 4).orderBy("position").collect()]
    assert got == [0, 1, 4, 2]


def test_gate_is_inclusive_and_refuses_without_a_hit(spark):
    hits = spark.createDataFrame([(1, 0.35), (1, 0.34), (2, 0.1)], "query int, dense_score double")
    got = {(r["query"], r["dense_score"]): (r["passed"], r["should_refuse"]) for r in R.gate(hits).collect()}
    assert got == {(1, 0.35): (True, False), (1, 0.34): (False, False), (2, 0.1): (False, True)}


def test_change_kinds(spark):
    rows = [(1, "", "x"), (2, "Le délai est de 3 mois", "Le delai  est de 3 mois"), (3, "Bonjour a tous", "Salut a tous"), (4, "Joindre un document ici", "Joindre deux documents ici"), (5, "les frais sont fixes", "les frais sont variables")]
    df = spark.createDataFrame(rows, "i int, a string, b string").withColumn("t", F.lit("T"))
    got = {r["i"]: r["change_type"] for r in P.compare(df, "a", "b", "t", "t").collect()}
    assert got == {1: "new", 2: "none", 3: "cosmetic", 4: "critical", 5: "substantive"}


def test_history_depth(spark):
    rows = [(1, 0), (2, 200), (3, 0), (5, 29), (5, 30), (5, 120)]
    got = [r["d"] for r in spark.createDataFrame(rows, "v int, d int").select(P.history_depth(F.col("v"), F.col("d")).alias("d")).collect()]
    assert got == ["insufficient_history", "insufficient_history", "limited_history", "limited_history", "historical_ready", "historical_mature"]


def test_incidents_open_anew_after_a_recovery(spark):
    rows = [("s", "dns", 1, True, 1), ("s", "dns", 2, True, 2), ("s", "", 3, False, 3), ("s", "dns", 4, True, 4), ("r", "dns", 1, True, 5)]
    got = P.incidents(spark.createDataFrame(rows, "source string, kind string, at int, failed boolean, n int"), "source", "kind", "at", "failed", "n")
    assert sorted((r["source"], r["first_seen"], r["occurrence_count"], r["current_status"]) for r in got.collect()) == [("r", 1, 1, "open"), ("s", 1, 2, "resolved"), ("s", 4, 1, "open")]


def test_claims_and_conflicts(spark):
    text = "Le délai est de trois mois pour vous\nLe délai est de trois mois pour vous\nmenu\nValable jusqu'au 31/12/2026 selon le dossier, condition"
    pages = spark.createDataFrame([(1, "s", text), (2, "s", None)], "v int, source string, text string")
    got = C.extract(pages, ["v", "source"], "source", "text").orderBy("position").collect()
    assert [r["position"] for r in got] == [0, 3] and str(got[1]["effective_until"]) == "2026-12-31"
    one = spark.range(1)
    q = one.select(C.quantities(F.lit("De 3,5 mois ou trois jours, 20 €")).alias("q")).first()["q"]
    assert q == ["20 €", "3 jour", "3.5 moi"]


def test_pack_never_divides_what_is_atomic():
    line = "word " * 40
    groups = K.pack([("paragraph", "One sentence. " * 100, []), ("list", "", [line] * 20), ("cases", "", [line, line])], 100, 100, 30)
    assert any(len(g[0]) > 400 and g[0].startswith("- ") for g in groups)
    assert [g for g in groups if g == [line]] == [[line], [line]]
    assert all(K.estimate(p) <= 100 for g in groups for p in g if p.startswith("One"))


def test_page_without_its_furniture():
    page = H.parse('<html lang="fr-FR"><head><title>T &amp; U</title></head><body><nav><a href="/menu">Le menu ici</a></nav><main class="x"><h1>Titre long</h1><p>Un texte utile.<br>Un texte utile.</p><a href="b#c">suite du texte</a></main><div class="cookie-box">non</div></body></html>', "https://a.fr/x/")
    assert page["title"] == "T & U" and page["headings"] == ["Titre long"] and page["language"] == "fr-FR"
    assert page["text"] == "Titre long\nUn texte utile.\nsuite du texte"
    assert page["links"] == ["https://a.fr/menu", "https://a.fr/x/b#c"]


def test_hosts_that_only_look_allowed(spark):
    urls = ["https://a.gouv.fr/x", "https://gouv.fr", "https://evilgouv.fr", "https://gouv.fr.evil.com", "https://gouv.fr@evil.com/", "https://1.2.3.4/", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r["ok"] for r in df.select("i", H.host_allowed(H.host(F.col("u")), ["gouv.fr"]).alias("ok")).orderBy("i").collect()] == [True, True, False, False, False, False, False]


def test_verdict_key_ignores_order_and_accents(spark):
    df = spark.createDataFrame([("Où aller ?", ["b", "a"]), ("ou  ALLER", ["a", "b"]), ("ou aller", ["a"])], "q string, c array<string>")
    k = [r["k"] for r in df.select(D.verdict_key(F.col("q"), F.col("c")).alias("k")).collect()]
    assert k[0] == k[1] != k[2]


def test_clarifications_expire_after_three_turns(spark):
    rows = [("c", 0, "ask:location", "visa?", False), *[("c", i, "reply", "hm", False) for i in (1, 2, 3)], ("c", 4, "reply", "late", True), ("d", 0, "ask:location", "visa?", False), ("d", 1, "reply", "Antibes", True), ("e", 0, "ask:date", "x", False), ("e", 1, "reply", "Actually, forget that", False)]
    got = S.clarifications(spark.createDataFrame(rows, "conversation string, turn long, kind string, message string, answers boolean"))
    assert [r["outcome"] for r in got.orderBy("conversation", "turn").collect()] == ["opened", "waiting", "waiting", "expired", "idle", "opened", "resumed", "opened", "switched"]


def test_streams(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "source string, kind string, at timestamp, failed boolean"
    rows = spark.createDataFrame([("s", "dns", "2024-01-01 00:00:00", True), ("s", "dns", "2024-01-01 01:00:00", True), ("s", "dns", "2024-01-01 02:00:00", False)], "source string, kind string, at string, failed boolean")
    rows.write.json(path)
    q = S.incident_stream(spark.readStream.schema(schema).json(path)).writeStream.outputMode("update").format("memory").queryName("incidents").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["occurrence_count"], r["current_status"]) for r in spark.table("incidents").orderBy("last_seen", "current_status").collect()] == [(1, "open"), (2, "open"), (2, "resolved")]


def test_versions_are_stored_once(spark, tmp_path):
    land, table = str(tmp_path / "land"), str(tmp_path / "versions")
    text = "mot " * 50
    rows = [("s", "u", "2024-01-01 00:00:00", "aaaaaaaaaa", "T", text), ("s", "u", "2024-01-02 00:00:00", "aaaaaaaaaa", "T", text), ("s", "u", "2024-01-03 00:00:00", "bbbbbbbbbb", "T", text), ("s", "u", "2024-01-04 00:00:00", "cccccccccc", "", text)]
    spark.createDataFrame(rows, "source_id string, url string, at string, content_hash string, title string, text string").withColumn("retrieved_at", F.to_timestamp("at")).drop("at").write.parquet(land)
    for i in range(2):
        src = spark.readStream.schema(spark.read.parquet(land).schema).parquet(land)
        S.record_versions(spark, src, table, str(tmp_path / f"ck{i}")).start().awaitTermination()
    assert sorted(r["version_id"] for r in S.stored_versions(spark, table).collect()) == ["20240101T000000Z-aaaaaaaa", "20240103T000000Z-bbbbbbbb"]


def test_logs_and_resumed_index(spark, tmp_path):
    log = tmp_path / "l"
    log.mkdir()
    (log / "a.json").write_text('{"at":"2024-01-01T00:00:00Z","event":"x"}\nnot json\n')
    assert logs.read_log(spark, str(log)).count() == 1
    path = str(tmp_path / "index")
    logs.append_index(spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int"), path)
    logs.append_index(spark.createDataFrame([("b", 3), ("c", 4)], "chunk_id string, v int"), path)
    assert sorted((r["chunk_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 4)]


def test_dense_search_takes_any_number_of_queries(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    search = lambda: {(r["query"], r["dense_rank"]): r["doc"] for r in R.dense_topk(e, e, 6, "vec_id", "vec_id", "embedding", "embedding").collect()}
    whole = search()
    monkeypatch.setattr(R, "MAX_QUERY_BYTES", 100 * 64 * 8)
    monkeypatch.setattr(R, "SHARD", 150)
    assert search() == whole and len(whole) == 6 * e.count()


def test_a_register_of_any_size_is_searched(spark):
    none = F.lit(None).cast("string")
    register = spark.range(1_000_001).select(F.concat(F.lit("School "), F.col("id").cast("string")).alias("name"), none.alias("acronym"), F.array(none).alias("aliases"), F.lit("Lyon").alias("commune"))
    queries = spark.createDataFrame([("school 1000000",), ("School 77",)], "query string")
    got = {(r["query"], r["rank"]): (r["name"], r["tier"]) for r in L.search_institutions(queries, register, 3).collect()}
    assert got[("school 1000000", 1)] == ("School 1000000", 0)
    assert [got[("School 77", i)] for i in (1, 2, 3)] == [("School 77", 0), ("School 770", 1), ("School 771", 1)]


def test_values_at_places_of_the_whole_order(spark, monkeypatch):
    import random

    from lumenfold.operators import telemetry as T

    rnd = random.Random(1)
    values = [rnd.choice([round(rnd.gauss(0, 1), 2), 0.5, float(i)]) for i in range(3000)]
    counted = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    places = [0, 1, 299, 1499, 1500, 2999]
    for ranges in (512, 7):
        monkeypatch.setattr(T, "RANGES", ranges)
        assert T.at_places(counted, places) == [sorted(values)[p] for p in places]
    asked = spark.createDataFrame([(0.5, False), (0.7, False), (None, False), (0.4, True)], "s double, r boolean")
    assert tuple(T.calibration(asked, "s", "r").first()) == (0.5, 0.5, 0.6, 0.7, True)
    assert tuple(T.calibration(asked.where("s > 9"), "s", "r").first()) == (None, None, None, None, False)


def test_substring_search_equals_a_plain_scan(spark):
    import random

    rnd = random.Random(6)
    parts = ["université ", "de ", "paris", "un", "lyon ", "école ", "x", "ens", "'é", " "]
    name = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) or "a"
    rows = [(name(), rnd.choice([None, "ENS", "UP8", "X"]), [name() for _ in range(rnd.randint(0, 2))], rnd.choice(["Paris", "Lyon", None])) for _ in range(300)]
    asked = sorted({name().strip() for _ in range(60)} | {"un", "de", "universite de paris", "zzz", "e", ""})
    fold = lambda x: "".join(c for c in __import__("unicodedata").normalize("NFD", (x or "").lower()) if not __import__("unicodedata").combining(c))
    want = set()
    for q in asked:
        needle, found = fold(q).strip(), []
        if len(needle) < 2:
            continue
        for n, a, more, town in rows:
            fn, fa, others = fold(n), fold(a), [fold(x) for x in [*more, town]]
            tier = 0 if needle in (fn, fa) else 1 if fn.startswith(needle) else 2 if fa.startswith(needle) else 3 if needle in fn else 4 if any(needle in m for m in others) else None
            if tier is not None:
                found.append((tier, len(n), fn, n))
        want |= {(q, i + 1, f[3], f[0]) for i, f in enumerate(sorted(found)[:10])}
    register = spark.createDataFrame(rows, "name string, acronym string, aliases array<string>, commune string")
    got = L.search_institutions(spark.createDataFrame([(q,) for q in asked], "query string"), register, 10).collect()
    assert {(r["query"], r["rank"], r["name"], r["tier"]) for r in got} == want and len(got) == len(want)
