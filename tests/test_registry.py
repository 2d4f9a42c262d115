"""Registries, places, institutions, ingestion, stores and clarifications on small literal tables."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import conversation as V
from lumenfold.operators import entities as E
from lumenfold.operators import ingest as I
from lumenfold.operators import pages as P
from lumenfold.operators import places as L
from lumenfold.operators import registry as G
from lumenfold.operators import retrieval as R
from lumenfold import settings as C
from lumenfold.operators import store as S
from lumenfold.operators import telemetry as T
from lumenfold.sources import logs
from lumenfold.sources import publications as X
from lumenfold.sources import registries as Y

yaml = pytest.importorskip("yaml")


def written(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(yaml.safe_dump(content, sort_keys=False, allow_unicode=True) if name.endswith("yml") else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    return str(path)


GOOD = {"id": "a", "name": "A", "domain": "A.fr", "base_url": "https://a.fr", "source_type": "Government"}


def test_sources_are_read_and_checked(spark, tmp_path):
    path = written(tmp_path, "r.yml", {"sources": [GOOD | {"aliases": ["B.fr"], "verified": True, "health": "healthy"}, GOOD | {"id": "b", "jurisdiction": "city", "authority_level": 1}]})
    a, b = Y.sources(spark, path).orderBy("file_order").collect()
    assert (a["domain"], a["aliases"], a["source_type"], a["authority_level"], a["freshness_hours"], a["health"]) == ("a.fr", ["b.fr"], "government", 2, 720, "healthy") and (b["jurisdiction"], b["authority_level"], b["verified"]) == ("city", 1, False)
    for bad, why in (({"source_type": "blog"}, "source_type"), ({"health": "fine"}, "health"), ({"base_url": "http://a.fr"}, "https"), ({"jurisdiction": "moon"}, "jurisdiction")):
        with pytest.raises(Y.RegistryError, match=f"a.*{why}"):
            Y.sources(spark, written(tmp_path, "bad.yml", {"sources": [GOOD | bad]}))
    with pytest.raises(Y.RegistryError, match="twice"):
        Y.sources(spark, written(tmp_path, "bad.yml", {"sources": [GOOD, GOOD]}))
    with pytest.raises(Y.RegistryError, match="no readable"):
        Y.sources(spark, str(tmp_path / "none.yml"))
    checked = Y.with_checks(Y.sources(spark, path), spark.createDataFrame([("b", "healthy"), ("a", "blocked")], "id string, health string"), "2024-05-01")
    assert {r["id"]: (r["health"], r["verified"], r["verified_at"]) for r in checked.collect()} == {"a": ("blocked", True, ""), "b": ("healthy", True, "2024-05-01")}
    live = Y.with_live(Y.sources(spark, path), spark.createDataFrame([("b",)], "id string"))
    assert {r["id"]: r["live_query_enabled"] for r in live.collect()} == {"a": False, "b": True}


def test_other_registries_keep_their_order(spark, tmp_path):
    path = written(tmp_path, "t.yml", {
        "topics": {"z": {"purposes": ["p"], "preferred": ["government"]}, "a": None}, "purposes": {"money": {"keywords": ["fee"], "page_types": ["fees"]}}, "page_types": {"fees": {"paths": ["/fees"]}},
        "procedures": {"renewal": {"label": "Renewal", "all_of": [["renew", "renouvel"], ["permit"]]}}, "regions": [{"id": "r", "name": "R"}], "departments": [{"code": "06", "id": "d", "name": "D", "cities": ["C"]}],
        "questions": [{"id": "q1", "segment": "student", "en": "How?", "fr": "Comment ?", "expect_refusal": True}],
    })
    assert [(r["id"], r["purposes"], r["file_order"]) for r in Y.topics(spark, path).orderBy("file_order").collect()] == [("z", ["p"], 0), ("a", [], 1)]
    assert Y.purposes(spark, path).first()["keywords"] == ["fee"] and Y.page_types(spark, path).first()["paths"] == ["/fees"]
    assert [tuple(r) for r in Y.procedures(spark, path).collect()] == [("renewal", "Renewal", 0, "renew"), ("renewal", "Renewal", 0, "renouvel"), ("renewal", "Renewal", 1, "permit")]
    assert Y.regions(spark, path).count() == 1 and Y.departments(spark, path).first()["cities"] == ["C"] and Y.questions(spark, path).first()["expect_refusal"]


def test_glossary_and_institutions(spark, tmp_path):
    path = written(tmp_path, "g.json", {"Visa": {"en": "Visa", "explanation_en": "x", "explanation_fr": "y"}, "Bail": {"en": "Lease", "explanation_en": "x", "explanation_fr": "y", "aliases_en": ["rental contract"], "source": "official", "definition_id": "R1"}})
    terms = Y.glossary(spark, path)
    assert [(r["fr"], r["is_official"]) for r in terms.collect()] == [("Bail", True), ("Visa", False)]
    assert {tuple(r) for r in Y.aliases(terms).collect()} == {("Bail", "bail"), ("Bail", "lease"), ("Bail", "rental contract"), ("Visa", "visa")}
    assert [r["fr"] for r in Y.search_glossary(terms, " RENTAL").collect()] == ["Bail"] and Y.search_glossary(terms, "").count() == 2
    rows = spark.createDataFrame([("Université Z", "UZ, Zed", "38 - Isère", "Mother (0380)"), ("École A", None, "Isère", None), ("  ", "x", None, None)], "nom string, sigle string, departement string, universite_de_rattachement_libelle_et_uai string")
    got = Y.institutions(rows).collect()
    assert [(r["name"], r["departement"], r["departement_id"], r["aliases"]) for r in got] == [("École A", "Isère", "Isère", []), ("Université Z", "Isère", "38", ["Mother", "UZ", "Zed"])]
    assert [r["name"] for r in Y.universities(Y.institutions(rows)).collect()] == ["Université Z"]


def test_places_and_institutions_as_people_write_them(spark):
    towns = spark.createDataFrame([("06", "Alpes-Maritimes", ["Antibes", "Nice"], 0), ("38", "Isère", ["Grenoble", "Saint-Martin"], 1), ("69", "Rhône", ["Lyon", "Saint-Martin"], 2)], "code string, name string, cities array<string>, file_order int")
    asked = [(1, "I live in Antibes and need a flat"), (2, "I need a nice flat"), (3, "Antibes, please"), (4, "à la préfecture du 69"), (5, "in Saint-Martin"), (6, "the isere office in Lyon"), (7, "near Grenoble Business School"), (8, None), (9, "06")]
    df = spark.createDataFrame(asked, "id int, text string")
    got = {r["id"]: (r["how"], r["department"], r["candidates"]) for r in L.resolve(df, "id", "text", towns).collect()}
    assert got == {1: ("introduced", "06", []), 3: ("name", "06", []), 4: ("code", "69", []), 5: ("introduced", None, ["38", "69"]), 6: ("department", "38", []), 7: ("introduced", "38", [])}
    reply = {r["id"]: r["department"] for r in L.resolve(df, "id", "text", towns, reply=True).collect()}
    assert reply[2] == "06" and reply[9] == "06" and reply[5] is None and 8 not in reply
    register = spark.createDataFrame([("Montpellier Business School", "MBS"), ("Montpellier Business", ""), ("Sorbonne Université", "SU")], "name string, acronym string")
    turns = [(1, 1, "I want Montpellier Business School"), (1, 2, "what does this school cost"), (2, 1, "what does the school cost"), (2, 2, "MBS then"), (3, 1, "How in France"), (3, 2, "is Sorbonne good")]
    res = {(r["c"], r["t"]): (r["institution"], r["from_context"], r["needs_clarification"]) for r in E.resolve(spark.createDataFrame(turns, "c int, t int, text string"), "c", "t", "text", register).collect()}
    assert res[1, 1] == ("Montpellier Business School", False, False) and res[1, 2] == ("Montpellier Business School", True, False) and res[2, 1] == (None, False, True)
    assert res[2, 2][0] == "Montpellier Business School" and res[3, 1][0] is None and res[3, 2][0] is None


def test_archives_to_chunks_to_index(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    pub = lambda n, body: f'<Publication xmlns:dc="http://purl.org/dc/elements/1.1/" ID="F{n}"><dc:title>T{n}</dc:title><Texte><Chapitre><Titre>C</Titre>{body}</Chapitre></Texte></Publication>'
    for name, files in {"part-2024-01-01": {"old.xml": pub(9, "<Paragraphe>old</Paragraphe>")}, "part-2024-05-01": {"a/F1.xml": pub(1, "<Paragraphe>same</Paragraphe>"), "../F2.xml": pub(2, "<Paragraphe>" + "A sentence. " * 500 + "</Paragraphe>"), "x.txt": "no"}, "pro-2024-05-01": {"F1.xml": pub(1, "<Paragraphe>same</Paragraphe>")}}.items():
        with zipfile.ZipFile(folder / f"{name}.zip", "w") as z:
            for member, content in files.items():
                z.writestr(member, content)
    found = I.archives(spark, str(folder))
    assert sorted((r["segment"], r["day"]) for r in found.collect()) == [("part", "2024-05-01"), ("pro", "2024-05-01")]
    files = I.members(found)
    assert sorted((r["segment"], r["source_file"]) for r in files.collect()) == [("part", "F1.xml"), ("part", "F2.xml"), ("pro", "F1.xml")]
    logs.write_manifest(I.manifest(found, files, "3.5"), str(tmp_path / "manifest"))
    assert sorted((r["segment"], r["documents"], r["feed_version"]) for r in logs.read_manifest(spark, str(tmp_path / "manifest")).collect()) == [("part", 2, "3.5"), ("pro", 1, "3.5")]
    chunks = I.ingest(files, "3.5", F.lit("2024-06-01"), F.lit("2024-06-01").cast("date")).cache()
    rows = {r["chunk_id"]: r for r in chunks.collect()}
    assert rows["F1#000#01"]["also_published_for"] == "entreprendre" and rows["F1#000#01"]["text"] == "T1\nSection : C\n\nsame" and len(rows) == 3 and len(chunks.columns) == 25
    assert all(r["token_count"] <= I.BUDGET + 10 for r in rows.values()) and {r["part_count"] for r in rows.values() if r["fiche_id"] == "F2"} == {len(rows) - 1}
    path = str(tmp_path / "index")
    I.write_index(I.embed(I.metadata(chunks).join(chunks.select("chunk_id", "text"), "chunk_id"), "text"), path, "chunk_id")
    back = I.read_index(spark, path, ["chunk_id", "embedding"])
    assert back.count() == len(rows) and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in back.collect())
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-2024-05-01.zip").write_bytes(b"no zip")
    with pytest.raises(Exception, match="no readable zip"):
        I.members(I.archives(spark, str(bad))).collect()


def test_chunks_never_divide_what_belongs_together():
    block = lambda kind, text="", items=(): {"kind": kind, "text": text, "items": list(items), "label": "", "url": ""}
    line = "word " * 40
    got = I.parts_of([block("paragraph", "One sentence. " * 100), block("list", items=[line] * 20), block("cases", items=[line, line]), block("paragraph", "end")], 100, 100, 30_000)
    assert [k for _, ks in got for k in ks if k != "paragraph"] == ["list", "cases"] and got[-1][0].endswith("end")
    cases = I.parts_of([block("paragraph", "a"), block("cases", items=[line, " ", line]), block("paragraph", "b")], 100, 100, 60)
    assert [b for b, _ in cases] == ["a", line, line, "b"]


def test_stored_postings_score_as_documents_do(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["carte sejour carte", "sejour visa", "visa visa long", "", "logement"])], "d int, t string")
    asked = spark.createDataFrame([(0, "carte visa visa"), (1, "logement")], "q int, t string")
    R.write_postings(docs, str(tmp_path / "kw"), "d", "t", 4)
    posts, terms = R.read_postings(spark, str(tmp_path / "kw"), asked, "t")
    got, want = (sorted((r["query"], r["doc"], round(r["keyword_score"], 9)) for r in df.collect()) for df in (R.bm25_score(asked, posts, terms, 10, "q", "t"), R.bm25_topk(asked, docs, 10, "q", "t", "d", "t")))
    assert got == want and len(got) == 4


def test_sinks_and_queues(spark, tmp_path):
    claims = spark.createDataFrame([("s", "v1", "c1", "current"), ("s", "v2", "c2", "current"), ("t", "v1", "c3", "current")], "source_id string, version_id string, claim_id string, status string")
    path = str(tmp_path / "claims")
    S.save_partitioned(claims, path, ["source_id", "version_id"])
    S.save_partitioned(claims.where("version_id = 'v1' and source_id = 's'").withColumn("status", F.lit("stale")), path, ["source_id", "version_id"])
    assert {(r["claim_id"], r["status"]) for r in S.saved(spark, path).collect()} == {("c1", "stale"), ("c2", "current"), ("c3", "current")}
    assert [r["claim_id"] for r in S.load_claims(spark, path, "s", "v2").collect()] == ["c2"]
    conflicts = spark.createDataFrame([("CONF-1", "a", "newer")], "conflict_id string, prefer string, prefer_reason string")
    S.append_conflicts(conflicts, str(tmp_path / "conflicts"))
    S.append_conflicts(conflicts, str(tmp_path / "conflicts"))
    assert S.read_conflicts(spark, str(tmp_path / "conflicts")).count() == 2 and S.review_conflicts(conflicts).first()["recommended_reason"] == "newer"
    card = "capability string, status string"
    assert S.read_latest(spark, str(tmp_path / "card"), card).count() == 0
    for n, status in enumerate(("failed", "blocked")):
        S.write_snapshot(spark.createDataFrame([("x", status)], card), str(tmp_path / "card"), f"2024-05-0{n + 1}")
    assert S.read_latest(spark, str(tmp_path / "card"), card).first()["status"] == "blocked" and S.read_history(spark, str(tmp_path / "card"), card).count() == 2
    bugs = spark.createDataFrame([("BUG-1", "open"), ("BUG-2", "resolved")], "id string, status string")
    assert [r["id"] for r in S.listing(bugs, "id", "status").collect()] == ["BUG-2", "BUG-1"]
    with pytest.raises(ValueError, match="none of"):
        S.listing(bugs, "id", "status", "closed", ("open", "resolved"))


def test_every_critical_word_makes_a_change_critical(spark):
    words = ["document", "justificatif", "pièce", "condition", "éligible", "eligibility", "délai", "deadline", "date limite", "obligatoire", "required", "admission", "candidature"]
    rows = [(w, "Bonjour à tous ici", f"Il faut un {w} maintenant") for w in words] + [("tarif", "Bonjour à tous ici", "Le tarif est changé ici")]
    got = {r["w"]: r["change_type"] for r in P.compare(spark.createDataFrame(rows, "w string, a string, b string").withColumn("t", F.lit("T")), "a", "b", "t", "t").collect()}
    # A word that marks no line leaves the change without signal lines.
    assert {w: got[w] for w in words if w not in ("date limite",)} == {w: "critical" for w in words if w not in ("date limite",)} and got["date limite"] == "critical" and got["tarif"] == "substantive"


def test_categories_severity_and_topics_as_published(spark):
    cases = {"Le tarif du dossier est fixé": (["fee"], "critical", ["tuition", "taxes"]), "Contact par téléphone au guichet": (["contact"], "medium", ["contact"]), "L'adresse est rue Neuve ici": (["address"], "medium", ["contact"])}
    df = spark.createDataFrame([(t, "") for t in cases], "t string, o string")
    names = P.categories(F.lower(F.translate("t", "éà", "ea")))
    for r in df.select("t", names.alias("n")).select("t", "n", P.severity(F.col("n")).alias("s"), P.topics(F.col("n")).alias("p")).collect():
        want = cases[r["t"]]
        assert (r["n"], r["s"], r["p"]) == want, r


def test_topics_stay_invalid_until_answers_are_made_anew(spark):
    at = lambda d: datetime.datetime(2024, 5, d)
    first = P.invalidations(spark.createDataFrame([("s", "v1", at(1), "critical", ["taxes", "work"]), ("s", "v2", at(2), "cosmetic", ["health"])], "source_id string, version_id string, retrieved_at timestamp, change_type string, affected_topics array<string>"))
    later = P.invalidations(spark.createDataFrame([("s", "v3", at(3), "substantive", ["taxes"])], "source_id string, version_id string, retrieved_at timestamp, change_type string, affected_topics array<string>"), first)
    assert {r["topic"]: (r["at"], r["version_id"]) for r in later.collect()} == {"taxes": (at(3), "v3"), "work": (at(1), "v1")}
    answers = spark.createDataFrame([(1, ["taxes"], at(2)), (2, ["taxes"], at(4)), (3, ["health"], at(1)), (4, [], at(1))], "answer int, topics array<string>, made_at timestamp")
    assert {r["answer"]: r["valid"] for r in P.still_valid(answers, later).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_plans_name_what_cannot_be_reached(spark):
    sources = spark.createDataFrame(
        [("mbs", "MBS", "school", 1, "live_query", 0, ["Z"], []), ("pref", "Préfecture", "local_authority", 1, "live_query", 1, [], ["residence-permit"]), ("caf", "CAF", "public_body", 1, "unavailable", 2, [], ["housing"]), ("crous", "CROUS", "public_body", 2, "sync_only", 3, [], ["student-housing"])],
        "id string, name string, source_type string, authority_level int, mode string, file_order int, supported_entities array<string>, supported_topics array<string>",
    )
    topics = spark.createDataFrame([("permits", 0, ["residence_permit"], ["local_authority", "government"], ["corpus"]), ("homes", 1, ["housing"], ["public_body"], [])], "id string, file_order int, purposes array<string>, preferred array<string>, fallback array<string>")
    asked = spark.createDataFrame([(1, ["housing"], None, None), (2, ["residence_permit", "housing"], "Z", "pref"), (3, ["residence_permit"], None, None), (4, [], None, None)], "question int, purposes array<string>, entity string, authority_source string")
    got = {r["question"]: r for r in G.plan(asked, topics, sources).collect()}
    assert [s["source_id"] for s in got[1]["steps"]] == ["crous"] and got[1]["unreachable"] == got[1]["unreachable_deciders"] == ["CAF"] and not got[1]["fall_back"] and not got[1]["live_steps"]
    assert [(s["source_id"], s["reason"]) for s in got[2]["steps"]] == [("mbs", "institution"), ("pref", "local authority")] and got[2]["topic"] == "permits" and not got[2]["needs_place"]
    assert got[3]["needs_place"] and not got[3]["has_authority"] and got[4]["fall_back"] and got[4]["topic"] is None


def test_clarifications_by_batch_and_stream(spark, tmp_path):
    turns = [
        ("a", 1, "ask:location", "How to validate?", None, None), ("a", 2, "reply", "Antibes", "06", None), ("a", 3, "ask:location", "", None, None), ("a", 4, "ask:entity", "", None, None), ("a", 5, "reply", "MBS", None, "Montpellier Business School"),
        ("b", 1, "ask:user_status", "What do I need?", None, None), ("b", 2, "reply", "hm", None, None), ("b", 3, "reply", "hm hm", None, None), ("b", 4, "reply", "what", None, None), ("b", 5, "reply", "later", None, None),
        ("c", 1, "ask:location", "Q", None, None), ("c", 2, "reply", "Actually, how do I get a visa?", None, None),
    ]
    df = spark.createDataFrame(turns, "conversation string, turn long, kind string, message string, location string, entity string").withColumns({c: F.lit(None).cast("string") for c in ("user_status", "purpose", "date")})
    want = {
        ("a", 1): ("opened", "How to validate?"), ("a", 2): ("resumed", "How to validate?"), ("a", 3): ("refused", "How to validate?"), ("a", 4): ("opened", "How to validate?"), ("a", 5): ("resumed", "How to validate? (Montpellier Business School)"),
        ("b", 1): ("opened", "What do I need?"), ("b", 2): ("waiting", "What do I need?"), ("b", 3): ("waiting", "What do I need?"), ("b", 4): ("expired", "what"), ("b", 5): ("idle", "later"), ("c", 1): ("opened", "Q"), ("c", 2): ("switched", "Actually, how do I get a visa?"),
    }
    out = V.dialogue(df)
    assert {(r["conversation"], r["turn"]): (r["outcome"], r["question"]) for r in out.collect()} == want
    last = out.where("conversation = 'a' and turn = 5")
    d = spark.createDataFrame([("06", "Alpes-Maritimes", "paca", "pref-06", "Préfecture 06")], "code string, name string, region string, prefecture_source string, prefecture_name string")
    r = V.retrieval_context(last, d).first()
    assert (r["department"], r["authority_source"], r["institution"], r["filled"]) == ("Alpes-Maritimes", "pref-06", "Montpellier Business School", ["entity", "location"])
    df.where("turn <= 2").coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: V.dialogue_stream(spark.readStream.schema(df.schema).json(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    stream()
    df.where("turn > 2").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream()
    assert {(r["conversation"], r["turn"]): (r["outcome"], r["question"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_status_words_and_dates(spark):
    rows = [("Je suis étudiante", "student"), ("Oui !", "yes"), ("nope", "no"), ("I'm a visitor", "visitor"), ("hm", None), (None, None)]
    got = spark.createDataFrame(rows, "m string, want string").select("want", V.status_of(F.col("m")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_documents_with_two_bodies_of_one_id(spark):
    pub = '<Publication xmlns:dc="http://purl.org/dc/elements/1.1/" ID="F1"><dc:title>T</dc:title><Texte><Paragraphe>{}</Paragraphe></Texte></Publication>'
    files = [("a.xml", "part", pub.format("one")), ("a.xml", "pro", pub.format("one")), ("b.xml", "pro", pub.format("two"))]
    docs = I.deduplicate(X.read_publications(spark.createDataFrame(files, "source_file string, segment string, xml string")))
    assert sorted((r["doc_id"], r["segments"]) for r in docs.collect()) == [("F1", ["part", "pro"]), ("F1@pro", ["pro"])]


def test_settings_are_read_and_checked():
    s = C.Settings({"A": " 5 ", "B": "", "C": "Yes", "D": "x, y,,z ", "E": "many", "F": "0.5"})
    assert (s.whole("A", 1), s.whole("B", 7), s.flag("C", False), s.names("D"), s.names("B", ("q",)), s.number("F", 1.0), s.text("none", "d")) == (5, 7, True, ("x", "y", "z"), ("q",), 0.5, "d")
    for read in (lambda: s.whole("E", 1), lambda: s.flag("E", True), lambda: s.number("E", 1.0)):
        with pytest.raises(ValueError, match="E must be"):
            read()
    assert C.feed_url("https://x/{version}/{segment}.zip", "3.5", "part") == "https://x/3.5/part.zip"
    with pytest.raises(ValueError, match="segment"):
        C.feed_url("https://x/", "3.5", "part")


def test_percentiles_are_exact_beyond_what_is_sorted_whole(spark, monkeypatch):
    monkeypatch.setattr(T, "WHOLE", 10)
    monkeypatch.setattr(T, "SLACK", 0.01)
    df = spark.range(5000).selectExpr("id % 2 AS g", "CASE WHEN id % 7 > 0 THEN CAST((id * 7919) % 5003 AS DOUBLE) / 3 END AS v")
    got = {r["g"]: r for r in T.percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.0), F.lit(0.5), F.lit(0.95), F.lit(1.0))).alias("p"), F.count("v").alias("n")).collect():
        assert got[r["g"]]["n"] == r["n"] and all(abs(got[r["g"]][f"p{k}"] - x) < 1e-9 for k, x in enumerate(r["p"]))
