"""Toxicity, language, nearest neighbours, sharding and URL lists."""

import datetime
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann, language, queries, sharding, toxicity, url_filter
from lumenfold.llm.words import PUNCT, Words

SF = "/root/testdata/sf0.01"


def test_noisy_or_finds_the_sentence_at_fault(spark):
    rnd = random.Random(1)
    clean = lambda: " ".join(f"w{rnd.randrange(400)}" for _ in range(8)) + ". "
    texts = ["".join(clean() for _ in range(rnd.randint(1, 9))) + ("you are a blorkhead. " if i % 2 else "") for i in range(400)]
    labels = np.array([i % 2 for i in range(400)])
    w = toxicity.train(texts[:300], labels[:300])
    assert ((toxicity.score_texts(texts[300:], w) >= 0.5) == labels[300:]).mean() >= 0.98
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[300:])], "doc_id long, text string")
    found = toxicity.offending_sentences(df, w).collect()
    assert found and all("blorkhead" in r["sentence"] for r in found)


def test_scores_equal_a_plain_noisy_or():
    """Sentence by sentence and word by word, with no arrays."""
    rng = np.random.default_rng(2)
    weights = np.append(rng.standard_normal(1 << toxicity.BITS), -3.0)
    texts = ["One two, three. FOUR five!\n\nsix?", "", None, "...", "été naïve-word x", "a b c " * 50 + ". tail"]

    def word(w):
        return sum(weights[f[0]] for f in toxicity.features(Words([w.encode()], PUNCT)))

    for t, got in zip(texts, toxicity.score_texts(texts, weights), strict=True):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", (t or "").lower()):
            if words := re.findall("[0-9a-z\x80-\U0010ffff]+", sentence):
                p, floor = (1 / (1 + math.exp(-z)) for z in (sum(map(word, words)) + weights[-1], weights[-1]))
                clean *= 1 - max(0.0, p - floor) / (1 - floor)
        assert abs(got - (1 - clean)) < 1e-9


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(1, "bad thing"), (1, "bad thing"), (2, "good thing"), (2, "zzz")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    want = toxicity.train(["bad thing", "good thing"], np.array([1, 0]))
    assert np.allclose(toxicity.fit(docs, labels), want.astype("<f4"))
    langs = docs.withColumn("lang", F.lit("xx"))
    assert language.fit(langs).langs == ["xx"] and language.fit(langs.where("doc_id < 0")).langs == []


def test_probabilities_equal_a_plain_network():
    net = language.Network(["a", "b", "c"])
    text = "Grüße an die Welt, " * 9
    raw = text.encode() + b" " * (-len(text.encode()) % language.WINDOW)
    p, want = {k: v.astype(float) for k, v in net.p.items()}, []
    for s in range(0, len(raw), language.WINDOW):
        part = (raw[s : s + language.WINDOW + language.WIDEST - 1] + b" " * language.WIDEST)[: language.WINDOW + language.WIDEST - 1]
        hidden = []
        for f in range(language.FILTERS * len(language.WIDTHS)):
            width = language.WIDTHS[f // language.FILTERS]
            sums = [sum(p["embed"][part[i + j]] @ p["conv"].reshape(language.WIDEST, language.EMBED, -1)[j, :, f] for j in range(width)) for i in range(language.WINDOW)]
            hidden.append(max(0.0, max(sums) + p["bias"][f]))
        z = np.exp(np.array(hidden) @ p["out"] + p["base"])
        want.append(z / z.sum())
    mean = np.mean(want, axis=0)
    langs, scores = net.predict([text, "½ ² Ⅷ 12 _", None])
    assert langs == [["a", "b", "c"][int(mean.argmax())], "und", "und"] and abs(scores[0] - mean.max()) < 1e-5


def test_toxicity_of_held_out_documents(spark):
    out = queries.op7_toxicity_mil(spark, "/root/testdata/sf0.1").join(queries.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    toxic = out["toxic"] == 1
    assert (out["predicted"][toxic] == 1).mean() > 0.8 and (out["predicted"][~toxic] == 0).mean() > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.itertuples())


def test_toxicity_of_odd_rows(spark, odd):
    w = toxicity.fit(odd, spark.createDataFrame([(4, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int"))
    got = toxicity.score(odd, w).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and {r["score"] for r in got if r["doc_id"] in (1, 2)} == {0.0}
    empty = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(odd.where("doc_id = -1"), empty).count() == 0
    assert toxicity.add_score(odd, w).columns == [*[c for c in odd.columns if c != "score"], "score"]


def test_language_of_held_out_documents(spark):
    out = queries.op8_language_cnn(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b"])
    x, y = rng.integers(0, 256, (6, language.WINDOW + language.WIDEST - 1), np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.gradients(x, y)
    for name, at in (("conv", (3, 2)), ("out", (5, 1)), ("embed", (int(x[0, 3]), 2)), ("base", (1,)), ("bias", (4,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[name][at]) < 1e-4, name
        net.p[name][at] = old


def test_language_of_odd_rows(spark, odd, docs):
    net = language.fit(docs)
    got = language.predict(odd, net).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 7)} == {"und"}
    assert language.predict(odd, language.fit(docs.where("lang = 'xx'"))).where("lang_pred <> 'und'").count() == 0


def test_neighbours_recall(spark):
    e = queries.table(spark, SF, "embeddings")
    data = e.toPandas()
    v = np.stack(data["embedding"]).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in ann.nearest(e).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    ids, hits, all_ = data["vec_id"].to_numpy(), 0, 0
    for q in ids[ids % 50 == 0]:
        sims = unit @ unit[ids == q][0]
        best = [int(ids[i]) for i in np.argsort(-sims, kind="stable") if ids[i] != q][:5]
        hits += len(set(best) & {x for x, _ in got[q].values()})
        all_ += 5
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and all(abs(s - sims[ids == x][0]) < 1e-9 for x, s in got[q].values())
    assert hits / all_ >= 0.9


def test_neighbours_among_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 30)] + [(50, [1.0, 0.1]), (100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (0, [1.0, 0.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    by = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}
    assert [by[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [by[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and len(by) == 10
    few = ann.nearest(spark.createDataFrame(rows[30:31] + [(51, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(50, 1, 51)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_any_size_length_and_direction(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 200)  # several blocks of queries
    rng = np.random.default_rng(3)
    big = rng.standard_normal((60, 8)) * 10.0 ** rng.integers(-250, 250, (60, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(big)]
    rows += [(100 + i, [float(i + 1), 2.0 * (i + 1)]) for i in range(80)]  # one direction, over BEAM of them
    rows += [(250, [1.0, 2.0]), (300, [1.0]), (350, [1.0, 2.0, 3.0]), (0, rows[7][1])]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = big / np.abs(big).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (50,):
        best = [(i, unit[i] @ unit[q]) for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5]
        assert [g[0] for g in got[q]] == [b[0] for b in best] and np.allclose([g[1] for g in got[q]], [b[1] for b in best], atol=1e-12)
    assert got[0][0] == (7, pytest.approx(1.0)) and len({g[0] for g in got[0]}) == 5
    assert [g[0] for g in got[100]] == [101, 102, 103, 104, 105] and [g[0] for g in got[250]] == [100, 101, 102, 103, 104]
    assert not got[300] and not got[350]


def test_shards_of_the_default_grain_come_near_plain_lpt(spark):
    rnd = random.Random(7)
    texts = [str(i) * rnd.randint(1, 60) for i in range(9000)] + ["x" * 40_000] * 3
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8)
    mine = sorted(r["n"] for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect())
    sizes = defaultdict(int)
    for t in texts:
        sizes[t] += len(t) + 1
    plain, to = defaultdict(int), sharding.lpt(list(enumerate(sizes.values())), 8)
    for i, size in enumerate(sizes.values()):
        plain[to[i]] += size
    assert mine[-1] - max(plain.values()) <= 2 * sum(sizes.values()) / 4096 and mine[0] >= min(plain.values()) - 2 * sum(sizes.values()) / 4096


def test_shards_equal_lpt_over_groups(spark):
    rnd = random.Random(3)
    texts = ["x" * (2 ** rnd.randint(1, 12)) + str(rnd.randrange(40)) for _ in range(300)]
    rows = list(enumerate(texts))
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, grain=10**6).collect()
    sizes = defaultdict(int)
    for t in texts:
        sizes[t] += len(t) + 1
    to = sharding.lpt(list(enumerate(sizes.values())), 4)
    loads = sorted(sum(s for i, s in enumerate(sizes.values()) if to[i] == k) for k in range(4))
    mine = defaultdict(int)
    for r in got:
        mine[r["shard"]] += r["size"]
    assert max(mine.values()) <= max(loads) * 1.001
    for t in set(texts):
        assert len({r["shard"] for r in got if texts[r["doc_id"]] == t}) == 1
    for k in mine:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_shards_of_odd_rows(spark, odd):
    got = sharding.shard_documents(odd, 3).collect()
    assert len(got) == odd.count() and len({r["shard"] for r in got if r["doc_id"] in (4, 5)}) == 1 and len({r["shard"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.shard_documents(odd.where("doc_id = -1"), 3).count() == 0


def test_lists_are_judged_as_of_the_fetch(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    log = [("spam", "block", "a.example.org", "add", day(10)), ("spam", "block", "a.example.org", "remove", day(20)), ("spam", "block", "a.example.org", "add", day(20)), ("spam", "block", "a.example.org", "remove", day(25)), ("ok", "allow", "example.org", "add", day(0)), ("bad", "block", "example.org", "add", day(15)), ("x", "block", None, "add", day(0)), ("x", "block", "b.org", "add", None)]
    entries = spark.createDataFrame(log, "list_name string, policy string, key string, action string, day date")
    seen = [(n, "http://u@A.Example.org:80/x", day(n)) for n in (9, 10, 19, 20, 25)] + [(100, None, day(1)), (101, "no url", day(1)), (102, "https://b.org", None), (103, "https://other.org", day(1)), (104, "http://[::1]:8080/" + "x" * 50_000, day(1)), (9, "http://A.example.org", day(9))]
    got = sorted((r["page_id"], r["blocked"], r["list_name"], r["entry_key"]) for r in url_filter.judge(spark.createDataFrame(seen, "page_id long, url string, day date").withColumn("key", F.lit("clash")), entries).collect())
    assert [g[1:] for g in got if g[0] == 9] == [(False, "ok", "example.org")] * 2
    assert {g[0]: g[1:] for g in got if 10 <= g[0] <= 25} == {10: (True, "spam", "a.example.org"), 19: (True, "spam", "a.example.org"), 20: (True, "spam", "a.example.org"), 25: (True, "bad", "example.org")}
    assert all(g[1:] == (False, None, None) for g in got if g[0] >= 100) and len(got) == len(seen)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, day date"), entries).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(str, cur.fetchall()))
