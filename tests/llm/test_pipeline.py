"""The pipeline's stages, each on its own input."""

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline as P
from lumenfold.llm import decontaminate, minhash, substring
from lumenfold.llm.common import shared_dir
from lumenfold.llm.queries import table

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    from tests.llm.test_dedup import classes, removed

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns, name
        kept[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    a, b = kept["toxicity"]
    gone = set(a) - set(b)
    assert sum(labels.get(d) == 1 for d in gone) >= 0.75 * sum(labels.get(d) == 1 for d in a) and len(gone) < 0.25 * len(a)
    a, b = kept["minhash near-dedup"]
    assert set(b) == set(classes(sorted(a.items())).values())
    a, b = kept["substring dedup"]
    want = removed(list(a.items()))
    assert set(a) == set(b) and all(len(b[d].split()) == want[d][0] - want[d][1] for d in b) and all(b[d] == a[d] for d in b if not want[d][1])
    a, b = kept["benchmark decontamination"]
    items = [decontaminate.normal(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    leaks = {d for d, t in a.items() if any(i in decontaminate.normal(t) for i in items)}
    assert leaks and leaks == set(a) - set(b)
    pieces = P.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces["doc_id"]) == set(b) and (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()
    assert minhash.LEAST == 0.8


def test_rows_without_an_id_or_with_a_shared_one_stay(spark):
    from tests.llm.test_dedup import words

    rnd = random.Random(3)
    a, b, c, d, e = (" ".join(words(rnd, 60)) for _ in range(5))
    rows = [(None, a, "n"), (None, b, "n"), (7, c, "x"), (7, d, "y"), (8, d, "z"), (9, e, "x"), (9, e, "x"), (None, e, "n"), (10, None, "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.keep_one_of_each_class(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == Counter([(None, a, "n"), (None, b, "n"), (7, c, "x"), (7, d, "y"), (9, e, "x"), (10, None, "t")])
    got = P.cut_repeats(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["source"]) for r in got) == sorted((str(i), s) for i, _, s in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {(r["doc_id"], r["source"]): r["text"] for r in got if r["text"] and r["text"] in (c, d)} == {(7, "x"): c, (7, "y"): d}
    assert {r["text"] for r in got if r["doc_id"] is None} >= {a, b} and sum(r["text"] == e for r in got) == 1


def through(spark, docs):
    """Rows after each stage but the last."""
    out = []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        out.append(docs)
    return out


def test_odd_rows_pass_all_stages(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the stages use themselves."""
    rows = [(None, "a text without any id at all here", None), (1, None, "x"), (2, "", "x"), (3, "  \n\t ", "x"), (4, "same text here", "x"), (5, "same text here", "y"), (5, "same text here", "y"), (6, "Very long words. " * 20_000, "x"), (7, "!!! ???", None), (8, "İ ﬁ क़. <|endoftext|>  a\x1cb", "x")]
    docs = spark.createDataFrame([(i, t, s, s, len(t or ""), s, 1.0, 2) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string, _score double, block int")
    stages = through(spark, docs)
    assert all(df.columns == docs.columns for df in stages)
    kept = stages[0].collect()
    assert len(kept) == len(rows)  # nothing is toxic
    texts = [r["text"] for r in stages[1].collect()]
    assert sorted(t or "" for t in texts) == sorted({t or "" for _, t, _ in rows})  # one of each text: a null is an empty one
    cut = {r["doc_id"]: r for r in stages[2].collect()}
    assert len(cut) == len(texts) and all(r["n_chars"] == len(r["text"]) for r in cut.values()) and len(cut[6]["text"].split()) < 100
    pieces = P.STAGES[-1][1](spark, stages[3], SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in stages[3].collect()}


def test_an_empty_table_passes_all_stages(spark):
    docs = table(spark, SF, "documents")
    stages = through(spark, docs.where("doc_id < 0"))
    assert [df.count() for df in stages] == [0, 0, 0, 0] and all(df.columns == docs.columns for df in stages) and P.STAGES[-1][1](spark, stages[-1], SF).count() == 0


def test_run_leaves_only_its_result(spark):
    folder = Path(shared_dir(spark)) / "lumenfold"
    before = set(folder.iterdir()) if folder.exists() else set()
    out = P.run(spark, "/root/testdata/sf0.001")
    # What the stages returned may still be read by who holds it; the tables between stages are gone.
    assert out.count() > 0 and sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before) == ["kept-rows", "pieces", "stage-packing", "substring"]


def test_texts_do_not_move_to_the_rows_that_stay(spark, monkeypatch):
    """Of each class one row stays where it lies, however many there are: no join moves texts by a row's number."""
    plans, write = {}, minhash.materialise

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    monkeypatch.setattr(minhash, "materialise", seen)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 400)
    docs = spark.createDataFrame([(i, f"text {i // 2} has a few words of number {i // 2} only", "fr", None) for i in range(60)], "doc_id long, text string, lang string, n long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash.one_of_each_class(docs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [tuple(r) for r in docs.where("doc_id % 2 = 0").orderBy("doc_id").collect()]
    assert "Join" not in plans["kept-rows"] and plans["kept-rows"].count("Exchange ") <= 1  # of the numbers of rows that stay
