"""Encoding, packing and ORC output against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import orc_tokens, packing
from lumenfold.llm.encode import PieceEncoder

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}


def library(kind, texts):
    t = Tokenizer.from_file(public_tokenizers.path(FILES[kind]))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_pieces_give_the_ids_of_whole_texts(kind):
    parts = ["a", " ", "\n", "'s", "é", "1", "!", "́", "\t", "the", "\x1d", "<|endoftext|>", "<|startoftext|>", "<|", "\0", "averylongwordofmorethantwentythreebytes", "Σ", "İ", " ", "क़", ".", " .", ","]
    rnd = random.Random(4)
    texts = ["", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(2000))]
    enc = PieceEncoder(public_tokenizers.path(FILES[kind]), kind, limit=50)
    got = []
    for i in range(0, len(texts), 100):
        flat, cut = enc.flat(texts[i : i + 100], 1)
        got += [flat[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    assert got == [[*x, 1] for x in library(kind, texts)]
    assert enc.memo.n <= 50


def test_added_tokens_are_the_librarys():
    """An untouched tokenizer takes the string of an added token as that token."""
    enc = PieceEncoder(public_tokenizers.path(FILES["byte"]), "byte")
    assert enc.flat(["hi <|endoftext|> x"])[0].tolist() == [5303, 220, 50256, 2124]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_documents_have_the_ids_of_whole_texts(docs, kind):
    texts = [r["text"] for r in docs.select("text").collect()]
    flat, cut = PieceEncoder(public_tokenizers.path(FILES[kind]), kind).flat(texts)
    assert [flat[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)] == library(kind, texts)


def test_hilbert_neighbours_are_grid_neighbours():
    g = np.stack(np.meshgrid(range(8), range(8), indexing="ij"), -1).reshape(-1, 2)
    path = g[np.argsort(packing.hilbert_key(g, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing_holds_every_id_once(spark, request, which):
    df = request.getfixturevalue(which)
    rows = packing.pack_documents(df, public_tokenizers.path(FILES["byte"]), "byte", 64 if which == "odd" else 2048).toPandas()
    src = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = sorted(str((d, [*i, 1])) for (d, _), i in zip(src, library("byte", [t for _, t in src]), strict=True))
    parts, at = [], {}
    for r in rows.sort_values(["sequence_id", "offset"]).itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        if r.start == 0:
            parts.append((None if r.doc_id != r.doc_id else int(r.doc_id), []))
        parts[-1][1].extend(r.ids)
    assert sorted(str((d, [int(x) for x in i])) for d, i in parts) == want
    full = sorted(at)
    assert full == list(range(len(full))) and all(at[s] == (64 if which == "odd" else 2048) for s in full[:-1])


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_orc_round_trip(spark, request, tmp_path, which):
    df, path = request.getfixturevalue(which), str(tmp_path / "orc")
    got = orc_tokens.encode_to_orc(df, public_tokenizers.path(FILES["word"]), "word", path).toPandas().sort_values("start")
    src = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: r[:2])
    ids = [[*i, 1] for i in library("word", [t for *_, t in src])]
    assert got["n_tokens"].tolist() == [len(i) for i in ids]
    assert got["start"].tolist() == np.cumsum([0, *map(len, ids[:-1])]).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in ids]
    some = orc_tokens.read_token_ids(spark, path, [5])
    assert "PushedFilters: [" in some._jdf.queryExecution().toString() and some.count() == len([1 for _, d, _ in src if d == 5])


def scanned(df):
    """Rows that the scan of a plan gave, after its filters were pushed down."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    plan = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_indexes_and_bloom_filters_skip_rows_and_readers_share_a_file(spark, tmp_path):
    path, n = str(tmp_path / "orc"), 6000
    rnd = random.Random(1)
    rows = [(2 * i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40))) for i in range(n)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        orc_tokens.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.path(FILES["word"]), "word", stripe_bytes=200_000, stride=1000)
        one, absent = orc_tokens.read_token_ids(spark, path, [7000]), orc_tokens.read_token_ids(spark, path, [7001])
        assert scanned(one) <= 1000 and one.count() == 1  # a row group of one stripe
        assert scanned(absent) == 0  # within the group's range, but not in its Bloom filter
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = orc_tokens.read_token_ids(spark, path)
        got = parts.select("doc_id", "n_tokens").collect()
        assert parts.rdd.getNumPartitions() > 2 and sorted(r["doc_id"] for r in got) == [r[0] for r in rows]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_empty_tables(spark, odd):
    none = odd.where("doc_id = -1")
    assert packing.pack_documents(none, public_tokenizers.path(FILES["byte"])).count() == 0
    assert orc_tokens.encode_to_orc(none, public_tokenizers.path(FILES["word"]), "word").count() == 0
