"""Secrets against plain patterns over texts, and what the compressor finds."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def held(rows, got):
    for text, spans in zip(rows, got, strict=True):
        assert [s[:3] for s in spans if s[0] != "novel"] == plain(text)
        assert spans == sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_query_equals_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op13_zstd_secrets(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] + r["n_access"] for r in rows) > 5
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in want) for kind in secrets.KINDS[:3])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == [f"{k}:{a}:{b}" for k, a, b in want]
    assert sum("novel" in r["spans"] for r in rows) < 0.002 * len(rows) + 1


def test_random_pieces_equal_plain_patterns():
    rnd = random.Random(6)
    pieces = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "API__KEY", '"', "'", " ", "  ", "\t", "\n", ":", "=", "==", "abc", "abcdefgh", "AKIA", "AKIA1234567890AB", "0123456789abcdef" * 2, "deadbeef", "é", "ſecret", "toKen", "中", "-", "x" * 9, None]
    texts = ["".join(p for p in (rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) if p) for _ in range(800)] + [None, "", "token=" + "a" * 200_000]
    held(texts, secrets.scan(texts, secrets.Novelty(b"")))


@pytest.mark.parametrize("lead", ["Authorization header, bearer ", "the private_key is ", "cookie -> "])
def test_random_strings_in_sensitive_places_are_found(lead):
    rnd, prose = random.Random(7), "The service reads its settings from the environment and keeps a connection open. "
    keys = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(20, 48))) for _ in range(100)]
    plain_ones = ["_".join(rnd.sample(secrets.IDENTIFIERS, 4)) for _ in range(50)] + ["".join(w.title() for w in rnd.sample(secrets.IDENTIFIERS, 4)) for _ in range(50)] + ["documentation-for-everyone", "internationalisation"]
    novelty = secrets.Novelty(b"")
    found = secrets.scan([prose + lead + k + ". " + prose for k in keys], novelty)
    assert sum(any(s[0] == "novel" and s[1] == len(prose + lead) for s in f) for f in found) >= 90
    assert sum(bool(f) for f in secrets.scan([prose + lead + k + ". " + prose for k in plain_ones], novelty)) <= 5
    assert not any(secrets.scan([prose + "the sum is " + k + ". " + prose for k in keys], novelty))  # no sensitive place


def test_a_string_seen_before_is_no_news():
    novelty, key = secrets.Novelty(b""), b"zq8rt2xwv9lkp4mn7byc3dhf"
    assert novelty.added(b"auth: ", key, b"") >= secrets.NOVEL * len(key)
    assert novelty.added(b"auth " + key + b" auth: ", key, b"") < 0.5 * len(key)


def test_repetitive_texts_stay_linear():
    texts = ["secret/" * 60_000, "secret " + "0" * 400_000, "auth " * 80_000, "password" + " " * 300_000, "AKIA" * 100_000]
    held(texts, secrets.scan(texts, secrets.Novelty(b"")))


def test_odd_rows(spark, odd):
    df = odd.withColumns({"spans": F.lit("x"), "kind": F.lit(1)})
    rows = secrets.secret_spans(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())
    assert all(r["spans"] == [] for r in rows)
    assert secrets.digests(secrets.secret_spans(df.where("false"))).collect() == []
    empty = secrets.digests(secrets.secret_spans(spark.createDataFrame([(1, None)], "doc_id long, text string"))).first()
    assert (empty["base_sha256"], empty["spans"]) == (hashlib.sha256(b"").hexdigest(), "")


def test_all_documents_prime_the_compressor(spark):
    df = spark.createDataFrame([(i, "Werkzeugkasten ähnliches " * (i + 1) + "ähnliches short") for i in range(20)], "doc_id long, text string")
    assert secrets.common_words(df) == "werkzeugkasten ähnliches".encode()
    assert secrets.common_words(df, 12) == "ähnliches".encode()
    assert secrets.common_words(df.where("false")) == b""
