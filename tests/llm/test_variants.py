"""Spelling variants against every pair of words, and their parts against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import queries, variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows, least=6, rare=199):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if rare and h % rare == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_forms(n, times=5, ratio=5):
    words = {w: c for w, c in n.items() if c >= times}
    near, out = {w: [] for w in words}, set()
    left = {}
    for w in words:  # words that share a deletion, or one of which is another's deletion
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            left.setdefault(x, []).append(w)
    for group in left.values():
        for a in group:
            near[a] += [b for b in group if a != b and one_edit(a, b)]
    form = {}
    for w in words:
        near[w] = sorted(set(near[w]), key=lambda x: (-words[x], x))
        if near[w] and words[near[w][0]] >= ratio * words[w]:
            form[w] = near[w][0]
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return out


def made(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_every_pair(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, sf)
    want = plain_forms(plain_counts(rows))
    assert made(got) == want and got.count() == len(want)
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want if w[1]) == any(w[1] and w[2] != w[1] for w in want)


def test_chains_ties_and_long_words(spark):
    rnd = random.Random(4)
    many = [("abcdef", 5), ("abcdeg", 30), ("abcdehg", 200), ("abcdehgi", 1000), ("aaaaaa", 6), ("aaaaaaa", 30), ("aaaaaab", 30), ("éééééé", 5), ("ééééééà", 25)]
    base = "".join(rnd.choice("abcxyzéü") for _ in range(63))
    many += [(base, 5), (base + "q", 25), (base + "qr", 125), (base[:30] + "w" + base[31:] + "qr", 25), (base + "qrs", 5), ("z" * 300, 7), ("z" * 301, 40), ("z" * 302, 5)]
    many += [("".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))), rnd.choice([1, 5, 5, 9, 26, 130])) for _ in range(400)]
    rows = [(i, " ".join([w] * c)) for i, (w, c) in enumerate(many)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = variants.variant_forms(df, rare=0)
    want = plain_forms(plain_counts(rows, rare=0))
    assert made(got) == want
    assert next(w for w in want if w[0] == "abcdef")[2] == "abcdehgi"
    assert next(w for w in want if w[0] == base)[2] == base + "qr"


def test_counts_equal_a_plain_loop(spark):
    rnd = random.Random(5)
    alphabet = "abcXYZÀÿ×÷ßſKéÉ0_ \n’中ªĀ"
    rows = [(i if i % 7 else None, "".join(rnd.choice(alphabet) * rnd.choice([1, 1, 1, 3]) for _ in range(rnd.randint(0, 4000)))) for i in range(60)] + [(1, None), (2, ""), (3, "x" * 3000), (3, "x" * 3000), (4, "É" * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rare in (199, 3, 0):
        got = variants.word_counts(df.repartition(3), 6, rare).collect()
        assert {r["word"]: r["n"] for r in got} == dict(plain_counts(rows, 6, rare))


def test_strings_decide_where_hashes_are_equal():
    """All keys are made equal, as if every hash collided."""
    words = sorted(["abcdef", "abcdeg", "abcde", "xbcdef", "zzzzz", "zzzzzz", "qqqqqq"])
    n = {w: 5 + i * 3 for i, w in enumerate(words)}
    rows = [(w, -1, True) for w in words] + [(w, i, i == 0 or w[i] != w[i - 1]) for w in words for i in range(len(w))]
    rows.sort(key=lambda r: (r[1], -n[r[0]], r[0]))
    near, best = variants.partners(np.zeros(len(rows), np.int64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([n[r[0]] for r in rows]), np.array([r[0].encode() for r in rows], "S"))
    total, top = Counter(), {}
    for (w, _, _), k, b in zip(rows, near, best, strict=True):
        total[w] += int(k)
        if k:
            top[w] = min(top.get(w, (0, "~")), (-n[rows[b][0]], rows[b][0]))
    for w in words:
        own = [x for x in words if x != w and one_edit(w, x)]
        assert total[w] == len(own) and (not own or top[w] == min((-n[x], x) for x in own))


def test_deletion_keys_are_hashes_of_deletions():
    words = [b"abcabc", b"zz", b"q" * 70, bytes(range(192, 256))]
    raw = np.frombuffer(b"".join(words), np.uint8)
    _, place, without, first = variants.deletion_keys(raw, np.array([len(w) for w in words]))
    at = 0
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            assert place[at] == i and first[at] == (i == 0 or w[i] != w[i - 1])
            assert without[at] == variants.deletion_keys(np.frombuffer(rest, np.uint8), np.array([len(rest)]))[0][0]
            at += 1


def test_groups_that_cross_batches(spark):
    rows = sorted((k, k, -1, True, f"w{k:05d}a", 5) for k in range(40)) + [(40, 40, p, True, w, n) for p, w, n in [(0, "xabcdef", 9), (0, "yabcdef", 7), (0, "zabcdef", 6)]]
    batch = pa.Table.from_pylist([dict(zip(("key", "radix", "place", "first", "word", "n"), r, strict=True)) for r in rows]).combine_chunks().to_batches()[0]
    whole = sorted(str(r) for b in variants._sorted_keys([batch]) for r in b.to_pylist())
    for size in (1, 2, 7):
        assert sorted(str(r) for b in variants._sorted_keys([batch.slice(i, size) for i in range(0, len(rows), size)]) for r in b.to_pylist()) == whole
    assert len(whole) == 3


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    df = odd.withColumns({"word": F.lit("w"), "n": F.lit(1), "key": F.lit(2)})
    assert made(variants.variant_forms(df)) == plain_forms(plain_counts(rows))
    assert variants.variant_forms(df.where("false")).collect() == []
