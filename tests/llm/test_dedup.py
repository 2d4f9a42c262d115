"""Near-duplicate classes, substring removal and decontamination against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import decontaminate, minhash, substring


def words(rnd, n):
    return [f"w{rnd.randrange(3000)}" for _ in range(n)]


def family(rnd, n, length, edits):
    """Copies of one text with up to ``edits`` words changed."""
    base, out = words(rnd, length), []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(length)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    shared = " ".join(words(rnd, 60))
    texts = family(rnd, 60, 120, 4) + family(rnd, 20, 80, 2) + [shared + " " + " ".join(words(rnd, 40)) for _ in range(40)]
    texts += [" ".join(words(rnd, 50)) for _ in range(40)] + ["a b c", "A  b, c", "", None, "one", "one"]
    texts += texts[:5]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def weighted_sets(rows):
    """Shingles and weights of each text, from its words alone."""
    counts = []
    for _, t in rows:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        counts.append(Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    df, n = Counter(s for c in counts for s in c), len(rows)
    return [{s: k * (1 + minhash.IDF * math.log((n + 1) / (df[s] + 1)) / math.log(n + 1)) for s, k in c.items()} for c in counts]


def jaccard(a, b):
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def classes(rows):
    """Connected components of equal texts and of exact similarity at the threshold."""
    sets, root = weighted_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or jaccard(sets[i], sets[j]) >= minhash.LEAST:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("chunk", [minhash.CHUNK, 16])
def test_classes_equal_brute_force(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    got = minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == classes(corpus)


def test_document_frequencies_are_each_shingles_own(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 1 << 17)
    monkeypatch.setattr(minhash, "BANK_SHINGLES", 1 << 14)
    rnd = random.Random(4)
    rows = [(i, " ".join(words(rnd, 300))) for i in range(400)]  # 120,000 different shingles
    rows += [(1000 + i, rows[i % 3][1] + f" and {i}") for i in range(30)]
    stored, _, _, size = substring.bucketed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", number=True)
    table, _, _, n = minhash.weighed(stored, size)
    texts = dict(rows)
    got = table.collect()
    assert n == len(got) == len(rows) and table.select("block").distinct().count() > 4
    held = {}
    for r in got:
        w = texts[r["doc_id"]].split()
        for s in {tuple(w[j : j + 5]) for j in range(len(w) - 4)}:
            held[s] = held.get(s, 0) + 1
    for r in got:
        w = texts[r["doc_id"]].split()
        low, high, count, df = minhash.unpack(r["shingles"], r["n"], *minhash.SET)
        assert sorted(df.tolist()) == sorted(held[s] for s in {tuple(w[j : j + 5]) for j in range(len(w) - 4)})


def test_odd_rows_have_classes(spark, odd):
    got = [(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    assert {c for d, c in got if d in (4, 5)} == {4} and {c for d, c in got if d in (1, 2)} == {1}
    assert minhash.near_duplicates(odd.where("doc_id = -1")).count() == 0


def test_members_that_meet_only_beside_the_first_are_linked():
    """Two texts near each other and each far from the bucket's first, however their samples agree."""
    rnd = random.Random(8)
    head = words(rnd, 300)
    u = head[:200] + words(rnd, 100)
    v = u[:285] + words(rnd, 15)
    texts = [" ".join(x) for x in (head, u, v)]
    doc, sid, count = minhash.shingles([t.encode() for t in texts])
    cut, df = np.searchsorted(doc, np.arange(4)), np.array([(sid == s).sum() for s in sid], np.uint32)
    packed = [minhash.pack(sid[i:j].astype(np.uint32), (sid[i:j] >> np.uint64(32)).astype(np.uint16), count[i:j].astype(np.uint32), df[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    sets = weighted_sets(list(enumerate(texts)))
    far = [1 - jaccard(sets[0], s) for s in sets]
    assert 0 < far[2] < 1 and jaccard(sets[1], sets[2]) > 0.8 > jaccard(sets[0], sets[1])
    for low, high in ((far, far), ([0.0] * 3, [0.0, 1.0, 1.0])):
        t = pa.table({"uid": [0, 1, 2], "label": [0, 1, 2], "apart": [False, True, True], "low": low, "high": high, "n": pa.array(np.diff(cut), pa.int32()), "shingles": packed})
        got = minhash._rest(3)(t).to_pylist()
        assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and abs(got[0]["sim"] - jaccard(sets[1], sets[2])) < 1e-6


def test_sets_at_the_threshold_share_one_of_their_rarest_shingles():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        n = int(rng.integers(5, 60))
        a, b = (np.sort(rng.choice(70, n, replace=False)).astype(np.uint64) for _ in "ab")
        b = np.unique(np.concatenate([a[: n - n // 12], b[:2]]))
        df, weight = rng.integers(1, 9, 70), rng.integers(1, 5, 70)
        x, y = ((s, weight[s.astype(int)].astype(np.float32)) for s in (a, b))
        if minhash.similarity(x, y) >= minhash.LEAST:
            met += 1
            assert set(a[minhash.rarest(x, df[a.astype(int)])]) & set(b[minhash.rarest(y, df[b.astype(int)])])
    assert met > 50


def test_weighted_samples_agree_as_often_as_documents_are_similar():
    rnd = random.Random(2)
    a = words(rnd, 400)
    b = [*a[:340], *words(rnd, 60)]
    doc, sid, count = minhash.shingles([" ".join(a).encode(), " ".join(b).encode()])
    w = count.astype(np.float32) * (1 + (sid % np.uint64(4)).astype(np.float32))
    s = minhash.samples(doc, sid, w, 2)
    exact = minhash.similarity((sid[doc == 0], w[doc == 0]), (sid[doc == 1], w[doc == 1]))
    assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact * (1 - exact) / minhash.SAMPLES) ** 0.5


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for j in range(len(w) - substring.WINDOW + 1):
            k = tuple(w[j : j + substring.WINDOW])
            if k in seen:
                gone[j : j + substring.WINDOW] = [True] * substring.WINDOW
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [substring.BLOCK_BYTES, 4096])
def test_repeats_equal_brute_force(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    rows = [*corpus, (9000, "loop " * 100), (9001, "\x1c nbsp\xa0" * 30)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == removed(rows)


def test_words_that_end_in_control_characters_differ(spark):
    """Words of eight bytes whose last is that of another word's length are words of their own."""
    rows = [(1, "abcdefg " * 25), (2, "abcdefg\x0f " * 25), (3, "abcdefg " * 25)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == removed(rows)


@pytest.mark.parametrize("most", [1, 3])
def test_buckets_may_hold_several_blocks(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 1 << 13)
    monkeypatch.setattr(substring, "MOST_BUCKETS", most)
    monkeypatch.setattr(minhash, "MOST_BUCKETS", most)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df, with_text=False).collect()} == removed(corpus)
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == classes(corpus)


def test_blocks_and_banks_grow_with_the_square_root():
    gb = 1 << 30
    assert [substring.grown(s * gb) for s in (0, 30, 64, 255, 256, 1024, 4096, 100 << 10)] == [1, 1, 1, 2, 2, 4, 8, 8]
    assert substring.blocks_of(0) == 1 and substring.blocks_of(100 << 40) < 2_000_000


def test_documents_table_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs, with_text=False).collect()} == removed(rows)


def test_odd_rows_keep_what_does_not_repeat(spark, odd):
    got = substring.remove_repeats(odd).collect()
    assert len(got) == odd.count() and {r["kept_text"] for r in got if r["doc_id"] == 4} == {"same text here"}
    assert [r["kept_text"] for r in got if r["doc_id"] in (1, 2)] == ["", ""]
    assert substring.remove_repeats(odd.where("doc_id = -1")).count() == 0


def infix_edits(item, text):
    row, t = np.zeros(len(text) + 1, int), np.frombuffer(text, np.uint8)
    for i, c in enumerate(item):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (t != c), row[1:] + 1)])
        step = np.arange(len(new))
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


@pytest.mark.parametrize(("part", "hits"), [(decontaminate.PART_BYTES, decontaminate.HITS), (600, 5000)])
def test_leaks_equal_brute_force(spark, monkeypatch, part, hits):
    rnd = random.Random(5)
    items = [(i, " ".join(words(rnd, rnd.randint(8, 40)))) for i in range(12)]
    texts = []
    for n in range(60):
        i = rnd.randrange(12)
        leak = list(items[i][1])
        for _ in range(rnd.randint(0, len(leak) // 7)):
            k = rnd.randrange(len(leak))
            leak[k : k + rnd.randint(0, 1)] = rnd.choice(["z", "", "qq"])
        texts.append((n, " ".join(words(rnd, rnd.randint(0, 80))) + " " + "".join(leak).upper() + "\n" + " ".join(words(rnd, 20))))
    items += [(20 + m, "".join(rnd.choice("abcdefghij") for _ in range(m))) for m in (8, 9, 10, 12, 15, 16, 20, 23, 24, 30, 31, 40, 60)]
    for i, item in items[12:]:  # short items with as many edits as they may have, and one more
        for more in (0, 1):
            leak = list(item)
            for _ in range(len(item) // 10 + more):
                k = rnd.randrange(len(leak))
                leak[k : k + rnd.randint(0, 1)] = rnd.choice(["z", "", "zz"])
            texts.append((200 + 2 * i + more, "xyz " + "".join(leak) + " uvw"))
    texts += [(100, None), (101, ""), (102, items[0][1]), (103, "Short"), (104, "not short"), (105, "aaaaaaaa" * 500)]
    items.append((60, "a" * 300))
    want = {(103, 51): 0}
    for n, t in texts:
        for i, item in items:
            raw = decontaminate.normal(item)
            if (e := infix_edits(raw, decontaminate.normal(t))) <= len(raw) // 10:
                want[n, i] = e
    bench = spark.createDataFrame([*items, *items[:2], (50, None), (51, "short"), (52, " "), (None, "x" * 50)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    monkeypatch.setattr(decontaminate, "HITS", hits)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(got) == len(want) > 40
    flagged = decontaminate.add_flag(df, bench)
    assert flagged.columns == ["doc_id", "text", "contaminated"] and {r["doc_id"] for r in flagged.where("contaminated").collect()} == {n for n, _ in want}


def test_long_items_and_items_without_an_id_are_searched(spark):
    rnd = random.Random(6)
    long = " ".join(words(rnd, 8000))
    assert len(long) > 40 << 10
    tail = long[-60:]  # at the start of a text: its diagonals lie over 40 KiB below 0
    docs = spark.createDataFrame([(1, tail), (2, "before " + long + " after"), (3, "so the nameless item of the benchmark lies in here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, long), (None, "the nameless item of the benchmark"), (2, "a short item that nobody holds")], "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contaminated(docs.coalesce(1), bench).collect()]
    assert got == [(2, 1, 7, 7 + len(long), 0), (3, None, 3, 37, 0)]
    assert {r["doc_id"] for r in decontaminate.add_flag(docs, bench).where("contaminated").collect()} == {2, 3}


def test_odd_rows_leak_nothing(spark, odd):
    bench = spark.createDataFrame([(1, "a benchmark passage that nobody holds")], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.where("item_id = 0")).count() == 0
    flagged = decontaminate.add_flag(odd, bench)
    assert flagged.columns == [*odd.columns, "contaminated"] and flagged.count() == odd.count()


@pytest.mark.parametrize(
    ("item", "text", "found"),
    [
        ("-" * 79 + "+", "-" * 10_000, True), ("-" * 79 + "+", "-" * 400_000, True), ("x" * 500 + "y", "x" * 20_000, True), ("x" * 50_000, "x" * 60_000, True), ("ab" * 20_000, "ab" * 30_000, True),
        ("| cell | cell " * 8 + "total", "| cell | cell " * 4_000, True), ("0123456789abcdefghij" * 5, "=" * 50_000, False), ("- - - " * 20 + "ten plain words that are nowhere else in all of this text", "- - - " * 10_000, False),
    ],
)
def test_repetitive_texts_take_no_longer(item, text, found):
    """Rules and tables: rows of one q-gram against rows of the same."""
    import time

    index = decontaminate.Benchmark([(1, item)])
    began = time.time()
    got = decontaminate.search_texts(index, ["before. " + text + " after", "clean text", text])
    took = time.time() - began
    assert [g[0] for g in got] == ([0, 2] if found else []) and all(g[4] <= len(item) // 10 for g in got)
    assert took < (1 if len(text) <= 60_000 else 6), took


def test_rows_of_places_lose_no_item():
    """Periodic items and texts with edits, against an alignment with the whole text."""
    rnd = random.Random(12)
    for _ in range(60):
        unit = "".join(rnd.choice("ab-|") for _ in range(rnd.randint(1, 5)))
        item = (unit * 40)[: rnd.randint(30, 90)] + rnd.choice(["", "total", "zz"])
        spoilt = list(item)
        for _ in range(rnd.randint(0, len(item) // 10 + 2)):
            spoilt[rnd.randrange(len(spoilt))] = rnd.choice(["", "q", "-"])
        text = rnd.choice(["", "intro "]) + (unit * 60)[: rnd.randint(0, 200)] + rnd.choice(["", " "]) + "".join(spoilt) + rnd.choice(["", unit * 9, " end"])
        index = decontaminate.Benchmark([(1, item)])
        raw, own = decontaminate.normal(text), decontaminate.normal(item)
        best = decontaminate.banded(own, raw, -len(own), len(raw) + len(own), len(own) // 10, 0, len(raw)) if len(raw) >= len(own) - len(own) // 10 else None
        got = decontaminate.search_texts(index, [text])
        assert [g[4] for g in got] == ([best[2]] if best else []), (item, text)
