"""Spelling variants: words one edit apart, by rolling hashes of their deletions.

Words are runs of letters up to U+00FF, so one byte holds a code point. Words are counted slice by slice as arrays.
Two words differ by one replaced code point if they are equal without the code point at one place,
and by an inserted one if the longer without it equals the shorter. Polynomial hashes of all prefixes and suffixes give
the hash of a word without each of its code points at once. These keys are dealt by their high bits and sorted; words that
meet under a key are compared as strings. A key's group is bounded by the alphabet, not by the corpus, and
adds to each of its words a count and its best partner, so pairs are never listed.

A word of over SHORT code points has too many deletions to carry its text with each: its keys carry a digest,
and the texts of the few that meet are joined to them afterwards.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, map_batches, materialise, shuffle_width
from lumenfold.llm.encode import sliced

RARE = 199  # one run in so many loses a code point
SHORT = 64
RADIX_BITS = 12
WIDTHS = (8, 16, 32)  # words are counted as fixed-width bytes; longer ones one by one
HELD = 400_000  # distinct words that a task counts before it passes them on
MODULI = ((2_147_483_647, 1_000_003), (2_147_483_629, 777_767_777))  # primes, and the base of each
HASH_BITS = 62
ROWS = 1 << 16  # of a batch of keys

#: A byte's lower-case letter, 0 for all else.
LETTER = np.zeros(256, np.uint8)
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)

CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


class Runs:
    """Maximal runs of letters of the texts in one slice, in Latin-1."""

    def __init__(self, texts: list[str | None], least: int):
        parts = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        lead = raw == 0xC3  # the first of the two bytes of U+00C0 to U+00FF, and of nothing else
        value = LETTER[raw]
        second = np.flatnonzero(lead) + 1
        value[second] = raw[second] + 0x40
        self.latin = value[~lead]
        step = np.diff((self.latin > 0).astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        fits = end - start >= least
        self.start, self.size = start[fits], (end - start)[fits]
        at = np.cumsum([len(p) + 1 for p in parts])
        self.text = np.searchsorted(at - np.searchsorted(second - 1, at), self.start, "right")

    def crc(self, begin: np.ndarray) -> np.ndarray:
        """Each run's CRC-32 in UTF-8, continued from that of its text's ``begin``."""
        crc, left = begin[self.text] ^ np.uint32(0xFFFFFFFF), np.flatnonzero(self.size <= SHORT)
        for j in range(SHORT):
            left = left[self.size[left] > j]
            if not len(left):
                break
            v, c = self.latin[self.start[left] + j], crc[left]
            wide = v >= 0xC0
            c[wide] = CRC[(c[wide] ^ 0xC3) & 255] ^ (c[wide] >> 8)
            v = np.where(wide, v - 0x40, v)
            crc[left] = CRC[(c ^ v) & 255] ^ (c >> 8)
        crc ^= np.uint32(0xFFFFFFFF)
        for i in np.flatnonzero(self.size > SHORT).tolist():
            crc[i] = zlib.crc32(self.word(i).decode("latin-1").encode(), int(begin[self.text[i]]))
        return crc

    def word(self, i: int) -> bytes:
        return self.latin[self.start[i] : self.start[i] + self.size[i]].tobytes()


class Counts:
    """Counts of words, merged whenever many have come."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {w: [] for w in WIDTHS}
        self.long: Counter[bytes] = Counter()
        self.rows = 0

    def add(self, runs: Runs, of: np.ndarray, odd: list[bytes]) -> None:
        """The runs numbered ``of``, and words of their own."""
        for low, w in zip((0, *WIDTHS), WIDTHS, strict=False):
            own = of[(runs.size[of] > low) & (runs.size[of] <= w)]
            place = np.arange(w)
            inside = place < runs.size[own, None]
            chars = np.where(inside, runs.latin[np.where(inside, runs.start[own, None] + place, 0)], 0).astype(np.uint8)
            self._put(w, np.ascontiguousarray(chars).view(f"S{w}").ravel())
            if some := [x for x in odd if low < len(x) <= w]:
                self._put(w, np.array(some, f"S{w}"))
        self.long.update(runs.word(i) for i in of[runs.size[of] > WIDTHS[-1]].tolist())
        self.long.update(x for x in odd if len(x) > WIDTHS[-1])

    def _put(self, w: int, words: np.ndarray) -> None:
        if len(words):
            self.parts[w].append(np.unique(words, return_counts=True))
            self.rows += len(self.parts[w][-1][0])

    def merge(self) -> None:
        self.rows = 0
        for w, parts in self.parts.items():
            if len(parts) > 1:
                words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                self.parts[w] = [(words, np.bincount(of, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64))]
            self.rows += sum(len(p[0]) for p in self.parts[w])

    def take(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for parts in self.parts.values():
            for words, n in parts:
                for a in range(0, len(words), ROWS):
                    yield _counted(np.char.decode(words[a : a + ROWS], "latin-1").tolist(), n[a : a + ROWS])
        if self.long:
            yield _counted([w.decode("latin-1") for w in self.long], list(self.long.values()))
        self.__init__()


def _counted(words: list[str], n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def _count(least: int, rare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for at, texts in sliced(b, "text"):
                runs = Runs(texts, least)
                of, odd = np.arange(len(runs.start)), []
                if rare:
                    begin = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[at : at + len(texts)]], np.uint32)
                    crc = runs.crc(begin)
                    cut = crc % rare == 0
                    for i in np.flatnonzero(cut).tolist():
                        word, k = runs.word(i), int(crc[i]) % int(runs.size[i])
                        odd.append(word[:k] + word[k + 1 :])
                    of = of[~cut]
                counts.add(runs, of, [w for w in odd if len(w) >= least])
                if counts.rows > 2 * HELD:
                    counts.merge()
                    if counts.rows > HELD:
                        yield from counts.take()
                elif len(counts.long) > ROWS:
                    yield from counts.take()
        yield from counts.take()

    return run


def word_counts(docs: DataFrame, least: int = 6, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of at least ``least`` letters of whole texts, A to Z as lower case; with ``rare``, one in so many lost a code point."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    return map_batches(rows, _count(least, rare), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def powers(base: int, p: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo p, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def deletion_keys(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words in Latin-1, one after another: each word's hash; and for each code point its place, the hash of its word without it, and whether it is the first of a run of equal ones."""
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) - start[of]
    whole, without = np.zeros(len(size), np.uint64), np.zeros(len(raw), np.uint64)
    for p, base in MODULI:
        m = np.uint64(p)
        term = (raw.astype(np.uint64) + np.uint64(1)) * powers(base, p, int(size.max(initial=0)))[place] % m
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
        prefix = (total[:-1] - total[start[of]]) % m
        word = (total[start + size] - total[start]) % m
        suffix = (word[of] + m + m - prefix - term) % m
        without = without << np.uint64(31) | (prefix + suffix * np.uint64(pow(base, -1, p))) % m  # what follows moves one place back
        whole = whole << np.uint64(31) | word
    first = (place == 0) | (raw != np.concatenate([raw[:1], raw[:-1]]))
    return whole.astype(np.int64), place, without.astype(np.int64), first


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place or -1 for the whole word, first, row of the batch) of runs of words."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    size = np.array([len(w) for w in words], np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // ROWS)) + 1
    for rows in np.split(np.arange(len(words)), cuts):
        own = size[rows]
        whole, place, without, first = deletion_keys(np.frombuffer(b"".join(words[i] for i in rows), np.uint8), own)
        yield np.concatenate([whole, without]), np.concatenate([np.full(len(rows), -1), place]), np.concatenate([np.ones(len(rows), bool), first]), np.concatenate([rows, np.repeat(rows, own)])


def _short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, place, first, row in _keyed(b):
            cols = [pa.array(key), pa.array((key >> (HASH_BITS - RADIX_BITS)).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(first), b.column("word").take(pa.array(row)), b.column("n").take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "radix", "place", "first", "word", "n"])


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, place, first, row in _keyed(b):
            for a in range(0, len(key), ROWS):
                cut = slice(a, a + ROWS)
                cols = [pa.array(key[cut]), pa.array(place[cut].astype(np.int32)), pa.array(first[cut]), b.column("digest").take(pa.array(row[cut]))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "place", "first", "digest"])


def partners(key: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of (key, place, -n, word): how many words each is near to under its key, and the row of the best of them (-1: none)."""
    wide = words.dtype.itemsize
    chars = np.concatenate([np.ascontiguousarray(words).view(np.uint8).reshape(-1, wide), np.zeros((len(words), 1), np.uint8)], 1)
    at = np.arange(wide)
    rest = np.take_along_axis(chars, at + (at >= np.where(place < 0, wide, place)[:, None]), 1).view(f"S{wide}").ravel()
    order = None
    new = np.diff(key, prepend=key[:1] - 1) != 0
    if not (new[1:] | (rest[1:] == rest[:-1])).all():  # different strings under one hash: strings decide
        order = np.lexsort((words, -n, place, rest, key))
        key, place, first, n, words, rest = (x[order] for x in (key, place, first, n, words, rest))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])])
    rows, near, best = np.arange(len(key)), np.zeros(len(key), np.int64), np.full(len(key), -1)
    # The same string is left without the same place: one code point is replaced.
    sub = np.flatnonzero(new | (np.diff(place, prepend=-2) != 0))
    many = np.diff(np.append(sub, len(key)))
    head, of = np.repeat(sub, many), np.repeat(many, many)
    same = (place >= 0) & (of > 1)
    near[same] = of[same] - 1
    best[same] = np.where(rows == head, head + 1, head)[same]
    # A whole word (the first row of its group) is what others leave: one code point is inserted.
    group = np.flatnonzero(new)
    lead = np.repeat(group, np.diff(np.append(group, len(key))))
    longer = np.flatnonzero((place[lead] < 0) & (place >= 0) & first)
    better = lambda a, b: (n[a] > n[b]) | ((n[a] == n[b]) & (words[a] < words[b]))
    whole = lead[longer]
    near[longer] += 1
    old = best[longer]
    best[longer] = np.where((old < 0) | better(whole, old), whole, old)
    by = longer[np.lexsort((words[longer], -n[longer], whole))]
    heads, at, count = np.unique(lead[by], return_index=True, return_counts=True)
    near[heads], best[heads] = count, by[at]
    if order is None:
        return near, best
    back_near, back = np.empty_like(near), np.empty_like(best)
    back_near[order], back[order] = near, np.where(best < 0, -1, order[best])
    return back_near, back


def _meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    key = rows["key"].to_numpy()
    alone = np.diff(key, prepend=key[:1] - 1) != 0
    alone &= np.append(alone[1:], True)
    if alone.all():
        return
    rows = rows.filter(pa.array(~alone))
    words = np.array([w.encode("latin-1") for w in rows["word"].to_pylist()], "S")
    near, best = partners(*(rows[c].to_numpy() for c in ("key", "place", "first", "n")), words)
    got = np.flatnonzero(near)
    word = rows["word"].combine_chunks()
    cols = [word.take(pa.array(got)), pa.array(near[got]), rows["n"].combine_chunks().take(pa.array(best[got])), word.take(pa.array(best[got]))]
    yield pa.RecordBatch.from_arrays(cols, names=["word", "near", "best_n", "best"])


def _sorted_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted keys; the last key of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        key = b.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1].column("key")[0].as_py() != key[0]):
            yield from _meet(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        elif last:
            yield from _meet(pa.Table.from_batches([b.slice(0, last)]))
        held.append(b.slice(last))
    if held:
        yield from _meet(pa.Table.from_batches(held))


def near_short(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best): what each group of a key adds to its words, of SHORT code points at most."""
    keys = map_batches(words.where(F.length("word") <= SHORT), _short_keys, "key long, radix int, place int, first boolean, word string, n long")
    dealt = keys.repartition(shuffle_width(words.sparkSession), "radix").sortWithinPartitions("key", "place", F.desc("n"), "word")
    return map_batches(dealt, _sorted_keys, "word string, near long, best_n long, best string")


def near_long(words: DataFrame) -> DataFrame:
    """The same for words of which the longer has over SHORT code points: a row for each partner, found by digests and compared as strings."""
    long = words.where(F.length("word") >= SHORT).withColumn("digest", F.unhex(F.sha2("word", 256)))
    keys = map_batches(long.select("word", "digest"), _long_keys, "key long, place int, first boolean, digest binary")
    gone = keys.where("place >= 0")
    a, b = gone.alias("a"), gone.alias("b")
    pairs = a.join(b, F.expr("a.key = b.key and a.place = b.place and a.digest < b.digest")).selectExpr("a.digest a", "b.digest b", "a.place place", "false inserted")
    whole = keys.where("place < 0").alias("b")
    pairs = pairs.unionByName(a.where("first").join(whole, F.expr("a.key = b.key")).selectExpr("a.digest a", "b.digest b", "a.place place", "true inserted"))
    texts = lambda x: long.selectExpr(f"digest {x}", f"word word_{x}", f"n n_{x}")
    found = pairs.join(texts("a"), "a").join(texts("b"), "b").where(f"greatest(length(word_a), length(word_b)) > {SHORT}")
    without = lambda w: f"concat(substring({w}, 1, place), substring({w}, place + 2))"
    found = found.where(f"{without('word_a')} = if(inserted, word_b, {without('word_b')}) and word_a <> word_b")
    both = [F.struct(F.col(f"word_{x}").alias("word"), F.lit(1).cast("long").alias("near"), F.col(f"n_{y}").alias("best_n"), F.col(f"word_{y}").alias("best")) for x, y in ("ab", "ba")]
    return found.select(F.inline(F.array(*both)))


def variant_forms(docs: DataFrame, least: int = 6, times: int = 5, ratio: int = 5, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A to Z, a to z, U+00C0 to U+00FF) of whole texts, A to Z as lower case, with ``least`` code
    points or more that occur ``times`` times or more. A word's form is its most frequent near word (ties: the smallest), if ``ratio`` times
    as frequent as itself; its root is where forms lead. Null and empty texts have no words; a
    null id counts as an empty one where runs lose a code point; repeated rows count as often as they come. An empty
    table gives an empty result. Other columns aren't read. The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    words, words_at = materialise(word_counts(docs, least, rare, id_col, text_col).where(F.col("n") >= times), "variant-words")
    parts = near_short(words).unionByName(near_long(words)).select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("form")).alias("best"))
    all_rows = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<minus: long, form: string>").alias("best")).unionByName(parts)
    found = all_rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    close = -F.col("best.minus") >= F.col("n") * ratio
    found, found_at = materialise(found.select("word", "n", "n_near", F.when(close, F.col("best.form")).alias("form"), F.when(close, -F.col("best.minus")).alias("form_n")), "variant-near")
    # Each step multiplies n by the ratio at least, so chains are short; each round doubles how far a root reaches.
    roots, at = materialise(found.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    paths = [at]
    most, reach = found.agg(F.max("n")).first()[0] or 1, 1
    while times * ratio**reach <= most:
        step = roots.selectExpr("word as root", "root as further")
        roots, at = materialise(roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variant-roots")
        paths.append(at)
        reach *= 2
    out, _ = materialise(found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    drop_path(spark, words_at, found_at, *paths)
    return out
