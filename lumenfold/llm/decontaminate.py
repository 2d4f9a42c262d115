"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of m bytes that occurs in a document with at most k edits shares at least
``m + 1 - q * (k + 1)`` of its q-grams with that place, on diagonals (place in the document minus
place in the item) that are at most k apart. Shared q-grams are therefore counted in diagonal
bands of width 2(k + 1) that overlap by half; a band that reaches the bound is aligned with the
item, inside the band only. q is 8, or as much less as a short item needs for a bound of one.

The benchmark is cut into parts of bounded size. A part's index is built once and sent to all
workers; documents are searched for the parts one after another, and never move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_column, map_batches
from lumenfold.llm.encode import sliced
from lumenfold.llm.words import FIRST

Q = 8
BUDGET = 0.1  # edits allowed, as a share of an item's bytes
PART_BYTES = 4 << 20  # of items in one index, which takes about 24 bytes for each of theirs
TABLE_BITS = 24
BAND_BITS = 40  # of a key; the rest numbers items of a part
SLICE_BYTES = 1 << 20
HITS = 1 << 20  # shared q-grams that are counted at once
ROW, APART = 8, 64  # places of a q-gram at even distances, of less than so many bytes, that count as one row
ALONE = 1 << 60
DIAGONALS = 1 << 16  # that are aligned at once


def normal(text: str | None) -> bytes:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split()).encode()


def grams(raw: bytes, q: int = Q) -> np.ndarray:
    """Every run of q (at most 8) bytes as an integer."""
    n = len(raw) - q + 1
    return np.ndarray((n,), "<u8", raw + bytes(8), strides=(1,)) & FIRST[q] if n > 0 else np.zeros(0, np.uint64)


def rows_of(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first, index of the last, number of places, distance) of rows: ROW or more places of a group at even distances; other places are rows by themselves, without a distance.

    In order of (group, place).
    """
    n = len(place)
    step = np.diff(place)
    even = np.zeros(n, bool)  # goes on at the distance of the two places before it
    if n > 2:
        even[2:] = (group[2:] == group[:-2]) & (step[1:] == step[:-1]) & (step[1:] < APART)
    edge = np.diff(even.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1) - 2, np.flatnonzero(edge == -1) - 1
    if len(begin) > 1:  # two rows share no place
        begin[1:] = np.maximum(begin[1:], end[:-1] + 1)
    long = end - begin + 1 >= ROW
    first = np.ones(n, bool)
    for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        first[a + 1 : b + 1] = False
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, n))
    last = at + many - 1
    return at, last, many, np.where(many > 1, (place[last] - place[at]) // np.maximum(many - 1, 1), ALONE)


class Grams:
    """Where items have each q-gram, for one q."""

    def __init__(self, q: int, items: np.ndarray, texts: list[bytes]):
        g = [grams(texts[i], q) for i in items]
        item = np.repeat(items.astype(np.int32), [len(x) for x in g])
        place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in g])
        code = np.concatenate(g)
        order = np.argsort(code, kind="stable")
        code, item, place = code[order], item[order], place[order]
        a, b, self.many, self.apart = rows_of(np.cumsum((np.diff(code, prepend=code[:1]) != 0) | (np.diff(item, prepend=item[:1]) != 0)), place)
        self.q, (self.code, first) = q, np.unique(code[a], return_index=True)
        self.item, self.low, self.high = item[a], place[a], place[b]
        self.first = np.append(first, len(a))
        self.bits = min(TABLE_BITS, max(12, (8 * len(self.code)).bit_length()))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(self.code)] = True

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def hits(self, raw: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, lowest and highest diagonal, number and distance of the places in ``raw``, those in the item, place in the item or -1) of rows that share q-grams, some at a time."""
        code = grams(raw, self.q)
        pos = np.flatnonzero(self.table[self._slot(code)])
        k = np.minimum(np.searchsorted(self.code, code[pos]), len(self.code) - 1)
        real = self.code[k] == code[pos]
        pos, k = pos[real], k[real]
        order = np.argsort(k, kind="stable")
        pos, k = pos[order], k[order]
        a, b, n, apart = rows_of(k, pos)
        low, high, k = pos[a], pos[b], k[a]
        many = self.first[k + 1] - self.first[k]
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // HITS)) + 1
        for at in np.split(np.arange(len(k)), cuts):
            m, f = many[at], self.first[k[at]]
            hit = np.repeat(f - (np.cumsum(m) - m), m) + np.arange(m.sum())
            own = np.repeat(at, m)
            single = (n[own] == 1) & (self.many[hit] == 1)
            yield self.item[hit], low[own] - self.high[hit], high[own] - self.low[hit], (n[own], apart[own], self.many[hit], self.apart[hit]), np.where(single, self.low[hit], -1)


class Benchmark:
    """q-gram index of items: those of Q bytes or more are found with edits, shorter ones as whole texts."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float = BUDGET):
        seen = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.ids, self.texts = [i for i, _ in seen], [t for _, t in seen]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.whole: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(size < Q).tolist():
            self.whole.setdefault(self.texts[i], []).append(i)
        self.k = np.where(size < Q, 0, (size * budget + 1e-9).astype(np.int64))
        q = np.clip(size // (self.k + 1), 1, Q)  # so that the bound is one at least
        self.least = size + 1 - q * (self.k + 1)
        self.width = self.k + 1
        # Added to diagonals, so that no band is negative however far into an item a gram at the text's start lies.
        self.offset = int((size + self.width).max(initial=0))
        self.grams = [Grams(x, np.flatnonzero((q == x) & (size >= Q)), self.texts) for x in np.unique(q[size >= Q]).tolist()]

    def _counted(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, rows: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, hits at most, row of the input) of each band that the diagonals lie in; some at a time, as a row may cross many."""
        w, low, high = self.width[item], low + self.offset, high + self.offset
        one, wide = np.flatnonzero(low == high), np.flatnonzero(low != high)
        band = low[one] // w[one]  # bands overlap by half: each diagonal lies in two
        found = [(self._key(item[one], band), np.ones(len(one), np.int64), one), (self._key(item[one], band - 1), np.ones(len(one), np.int64), one)]
        first = low[wide] // w[wide] - 1
        many = high[wide] // w[wide] - first + 1
        for at in np.split(np.arange(len(wide)), np.flatnonzero(np.diff(np.cumsum(many) // (2 * HITS))) + 1):
            m, own = many[at], np.repeat(wide[at], many[at])
            band = np.repeat(first[at] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            inside = np.minimum(high[own], (band + 2) * w[own] - 1) - np.maximum(low[own], band * w[own]) + 1
            n, apart, many_, apart_ = (x[own] for x in rows)
            # Of the places of one side, each meets so many of the other inside the band.
            found.append((self._key(item[own], band), np.minimum(n * (inside // apart_ + 1), many_ * (inside // apart + 1)), own))
            yield tuple(map(np.concatenate, zip(*found, strict=True)))
            found = []

    def _bands(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Items and bands whose shared q-grams reach the bound, in order."""
        keys, counts, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], None
        for g in self.grams:
            for item, low, high, rows, place in g.hits(raw):
                for key, count, own in self._counted(item, low, high, rows):
                    order = np.argsort(key)
                    key = key[order]
                    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
                    keys.append(key[first])
                    counts.append(np.add.reduceat(count[order], first) if len(first) else count)
                    places = (place[own[order]], count[order], first, np.diff(np.append(first, len(key)))) if places is None else ()
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(of, np.concatenate(counts), len(key))
        item = (key >> np.uint64(BAND_BITS)).astype(np.int64)
        enough = count >= self.least[item]
        if places:  # all came at once: a gram of the item counts once, however often the place repeats it
            place, hits, first, many = places
            for j in np.flatnonzero(enough):
                own = slice(first[j], first[j] + many[j])
                row = place[own] < 0
                enough[j] = len(np.unique(place[own][~row])) + hits[own][row].sum() >= self.least[item[j]]
        return item[enough], (key[enough] & np.uint64((1 << BAND_BITS) - 1)).astype(np.int64)

    def _ranges(self, raw: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, lowest, highest diagonal): bands that overlap as one range, and long ranges in pieces that overlap by a band."""
        item, band = self._bands(raw)
        first = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(band, prepend=-2) > 1))
        ends = np.append(first, len(item))[1:]
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            it = int(item[a])
            w = int(self.width[it])
            low, high, size = int(band[a]) * w - self.offset, (int(band[b - 1]) + 2) * w - self.offset, max(DIAGONALS, 8 * w)
            for at in range(low, max(low + 1, high - 2 * w), size):
                yield it, at, min(high, at + size + 2 * w)

    def search(self, raw: bytes, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first byte, end, edits) of the best place for each document and item. ``at``: where the documents of ``raw`` start, and its end."""
        spans: dict[tuple[int, int], tuple[int, int, int]] = {}
        for it, low, high in self._ranges(raw):
            k, size = int(self.k[it]), len(self.texts[it])
            first, last = np.searchsorted(at, [max(low, 0), min(high + size, int(at[-1]) - 1)], "right") - 1
            for d in range(int(first), min(int(last), len(at) - 2) + 1):  # a range crosses into these documents
                a, b = int(at[d]), int(at[d + 1]) - 1
                from_, to = max(low, a - k), min(high, b - (size - k))
                held = spans.get((d, it))
                if from_ > to or (held and held[2] == 0 and held[0] <= from_):
                    continue  # the item doesn't fit there, or is there as it is further ahead
                got = banded(self.texts[it], raw, from_, to - from_, k, a, b)
                if got and (held is None or (got[2], got[0]) < (held[2], held[0])):
                    spans[d, it] = got
        if self.whole:
            for d, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                spans |= {(d, it): (a, b - 1, 0) for it in self.whole.get(raw[a : b - 1], ())}
        return [(d, it, s - int(at[d]), e - int(at[d]), edits) for (d, it), (s, e, edits) in sorted(spans.items())]

    @staticmethod
    def _key(item: np.ndarray, band: np.ndarray) -> np.ndarray:
        return item.astype(np.uint64) << np.uint64(BAND_BITS) | band.astype(np.uint64)


def banded(item: bytes, raw: bytes, low: int, width: int, most: int, a: int, b: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the item's best place in ``raw[a:b]`` on diagonals ``low .. low + width``; None over ``most`` edits.

    Start and end are free on the document's side. Row i holds, for each diagonal, the fewest
    edits of the item's first i bytes that end there.
    """
    exact = raw.find(item, max(a, low), min(b, low + width + len(item) + 1))
    if exact >= 0:
        return exact, exact + len(item), 0
    m, w = len(item), width + 1
    inf = m + w + 1
    # What lies on the diagonals, byte by byte from ``low`` on; outside of the document nothing pairs and nothing ends.
    place = low + np.arange(w + m + 1)
    inside = (place >= a) & (place < b)
    chars = np.full(w + m + 1, -1, np.int16)
    chars[inside] = np.frombuffer(raw, np.uint8)[place[inside]]
    no_pair, no_end = np.where(inside, 0, inf), np.where((place >= a) & (place <= b), 0, inf)
    row, begin, steps = no_end[:w].copy(), place[:w].copy(), np.arange(w)
    drop, dropped = np.empty_like(row), np.empty_like(begin)
    drop[-1], dropped[-1] = inf, 0
    for i, c in enumerate(item):
        pair = row + (chars[i : i + w] != c)
        pair += no_pair[i : i + w]
        np.add(row[1:], 1, out=drop[:-1])  # the item's byte is missing in the text
        dropped[:-1] = begin[1:]
        take = drop < pair
        new, begin = np.where(take, drop, pair), np.where(take, dropped, begin)
        new += no_end[i + 1 : i + 1 + w]
        np.minimum(new, inf, out=new)
        # Extra bytes in the text move to higher diagonals at one edit each.
        level = new - steps
        best = np.minimum.accumulate(level)
        better = best < level
        if better.any():
            came = np.maximum.accumulate(np.where(better, -1, steps))
            better &= no_end[i + 1 : i + 1 + w] == 0
            new, begin = np.where(better, best + steps, new), np.where(better, begin[np.maximum(came, 0)], begin)
        row = new
        if i % 64 == 63 and row.min() > most:
            return None  # edits never get fewer
    j = int(row.argmin())
    return (int(begin[j]), int(place[j] + m), int(row[j])) if row[j] <= most else None


def search_texts(index: Benchmark, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(number of the text, item id, start, end, edits) of every item found."""
    found, run, size, base = [], [], 0, 0
    for i, t in enumerate(texts):
        run.append(normal(t))
        size += len(run[-1])
        if size >= SLICE_BYTES or i == len(texts) - 1:
            at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in run])])
            found += [(base + d, index.ids[it], s, e, edits) for d, it, s, e, edits in index.search(b"\x00".join(run) + b"\x00", at)]
            run, size, base = [], 0, i + 1
    return found


def _search(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            found = [(ids[at + x[0]], *x[1:]) for at, texts in sliced(b, "text") for x in search_texts(index.value, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(5)], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def indexes(benchmark: DataFrame, budget: float, text_col: str, item_col: str) -> list[Broadcast]:
    """An index of each part of the benchmark, sent to all workers. A part comes to the driver by itself: about PART_BYTES, or one longer item."""
    spark, text = benchmark.sparkSession, F.col(f"`{text_col}`").cast("string")
    items = benchmark.where(text.isNotNull()).select(F.col(f"`{item_col}`").cast("long").alias("item"), text.alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    part: Column = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    out = []
    for p in range(parts):
        rows = sorted(map(tuple, items.where(part == p).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out.append(spark.sparkContext.broadcast(Benchmark(rows, budget)))
    return out


def add_flag(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, text_col: str = "text", out: str = "contaminated", item_col: str = "item_id") -> DataFrame:
    """``docs`` with a column that is true where the text holds a benchmark item; nothing is joined or moved."""
    found = docs.drop(out)
    names = []
    for n, index in enumerate(indexes(benchmark, budget, text_col, item_col)):

        def make(index=index):
            def flags(texts):
                hit = {x[0] for x in search_texts(index.value, texts)}
                return [i in hit for i in range(len(texts))]

            return flags

        names.append(f"{out}_{n}_" if n else out)
        found = add_column(found, text_col, names[-1], T.BooleanType(), pa.bool_(), make)
    if len(names) > 1:
        found = found.withColumn(out, F.array_contains(F.array(*names), True)).drop(*names[1:])
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start, end (bytes of the normal form), edits.

    Every whole text is searched for every item, of any length and number; one whose id is null is reported with
    a null item_id. An item may differ by a tenth of its bytes (rounded down). An item under 8 bytes is found only where it
    is the whole text, as it occurs by chance in others; an empty or null one is never found. Null and empty texts hold nothing.
    Repeated rows are reported as often as they come, repeated items once. Only the named columns are read. Texts
    are read once for each PART_BYTES of benchmark.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, budget, text_col, item_col):
        found = map_batches(rows, _search(index), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionByName(found)
    return out
