"""Substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words; every word covered by a window whose words also start
earlier goes. Texts are dealt to blocks of about ``BLOCK_BYTES``, kept in a bucketed table in the
shared folder, and three passes read it without moving texts again:

1. Each block counts its windows in a count-min sketch of two rows. The sketch is as wide as the
   corpus needs and is held in banks; a block sends each bank the cells it touched, as sorted
   differences. A bank adds the blocks' sketches up and answers each block with a bit for each of its
   cells: does the merged count reach two?
2. Merged counts never fall short, so a window is a candidate only if both its cells reach two, and
   none that repeats is lost. A block sends each candidate's 128-bit fingerprint once, with its first
   place, to an exact bank, which groups them and answers which are first elsewhere.
3. Each block removes what is covered and emits the kept words.

All traffic is a few bytes a window, every task's work is bounded by a block or a bank, and a window
that a third of all documents share costs one row a block. Beyond ``GROW_FROM`` bytes, blocks and banks both grow
with the square root of the corpus, so that messages (blocks times banks) stay in proportion to it; at
``MOST_GROWN`` times their size, from 2 TB on, messages get smaller instead, down to a cell each.

Windows are compared by two 64-bit hashes, each of word hashes of its own seed: two different
windows are taken as one with a probability of 2 ** -128 a pair.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.llm.common import bound_batches, drop_path, materialise, new_path
from lumenfold.llm.words import SPACE, Words, mix

WINDOW = 20
BLOCK_BYTES = 8 << 20
GROW_FROM, MOST_GROWN = 64 << 30, 8  # a grown block has 64 MB of text and a bank 128 million cells
MOST_BUCKETS = 1 << 16  # of a table: beyond, a bucket holds several blocks
BANK_BITS = 24  # cells of a bank of the sketch
CELLS_PER_WINDOW = 8
CHUNK = 1 << 15

_RNG = np.random.default_rng(20)
_TERMS = _RNG.integers(1, 2**63, (2, WINDOW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(h: np.ndarray, starts: np.ndarray, which: int) -> np.ndarray:
    """Multilinear hash of the WINDOW word hashes from each start."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), CHUNK):
        s = starts[i : i + CHUNK]
        acc = np.zeros(len(s), np.uint64)
        if len(s) and s[-1] - s[0] == len(s) - 1:  # one run: slices are enough
            for j in range(WINDOW):
                acc += h[s[0] + j : s[0] + j + len(s)] * _TERMS[which, j]
        else:
            for j in range(WINDOW):
                acc += h[s + j] * _TERMS[which, j]
        out[i : i + CHUNK] = mix(acc)
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as byte planes, compressed: bytes of like weight lie together."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(1).compress(planes)


def unpack(raw: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    import zstandard

    planes, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def grown(size: int) -> int:
    """How many times larger blocks and banks are for so many bytes of text: a power of two."""
    return 1 << min(MOST_GROWN.bit_length() - 1, max(0, (size // GROW_FROM).bit_length() // 2))


def blocks_of(size: int) -> int:
    return max(1, -(-size // (BLOCK_BYTES * grown(size))))


class Block:
    """Words and windows of a block's rows, in order of document."""

    def __init__(self, table: pa.Table, bits: int, bank_bits: int):
        ids = table["doc_id"].to_pylist()
        self.order = order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        texts = table["text"].to_pylist()
        self.ids, self.texts = [ids[i] for i in order], [texts[i] or b"" for i in order]
        self.words, self.bits, self.bank_bits = Words(self.texts, SPACE), bits, bank_bits
        w, n = self.words, np.diff(self.words.first)
        whole = np.ones(len(w.start), bool)
        # The last WINDOW - 1 words of a document start no window.
        ends = w.first[1:]
        for j in range(1, WINDOW):
            at = ends - j
            whole[at[j <= n]] = False
        self.starts = np.flatnonzero(whole)
        self.h1 = window_hashes(w.hashes(), self.starts, 0)

    def cells(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of a row of the sketch in order, which windows fall in more than once, and each window's number in that list."""
        h = self.h1 if row == 0 else mix(self.h1 * np.uint64(0xC2B2AE3D27D4EB4F))
        room = max(1, int(len(h)).bit_length())
        both = np.sort((h >> np.uint64(64 - self.bits)) << np.uint64(room) | np.arange(len(h), dtype=np.uint64))
        cell, who = both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)
        new = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        number = np.empty(len(h), np.int64)
        number[who] = np.cumsum(new) - 1
        return cell[first], np.diff(np.append(first, len(cell))) > 1, number

    def candidates(self, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Numbers of the windows whose merged counts reach two in both rows."""
        keep = np.ones(len(self.starts), bool)
        for row in (0, 1):
            cells, _, number = self.cells(row)
            flags = np.zeros(len(cells), np.uint8)
            bank = (cells >> np.uint64(self.bank_bits)).astype(np.int64)
            for b, i, j in runs(bank):
                flags[i:j] = unbits(replies[row, b], j - i)
            keep &= flags[number] > 0
        return np.flatnonzero(keep)

    def grouped(self, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates in order of fingerprint, then place: numbers, both halves, and where a new fingerprint begins."""
        h1, h2 = self.h1[cand], window_hashes(self.words.hashes(1), self.starts[cand], 1)
        order = np.argsort(h1, kind="stable")
        a, b = h1[order], h2[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return cand[order], a, b, new

    def document(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, self.starts[numbers], "right") - 1


def runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    if not len(keys):
        return []
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return list(zip(keys[cut].tolist(), cut.tolist(), np.append(cut[1:], len(keys)).tolist(), strict=True))


def bits_of(flags: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.packbits(flags).tobytes())


def unbits(raw: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=n)


MESSAGE = "bank long, block long, n int, payload binary"
REPLY = "block long, kind int, bank long, payload binary"


def _rows(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(zip(names, types, strict=True))})


def _messages(rows: list[tuple]) -> pa.Table:
    return _rows(["bank", "block", "n", "payload"], rows, [pa.int64(), pa.int64(), pa.int32(), pa.binary()])


def _answers(rows: list[tuple]) -> pa.Table:
    return _rows(["block", "kind", "bank", "payload"], rows, [pa.int64(), pa.int32(), pa.int64(), pa.binary()])


def _count(bits: int, bank_bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        block, no, rows = Block(table, bits, bank_bits), table["block"][0].as_py(), []
        for row in (0, 1):
            cells, twice, _ = block.cells(row)
            for bank, i, j in runs((cells >> np.uint64(bank_bits)).astype(np.int64)):
                low = (cells[i:j] & np.uint64((1 << bank_bits) - 1)).astype(np.uint32)
                # Rows of the sketch have banks of their own: even and odd numbers.
                rows.append((bank * 2 + row, no, j - i, pack(np.diff(low, prepend=np.uint32(0)), twice[i:j].astype(np.uint8))))
        return _messages(rows)

    return run


def _merge(bank_bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        counts, bank = np.zeros(1 << bank_bits, np.uint8), table["bank"][0].as_py()
        blocks, sizes, payloads = (table[c].to_pylist() for c in ("block", "n", "payload"))
        for n, raw in zip(sizes, payloads, strict=True):
            step, twice = unpack(raw, n, "u4", "u1")
            at = np.cumsum(step, dtype=np.int64)
            counts[at] = np.minimum(2, counts[at] + 1 + twice)
        rows = []
        for no, n, raw in zip(blocks, sizes, payloads, strict=True):
            at = np.cumsum(unpack(raw, n, "u4", "u1")[0], dtype=np.int64)
            rows.append((no, bank & 1, bank >> 1, bits_of(counts[at] >= 2)))
        return _answers(rows)

    return run


def _replies(table: pa.Table) -> tuple[dict[tuple[int, int], bytes], dict[int, bytes]]:
    sketch, exact = {}, {}
    for kind, bank, raw in zip(table["kind"].to_pylist(), table["bank"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if kind == 2:
            exact[bank] = raw
        else:
            sketch[kind, bank] = raw
    return sketch, exact


def exact_bank(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits)).astype(np.int64)


def _propose(bits: int, bank_bits: int, exact_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _messages([])
        block, no = Block(table, bits, bank_bits), table["block"][0].as_py()
        who, a, b, new = block.grouped(block.candidates(_replies(replies)[0]))
        who, a, b = who[new], a[new], b[new]
        doc = block.document(who)
        start = (block.starts[who] - block.words.first[doc]).astype(np.uint32)
        ids = np.array([-(2**63) if x is None else x for x in block.ids], np.int64)[doc]
        return _messages([(bank, no, j - i, pack(a[i:j], b[i:j], ids[i:j], start[i:j])) for bank, i, j in runs(exact_bank(a, exact_bits))])

    return run


def _decide(table: pa.Table) -> pa.Table:
    bank, blocks, sizes = table["bank"][0].as_py(), table["block"].to_pylist(), table["n"].to_pylist()
    parts = [unpack(raw, n, "u8", "u8", "i8", "u4") for n, raw in zip(sizes, table["payload"].to_pylist(), strict=True)]
    a, b, ids, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
    no = np.repeat(np.array(blocks, np.int64), sizes)
    order = np.lexsort((start, no, ids, b, a))
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    later = np.zeros(len(a), bool)
    later[order[1:]] = same
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return _answers([(x, 2, bank, bits_of(later[i:j])) for x, i, j in zip(blocks, cut[:-1], cut[1:], strict=True)])


def _remove(bits: int, bank_bits: int, exact_bits: int, with_text: bool, others: pa.DataType | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"]
        if not table.num_rows:
            return _rows([*names, "others"], [], [*types, others]) if others else _rows(names, [], types)
        block = Block(table, bits, bank_bits)
        gone = np.zeros(len(block.words.start) + 1, np.int64)
        if replies.num_rows:
            sketch, exact = _replies(replies)
            who, a, _, new = block.grouped(block.candidates(sketch))
            covered = ~new
            first = np.flatnonzero(new)
            for bank, i, j in runs(exact_bank(a[first], exact_bits)):
                covered[first[i:j]] |= unbits(exact[bank], j - i) > 0
            hit = block.starts[who[covered]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + WINDOW, -1)
        kept = np.cumsum(gone[:-1]) == 0
        total = np.concatenate([[0], np.cumsum(kept)])
        rows, at = [], block.words.first
        for i, (doc, text) in enumerate(zip(block.ids, block.texts, strict=True)):
            s, e = int(at[i]), int(at[i + 1])
            left, words = int(total[e] - total[s]), text.split()
            if with_text and left == e - s:
                rows.append((doc, e - s, 0, text.decode()))
                continue
            out = b" ".join(words if left == e - s else itertools.compress(words, kept[s:e].tolist()))
            rows.append((doc, e - s, e - s - left, out.decode() if with_text else hashlib.sha256(out).hexdigest()))
        out = _rows(names, rows, types)
        return out.append_column("others", table["others"].take(pa.array(block.order))) if others else out

    return run


def bucketed(docs: DataFrame, id_col: str, text_col: str, number: bool = False, whole: bool = False) -> tuple[DataFrame, str, str, int]:
    """Rows dealt to blocks, in a table bucketed by block so that passes need no shuffle of texts: table, its name, its path, bytes of text.

    ``number`` adds ``uid``, a number of each row that stays as written; ``whole`` adds ``others``, a row's other columns and its id as one value.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("others")] if whole else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"), *others)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = blocks_of(size)
    buckets = min(n, MOST_BUCKETS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long"))
    if n == buckets:
        # A number for each bucket that hashes to it, so that every bucket holds one block: a row a bucket, at most MOST_BUCKETS.
        # So many tries miss a bucket with a probability of e ** -30, and a missed one shares another's.
        tries = n * (n.bit_length() + 30)
        of = spark.range(0, tries, 1, 4).select(F.col("id").alias("own"), F.pmod(F.hash("id"), F.lit(n)).cast("long").alias("block")).groupBy("block").agg(F.min("own").alias("own"))
        dealt = dealt.join(F.broadcast(of), "block", "left").withColumn("block", F.coalesce("own", "block")).drop("own")
    name, path = f"lumenfold_{uuid.uuid4().hex}", new_path(spark, "blocks")
    dealt = dealt.select(*rows.columns, "block").repartition(buckets, "block")
    if number:
        dealt = dealt.withColumn("uid", F.monotonically_increasing_id())
    dealt.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name, path, size


def remove_repeats(docs: DataFrame, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_text, or kept_sha256 of the kept words joined by a space.

    kept_text is the text as it was where nothing is removed, else the kept words joined by a space.

    Words are runs of bytes other than ASCII white space. Earlier means a smaller id (null is the
    smallest), or an earlier start in the same row; rows that share an id are ordered among
    themselves in some way. Null and empty texts have no words and are kept as empty texts. Only the two named
    columns are read, unless ``whole`` asks for ``others``: all columns of the same row but its text, as one value. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows, name, path, size = bucketed(docs, id_col, text_col, whole=whole)
    table = rows.select("doc_id", "text", "block")
    windows = max(1, size // 6)
    bank_bits = BANK_BITS + grown(size).bit_length() - 1
    bits = max(bank_bits, (CELLS_PER_WINDOW * windows - 1).bit_length())
    exact_bits = blocks_of(size).bit_length()  # of a fingerprint, to pick its exact bank
    texts = table.groupBy("block")
    counted = texts.applyInArrow(_count(bits, bank_bits), MESSAGE)
    sketch, at1 = materialise(counted.groupBy("bank").applyInArrow(_merge(bank_bits), REPLY), "sketch")
    proposed = texts.cogroup(sketch.groupBy("block")).applyInArrow(_propose(bits, bank_bits, exact_bits), MESSAGE)
    exact, at2 = materialise(proposed.groupBy("bank").applyInArrow(_decide, REPLY), "exact")
    kept = "kept_text string" if with_text else "kept_sha256 string"
    schema = T.StructType.fromDDL(f"doc_id long, n_words long, n_removed long, {kept}")
    others = None
    if whole:
        schema = schema.add(rows.schema["others"])
        others = to_arrow_schema(schema).field("others").type
    out = rows.groupBy("block").cogroup(sketch.unionByName(exact).groupBy("block")).applyInArrow(_remove(bits, bank_bits, exact_bits, with_text, others), schema)
    done, _ = materialise(out, "substring")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path, at1, at2)
    return done
