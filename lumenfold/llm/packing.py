"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's token ids are hashed into a vector, projected to a few dimensions by a fixed
Gaussian matrix and quantised; its position along the Hilbert curve through that grid is its
key. Documents are put in order of key, their ids form one stream, and the stream is cut at every
``length`` ids. Only the last sequence is padded, and a document is cut only where a sequence ends.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, map_batches, materialise, running_positions
from lumenfold.llm.encode import encoder, sliced

END_ID = 1
FEATURES, DIMS, BITS = 256, 4, 10
SLICE = 1000


def hilbert_key(points, bits: int):
    """Positions along the Hilbert curve of integer points (rows) below ``2 ** bits``, by Skilling's transform."""
    import numpy as np

    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


@functools.cache
def _projection():
    """A token's bucket and sign in one number, for every 16-bit id, and the Gaussian matrix."""
    import numpy as np

    h = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cell = ((h >> np.uint64(56)) * np.uint64(2) + ((h >> np.uint64(40)) & np.uint64(1))).astype(np.int64)  # FEATURES = 256
    return cell, np.random.default_rng(17).standard_normal((FEATURES, DIMS))


def document_points(flat, cut):
    """Grid points of documents, given their ids one after another and where each ends."""
    import numpy as np

    cell, matrix = _projection()
    rows = np.repeat(np.arange(0, (len(cut) - 1) * FEATURES * 2, FEATURES * 2), np.diff(cut))
    rows += cell[flat]  # counts of either sign are subtracted
    v = np.bincount(rows, minlength=(len(cut) - 1) * FEATURES * 2).reshape(-1, FEATURES, 2)
    v = (v[:, :, 1] - v[:, :, 0]).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    y = v @ matrix
    top = 1 << BITS
    return np.clip((0.5 + y / 6) * top, 0, top - 1).astype(np.int64)  # +-3 standard deviations of a projection of a unit vector


def _tokens(path: str, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        enc, uid, squeeze = encoder(path, kind, 2), TaskContext.get().partitionId() << 36, zstandard.ZstdCompressor(1)
        for whole in batches:
            for at, texts in sliced(whole, "text"):
                b = whole.slice(at, len(texts))
                flat, cut = enc.flat(texts, END_ID)
                n = np.diff(cut)
                key = hilbert_key(document_points(flat, cut), BITS)
                packed = [squeeze.compress(flat[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(uid + np.arange(len(n))), pa.array(key), pa.array(n), pa.array(packed, pa.binary())],
                    names=["doc_id", "uid", "key", "doc_tokens", "ids"],
                )
                uid += len(n)

    return run


def _pieces(length: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import zstandard

        open_up = zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                doc, at_, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "_at", "doc_tokens"))
                rows, starts, lengths, crc, ids = [], [], [], [], []
                for i, z in enumerate(b.column("ids").to_pylist()):
                    flat = np.frombuffer(open_up.decompress(z), "<u2").astype("<u4")
                    s = 0
                    while s < n[i]:
                        m = min(int(n[i]) - s, length - (int(at_[i]) + s) % length)
                        rows.append(i)
                        starts.append(s)
                        lengths.append(m)
                        crc.append(zlib.crc32(flat[s : s + m]))
                        if with_ids:
                            ids.append(flat[s : s + m].astype(np.int32))
                        s += m
                at_piece = at_[rows] + np.array(starts, np.int64) if rows else np.zeros(0, np.int64)
                cols = {
                    "doc_id": b.column("doc_id").take(pa.array(rows, pa.int64())),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(n[rows] if rows else [], pa.int64()),
                    "sequence_id": pa.array(at_piece // length, pa.int64()),
                    "offset": pa.array(at_piece % length, pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", length: int = 2048, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    The vocabulary has at most 65,536 ids: between the passes an id takes two bytes. Every whole text is encoded, with the end id behind it; a null or empty text is the end id
    alone. Equal keys are ordered by id, so ties and copies still spread over tasks. Repeated rows
    and null ids are documents of their own. Only the two named columns are read. An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    coded, coded_at = materialise(map_batches(rows, _tokens(tokenizer, kind), "doc_id long, uid long, key long, doc_tokens long, ids binary"), "pack-ids")
    placed, placed_at = running_positions(coded.select("uid", "key", "doc_id", "doc_tokens"), ["key", "doc_id", "uid"], "doc_tokens", "_at")
    out = coded.join(placed.select("uid", "_at"), "uid").select("doc_id", "_at", "doc_tokens", "ids")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    pieces, _ = materialise(map_batches(out, _pieces(length, with_ids), fields), "pieces")
    drop_path(spark, coded_at, placed_at)
    return pieces
