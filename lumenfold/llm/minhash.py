"""Near-duplicate classes by improved consistent weighted sampling.

A document is a weighted set of five-word shingles; a shingle weighs its count in the document times
a mild inverse document frequency, ``1 + IDF * ln(N / df) / ln(N)``. The plain one, ``ln(N / df)``, would make the
shingles that a group of near copies shares the lighter the larger the group is, while what each copy has of its own keeps its full
weight: copies that differ in one shingle of ten would fall under 0.8 once the group has some hundreds of
members. Damped so, weights of the rarest and the commonest shingle differ by a quarter, and a pair's similarity by 0.03 at
most at 0.8 from the unweighted one. Document frequencies are counted over all documents for each shingle number of
48 bits: blocks tell them to banks, and banks answer each block. Two different shingles share a number
(and so a count) with probability 2 ** -48: of 5 billion different ones, as about 30 GB may hold, one in 50,000 does, and one in 15 at 100 TB.

``SAMPLES`` weighted samples of each document are banded; documents that share a band are candidates,
and all candidates are decided by exact weighted Jaccard similarity or by a bound that proves them below it. Equal texts are one from the start.

Candidates never become all pairs of a bucket. The first of a bucket is compared with each other
member whose total weight allows 0.8, which settles most buckets of true copies. Where members stay apart from the first, their
whole shingle sets meet in the bucket's task. There, two members can reach 0.8 only if they share one of their rarest
shingles (those beyond which less than 0.8 of a member's weight is left), if their total weights differ
by a fifth at most, and if their distances to the bucket's first, which is a metric's, differ by 0.2 at most. Who passes is compared
exactly unless it is in the same class already, and a link joins two
classes at once. A bucket so gives fewer links than it has members, however many pairs it has. Large buckets
are worked off in pairs of chunks of bounded size.

Texts lie in a bucketed table, and so do their packed shingles with counts; verification sends a document's
shingles once to each block that needs them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenfold.llm.common import drop_path, map_batches, materialise, new_path
from lumenfold.llm.encode import forget
from lumenfold.llm.substring import MESSAGE, MOST_BUCKETS, _messages, blocks_of, bucketed, grown, pack, runs, unpack
from lumenfold.llm.words import PUNCT, Words, mix, per_text

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
IDF = 0.25
BANK_SHINGLES = 4 << 20  # about so many shingles are told to a bank
CHUNK, CHUNK_SHINGLES = 4096, 4 << 20  # members of a bucket, and shingles of theirs, that a task holds twice
POOL = 16
SLICE_BYTES, SLICE_TEXTS = 1 << 19, 1 << 15  # arrays of a slice fit the processor's cache
ID_BITS = 48  # of a shingle's hash; the rest numbers the texts of a slice
EPS = 1e-6  # bounds are given this much room, as weights are summed in 32 bits

_RNG = np.random.default_rng(48)
_TERMS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _RNG.gamma(2.0, 1.0, 1 << POOL).astype(np.float32)
_LOG_C = np.log(_RNG.gamma(2.0, 1.0, 1 << POOL)).astype(np.float32)
_BETA = _RNG.random(1 << POOL).astype(np.float32)


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= SLICE_BYTES or len(run) >= SLICE_TEXTS:
            yield run
            run, size = [], 0
    if run:
        yield run


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, shingle ids (in order within a document) and counts. A text of fewer than five words is one shingle; one without words has none."""
    w = Words([t.decode().lower().encode() for t in texts], PUNCT)
    h, n = w.hashes(), np.diff(w.first)
    doc = per_text(w.first)
    at = np.arange(len(h)) - w.first[doc]
    starts = np.flatnonzero((at + SHINGLE <= n[doc]) | (at == 0))
    acc = np.zeros(len(starts), np.uint64)
    ends = w.first[1:][doc[starts]]
    for j in range(SHINGLE):
        inside = starts + j < ends
        acc += np.where(inside, h[np.minimum(starts + j, len(h) - 1)], np.uint64(j)) * _TERMS[j]
    sid = mix(acc) >> np.uint64(64 - ID_BITS)
    both, count = np.unique(doc[starts].astype(np.uint64) << np.uint64(ID_BITS) | sid, return_counts=True)
    return (both >> np.uint64(ID_BITS)).astype(np.int64), both & np.uint64((1 << ID_BITS) - 1), count


def idf(df: np.ndarray, docs: int) -> np.ndarray:
    """Inverse document frequencies of shingles that ``df`` of ``docs`` documents hold."""
    return (1 + IDF * np.log((docs + 1) / (np.minimum(df, docs) + 1)) / np.log(docs + 1) if docs else np.ones(len(df))).astype(np.float32)


def samples(doc: np.ndarray, sid: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES consistent weighted samples of each of n documents (zeros where there is no shingle)."""
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(doc):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    who, log_s = doc[first], np.log(weight).astype(np.float32)
    place, low = np.arange(len(doc)), np.int64((1 << POOL) - 1)
    for k in range(SAMPLES):
        # Three places of one hash pick r, beta and c, each from its own pool of 65,536 values.
        x = sid * _TURN[k]
        places = x.view(np.int64)
        r, beta, log_a = _R.take((x >> np.uint64(48)).view(np.int64)), _BETA.take((places >> 32) & low), _LOG_C.take((places >> 16) & low)
        t = np.floor(log_s / r + beta)
        beta -= t
        beta -= 1
        beta *= r
        log_a += beta  # ln c - r (t - beta) - r
        bits = log_a.view(np.int32)
        bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)  # orders as the numbers do
        best = np.minimum.reduceat(bits.astype(np.int64) << 32 | place, first) & np.int64(0xFFFFFFFF)
        out[who, k] = (mix(sid[best] * np.uint64(64) + t[best].astype(np.int64).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ids in order, weights)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    same = a[0][at] == b[0]
    low = np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64)
    return float(low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low))


def _told(sids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a block in order, and how many of its documents hold each."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sids]), return_counts=True)


def _block(table: pa.Table) -> list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Shingles of a block's texts, slice by slice: texts in the slice, and what ``shingles`` gives."""
    return [(len(part), shingles(part)) for part in slices([t or b"" for t in table["text"].to_pylist()])]


def _bank(sid: np.ndarray, bits: int) -> np.ndarray:
    return (sid >> np.uint64(ID_BITS - bits)).astype(np.int64)


def _tell(bits: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        forget()
        sid, n = _told([x[1][1] for x in _block(table)])
        block = table["block"][0].as_py()
        return _messages([(bank, block, j - i, pack(np.diff(sid[i:j], prepend=np.uint64(0)), n[i:j].astype(np.uint32))) for bank, i, j in runs(_bank(sid, bits))])

    return run


def _sum(table: pa.Table) -> pa.Table:
    """Answers each block with the documents over all blocks that hold each of its shingles."""
    bank, blocks, sizes = table["bank"][0].as_py(), table["block"].to_pylist(), table["n"].to_pylist()
    parts = [unpack(raw, n, "u8", "u4") for n, raw in zip(sizes, table["payload"].to_pylist(), strict=True)]
    sid, count = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(sid, kind="stable")
    new = np.concatenate([[True], sid[order][1:] != sid[order][:-1]])
    total = np.empty(len(sid), np.uint32)
    total[order] = np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return _messages([(bank, b, n, pack(total[i:j])) for b, n, i, j in zip(blocks, sizes, cut[:-1], cut[1:], strict=True)])


SET = "u4", "u2", "u4", "u4"  # low and high bits of shingles, counts in the document, documents that hold them


def _weigh(docs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        import hashlib

        forget()
        names = ["uid", "doc_id", "block", "key", "n", "total", "shingles", "sketch"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        found = _block(table)
        _, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[1][1] for x in found)]), return_inverse=True)
        got = sorted(zip(*(replies[c].to_pylist() for c in ("bank", "n", "payload")), strict=True)) if replies.num_rows else []
        df = np.concatenate([np.zeros(0, np.uint32), *(unpack(raw, n, "u4")[0] for _, n, raw in got)])
        size, total, sets, sketch, at = [], [], [], [], 0
        for many, (doc, sid, count) in found:
            d = df[number[at : at + len(sid)]]
            at += len(sid)
            cut = np.searchsorted(doc, np.arange(many + 1))
            low, high, n = sid.astype(np.uint32), (sid >> np.uint64(32)).astype(np.uint16), count.astype(np.uint32)
            size += np.diff(cut).tolist()
            sets += [pack(low[i:j], high[i:j], n[i:j], d[i:j]) if i < j else None for i, j in zip(cut[:-1], cut[1:], strict=True)]
            weight = count * idf(d, docs)
            total += np.bincount(doc, weight, many).tolist()
            rows = samples(doc, sid, weight, many)
            sketch += [row.tobytes() if i < j else None for row, i, j in zip(rows, cut[:-1], cut[1:], strict=True)]
        keys = [hashlib.sha256(t or b"").digest()[:16] for t in table["text"].to_pylist()]
        return pa.table([table["uid"], table["doc_id"], table["block"], *(pa.array(x, t) for x, t in zip((keys, size, total, sets, sketch), types[3:], strict=True))], names=names)

    return run


def weighed(stored: DataFrame, size: int) -> tuple[DataFrame, str, str, int]:
    """Each row's key, weighted shingles and samples, in a table bucketed as ``stored`` is: table, its name, its path, and the number of rows.

    A block tells banks of shingles which it holds and in how many documents; a bank adds up and
    answers. Counts are exact for each of the 2 ** ID_BITS shingle numbers, however large the corpus.
    """
    spark, docs = stored.sparkSession, stored.count()
    bits = max(1, (size // 6 // (BANK_SHINGLES * grown(size))).bit_length())
    n = min(MOST_BUCKETS, blocks_of(size))
    texts = stored.select("uid", "doc_id", "block", "text").groupBy("block")
    sums, at = materialise(texts.applyInArrow(_tell(bits), MESSAGE).groupBy("bank").applyInArrow(_sum, MESSAGE), "frequencies")
    out = texts.cogroup(sums.groupBy("block")).applyInArrow(_weigh(docs), "uid long, doc_id long, block long, key binary, n int, total double, shingles binary, sketch binary")
    name, path = f"lumenfold_{uuid.uuid4().hex}", new_path(spark, "sketches")
    out.write.bucketBy(n, "block").option("compression", "zstd").option("path", path).saveAsTable(name)
    drop_path(spark, at)
    return spark.table(name), name, path, docs


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2])
        for j in range(ROWS):
            h = mix(h * np.uint64(3) + s[:, :, j])
        uid = np.repeat(b.column("uid").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(uid)], names=["bucket", "uid"])


def _sets(table: pa.Table, wanted: pa.Table) -> pa.Table:
    """(uid, n, shingles) of the wanted rows of a block."""
    mask = pa.compute.is_in(table["uid"], value_set=wanted["uid"].combine_chunks()) if wanted.num_rows and table.num_rows else None
    if not table.num_rows:
        return pa.table({"uid": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "shingles": pa.array([], pa.binary())})
    return (table.filter(mask) if mask is not None else table.slice(0, 0)).select(["uid", "n", "shingles"])


def _kept(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, kept: pa.Table) -> pa.Table:
        """Rows of a block whose uid is kept."""
        if not table.num_rows or not kept.num_rows:
            return schema.empty_table()
        return table.filter(pa.compute.is_in(table["uid"], value_set=kept["uid"].combine_chunks()))

    return run


def weighted_sets(table: pa.Table, docs: int, with_df: bool = False):
    """Ids and weights of the packed shingles of each row; with them, how many documents hold each."""
    out, held = [], []
    for n, raw in zip(table["n"].to_pylist(), table["shingles"].to_pylist(), strict=True):
        low, high, count, df = unpack(raw, n, *SET)
        out.append((low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), count * idf(df, docs)))
        held.append(df)
    return (out, held) if with_df else out


def _verify(docs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, needs: pa.Table) -> pa.Table:
        forget()
        out: list[tuple[int, int, float]] = []
        if table.num_rows and needs.num_rows:
            given = needs.filter(pa.compute.is_valid(needs["shingles"]))
            pairs = needs.filter(pa.compute.is_null(needs["shingles"]))
            own = _sets(table, pa.table({"uid": pairs["b"]}))
            sets = dict(zip(given["a"].to_pylist(), weighted_sets(given, docs), strict=True)) | dict(zip(own["uid"].to_pylist(), weighted_sets(own, docs), strict=True))
            out = [(a, b, similarity(sets[a], sets[b])) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "sim": pa.array([x[2] for x in out], pa.float64())})

    return run


def verify(table: DataFrame, pairs: DataFrame, docs: int) -> DataFrame:
    """(a, b, sim) of pairs (a, b, block_a, block_b). A document's shingles go once to each block that compares something with them."""
    blocks = table.groupBy("block")
    sources = pairs.select(F.col("block_a").alias("block"), F.col("a").alias("uid")).distinct()
    sets = blocks.cogroup(sources.groupBy("block")).applyInArrow(_sets, "uid long, n int, shingles binary")
    to = pairs.select(F.col("a").alias("uid"), F.col("block_b").alias("block")).distinct()
    sent = to.join(sets, "uid").select("block", F.col("uid").alias("a"), F.lit(None).cast("long").alias("b"), "n", "shingles")
    asked = pairs.select(F.col("block_b").alias("block"), "a", "b", F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("shingles"))
    return blocks.cogroup(sent.unionByName(asked).groupBy("block")).applyInArrow(_verify(docs), "a long, b long, sim double")


def components(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, str]:
    """(uid, label): the smallest node of each node's component, by min-label steps with pointer jumping; written tables cut lineage."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both, edges_at = materialise(both, "edges")
    labels, at = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "uid"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, labels.uid == near.a).select("uid", "label", F.least("label", "near").alias("low"))
        # A label is a node too: take its label if that is lower.
        jump = labels.select(F.col("uid").alias("low"), F.col("label").alias("further"))
        step = best.join(jump, "low", "left").select("uid", F.least("low", F.coalesce("further", "low")).alias("label"), (F.least("low", F.coalesce("further", "low")) < F.col("label")).alias("moved"))
        done, new_at = materialise(step, "labels")
        moved = done.where("moved").limit(1).count()
        drop_path(spark, at)
        labels, at = done.select("uid", "label"), new_at
        if not moved:
            drop_path(spark, edges_at)
            return labels, at


def rarest(own: tuple[np.ndarray, np.ndarray], df: np.ndarray) -> np.ndarray:
    """Places of the shingles one of which any set at LEAST or nearer shares: the rarest, until less than LEAST of the weight is left."""
    order = np.lexsort((own[0], df))
    left = np.cumsum(own[1][order][::-1], dtype=np.float64)[::-1]  # the weight from each on
    return order[left >= LEAST * left[0] - EPS * left[0]] if len(order) else order


def _rest(docs: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        forget()
        uid, label, apart, low, high = (table[c].to_numpy() for c in ("uid", "label", "apart", "low", "high"))
        sets, frequencies = weighted_sets(table, docs, with_df=True)
        total = np.array([x[1].sum(dtype=np.float64) for x in sets])
        heads = [x[0][rarest(x, df)] for x, df in zip(sets, frequencies, strict=True)]
        # Who holds a shingle among its rarest, in order of shingle.
        sid, owner = np.concatenate(heads), np.repeat(np.arange(len(sets)), [len(x) for x in heads])
        order = np.argsort(sid, kind="stable")
        sid, owner = sid[order], owner[order]
        _, group = np.unique(label, return_inverse=True)
        links: list[tuple[int, int, float]] = []
        for u in np.flatnonzero(apart)[np.argsort(uid[apart], kind="stable")].tolist():
            first, end = np.searchsorted(sid, heads[u], "left"), np.searchsorted(sid, heads[u], "right")
            shared = np.bincount(owner[np.repeat(first - np.cumsum(end - first) + (end - first), end - first) + np.arange((end - first).sum())], minlength=len(sets))
            fits = (shared > 0) & (group != group[u]) & (np.minimum(total, total[u]) >= (LEAST - EPS) * np.maximum(total, total[u]))
            # By the triangle inequality: distances to the bucket's first differ by no more than a linked pair is apart.
            fits &= (low <= high[u] + 1 - LEAST + EPS) & (high >= low[u] - (1 - LEAST) - EPS)
            near = np.flatnonzero(fits)
            for v in near[np.argsort(-shared[near], kind="stable")].tolist():
                if group[v] != group[u] and (sim := similarity(sets[u], sets[v])) >= LEAST:
                    links.append((min(int(uid[u]), int(uid[v])), max(int(uid[u]), int(uid[v])), sim))
                    group[group == group[v]] = group[u]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64()), "sim": pa.array([x[2] for x in links], pa.float64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the smallest id in its class.

    Classes are connected by equal texts and by pairs of weighted Jaccard similarity of at least
    0.8. Words are lower-cased runs of letters and digits; texts of fewer than five words are one shingle, and texts
    without words join only equal texts. Null is an empty text; null ids have a class but
    never name one (class_id is null where all ids are). Repeated rows get a row each. Only the two
    named columns are read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    stored, name, path, size = bucketed(docs, id_col, text_col, number=True)
    rows, sketches, tables = labelled(stored, size)
    rows, r_at = materialise(rows.select("doc_id", "label"), "labelled")
    least, at = materialise(rows.groupBy("label").agg(F.min("doc_id").alias("class_id")), "named")
    out, _ = materialise(rows.join(least, "label").select("doc_id", "class_id"), "classes")
    drop_path(spark, r_at, at)
    for table in (name, sketches):
        spark.sql(f"DROP TABLE {table}")
    drop_path(spark, path, *tables)
    return out


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of ``docs`` for each class of ``near_duplicates``: that with the smallest id.

    Rows count one by one, whatever their ids: different texts that share an id or have none each stay
    in their own class. A null id comes after all others; of equal ids, one text is taken by its hash.
    """
    spark = docs.sparkSession
    stored, name, path, size = bucketed(docs, id_col, text_col, number=True, whole=True)
    rows, sketches, tables = labelled(stored.select("doc_id", "text", "block", "uid"), size)
    first = F.min_by(F.struct("uid", "block"), F.struct(F.col("doc_id").isNull(), "doc_id", "key", "uid")).alias("first")
    kept, at = materialise(rows.groupBy("label").agg(first).select("first.*"), "kept")
    spark.sql(f"DROP TABLE {sketches}")
    drop_path(spark, *tables)
    text = F.col("text").cast("string").cast(docs.schema[text_col].dataType)
    # Rows stay where they lie: a join by uid would move every text, and sort it.
    whole = stored.select("uid", "text", "others", "block")
    found = whole.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(_kept(to_arrow_schema(whole.schema)), whole.schema).select(*[(text if c == text_col else F.col("others").getField(c)).alias(c) for c in docs.columns])
    out, _ = materialise(found, "kept-rows")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path, at)
    return out


def labelled(stored: DataFrame, size: int) -> tuple[DataFrame, str, list[str]]:
    """(uid, doc_id, block, key, label) of each row of a bucketed table, key a hash of its text and label its class; the name and paths of the tables that this reads.

    Small sides of joins on a key that may be hot (a bucket, a class) are written tables, so that the other side can be split.
    """
    spark = stored.sparkSession
    sketched, sketches, s_at, docs = weighed(stored, size)
    packed = sketched.select("uid", "block", "n", "shingles")
    tables = [s_at]

    def kept(df: DataFrame, tag: str) -> DataFrame:
        out, at = materialise(df, tag)
        tables.append(at)
        return out

    ones = kept(sketched.groupBy("key").agg(F.min("uid").alias("uid"), *[F.min_by(c, "uid").alias(c) for c in ("block", "n", "total", "sketch")]), "texts")
    held = ones.where("sketch is not null")
    # Where several documents share a band.
    band = map_batches(held.select("uid", "sketch"), _bands, "bucket long, uid long")
    shared = kept(band.groupBy("bucket").agg(F.min("uid").alias("head"), F.count("*").alias("n")).where("n > 1"), "shared")
    members = kept(band.join(shared, "bucket").select("bucket", "head", "uid").where("uid <> head"), "buckets")
    of = held.select("uid", "block", "total")
    stars = members.select(F.col("head").alias("a"), F.col("uid").alias("b")).distinct()
    left = of.select(F.col("uid").alias("a"), F.col("block").alias("block_a"), F.col("total").alias("total_a"))
    right = of.select(F.col("uid").alias("b"), F.col("block").alias("block_b"), F.col("total").alias("total_b"))
    # No pair is more alike than its lighter document's share of the heavier one's weight.
    stars = kept(stars.join(left, "a").join(right, "b").withColumn("most", F.least("total_a", "total_b") / F.greatest("total_a", "total_b")), "stars")
    checked = kept(verify(packed, stars.where(F.col("most") >= LEAST - EPS).select("a", "b", "block_a", "block_b"), docs), "verified")
    labels, at = components(spark, checked.where(F.col("sim") >= LEAST))
    tables.append(at)
    # Bounds of each member's distance to its bucket's first, equal where the pair was verified.
    known = stars.join(checked, ["a", "b"], "left").select(F.col("a").alias("head"), F.col("b").alias("uid"), F.coalesce(1 - F.col("sim"), 1 - F.col("most")).alias("low"), F.coalesce(1 - F.col("sim"), F.lit(1.0)).alias("high"))
    heads = labels.select(F.col("uid").alias("head"), F.col("label").alias("head_label"))
    own = members.join(labels, "uid", "left").select("bucket", "head", "uid", F.coalesce("label", "uid").alias("label"))
    own = own.join(heads, "head", "left").withColumn("apart", F.col("label") != F.coalesce("head_label", "head"))
    open_ = kept(own.join(known, ["head", "uid"]).join(held.select("uid", "n"), "uid").select("bucket", "uid", "label", "apart", "low", "high", "n"), "open")
    least = open_.groupBy("bucket").agg(F.min(F.when(F.col("apart"), F.col("low"))).alias("least"), F.count("*").alias("members"), F.sum("n").alias("weight")).where("least is not null and members > 1")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    least = kept(least.select("bucket", "least", chunks.alias("chunks")), "least")
    rest = open_.join(least, "bucket").where(F.col("high") >= F.col("least") - (1 - LEAST) - EPS)
    chunk = F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(chunk, c).alias("i"), F.greatest(chunk, c).alias("j")))
    rest = kept(rest.select("bucket", "uid", "label", "apart", "low", "high", F.explode(cells).alias("cell")), "rest")
    blocks = packed.groupBy("block")
    wanted = rest.select("uid").distinct().join(of, "uid").select("uid", "block")
    sets = blocks.cogroup(wanted.groupBy("block")).applyInArrow(_sets, "uid long, n int, shingles binary")
    more = kept(rest.join(sets, "uid").groupBy("bucket", "cell").applyInArrow(_rest(docs), "a long, b long, sim double"), "links")
    labels, at = components(spark, checked.unionByName(more).where(F.col("sim") >= LEAST))
    tables.append(at)
    named = ones.select("key", "uid").join(labels, "uid", "left").select("key", F.coalesce("label", "uid").alias("label"))
    return sketched.select("uid", "doc_id", "block", "key").join(named, "key").select("uid", "doc_id", "block", "key", "label"), sketches, tables
