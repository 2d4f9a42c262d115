"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards of about ``SHARD`` by a hash. In a shard, a graph is built in two passes:
a greedy beam search on the graph so far proposes neighbours of each vector, and pruning keeps
a neighbour only if none that is kept already is nearer to it by the factor ``ALPHA``, so that
edges point in diverse directions. A query runs a beam search in every shard, what it meets is scored
exactly in double precision, and shards' best are merged.

Vectors of one direction would fill each other's edges, so a graph holds each direction once (the vector divided
by its largest component), with the smallest ``k + 1`` of its ids; no larger id of the group can be among the k nearest.

The index is a table of one row a shard. Queries are the side of known size: blocks of at most ``QUERY_BYTES`` are
sent to all workers, and each pass reads the index once, where it lies; only each task's best go through a shuffle.
Work is queries times shards, as every query is searched in every shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, map_batches, materialise, new_path

SHARD, DEGREE, BEAM, ALPHA = 4096, 24, 64, 1.2
SHARD_BYTES = 64 << 20  # vectors of a shard take no more: long ones make smaller shards
BATCH, EXPAND = 256, 4
QUERY_BYTES = 32 << 20
MOST_TASKS = 1 << 14


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest vectors (by dot product) that a search from ``start`` meets, for each query; -1 fills up."""
    n, m = len(x), len(q)
    rows = np.arange(m)[:, None]
    ids, sims = np.full((m, beam), -1), np.full((m, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = start, q @ x[start]
    opened, met = np.zeros((m, beam), bool), np.zeros((m, n + 1), bool)
    met[:, [start, n]] = True  # the last column stands for no neighbour
    while True:
        waiting = np.where(opened | (ids < 0), -np.inf, sims)
        pick = np.argpartition(-waiting, min(EXPAND, beam - 1), axis=1)[:, :EXPAND]
        valid = np.isfinite(np.take_along_axis(waiting, pick, 1))
        if not valid.any():
            return ids, sims
        opened[rows, pick] |= valid
        near = np.where(valid[:, :, None], graph[np.take_along_axis(ids, pick, 1)], n).reshape(m, -1)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[met[rows, near]] = n
        met[rows, near] = True
        far = near == n
        sim = np.einsum("mrd,md->mr", x[np.where(far, 0, near)], q)
        sim[far] = -np.inf
        all_ids, all_sims = np.concatenate([ids, np.where(far, -1, near)], 1), np.concatenate([sims, sim], 1)
        all_open = np.concatenate([opened, np.zeros_like(far)], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids, sims, opened = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))


def prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours for each of the vectors ``of`` from its candidates (-1: none)."""
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == of[:, None]] = -1
    v = x[cand]
    dist = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", v, x[of])))
    dist[cand < 0] = np.inf
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))))
    alive, out, rows = np.isfinite(dist), np.full((len(of), DEGREE), -1), np.arange(len(of))
    for r in range(DEGREE):
        left = np.where(alive, dist, np.inf)
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, r] = cand[rows, best][some]
        alive &= ALPHA * between[rows, best] > dist
        alive[rows, best] = False
    return out


def build_graph(x: np.ndarray, seed: int = 11) -> tuple[np.ndarray, int]:
    """Edges (rows of DEGREE, -1 filled) and the start of searches: the vector nearest to the mean."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int((x @ x.mean(axis=0)).argmax())
    graph = rng.integers(0, n, (n, DEGREE))
    graph[graph == np.arange(n)[:, None]] = -1
    for _ in range(2):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            of = order[i : i + BATCH]
            met, _ = beam_search(x, graph, start, x[of], BEAM)
            graph[of] = prune(x, of, np.concatenate([met, graph[of]], 1))
            # Each new edge is offered backwards; vectors that are offered any are pruned again.
            to, src = graph[of].ravel(), np.repeat(of, DEGREE)
            src, to = src[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            src, to = src[by], to[by]
            who, first, many = np.unique(to, return_index=True, return_counts=True)
            if len(who):
                offered = np.full((len(who), int(min(many.max(), 64))), -1)
                place = np.arange(len(to)) - np.repeat(first, many)
                fits = place < offered.shape[1]
                offered[np.repeat(np.arange(len(who)), many)[fits], place[fits]] = src[fits]
                for j in range(0, len(who), BATCH):
                    w = who[j : j + BATCH]
                    graph[w] = prune(x, w, np.concatenate([graph[w], offered[j : j + BATCH]], 1))
    return graph, start


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


INDEX = "shard int, dim int, n int, start int, vectors binary, edges binary, ids binary, many binary"


def _build(table: pa.Table) -> pa.Table:
    """The row of a shard: its vectors (doubles), edges, ids (one vector's after another's) and how many ids each vector has."""
    order = np.lexsort((table["first_id"].to_numpy(),))
    dim, ids = table["dim"][0].as_py(), [table["ids"][int(i)].as_py() for i in order]
    x = np.concatenate([np.zeros(0), table["embedding"].combine_chunks().flatten().to_numpy()]).reshape(len(order), dim)[order]
    graph, start = build_graph(_unit(x))
    cols = [table["shard"][0].as_py(), dim, len(x), start, x.tobytes(), graph.astype(np.int32).tobytes(), np.array([i for g in ids for i in g], np.int64).tobytes(), np.array([len(g) for g in ids], np.int32).tobytes()]
    kinds = [*[pa.int32()] * 4, *[pa.binary()] * 4]
    return pa.table([pa.array([v], t) for v, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, embedding) of rows whose vector isn't null, empty or zero and has finite components only; repeated rows once.

    The embedding is the vector's direction: divided by its largest absolute component, in double precision.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = rows.where(finite).withColumn("_top", F.array_max(F.transform("embedding", F.abs))).where("_top > 0")
    return rows.select("vec_id", F.transform("embedding", lambda e: e / F.col("_top") + F.lit(0.0)).alias("embedding")).dropDuplicates(["vec_id", "embedding"])


def build_index(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, str]:
    """The index of every usable row, a row a shard, and the path of its table. Vectors of different lengths lie in different shards."""
    spark = vectors.sparkSession
    w = Window.partitionBy("embedding").orderBy("vec_id")  # each task keeps k + 1 rows of a direction before the shuffle
    kept = usable(vectors, id_col, vec_col).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    once = kept.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    once, at = materialise(once, "ann-vectors")
    size = once.agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 8).alias("bytes")).first()
    shards = max(1, -(-size["n"] // SHARD), -(-(size["bytes"] or 0) // SHARD_BYTES))
    dealt = once.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"), F.col("ids")[0].alias("first_id"), "ids", "embedding")
    built = dealt.repartition(min(shards, MOST_TASKS), "shard").groupBy("shard", "dim").applyInArrow(_build, INDEX)
    index, path = materialise(built, "ann-index")
    drop_path(spark, at)
    return index, path


def merged(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, an id once, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    _, first = np.unique(np.stack([query, vec]), axis=1, return_index=True)
    keep = np.zeros(len(query), bool)
    keep[first] = True  # the best row of an id, as rows are in order of score
    query, vec, score = query[keep], vec[keep], score[keep]
    new = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
    rank = np.arange(len(query)) - np.repeat(new, np.diff(np.append(new, len(query))))
    return query[rank < k], vec[rank < k], score[rank < k]


def _search(k: int, block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for r in (r for b in batches for r in b.to_pylist()):
            own, q = block.value.get(r["dim"], (np.zeros(0, np.int64), None))
            x = np.frombuffer(r["vectors"]).reshape(r["n"], r["dim"])
            graph, many = np.frombuffer(r["edges"], np.int32).reshape(r["n"], DEGREE), np.frombuffer(r["many"], np.int32)
            ids, first, norm, unit = np.frombuffer(r["ids"], np.int64), np.cumsum(many) - many, np.linalg.norm(x, axis=1), _unit(x)
            found = [best]
            for i in range(0, len(own), BATCH):
                v, asks = q[i : i + BATCH], own[i : i + BATCH]
                met, _ = beam_search(unit, graph, r["start"], _unit(v), BEAM)
                near = np.maximum(met, 0)
                score = np.einsum("mbd,md->mb", x[near], v) / (norm[near] * np.linalg.norm(v, axis=1)[:, None])
                score[met < 0] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 2]
                # Where more than these tie, all that tie are looked at.
                last = np.take_along_axis(score, top[:, -1:], 1)
                row, col = np.nonzero((score >= last) & np.isfinite(score))
                vec = near[row, col]
                each = many[vec]
                flat = np.repeat(first[vec] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                who, vec, s = np.repeat(asks[row], each), ids[flat], np.repeat(score[row, col], each)
                found.append(merged(who[who != vec], vec[who != vec], s[who != vec], k))
            best = merged(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (query_id, embedding), ties to the smaller vec_id.

    A query is compared with vectors of its own length. A query id with several vectors is asked with each, and its best count.
    """
    spark, path = index.sparkSession, new_path(index.sparkSession, "ann-found")
    size = queries.agg(F.sum(F.size("embedding") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("query_id", "embedding"), F.lit(blocks)) == b).select("query_id", F.size("embedding").alias("dim"), "embedding").toArrow()
        block = {}
        for dim in got["dim"].unique().to_pylist():
            of = got.filter(pa.compute.equal(got["dim"], dim))
            block[dim] = of["query_id"].to_numpy(), of["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        sent = spark.sparkContext.broadcast(block)
        map_batches(index, _search(k, sent), "query_id long, vec_id long, score double").write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out, _ = materialise(best.select("query_id", "rank", "vec_id", "score"), "ann-nearest")
    drop_path(spark, path)
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all other rows.

    Vectors that are null, empty, zero or hold a null or non-finite component take no part; those of different
    lengths are never compared. Components may have any size: a vector counts by its direction. Repeated rows count once.
    An empty table gives an empty result. Other columns aren't read.
    """
    queries = usable(vectors, id_col, vec_col).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    index, path = build_index(vectors, k, id_col, vec_col)
    out = search(index, queries, k)
    drop_path(vectors.sparkSession, path)
    return out
