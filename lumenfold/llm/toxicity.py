"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of hashed words and
word beginnings; a document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents
are labelled; the likelihood of their labels under the noisy-or trains the sentence scorer, which
then points at the sentences at fault. When scoring, a sentence counts by how far it lies above one that holds nothing
learned: a document isn't toxic by its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import add_column, map_batches
from lumenfold.llm.encode import sliced
from lumenfold.llm.words import PUNCT, Words, mix, per_text

BITS = 18
PREFIXES = (4, 5, 6)
TRAIN_PER_CLASS = 2000  # documents of each label that are learned from, the lowest by a hash of their id
EPOCHS, RATE, DECAY = 150, 0.15, 3e-5
#: Chosen by ``cross_validated`` over the training folds of four tables, the best on average: a feature is learned if its documents'
#: labels differ from chance by so much (G-test, one degree of freedom), and so much of the weight is on toxic documents.
LEAST_G2, TOXIC_SHARE = 10.0, 0.5
SLICE_BYTES = 1 << 20
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts in runs of about SLICE_BYTES, and where each run begins."""
    run, size, at = [], 0, 0
    for i, t in enumerate(texts):
        run.append((t or "").lower().encode())
        size += len(run[-1])
        if size >= SLICE_BYTES:
            yield at, run
            run, size, at = [], 0, i + 1
    if run:
        yield at, run


def features(w: Words) -> list[np.ndarray]:
    """Feature indices, an array for each kind; words too short for a beginning use it whole."""
    top = np.uint64(64 - BITS)
    return [(w.hashes() >> top).astype(np.int64)] + [(mix(w.prefix(n) + np.uint64(n)) >> top).astype(np.int64) for n in PREFIXES]


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each sentence that has words, its document, and the sentence number of each word."""
    ends = np.flatnonzero(ENDS[w.buf[:-8]])
    of = np.searchsorted(ends, w.start)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return first, np.searchsorted(w.first, first, "right") - 1, of


def _log1m(p):
    return np.log1p(-np.minimum(np.asarray(p, float), 1 - 1e-12))


def sentence_scores(w: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, document and score of each sentence, 0 for one that holds nothing learned. The last weight is the bias."""
    first, doc, _ = sentences(w)
    if not len(first):
        return first, doc, np.zeros(0)
    z = sum(weights[f] for f in features(w))
    p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(z, first) + weights[-1], -40, 40)))
    floor = 1 / (1 + np.exp(-np.clip(weights[-1], -40, 40)))
    return first, doc, np.maximum(p - floor, 0) / (1 - floor)


def score_texts(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Noisy-or over each text's sentences; a text without words scores 0."""
    out = np.zeros(len(texts))
    for at, run in slices(texts):
        w = Words(run, PUNCT)
        _, doc, p = sentence_scores(w, weights)
        out[at : at + len(run)] = -np.expm1(np.bincount(doc, _log1m(p), len(run)))
    return np.clip(out, 0, 1)


def informative(held: np.ndarray, y: np.ndarray, least: float = LEAST_G2) -> np.ndarray:
    """Features whose presence in a document goes with its label beyond chance, ascending. Others would only be learned by heart.

    ``held``: in how many clean (row 0) and toxic (row 1) documents each feature is.
    """
    b, a = held.astype(float)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    n, g2 = n1 + n0, np.zeros(1 << BITS)
    for seen, rows, cols in ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0)):
        ok = (seen > 0) & (rows > 0)
        g2[ok] += 2 * seen[ok] * np.log(seen[ok] * n / (rows[ok] * cols))
    return np.flatnonzero(g2 >= least)


def train(texts: list[str | None], labels: np.ndarray, least: float = LEAST_G2, share_toxic: float = TOXIC_SHARE) -> np.ndarray:
    """Weights by full-batch Adam on the noisy-or likelihood, with ``share_toxic`` of the weight on toxic documents.

    Texts are read twice, slice by slice: to count features, then to keep the telling ones of each sentence.
    """
    y, held = labels.astype(float), np.zeros((2, 1 << BITS), np.int32)
    for at, run in slices(texts):
        w = Words(run, PUNCT)
        doc = per_text(w.first).astype(np.int64)
        for label in (0, 1):
            rows = np.flatnonzero(labels[at + doc] == label)
            pairs = np.unique(np.concatenate([doc[rows] << BITS | f[rows] for f in features(w)]))
            held[label] += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.int32)
    kinds, number = informative(held, y, least), np.full(1 << BITS, -1, np.int32)
    number[kinds] = np.arange(len(kinds))
    idx, sent, bag, n = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for at, run in slices(texts):
        w = Words(run, PUNCT)
        first, doc, _ = sentences(w)
        of = np.repeat(np.arange(n, n + len(first), dtype=np.int32), np.diff(np.append(first, len(w.start)))) if len(first) else np.zeros(0, np.int32)
        for f in features(w):
            rows = np.flatnonzero(number[f] >= 0)
            idx.append(number[f[rows]])
            sent.append(of[rows])
        bag.append(doc + at)
        n += len(first)
    docs = len(texts)
    weights = np.zeros((1 << BITS) + 1)
    weights[-1] = -5.0
    if not n:
        return weights
    idx, sent, bag = np.concatenate(idx), np.concatenate(sent), np.concatenate(bag)
    share = np.where(y == 1, share_toxic / max(y.sum(), 1), (1 - share_toxic) / max((1 - y).sum(), 1))
    v, b, m, s = np.zeros(len(kinds)), -5.0, np.zeros(len(kinds) + 1), np.zeros(len(kinds) + 1)
    for t in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sent, v[idx], n) + b, -40, 40)))
        none = np.exp(np.bincount(bag, _log1m(p), docs))  # no sentence is at fault
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * share
        g = pull[bag] * p
        grad = np.append(np.bincount(idx, g[sent], len(kinds)) + DECAY * v, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-6)
        v, b = v - step[:-1], b - step[-1]
    weights[kinds], weights[-1] = v, b
    return weights


def cross_validated(texts: list[str | None], labels: np.ndarray, leasts: tuple[float, ...], shares: tuple[float, ...], folds: int = 4) -> list[tuple[float, float, float]]:
    """(score, least, share) of each choice, best first: the mean over folds of the share of labels told right, toxic and clean ones by halves, at 0.5. Give it the training fold only."""
    fold, out = np.arange(len(texts)) % folds, []
    for least in leasts:
        for share in shares:
            right = []
            for f in range(folds):
                weights = train([t for t, k in zip(texts, fold, strict=True) if k != f], labels[fold != f], least, share)
                y, hit = labels[fold == f] == 1, score_texts([t for t, k in zip(texts, fold, strict=True) if k == f], weights) >= 0.5
                right.append((hit[y].mean() + (~hit[~y]).mean()) / 2)
            out.append((float(np.mean(right)), least, share))
    return sorted(out, reverse=True)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    rows = pa.Table.from_batches(got, None if got else pa.schema([("text", pa.string()), ("label", pa.int32())]))
    weights = train(rows["text"].to_pylist(), rows["label"].to_numpy())
    yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = TRAIN_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Sentence weights from labelled documents: at most ``per_class`` of each label, the lowest by a hash of the id.

    Rows of ``labels`` without an id or a label are left out; of several labels of a document the
    highest counts, and of several texts of a document the first in order. Without any labelled document, every sentence scores as the bias alone.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where("_id is not null and label is not null").groupBy("_id").agg(F.max("label").alias("label"))
    picks = [known.where(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * per_class ids
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(picked), "_id")
    rows = rows.groupBy("_id", "label").agg(F.min("text").alias("text"))  # rows that share an id teach once
    out = map_batches(rows.repartition(1).sortWithinPartitions("_id").select("text", "label"), _fit, "weights binary").collect()
    return np.frombuffer(out[0]["weights"], "<f4") if out else train([], np.zeros(0))


def _score(weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [np.zeros(0), *(score_texts(texts, weights) for _, texts in sliced(b, "text"))]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(np.concatenate(scores))})

    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; null and empty texts score 0, repeated rows and null ids are kept. Other columns aren't read."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(rows, _score(weights), "doc_id long, score double")


def add_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column of scores; nothing is joined or moved."""
    return add_column(docs, text_col, out, T.DoubleType(), pa.float64(), lambda: lambda texts: score_texts(texts, weights))


def _locate(weights: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, found = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), []
            for at, low in slices(texts):
                w = Words(low, PUNCT)
                first, doc, p = sentence_scores(w, weights)
                last = np.append(first[1:], len(w.start)) - 1
                for k in np.flatnonzero(p >= least):
                    found.append((ids[at + doc[k]], w.buf[w.start[first[k]] : w.end[last[k]]].tobytes().decode(errors="replace"), float(p[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "sentence", "score"])

    return run


def offending_sentences(docs: DataFrame, weights: np.ndarray, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lower-cased sentence and score of each sentence that scores at least ``least``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(rows, _locate(weights, least), "doc_id long, sentence string, score double")
