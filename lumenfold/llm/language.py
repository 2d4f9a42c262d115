"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length; each filter's
largest value over the window goes through a linear layer and softmax. Every window of a text is
scored, in batches, and their probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import map_batches
from lumenfold.llm.encode import sliced

WINDOW, WIDTHS, FILTERS, EMBED = 64, (2, 3, 4), 16, 8
WIDEST = max(WIDTHS)
TRAIN_PER_LANG = 400  # documents of a language that are learned from, with all their windows
EPOCHS, BATCH, RATE = 4, 512, 0.01
BLOCK = 2048  # windows that are scored at once
LETTER = regex.compile(r"\p{L}")  # Unicode's letters: neither digits nor signs such as a half or a squared


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows over whole texts, and how many each text has. Each overlaps the next by WIDEST - 1 bytes; the last is filled with spaces."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    tail = WIDEST - 1
    flat = np.frombuffer(b"".join(t.ljust(k * WINDOW) for t, k in zip(texts, n.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
    over = np.full((len(flat), tail), 32, np.uint8)
    over[:-1] = flat[1:, :tail]
    over[np.cumsum(n) - 1] = 32  # the next text's bytes are none of this one's
    return np.concatenate([flat, over], axis=1), n


class Network:
    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs, f = langs, FILTERS * len(WIDTHS)
        self.mask = np.zeros((WIDEST, EMBED, f), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, f)
        self.p = {
            "embed": rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5,
            "conv": (rng.standard_normal((WIDEST * EMBED, f)) * 0.25).astype(np.float32) * self.mask,
            "bias": np.zeros(f, np.float32),
            "out": (rng.standard_normal((f, len(langs))) * 0.1).astype(np.float32),
            "base": np.zeros(len(langs), np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x].reshape(len(x), -1)
        s = e.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, WIDEST * EMBED), (s[0], EMBED * s[1], s[1])))

    def probabilities(self, x: np.ndarray, pos: bool = False):
        cols = self._columns(x)
        conv = (cols.reshape(-1, WIDEST * EMBED) @ self.p["conv"]).reshape(len(x), WINDOW, -1)
        top = conv.max(axis=1) + self.p["bias"]
        h = np.maximum(top, 0)
        z = h @ self.p["out"] + self.p["base"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        probs = z / z.sum(axis=1, keepdims=True)
        return (probs, h, cols, conv.argmax(axis=1)) if pos else probs

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        probs, h, cols, pos = self.probabilities(x, True)
        d = probs.copy()
        d[np.arange(len(x)), y] -= 1
        d /= len(x)
        dh = (d @ self.p["out"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        picked = cols[rows, pos]  # the bytes under each filter's largest value
        dx = dh[:, :, None] * self.p["conv"].T[None]
        at = x[rows[:, :, None], pos[:, :, None] + np.arange(WIDEST)].ravel()
        dx = dx.reshape(-1, EMBED)
        embed = np.stack([np.bincount(at, dx[:, i], 256) for i in range(EMBED)], axis=1)
        return {"embed": embed, "conv": np.einsum("nf,nfk->kf", dh, picked) * self.mask, "bias": dh.sum(0), "out": h.T @ d, "base": d.sum(0)}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng, m, s, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                for k, g in self.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        run: list[int] = []
        size = 0
        for k, i in enumerate(some):
            run.append(i)
            size += len(texts[i])
            if size >= (1 << 20) or k == len(some) - 1:
                x, n = windows([texts[j].encode() for j in run])
                probs = np.concatenate([self.probabilities(x[b : b + BLOCK]) for b in range(0, len(x), BLOCK)])
                mean = np.add.reduceat(probs, np.cumsum(n) - n) / n[:, None]
                for j, row in zip(run, mean, strict=True):
                    langs[j], scores[j] = self.langs[int(row.argmax())], float(min(1.0, row.max()))
                run, size = [], 0
        return langs, scores


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    got = list(batches)
    rows = pa.Table.from_batches(got, None if got else pa.schema([("text", pa.string()), ("lang", pa.string())]))
    net = Network(sorted(set(rows["lang"].to_pylist())))
    xs, ys = [], []
    for t, lang in zip(rows["text"].to_pylist(), rows["lang"].to_pylist(), strict=True):
        x, _ = windows([t.encode()])
        xs.append(x)
        ys.append(np.full(len(x), net.langs.index(lang)))
    if xs:
        net.train(np.concatenate(xs), np.concatenate(ys))
    yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps((net.langs, net.p))], pa.binary())})


def fit(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network trained in one task on at most ``per_lang`` documents of each language, the lowest by a hash of the id: all windows of their whole texts.

    Languages are counted first; then one scan takes of each about four times the documents wanted, by their hash, and of these the lowest.
    Rows without a language or without a letter teach nothing; of rows that share an id and a language one does. Without any row the network knows no language.
    """
    import pickle

    lang = F.col(f"`{lang_col}`").cast("string")
    sizes = docs.where(lang.isNotNull()).groupBy(lang.alias("lang")).count().select("lang", F.least(F.lit(1.0), 4 * (per_lang + 25) / F.col("count")).alias("share"))  # languages are few
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    place = F.xxhash64("_id") / F.lit(2.0**64) + 0.5
    some = rows.withColumn("_place", place).join(F.broadcast(sizes), "lang").where((F.col("_place") <= F.col("share")) & F.col("text").rlike(r"\p{L}"))
    once = some.groupBy("lang", "_id", "_place").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_place", "_id"))
    picked = once.withColumn("_rank", rank).where(F.col("_rank") <= per_lang)
    ranked = picked.select("text", "lang", "_place", "_id").repartition(1).sortWithinPartitions("lang", "_place", "_id")
    out = map_batches(ranked.select("text", "lang"), _fit, "net binary").collect()
    langs, p = pickle.loads(out[0]["net"]) if out else ([], None)
    net = Network(langs)
    if p:
        net.p = p
    return net


def _predict(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            for at, texts in sliced(b, "text") if net.langs else ():
                langs[at : at + len(texts)], scores[at : at + len(texts)] = net.predict(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row. Null, empty and letterless texts are ``und`` with score 0; repeated rows and null ids are kept."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(rows, _predict(net), "doc_id long, lang_pred string, score double")
