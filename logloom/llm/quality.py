"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes step over the whole text by ``STRIDE``; their responses
are max-pooled in chunks of 2 x ``HALF`` responses that overlap by half; the mean and the maximum over a
document's chunks feed one logistic unit.  As an embedding followed by a filter is a table by byte, responses
are sums of table rows.  Texts of any length are worked on in blocks.

Trained on the driver from labelled rows (chosen by a hash of doc_id) whose label is not null: about ``max_rows`` of them,
or fewer where their texts would pass ``max_bytes``.  Of several labels of one doc_id the largest holds; of repeated rows
each is learned from and scored.  An empty table gives no rows.  A null text is scored as an empty one; scores tie as they
fall, and equal texts have equal scores.  Without rows of both labels the score is the label's share, 0.5
where there is none.  Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, sampled, slices

WIDTH, STRIDE, HALF, FILTERS, EMBED = 6, 2, 128, 16, 8
SPAN = STRIDE * HALF  # bytes that a half chunk steps over
BLOCK = 1024  # half chunks worked on at a time


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded bytes of all texts, and each text's first half chunk; two at least, none shared.  The zeros before a
    text are all that the last responses of the one before reach, so that scores don't depend on neighbours."""
    raw = [b"\0" * (WIDTH - STRIDE) + (t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = [max(2, -(-(len(r) + WIDTH) // SPAN)) for r in raw]
    return np.frombuffer(b"".join(r.ljust(k * SPAN, b"\0") for r, k in zip(raw, n)) + b"\0" * WIDTH, dtype="u1"), np.cumsum([0, *n])


def _responses(data: np.ndarray, begin: int, stop: int, tables: np.ndarray) -> np.ndarray:
    """Of half chunks begin..stop: (half chunk, response, filter)."""
    out = 0
    for j in range(WIDTH):
        out = out + tables[j][data[begin * SPAN + j : stop * SPAN + j : STRIDE]]
    return out.reshape(stop - begin, HALF, -1)


class Network:
    def __init__(self, seed: int = 7, prior: float = 0.5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype("f4")
        self.filters = rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype("f4")
        self.bias = np.zeros(FILTERS, dtype="f4")
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype("f4")
        self.offset = np.zeros(1, dtype="f4")
        self.constant: float | None = None

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype("f4")

    def _halves(self, data: np.ndarray, n: int, tables: np.ndarray, places: bool = False):
        top, where = np.empty((n, FILTERS), dtype="f4"), np.empty((n, FILTERS), dtype="i4") if places else None
        for a in range(0, n, BLOCK):
            r = _responses(data, a, min(n, a + BLOCK), tables)
            top[a : a + BLOCK] = r.max(1)
            if places:
                where[a : a + BLOCK] = r.argmax(1)
        return top, where

    def _features(self, top: np.ndarray, begins: np.ndarray):
        act = np.maximum(top + self.bias, 0)
        chunk = np.maximum(act[:-1], act[1:])  # row begins[i+1]-1 pairs two documents and is left out
        chunk = np.concatenate([chunk, act[-1:]])
        real = np.ones(len(act), dtype=bool)
        real[begins[1:] - 1] = False
        n = np.diff(begins) - 1
        mean = np.add.reduceat(np.where(real[:, None], chunk, 0), begins[:-1]) / n[:, None]
        most = np.maximum.reduceat(np.where(real[:, None], chunk, 0), begins[:-1])
        return act, chunk, real, n, np.concatenate([mean, most], 1)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        data, begins = _padded(texts)
        top, _ = self._halves(data, int(begins[-1]), self._tables if hasattr(self, "_tables") else self.tables())
        x = self._features(top, begins)[-1]
        return 1 / (1 + np.exp(-np.clip((x @ self.weights + self.offset[0]).astype("f8"), -30, 30)))

    def gradients(self, texts: list[str], labels: np.ndarray):
        data, begins = _padded(texts)
        tables = self.tables()
        top, where = self._halves(data, int(begins[-1]), tables, True)
        act, chunk, real, n, x = self._features(top, begins)
        p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset[0], -30, 30)))
        d = ((p - labels) / len(labels)).astype("f4")
        doc = np.repeat(np.arange(len(n)), np.diff(begins))
        dx = d[:, None] * self.weights
        dchunk = np.where(real[:, None], (dx[:, :FILTERS] / n[:, None])[doc] + np.where(chunk == x[doc, FILTERS:], dx[doc, FILTERS:], 0), 0)
        left = np.concatenate([act[:-1] >= act[1:], np.ones((1, FILTERS), dtype=bool)])
        dact = np.where(left, dchunk, 0)
        dact[1:] += np.where(left, 0, dchunk)[:-1]
        dact = np.where(act > 0, dact, 0).astype("f4")
        h, f = np.nonzero(dact)
        at, g = h * SPAN + where[h, f] * STRIDE, dact[h, f]
        dt = np.stack([np.bincount(data[at + j].astype("i8") * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
        return [np.einsum("wbf,wef->be", dt, self.filters), np.einsum("be,wbf->wef", self.embed, dt), dact.sum(0), x.T @ d, np.array([d.sum()])], p

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        self.offset[0] = np.log(labels.mean() / (1 - labels.mean()))
        rng, m, v, t = np.random.default_rng(seed), [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            step = rate * (1 - epoch / epochs)
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                grads, _ = self.gradients([texts[i] for i in pick], labels[pick])
                t += 1
                for p, g, m_, v_ in zip(self.params(), grads, m, v):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.01 * (g * g - v_)
                    p -= (step * (m_ / (1 - 0.9**t)) / (np.sqrt(v_ / (1 - 0.99**t)) + 1e-6)).astype("f4")
        return self


def train(docs: DataFrame, labels: DataFrame, where: Column, label: str = "quality", max_rows: int = 2500, max_bytes: int = 64 << 20) -> Network:
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("__label")).where(where)
    marked = marked.groupBy("doc_id").agg(F.max("__label").alias("__label"))
    share = max_rows / max(1, marked.count())

    def drawn(share: float) -> DataFrame:
        # about max_rows ids at most, hence small enough to broadcast
        own = docs.select("doc_id", "text").join(F.broadcast(marked.where(sampled(share))), "doc_id")
        return own.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "__label")

    size = drawn(share).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = drawn(min(share, 1) * min(1, max_bytes / max(1, size))).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return Network().fit(rows.column("text").to_pylist(), rows.column("__label").to_numpy())


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        net._tables = net.tables()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.score(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labelled rows that are not held out."""
    network = train(docs, labels, ~is_held_out())
    return predict(docs, network).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
