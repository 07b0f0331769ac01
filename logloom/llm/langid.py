"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered on the executors from a sample of labelled rows of about ``max_rows`` rows, summed by
Spark, and turned into one matrix of log probabilities (languages x buckets), which is broadcast: its size is
bounded by ``max_langs`` x ``BUCKETS`` floats.  Every text is scored whole: a batch's n-grams are a sparse matrix, whose
product with the log probabilities gives all of its scores.

A null text, or one without a letter, gets ``und`` and score 0; so does every text where nothing could be
learned (an empty table).  Other columns are not read.  Score is the largest posterior probability; of languages that tie,
the first in order of text.  Repeated rows count and are scored each; rows with a null doc_id share one draw of the sample.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, sampled

BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 15)
#: Code points of a text that are hashed at a time.
BLOCK = 1 << 17


def has_letter(text: str) -> bool:
    return any(c.isalpha() and unicodedata.category(c)[0] == "L" for c in text)


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams stand in the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    total = np.zeros(BUCKETS, dtype="i8")
    for begin in range(0, len(codes), BLOCK):
        part = codes[begin : begin + BLOCK + max(ORDERS) - 1].astype("u8")
        for n in ORDERS:
            stop = min(len(part) - n + 1, BLOCK)
            if stop <= 0:
                continue
            key = np.full(stop, n, dtype="u8")
            for j in range(n):
                key = key << np.uint64(21) ^ part[j : j + stop]
            total += np.bincount((key * _MIX >> _SHIFT).astype("i8"), minlength=BUCKETS)
    return total


def train(docs: DataFrame, where: Column, max_rows: int = 20_000, max_langs: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (bucket columns, then the prior) from rows with text and lang that meet
    ``where``: all of them, or about ``max_rows`` chosen by a hash of doc_id."""
    rows = docs.where(where & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = rows.where(sampled(max_rows / max(1, rows.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out():
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                total = held.setdefault(lang, np.zeros(BUCKETS + 1, dtype="i8"))
                total[:BUCKETS] += counts(text)
                total[BUCKETS] += 1  # the last bucket counts documents
                if len(held) > 100:
                    yield from out()
        yield from out()

    got = rows.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    where_ = {lang: i for i, lang in enumerate(langs)}
    n = np.zeros((len(langs), BUCKETS + 1))
    n[[where_[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    model = np.empty_like(n, dtype="f4")
    model[:, :BUCKETS] = np.log((n[:, :BUCKETS] + SMOOTHING) / (n[:, :BUCKETS].sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    model[:, BUCKETS] = np.log(n[:, BUCKETS] / max(1.0, n[:, BUCKETS].sum()))
    return langs, model


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The batch as a sparse matrix in rows of texts, part by part: (bucket of each n-gram, its text), texts in order."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 4 for r in raw])
    codes, ends = np.frombuffer(b"".join(raw), dtype="<u4"), np.cumsum(size)
    for begin in range(0, len(codes), BLOCK):
        stop = min(begin + BLOCK, len(codes))
        part = codes[begin : stop + max(ORDERS) - 1].astype("u8")
        at = np.arange(begin, stop)
        owner = np.searchsorted(ends, at, "right")
        for n in ORDERS:
            fit = np.flatnonzero(at + n <= ends[owner])
            key = np.full(len(fit), n, dtype="u8")
            for j in range(n):
                key = key << np.uint64(21) ^ part[fit + j]
            yield (key * _MIX >> _SHIFT).astype("i8"), owner[fit]


def score(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text: the batch's sparse count matrix times the log probabilities, in doubles.

    Of languages with one posterior the first in order of text is taken."""
    found, best = ["und"] * len(texts), np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if langs and t and has_letter(t)]
    if not use:
        return found, best
    columns = np.ascontiguousarray(model[:, :BUCKETS].T, dtype="f8")
    logs = np.repeat(model[:, BUCKETS].astype("f8")[None], len(use), 0)
    step = max(1, (1 << 22) // len(langs))
    for bucket, owner in grams([texts[i] for i in use]):
        for a in range(0, len(bucket), step):
            own = owner[a : a + step]
            rows = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            logs[own[rows]] += np.add.reduceat(columns[bucket[a : a + step]], rows, axis=0)
    top = logs.argmax(1)
    best[use] = 1 / np.exp(logs - logs[np.arange(len(use)), top][:, None]).sum(1)
    for i, k in zip(use, top.tolist()):
        found[i] = langs[k]
    return found, best


def predict(docs: DataFrame, trained: tuple[list[str], np.ndarray], keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row, and the two ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    keep = keep or ["doc_id"]
    return _scored(docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep]), shared, names, False)


def _scored(rows: DataFrame, shared, names: tuple[str, str], whole: bool) -> DataFrame:
    """``rows`` with the two ``names``: of their first column, a text that goes, or if ``whole`` a row with a text that stays."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[not whole :]) + f", {names[0]} string, {names[1]} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        for batch in batches:
            texts, found, best = (pc.struct_field(batch.column(0), "text") if whole else batch.column(0)).to_pylist(), [], []
            begin, size = 0, 0
            for i, t in enumerate(texts, 1):
                size += len(t or "")
                if size >= BLOCK or i == len(texts):
                    own = score(texts[begin:i], langs, model)
                    found += own[0]
                    best.append(own[1])
                    begin, size = i, 0
            if best:
                yield pa.RecordBatch.from_arrays([*batch.columns[not whole :], pa.array(found, pa.string()), pa.array(np.concatenate(best))], names=[*batch.schema.names[not whole :], *names])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    trained = train(docs, ~is_held_out())
    return predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), trained).withColumn("held_out", is_held_out()).select("doc_id", "held_out", "lang_pred", "score")


def filter_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Keeps documents whose language is found with at least that score; columns stay as they are, whatever their names."""
    trained = train(docs, F.lit(True))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = _scored(row, docs.sparkSession.sparkContext.broadcast(trained), ("__lang", "__score"), True).where((F.col("__lang") != "und") & (F.col("__score") >= least))
    return found.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
