"""Target-distribution importance resampling by hashed n-grams of words.

1. One scan of a text keeps a ring of running CRC-32 states, one for each of the last ``width`` starts; each word extends
   them by a blank and its bytes, and each state that comes up is a feature's hash; modulo ``buckets`` it is counted.
2. The counts of the corpus and of the target meet by bucket; there are ``buckets`` of them at any size, and as many gains:
   floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))).
3. A second scan adds the gains of each text up, and Gumbel noise from the id makes of the sum a score.  Rows are dealt by
   ranges of their order, so that a row's rank is its place in its range behind the sizes of the ranges before.

Words are runs of a-z, 0-9 and all characters beyond ASCII, A-Z lower-cased.  A null text has none.  A null doc_id takes part
with the noise of the text "null" in its place and is the last among equal scores; rows that agree in id and score follow each
other in any order.  An empty corpus gives an empty result, an empty target gains below those of a like one.  Further columns
are not read by ``scored`` and kept as they are by ``resample``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut

_LOWER = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def features(words: list[bytes], width: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``width`` words, by the words they end with."""
    ring: deque[int] = deque(maxlen=width)
    out: list[int] = []
    for word in words:
        if width > 1:
            tail = b" " + word
            ring = deque([crc32(tail, state) for state in ring], maxlen=width)
        ring.append(crc32(word))
        out += ring
    return np.array(out, dtype="i8") % buckets


def counts(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """bucket, n: the features of all texts; each task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype="i8")
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(words_of(text.as_py()), width, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000) -> np.ndarray:
    """What a feature of each bucket adds to a weight."""
    found = []
    for texts in (corpus, target):
        own, at = np.zeros(buckets), counts(texts, width, buckets).toArrow()
        own[at.column("bucket").to_numpy()] = at.column("n").to_numpy()
        found.append(own)
    s, t = found
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype("i8")


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the first 8 hex digits of a digest of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _weighed(docs: DataFrame, gain: np.ndarray, width: int, seed: int, row: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, and ``row`` where it is given."""
    buckets, shared, whole = len(gain), docs.sparkSession.sparkContext.broadcast(gain), row is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                own = features(words, width, buckets)
                out.append((len(words), len(own), int(shared.value[own].sum())))
            if out:
                cols = {"doc_id": batch.column(0)} | dict(zip(("n_words", "n_features", "weight"), (pa.array(c, pa.int64()) for c in zip(*out))))
                yield pa.RecordBatch.from_pydict(cols | ({"row": batch.column(2)} if whole else {}))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *([] if row is None else [row.alias("row")]))
    kept = [f for f in rows.schema if f.name != "text"]
    schema = StructType([kept[0], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight")), *kept[1:]])
    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def _order(least_words: int) -> list[Column]:
    return [(F.col("n_words") < least_words).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def _ranked(rows: DataFrame, percent: int, least_words: int) -> tuple[DataFrame, int]:
    """The rows with ``place``, 1, 2, 3 ... in the order of drawing, and how many are drawn."""
    spark, order = rows.sparkSession, _order(least_words)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_words") >= least_words, 1)).alias("able")).collect()  # a row for each range
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        before[r["range"]], total = total, total + r["n"]
    behind = spark.createDataFrame(list(before.items()) or [(0, 0)], "range int, behind long")
    place = F.row_number().over(W.partitionBy("range").orderBy(*order)) + F.col("behind")
    return placed.join(F.broadcast(behind), "range").withColumn("place", place), percent * sum(r["able"] for r in sizes) // 100


def scored(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; the rank is null where a row is not drawn.

    Drawn are ``percent`` percent, rounded down, of the rows with ``least_words`` words or more."""
    rows = cut(_weighed(docs, gains(docs, target, width, buckets), width, seed), "weighed")
    ranked, drawn = _ranked(rows, percent, least_words)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """The drawn documents, columns as they are.  Texts are not shuffled: a further scan keeps what stands up to the last one
    drawn.  Rows that agree in id and score with that one all stay."""
    gain = gains(docs, target, width, buckets)
    ranked, drawn = _ranked(cut(_weighed(docs, gain, width, seed), "weighed"), percent, least_words)
    last = ranked.where(F.col("place") == drawn).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    early = F.lit(True) if last["doc_id"] is None else F.coalesce(F.col("doc_id") <= last["doc_id"], F.lit(False))
    within = (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & early)
    kept = _weighed(docs, gain, width, seed, row).where((F.col("n_words") >= least_words) & within)
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
