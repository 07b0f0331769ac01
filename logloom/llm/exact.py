"""Exact dedup: counting quotient filters find fingerprints that occur more than once, byte comparison decides.

1. A 64-bit fingerprint of each text is counted per partition in counting quotient filters, one for each range
   of fingerprints.  The filters of a range merge without loss by walking their sorted remainders.
2. Rows whose fingerprint counts more than once are routed to verification: they are grouped by their bytes,
   with partial aggregation, so that copies within a partition travel once.
3. All rows look their group up by SHA-256; rows without one are alone.

A null text counts as empty.  A null doc_id is smaller than any other; in a group with null ids only, each row
stays.  Rows that agree in text and in the largest id are all marked kept by ``groups``; ``dedup`` keeps one of
them.  Further columns are not read by ``groups`` and kept as they are by ``dedup``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import dealt_join


class QuotientFilter:
    """Counts of 64-bit fingerprints: quotients (high bits) mark ``occupied``, the remainders of a quotient form a
    sorted run, ``ends`` marks the last slot of each run, and each slot has a counter of 1, 2, 4 or 8 bytes.

    Slots lie gapless, so the n-th occupied quotient owns the n-th run.  No fingerprint bit is lost."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int = 0, bits: int = 64):
        """``keys``: distinct, sorted, all sharing what stands above ``bits`` (given by ``low``)."""
        self.low, self.bits, n = low, bits, len(keys)
        self.q = max(1, int(np.ceil(np.log2(max(2, n)))))
        self.q = min(self.q, bits)
        self.r = bits - self.q
        own = keys - np.uint64(low)
        quotient = (own >> np.uint64(self.r)).astype("i8") if self.r < 64 else np.zeros(n, dtype="i8")
        self.remainders = own & np.uint64((1 << self.r) - 1)
        occupied = np.zeros(1 << self.q, dtype=bool)
        occupied[quotient] = True
        ends = np.ones(n, dtype=bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        self.occupied, self.ends, self.counts = np.packbits(occupied), np.packbits(ends), counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, low: int = 0, bits: int = 64) -> QuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True), low, bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        n = len(self.remainders)
        ends = np.unpackbits(self.ends, count=n).astype(bool)
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q))[run]
        return (quotient.astype("u8") << np.uint64(self.r) | self.remainders) + np.uint64(self.low), self.counts

    def count(self, fingerprint: int) -> int:
        own = fingerprint - self.low
        if not 0 <= own < 1 << self.bits:
            return 0
        quotient = own >> self.r
        occupied = np.unpackbits(self.occupied, count=1 << self.q)
        if not occupied[quotient]:
            return 0
        rank = int(occupied[:quotient].sum())
        ends = np.flatnonzero(np.unpackbits(self.ends, count=len(self.remainders)))
        begin, stop = (int(ends[rank - 1]) + 1 if rank else 0), int(ends[rank]) + 1
        at = begin + int(np.searchsorted(self.remainders[begin:stop], np.uint64(own & (1 << self.r) - 1)))
        return int(self.counts[at]) if at < stop and int(self.remainders[at]) == own & (1 << self.r) - 1 else 0

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """All of one range, two by two; counts add up.  Remainders lie in order of their quotients, so each filter is a
        sorted run, and where the items of one run fall in the other is their place in the merged one."""
        runs = [f.items() for f in filters]
        while len(runs) > 1:
            runs = [cls._merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return cls(*runs[0], filters[0].low, filters[0].bits)

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own, other = np.searchsorted(b[0], a[0], "left"), np.searchsorted(a[0], b[0], "left")
        shared = np.zeros(len(b[0]), dtype=bool)
        if len(a[0]):
            shared = a[0][np.minimum(other, len(a[0]) - 1)] == b[0]
        skipped = np.cumsum(shared) - shared  # items of b that a has as well, before each
        at = np.arange(len(a[0])) + own - (np.append(0, np.cumsum(shared))[own])
        to = np.where(shared, 0, np.arange(len(b[0])) - skipped + other)
        keys = np.empty(len(a[0]) + int((~shared).sum()), dtype="u8")
        counts = np.zeros(len(keys), dtype="u8")
        keys[at], counts[at] = a[0], a[1]
        keys[to[~shared]], counts[to[~shared]] = b[0][~shared], b[1][~shared]
        counts[at[other[shared]]] += b[1][shared].astype("u8")
        return keys, counts

    def to_bytes(self) -> bytes:
        wide = -(-self.r // 8)
        most = int(self.counts.max()) if len(self.counts) else 0
        kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)
        rest = self.remainders.astype("<u8").view("u1").reshape(-1, 8)[:, :wide].tobytes()
        return struct.pack("<QBBBI", self.low, self.bits, self.q, np.dtype(kind).itemsize, len(self.remainders)) + self.occupied.tobytes() + self.ends.tobytes() + rest + self.counts.astype(kind).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        self = cls.__new__(cls)
        self.low, self.bits, self.q, size, n = struct.unpack_from("<QBBBI", data)
        self.r = self.bits - self.q
        at, wide = struct.calcsize("<QBBBI"), -(-self.r // 8)
        parts = []
        for length in (-(-(1 << self.q) // 8), -(-n // 8), n * wide, n * size):
            parts.append(np.frombuffer(data, dtype="u1", count=length, offset=at))
            at += length
        self.occupied, self.ends = parts[0], parts[1]
        full = np.zeros((n, 8), dtype="u1")
        full[:, :wide] = parts[2].reshape(n, wide)
        self.remainders = full.reshape(-1).view("<u8")
        self.counts = parts[3].view(f"<u{size}")
        return self


#: Rows that a range of fingerprints holds on the mean: about 40 MB of filters.
RANGE = 4_000_000


def repeated(fingerprints: DataFrame, column: str, ranges: int | None = None) -> DataFrame:
    """The values of a long column that occur more than once.  There are as many ranges as shuffle partitions, or more
    where the rows ask for it, so that a task's filters stay small at any size."""
    spark = fingerprints.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fingerprints.count() // RANGE))
    power = max(1, (n - 1).bit_length())
    bits = 64 - power

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view("u8"))
            if sum(map(len, held)) >= 4_000_000:
                yield from emit(np.concatenate(held))
                held = []
        if held:
            yield from emit(np.concatenate(held))

    def emit(values: np.ndarray):
        keys, counts = np.unique(values, return_counts=True)
        part = (keys >> np.uint64(bits)).astype("i8")
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        stops = [*at[1:], len(keys)]
        blobs = [QuotientFilter(keys[a:b], counts[a:b], int(part[a]) << bits, bits).to_bytes() for a, b in zip(at, stops)]
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(blobs, pa.binary())], names=["part", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out():
            keys, counts = QuotientFilter.merge(held).items()
            return pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].view("i8"))], names=[column])

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and p != part:
                    yield out()
                    held = []
                part = p
                held.append(QuotientFilter.from_bytes(blob))
                if len(held) >= 64:
                    held = [QuotientFilter.merge(held)]
        if held:
            yield out()

    blobs = fingerprints.select(column).mapInArrow(build, "part long, filter binary")
    return blobs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, f"{column} long")


#: Rows of one text are dealt to so many tasks by their id.
SALTS = 16


def _classes(docs: DataFrame, text: Column) -> DataFrame:
    """Groups of equal texts with more than one row: __sha, __keep, __n."""
    rows = docs.select("doc_id", text.alias("__text")).select("doc_id", "__text", F.xxhash64("__text").alias("__fp"))
    twice = repeated(rows, "__fp")
    routed = dealt_join(rows, twice, "__fp", "doc_id", "left_semi", SALTS)  # each of a hot text's tasks sends one row on
    same = routed.groupBy("__text").agg(F.max("doc_id").alias("__keep"), F.count("*").alias("__n")).where("__n > 1")
    return same.select(F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("__sha"), "__keep", "__n")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("__sha"))
    found = dealt_join(rows, _classes(docs, text), "__sha", "doc_id", "left", SALTS)
    return found.select(
        "doc_id",
        F.when(F.col("__n").isNull(), F.col("doc_id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__n").isNull() | F.col("doc_id").eqNullSafe(F.col("__keep"))).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id; columns stay as they are, whatever their names.

    Rows meet their group by (text, salt of the id), so that a large group is spread; rows that agree in both text
    and id share the salt, and one of them is taken without a further shuffle."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("__sha"), F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int").alias("__salt"), row)
    found = _classes(docs.select("doc_id", "text"), text).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = rows.join(found, ["__sha", "__salt"], "left").where(F.col("__n").isNull() | F.col("doc_id").eqNullSafe(F.col("__keep")))
    at = F.when(F.col("__n").isNull(), 1).otherwise(F.row_number().over(W.partitionBy("__sha", "__salt").orderBy("doc_id")))
    return kept.withColumn("__at", at).where("__at = 1").select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
