"""Periodic run detection in the words of texts, by longest previous factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends with period q; its length is at
least max(``least``, 2 q).  Words are what stands between the bytes 0x20 and 0x09-0x0D.  Texts are read in joint arrays
of about ``PIECE`` bytes, a longer text alone; a separator behind each text occurs nowhere else, so nothing reaches beyond it.

1. Prefix doubling sorts the suffixes; the ranks of each doubling stay, and give common prefixes and suffixes of any two
   places exactly.  Common prefixes of neighbours in the suffix array are the LCP array.
2. Taking places out of the suffix array's order from the last to the first leaves the longest previous factor of each
   (Crochemore, Ilie 2008), and these cut the array into Lempel-Ziv blocks.
3. A run that touches a block's border is found by Main's extensions (1989): if the block that holds the run's last word is
   B(i), it touches the border before B(i) or behind it with a period below |B(i-1)| + |B(i)|; for each such period both
   extensions are looked up at once.
4. A run inside a block is a copy of one where the block was copied from, so starts are walked left to right and
   runs taken over from the bucket of the start they are copied from.

A null text has no words.  A null doc_id is passed on as it is.  Every row has its own result, further columns are not read by
``runs`` and ``digests`` and kept as they are by ``collapse``; one task holds one text and its ranks, about 100 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in one array.
PIECE = 1_000_000


class Ranks:
    """Ranks of all substrings of 1, 2, 4 ... words, the suffix array and its LCP array."""

    def __init__(self, ids: np.ndarray):
        """``ids``: numbers from 0 without gaps; the last one occurs once."""
        n = self.n = len(ids)
        size = np.bincount(ids)
        rank = (np.cumsum(size) - size)[ids]
        self.levels = [rank]
        active = np.flatnonzero(size[ids] > 1)
        step = 1
        while len(active):
            own, after = rank[active], rank[np.minimum(active + step, n - 1)]
            order = np.argsort(own * n + after)
            active, own, after = active[order], own[order], after[order]
            first = np.append(True, own[1:] != own[:-1])
            new = first | np.append(True, after[1:] != after[:-1])
            place = np.arange(len(active))
            begin, group = np.maximum.accumulate(np.where(new, place, 0)), np.maximum.accumulate(np.where(first, place, 0))
            rank = rank.copy()
            rank[active] = own + begin - group
            self.levels.append(rank)
            alone = new & np.append(new[1:], True)
            active = active[~alone]
            step *= 2
        self.array = np.empty(n, dtype="i8")
        self.array[rank] = np.arange(n)
        self.lcp = np.zeros(n, dtype="i8")
        self.lcp[1:] = self.forward(self.array[:-1], self.array[1:])

    def _extended(self, a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
        """Number of equal words from a and b on in one direction; a separator or an end of the array ends it."""
        out = np.zeros(len(a), dtype="i8")
        open_, tops = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n)), np.zeros(len(a), dtype="i1")
        for k, rank in enumerate(self.levels):  # the largest power of two that fits
            shift = 0 if sign > 0 else (1 << k) - 1
            x, y = a[open_] - shift, b[open_] - shift
            inside = (x >= 0) & (y >= 0)
            same = inside & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])
            open_ = open_[same]
            if not len(open_):
                break
            tops[open_] = k + 1
        at = np.flatnonzero(tops)
        out[at] = 1 << (tops[at].astype("i8") - 1)
        for k in range(int(tops.max(initial=0)) - 2, -1, -1):
            rank, shift = self.levels[k], 0 if sign > 0 else (1 << k) - 1
            sub = at[tops[at] > k + 1]
            x, y = a[sub] + sign * out[sub] - shift, b[sub] + sign * out[sub] - shift
            inside = (x >= 0) & (y >= 0) & (x < self.n) & (y < self.n)
            last = self.n - 1
            same = inside & (rank[np.clip(x, 0, last)] == rank[np.clip(y, 0, last)])
            out[sub[same]] += 1 << k
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extended(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._extended(a, b, -1)


def previous_factors(ranks: Ranks) -> tuple[list[int], list[int]]:
    """For each place the length of the longest stretch that also starts before it, and one such start."""
    n, array = ranks.n, ranks.array
    before, after, common = np.full(n + 1, n), np.full(n + 1, n), np.zeros(n + 1, dtype="i8")
    before[array[1:]], after[array[:-1]] = array[:-1], array[1:]
    common[array] = ranks.lcp
    before, after, common = before.tolist(), after.tolist(), common.tolist()  # common: with the place before
    longest, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        p, q, x = before[i], after[i], common[i]
        y = common[q]
        after[p], before[q] = q, p
        if x < y:
            common[q] = x
            longest[i], source[i] = y, q
        else:
            longest[i], source[i] = x, p
    return longest, source


def blocks(longest: list[int]) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end."""
    out, at, n = [], 0, len(longest)
    while at < n:
        out.append(at)
        at += longest[at] or 1
    out.append(n)
    return np.array(out)


def bordering(ranks: Ranks, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs that touch a border between blocks."""
    size = np.diff(starts)
    border = starts[1:-1]
    most = size[:-1] + size[1:] - 1
    at = np.repeat(border, most)
    period = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
    pair = ranks.levels[min(1, len(ranks.levels) - 1)]
    found = []
    for left in (True, False):  # the border's period lies left or right of it
        a, b = (at - period, at) if left else (at, at + period)
        ok = (a >= 0) & (b < ranks.n)
        a, b, p = a[ok], b[ok], period[ok]
        if least >= 6:  # both extensions together reach half of it, so one of them reaches two words
            near = pair[a] == pair[b]
            inside = a >= 2
            near[inside] |= pair[a[inside] - 2] == pair[b[inside] - 2]
            a, b, p = a[near], b[near], p[near]
        start, stop = a - ranks.backward(a - 1, b - 1), b + ranks.forward(a, b)
        long = stop - start >= np.maximum(least, 2 * p)
        found.append((start[long], stop[long], p[long]))
    start, stop, p = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, stop, start))
    start, stop, p = start[order], stop[order], p[order]
    new = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])) if len(start) else np.zeros(0, dtype=bool)
    return start[new], stop[new], p[new]  # of equal stretches the smallest period


def all_runs(ids: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs, in order."""
    ranks = Ranks(ids)
    longest, source = previous_factors(ranks)
    starts = blocks(longest)
    start, stop, period = bordering(ranks, starts, least)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for a, b, p in zip(start.tolist(), stop.tolist(), period.tolist()):
        buckets.setdefault(a, []).append((b, p))
    size = np.diff(starts)
    if buckets:
        for s in starts[:-1][size >= least + 2].tolist():
            e, d = s + longest[s], s - source[s]
            for a in range(s + 1, e - least):
                for b, p in buckets.get(a - d, ()):
                    if b + d < e:
                        buckets.setdefault(a, []).append((b + d, p))
    rows = sorted((a, p, b - a) for a, found in buckets.items() for b, p in found)
    a, p, n = (np.array(x, dtype="i8") for x in zip(*rows)) if rows else (np.zeros(0, dtype="i8"),) * 3
    return a, n, p


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


Words = list[bytes]


def _found(texts: list[Words], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, lengths and periods of the runs of each text."""
    numbers = _Numbers()
    counts = np.array([len(t) for t in texts])
    joined: list[bytes | None] = []
    for t in texts:
        joined += t
        joined.append(None)
    ids = np.fromiter(map(numbers.__getitem__, joined), dtype="i8", count=len(joined))
    ends = np.cumsum(counts + 1) - 1
    shared = numbers[None]
    ids[ids > shared] -= 1
    ids[ends] = len(numbers) - 1 + np.arange(len(texts))
    a, n, p = all_runs(ids, least)
    begin = ends - counts
    cuts = np.searchsorted(a, begin)
    for i, lo in enumerate(cuts.tolist()):
        hi = cuts[i + 1] if i + 1 < len(cuts) else len(a)
        yield a[lo:hi] - begin[i], n[lo:hi], p[lo:hi]


def repeated_words(count: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``count`` words a run holds behind its first period."""
    change = np.zeros(count + 1, dtype="i8")
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Place of the first and the texts of slices of about PIECE bytes."""
    begin, size, held = 0, 0, []
    for i in range(batch.num_rows):
        text = batch.column(column)[i].as_py() or b""
        if held and size + len(text) > PIECE:
            yield begin, held
            begin, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield begin, held


def _mapped(docs: DataFrame, schema: str, least: int, prepare: Callable | None, emit: Callable) -> DataFrame:
    """``emit(doc_id, words, runs)`` makes the rows of a text."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "string": pa.string()}[c.split(" ")[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, texts in _pieces(batch, 1):
                words = [t.split() for t in texts]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids[begin:], words)]
                out = [row for i, w, found in zip(ids[begin:], words, _found(words, least)) for row in emit(i, w, found)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds.types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, start, length, period: a row for each run."""

    def emit(doc_id, words, found):
        return [(doc_id, *r) for r in zip(*(x.tolist() for x in found))]

    return _mapped(docs, "doc_id long, start long, length long, period long", least, None, emit)


def _collapsed(words: Words, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    if not len(found[0]):
        return b" ".join(words)
    drop = repeated_words(len(words), *found)
    return b" ".join([w for w, d in zip(words, drop.tolist()) if not d])


def collapse(docs: DataFrame, least: int = 12) -> DataFrame:
    """The documents with each run cut down to its first period; words are joined by one blank where a text has a run, and
    texts without runs, null ones too, stay as they are.  Columns stay as they are."""
    kind, columns = docs.schema["text"], docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, part in _pieces(batch, 0):
                words = [t.split() for t in part]
                for i, (w, found) in enumerate(zip(words, _found(words, least))):
                    if len(found[0]):
                        texts[begin + i] = _collapsed(w, found)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), batch.column(1)], names=["text", "row"])

    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).alias("row")
    packed = docs.select(F.col("text").cast("binary").alias("text"), row)
    done = packed.mapInArrow(run, packed.schema)
    at = columns.index("text")
    out = [F.col("text").cast(kind.dataType).alias("text") if k == at else F.col(f"row.c{k}").alias(c) for k, c in enumerate(columns)]
    return done.select(*out)


def digests(docs: DataFrame, least: int = 12, prepare: Callable | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; null without runs), digests of all runs and of
    the collapsed words.  ``prepare(doc_id, words)`` may change a text's words before they are read."""

    def emit(doc_id, words, found):
        rows = list(zip(*(x.tolist() for x in found)))
        best = (None,) * 4
        if rows:
            a, n, p = min(rows, key=lambda r: (-r[1], r[0], r[2]))
            best = (a, n, p, 1000 * n // p)
        said = "".join(f"{a},{n},{p}\n" for a, n, p in rows).encode()
        return [(doc_id, len(rows), *best, hashlib.sha256(said).hexdigest(), hashlib.sha256(_collapsed(words, found)).hexdigest())]

    return _mapped(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", least, prepare, emit)


def planted(doc_id: int | None, words: Words) -> Words:
    """The words that the query reads: in a tenth of the documents, chosen by the id, the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * (-(-(n - a) // p)))[: n - a]
