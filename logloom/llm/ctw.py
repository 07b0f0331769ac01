"""LM scoring by context-tree weighting over bytes.

A text is coded as its words (what stands between the bytes 0x20 and 0x09-0x0D, A-Z lower-cased), each with a blank behind
it, and a line end.  A byte is eight binary decisions; each has one estimate for each number of bytes before it, 0 to
``DEPTH``, by Krichevsky and Trofimov from the counts of the training texts.  A node of the context tree weighs its own estimate
against its children's by how well either codes the training texts (Willems, Shtarkov, Tjalkens 1995), and the mixture of all
depths gives a decision's probability.  Contexts that training never saw add nothing: the mixture ends at the deepest one it saw.

The counts follow from the numbers of the (DEPTH + 1)-grams, so nothing else is gathered; none of it is bounded, and all of
it is spread:

1. Documents are dealt to chunks of about ``CHUNK`` bytes.  Each gives out its distinct grams with their numbers in training
   texts, and its distinct words, packed by bucket; a bucket holds whole subtrees below the last ``ROOT`` bytes.
2. A bucket adds its grams up over all chunks and grows its subtrees.  What stands above them is at most 255 decisions for each
   of the 65,536 contexts of two bytes; that much goes through the driver.
3. A bucket answers each chunk with the probabilities of the chunk's own grams and the counts of its words; a chunk adds
   up its documents.

The base beside it is a unigram model of words with the end as one more: log10((c + 0.1) / (N + 0.1 (V + 1))).  Words
are counted by 64-bit hashes: of a million distinct words two share one with a chance of 3e-8.

A null text is empty: it has one token, the end.  A null doc_id is not held out.  Each row is scored by itself, rows that
repeat count as often as they are there; without training texts every decision has the probability 1/2.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, free

DEPTH, ROOT = 5, 3
#: Bytes of text in a chunk, and of text that is sorted at once.
CHUNK, PIECE = 8_000_000, 500_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_8 = np.uint64(8)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def coded(words: list[bytes]) -> bytes:
    """The bytes whose probability is the text's."""
    return b" ".join([*words, b"\n"])


# -- grams and estimates


def grams(texts: list[bytes]) -> np.ndarray:
    """A gram for each byte of the texts: the bytes before it, the last one first, then the byte itself; a text begins
    behind line ends."""
    data = np.frombuffer(b"\n" * DEPTH + b"".join(t + b"\n" * DEPTH for t in texts), dtype="u1")
    n = len(data) - DEPTH
    key = data[DEPTH - 1 : DEPTH - 1 + n].astype("u8")
    for j in range(2, DEPTH + 1):
        key <<= _8
        key |= data[DEPTH - j : DEPTH - j + n]
    key <<= _8
    key |= data[DEPTH:]
    use = np.ones(n, dtype=bool)
    ends = np.cumsum([len(t) + DEPTH for t in texts])
    for j in range(1, DEPTH + 1):
        use[ends - j] = False
    return key[use]


def _half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2)."""
    x = n + 0.5
    return np.where(n < len(_HALF), _HALF[np.minimum(n, len(_HALF) - 1).astype("i8")], _stirling(np.maximum(x, 8)))


def _whole(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1)."""
    return np.where(n < len(_WHOLE), _WHOLE[np.minimum(n, len(_WHOLE) - 1).astype("i8")], _stirling(np.maximum(n + 1, 8)))


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


_HALF = np.array([math.lgamma(i + 0.5) for i in range(1024)])
_WHOLE = np.array([math.lgamma(i + 1) for i in range(1024)])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the probability that the estimator gives to n0 zeros and n1 ones in any one order."""
    return _half(n0) + _half(n1) - _whole(n0 + n1) - math.log(math.pi)


class _Level:
    """The decisions of one depth: ``key`` is the context above 8 bits of decision; counts, own and weighted logs."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.total = key, n0 + n1
        own = log_kt(n0, n1)
        self.one = (n1 + 0.5) / (self.total + 1)
        if below is None:
            self.log, self.weight = own, np.ones(len(own))
        else:
            both = np.logaddexp(own, below)
            self.log, self.weight = both - math.log(2), np.exp(own - both)


def _counted(gram: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, zeros and ones of all decisions of one depth, from sorted grams that end in the coded byte."""
    context, byte = gram >> _8 >> np.uint64(8 * (DEPTH - depth)), (gram & np.uint64(255)).astype("i8")
    keys, zeros, ones = [], [], []
    for j in range(8):
        key = context << _8 | ((256 | byte) >> (8 - j)).astype("u8")
        at, place = np.unique(key, return_inverse=True)
        bit = byte >> (7 - j) & 1
        keys.append(at)
        ones.append(np.bincount(place, weights=n * bit, minlength=len(at)))
        zeros.append(np.bincount(place, weights=n * (1 - bit), minlength=len(at)))
    keys, zeros, ones = (np.concatenate(x) for x in (keys, zeros, ones))
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def _upper(key: np.ndarray) -> np.ndarray:
    """The same decision in a context that is shorter by the farthest byte."""
    return key >> np.uint64(16) << _8 | key & np.uint64(255)


def subtrees(gram: np.ndarray, n: np.ndarray) -> dict[int, _Level]:
    """Levels DEPTH to ROOT of grams with their numbers, all of them above 0."""
    levels: dict[int, _Level] = {}
    for depth in range(DEPTH, ROOT - 1, -1):
        key, n0, n1 = _counted(gram, n, depth)
        below = None
        if depth < DEPTH:
            child = levels[depth + 1]
            below = np.bincount(np.searchsorted(key, _upper(child.key)), weights=child.log, minlength=len(key))
        levels[depth] = _Level(key, n0, n1, below)
    return levels


def crown(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> dict[str, np.ndarray]:
    """What stands above the subtrees, from the sums of depth ROOT - 1 and of the logs below it.

    ``key{d}`` and ``end{d}``: the probability of a one where the path ends at depth d; ``base`` and ``rest`` at depth
    ROOT - 1: it is base + rest * (that of the subtree) where the path goes on."""
    levels: dict[int, _Level] = {}
    for depth in range(ROOT - 1, -1, -1):
        levels[depth] = level = _Level(key, n0, n1, below)
        up = _upper(key)
        key, place = np.unique(up, return_inverse=True)
        n0, n1, below = (np.bincount(place, weights=w, minlength=len(key)) for w in (n0, n1, level.log))
    out: dict[str, np.ndarray] = {}
    base, rest = np.zeros(len(levels[0].key)), np.ones(len(levels[0].key))
    for depth in range(ROOT):
        level = levels[depth]
        if depth:
            place = np.searchsorted(levels[depth - 1].key, _upper(level.key))
            base, rest = base[place], rest[place]
        out |= {f"key{depth}": level.key, f"end{depth}": base + rest * level.one}
        base, rest = base + rest * level.weight * level.one, rest * (1 - level.weight)
    return out | {"base": base, "rest": rest}


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype="i8"), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def probabilities(gram: np.ndarray, n: np.ndarray, top: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each gram's last byte behind the others."""
    seen = n > 0
    levels = subtrees(gram[seen], n[seen])
    byte = (gram & np.uint64(255)).astype("i8")
    out = np.zeros(len(gram))
    for j in range(8):
        decision = ((256 | byte) >> (8 - j)).astype("u8")
        one = np.full(len(gram), 0.5)
        for depth in range(ROOT):
            at, there = _found(top[f"key{depth}"], gram >> _8 >> np.uint64(8 * (DEPTH - depth)) << _8 | decision)
            one[there] = top[f"end{depth}"][at[there]]
        sub, on = np.zeros(len(gram)), np.zeros(len(gram), dtype=bool)
        for depth in range(DEPTH, ROOT - 1, -1):
            level = levels[depth]
            at, there = _found(level.key, gram >> _8 >> np.uint64(8 * (DEPTH - depth)) << _8 | decision)
            own, weight = level.one[at[there]], np.where(on[there], level.weight[at[there]], 1)
            sub[there] = weight * own + (1 - weight) * sub[there]
            on |= there
        at, _ = _found(top[f"key{ROOT - 1}"], gram >> _8 >> np.uint64(8 * (DEPTH - ROOT + 1)) << _8 | decision)
        one[on] = top["base"][at[on]] + top["rest"][at[on]] * sub[on]
        out += np.log10(np.where(byte >> (7 - j) & 1, one, 1 - one))
    return out


# -- what chunks and buckets send each other


def _pack(values: np.ndarray, steps: bool = False) -> bytes:
    """Numbers as planes of bytes, which compress well; ``steps``: sorted ones as differences."""
    values = values.astype("u8")
    if steps and len(values):
        values = np.append(values[:1], np.diff(values))
    return values.view("u1").reshape(-1, 8).T.tobytes()


def _unpack(data: bytes, steps: bool = False) -> np.ndarray:
    values = np.ascontiguousarray(np.frombuffer(data, dtype="u1").reshape(8, -1).T).reshape(-1).view("u8")
    return np.cumsum(values, dtype="u8") if steps else values


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    if not keys:
        return np.zeros(0, dtype="u8"), np.zeros(0, dtype="i8")
    both = np.concatenate(keys)
    order = np.argsort(both)
    both, numbers = both[order], np.concatenate(n)[order].astype("i8")
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, dtype="i8")
    return both[first], np.add.reduceat(numbers, first) if len(first) else numbers


def _bucket(keys: np.ndarray, shift: int, buckets: int) -> np.ndarray:
    mixed = (keys >> np.uint64(shift)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype("i8")


def _parts(keys: np.ndarray, shift: int, buckets: int) -> list[np.ndarray]:
    """For each bucket the places of its keys, in order."""
    own = _bucket(keys, shift, buckets)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, buckets)))


#: A subtree's bytes stand above this bit of a gram, and a word's hash is dealt by its high bits.
_SUBTREE, _HASH = 8 * (DEPTH - ROOT + 1), 16


class _Words(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype="i8", count=len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), dtype="u8", count=len(self))


class _Chunk:
    """Distinct grams and words of a chunk with their numbers in training texts."""

    def __init__(self):
        self.waiting: dict[bool, list[bytes]] = {False: [], True: []}
        self.size = {False: 0, True: 0}
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.words, self.counts = _Words(), np.zeros(0, dtype="i8")

    def add(self, text: bytes | None, train: bool) -> None:
        words = words_of(text)
        own = self.words.numbers(words)
        if len(self.words) > len(self.counts):
            self.counts = np.append(self.counts, np.zeros(max(1024, 2 * len(self.words) - len(self.counts)), dtype="i8"))
        if train:
            np.add.at(self.counts, own, 1)
        text = coded(words)
        self.waiting[train].append(text)
        self.size[train] += len(text)
        if self.size[train] >= PIECE:
            self.flush(train)

    def flush(self, train: bool) -> None:
        if not self.waiting[train]:
            return
        key, n = np.unique(grams(self.waiting[train]), return_counts=True)
        self.waiting[train], self.size[train] = [], 0
        self.grams.append((key, n if train else np.zeros(len(n), dtype="i8")))
        self.held += len(key)
        if self.held > 1_500_000:
            self.grams = [_added(*zip(*self.grams))]
            self.held = 0

    def rows(self, chunk: int, buckets: int) -> Iterator[dict]:
        self.flush(False)
        self.flush(True)
        key, n = _added(*zip(*self.grams)) if self.grams else _added([], [])
        word, m = _added([self.words.hashes()], [self.counts[: len(self.words)]])
        for b, (g, w) in enumerate(zip(_parts(key, _SUBTREE, buckets), _parts(word, _HASH, buckets))):
            if len(g) or len(w):
                yield {"bucket": b, "chunk": chunk, "grams": _pack(key[g], True), "n": _pack(n[g]), "words": _pack(word[w], True), "m": _pack(m[w])}


_ASKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("grams", pa.binary()), ("n", pa.binary()), ("words", pa.binary()), ("m", pa.binary())])
_ASKED_SQL = "bucket int, chunk int, grams binary, n binary, words binary, m binary"


def _asked(rows: DataFrame, buckets: int) -> DataFrame:
    """Step 1: what each chunk asks each bucket for; the rows of a chunk (chunk, text, train) lie in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, _Chunk] = {}
        for batch in batches:
            for chunk, text, train in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                chunks.setdefault(chunk, _Chunk()).add(text.as_py(), train)
        for chunk in list(chunks):
            out = []
            for row in chunks.pop(chunk).rows(chunk, buckets):
                out.append(row)
                if len(out) >= 64:
                    yield pa.RecordBatch.from_pylist(out, _ASKED)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _ASKED)

    return rows.select("chunk", "text", "train").mapInArrow(run, _ASKED_SQL)


def _added_up(asked: DataFrame, buckets: int) -> DataFrame:
    """Step 2: all grams and words that a bucket is asked for, with their numbers in all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            held: dict[str, list] = {"grams": [], "n": [], "words": [], "m": []}
            for row in rows:
                for name, key in (("n", "grams"), ("m", "words")):
                    held[key].append(_unpack(row[key], True))
                    held[name].append(_unpack(row[name]))
                    if sum(map(len, held[key][1:])) > max(500_000, len(held[key][0])):
                        one = _added(held[key], held[name])
                        held[key], held[name] = [one[0]], [one[1]]
            key, n = _added(held["grams"], held["n"])
            word, m = _added(held["words"], held["m"])
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "chunk": -1, "grams": _pack(key, True), "n": _pack(n), "words": _pack(word, True), "m": _pack(m)}], _ASKED)

    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ASKED_SQL)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Runs of rows of one bucket, row by row."""
    from itertools import groupby

    def each():
        for batch in batches:
            for i in range(batch.num_rows):
                yield {k: batch.column(k)[i].as_py() for k in ("bucket", "chunk", "grams", "n", "words", "m")}

    yield from groupby(each(), lambda r: r["bucket"])


def _crown_of(model: DataFrame) -> dict[str, np.ndarray]:
    """The sums of depth ROOT - 1 over all buckets: at most 255 rows for each of 65,536 contexts, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams_, n in zip(batch.column("grams"), batch.column("n")):
                level, up = _subtree_sums(_unpack(grams_.as_py(), True), _unpack(n.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(up.astype("i8")), *map(pa.array, level)], names=["key", "n0", "n1", "below"])

    sums = model.select("grams", "n").mapInArrow(run, "key long, n0 double, n1 double, below double")
    found = sums.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")).toArrow()
    key, n0, n1, below = (found.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
    order = np.argsort(key)
    return crown(key[order].astype("u8"), n0[order], n1[order], below[order])


def _subtree_sums(gram: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    level = subtrees(gram[n > 0], n[n > 0])[ROOT]
    ones = np.rint(level.one * (level.total + 1) - 0.5)
    up, place = np.unique(_upper(level.key), return_inverse=True)
    return tuple(np.bincount(place, weights=w, minlength=len(up)) for w in (level.total - ones, ones, level.log)), up


def _answered(model: DataFrame, asked: DataFrame, buckets: int, top) -> DataFrame:
    """Step 3: chunk, bucket, the log10 probabilities of the chunk's grams and the counts of its words, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            key = word = np.zeros(0, dtype="u8")
            n = m = np.zeros(0, dtype="i8")
            for row in rows:
                if row["chunk"] < 0:  # the model's row comes first
                    key, n, word, m = _unpack(row["grams"], True), _unpack(row["n"]).astype("i8"), _unpack(row["words"], True), _unpack(row["m"]).astype("i8")
                    known = np.float32(probabilities(key, n, top.value)) if len(key) else np.zeros(0, dtype="f4")
                    continue
                own, words = _unpack(row["grams"], True), _unpack(row["words"], True)
                at, there = _found(key, own)
                if not there.all():
                    raise RuntimeError("a chunk asks for what it has not named")
                counts = m[np.searchsorted(word, words)]
                yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "bucket": bucket, "log": known[at].tobytes(), "count": _pack(counts)}], schema)

    schema = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("log", pa.binary()), ("count", pa.binary())])
    rows = model.unionByName(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return rows.mapInArrow(run, "chunk int, bucket int, log binary, count binary")


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _scored(rows: DataFrame, answers: DataFrame, buckets: int, tokens: int, distinct: int, ends: int) -> DataFrame:
    """The documents of each chunk, by its answers."""
    below = math.log10(tokens + 0.1 * (distinct + 1))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        words, pieces, each = _Words(), [], []
        waiting: list[bytes] = []

        def flush():
            if waiting:
                pieces.append((*np.unique(grams(waiting), return_inverse=True), [len(t) for t in waiting]))
                waiting.clear()

        size = 0
        for text in docs.column("text"):
            own = words_of(text.as_py())
            each.append(words.numbers(own).astype("i4"))
            waiting.append(coded(own))
            size += len(waiting[-1])
            if size >= PIECE:
                flush()
                size = 0
        flush()
        key = np.unique(np.concatenate([p[0] for p in pieces]))
        hashes, place = np.unique(words.hashes(), return_inverse=True)
        log, count = np.zeros(len(key), dtype="f4"), np.zeros(len(hashes), dtype="i8")
        of_grams, of_words = _parts(key, _SUBTREE, buckets), _parts(hashes, _HASH, buckets)
        for bucket, logs, counts in zip(found.column("bucket").to_pylist(), found.column("log"), found.column("count")):
            log[of_grams[bucket]] = np.frombuffer(logs.as_py(), dtype="f4")
            count[of_words[bucket]] = _unpack(counts.as_py()).astype("i8")
        score, n_bytes = [], []
        for own, inverse, lengths in pieces:
            starts = np.cumsum([0, *lengths[:-1]])
            score.append(np.add.reduceat(log[np.searchsorted(key, own)].astype("f8")[inverse], starts))
            n_bytes += lengths
        count = count[place]
        base = np.log10(count + 0.1) - below
        last = math.log10(ends + 0.1) - below
        return pa.Table.from_arrays(
            [
                docs.column("doc_id").combine_chunks(),
                pa.array([not t for t in docs.column("train").to_pylist()]),
                pa.array([len(w) + 1 for w in each], pa.int64()),
                pa.array([int((count[w] > 0).sum()) + (ends > 0) for w in each], pa.int64()),
                pa.array([tokens] * len(each), pa.int64()),
                pa.array([float(base[w].sum()) + last for w in each]),
                pa.array(np.concatenate(score)),
                pa.array(n_bytes, pa.int64()),
            ],
            schema=schema,
        )

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _SCORED)


def score(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    ``held_out``: a column that is true for rows that are not learnt from; all others are."""
    spark = docs.sparkSession
    train = F.lit(True) if held_out is None else ~F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), train.alias("train"))
    total = rows.agg(F.sum(F.length("text") + 1).alias("bytes"), F.count(F.when(F.col("train"), 1)).alias("ends")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // CHUNK))
    buckets = min(n, 1024)
    # as Spark deals rows out by a hash of this column, the rows of a chunk lie in one partition
    rows = rows.withColumn("at", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod(F.hash("at"), F.lit(n)).cast("int"))
    asked = cut(_asked(rows.repartition(n, "at"), buckets), "asked")
    model = cut(_added_up(asked, buckets), "model")
    top = spark.sparkContext.broadcast(_crown_of(model))
    sums = model.select("m").mapInArrow(_totals, "tokens long, distinct long").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = (sums[0] or 0) + total["ends"], (sums[1] or 0) + (total["ends"] > 0)
    answers = cut(_answered(model, asked, buckets, top), "answers")
    free(asked, model)
    found = _scored(rows.drop("at"), answers, buckets, tokens, distinct, total["ends"])
    return found.withColumn("bits_per_byte", -F.col("score") / math.log10(2) / F.col("n_bytes"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.column(0):
            numbers = _unpack(m.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([int(numbers.sum())]), pa.array([int((numbers > 0).sum())])], names=["tokens", "distinct"])


def is_tenth(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 10; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))
