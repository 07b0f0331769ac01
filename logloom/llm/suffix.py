"""Suffix-array dedup: bytes covered by strings of ``length`` bytes that start anywhere else as well.

Texts are UTF-8 bytes; matches never cross documents.  A string that repeats decides all that is derived from
its bytes alone, so equal strings can be brought together by such a value without comparing all texts:

1. Of each window of ``length`` bytes, the 64-byte string with the smallest hash (the leftmost of equals) is its
   anchor.  Windows that share an anchor position form a run; anchors whose bytes occur once are done with.
2. Runs of the other anchors become contexts (the bytes that the run's windows cover).  Equal contexts are one,
   with a count, collapsed before the shuffle.
3. Contexts of an anchor are one group.  Windows that are equal hold their anchor at the same place, so suffixes are
   compared only with those that begin as many bytes before the anchor.  The enhanced suffix array of such an offset
   (order and common prefixes) follows from that of the offset before: a stable sort by the byte that is added.
4. In each offset's array a stack scan finds the common-prefix intervals of ``length`` or more.  One whose suffixes do
   not all continue one left byte is a maximal repeat within the contexts, with all of its occurrences; these cover what
   is to be removed, and ``repeat_groups`` gives them out.
5. Spans go back to the documents by context, and runs of covered bytes are united.

One array holds ``GROUP`` different contexts at most.  A larger group is split: its runs are cut where further anchors
in the windows' first and last thirds change, and those belong to the key; what is still larger, by those in the
first and last ninths; of what is larger even then, each window is counted by its digest, with partial sums.

``dedup_passages`` removes strings of so many words as well.  A text's words (between blanks of ASCII) become codes of
``CODE`` bytes, and repeats are looked for in these as above.  A string of ``length`` bytes that holds as many words is
among them; so bytes are compared only of texts with a window of ``length`` bytes that may hold fewer.

Null texts are empty; texts shorter than ``length`` have nothing to remove.  Documents are told apart by doc_id
and the text's hash, so repeated rows are two documents with one text.  A null doc_id is a value like others.  Further columns are
not read by ``digests`` and kept as they are by ``dedup``, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt_join, free, slices

LENGTH, ANCHOR, SUB = 400, 64, 32
#: Different contexts in one suffix array, at most: 24 MB of bytes.
GROUP = 1 << 15
#: Times that larger groups are split by further anchors, before their windows are counted one by one.
LEVELS = 2
#: Bytes that stand for a word: passages that differ in one word only are taken as equal with a chance of 2^-32.
CODE = 4
#: Bytes of contexts that are worked on together, unless one group is larger.
BATCH = 1 << 22
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(51).integers(0, 1 << 64, 256, dtype="u8")
_INVERSE = np.uint64(pow(int(_MUL), -1, 1 << 64))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-byte strings (n a power of two), by doubling."""
    h = (data.astype("u8") + np.uint64(1)) * _MUL
    size = 1
    while size < n:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[size:] * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        size *= 2
    return h * _MUL


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest (leftmost of equals) of each w neighbours."""
    n = len(h) - w + 1
    blocks = -(-len(h) // w)
    full = np.full(blocks * w, np.iinfo("u8").max, dtype="u8")
    full[: len(h)] = h
    grid, place = full.reshape(blocks, w), np.arange(blocks * w).reshape(blocks, w)
    low = np.minimum.accumulate(grid, 1)
    new = np.ones_like(grid, dtype=bool)
    new[:, 1:] = grid[:, 1:] < low[:, :-1]
    before = np.maximum.accumulate(np.where(new, place, 0), 1).reshape(-1)
    back = grid[:, ::-1]
    low_back = np.minimum.accumulate(back, 1)
    new = np.ones_like(grid, dtype=bool)
    new[:, 1:] = back[:, 1:] <= low_back[:, :-1]
    after = np.minimum.accumulate(np.where(new, place[:, ::-1], blocks * w), 1)[:, ::-1].reshape(-1)
    a, b = after[:n], before[w - 1 : w - 1 + n]
    return np.where(full[a] <= full[b], a, b)


#: Window starts of one text that are worked on at a time.
STRETCH = 1 << 18


def runs(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of the anchor, first window, last window) of the runs of windows that share an anchor position."""
    keys, places, firsts, lasts = [], [], [], []
    n = len(data) - length + 1
    for begin in range(0, max(0, n), STRETCH):
        h = gram_hashes(data[begin : min(len(data), begin + STRETCH + length - 1)], ANCHOR)
        at = window_argmin(h, length - ANCHOR + 1)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        keys.append(h[at[first]])
        places.append(begin + at[first])
        firsts.append(begin + first)
        lasts.append(begin + np.append(first[1:], len(at)) - 1)
    if not keys:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    return np.concatenate(keys), np.concatenate(places), np.concatenate(firsts), np.concatenate(lasts)


def finer(key: int, context: bytes, level: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(key, first, last) of parts of a context's windows, cut where further anchors change."""
    n = len(context) - length + 1
    h = gram_hashes(np.frombuffer(context, dtype="u1"), SUB)
    w = max(1, length // 3**level - SUB + 1)
    at = window_argmin(h, w)
    left, right = at[:n], at[length - SUB - w + 1 : length - SUB - w + 1 + n]
    first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    mixed = ((h[left[first]] * _MUL) ^ h[right[first]]) * _MUL ^ np.uint64(key & (1 << 64) - 1)
    return list(zip(mixed.view("i8").tolist(), first.tolist(), (np.append(first[1:], n) - 1).tolist()))


def _grid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts as rows of one width, and their lengths."""
    size = np.array([len(p) for p in parts])
    width = int(size.max(initial=0)) + 1
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype="u1").reshape(len(parts), width), size


def intervals(lcp: list[int], left: list[int], begin: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, begin, stop) of the common-prefix intervals among the suffixes begin..stop whose suffixes differ in
    what stands before them, by one scan with a stack.  ``lcp`` is shared with the suffix before."""
    # an entry: common prefix, begin, the one left byte (None: several)
    stack: list[list] = []
    for k in range(begin + 1, stop + 1):
        here = lcp[k] if k < stop else 0
        at, byte = k - 1, left[k - 1]
        while stack and stack[-1][0] > here:
            prefix, at, own = stack.pop()
            byte = own if own == byte else None
            if byte is None:
                yield prefix, at, k
        if here:
            if stack and stack[-1][0] == here:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            else:
                stack.append([here, at, byte])


def maximal_repeats(group: list[int], contexts: list[bytes], places: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes, bytes before the anchor, contexts) of the maximal repeats of ``length`` or more that hold the anchor, which
    stands at ``places``.  ``group`` (sorted) tells the anchors apart."""
    right = [c[p:] for c, p in zip(contexts, places)]
    lefts, before = _grid([c[:p][::-1] for c, p in zip(contexts, places)])
    at = np.array(sorted(range(len(contexts)), key=lambda i: (group[i], right[i])), dtype="i8")
    rights, after = _grid(right)
    same = rights[at[1:]] == rights[at[:-1]]
    same[:, -1] = False
    common = np.minimum(same.argmin(1), np.minimum(after[at[1:]], after[at[:-1]]))
    kind = np.array(group)[at]
    #: common prefix with the suffix before, -1 where what stands up to the anchor differs
    lcp = np.append(-1, np.where(kind[1:] == kind[:-1], common, -1))
    for p in range(lefts.shape[1]):
        byte = np.where(before[at] > p, lefts[at, p].astype("i4"), 256 + np.arange(len(at)))
        hit = lcp >= length
        if hit.any():
            # only stretches of the array in which left bytes differ hold maximal repeats
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype("i1"))
            begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            other = np.cumsum(np.append(0, hit[1:] & (byte[1:] != byte[:-1])))
            mixed = other[stop - 1] > other[begin - 1]
            values = left = None
            for a, b in zip((begin[mixed] - 1).tolist(), stop[mixed].tolist()):
                if b - a == 2:
                    yield int(lcp[a + 1]), p, at[a:b]
                    continue
                if values is None:
                    values, left = lcp.tolist(), byte.tolist()
                for prefix, x, y in intervals(values, left, a, b):
                    yield prefix, p, at[x:y]
        # one byte more: suffixes without one, or alone in their class, are done with
        alone = (lcp < 0) & (np.append(lcp[1:], -1) < 0)
        keep = np.flatnonzero((before[at] > p) & ~alone)
        if len(keep) < 2:
            return
        if len(keep) < len(at):
            lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.append(0, keep[:-1] + 1))
            at, byte = at[keep], byte[keep]
        kind = np.cumsum(lcp < 0) * 256 + byte
        move = np.argsort(kind, kind="stable")
        x, y = move[:-1], move[1:]
        lower = lcp[y].copy()
        far = np.flatnonzero((kind[x] == kind[y]) & (y != x + 1))
        if len(far):
            lower[far] = np.minimum.reduceat(np.append(lcp, -1), np.stack([x[far] + 1, y[far] + 1], 1).reshape(-1))[::2]
        lcp = np.append(-1, np.where(kind[x] == kind[y], lower + 1, -1))
        at = at[move]


def repeats(group: list[int], contexts: list[bytes], places: list[int], counts: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, list[int]]]]:
    """Of each context where what is covered begins and stops (all of it holds the anchor, so it is one span; -1: none),
    and the maximal repeats: (bytes, bytes before the anchor, contexts)."""
    size, at = np.array([len(c) for c in contexts]), np.array(places)
    left, right, found = np.full(len(contexts), -1), np.full(len(contexts), -1), []
    several = np.bincount(np.unique(group, return_inverse=True)[1])[np.unique(group, return_inverse=True)[1]] > 1
    own = np.flatnonzero(several)
    if len(own):
        pick = own.tolist()
        for prefix, p, members in maximal_repeats([group[i] for i in pick], [contexts[i] for i in pick], [places[i] for i in pick], length):
            members = own[members]
            left[members] = np.maximum(left[members], p)
            right[members] = np.maximum(right[members], prefix - p)
            found.append((prefix, p, members))
    many = np.array(counts) > 1  # the context itself stands in several places
    begin, stop = np.where(many, 0, np.where(left < 0, -1, at - left)), np.where(many, size, np.where(left < 0, -1, at + right))
    found += [(int(size[i]), int(at[i]), np.array([i])) for i in np.flatnonzero(many).tolist()]
    return begin, stop, found


def _anchors(docs: DataFrame, length: int, by_word: bool) -> DataFrame:
    """doc, keys of the anchors of every text of at least ``length`` bytes, or if ``by_word`` of word codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                texts = [np.frombuffer(t, dtype="u1") for t in part.column(1).to_pylist()]
                if by_word:
                    texts = [np.frombuffer(word_codes(t), dtype="u1") for t in texts]
                long_ = [k for k, t in enumerate(texts) if len(t) >= length]
                keys = [runs(texts[k], length)[0].view("i8") for k in long_]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(long_, pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "keys"])

    return docs.select("doc", "body").mapInArrow(run, "doc binary, keys array<long>")


def _frames(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds.values())], names=list(kinds))


_CONTEXT = {"key": pa.int64(), "context": pa.binary(), "place": pa.int32(), "doc": pa.binary(), "first": pa.int64()}
_PART = {"key": pa.int64(), "context": pa.binary(), "place": pa.int32(), "parent": pa.binary(), "shift": pa.int64(), "many": pa.int64()}
_WINDOW = {"window": pa.binary(), "parent": pa.binary(), "shift": pa.int64(), "many": pa.int64()}
_SPAN = {"ident": pa.binary(), "begin": pa.int64(), "stop": pa.int64()}
_GROUP = {"repeat": pa.binary(), "n_bytes": pa.int64(), "ident": pa.binary(), "begin": pa.int64()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def _schema(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in kinds.items())


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """key, context, place (of the anchor in it), doc, first of the runs whose anchor is among ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc, body, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys, anchor, first, last = runs(np.frombuffer(body, dtype="u1"), length)
                keys = keys.view("i8")
                for k in np.flatnonzero(np.isin(keys, np.array(wanted, dtype="i8"))).tolist():
                    a, b = int(first[k]), int(last[k]) + length
                    out.append((int(keys[k]), body[a:b], int(anchor[k]) - a, doc, a))
                    size += b - a
                    if size > 4_000_000:
                        yield _frames(out, _CONTEXT)
                        out, size = [], 0
            if out:
                yield _frames(out, _CONTEXT)

    return docs.select("doc", "body", "wanted").mapInArrow(run, _schema(_CONTEXT))


def _split(contexts: DataFrame, level: int, length: int) -> DataFrame:
    """Contexts (key, context, place, parent, shift, many) cut into finer ones, with new keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200_000):
                out = []
                for key, context, place, parent, shift, many in zip(*(part.column(i).to_pylist() for i in range(6))):
                    out += [(k, context[a : b + length], place - a, parent, shift + a, many) for k, a, b in finer(key, context, level, length)]
                yield _frames(out, _PART)

    return contexts.select(*_PART).mapInArrow(run, _schema(_PART))


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """window (a 128-bit digest with the key), parent, shift, many of every window of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200_000):
                out = []
                for key, context, _, parent, shift, many in zip(*(part.column(i).to_pylist() for i in range(6))):
                    out += [(xxhash.xxh3_128_digest(context[i : i + length], key & (1 << 64) - 1), parent, shift + i, many) for i in range(len(context) - length + 1)]
                yield _frames(out, _WINDOW)

    return contexts.select(*_PART).mapInArrow(run, _schema(_WINDOW))


def _solve(groups: DataFrame, length: int, listed: bool) -> DataFrame:
    """Of contexts (key, context, place, ident, many) what is covered (ident, begin, stop), or if ``listed`` the maximal
    repeats with all contexts that they stand in (repeat, n_bytes, ident, begin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= BATCH and row[0] != last:
                    yield from solved(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
                last = row[0]
        yield from solved(rows)

    def solved(rows):
        if not rows:
            return
        keys, contexts, places, idents, counts = map(list, zip(*rows))
        begin, stop, found = repeats(keys, contexts, places, counts, length)
        if listed:
            for a in range(0, len(found), 1000):
                out = []
                for n, p, members in found[a : a + 1000]:
                    one = members[0]
                    name = hashlib.md5(contexts[one][places[one] - p : places[one] - p + n]).digest()
                    out += [(name, n, idents[i], places[i] - p) for i in members.tolist()]
                yield _frames(out, _GROUP)
            return
        at = np.flatnonzero(begin >= 0)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([idents[i] for i in at.tolist()], pa.binary()), pa.array(begin[at]), pa.array(stop[at])], names=list(_SPAN))

    dealt = groups.select("key", "context", "place", "ident", "many").repartition("key").sortWithinPartitions("key", "ident")
    return dealt.mapInArrow(run, _schema(_GROUP if listed else _SPAN))


def _solved(different: DataFrame, length: int, listed: bool = False) -> DataFrame:
    """ident, begin, stop of covered spans (or, if ``listed``, the maximal repeats), from distinct contexts
    (key, context, place, ident, many)."""
    at, ties, found = different, None, []
    for level in range(LEVELS + 1):
        if level:
            parts = cut(_split(at, level, length).withColumn("ident", F.unhex(F.md5(F.concat(F.col("context"), F.col("key").cast("string").cast("binary"))))), "parts")
            ties = parts.select("ident", "parent", "shift")
            at = parts.groupBy("key", "ident").agg(F.first("context").alias("context"), F.first("place").alias("place"), F.sum("many").alias("many"))
            at = cut(at, "level")
        large = cut(at.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "large")
        done = large.isEmpty()
        own = _solve(at if done else at.join(large, "key", "left_anti"), length, listed)
        if ties is not None:
            own = cut(own, "own")
            own = ties.join(own, "ident").withColumns({"begin": F.col("shift") + F.col("begin"), "ident": F.col("parent")})
            if not listed:  # all of a context's spans hold its anchor, so they are one
                own = own.withColumn("stop", F.col("shift") + F.col("stop")).groupBy("ident").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"))
        found.append(own.select(*(_GROUP if listed else _SPAN)))
        if done:
            break
        rest = at.join(large, "key", "left_semi")
        if ties is None:
            rest = rest.select("key", "context", "place", F.col("ident").alias("parent"), F.lit(0).cast("long").alias("shift"), "many")
        else:
            rest = rest.drop("many").join(parts.select("ident", "parent", "shift", "many"), "ident").select(*_PART)
        at = cut(rest, "rest")
    else:
        rows = cut(_windows(at, length), "windows")
        twice = rows.groupBy("window").agg(F.sum("many").alias("all")).where("all > 1").select("window")
        rows = dealt_join(rows, twice, "window", "parent")
        if listed:
            own = rows.select(F.col("window").alias("repeat"), F.lit(length).cast("long").alias("n_bytes"), F.col("parent").alias("ident"), F.col("shift").alias("begin"))
        else:
            own = rows.groupBy(F.col("parent").alias("ident")).agg(F.min("shift").alias("begin"), (F.max("shift") + length).alias("stop"))
        found.append(own)
    out = found[0]
    for own in found[1:]:
        out = out.unionByName(own)
    return out


def _occurrences(docs: DataFrame, length: int, by_word: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``docs`` (body: bytes of every text, doc: a hash of it): the different texts that hold repeats, each with its
    copies (doc, body, many), their contexts (key, ident, doc, first), and these without repeats (key, context, place,
    ident, many).  If ``by_word``, of the texts' word codes, which become the bodies."""
    long_ = (_coded(docs) if by_word else docs).where(F.length("body") >= length)
    # codes are made in the same Python function: two in one stage hold twice as many workers on every executor
    keyed = cut(_anchors(docs if by_word else long_, length, by_word), "anchors")
    one = cut(keyed.groupBy("doc").agg(F.first("keys").alias("keys"), F.count("*").alias("many")), "texts")
    free(keyed)
    every = one.select("doc", "many", F.explode("keys").alias("key"))
    twice = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = dealt_join(every, twice, "key", "doc").groupBy("doc", "many").agg(F.collect_set("key").alias("wanted"))  # a text's own anchors
    copies = one.where("many > 1").select("doc", "many", F.array().cast("array<bigint>").alias("wanted")).join(wanted, "doc", "left_anti")
    wanted = wanted.unionByName(copies)
    # copies are dropped before they move
    texts = cut(long_.select("doc", "body").dropDuplicates(["doc"]).join(wanted, "doc"), "repeats")
    free(one)
    # worked out twice rather than written with their bytes, which take more room than the texts
    occur = _contexts(texts, length).withColumn("ident", F.unhex(F.md5("context")))
    different = occur.groupBy("key", "ident").agg(F.first("context").alias("context"), F.first("place").alias("place"), F.count("*").alias("many"))
    different = cut(different, "different")
    light = cut(occur.select("key", "ident", "doc", "first"), "occur")
    return texts, light, different


def covered(docs: DataFrame, length: int = LENGTH, by_word: bool = False) -> tuple[DataFrame, DataFrame]:
    """From ``docs`` (body: bytes of every text, doc: a hash of it): the different texts that hold repeats, each with
    its copies ``many`` (doc, body, many), and the covered spans (doc, begin, stop) found in them; if ``by_word``, in
    the texts' word codes."""
    texts, occur, different = _occurrences(docs, length, by_word)
    spans = cut(_solved(different, length), "spans")
    free(different)
    # few rows for each text, so they are brought to it here and the contexts can go
    back = dealt_join(occur.select("ident", "doc", "first"), spans, "ident", "doc").select("doc", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("stop")).alias("stop"))
    whole = texts.where("many > 1").select("doc", F.lit(0).cast("long").alias("begin"), F.length("body").cast("long").alias("stop"))
    found = cut(back.unionByName(whole), "covered")
    free(occur, spans)
    return texts, found


def repeat_groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The maximal repeats of ``length`` bytes or more with all occurrences: repeat (a digest of its bytes), n_bytes, doc_id,
    begin.  Repeats are maximal within contexts of up to about 2 * length bytes; a longer one gives several that
    overlap.  A group larger than an array gives its repeats as windows of ``length``."""
    rows = _bodies(docs.select(F.col("doc_id").cast("long"), "text"))
    _, occur, different = _occurrences(rows.select("doc", "body"), length)
    found = cut(_solved(different, length, True), "groups")
    places = occur.select("ident", "doc", "first").join(found, "ident").select("repeat", "n_bytes", "doc", (F.col("first") + F.col("begin")).alias("begin")).distinct()
    return rows.select("doc_id", "doc").join(places, "doc").select("repeat", "n_bytes", "doc_id", "begin")


def _united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(body: bytes, spans) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(body[at:a])
        at = b
    return b"".join([*parts, body[at:]])


def _bodies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id and text), with body and doc."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumn("body", body).withColumn("doc", F.unhex(F.sha2("body", 256)))


def _cut_texts(docs: DataFrame, length: int) -> DataFrame:
    """doc, spans (united), kept (bytes) of the different texts that lose something."""
    texts, spans = covered(docs, length)
    lists = spans.groupBy("doc").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                united = _united([(s["begin"], s["stop"]) for s in own])
                out.append((doc, [list(s) for s in united], _kept(body, united)))
            kinds = (pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=["doc", "spans", "kept"])

    return texts.select("doc", "body").join(lists, "doc").mapInArrow(run, "doc binary, spans array<array<long>>, kept binary")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = _bodies(docs.select(F.col("doc_id").cast("long"), "text"))
    changed = _cut_texts(rows.select("doc", "body"), length)
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    changed = changed.select("doc", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    light = rows.select("doc_id", "doc", F.length("body").cast("long").alias("n_bytes"))
    return dealt_join(light, changed, "doc", "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", F.lower(F.hex("doc"))).alias("kept_sha256"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without the covered bytes; of a character that is cut, the rest goes too.  Documents of which
    nothing is left go; columns stay as they are, but for text and, where there is one, n_chars."""
    texts, spans = covered(_bodies(docs.select("text")).select("doc", "body"), length)
    free(texts)
    return _without(docs, _lists(spans.withColumn("unit", F.lit(1))))


def _lists(spans: DataFrame) -> DataFrame:
    """doc, spans of every text that loses something, from doc, begin, stop, unit (bytes or words of ``CODE`` bytes)."""
    return spans.groupBy("doc").agg(F.collect_set(F.struct("begin", "stop", "unit")).alias("spans"))  # of one text


def _left(body: bytes, own: list[dict]) -> str:
    """The text without spans of bytes and of words."""
    spans = [(s["begin"], s["stop"]) for s in own if s["unit"] == 1]
    begins, stops = word_spans(np.frombuffer(body, dtype="u1"))
    for a, b in _united([(s["begin"], s["stop"]) for s in own if s["unit"] == CODE]):
        a, b = -(-a // CODE), b // CODE  # whole words
        spans.append((int(begins[a]), int(stops[b - 1])))
    return _kept(body, _united(spans)).decode("utf-8", "ignore")


def _without(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs`` without the spans of ``lists`` (doc, spans), which come to the rows: no text moves but with its row.  Their
    columns travel in one struct, so that no name clashes."""

    @F.arrow_udf("string")
    def left(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if s is None else _left(b, s) for b, s in zip(bodies.to_pylist(), spans.to_pylist())], pa.string())

    lists = cut(lists, "lists").select(F.col("doc").alias("__doc"), F.col("spans").alias("__spans"))
    doc = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), doc.alias("__doc"))
    full = dealt_join(rows, lists, "__doc", "__row.doc_id", "left")
    body = F.when(F.col("__spans").isNotNull(), F.col("__row.text").cast("binary"))
    full = full.select("__row", left.asNondeterministic()(body, "__spans").alias("__kept"))  # worked out once
    full = full.where(F.col("__kept").isNull() | (F.length("__kept") > 0))
    new = {"text": F.coalesce("__kept", F.col("__row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__kept").isNull(), F.col("__row.n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))
    return full.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, stops) of the words of a text's bytes."""
    blank = np.ones(len(data) + 2, dtype=bool)
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(blank.astype("i1"))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_codes(data: np.ndarray) -> bytes:
    """``CODE`` bytes for each word: of a hash, by sums over the text's bytes times powers."""
    begins, stops = word_spans(data)
    power = np.full(len(data) + 1, _MUL)
    power[0] = 1
    sums = np.append(np.uint64(0), np.cumsum(_BYTES[data] * np.cumprod(power)[:-1], dtype="u8"))
    back = np.full(len(data) + 1, _INVERSE)
    back[0] = 1
    h = (sums[stops] - sums[begins]) * np.cumprod(back)[begins]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.astype("<u8").view("u1").reshape(-1, 8)[:, :CODE].tobytes()


def sparse(data: np.ndarray, words: int, length: int) -> bool:
    """Whether a window of ``length`` bytes may hold fewer whole words: the first that begins after its first byte and
    the last one, which may go on, are told by the window's bytes alone."""
    if len(data) < length:
        return False
    begins, _ = word_spans(data)
    at = np.zeros(len(data) + 1, dtype="i8")
    at[1:] = np.cumsum(np.bincount(begins, minlength=len(data))[: len(data)])
    return bool((at[length:] - at[1 : len(at) - length + 1]).min() <= words)


def _coded(docs: DataFrame) -> DataFrame:
    """doc, body (codes of the words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                codes = [word_codes(np.frombuffer(t, dtype="u1")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.binary())], names=["doc", "body"])

    return docs.select("doc", "body").mapInArrow(run, "doc binary, body binary")


def _sparse(docs: DataFrame, words: int, length: int) -> DataFrame:
    """doc of the texts that are ``sparse``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                few = [sparse(np.frombuffer(t, dtype="u1"), words, length) for t in part.column(1).to_pylist()]
                yield part.select(["doc"]).filter(pa.array(few, pa.bool_()))

    return docs.select("doc", "body").mapInArrow(run, "doc binary")


def _passages(docs: DataFrame, words: int, length: int) -> DataFrame:
    """doc, begin, stop, unit of what the different texts lose."""
    texts, by_word = covered(docs, words * CODE, by_word=True)
    free(texts)
    few = cut(_sparse(docs, words, length).distinct(), "sparse")
    texts, by_byte = covered(docs.join(few, "doc", "left_semi"), length)
    free(texts)
    return by_word.withColumn("unit", F.lit(CODE)).unionByName(by_byte.withColumn("unit", F.lit(1)))


def dedup_passages(docs: DataFrame, words: int = 51, length: int = LENGTH) -> DataFrame:
    """As ``dedup``, without strings of ``words`` words, or of ``length`` bytes with fewer words, that start elsewhere as well."""
    return _without(docs, _lists(_passages(_bodies(docs.select("text")).select("doc", "body"), words, length)))
