"""MinHash near-dedup with odd sketches.

Words are what stands between the bytes 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set holds its shingles
of ``width`` words, or its words as one shingle if they are fewer; without words it is empty and linked with
nothing.  Documents with equal sets are one node.  Nodes whose sets have a Jaccard similarity of at least
``percent`` / 100 are linked:

1. ``BANDS`` x ``ROWS`` MinHash samples of each node make its band keys.  At 0.8, two nodes share no band with a
   probability of 3e-6.  The same samples, folded into a bitmap by parity, are its odd sketch: the population
   count of two sketches' XOR estimates how many samples differ, and a pair far beyond the threshold is passed over
   (at 0.8, with a probability below 1e-7).
2. In each bucket every node is paired with one centre, another in every band.  Of these pairs, each node first
   confirms that with the smallest node; then all pairs whose nodes are not connected yet.
3. Nodes that the sketched pairs hang together are a group.  Groups that still hold several components are dealt
   out in blocks with their hashed sets; where two blocks meet, all of their pairs across components that the sketches
   pass are decided, and a forest of the links goes on.  Pairs of two groups that share a bucket are compared by
   sketch in blocks of the bucket.  So no link that decides a component is left out, and no group's pairs are listed.

Links are confirmed on the full sets of shingles of the texts.  A null text is an empty one; a null doc_id is
linked with nothing and kept; rows with one doc_id count as one document where their texts agree; further columns are not read by ``classes`` and
kept as they are by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, dealt_join, group_bounds, slices
from .linking import blocked, components, dealt, pairs_in_groups

BANDS, ROWS, BITS = 32, 5, 1024
#: XOR bits beyond which a pair is passed over: at 0.8, 32 of 160 samples are expected to differ; 64 make 113 bits.
MOST_BITS = 120
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype="u8")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The set of a document as it is defined."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def hashed(words: list[bytes], width: int, cache: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the set."""
    if not words:
        return np.zeros(0, dtype="u8")
    h = np.fromiter(map(cache.__getitem__, words), dtype="u8", count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), dtype="u8")
    for j in range(min(width, len(h))):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sample(values: np.ndarray) -> np.ndarray:
    """MinHash samples."""
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype="u8")
    for a in range(0, len(values), 256):
        low = np.minimum(low, ((values[a : a + 256, None] ^ _XOR) * _MUL).min(0))
    return low


def fold(low: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and odd sketch of MinHash samples."""
    spread = (low ^ np.arange(len(low), dtype="u8")) * _MIX
    spread ^= spread >> np.uint64(31)
    key = np.arange(BANDS, dtype="u8")
    for j in range(ROWS):
        key = (key ^ spread[j::ROWS]) * _MIX
        key ^= key >> np.uint64(32)
    bits = np.bincount((spread * _MIX >> np.uint64(64 - 10)).astype("i8"), minlength=BITS) & 1
    return key.view("i8"), np.packbits(bits.astype("u1")).tobytes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark, node, n_shingles, keys, sketch; a node is the hash of a set, null for an empty one, a mark that of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            for part in slices(batch, 4_000_000):
                out = []
                for text in part.column(1).to_pylist():
                    values = hashed(words_of(text), width, cache)
                    if len(values):
                        keys, sketch = fold(sample(values))
                        out.append((int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())))), len(values), keys, sketch))
                    else:
                        out.append((None, 0, None, None))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())))], names=["doc_id", "mark", "node", "n_shingles", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id long, mark long, node long, n_shingles long, keys array<long>, sketch binary")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="u8").reshape(-1, BITS // 64)


def _sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that the odd sketches pass."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.bitwise_count(_bits(batch.column(2)) ^ _bits(batch.column(3))).sum(1) <= MOST_BITS
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(None, set()), (None, set())]
        for batch in batches:
            keep = []
            for k, row in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                for side in (0, 1):
                    if known[side][0] != row[side]:
                        known[side] = (row[side], shingles(row[2 + side], width))
                x, y = known[0][1], known[1][1]
                same = len(x & y)
                if 100 * same >= percent * (len(x) + len(y) - same):
                    keep.append(k)
            if keep:
                yield batch.take(pa.array(keep)).select(["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, signed: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, text of the given nodes (column ``node``)."""
    wanted = dealt_join(signed.where("doc_id is not null").select("node", "doc_id"), nodes.distinct(), "node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:  # of rows that share a doc_id, the one with the node's set
            keep = [k for k, (n, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashed(words_of(t), width, cache).tobytes()))) == n]
            if keep:
                yield batch.take(pa.array(keep))

    return rows.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(signatures, components of nodes): all that decides which documents hang together."""
    if percent < 80:
        raise ValueError("the bands and the sketches' limit hold for similarities of 80 percent and more")
    signed = cut(signatures(docs, width), "signed")
    nodes = signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes, "nodes")
    members = nodes.select("node", F.explode("keys").alias("key"))
    # the node nearest to a bucket's key by XOR is its centre: another one in each bucket
    centre = members.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("c"), F.count("*").alias("n")).where("n > 1")
    shared = cut(dealt_join(members, centre, "key", "node").select("key", "node", F.col("c").bitwiseXOR(F.col("key")).alias("c"), "n"), "buckets")
    star = shared.where("node != c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    star = cut(_sketched(star, nodes), "star")
    texts = cut(_texts(docs, signed, star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))), width), "texts")
    first = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    edges = cut(_confirmed(first, texts, width, percent), "edges")
    comps = cut(components(edges), "comps")
    open_ = _across(star.join(first, ["a", "b"], "left_anti"), comps)
    more = cut(_confirmed(open_, texts, width, percent), "edges")
    edges = edges.unionByName(more)
    comps = cut(components(edges), "comps")
    # groups that sketches hang together, and that still hold several components
    groups = cut(components(star).select("node", F.col("comp").alias("grp")), "groups")
    apart = nodes.select("node", "sketch").join(groups, "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    inner = cut(_inner(_several(apart, "grp"), texts, width, percent), "inner")
    # links between such groups, in buckets of more than one
    labelled = shared.where("n > 2").select("key", "node").join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    mixed = _several(labelled, "key", "grp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    outer = cut(_outer(mixed.join(nodes.select("node", "sketch"), "node")), "outer")
    late = cut(inner.unionByName(outer).distinct(), "late")
    if late.isEmpty():
        return signed, comps
    texts = _texts(docs, signed, late.select(F.col("a").alias("node")).unionByName(late.select(F.col("b").alias("node"))), width)
    more = cut(_confirmed(late, cut(texts, "texts"), width, percent), "edges")
    return signed, cut(components(edges.unionByName(more)), "comps")


def _several(rows: DataFrame, key: str, label: str = "comp") -> DataFrame:
    """The rows of keys that hold more than one label."""
    several = rows.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo < hi").select(key)
    return rows.join(several, key, "left_semi")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y the sketches pass."""
    out = np.empty((len(x), len(y)), dtype=bool)
    for a in range(0, len(x), 64):
        out[a : a + 64] = np.bitwise_count(x[a : a + 64, None] ^ y).sum(2) <= MOST_BITS
    return out


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of 0/1 matrices of a few columns at a time."""
    sizes = [len(s) for s in (*x, *y)]
    _, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), dtype="f4")
    for low in range(0, int(column[-1]) + 1, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        dense = np.zeros((len(sizes), 4096), dtype="f4")
        dense[row[a:b], column[a:b] - low] = 1
        out += dense[: len(x)] @ dense[len(x) :].T
    return out.astype("i8")


def _inner(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within groups (grp, node, comp, sketch): every pair of two components that the sketches pass is decided on
    the hashed sets where its blocks meet, and of the links found there a forest over components goes on.

    A group has some two dozen blocks, of 64 rows at least; blocks do not pass 1024 rows or 2^18 shingles on average,
    so that further rows make more blocks."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            for part in slices(batch, 4_000_000):
                found = [hashed(words_of(t), width, cache) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in found], pa.binary())], names=["node", "hashes"])

    wanted = texts.join(rows.select("node"), "node", "left_semi").select("node", "text").mapInArrow(sets, "node long, hashes binary")
    full = cut(rows.join(wanted, "node"), "sets")
    n = full.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.length("hashes") / 8).alias("all"))
    blocks = F.greatest(F.ceil(F.col("n") / F.greatest(F.lit(64), F.least(F.lit(1024), F.ceil(F.col("n") / 24)))), F.ceil(F.col("all") / (1 << 18)))
    each = full.join(n.select("grp", blocks.cast("int").alias("__b")), "grp").withColumn("block", F.pmod(F.xxhash64("node", "grp"), F.col("__b")).cast("int"))
    each = each.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    each = each.withColumns({"lo": F.least("block", "__o"), "hi": F.greatest("block", "__o")}).drop("__b", "__o")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, ["grp", "lo", "hi"], 1):
            node, comp, block, group, lo, hi = (whole.column(c).to_numpy() for c in ("node", "comp", "block", "grp", "lo", "hi"))
            bounds = group_bounds(group, lo, hi)
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                x = np.arange(p, q) if lo[p] == hi[p] else p + np.flatnonzero(block[p:q] == lo[p])
                y = x if lo[p] == hi[p] else p + np.flatnonzero(block[p:q] == hi[p])
                sketch = _bits(whole.column("sketch").slice(p, q - p))
                near = _near(sketch[x - p], sketch[y - p]) & (comp[x][:, None] != comp[y])
                x, y, near = x[near.any(1)], y[near.any(0)], near[near.any(1)][:, near.any(0)]
                if not near.size:
                    continue
                u, v = ([np.frombuffer(whole.column("hashes")[k].as_py(), dtype="u8") for k in at.tolist()] for at in (x, y))
                same = _common(u, v)
                total = np.array([len(s) for s in u])[:, None] + np.array([len(s) for s in v])
                i, j = np.nonzero(near & (100 * same >= percent * (total - same)))
                found = _forest(node[x[i]], node[y[j]], comp[x[i]], comp[y[j]])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return dealt(each, "grp").mapInArrow(links, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b) between components as many as hang the same components together."""
    top: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := top.get(k, k)) != k:
            top[k] = top.get(up, up)
            k = up
        return k

    out = []
    for x, y, p, q in zip(a.tolist(), b.tolist(), ca.tolist(), cb.tolist()):
        p, q = root(p), root(q)
        if p != q:
            top[p] = q
            out.append((min(x, y), max(x, y)))
    return out


def _outer(rows: DataFrame) -> DataFrame:
    """Pairs in buckets (key, node, grp, comp, sketch) of two groups and two components that the sketches pass."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, ["key", "lo", "hi"], 20_000):
            node, comp, grp, block, key, lo, hi = (whole.column(c).to_numpy() for c in ("node", "comp", "grp", "block", "key", "lo", "hi"))
            sketch = _bits(whole.column("sketch"))
            bounds = group_bounds(key, lo, hi)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for i, j in pairs_in_groups(group, block, lo, hi, 100_000):
                use = (comp[i] != comp[j]) & (grp[i] != grp[j])
                i, j = i[use], j[use]
                use = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1) <= MOST_BITS
                if use.any():
                    a, b = node[i[use]], node[j[use]]
                    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return dealt(blocked(rows, "key", "node"), "key").mapInArrow(near, "a long, b long").distinct()


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose nodes are of two components."""
    ca = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    cb = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, node, comp and the smallest (doc_id, node) of its component for every row."""
    signed, comps = linked(docs, width, percent)
    rows = dealt_join(signed.select("doc_id", "mark", "n_shingles", "node"), comps, "node", "doc_id", "left").withColumn("comp", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node")))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    return dealt_join(rows, least, "comp", "doc_id", "left")


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    own = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return _members(docs, width, percent).select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that with the smallest doc_id; columns stay as they are.

    Rows are told apart by id and text: of two texts under one id each stays or goes with its own component, and of two in
    one component one stays."""
    far = (F.col("doc_id") != F.col("least.doc_id")) | (F.col("node") != F.col("least.node"))
    dropped = _members(docs, width, percent).where(F.col("comp").isNotNull() & far).select("doc_id", "mark").distinct()
    return docs.join(dropped, (docs["doc_id"].cast("long") == dropped["doc_id"]) & (F.xxhash64(docs["text"]) == dropped["mark"]), "left_anti")
