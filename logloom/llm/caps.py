"""Embedding near-dedup by spherical-cap filters.

A filter is a direction.  Directions are a product code: one of ``size`` random unit vectors for each half of the
coordinates, joined, so ``size`` squared of them.  The coordinates are rotated at random before they are halved, so
that it does not matter where a vector has its length.  A vector falls into the ``FILTERS`` directions that it is
nearest to, in each of ``CODES`` independent codes; so each vector has the same number, whatever its halves are.  List
decoding finds them without trying each: of the best words of both halves, the i-th and j-th are read together only
where i * j is ``FILTERS`` at most.  ``size`` follows from the dimension, so that ``MEAN`` caps of ``threshold``
hold a random direction on the mean.  Of 40,000 random pairs at a cosine of 0.9501 in 64 dimensions, all shared a filter.

Vectors that share a filter meet in blocks of bounded size.  First, rows that no sign sketch brings near another
row of their bucket are left out; then cosines are worked out in double precision, each pair counting in the
smallest filter that it shares.  Equal vectors are one node with a count.

A null or zero vector, or one with a null or non-finite component, has no links; vectors of different length
have none either.  The rows with one vec_id count each; an empty table gives no rows.  Filters may miss a link: see README for the measured shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, dealt_join, group_bounds
from .linking import blocked, components, dealt, pairs_in_groups

FILTERS, CODES, SIGNS = 24, 2, 128
#: Caps that hold a random direction on the mean; the code's size follows from it.
MEAN = 40
#: Differing sign bits beyond which a pair is not near: at 0.95, 13 of 128 are expected, with a deviation of 3.4.
MOST_SIGNS = 36


def threshold(dim: int) -> float:
    """Cosine of the caps that the code's size is worked out for: four deviations of a random direction, 0.6 at most."""
    return min(0.6, 4 / np.sqrt(dim))


@lru_cache(maxsize=8)
def code(dim: int, filters: float = MEAN, seed: int = 99) -> tuple[np.ndarray, np.ndarray]:
    """Code words of both halves."""
    if dim == 1:
        return np.ones((1, 1)), np.zeros((1, 0))
    x = np.linspace(-1, 1, 200_001)[1:-1]
    density = (1 - x * x) ** ((dim - 3) / 2)
    share = density[x > threshold(dim)].sum() / density.sum()
    size = int(np.clip(np.ceil(np.sqrt(filters / max(share, 1e-12))), 8, 3000))
    rng = np.random.default_rng([seed, dim])
    halves = [rng.normal(size=(size, n)) for n in (dim // 2, dim - dim // 2)]
    return tuple(h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves)


@lru_cache(maxsize=8)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([7, dim]).normal(size=(dim, SIGNS))


@lru_cache(maxsize=16)
def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, 1]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _best(products: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of the ``n`` largest, in order, and their values."""
    n = min(n, products.shape[1])
    at = np.argpartition(-products, n - 1, axis=1)[:, :n]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(products, at, 1), axis=1, kind="stable"), 1)
    return at, np.take_along_axis(products, at, 1)


def nearest_filters(unit: np.ndarray, number: int) -> np.ndarray:
    """For each unit vector (rows) the ``FILTERS`` nearest filters of one code, or all if there are fewer."""
    dim = unit.shape[1]
    first, second = code(dim, seed=99 + number)
    half = dim // 2 if dim > 1 else 1
    turned = unit @ _rotation(dim, 99 + number)
    (at, a), (bt, b) = _best(turned[:, :half] @ first.T, FILTERS), _best(turned[:, half:] @ second.T, FILTERS)
    # the pair of ranks (i, j) is among the best n only if (i + 1) * (j + 1) <= n
    i, j = np.nonzero(np.outer(np.arange(1, a.shape[1] + 1), np.arange(1, b.shape[1] + 1)) <= FILTERS)
    own, _ = _best(a[:, i] + b[:, j], FILTERS)
    return np.take_along_axis(at[:, i] * len(second) + bt[:, j], own, 1)


def decode(unit: np.ndarray) -> np.ndarray:
    """For each unit vector (rows) the sorted numbers of its filters, of all codes."""
    return np.sort(np.concatenate([nearest_filters(unit, k) | k << 32 for k in range(CODES)], axis=1), axis=1)


def filtered(vectors: DataFrame) -> DataFrame:
    """vec_id, node (null: no links), vector (doubles of the unit vector), keys, signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = [(None, None, None, None)] * batch.num_rows
                by_dim: dict[int, list[int]] = {}
                rows = batch.column(1).to_pylist()
                for i, v in enumerate(rows):
                    if v and all(x is not None for x in v):
                        by_dim.setdefault(len(v), []).append(i)
                for dim, places in by_dim.items():
                    x = np.array([rows[i] for i in places], dtype="f8") + 0.0
                    with np.errstate(all="ignore"):
                        top = np.abs(x).max(1)
                        fine = np.isfinite(x).all(1) & (top > 0)
                        x, places, top = x[fine], np.array(places)[fine], top[fine]
                        unit = x / top[:, None]
                        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    if not len(x):
                        continue
                    signs = np.packbits(unit @ _planes(dim) > 0, axis=1)
                    for i, own, u, keys, sign in zip(places.tolist(), x, unit, decode(unit), signs):
                        node = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes()))))
                        out[i] = (node, u.tobytes(), (keys | dim << 40), sign.tobytes())
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())))], names=["vec_id", "node", "vector", "keys", "signs"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, node long, vector binary, keys array<long>, signs binary")


def _matrix(column, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1)


def _groups(whole: pa.Table):
    node, key, lo, hi, block = (whole.column(c).to_numpy() for c in ("node", "key", "lo", "hi", "block"))
    bounds = group_bounds(key, lo, hi)
    return node, key, lo, hi, block, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def active(members: DataFrame) -> DataFrame:
    """Rows (key, node) that a sign sketch brings near another row of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, ["key", "lo", "hi"], 50_000):
            node, key, lo, hi, block, group = _groups(whole)
            signs, near = _matrix(whole.column("signs"), "u8"), np.zeros(len(node), dtype=bool)
            for i, j in pairs_in_groups(group, block, lo, hi):
                use = np.bitwise_count(signs[i] ^ signs[j]).sum(1) <= MOST_SIGNS
                near[i[use]] = near[j[use]] = True
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(node[near])], names=["key", "node"])

    return dealt(blocked(members, "key", "node"), "key").mapInArrow(run, "key long, node long").distinct()


def _shares_smaller(lists: list, key: int) -> np.ndarray:
    """Which pairs of rows share a filter smaller than ``key``, by one product of incidence matrices."""
    own = [np.asarray(k, dtype="i8") for k in lists]
    own = [k[k < key] for k in own]
    flat = np.concatenate(own)
    if not len(flat):
        return np.zeros((len(own), len(own)), dtype=bool)
    _, place = np.unique(flat, return_inverse=True)
    held = np.zeros((len(own), int(place.max()) + 1), dtype="f4")
    held[np.repeat(np.arange(len(own)), [len(k) for k in own]), place] = 1
    return held @ held.T > 0


def linked(rows: DataFrame, least: float) -> DataFrame:
    """From blocked rows (key, node, vector, keys, many): node, n (links within the group), root (of the group's links).

    A group is at most two blocks, so its cosines and shared filters are two matrix products of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_group(batches, ["key", "lo", "hi"], 2_000):
            node, key, lo, hi, block, group = _groups(whole)
            lists, raw, many = whole.column("keys").to_pylist(), whole.column("vector").to_pylist(), whole.column("many").to_numpy()
            total, root, linked_ = np.zeros(len(node), dtype="i8"), np.arange(len(node)), np.zeros(len(node), dtype=bool)
            bounds = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(node))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                x = np.frombuffer(b"".join(raw[a:b]), dtype="f8").reshape(b - a, -1)  # a key holds vectors of one length
                near = x @ x.T >= least
                near &= True if lo[a] == hi[a] else block[a:b, None] != block[None, a:b]
                np.fill_diagonal(near, False)
                if not near.any():
                    continue
                linked_[a:b] = near.any(1)
                total[a:b] = (near & ~_shares_smaller(lists[a:b], int(key[a]))) @ many[a:b]
                at = np.arange(b - a)
                while True:
                    low = np.minimum(at, np.where(near, at[None, :], b - a).min(1))
                    if np.array_equal(low, at):
                        break
                    at = low
                root[a:b] = a + at
            if linked_.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[linked_]), pa.array(total[linked_]), pa.array(node[root[linked_]])], names=["node", "n", "root"])

    return dealt(rows, "key").mapInArrow(run, "node long, n long, root long")


def links(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    if least < 0.95:
        raise ValueError("the filters and the sketches' limit hold for cosines of 0.95 and more")
    rows = cut(filtered(vectors), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.first("keys").alias("keys"), F.first("signs").alias("signs"), F.count("*").alias("many"), F.min("vec_id").alias("least"))
    nodes = cut(nodes, "nodes")
    near = cut(active(nodes.select("node", "signs", F.explode("keys").alias("key"))), "active")
    own = near.groupBy("node").agg(F.collect_list("key").alias("keys"))  # as many keys as a vector has filters
    full = near.join(nodes.select("node", "vector", "many").join(own, "node"), "node")
    found = cut(linked(blocked(full, "key", "node"), least), "linked")
    count = found.groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = nodes.select("node", "many", "least").join(count, "node", "left").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = info.groupBy("comp").agg(F.min("least").alias("component_id"))
    info = dealt_join(info, smallest, "comp", "node").select("node", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = dealt_join(rows.select("vec_id", "node"), info, "node", "vec_id", "left")
    own_id = F.when(F.col("node").isNull() | F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), F.col("vec_id").eqNullSafe(own_id).alias("kept"))
