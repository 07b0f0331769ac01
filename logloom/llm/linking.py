"""Shared by the operators that link near copies: blocks of hot buckets, pairs within groups, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def blocked(members: DataFrame, key: str, node: str, size: int = 256) -> DataFrame:
    """Deal the rows of each ``key`` with two rows or more to pairs of blocks of about ``size`` rows.

    Adds ``lo``, ``hi`` (the pair of blocks; together with the key the group that a task works on) and ``block``
    (the row's own).  Every pair of rows of a key meets: in the group (b, b) if both are in block b, else in one
    group.  No group has more than about two blocks of rows, whatever the size of the key."""
    n = members.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    rows = members.join(n, key).withColumn("__b", F.ceil(F.col("__n") / size))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(node, key), F.col("__b")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), (F.col("__b") - 1).cast("int"))))
    return rows.withColumns({"lo": F.least("block", "__o"), "hi": F.greatest("block", "__o")}).drop("__n", "__b", "__o")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Groups of ``blocked`` brought together and in order, for ``by_group``."""
    return rows.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def pairs_in_groups(group: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of a group that are of one block where lo is hi, of two elsewhere."""
    at, step, held, n = np.arange(len(group)), 1, [], 0
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        use = at[(block[at] != block[at + step]) | (lo[at] == hi[at])]
        if len(use):
            held.append((use, use + step))
            n += len(use)
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
        step += 1
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge, comp being the smallest node it reaches.

    Large-star and small-star by turns (Kiveris et al. 2014) until nothing changes; each round is written to the
    shared folder, and only a count and a checksum come to the driver."""
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u != v").distinct(), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    return now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
