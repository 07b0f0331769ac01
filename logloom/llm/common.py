"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the session runs in one process is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="logloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, so that the loss of an
    executor replays one step at most.  ``free`` deletes the files; what is left goes when the driver's JVM ends.

    The shuffles behind ``df`` are done with then; the driver is made to find that, so that Spark deletes their files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def free(*frames: DataFrame) -> None:
    """Delete the files of frames from ``cut`` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_cut_path", None):
            at, files = _files(df.sparkSession, path)
            files.delete(at, True)


def sampled(share: float, column: str = "doc_id"):
    """True for about that share of the values of a column, chosen by 63 bits of a hash; all of them from 1 on."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(column), 1) < F.lit(int(share * (1 << 63)))


#: Rows of one key are dealt to so many tasks where they meet a table with few rows of each key.
SALTS = 8


def dealt_join(rows: DataFrame, few: DataFrame, by: str, spread, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``few``, which has few rows of each ``by``; the rows of one key go to ``salts`` tasks, by a hash
    of ``spread``."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(few, [by, "__salt"], how).drop("__salt")


def is_held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables of whole groups, each of about ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cols = [whole.column(k).to_numpy() for k in keys]
        same = np.ones(rows, dtype=bool)
        for c in cols:
            same &= c == c[-1]
        last = int(np.argmin(same[::-1])) if not same.all() else rows
        if last < rows:
            yield whole.slice(0, rows - last)
            rest = whole.slice(rows - last)
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(*cols: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns, and the end."""
    n = len(cols[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def slices(batch: pa.RecordBatch, chars: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts add up to about so many bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(column)
    size = np.array([len(x) if x else 0 for x in col.to_pylist()])
    begin, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > chars:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)
