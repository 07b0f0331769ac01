"""Written steps: cut the lineage of iterative plans, so that the loss of an executor replays one step at most."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the session runs in one process is a temporary folder made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="logloom-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` from the shared folder, where it is written; ``dropped`` deletes the files, else they go with the driver."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of written steps that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_step_path", None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def lookup(rows: DataFrame, table: DataFrame, by: str, spread: str, how: str = "left", salts: int = 8) -> DataFrame:
    """``rows`` joined with ``table``, which has one row of each ``by``; rows of one key go to ``salts`` tasks by a hash of
    ``spread``, as many rows may ask for one key."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(table, [by, "__salt"], how).drop("__salt")
