"""Sources that are databases: SQLite files read where they lie, and rules that their schemas share.

A database file is one task's work: its bytes come from Spark's binary file source and are opened in memory, so any
store that Spark reads will do and nothing of the file is ever written.  The committed pages of a ``-wal`` file beside it are laid
over it first.  Both are read one after the other, so a checkpoint in between can leave a database that does not open; that is
an error, and the next scan reads it again.
After that all is DataFrames: sessions, messages and usage rows of all databases are joined and aggregated by Spark in one
plan; ids carry their database's path until rows of different databases may meet."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import canon
from ..plans.steps import lookup, written
from .base import WHOLE, plain_path, reading, walk
from .wal import overlaid

COUNTERS = ("input", "output", "cache_read", "cache_write", "reasoning")


# ---------------------------------------------------------------- files
def rows_of(data: bytes, tables: list[str]) -> Iterator[tuple[str, str]]:
    """(table, row as JSON) of the tables that a database has; bytes become text where they are UTF-8, else null."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data[:18] + b"\x01\x01" + data[20:])  # a file in WAL mode opens as one without
        have = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        for table in tables:
            if table not in have:
                continue
            at = db.execute(f'SELECT * FROM "{table}"')
            names = [d[0] for d in at.description]
            for row in at:
                plain = [v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in row]
                yield table, json.dumps(dict(zip(names, plain)), ensure_ascii=False)
    finally:
        db.close()


def read_sqlite(spark: SparkSession, roots: list[str], tables: list[str], glob: str = "*.db") -> tuple[DataFrame, DataFrame]:
    """(rows, errors): path, mtime, size, tab, row of every database below the roots; and source_path, error of those that
    cannot be read and of folders that cannot be listed."""
    files, broken = walk(spark, roots, (glob, f"{glob}-wal"))
    large = files.where(F.col("length") > WHOLE).select(F.col("path").alias("source_path"), F.lit("too large to be read whole").alias("error"))
    load = lambda paths, g: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).option("ignoreMissingFiles", "true").load(paths).select(plain_path().alias("path"), "content")
    fine = files.where((F.col("length") <= WHOLE) & (F.col("length") > 0))
    contents = reading(spark, fine, roots, (glob,), load, not broken.isEmpty())
    if contents is None:
        return spark.createDataFrame([], "path string, mtime long, size long, tab string, row string"), broken.unionByName(large)
    logs = reading(spark, fine.where(F.col("path").endswith("-wal")), roots, (f"{glob}-wal",), load, not broken.isEmpty())
    logs = spark.createDataFrame([], "path string, wal binary") if logs is None else logs.select(F.regexp_replace("path", "-wal$", "").alias("path"), F.col("content").alias("wal"))
    both = contents.join(logs, "path", "left").join(files.select("path", "mtime", "length"), "path").select("path", "mtime", "length", "content", "wal")
    kinds = {"path": pa.string(), "mtime": pa.int64(), "size": pa.int64(), "tab": pa.string(), "row": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), kinds.values())], names=list(kinds))

        for batch in batches:
            for k in range(batch.num_rows):  # one database at a time
                path, mtime, size = (batch.column(i)[k].as_py() for i in range(3))
                held = []
                try:
                    data = overlaid(batch.column(3)[k].as_py(), batch.column(4)[k].as_py())
                    for table, row in rows_of(data, tables):
                        held.append((path, mtime, size, table, row, None))
                        if len(held) >= 5000:
                            yield out(held)
                            held = []
                except sqlite3.Error as e:  # one broken database leaves the others
                    held = [(path, mtime, size, None, None, str(e)[:500])]
                if held:
                    yield out(held)

    found = written(both.mapInArrow(run, "path string, mtime long, size long, tab string, row string, error string"), "sqlite")
    bad = found.where("error is not null").select(F.col("path").alias("source_path"), "error")
    rows = found.where("error is null").drop("error")
    if not bad.isEmpty():  # of a database that broke off, no row counts
        rows = written(rows.join(bad.select(F.col("source_path").alias("path")), "path", "left_anti"), "sqlite")
    return rows, broken.unionByName(large).unionByName(bad)


#: Between a database's path and an id.
MARK = "\x1f"


def composite(rows: DataFrame, *columns: str) -> DataFrame:
    """Ids with their database's path before them, so that rows of several databases go through one plan; written, as
    the ids are read many times."""
    return written(rows.withColumns({c: F.when(F.trim(c) != "", F.concat("path", F.lit(MARK), F.col(c))).otherwise(F.col(c)) for c in columns}), "ids")


def plain_id(c: str | Column) -> Column:
    """An id without its database's path."""
    return F.regexp_replace(c, f"^[^{MARK}]*{MARK}", "")


def table_of(rows: DataFrame, name: str, columns: str) -> DataFrame:
    """One table of ``read_sqlite``'s rows with typed columns; those that a database lacks are null."""
    kind = T.StructType([T.StructField(n, _KINDS[t]) for n, t in (c.split() for c in columns.split(", "))])
    return rows.where(F.col("tab") == name).select("path", F.from_json("row", kind).alias("r")).select("path", "r.*")


_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}


# ---------------------------------------------------------------- expressions
def blank_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def counter(c: str | Column) -> Column:
    """A counter that is there and not negative, else zero."""
    return F.greatest(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)), F.lit(0)).cast("long")


def epoch_millis(c: str | Column) -> Column:
    """Milliseconds of seconds, or of what is milliseconds already."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c > 1e12, c).otherwise(c * 1000).cast("long")


def total(*columns: Column) -> Column:
    """Sum that stops at the largest long."""
    out = sum((c.cast("decimal(38,0)") for c in columns[1:]), columns[0].cast("decimal(38,0)"))
    return F.least(out, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def json_text(value) -> str:
    """A string as it is, other values as JSON with sorted keys."""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def by_json(f) -> Column:
    """A Pandas UDF that applies ``f`` to parsed JSON; null for null, for what is no JSON, and for None."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else f(json.loads(raw))
            except ValueError:
                return None

        return values.map(one).astype(object).where(lambda x: x.notna(), None)

    return run


def preferred(c: str) -> Column:
    """Aggregate: the longest non-blank text, of ties the greatest."""
    own = blank_null(F.col(c))
    return F.max(F.when(own.isNotNull(), F.struct(F.octet_length(own).alias("n"), own.alias("t"))))["t"]


# ---------------------------------------------------------------- rules on rows
def ancestors(rows: DataFrame, inherits: str | None = None) -> DataFrame:
    """(id, root, and the nearest value of ``inherits`` upwards) over ``parent``; a parent that is no row can be the root,
    and in a cycle it is the first id that is met again.

    One lookup a generation, in written steps; a row is done with at its root."""
    own = rows.select("id", "parent", *([inherits] if inherits else []))
    above = own.select(F.col("id").alias("at"), F.col("parent").alias("__up"), *([F.col(inherits).alias("__value")] if inherits else []))
    value = F.col(inherits) if inherits else F.lit(None).cast("string")
    state = own.select("id", F.col("id").alias("at"), F.array("id").alias("seen"), value.alias("value"), F.lit(False).alias("done"), F.lit(True).alias("first"))
    finished, held = [], []
    while True:
        moved = lookup(state, above, "at", "id")
        got = F.coalesce("value", F.when(~F.col("first"), F.col("__value"))) if inherits else F.col("value")
        again = F.array_contains("seen", F.col("__up"))
        state = written(moved.select(
            "id", F.coalesce("__up", "at").alias("at"), F.when(again | F.col("__up").isNull(), F.col("seen")).otherwise(F.array_append("seen", F.col("__up"))).alias("seen"),
            got.alias("value"), (F.col("__up").isNull() | again).alias("done"), F.lit(False).alias("first"),
        ), "ancestors")
        held.append(state)
        finished.append(state.where("done").select("id", F.col("at").alias("root"), "value"))
        state = state.where("not done")
        if state.isEmpty():
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("value", inherits) if inherits else out.drop("value")


def has_usage() -> Column:
    """A usage row that says anything."""
    return (F.col("api_calls") > 0) | (F.col("total_tokens") > 0) | (F.coalesce("request_attempts", F.lit(0)) > 0) | F.col("actual_cost_usd").isNotNull() | F.col("estimated_cost_usd").isNotNull()


def usage_frame(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``rows`` with all columns of a usage record, enriched."""
    for f in schema.USAGE_RECORD:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("api_calls", "request_attempts", "total_tokens", *(f"{t}_tokens" for t in COUNTERS))}
    rows = rows.withColumns(zero | {"usage_grain": F.coalesce("usage_grain", F.lit("event"))})
    return canon.enrich(rows).select(key, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.USAGE_RECORD])


_TEXTS = ("provider", "model", "provider_family", "provider_inference_source", "provider_inference_confidence", "model_family", "model_variant", "task", "billing_base_url", "billing_mode", "token_semantics", "cost_status", "cost_source", "cost_currency", "pricing_version")
_MOST = ("api_calls", "request_attempts", "reported_total_tokens", "interval_end", "actual_cost_usd", "estimated_cost_usd", *(f"{t}_tokens" for t in COUNTERS))
# Grains from the weakest to the one that a merge keeps.
_GRAINS = ("event", "session_aggregate", "interval_aggregate")


def merged_usage(rows: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Usage rows of one event of a session as one: smallest start, largest counters and costs, longest texts; rows
    without an event stay unless they are equal.  ``idx`` numbers them in the order of time, unknown last."""
    ident = F.trim("source_event_id")
    rows = rows.select(key, *schema.USAGE_RECORD.names).withColumn("__id", F.when(ident != "", ident))
    rank = F.array_position(F.array(*map(F.lit, _GRAINS)), F.col("usage_grain"))
    parts = [F.max(f"{t}_tokens") for t in COUNTERS[:4]]
    whole = total(*parts)
    named = rows.where("__id is not null").groupBy(key, "__id").agg(
        F.count("*").alias("__n"), F.min("timestamp").alias("timestamp"), F.min("interval_start").alias("interval_start"), F.max_by("usage_grain", rank).alias("usage_grain"), F.min("source_event_id").alias("source_event_id"),
        *[preferred(c).alias(c) for c in _TEXTS], *[F.max(c).alias(c) for c in _MOST], F.max("total_tokens").alias("__total"), F.max("component_total_tokens").alias("__component"), whole.alias("__whole"),
    )
    several = F.col("__n") > 1
    named = named.withColumns({"total_tokens": F.when(several, F.greatest("__total", "__whole")).otherwise(F.col("__total")), "component_total_tokens": F.coalesce("__component", F.when(several, F.col("__whole")))})
    plain = rows.where("__id is null").drop("__id").dropDuplicates()
    both = usage_frame(named.select(key, *schema.USAGE_RECORD.names).unionByName(plain), key)
    rest = [c for c in schema.USAGE_RECORD.names if c not in ("timestamp", "source_event_id", "provider", "model")]
    order = [F.col("timestamp").isNull(), F.col("timestamp"), *[F.asc_nulls_first(c) for c in ("source_event_id", "provider", "model", "api_calls", *(f"{t}_tokens" for t in COUNTERS), "total_tokens", "actual_cost_usd", "estimated_cost_usd")], F.to_json(F.struct(*rest))]
    return both.withColumn("idx", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def session_rest(sessions: DataFrame, projected: DataFrame, key: str = "conversation_id") -> DataFrame:
    """``sessions`` (a usage row each, of the whole session) less what its ``projected`` rows hold, never below zero, where
    anything is left.  A cost that is zero is kept only where nothing is projected."""
    counted = ["api_calls", "total_tokens", *(f"{t}_tokens" for t in COUNTERS)]
    money = ("actual_cost_usd", "estimated_cost_usd")
    paid = lambda c: F.sum(F.when(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf")), c))
    sums = projected.groupBy(key).agg(F.count("*").alias("__rows"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(f"__{c}") for c in counted], *[paid(F.col(c)).alias(f"__{c}") for c in money], paid(F.coalesce(*money)).alias("__any_cost"))
    both = sessions.join(sums, key, "left")
    left = {c: F.greatest(F.col(c).cast("decimal(38,0)") - F.coalesce(f"__{c}", F.lit(0)), F.lit(0)).cast("long") for c in counted}
    for c in money:
        spare = F.greatest(F.col(c) - F.coalesce(f"__{c}", F.lit(0.0)), F.lit(0.0))
        left[c] = F.when(F.col(c).isNull() | (F.col(c) < 0), None).when(F.col("__rows").isNull() & (F.col(c) == 0), 0.0).when(spare > 2.220446049250313e-16, spare)
    return both.withColumns(left)


def assembled(sessions: DataFrame, messages: DataFrame, usage: DataFrame, agent: str, files: DataFrame | None = None) -> DataFrame:
    """Conversation records of ``sessions`` (external_id and the facts of a conversation) with their messages and usage
    (conversation_id: the external id), in order; sessions with neither are left out.  The fingerprint covers all of it."""
    said = F.struct("idx", "role", "content", "timestamp", "model").cast(schema.MESSAGE_RECORD)
    said = messages.groupBy(F.col("conversation_id").alias("external_id")).agg(F.array_sort(F.collect_list(said)).alias("messages"))
    used = F.struct("idx", F.struct(*schema.USAGE_RECORD.names).cast(schema.USAGE_RECORD).alias("u"))
    used = usage.groupBy(F.col("conversation_id").alias("external_id")).agg(F.transform(F.array_sort(F.collect_list(used), lambda a, b: a["idx"] - b["idx"]), lambda x: x["u"]).alias("usage"))
    rows = sessions.join(said, "external_id", "left").join(used, "external_id", "left").where("messages is not null or usage is not null")
    for name, kind in (("messages", schema.MESSAGE_RECORD), ("usage", schema.USAGE_RECORD)):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(T.ArrayType(kind))))
    first = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    from ..functions import text

    rows = rows.withColumns({
        "agent": F.lit(agent), "title": F.coalesce(blank_null(F.col("title")), text.truncated(text.first_line(first), 100)),
        "source_files": F.col("source_files") if "source_files" in sessions.columns else F.array().cast(T.ArrayType(schema.SOURCE_FILE)),
    })
    facts = F.to_json(F.struct("external_id", "title", "workspace", "started_at", "ended_at", "messages", "usage", "logical_session_id", "parent_external_id", "record_kind", "is_synthetic"))
    rows = rows.withColumns({
        "source_fingerprint": F.concat(F.lit(f"{agent}-v{schema.PARSER_REVISIONS[agent]}:"), F.sha2(facts, 256)),
        "source_mtime_max": F.coalesce(F.array_max(F.transform("source_files", lambda f: f["mtime"])), F.lit(0).cast("long")),
    })
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.CONVERSATION_RECORD])

