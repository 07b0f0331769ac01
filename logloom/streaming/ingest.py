"""Ingestion by plan: full, incremental and as a stream, and a streamed trend."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store
from ..plans.steps import written
from ..sources.base import VIRTUAL, Connector, Scan, existence, scan
from ..sources.roots import COPIES, session_ids, without_copies

INCOMPLETE = "__incomplete__"
#: An index younger than this needs no refresh.
MAX_AGE_MS = 15 * 60 * 1000


def plan_key(connector: Connector, roots: list[str]) -> str:
    """Changes with the parser or the roots; a change makes the next scan a full one."""
    return hashlib.sha256(f"{connector.revision}|{'|'.join(sorted(roots))}".encode()).hexdigest()


def is_fresh(store: Store, now_ms: int, max_age_ms: int = MAX_AGE_MS) -> bool:
    """A cursor in the future counts as of now."""
    last = store.meta("last_scan_ts")
    return last is not None and max(0, now_ms - last) <= max_age_ms


def index(store: Store, connectors: dict[str, Connector], roots: dict[str, list[str]], full: bool = False, now_ms: int | None = None, dry_run: bool = False, unlisted: frozenset[str] = frozenset()) -> dict:
    """Scan detected agents, upsert, clean up, rebuild; the cursor moves only if every scan was complete.

    Incremental scans read files changed since the cursor, and files or sessions of any age that the store lacks.  Sources that
    may hold copies of another one's sessions come behind it, and sessions whose id a header of the other one's files or the
    store's rows of it name are left out.  Only a complete scan deletes, and only what the file system says is gone; agents in
    ``unlisted`` may have folders that ``roots`` lacks, so their scans are not complete."""
    now = now_ms if now_ms is not None else int(time.time() * 1000)
    spark, since = store.spark, None if full else store.meta("last_scan_ts")
    began = time.monotonic()
    out = {"inserted": 0, "updated": 0, "deleted": 0, "agents": [], "finished": [], "complete": True}
    report = {"insert": 0, "update": 0, "delete": 0, "uncertain": 0}
    plans = {}
    for agent in sorted(connectors, key=lambda a: a in COPIES):  # originals first
        connector = connectors[agent]
        if not roots.get(agent):
            continue
        out["agents"].append(agent)
        key = plan_key(connector, roots[agent])
        bounded = since if since is not None and store.meta(f"plan:{agent}") == key else None
        held = store.table("conversations").where(F.col("agent") == agent).select("source_path")
        found = scan(spark, connector, roots[agent], bounded, held if bounded is not None else None, store.meta(f"files:{agent}"))
        rows, complete = found.conversations, found.complete and agent not in unlisted
        if (other := COPIES.get(agent)) is not None:
            rows = without_copies(rows, _originals(store, other, roots.get(other, [])))
        plans[f"plan:{agent}"] = key if complete else INCOMPLETE
        if complete and found.mark is not None:
            plans[f"files:{agent}"] = found.mark
        out["complete"] &= complete
        gone = absent(store, agent, found) if complete and not found.unchanged else None
        if dry_run:
            own = store.dry_run(rows, gone)
            report = {k: v + own[k] for k, v in report.items()}
            continue
        counts = store.upsert(rows, now)
        if complete:
            out["finished"].append(agent)
        out["inserted"] += counts["inserted"]
        out["updated"] += counts["updated"]
        out["deleted"] += store.delete_missing(gone) if gone is not None else 0
    if dry_run:
        return report
    store.set_meta(**plans, **({"last_scan_ts": now} if out["complete"] and plans else {}))
    if not store.index_is_current():
        store.refresh_index()
    out["took_ms"] = int((time.monotonic() - began) * 1000)
    return out


def _originals(store: Store, agent: str, roots: list[str]) -> DataFrame:
    """external_id of all sessions of an agent: of the headers of its files, and of its rows in the store."""
    held = store.table("conversations").where(F.col("agent") == agent).select("external_id")
    return held.unionByName(session_ids(store.spark, roots)) if roots else held


def absent(store: Store, agent: str, found: Scan) -> DataFrame:
    """Rows of an agent that a complete scan did not find: missing where the file system says so, or where a source that loads
    its roots itself has no such session; uncertain where that cannot be told.  A file that is there but no longer below the
    roots, or no longer of the source's names, stays."""
    there = found.present.distinct().withColumn("exists", F.lit(True))
    rest = store.table("conversations").where(F.col("agent") == agent).select("source_path").join(there.select("source_path"), "source_path", "left_anti")
    virtual = F.col("source_path").contains(VIRTUAL)
    asked = existence(rest.where(~virtual)).unionByName(rest.where(virtual).withColumn("exists", F.lit(False)))
    return written(store.missing(there.unionByName(asked), [agent]), "absent")


def stream(store: Store, connector: Connector, roots: list[str], checkpoint: str) -> int:
    """New files since the stream's checkpoint, once each, upserted batch by batch; returns the number of batches.

    Files that cannot be parsed are kept in the table ``failed`` and tried again by the next run."""
    spark, batches = store.spark, []
    again = [r[0] for r in store.table("failed").select("source_path").collect()]
    if again:
        found = scan(spark, connector, again)  # a name is a root of one file
        store.upsert(found.conversations, int(time.time() * 1000))
        store.replace({"failed": found.errors})
    schema = "path string, modificationTime timestamp, length long, content binary"

    def upsert(batch: DataFrame, number: int) -> None:
        paths = [r[0] for r in batch.select("path").distinct().collect()]  # names of a batch's files, at most maxFilesPerTrigger
        if paths:
            found = scan(spark, connector, paths)
            store.upsert(found.conversations, int(time.time() * 1000))
            if not found.complete:
                store.change({"failed": found.errors})
            batches.append(number)

    for k, (root, glob) in enumerate((r, g) for r in roots for g in connector.globs):
        rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1000).load(root)
        rows.select("path").writeStream.foreachBatch(upsert).option("checkpointLocation", f"{checkpoint}/{k}").trigger(availableNow=True).start().awaitTermination()
    return len(batches)


def trend_stream(events: DataFrame, late: str = "1 hour", bucket: str = "1 day") -> DataFrame:
    """An extension: tokens by bucket over a stream of (ts, total_tokens), with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", bucket)).agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("events"))
