"""Sources: transcript files listed and read by Spark's tasks.

A connector names the file patterns of an agent and folds lines, or whole files, into conversations.  ``walk`` lists folders in
tasks, as many levels as a task may see entries; a folder that cannot be read is an error and leaves the scan incomplete,
so that it neither moves a cursor nor deletes.  ``scan`` reads what is to be read: all, files changed since a time, or files
whose path is not known."""

from __future__ import annotations

import base64
import re
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..plans.steps import written
from .lines import Folded, read, records

#: Entries that a task lists before it hands the folders that are left on to other tasks.
ENTRIES = 10_000
#: Up to so many files are read by their names; beyond, the roots are read and joined with the listing.
NAMES = 10_000
#: Bytes that a file read whole may have, as Spark holds it in one value.
WHOLE = (1 << 31) - 1 - 64


@dataclass(frozen=True)
class Connector:
    """``fold`` makes conversations of the lines of files that match ``globs``, ``whole`` of (path, value) of those that match
    ``objects``.  A connector with ``load`` reads its roots itself: it gives (conversations, errors)."""

    agent: str
    globs: tuple[str, ...]
    fold: Callable[..., Folded] | None = None
    objects: tuple[str, ...] = ()
    whole: Callable[[DataFrame], Folded] | None = None
    on_error: str = "skip"  # skip: leave the file out, scan incomplete; fail: raise; skip_agent: no rows of this agent
    load: Callable[[SparkSession, list[str]], Scan] | None = None
    inventory: Callable[[SparkSession, list[str]], DataFrame] | None = None  # source_path, external_id of all sessions that ``load`` would find
    keep: str | None = None  # a pattern that paths have to hold
    headers: bool = False  # sessions name files as their parents

    @property
    def revision(self) -> int:
        return schema.PARSER_REVISIONS[self.agent]


@dataclass
class Scan:
    conversations: DataFrame
    errors: DataFrame
    unchanged: bool = False  # nothing was read, as no file of the source is newer than asked for
    present: DataFrame | None = None  # source_path of all that there is, read or not
    mark: str | None = None  # a digest of the listing

    @property
    def complete(self) -> bool:
        return self.errors.isEmpty()


def outermost(roots: list[str]) -> list[str]:
    """Roots without repeats and without those below another one."""
    plain = sorted({r.rstrip("/") or "/" for r in roots})
    return [r for r in plain if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in plain)]


def plain_path(column: str = "path"):
    return F.regexp_replace(column, "^file:/*", "/")


def literal(path: str) -> str:
    """A path as Spark's readers take it, with no pattern in it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


# ---------------------------------------------------------------- listing
_LISTED = "path string, mtime long, length long, kind string, error string"


def _entries(folder: str, globs: tuple[str, ...], limit: int) -> Iterator[tuple]:
    """(path, mtime, length, kind, error) of what lies below a folder or is that file; kinds: file, folder (not listed yet), error."""
    import os

    stack, seen = [folder], 0
    while stack:
        at = stack.pop()
        if seen >= limit:
            yield at, None, None, "folder", None
            continue
        try:
            found = os.stat(at)
            if stat.S_ISDIR(found.st_mode):
                below = sorted(os.path.join(at, e) for e in os.listdir(at))
                seen += len(below)
                # a link to a folder above would never end
                stack += [b for b in below if not (os.path.islink(b) and (os.path.realpath(at) + "/").startswith(os.path.realpath(b) + "/"))]
            elif stat.S_ISREG(found.st_mode) and any(fnmatchcase(os.path.basename(at), g) for g in globs):
                yield at, int(found.st_mtime * 1000), found.st_size, "file", None
        except (FileNotFoundError, NotADirectoryError):  # gone meanwhile, or a link to nothing
            continue
        except OSError as e:
            yield at, None, None, "error", f"{type(e).__name__}: {e.strerror}"


def walk(spark: SparkSession, roots: list[str], globs: tuple[str, ...], keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, errors): path, mtime (milliseconds), length of all files below the roots that match; and source_path, error of
    what cannot be listed.  Roots with a scheme other than ``file`` are listed by Spark's reader instead, which fails as a whole."""
    plain = [re.sub("^file:/*", "/", r) for r in outermost(roots)]
    local, far = [r for r in plain if r.startswith("/")], [r for r in plain if not r.startswith("/")]
    names = [c.split()[0] for c in _LISTED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = list(_entries(folder, globs, ENTRIES))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = spark.createDataFrame([], _LISTED)
    front = spark.createDataFrame([(r,) for r in local], "path string")
    while local:
        found = written(front.repartition("path").mapInArrow(run, _LISTED), "listing")
        rows, front = rows.unionByName(found.where("kind != 'folder'")), found.where("kind = 'folder'").select("path")
        if front.isEmpty():
            break
    for glob in globs if far else ():
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true").load([literal(r) for r in far])
        rows = rows.unionByName(own.select("path", (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime"), "length", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("error")))
    files = rows.where("kind = 'file'").select("path", "mtime", "length")
    return files.where(F.col("path").rlike(keep)) if keep else files, rows.where("kind = 'error'").select(F.col("path").alias("source_path"), "error")


def existence(paths: DataFrame) -> DataFrame:
    """source_path, exists of given source_paths: false only where the file system says that nothing is there, null where it
    cannot tell."""

    def one(path: str) -> bool | None:
        import os

        try:
            if "://" in path:
                from pyarrow import fs

                system, at = fs.FileSystem.from_uri(path)
                return system.get_file_info(at).type != fs.FileType.NotFound
            os.stat(path)
        except (FileNotFoundError, NotADirectoryError):
            return False
        except Exception:
            return None
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(p) for p in batch.column(0).to_pylist()], pa.bool_())], names=["source_path", "exists"])

    return paths.select("source_path").mapInArrow(run, "source_path string, exists boolean")


# ---------------------------------------------------------------- reading
def reading(spark: SparkSession, files: DataFrame, roots: list[str], globs: tuple[str, ...], load: Callable[[list[str], str], DataFrame], broken: bool = False) -> DataFrame | None:
    """``load(paths, glob)`` of the given files; None if there are none.  Few files, or any where a folder is ``broken``, are
    read by their names; many by their roots, which costs a listing and no pattern of names."""
    def union(frames):
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    if not broken:
        some = files.select("path").limit(NAMES + 1).collect()
        if len(some) > NAMES:
            own = union(load([literal(r) for r in outermost(roots)], g) for g in globs)
            return own.join(files.select("path"), "path", "left_semi")
    else:
        some = files.select("path").collect()
    names = [r[0] for r in some]
    parts = [([literal(n) for n in names if fnmatchcase(n.rsplit("/", 1)[-1], g)], g) for g in globs]
    return union(load(p, g) for p, g in parts if p)


def scan(spark: SparkSession, connector: Connector, roots: list[str], since_ms: int | None = None, known: DataFrame | None = None, mark: str | None = None) -> Scan:
    """Conversations of all files; with ``since_ms`` of those changed since then, with ``known`` (source_path) of those whose path
    it lacks, with both of either.  ``mark`` is the digest of an earlier complete listing: a source that loads its roots itself is
    not read where no file has come, gone or changed since, and only looked through for unknown sessions where files have
    come or gone but none is new."""
    if connector.load is not None:
        return _loaded(spark, connector, roots, since_ms, known, mark)
    files, errors = walk(spark, roots, connector.globs + connector.objects, connector.keep)
    wanted = files
    if since_ms is not None or known is not None:
        new = files.join(known.select(F.col("source_path").alias("path")), "path", "left_anti") if known is not None else files.limit(0)
        wanted = files.where(F.col("mtime") >= since_ms).unionByName(new).dropDuplicates(["path"]) if since_ms is not None else new
    wanted = written(wanted, "wanted")
    rows, bad = conversations_of(spark, connector, wanted, roots, not errors.isEmpty())
    if connector.on_error == "fail" and not bad.isEmpty():
        raise ValueError(f"{connector.agent}: {bad.first()}")
    if connector.on_error == "skip_agent" and not bad.isEmpty():
        rows = rows.limit(0)
    return Scan(rows, errors.unionByName(bad), False, files.select(F.col("path").alias("source_path")))


def _loaded(spark: SparkSession, connector: Connector, roots: list[str], since_ms: int | None, known: DataFrame | None, mark: str | None) -> Scan:
    logs = tuple(f"{g}-wal" for g in connector.globs if g.endswith(".db"))
    files, errors = walk(spark, roots, connector.globs + logs)
    sums = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "mtime", "length").cast("decimal(20,0)")).alias("s"), F.max("mtime").alias("last")).first()
    own, none = f"{sums['n']}:{sums['s']}", spark.createDataFrame([], schema.CONVERSATION_RECORD)
    older = since_ms is not None and (sums["last"] is None or sums["last"] < since_ms)
    if older and own == mark and errors.isEmpty():
        return Scan(none, errors, True, mark=own)
    if older and connector.inventory is not None and known is not None:
        held = written(connector.inventory(spark, roots), "inventory")
        new = held.join(known.select("source_path"), "source_path", "left_anti")
        if new.isEmpty():
            return Scan(none, errors, False, held.select("source_path"), own)
        found = connector.load(spark, roots)
        rows = found.conversations.join(new.select("source_path"), "source_path", "left_semi").select(*found.conversations.columns)
        return Scan(rows, found.errors.unionByName(errors).dropDuplicates(["source_path"]), False, held.select("source_path"), own)
    found = connector.load(spark, roots)
    rows = found.conversations if known is None or since_ms is not None else found.conversations.join(known.select("source_path"), "source_path", "left_anti")
    return Scan(rows, found.errors.unionByName(errors).dropDuplicates(["source_path"]), False, found.conversations.select("source_path"), own)


def conversations_of(spark: SparkSession, connector: Connector, files: DataFrame, roots: list[str], broken: bool = False) -> tuple[DataFrame, DataFrame]:
    """(conversations, errors) of the given files (path, mtime, length) of a connector that folds."""
    folded = []
    lines = reading(spark, files, roots, connector.globs, lambda paths, glob: read(spark, paths, glob), broken)
    if lines is not None:
        more = {"headers": lambda asked: headers_of(spark, asked, roots)} if connector.headers else {}
        folded.append(connector.fold(lines, **more))
    if connector.whole is not None:
        own = lambda paths, glob: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("wholetext", "true").text(paths).select(plain_path("_metadata.file_path").alias("path"), "value")
        values = reading(spark, files.where(F.col("length") <= WHOLE), roots, connector.objects, own, broken)
        if values is not None:
            folded.append(connector.whole(values))
    rows = [written(records(f, files, connector.agent, connector.revision), "scan") for f in folded]
    out, bad = spark.createDataFrame([], schema.CONVERSATION_RECORD), spark.createDataFrame([], "source_path string, error string")
    for own, f in zip(rows, folded):
        out, bad = out.unionByName(own), bad.unionByName(f.errors)
    if connector.objects:
        large = files.where((F.col("length") > WHOLE) & F.col("path").endswith(".json"))
        bad = bad.unionByName(large.select(F.col("path").alias("source_path"), F.lit("too large to be read whole").alias("error")))
    return out, bad


def headers_of(spark: SparkSession, asked: DataFrame, roots: list[str]) -> DataFrame:
    """path, id: the session that each of the given files says it is."""
    there = existence(asked.select(F.col("path").alias("source_path"))).where("exists").select(F.col("source_path").alias("path"))
    rows = reading(spark, written(there, "parents"), roots, ("*",), lambda paths, glob: read(spark, paths, glob))
    if rows is None:
        return spark.createDataFrame([], "path string, id string")
    return session_headers(rows, ("session",))


def session_headers(lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """path, id of the first line of each file that opens a session."""
    from .lines import text_of

    own = lines.where(F.col("line").contains("session")).withColumn("v", F.try_parse_json("line")).where(text_of("v", "type").isin(*kinds))
    return own.withColumn("id", text_of("v", "id")).where("id is not null").groupBy("path").agg(F.min_by("id", F.struct("block", "row")).alias("id"))


# ---------------------------------------------------------------- helpers on JSON
def at(value: Any, path: str) -> Any:
    """The value at a path of keys joined by ``/``, or None."""
    for key in path.strip("/").split("/"):
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return value


def flatten(content: Any) -> str:
    """The text of a message's content: a text, blocks of it, or an object that holds it."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        parts = (b if isinstance(b, str) else next((b[k] for k in ("text", "thinking", "prompt") if isinstance(b.get(k), str)), None) or flatten(b.get("content")) if isinstance(b, dict) else "" for b in content)
        return "\n".join(p for p in parts if p)
    if isinstance(content, dict):
        return next((flatten(content[k]) for k in ("text", "content", "message") if k in content), "")
    return ""


#: In the key of a session that is no file of its own.
VIRTUAL = "/.logloom-sessions/"


def virtual_path(root: str, agent: str, ident: str) -> str:
    """The key of a session that is no file of its own."""
    return f"{root.rstrip('/')}{VIRTUAL}{agent}/{base64.urlsafe_b64encode(ident.encode()).decode().rstrip('=')}"


def virtual_id(path: str, agent: str) -> str | None:
    _, mark, rest = path.rpartition(f"{VIRTUAL}{agent}/")
    return base64.urlsafe_b64decode(rest + "=" * (-len(rest) % 4)).decode() if mark and rest else None
