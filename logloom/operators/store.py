"""The store: Parquet segments under one folder, with upsert, cleanup, derived index and statistics.

A change appends a segment to each table that it touches, a list of ids whose older rows no longer count, and last a
state file with the next number, made only if no one else made it.  A reader takes the highest state and sees all of a
change or nothing of it; a crash leaves the state before.  What a change writes follows the change, not the store: readers
drop dead rows by a join with the ids, and every ``COMPACT`` segments a table is written anew.  Files that no state of the
last two names are deleted.

Keys: ``source_path`` of a conversation; ids are hashes of it, hence the same whichever executor makes them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import canon, text
from ..plans.steps import lookup, written
from . import search

_SEARCH = "id long, title string, content string, preview string, agent string, workspace string, source_path string, created_at long, title_length int, content_length int"
TABLES = {
    "conversations": schema.CONVERSATIONS, "messages": schema.MESSAGES, "usage_events": schema.USAGE_EVENTS, "embeddings": schema.EMBEDDINGS,
    "search_docs": _SEARCH, "postings": "field string, term string, id long, length int, tf long, positions array<int>", "failed": "source_path string, error string",
}
#: The column by which a conversation's rows are told, of the tables that have it.
KEYS = {"conversations": "id", "messages": "conversation_id", "usage_events": "conversation_id", "embeddings": "conversation_id", "search_docs": "id", "postings": "id"}
#: A digest of the index tables' columns; an index of other columns is built anew.
INDEX_SCHEMA = hashlib.sha256(f"{TABLES['search_docs']}|{TABLES['postings']}".encode()).hexdigest()
#: Steps from older versions, by the version that they lead to.
MIGRATIONS = ((schema.SCHEMA_VERSION, "_provenance"),)
#: Segments of a table after which it is written anew.
COMPACT = 32


# ---------------------------------------------------------------- rules on rows
def titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """id, title: the own one, else the first user message's first line, else Untitled."""
    first = messages.where("role = 'user'").groupBy(F.col("conversation_id").alias("id")).agg(F.min_by("content", "idx").alias("__first"))
    return conversations.join(first, "id", "left").select("id", text.title("title", "__first").alias("title"))


def full_texts(messages: DataFrame) -> DataFrame:
    """id, content (``[role] text`` by blank lines, in order), n_messages."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return messages.groupBy(F.col("conversation_id").alias("id")).agg(parts.alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("content"), F.size("p").alias("n_messages"))


def normalized_messages(messages: DataFrame) -> DataFrame:
    """Rows in the order (timestamp, role, model, content), without repeats, numbered anew."""
    cols = ["timestamp", "role", "model", "content"]
    order = W.partitionBy("conversation_id").orderBy(*cols)
    return messages.dropDuplicates(["conversation_id", *cols]).withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def roots(rows: DataFrame) -> DataFrame:
    """(id, root): the topmost known ancestor over ``parent``; in a cycle, its smallest id.

    Pointers are doubled: after k rounds a row has seen 2^k ancestors and the smallest of them, so the rounds are
    the logarithm of the longest chain, or of the number of rows where there is a cycle."""
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("__k"))
    at = rows.join(known, "parent", "left").select("id", F.when(F.col("__k"), F.col("parent")).otherwise(F.col("id")).alias("up"))
    at = at.withColumn("low", F.least("id", "up"))
    rounds = max(1, rows.count().bit_length() + 1)
    for _ in range(rounds):
        ahead = at.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("low").alias("__low"))
        at = lookup(at, ahead, "up", "id", "inner").select("id", F.col("__up").alias("up"), F.least("low", "__low").alias("low"), (F.col("__up") != F.col("up")).alias("moved"))
        at = written(at, "roots")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    tops = rows.where("parent is null or parent = id").select(F.col("id").alias("up"))
    tops = tops.unionByName(rows.join(known, "parent", "left_anti").select(F.col("id").alias("up"))).distinct().withColumn("top", F.lit(True))
    return at.join(tops, "up", "left").select("id", F.when(F.col("top"), F.col("up")).otherwise(F.col("low")).alias("root"))


def residual(sessions: DataFrame, projected: DataFrame, counters: list[str], key: str = "conversation_id") -> DataFrame:
    """What the session aggregates hold beyond the sum of their projected rows, per counter and never below zero."""
    sums = projected.groupBy(key).agg(*[F.sum(c).alias(f"__{c}") for c in counters])
    rest = {c: F.greatest(F.coalesce(c, F.lit(0)) - F.coalesce(f"__{c}", F.lit(0)), F.lit(0)).cast(sessions.schema[c].dataType) for c in counters}
    some = F.lit(False)
    for c in counters:
        some = some | (F.col(c) > 0)
    return sessions.join(sums, key, "left").withColumns(rest).where(some).select(key, *counters)


def change_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_path, class: insert, update, delete or unchanged, by fingerprint."""
    o = old.select("source_path", F.col("source_fingerprint").alias("of"), F.lit(True).alias("o"))
    n = new.select("source_path", F.col("source_fingerprint").alias("nf"), F.lit(True).alias("n"))
    both = o.join(n, "source_path", "full_outer")
    kind = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(~F.col("of").eqNullSafe(F.col("nf")), "update").otherwise("unchanged")
    return both.select("source_path", kind.alias("class"))


def stats(conversations: DataFrame, messages: DataFrame, scope=None) -> DataFrame:
    """Per agent: conversations and messages in scope, and the whole store's last index time."""
    own = conversations if scope is None else conversations.where(canon.in_scope("workspace", scope, below_ignores_case=True))
    n = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    rows = own.join(n, own["id"] == n["conversation_id"], "left").groupBy("agent").agg(F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))
    return rows.crossJoin(conversations.agg(F.max("indexed_at").alias("last_indexed_at")))  # by one row


def search_rows(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The corpus of ``search``."""
    body = full_texts(messages)
    named = titles(conversations, messages).withColumnRenamed("title", "__title")
    rows = conversations.join(named, "id").join(body, "id", "left")
    content = F.coalesce("content", F.lit(""))
    return rows.select(
        "id", F.col("__title").alias("title"), content.alias("content"), text.preview(content).alias("preview"), "agent", F.coalesce("workspace", F.lit("")).alias("workspace"), "source_path", F.coalesce("started_at", F.lit(0)).alias("created_at"),
        F.size(text.terms(F.coalesce("__title", F.lit("")))).alias("title_length"), F.size(text.terms(content)).alias("content_length"),
    )


def known(column: str, values, what: str) -> Column:
    """The column's value; one that is not among ``values`` is an error, no default."""
    bad = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(column, F.lit("null"))))
    return F.when(F.col(column).isin(*values), F.col(column)).otherwise(bad)


def checked(rows: DataFrame) -> DataFrame:
    """Rows whose agents are slugs."""
    return rows.withColumn("agent", known("agent", schema.AGENTS, "agent"))


# ---------------------------------------------------------------- the store
class Store:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = self._state()
        version = held["meta"].get("schema_version", schema.SCHEMA_VERSION)
        if not 0 <= int(version) <= schema.SCHEMA_VERSION:
            raise ValueError(f"schema version {version} is not supported")
        if not read_only and int(version) < schema.SCHEMA_VERSION:
            self.migrate(int(version))

    # a state: {"number", "tables": {name: [[segment number, folder], ...]}, "gone": [[number, folder], ...], "meta": {key: value}}
    def _numbers(self) -> list[int]:
        at = self._path(self.path)
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[6:-5]) for n in names if n.startswith("STATE-") and n.endswith(".json"))

    def _state(self, number: int | None = None) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "tables": {}, "gone": [], "meta": {}}
        stream = self._fs.open(self._path(f"{self.path}/STATE-{number or numbers[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, state: dict) -> None:
        """Make the next state visible: written aside, then renamed to a name that must not exist."""
        if self.read_only:
            raise RuntimeError("the store is open for reading only")
        number = state["number"] + 1
        aside, at = self._path(f"{self.path}/.state-{uuid.uuid4().hex}"), self._path(f"{self.path}/STATE-{number:012d}.json")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(state | {"number": number}).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(aside, at):
            self._fs.delete(aside, False)
            raise RuntimeError(f"another writer made state {number}")
        self._sweep(number)

    def _sweep(self, number: int) -> None:
        """Delete states before the last one, and folders that neither names."""
        kept = [n for n in self._numbers() if n >= number - 1]
        named: set[str] = set()
        for n in kept:
            state = self._state(n)
            named |= {f for own in (*state["tables"].values(), state["gone"]) for _, f in own}
        for f in self._fs.listStatus(self._path(self.path)):
            name = f.getPath().getName()
            old = name.startswith("STATE-") and int(name[6:-5]) not in kept
            if old or name.startswith("segment-") and name not in named and int(name.split("-")[1]) < number:
                self._fs.delete(f.getPath(), True)

    def _segment(self, rows: DataFrame, name: str, number: int) -> str:
        folder = f"segment-{number:012d}-{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def table(self, name: str) -> DataFrame:
        return self._rows(self._state(), name)

    def _rows(self, state: dict, name: str) -> DataFrame:
        segments = state["tables"].get(name)
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        key = KEYS.get(name)
        gone = [(n, f) for n, f in state["gone"] if key and n > segments[0][0]]
        rows = None
        for number, folder in segments:
            own = self.spark.read.parquet(f"{self.path}/{folder}")
            for f in TABLES[name] if isinstance(TABLES.get(name), T.StructType) else ():  # columns that an older version lacks
                if f.name not in own.columns:
                    own = own.withColumn(f.name, F.lit(None).cast(f.dataType))
            own = own.withColumn("__segment", F.lit(number).cast("long")) if gone else own
            rows = own if rows is None else rows.unionByName(own)
        if not gone:
            return rows
        dead = self.spark.read.parquet(*[f"{self.path}/{f}" for _, f in gone]).groupBy(F.col("id").alias(key)).agg(F.max("number").alias("__dead"))
        return rows.join(dead, key, "left").where(F.col("__dead").isNull() | (F.col("__segment") >= F.col("__dead"))).drop("__dead", "__segment")

    def meta(self, key: str, default=None):
        return self._state()["meta"].get(key, default)

    def set_meta(self, **values) -> None:
        state = self._state()
        state["meta"] |= values
        self._point(state)

    def replace(self, tables: dict[str, DataFrame], **meta) -> None:
        """New contents of all given tables, visible together."""
        state = self._state()
        number = state["number"] + 1
        for name, rows in tables.items():
            state["tables"][name] = [[number, self._segment(rows, name, number)]]
        state["meta"] |= {"schema_version": schema.SCHEMA_VERSION, **meta}
        self._point(self._pruned(state))

    @staticmethod
    def _pruned(state: dict) -> dict:
        """Without lists of dead ids that are older than all rows."""
        first = min((own[0][0] for name, own in state["tables"].items() if name in KEYS and own), default=0)
        return state | {"gone": [[n, f] for n, f in state["gone"] if n > first]}

    def change(self, added: dict[str, DataFrame], gone: DataFrame | None = None, **meta) -> None:
        """Append rows to the given tables; rows of ids in ``gone`` that any table holds so far no longer count."""
        state = self._state()
        number = state["number"] + 1
        if gone is not None:
            state["gone"].append([number, self._segment(gone.select("id").distinct().withColumn("number", F.lit(number).cast("long")), "gone", number)])
        for name, rows in added.items():
            state["tables"].setdefault(name, []).append([number, self._segment(rows, name, number)])
        state["meta"] |= {"schema_version": schema.SCHEMA_VERSION, **meta}
        self._point(state)
        if max((len(own) for own in state["tables"].values()), default=0) >= COMPACT or len(state["gone"]) >= COMPACT:
            self.compact()

    def compact(self) -> None:
        """Every table in one segment, without dead rows."""
        state = self._state()
        self.replace({name: self._rows(state, name) for name, own in state["tables"].items() if own})

    def migrate(self, version: int) -> None:
        """The steps that are newer than a version, in order; each is one change, with its number."""
        for number, step in MIGRATIONS:
            if number > version:
                getattr(self, step)()
                self.set_meta(schema_version=number)

    def _provenance(self) -> None:
        """Backfill of the provenance columns: blanks become null, totals and a cost status are derived."""
        rows = self.table("usage_events")
        blank = {f.name: F.nullif(F.col(f.name), F.lit("")) for f in schema.USAGE_EVENTS if f.dataType.simpleString() == "string"}
        rows = canon.enrich(rows.withColumns({**blank, "usage_grain": F.coalesce("usage_grain", F.lit("event"))}))
        own = self.table("conversations")
        own = own.withColumns({"logical_session_id": F.coalesce("logical_session_id", F.nullif("external_id", F.lit(""))), "record_kind": F.coalesce("record_kind", F.lit("top_level")), "is_synthetic": F.coalesce("is_synthetic", F.lit(False))})
        self.replace({"usage_events": rows.select(*schema.USAGE_EVENTS.names), "conversations": own.select(*schema.CONVERSATIONS.names)})

    # ------------------------------------------------------------ writing
    def dry_run(self, scanned: DataFrame, missing: DataFrame | None = None) -> dict[str, int]:
        """How many rows an ``upsert`` would insert and update, and a cleanup delete."""
        classes = change_classes(self.table("conversations"), scanned)
        counts = {r["class"]: r["n"] for r in classes.groupBy("class").agg(F.count("*").alias("n")).collect()}
        out = {k: counts.get(k, 0) for k in ("insert", "update", "unchanged")}
        return out | {"delete": missing.where("state = 'missing'").count() if missing is not None else 0, "uncertain": missing.where("state = 'uncertain'").count() if missing is not None else 0}

    def upsert(self, scanned: DataFrame, now_ms: int) -> dict[str, int]:
        """Insert new conversations and replace those whose fingerprint changed, with all that belongs to them."""
        old = self.table("conversations")
        scanned = checked(scanned).dropDuplicates(["source_path"]).withColumn("id", F.xxhash64("source_path"))
        fresh = scanned.join(old.select("source_path", F.col("source_fingerprint").alias("__f")), "source_path", "left").where(F.col("__f").isNull() | (F.col("__f") != F.col("source_fingerprint")))
        work = f"{self.path}/work-{uuid.uuid4().hex}"
        fresh.withColumn("__new", F.col("__f").isNull()).drop("__f").write.parquet(work)
        fresh = self.spark.read.parquet(work)
        counts = {bool(r["__new"]): r["n"] for r in fresh.groupBy("__new").agg(F.count("*").alias("n")).collect()}
        if not counts:
            self._fs.delete(self._path(work), True)
            return {"inserted": 0, "updated": 0}
        usage = canon.enrich(fresh.select(F.col("id").alias("conversation_id"), F.posexplode("usage").alias("idx", "u")).select("conversation_id", "idx", "u.*"))
        counters = [c for c in usage.columns if c.endswith("_tokens") and not c.startswith(("reported", "component"))] + ["api_calls", "request_attempts"]
        usage = usage.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in counters}).withColumn("usage_grain", F.coalesce("usage_grain", F.lit("event"))).withColumn("usage_grain", known("usage_grain", schema.GRAINS, "grain"))
        messages = fresh.select(F.col("id").alias("conversation_id"), F.explode("messages").alias("m")).select("conversation_id", "m.*").withColumns({"content_hash": F.sha2("content", 256), "role": known("role", sorted(set(schema.ROLES.values())), "role")})
        faux = usage.where(canon.is_synthetic("provider", "model", F.lit(None).cast("string"))).select(F.col("conversation_id").alias("id"), F.lit(True).alias("__faux")).distinct()
        own = fresh.join(faux, "id", "left").withColumns({
            "indexed_at": F.lit(now_ms).cast("long"), "logical_session_id": F.coalesce("logical_session_id", F.nullif("external_id", F.lit(""))),
            "record_kind": F.coalesce("record_kind", F.lit("top_level")), "is_synthetic": F.coalesce("is_synthetic", F.lit(False)) | F.coalesce("__faux", F.lit(False)),
        })
        self.change({
            "conversations": own.select(*schema.CONVERSATIONS.names), "messages": messages.select(*schema.MESSAGES.names), "usage_events": usage.select(*schema.USAGE_EVENTS.names),
            **({"embeddings": self._kept_embeddings(fresh.where("not __new"))} if counts.get(False) else {}),
        }, fresh.where("not __new") if counts.get(False) else None, index_stale=True)
        self._fs.delete(self._path(work), True)
        return {"inserted": counts.get(True, 0), "updated": counts.get(False, 0)}

    def _kept_embeddings(self, updated: DataFrame) -> DataFrame:
        """An update leaves the embedding of a conversation as it is."""
        return self.table("embeddings").join(updated.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi").select(*schema.EMBEDDINGS.names)

    def needs_reindex(self, source_path: str, fingerprint: str) -> bool:
        return self.table("conversations").where((F.col("source_path") == source_path) & (F.col("source_fingerprint") == fingerprint)).isEmpty()

    def has_source_path(self, source_path: str) -> bool:
        return not self.table("conversations").where(F.col("source_path") == source_path).isEmpty()

    def fingerprints(self) -> DataFrame:
        """source_path, source_fingerprint, id of every row."""
        return self.table("conversations").select("source_path", "source_fingerprint", "id")

    def missing(self, existing: DataFrame, detected: list[str]) -> DataFrame:
        """source_path, state of rows of detected agents whose source is not there: ``existing`` has source_path and
        exists (true, false, or null where that is not known); paths that it does not name are missing."""
        rows = self.table("conversations").where(F.col("agent").isin(*detected)).join(existing.select("source_path", "exists", F.lit(True).alias("__n")), "source_path", "left")
        state = F.when(F.col("__n").isNull() | ~F.col("exists"), "missing").when(F.col("exists").isNull(), "uncertain")
        return rows.select("source_path", "id", state.alias("state")).where("state is not null")

    def delete_missing(self, missing: DataFrame) -> int:
        """Remove confirmed rows with all that belongs to them, uncertain ones stay."""
        keys = missing.where("state = 'missing'").select("id")
        n = keys.count()
        if n:
            self.change({}, keys, index_stale=True)
        return n

    def rebuild_index(self) -> int:
        """Search rows and postings from the tables, all anew."""
        self.replace({"search_docs": search_rows(self.table("conversations"), self.table("messages"))})
        docs = self.table("search_docs")
        self.replace({"postings": self._postings(docs)}, index_stale=False, document_format=schema.DOCUMENT_FORMAT, index_schema=INDEX_SCHEMA)
        return docs.count()

    @staticmethod
    def _postings(docs: DataFrame) -> DataFrame:
        return search.all_postings(docs).repartition("term").sortWithinPartitions("term")  # so that a term's rows are found by the statistics of pages

    def refresh_index(self) -> int:
        """Search rows and postings of conversations that have none yet; rows of changed and deleted ones are dead already.
        An index of another format is built anew."""
        if not self._same_format():
            return self.rebuild_index()
        have = self.table("search_docs").select("id")
        fresh = self.table("conversations").join(have, "id", "left_anti")
        if fresh.isEmpty():
            self.set_meta(index_stale=False)
            return 0
        said = self.table("messages").join(fresh.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
        work = f"{self.path}/work-{uuid.uuid4().hex}"
        search_rows(fresh, said).write.parquet(work)
        docs = self.spark.read.parquet(work)
        n = docs.count()
        self.change({"search_docs": docs, "postings": self._postings(docs)}, index_stale=False)
        self._fs.delete(self._path(work), True)
        return n

    def remove_from_index(self, ids: DataFrame) -> None:
        """Search rows and postings of the ids go; their conversations stay, and the next refresh adds them again."""
        state = self._state()
        self.replace({name: self._rows(state, name).join(ids.select("id"), "id", "left_anti") for name in ("search_docs", "postings") if state["tables"].get(name)}, index_stale=True)

    def size(self) -> int:
        """Bytes of all files."""
        at = self._path(self.path)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def doc_count(self) -> int:
        return self.table("search_docs").count()

    def index_is_current(self) -> bool:
        return not self.meta("index_stale", True) and self._same_format()

    def _same_format(self) -> bool:
        """Whether the index has this version's columns and document format."""
        return self.meta("document_format") == schema.DOCUMENT_FORMAT and self.meta("index_schema") == INDEX_SCHEMA

    def embed(self, encode: Callable[[DataFrame], DataFrame]) -> int:
        """Embeddings for conversations that have none; ``encode`` maps (id, text) to (id, embedding)."""
        have = self.table("embeddings").select(F.col("conversation_id").alias("id"))
        docs = self.table("search_docs").join(have, "id", "left_anti").select("id", text.cut_bytes("content", 1000).alias("text"))
        fresh = encode(docs).select(F.col("id").alias("conversation_id"), "embedding")
        before = have.count()
        self.change({"embeddings": fresh})
        return self.table("embeddings").count() - before

    # ------------------------------------------------------------ reading
    def search(self, q: search.SearchQuery, as_of: int, mode: str = "window") -> DataFrame:
        index = self.table("postings")
        docs = self.table("search_docs")
        return search.search(docs, q, as_of, index, search.sizes_of(docs), mode)

    def conversation(self, ident: int | str) -> dict | None:
        """A conversation with its messages and usage, by id or by exact source path."""
        where = F.col("source_path") == ident if isinstance(ident, str) and not ident.lstrip("-").isdigit() else F.col("id") == int(ident)
        own = self.table("conversations").where(where).limit(1).toJSON().collect()
        if not own:
            return None
        out = json.loads(own[0])
        for name in ("messages", "usage_events"):
            out[name] = [json.loads(r) for r in self.table(name).where(F.col("conversation_id") == out["id"]).orderBy("idx").toJSON().collect()]
        return out

    def messages_of(self, ident: int) -> DataFrame:
        return self.table("messages").where(F.col("conversation_id") == ident).orderBy("idx")

    def usage_of(self, ident: int) -> DataFrame:
        return self.table("usage_events").where(F.col("conversation_id") == ident).orderBy(F.coalesce("timestamp", "interval_start"), "idx")

    def all_conversations(self) -> DataFrame:
        """Every conversation with its messages and usage in arrays, by id."""
        said = self.table("messages").groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in schema.MESSAGES.names if c not in ("conversation_id", "idx")]))).alias("messages"))
        used = self.table("usage_events").groupBy(F.col("conversation_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", *schema.USAGE_RECORD.names)), lambda a, b: a["idx"] - b["idx"]).alias("usage"))
        return self.table("conversations").join(said, "id", "left").join(used, "id", "left").orderBy("id")
