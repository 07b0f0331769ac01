"""The source with three stores: databases of an older and a newer message schema, and a tree of JSON files.

Each store's tables become message and usage rows by DataFrame expressions; JSON paths are read by Spark, only the
renderings of tools, files and patches by a Pandas UDF.  Sessions that several stores hold are merged by their id."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..operators.store import normalized_messages
from ..plans.steps import lookup, written
from .base import WHOLE, Scan, at, flatten, plain_path, reading, walk
from .database import ancestors, assembled, blank_null, by_json, composite, counter, has_usage, json_text, merged_usage, plain_id, preferred, read_sqlite, session_rest, table_of, total, usage_frame

AGENT = "opencode"
SESSION = "id string, directory string, title string, time_created long, time_updated long, model string, parent_id string, fork_session_id string, agent string, cost double, tokens_input long, tokens_output long, tokens_reasoning long, tokens_cache_read long, tokens_cache_write long"
MESSAGE = "id string, session_id string, time_created long, data string"
PART = "id string, message_id string, time_created long, data string"
SESSION_MESSAGE = "id string, session_id string, type string, seq long, time_created long, data string"
# Labels of the counters' meaning.
EVENT_TOKENS, SESSION_TOKENS = "opencode-event-output-includes-reasoning-v1", "opencode-session-output-includes-reasoning-v1"


# ---------------------------------------------------------------- renderings
def tool_text(v: dict) -> str:
    name = v.get("name", v.get("tool"))
    state = v.get("state") if isinstance(v.get("state"), dict) else {}
    out = [f"[Tool: {name if isinstance(name, str) else 'unknown'}]"]
    if state.get("input") is not None:
        out.append(f"Input: {json_text(state['input'])}")
    result = state["output"] if "output" in state else state.get("result")
    if result is not None:
        out.append(f"Output: {json_text(result)}")
    elif state.get("content") is not None:
        out.append(f"Output: {flatten(state['content']) or json_text(state['content'])}")
    elif state.get("structured") is not None:
        out.append(f"Output: {json_text(state['structured'])}")
    elif state.get("error") is not None:
        out.append(f"Error: {json_text(state['error'])}")
    return "\n".join(out)


def file_text(v: dict) -> str:
    found = [v.get("filename"), v.get("name"), at(v, "source/path"), v.get("url")]
    name = next((x for x in found if x is not None), None)
    mime = v.get("mime") if isinstance(v.get("mime"), str) else None
    out = [f"[Attachment: {name if isinstance(name, str) else 'unnamed'}{f' ({mime})' if mime is not None else ''}]"]
    shown = at(v, "source/text/value")
    if isinstance(shown, str) and shown.strip():
        out.append(shown)
    if mime and (mime.startswith("text/") or mime == "application/json") and isinstance(v.get("data"), str):
        try:
            plain = base64.b64decode(v["data"], validate=True).decode("utf-8")
        except ValueError:
            plain = ""
        if plain.strip():
            out.append(plain)
    return "\n".join(out)


def patch_text(v: dict) -> str:
    files = v.get("files") if isinstance(v.get("files"), list) else []
    return "\n".join(["[Patch]", *map(json_text, files)])


def rendered(v: dict) -> str | None:
    """The text of a tool, file or patch; of other kinds, none."""
    draw = {"tool": tool_text, "file": file_text, "patch": patch_text}.get(v.get("type")) if isinstance(v, dict) else None
    return draw(v) if draw else None


def user_text(v: dict) -> str:
    own = v.get("text") if isinstance(v.get("text"), str) and v["text"].strip() else None
    files = v.get("files") if isinstance(v.get("files"), list) else []
    return "\n".join([*([own] if own else []), *(file_text(f) for f in files if isinstance(f, dict))])


def pieces(v: dict) -> str | None:
    """[[role, text], ...] of an assistant message's content as JSON; its error where it has none."""
    out = []
    for c in v.get("content") if isinstance(v.get("content"), list) else []:
        kind = c.get("type") if isinstance(c, dict) else None
        if kind == "text":
            out.append(["assistant", c.get("text") if isinstance(c.get("text"), str) else ""])
        elif kind in ("tool", "file", "patch"):
            out.append(["assistant" if kind == "file" else "tool", rendered(c)])
    out = [x for x in out if x[1].strip()]
    if not out and "error" in v:
        out = [["assistant", f"[Assistant error] {json_text(v['error'])}"]]
    return json.dumps(out) if out else None


#: A lone surrogate's escape, which stands for no character.
LONE = r"(?i)(\\u[dD][89aAbB][0-9a-fA-F]{2})(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})|(?<!\\u[dD][89aAbB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def repaired(raw: Column) -> Column:
    """JSON text with each lone surrogate's escape replaced."""
    return F.regexp_replace(raw, LONE, "\\\\uFFFD")


# ---------------------------------------------------------------- fields of JSON
def got(raw: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(raw, f"$.{p}") for p in paths])


def whole(raw: Column, *paths: str) -> Column:
    """The first of the paths that holds a non-negative integer, else null."""
    own = [F.get_json_object(raw, f"$.{p}") for p in paths]
    return F.coalesce(*[F.when(v.rlike(r"^\d{1,18}$"), v.cast("long")) for v in own])


def model_of(raw: Column) -> Column:
    return got(raw, "model.id", "model.modelID", "modelID")


def session_model(model: Column) -> tuple[Column, Column, Column]:
    """(model, provider, variant) of a session's model, which is JSON or a plain name."""
    raw = F.when(F.trim(model) != "", F.trim(model))
    return F.coalesce(model_of(raw), raw), got(raw, "providerID", "model.providerID"), got(raw, "model.variant", "variant")


def _price(raw: Column) -> Column:
    own = [F.get_json_object(raw, f"$.{p}") for p in ("cost", "cost.total", "cost_usd")]
    return F.coalesce(*[F.when(v.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), v.cast("double")) for v in own])


def _usage_columns(data: Column, tokens: Column) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    used, out, thought, read, wrote = (F.coalesce(whole(tokens, *p), zero) for p in (("input", "input_tokens"), ("output", "output_tokens"), ("reasoning", "reasoning_tokens"), ("cache.read", "cacheRead"), ("cache.write", "cacheWrite")))
    out = total(out, thought)
    parts, reported, cost = total(used, out, read, wrote), whole(tokens, "total", "totalTokens", "total_tokens"), _price(data)
    return {
        "input_tokens": used, "output_tokens": out, "cache_read_tokens": read, "cache_write_tokens": wrote, "reasoning_tokens": thought, "reported_total_tokens": reported, "component_total_tokens": parts,
        "total_tokens": F.when(reported > 0, reported).otherwise(parts), "estimated_cost_usd": cost, "cost_status": F.when(F.abs(cost) <= 2.220446049250313e-16, "source_reported_zero"), "cost_source": F.when(cost.isNotNull(), "opencode.message.cost"),
    }


def message_usage(rows: DataFrame, failures: bool = False) -> DataFrame:
    """Usage of assistant messages (session_id, id, timestamp, data and the session's s_model, s_provider, s_variant,
    s_agent).  With ``failures``, a message with an error and no usage is an attempt without a call."""
    data = F.col("data")
    tokens = got(data, "tokens", "usage")
    rows = rows.withColumn("__t", tokens)
    common = {
        "conversation_id": F.col("session_id"), "timestamp": F.col("timestamp"), "provider": F.coalesce(got(data, "model.providerID", "providerID"), "s_provider"), "model": F.coalesce(model_of(data), "s_model"),
        "model_variant": F.coalesce(got(data, "model.variant", "variant"), "s_variant"), "task": F.coalesce(got(data, "agent"), "s_agent"), "token_semantics": F.lit(EVENT_TOKENS), "request_attempts": F.lit(1).cast("long"),
        "source_event_id": F.concat(F.lit("opencode-message:"), plain_id("session_id"), F.lit(":"), plain_id("id")),
    }
    cols = lambda more: [v.alias(k) for k, v in (common | more).items()]
    out = usage_frame(rows.where("__t is not null").select(*cols({"api_calls": F.lit(1).cast("long")} | _usage_columns(data, F.col("__t")))))
    if failures:
        failed = rows.where(F.col("__t").isNull() & got(data, "error").isNotNull())
        out = out.unionByName(usage_frame(failed.select(*cols({"api_calls": F.lit(0).cast("long"), "cost_status": F.lit("unknown")}))))
    return out


# ---------------------------------------------------------------- messages
_MESSAGE = ("conversation_id", "role", "content", "timestamp", "model")


def _role(raw: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(raw) == k, v) for k, v in schema.ROLES.items()], F.lit("user"))


def _with_session(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    model, provider, variant = session_model(F.col("model"))
    own = sessions.select(F.col("id").alias("session_id"), model.alias("s_model"), provider.alias("s_provider"), variant.alias("s_variant"), F.col("agent").alias("s_agent"))
    return lookup(rows, own, "session_id", "id", "inner")


def first_schema(sessions: DataFrame, message: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, usage) of the older tables: a message for each part that has a text."""
    rows = _with_session(message, sessions).withColumn("timestamp", F.coalesce(F.get_json_object("data", "$.time.created").try_cast("long"), "time_created"))
    rows = rows.withColumn("role", _role(F.get_json_object("data", "$.role")))
    used = message_usage(rows.where("role = 'assistant'"))
    own = part.select(F.col("message_id").alias("id"), F.col("data").alias("part"))
    both = rows.select("id", "session_id", "timestamp", "role", F.coalesce(model_of(F.col("data")), "s_model").alias("model")).join(own, "id")
    kind = F.get_json_object("part", "$.type")
    drawn = by_json(rendered)(F.when(kind.isin("tool", "file", "patch"), F.col("part")))
    content = F.when(kind == "text", F.get_json_object("part", "$.text")).when(kind == "subtask", F.concat(F.lit("[Subtask] "), F.get_json_object("part", "$.prompt"))).when(kind == "compaction", "[Compaction]").otherwise(drawn)
    role = F.when(kind.isin("tool", "patch"), "tool").when(kind == "compaction", "system").otherwise(F.col("role"))
    said = both.select(F.col("session_id").alias("conversation_id"), role.alias("role"), content.alias("content"), "timestamp", "model")
    return said.where(F.trim("content") != "").select(*_MESSAGE), used


def second_schema(sessions: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, usage) of the newer table."""
    rows = _with_session(rows, sessions).withColumn("timestamp", F.coalesce(F.get_json_object("data", "$.time.created").try_cast("long"), "time_created"))
    field = lambda name: F.coalesce(F.get_json_object("data", f"$.{name}"), F.lit(""))
    kind = F.col("type")
    content = (
        F.when(kind == "user", by_json(user_text)(F.when(kind == "user", F.col("data")))).when(kind.isin("synthetic", "system"), field("text"))
        .when(kind == "skill", F.concat(F.lit("[Skill: "), F.coalesce(F.get_json_object("data", "$.name"), F.lit("unknown")), F.lit("]\n"), field("text")))
        .when(kind == "shell", F.concat(F.lit("[Shell]\nCommand: "), field("command"), F.lit("\nOutput: "), field("output")))
        .when(kind == "compaction", F.concat(F.lit("[Compaction summary]\n"), field("summary"), F.lit("\n"), field("recent")))
    )
    role = F.when(kind == "user", "user").when(kind == "shell", "tool").otherwise("system")
    plain = rows.where(kind.isin("user", "synthetic", "system", "skill", "shell", "compaction")).select(F.col("session_id").alias("conversation_id"), role.alias("role"), content.alias("content"), "timestamp", F.col("s_model").alias("model"))
    spoken = rows.where(kind == "assistant")
    parts = F.from_json(by_json(pieces)(F.col("data")), "array<array<string>>")
    said = spoken.select(F.col("session_id").alias("conversation_id"), F.explode(parts).alias("p"), "timestamp", F.coalesce(model_of(F.col("data")), "s_model").alias("model"))
    said = said.select("conversation_id", F.col("p")[0].alias("role"), F.col("p")[1].alias("content"), "timestamp", "model")
    return plain.unionByName(said).where(F.trim("content") != "").select(*_MESSAGE), message_usage(spoken, failures=True)


# ---------------------------------------------------------------- sessions
def session_facts(sessions: DataFrame) -> DataFrame:
    """external_id, workspace, parent, root, kind of a database's sessions."""
    parent = F.coalesce("parent_id", "fork_session_id")
    roots = ancestors(sessions.select("id", parent.alias("parent")))
    kind = F.when(F.col("parent_id").isNotNull(), "child_agent").when(F.col("fork_session_id").isNotNull(), "fork").otherwise("top_level")
    own = sessions.select(F.col("id").alias("external_id"), F.col("directory").alias("workspace"), "title", "time_created", "time_updated", parent.alias("parent_external_id"), kind.alias("record_kind"), F.lit(False).alias("is_synthetic"))
    return own.join(roots.select(F.col("id").alias("external_id"), F.col("root").alias("logical_session_id")), "external_id")


def session_usage(sessions: DataFrame, projected: DataFrame) -> DataFrame:
    """What the sessions' own counters and cost hold beyond their ``projected`` rows; no calls of its own."""
    model, provider, variant = session_model(F.col("model"))
    used, seen, thought, read, wrote = (counter(f"tokens_{t}") for t in ("input", "output", "reasoning", "cache_read", "cache_write"))
    sums = total(used, total(seen, thought), read, wrote)
    cost = F.when((F.col("cost") > 0) & (F.col("cost") < float("inf")), F.col("cost"))
    rows = sessions.select(
        F.col("id").alias("conversation_id"), provider.alias("provider"), model.alias("model"), variant.alias("model_variant"), F.col("agent").alias("task"), used.alias("input_tokens"), total(seen, thought).alias("output_tokens"), read.alias("cache_read_tokens"),
        wrote.alias("cache_write_tokens"), thought.alias("reasoning_tokens"), sums.alias("total_tokens"), sums.alias("reported_total_tokens"), cost.alias("__cost"), F.col("time_created").alias("interval_start"), F.col("time_updated").alias("interval_end"),
        F.lit("session_aggregate").alias("usage_grain"), F.lit(SESSION_TOKENS).alias("token_semantics"), F.concat(F.lit("opencode-session-aggregate:"), plain_id("id")).alias("source_event_id"), F.lit(0).cast("long").alias("api_calls"),
        F.lit(None).cast("double").alias("actual_cost_usd"), F.lit(None).cast("double").alias("estimated_cost_usd"),
    ).where("total_tokens > 0 or __cost is not null")
    left = session_rest(rows, projected)
    spare = F.greatest(F.col("__cost") - F.coalesce("__any_cost", F.lit(0.0)), F.lit(0.0))
    left = left.withColumns({"estimated_cost_usd": F.when(spare > 2.220446049250313e-16, spare), "component_total_tokens": F.col("total_tokens")}).withColumn("cost_source", F.when(F.col("estimated_cost_usd").isNotNull(), "opencode.session.cost"))
    return usage_frame(left).where(has_usage())


def database(sessions: DataFrame, message: DataFrame | None = None, part: DataFrame | None = None, newer: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, messages, usage) of one database; any of the schemas may be absent."""
    said, used = [], []
    if message is not None and part is not None:
        a, b = first_schema(sessions, message, part)
        said.append(a)
        used.append(b)
    if newer is not None:
        a, b = second_schema(sessions, newer)
        said.append(a)
        used.append(b)
    spark = sessions.sparkSession
    messages = said[0] if len(said) == 1 else said[0].unionByName(said[1]) if said else spark.createDataFrame([], "conversation_id string, role string, content string, timestamp long, model string")
    usage = used[0] if len(used) == 1 else used[0].unionByName(used[1]) if used else usage_frame(spark.createDataFrame([], "conversation_id string"))
    usage = merged_usage(usage).drop("idx")
    usage = usage.unionByName(session_usage(sessions, usage))
    messages = normalized_messages(messages)
    bounds = messages.groupBy(F.col("conversation_id").alias("external_id")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    facts = session_facts(sessions).join(bounds, "external_id", "left")
    facts = facts.withColumns({"started_at": F.coalesce("lo", "time_created"), "ended_at": F.coalesce("hi", "time_updated")}).drop("lo", "hi", "time_created", "time_updated")
    return facts, messages, usage


# ---------------------------------------------------------------- the tree of JSON files
def tree(files: DataFrame, recover: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(facts, messages, usage, broken paths) of ``files`` (path, body, mtime, size) below ``session``, ``message/<session>``
    and ``part/<message>`` folders.  With ``recover``, message folders without a session become recovered sessions."""
    kind = F.regexp_extract("path", r"/(session|message|part)/(?:.*/)?[^/]+\.json$", 1)
    rows = files.where(F.col("path").endswith(".json")).withColumns({"kind": kind, "folder": F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), "body": repaired(F.col("body"))}).where("kind != ''")
    rows = rows.withColumn("fine", F.try_parse_json("body").isNotNull())
    number = lambda p: F.get_json_object("body", f"$.{p}").try_cast("long")
    field = lambda p: F.get_json_object("body", f"$.{p}")
    one = rows.where("kind = 'session' and fine").select(
        field("id").alias("id"), field("projectID").alias("project"), field("directory").alias("directory"), field("title").alias("title"), number("time.created").alias("time_created"), number("time.updated").alias("time_updated"), field("parentID").alias("parent_id"), F.lit(False).alias("recovered"),
    )
    broken = rows.where("not fine").select("path").unionByName(rows.where((F.col("kind") == "session") & F.col("fine") & (field("id").isNull() | field("projectID").isNull())).select("path"))
    one = one.where("id is not null and project is not null").drop("project").dropDuplicates(["id"])
    message = rows.where("kind = 'message' and fine").select(field("id").alias("id"), field("sessionID").alias("session_id"), "folder", _role(field("role")).alias("role"), number("time.created").alias("timestamp"), F.col("body").alias("data"))
    message = message.where("id is not null and session_id is not null")
    if recover:
        lost = message.where("session_id = folder").join(one.select(F.col("id").alias("session_id")), "session_id", "left_anti")
        lost = lost.groupBy(F.col("session_id").alias("id")).agg(F.min("timestamp").alias("time_created"), F.max("timestamp").alias("time_updated"))
        one = one.unionByName(lost.select("id", F.lit(None).cast("string").alias("directory"), F.concat(F.lit("Recovered OpenCode session "), F.col("id")).alias("title"), "time_created", "time_updated", F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("recovered")))
    sessions = one.withColumns({c: F.lit(None).cast("string") for c in ("model", "agent", "fork_session_id")})
    full = _with_session(message, sessions)
    used = message_usage(full.where("role = 'assistant'"))
    part = rows.where("kind = 'part' and fine").select(F.coalesce(field("messageID"), "folder").alias("id"), field("type").alias("type"), field("text").alias("text"), field("prompt").alias("prompt"), field("name").alias("name"))
    content = F.when(F.col("type") == "text", F.col("text")).when(F.col("type") == "subtask", F.concat(F.lit("[Subtask] "), F.col("prompt"))).when(F.col("type") == "tool", F.concat(F.lit("[Tool: "), F.coalesce("name", F.lit("unknown")), F.lit("]")))
    said = full.select("id", "session_id", "role", "timestamp", model_of(F.col("data")).alias("model")).join(part.select("id", content.alias("content")), "id")
    said = said.select(F.col("session_id").alias("conversation_id"), "role", "content", "timestamp", "model").where(F.trim("content") != "")
    bounds = said.groupBy(F.col("conversation_id").alias("external_id")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    roots = ancestors(sessions.select("id", F.col("parent_id").alias("parent")))
    facts = sessions.join(roots, "id").withColumnRenamed("id", "external_id").join(bounds, "external_id", "left")
    facts = facts.select(
        "external_id", F.col("directory").alias("workspace"), "title", F.col("parent_id").alias("parent_external_id"), F.when(F.col("recovered"), "recovered").when(F.col("parent_id").isNotNull(), "child_agent").otherwise("top_level").alias("record_kind"),
        F.col("recovered").alias("is_synthetic"), F.col("root").alias("logical_session_id"), F.coalesce("lo", "time_created").alias("started_at"), F.coalesce("hi", "time_updated").alias("ended_at"),
    )
    return facts, said.select(*_MESSAGE), used, broken


# ---------------------------------------------------------------- several stores
# Kinds of a record, from the one that gives way to all to the one that holds.
_KINDS = ("recovered", "top_level", "fork", "child_agent", "test")


def merged_facts(facts: DataFrame) -> DataFrame:
    """One row for each session of several stores: widest times, longest texts, the strongest kind."""
    rank = F.array_position(F.array(*map(F.lit, _KINDS)), F.col("record_kind"))
    own = F.col("logical_session_id")
    out = facts.groupBy("external_id").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), *[preferred(c).alias(c) for c in ("title", "workspace", "parent_external_id")], F.max_by("record_kind", F.struct(rank, F.col("record_kind"))).alias("record_kind"),
        F.max("is_synthetic").alias("is_synthetic"), preferred("logical_session_id").alias("__any"), F.max(F.when(own != F.col("external_id"), F.struct(F.octet_length(own).alias("n"), own.alias("t"))))["t"].alias("__other"),
    )
    root = F.when(F.col("parent_external_id").isNull(), F.col("__any")).otherwise(F.coalesce("__other", "parent_external_id"))
    return out.withColumn("logical_session_id", root).drop("__any", "__other")


def conversations(stores: list[tuple[DataFrame, DataFrame, DataFrame]], root: str = "") -> DataFrame:
    """Conversation records of several stores' (facts, messages, usage), merged by session."""
    facts, messages, usage = stores[0][0], stores[0][1].select(*_MESSAGE), stores[0][2]
    for f, m, u in stores[1:]:
        facts, messages, usage = facts.unionByName(f), messages.unionByName(m.select(*_MESSAGE)), usage.unionByName(u.select(*usage.columns))
    own = merged_facts(facts)
    messages = normalized_messages(messages)
    first = messages.where("role = 'user'").groupBy(F.col("conversation_id").alias("external_id")).agg(F.min_by("content", "idx").alias("__first"))
    own = own.join(first, "external_id", "left").withColumn("title", F.coalesce(blank_null(F.col("title")), text.truncated(text.first_line("__first"), 100))).drop("__first")
    return assembled(own.withColumn("source_path", _virtual(F.col("external_id"), root)), messages, merged_usage(usage), AGENT)


def inventory(spark: SparkSession, roots: list[str], recover: bool = False) -> DataFrame:
    """source_path, external_id of every session that any store below the roots holds, without reading messages; with
    ``recover``, of the folders of messages as well."""
    rows, _ = read_sqlite(spark, roots, ["session", "sessions"])
    ids = rows.select(F.get_json_object("row", "$.id").alias("external_id"))
    files, _ = _tree_files(spark, roots)
    if recover:
        ids = ids.unionByName(files.where(F.col("path").rlike(r"/message/[^/]+/[^/]+\.json$")).select(F.regexp_extract("path", r"/message/([^/]+)/[^/]+$", 1).alias("external_id")))
    files = files.where(F.col("path").rlike(r"/session/.*\.json$"))
    ids = ids.unionByName(files.select(F.get_json_object("body", "$.id").alias("external_id"))).where("external_id is not null").distinct()
    return ids.select(_virtual(F.col("external_id")).alias("source_path"), "external_id")


def _virtual(ident: Column, root: str = "") -> Column:
    """The store's key of a session."""
    key = F.rtrim(F.translate(F.base64(ident.cast("binary")), "+/", "-_"), F.lit("="))
    return F.concat(F.lit(f"{root.rstrip('/')}/.logloom-sessions/{AGENT}/"), key)


def disjoint(a: DataFrame, b: DataFrame, column: str = "external_id") -> bool:
    """Whether two stores share no value of a column."""
    return a.select(column).join(b.select(column), column, "left_semi").isEmpty()


def unindexed(spark: SparkSession, roots: list[str], known: DataFrame) -> DataFrame:
    """Sessions of the inventory that no row of ``known`` (external_id) stands for."""
    return inventory(spark, roots).join(known.select("external_id"), "external_id", "left_anti").select("external_id")


def _tree_files(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, body, mtime, size of the JSON files below the roots; errors)."""
    files, broken = walk(spark, roots, ("*.json",))
    load = lambda paths, g: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).option("ignoreMissingFiles", "true").load(paths).select(plain_path().alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("body"))
    bodies = reading(spark, files.where(F.col("length") <= WHOLE), roots, ("*.json",), load, not broken.isEmpty())
    if bodies is None:
        return spark.createDataFrame([], "path string, body string, mtime long, size long"), broken
    return written(bodies.join(files.withColumnRenamed("length", "size"), "path"), "tree"), broken


def scan(spark: SparkSession, roots: list[str], recover: bool = False) -> Scan:
    """Conversations of all databases, in one plan, and of the JSON trees below the roots, merged by session."""
    rows, broken = read_sqlite(spark, roots, ["session", "sessions", "message", "part", "session_message"])
    named = rows.where("tab = 'session'").select("path").distinct()
    older = rows.join(named, "path", "left_anti").where("tab = 'sessions'").withColumn("tab", F.lit("session"))  # a database has one of the two
    own = table_of(rows.where("tab = 'session'").unionByName(older.select(*rows.columns)), "session", SESSION)
    of = lambda t, spec, *ids: composite(table_of(rows, t, spec), *ids)
    facts, said, used = database(composite(own, "id", "parent_id", "fork_session_id"), of("message", MESSAGE, "id", "session_id"), of("part", PART, "message_id"), of("session_message", SESSION_MESSAGE, "id", "session_id"))
    facts = written(facts.withColumns({c: plain_id(c) for c in ("external_id", "logical_session_id", "parent_external_id")}), "facts")
    said, used = (written(x.withColumn("conversation_id", plain_id("conversation_id")), "rows") for x in (said, used))
    files, unlisted = _tree_files(spark, roots)
    more, told, counted, bad = tree(files, recover)
    errors = broken.unionByName(unlisted).unionByName(bad.select(F.col("path").alias("source_path"), F.lit("no session").alias("error"))).dropDuplicates(["source_path"])
    return Scan(written(conversations([(facts, said, used), (more, told, counted)]), "opencode"), errors)
