"""Sessions, messages and per-model usage of the source that keeps one database a home.

All rules are DataFrame expressions over the three tables; only JSON of message contents is read by a Pandas UDF.  Ids
are those of one home; of several homes they carry the database's path until all joins are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..plans.steps import lookup, written
from .base import Scan, flatten
from .database import MARK, ancestors, assembled, blank_null, by_json, composite, counter, epoch_millis, has_usage, json_text, plain_id, read_sqlite, session_rest, table_of, total, usage_frame

AGENT = "hermes"
_COUNTED = "api_call_count long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long"
SESSIONS = f"id string, source string, model string, started_at double, ended_at double, title string, cwd string, git_repo_root string, parent_session_id string, {_COUNTED}, billing_provider string, billing_base_url string, billing_mode string, estimated_cost_usd double, actual_cost_usd double, cost_status string, cost_source string, pricing_version string"
MESSAGES = "id long, session_id string, role string, content string, tool_calls string, tool_name string, timestamp double, active long, compacted long"
MODEL_USAGE = f"session_id string, model string, billing_provider string, billing_base_url string, billing_mode string, task string, {_COUNTED}, estimated_cost_usd double, actual_cost_usd double, cost_status string, cost_source string, first_seen double, last_seen double"
#: Sessions whose rest one task works out.
SESSIONS_A_TASK = 1 << 17
_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def with_columns(rows: DataFrame, spec: str) -> DataFrame:
    """The columns of ``spec`` with their types; those that are not there are null."""
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in spec.split(", "))])


# ---------------------------------------------------------------- sessions
def record_kind(parent, source):
    low = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(blank_null(parent).isNotNull() | (low == "subagent"), "child_agent").when(low.isin("cron", "webhook"), "automation").when(low.isin("test", "fixture"), "test").otherwise("top_level")


def sessions(rows: DataFrame) -> DataFrame:
    """external_id, workspace (own or of the nearest ancestor), logical_session_id (the topmost ancestor), kind, times."""
    rows = with_columns(rows, SESSIONS)
    own = F.coalesce(blank_null(F.trim("cwd")), blank_null(F.trim("git_repo_root")))
    parent = blank_null(F.trim("parent_session_id"))
    chain = ancestors(rows.select("id", parent.alias("parent"), own.alias("workspace")), "workspace")
    kind = record_kind(F.col("parent_session_id"), F.col("source"))
    facts = rows.select(
        F.col("id").alias("external_id"), "title", "model", epoch_millis("started_at").alias("started_at"), epoch_millis("ended_at").alias("ended_at"),
        parent.alias("parent_external_id"), kind.alias("record_kind"), (kind == "test").alias("is_synthetic"),
    )
    return facts.join(chain.select(F.col("id").alias("external_id"), F.col("root").alias("logical_session_id"), "workspace"), "external_id")


# ---------------------------------------------------------------- messages
def _call(call) -> str:
    inner = call.get("function", call) if isinstance(call, dict) else {}
    inner = inner if isinstance(inner, dict) else {}
    name = next((n for n in (inner.get("name", call.get("name") if isinstance(call, dict) else None),) if isinstance(n, str)), "unknown")
    args = inner.get("arguments", call.get("input") if isinstance(call, dict) else None)
    text = "" if args is None and "arguments" not in inner and "input" not in (call if isinstance(call, dict) else {}) else json_text(args)
    return f"[Tool: {name}] {text}" if text else f"[Tool: {name}]"


def tool_summary(calls) -> str | None:
    """One line for each of a message's tool calls."""
    return "\n".join(map(_call, calls)) or None if isinstance(calls, list) else None


def messages(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """conversation_id, idx, role, content, timestamp, model of visible messages of ``owners`` (external_id, model): the
    content, then a line for each tool call."""
    rows = with_columns(rows, MESSAGES).where("active = 1 or compacted = 1 or active is null and compacted is null")
    low = F.lower("role")
    role = F.coalesce(*[F.when(low == k, v) for k, v in schema.ROLES.items()])
    json_like = F.col("content").rlike(r'^\s*[\[{"]')  # other JSON has no text
    decoded = by_json(lambda v: flatten(v) or None)(F.when(json_like, F.col("content")))
    content = F.coalesce(decoded, F.col("content"), F.lit(""))
    named = F.when((role == "tool") & F.col("tool_name").isNotNull(), F.concat(F.lit("[Tool: "), F.col("tool_name"), F.lit("]\n"), content)).otherwise(content)
    calls = by_json(tool_summary)(F.col("tool_calls"))
    parts = F.array(F.struct(F.lit(0).alias("part"), role.alias("role"), F.when(F.trim(content) != "", named).alias("content")), F.struct(F.lit(1).alias("part"), F.lit("tool").alias("role"), calls.alias("content")))
    every = rows.where(role.isNotNull()).select("session_id", "id", epoch_millis("timestamp").alias("timestamp"), F.explode(parts).alias("p")).where("p.content is not null")
    order = W.partitionBy("session_id").orderBy("id", "p.part", "p.role", "p.content")
    every = every.select(F.col("session_id").alias("external_id"), (F.row_number().over(order) - 1).cast("int").alias("idx"), "p.role", "p.content", "timestamp")
    return lookup(every, owners.select("external_id", "model"), "external_id", "idx", "inner").withColumnRenamed("external_id", "conversation_id")


# ---------------------------------------------------------------- usage
def _cost(value: str, statuses: tuple[str, ...]):
    c = F.col(value)
    fine = c.isNotNull() & ~F.isnan(c) & (c < float("inf")) & (c >= 0)
    return F.when(fine & ((c > 0) | F.trim(F.coalesce("cost_status", F.lit(""))).isin(*statuses)), c)


def _currency():
    paid = F.lit(False)
    for c in ("actual_cost_usd", "estimated_cost_usd"):
        paid = paid | F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    return F.when(paid | F.coalesce(F.trim("cost_status").isin("actual", "estimated", "included"), F.lit(False)), "USD")


def _common(tokens: str) -> dict:
    own = [counter(t) for t in _TOKENS]
    return {
        "provider": blank_null(F.col("billing_provider")), "model": blank_null(F.col("model")), "billing_base_url": blank_null(F.col("billing_base_url")), "billing_mode": blank_null(F.col("billing_mode")),
        "api_calls": counter("api_call_count"), "request_attempts": counter("api_call_count"), **dict(zip(_TOKENS, own)), "reasoning_tokens": counter("reasoning_tokens"), "total_tokens": total(*own), "component_total_tokens": total(*own),
        "actual_cost_usd": _cost("actual_cost_usd", ("actual",)), "estimated_cost_usd": _cost("estimated_cost_usd", ("estimated", "included")), "cost_status": blank_null(F.col("cost_status")), "cost_source": blank_null(F.col("cost_source")),
        "cost_currency": _currency(), "token_semantics": F.lit(tokens),
    }


def model_usage(rows: DataFrame) -> DataFrame:
    """A row for each model of a session over the time from its first to its last use; its event id is a digest of
    what tells it apart, each part with its length in bytes."""
    rows = with_columns(rows, MODEL_USAGE)
    parts = [F.coalesce(blank_null(F.col(c)) if c != "session_id" else plain_id(c), F.lit("")) for c in ("session_id", "model", "billing_provider", "billing_base_url", "billing_mode", "task")]
    ident = F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)
    out = rows.select(F.col("session_id").alias("conversation_id"), *[v.alias(k) for k, v in _common("hermes_session_model_usage_v1").items()], blank_null(F.col("task")).alias("task"), F.lit("interval_aggregate").alias("usage_grain"), epoch_millis("first_seen").alias("interval_start"), epoch_millis("last_seen").alias("interval_end"), F.concat(F.lit("hermes-model-aggregate:"), ident).alias("source_event_id"))
    return usage_frame(out).where(has_usage())


def session_usage(rows: DataFrame, projected: DataFrame, times: DataFrame) -> DataFrame:
    """What each session's own counters hold beyond its ``projected`` rows; ``times`` has its bounds by external_id."""
    rows = with_columns(rows, SESSIONS)
    # what a task holds of sessions and of their few rows does not grow with the tables
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SESSIONS_A_TASK))
    whole = rows.select(F.col("id").alias("conversation_id"), *[v.alias(k) for k, v in _common("hermes_session_residual_v1").items()], blank_null(F.col("pricing_version")).alias("pricing_version"), F.lit("session_aggregate").alias("usage_grain"), F.concat(F.lit("hermes-session-aggregate:"), plain_id("id")).alias("source_event_id"))
    whole = whole.repartition(parts, "conversation_id").join(times.select(F.col("external_id").alias("conversation_id"), F.col("started_at").alias("interval_start"), F.col("ended_at").alias("interval_end")), "conversation_id")
    whole = usage_frame(whole).where(has_usage())
    left = session_rest(whole, projected.repartition(parts, "conversation_id"))
    left = left.withColumns({"request_attempts": F.col("api_calls"), "component_total_tokens": F.col("total_tokens"), "reported_total_tokens": F.lit(None).cast("long")})
    return usage_frame(left.select("conversation_id", *schema.USAGE_RECORD.names)).where(has_usage())


def usage(session_rows: DataFrame, model_rows: DataFrame, times: DataFrame) -> DataFrame:
    """Rows by model in their order, then the session's rest; ``idx`` numbers them."""
    own = model_usage(model_rows)
    rest = session_usage(session_rows, own, times)
    order = W.partitionBy("conversation_id").orderBy(F.col("usage_grain") == "session_aggregate", F.asc_nulls_first("interval_start"), *[F.asc_nulls_first(c) for c in ("model", "provider", "billing_base_url", "billing_mode", "task")])
    return own.unionByName(rest).withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


# ---------------------------------------------------------------- conversations
def conversations(session_rows: DataFrame, message_rows: DataFrame, model_rows: DataFrame) -> DataFrame:
    """Conversation records of all homes' tables, whose ids are composite."""
    own = sessions(session_rows)
    said = messages(message_rows, own)
    bounds = said.groupBy(F.col("conversation_id").alias("external_id")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    own = own.join(bounds, "external_id", "left").withColumns({"started_at": F.coalesce("started_at", "lo"), "ended_at": F.coalesce("ended_at", "hi")}).drop("lo", "hi", "model")
    used = usage(session_rows, model_rows, own)
    out = assembled(own.withColumn("source_path", _virtual(F.col("external_id"))), said, used, AGENT)
    return out.withColumns({c: plain_id(c) for c in ("external_id", "logical_session_id", "parent_external_id")})


def _virtual(ident):
    """The store's key of a session, from its composite id."""
    key = F.rtrim(F.translate(F.base64(plain_id(ident).cast("binary")), "+/", "-_"), F.lit("="))
    home = F.regexp_replace(F.regexp_extract(ident, f"^([^{MARK}]*)/[^/{MARK}]*{MARK}", 1), "/+$", "")
    return F.concat(home, F.lit(f"/.logloom-sessions/{AGENT}/"), key)


def inventory(spark: SparkSession, homes: list[str]) -> DataFrame:
    """source_path, external_id of every session that any home's database holds, without reading messages."""
    rows, _ = read_sqlite(spark, homes, ["sessions"], "state.db")
    own = composite(table_of(rows, "sessions", "id string"), "id").where("id is not null")
    return own.select(_virtual(F.col("id")).alias("source_path"), plain_id("id").alias("external_id")).distinct()


def scan(spark: SparkSession, homes: list[str]) -> Scan:
    """Conversations of every home's database, all in one plan; homes keep one ``state.db`` each, profiles have their own."""
    rows, broken = read_sqlite(spark, homes, ["sessions", "messages", "session_model_usage"], "state.db")
    own = composite(table_of(rows, "sessions", SESSIONS).withColumn("parent_session_id", F.trim("parent_session_id")), "id", "parent_session_id")
    said, used = (composite(table_of(rows, t, spec), "session_id") for t, spec in (("messages", MESSAGES), ("session_model_usage", MODEL_USAGE)))
    return Scan(written(conversations(own, said, used), "hermes"), broken)
