"""Queries of the sources and the store: the driver's tables are put into each source's own shape, parsed or projected by
its operators, and compared with SQL over the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import usage as U
from .operators.store import Store, titles
from .plans.steps import dropped, lookup, shared_dir, written
from .queries import _read, register
from .sources import database, hermes, lines as L, opencode, roots

# ---------------------------------------------------------------- sessions of a database, per-model rows, the rest
_HERMES_SESSIONS = {
    "id": "concat('o', CAST(o_orderkey AS {str}))", "source": "CASE o_orderkey % 7 WHEN 0 THEN 'cron' WHEN 1 THEN ' Subagent' WHEN 2 THEN 'test' ELSE 'cli' END", "model": "CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('m-', CAST(o_orderkey % 3 AS {str})) END",
    "started_at": "{sec}", "ended_at": "CASE WHEN o_orderkey % 5 <> 0 THEN {sec} + 3600.5 END", "title": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END", "cwd": "CASE WHEN o_orderkey % 6 = 0 THEN concat(' /w/', CAST(o_custkey % 5 AS {str})) WHEN o_orderkey % 6 = 1 THEN ' ' END",
    "git_repo_root": "CASE WHEN o_orderkey % 10 = 0 THEN '/g' END", "parent_session_id": "CASE WHEN o_orderkey % 4 <> 0 THEN concat('o', CAST(o_orderkey - 1 AS {str})) END", "api_call_count": "o_orderkey % 9 - 2", "input_tokens": "CAST(floor(o_totalprice) AS BIGINT)", "output_tokens": "o_custkey",
    "billing_provider": "CASE o_orderkey % 4 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'anthropic' WHEN 2 THEN '' END", "estimated_cost_usd": "CASE WHEN o_orderkey % 8 = 0 THEN 0.0 ELSE o_totalprice / 1000 END", "cost_status": "CASE o_orderkey % 3 WHEN 0 THEN 'estimated' WHEN 1 THEN 'included' END",
}
_SEC = {"spark": "(unix_micros(CAST(o_orderdate AS TIMESTAMP)) / 1000000)", "duck": "(epoch_us(o_orderdate) / 1000000)"}
_HERMES_MESSAGES = {
    "id": "l_linenumber", "session_id": "concat('o', CAST(l_orderkey AS {str}))", "role": "CASE l_linenumber % 5 WHEN 0 THEN 'alien' WHEN 1 THEN 'user' WHEN 2 THEN 'Assistant' WHEN 3 THEN 'tool_result' ELSE 'assistant' END",
    "content": "CASE l_linenumber % 3 WHEN 0 THEN concat('ship ', CAST(l_partkey AS {str})) WHEN 1 THEN concat('[{{\"type\":\"text\",\"text\":\"a', CAST(l_partkey AS {str}), '\"}},{{\"text\":\"b\"}}]') END",
    "tool_calls": "CASE WHEN l_linenumber % 4 = 1 THEN concat('[{{\"function\":{{\"name\":\"f', CAST(l_suppkey AS {str}), '\",\"arguments\":{{\"z\":1,\"a\":2}}}}}},{{\"name\":\"g\"}}]') END",
    "tool_name": "CASE WHEN l_suppkey % 2 = 0 THEN 'grep' END", "timestamp": "CAST(l_linenumber + 1000 AS DOUBLE)", "active": "CASE WHEN l_linenumber % 6 = 0 THEN 0 ELSE 1 END", "compacted": "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END",
}
_HERMES_MODELS = {
    "session_id": "concat('o', CAST(l_orderkey AS {str}))", "model": "concat('m-', l_returnflag)", "billing_provider": "CASE l_returnflag WHEN 'A' THEN 'openai' WHEN 'R' THEN ' ' END", "task": "l_linestatus", "api_call_count": "count(*)", "input_tokens": "CAST(floor(sum(l_quantity)) AS BIGINT)", "output_tokens": "CAST(sum(l_linenumber) AS BIGINT)",
    "estimated_cost_usd": "CAST(max(l_linenumber) AS DOUBLE) / 8", "first_seen": "CAST(min(l_linenumber) AS DOUBLE)", "last_seen": "2000000000000.0",
}


def _as(columns: dict[str, str], engine: str) -> list[str]:
    words = {"str": "STRING" if engine == "spark" else "VARCHAR", "sec": _SEC[engine]}
    return [f"{v.format(**words)} AS {k}" for k, v in columns.items()]


def _hermes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    sessions = _read(spark, sf_dir, "orders").selectExpr(*_as(_HERMES_SESSIONS, "spark"))
    messages = _read(spark, sf_dir, "lineitem").selectExpr(*_as(_HERMES_MESSAGES, "spark"))
    line = _read(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_returnflag", "l_linestatus"]
    models = line.groupBy(*keys).agg(*[F.expr(v.format(str="STRING")).alias(k) for k, v in _HERMES_MODELS.items()]).drop(*keys)
    return sessions, messages, models


_DUCK_HERMES = f"""s AS (SELECT {', '.join(_as(_HERMES_SESSIONS, 'duck'))} FROM orders), g AS (SELECT {', '.join(_as(_HERMES_MESSAGES, 'duck'))} FROM lineitem),
p AS (SELECT {', '.join(_as(_HERMES_MODELS, 'duck'))} FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus),
own AS (SELECT id, nullif(trim(parent_session_id), '') AS parent, coalesce(nullif(trim(cwd), ''), nullif(trim(git_repo_root), '')) AS ws FROM s)"""


@register(
    "hermes_sessions",
    f"""WITH RECURSIVE {_DUCK_HERMES},
r AS (SELECT id, id AS top, ws, 0 AS k FROM own UNION ALL SELECT r.id, own.parent, coalesce(r.ws, n.ws), k + 1 FROM r JOIN own ON own.id = r.top LEFT JOIN own n ON n.id = own.parent WHERE own.parent IS NOT NULL),
f AS (SELECT id, arg_max(top, k) AS root, max(ws) AS ws FROM r GROUP BY id)
SELECT s.id AS external_id, f.root AS logical_session_id, f.ws AS workspace, s.parent_session_id AS parent_external_id,
  CASE WHEN s.parent_session_id IS NOT NULL OR lower(trim(source)) = 'subagent' THEN 'child_agent' WHEN source = 'cron' THEN 'automation' WHEN source = 'test' THEN 'test' ELSE 'top_level' END AS record_kind,
  CAST(trunc(started_at * 1000) AS BIGINT) AS started_at, CAST(trunc(ended_at * 1000) AS BIGINT) AS ended_at FROM s JOIN f ON f.id = s.id""",
)
def hermes_sessions(spark, sf_dir):
    return hermes.sessions(_hermes(spark, sf_dir)[0]).select("external_id", "logical_session_id", "workspace", "parent_external_id", "record_kind", "started_at", "ended_at")


@register(
    "hermes_messages",
    f"""WITH {_DUCK_HERMES},
v AS (SELECT *, CASE l_role WHEN 'tool_result' THEN 'tool' ELSE l_role END AS r FROM (SELECT *, lower(role) AS l_role FROM g WHERE active = 1 OR compacted = 1) WHERE l_role <> 'alien'),
t AS (SELECT session_id, id, 0 AS part, r AS role, CASE WHEN content LIKE '[%' THEN regexp_extract(content, '"(a[0-9]+)"', 1) || chr(10) || 'b' ELSE content END AS body, tool_name, timestamp FROM v WHERE content IS NOT NULL
  UNION ALL SELECT session_id, id, 1, 'tool', '[Tool: ' || regexp_extract(tool_calls, '"(f[0-9]+)"', 1) || '] {{"a":2,"z":1}}' || chr(10) || '[Tool: g]', NULL, timestamp FROM v WHERE tool_calls IS NOT NULL)
SELECT session_id AS conversation_id, row_number() OVER (PARTITION BY session_id ORDER BY id, part, role, content) - 1 AS idx, * EXCLUDE (session_id, id, part)
FROM (SELECT session_id, id, part, role, CASE WHEN role = 'tool' AND tool_name IS NOT NULL THEN '[Tool: ' || tool_name || ']' || chr(10) || body ELSE body END AS content, CAST(timestamp * 1000 AS BIGINT) AS timestamp FROM t) WHERE session_id IN (SELECT id FROM s)""",
)
def hermes_messages(spark, sf_dir):
    sessions, messages, _ = _hermes(spark, sf_dir)
    own = sessions.select(F.col("id").alias("external_id"), "model")
    return hermes.messages(messages, own).select("conversation_id", F.col("idx").cast("long").alias("idx"), "role", "content", "timestamp")


_DUCK_MODEL_USAGE = """mu AS (SELECT session_id AS conversation_id, model, nullif(trim(billing_provider), '') AS provider, task, api_call_count AS api_calls, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, estimated_cost_usd,
  CAST(trunc(first_seen * 1000) AS BIGINT) AS interval_start, CAST(last_seen AS BIGINT) AS interval_end,
  'hermes-model-aggregate:' || sha256(concat(strlen(session_id), ':', session_id, strlen(model), ':', model, strlen(coalesce(nullif(trim(billing_provider), ''), '')), ':', coalesce(nullif(trim(billing_provider), ''), ''), '0:', '0:', strlen(task), ':', task)) AS source_event_id FROM p)"""


@register("hermes_model_usage", f"WITH {_DUCK_HERMES}, {_DUCK_MODEL_USAGE} SELECT * FROM mu")
def hermes_model_usage(spark, sf_dir):
    return hermes.model_usage(_hermes(spark, sf_dir)[2]).select("conversation_id", "model", "provider", "task", "api_calls", "input_tokens", "output_tokens", "total_tokens", "estimated_cost_usd", "interval_start", "interval_end", "source_event_id")


@register(
    "hermes_residual",
    f"""WITH {_DUCK_HERMES}, {_DUCK_MODEL_USAGE},
w AS (SELECT id, greatest(api_call_count, 0) AS api, input_tokens AS i, output_tokens AS o, CASE WHEN estimated_cost_usd > 0 OR cost_status IN ('estimated', 'included') THEN estimated_cost_usd END AS c FROM s),
q AS (SELECT conversation_id, count(*) AS n, sum(api_calls) AS api, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(total_tokens) AS t, sum(CASE WHEN estimated_cost_usd > 0 THEN estimated_cost_usd END) AS c FROM mu GROUP BY 1),
e AS (SELECT w.id AS conversation_id, CAST(greatest(w.api - coalesce(q.api, 0), 0) AS BIGINT) AS api_calls, CAST(greatest(w.i - coalesce(q.i, 0), 0) AS BIGINT) AS input_tokens, CAST(greatest(w.o - coalesce(q.o, 0), 0) AS BIGINT) AS output_tokens, CAST(greatest(w.i + w.o - coalesce(q.t, 0), 0) AS BIGINT) AS total_tokens,
  CASE WHEN q.n IS NULL AND w.c = 0 THEN 0.0 WHEN w.c - coalesce(q.c, 0) > 2.220446049250313e-16 THEN w.c - coalesce(q.c, 0) END AS c, w.api + w.i + w.o AS any_, w.c AS wc FROM w LEFT JOIN q ON q.conversation_id = w.id)
SELECT conversation_id, api_calls, input_tokens, output_tokens, total_tokens, round(c, 6) AS estimated_cost_usd FROM e WHERE (any_ > 0 OR wc IS NOT NULL) AND (api_calls > 0 OR total_tokens > 0 OR c IS NOT NULL)""",
)
def hermes_residual(spark, sf_dir):
    sessions, _, models = _hermes(spark, sf_dir)
    times = sessions.select(F.col("id").alias("external_id"), database.epoch_millis("started_at").alias("started_at"), database.epoch_millis("ended_at").alias("ended_at"))
    return hermes.session_usage(sessions, hermes.model_usage(models), times).select("conversation_id", "api_calls", "input_tokens", "output_tokens", "total_tokens", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"))


# ---------------------------------------------------------------- databases of two message schemas and a JSON tree
def _opencode_sessions(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return hermes.with_columns(
        rows.selectExpr(
            "concat('c', conv_id) AS id", "concat('/w', conv_id % 4) AS directory", "concat('t', conv_id) AS title", "conv_id AS time_created", "conv_id + 9 AS time_updated", "CASE conv_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN '{\"modelID\":\"m9\",\"providerID\":\"p9\",\"variant\":\"v9\"}' END AS model",
            "CASE WHEN conv_id % 5 = 1 THEN concat('c', conv_id - 1) END AS parent_id", "CASE WHEN conv_id % 5 = 2 THEN concat('c', conv_id - 1) END AS fork_session_id", "'build' AS agent", "CASE WHEN conv_id % 2 = 0 THEN 1.5 END AS cost", "conv_id * 50 AS tokens_input", "conv_id * 3 AS tokens_output", "conv_id AS tokens_reasoning", "-5L AS tokens_cache_read",
        ), opencode.SESSION,
    )


def _turns(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _opencode_first(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    turns = _turns(spark, sf_dir)
    ident = F.concat_ws("-", F.lit("m"), "conv_id", "turn")
    tokens = F.struct(F.length("text").alias("input"), F.lit(3).alias("output"), F.lit(2).alias("reasoning"), F.struct(F.lit(5).alias("read")).alias("cache"))
    data = F.to_json(F.struct("role", F.struct((F.col("turn") * 10).alias("created")).alias("time"), F.when(F.col("turn") % 2 == 1, "m8").alias("modelID"), F.when(F.col("role") == "assistant", tokens).alias("tokens"), F.when(F.col("turn") % 4 == 1, 0.25).alias("cost")))
    message = turns.select(ident.alias("id"), F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").alias("time_created"), data.alias("data"))
    kinds = F.array(F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.to_json(F.struct(F.lit("tool").alias("type"), F.lit("grep").alias("tool"), F.struct(F.struct(F.lit(1).alias("z"), F.lit("q").alias("a")).alias("input"), F.col("text").alias("output")).alias("state"))), F.lit('{"type":"step-start"}'))
    part = turns.select(ident.alias("message_id"), F.posexplode(kinds).alias("time_created", "data")).select(F.concat_ws("/", "message_id", "time_created").alias("id"), "message_id", F.col("time_created").cast("long").alias("time_created"), "data")
    return message, part


_DUCK_TURNS = "tu AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations)"
_DUCK_SESSION_MODEL = "CASE conv_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'm9' END"
_DUCK_FIRST = f"""{_DUCK_TURNS}, said AS (SELECT 'c' || conv_id AS conversation_id, turn * 10 AS ts, role, CASE WHEN turn % 2 = 1 THEN 'm8' ELSE {_DUCK_SESSION_MODEL} END AS model, text AS content FROM tu WHERE trim(text, ' ') <> ''
  UNION ALL SELECT 'c' || conv_id, turn * 10, 'tool', CASE WHEN turn % 2 = 1 THEN 'm8' ELSE {_DUCK_SESSION_MODEL} END, '[Tool: grep]' || chr(10) || 'Input: {{"a":"q","z":1}}' || chr(10) || 'Output: ' || text FROM tu)"""


@register(
    "opencode_first_messages",
    f"WITH {_DUCK_FIRST} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ts NULLS FIRST, role, model NULLS FIRST, content) - 1 AS idx, role, content, model FROM (SELECT DISTINCT * FROM said)",
)
def opencode_first_messages(spark, sf_dir):
    from .operators.store import normalized_messages

    said, _ = opencode.first_schema(_opencode_sessions(spark, sf_dir), *_opencode_first(spark, sf_dir))
    return normalized_messages(said).select("conversation_id", F.col("idx").cast("long").alias("idx"), "role", "content", "model")


_DUCK_OC_USAGE = f"""{_DUCK_TURNS}, ou AS (SELECT 'c' || conv_id AS conversation_id, 'opencode-message:c' || conv_id || ':m-' || conv_id || '-' || turn AS source_event_id, turn * 10 AS timestamp, CASE WHEN turn % 2 = 1 THEN 'm8' ELSE {_DUCK_SESSION_MODEL} END AS model, CASE WHEN conv_id % 3 = 1 THEN 'p9' END AS provider,
  CASE WHEN conv_id % 3 = 1 THEN 'v9' END AS model_variant, CAST(length(text) AS BIGINT) AS input_tokens, 5 AS output_tokens, 2 AS reasoning_tokens, CAST(length(text) + 10 AS BIGINT) AS total_tokens, CASE WHEN turn % 4 = 1 THEN 0.25 END AS estimated_cost_usd FROM tu WHERE role = 'assistant')"""


@register("opencode_first_usage", f"WITH {_DUCK_OC_USAGE} SELECT * FROM ou")
def opencode_first_usage(spark, sf_dir):
    _, used = opencode.first_schema(_opencode_sessions(spark, sf_dir), *_opencode_first(spark, sf_dir))
    return used.select("conversation_id", "source_event_id", "timestamp", "model", "provider", "model_variant", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "estimated_cost_usd")


@register(
    "opencode_merged_usage",
    f"""WITH {_DUCK_OC_USAGE}, two AS (SELECT conversation_id, source_event_id, timestamp, model, input_tokens, output_tokens, total_tokens FROM ou UNION ALL SELECT conversation_id, source_event_id, timestamp - 1, 'longer-' || coalesce(model, ''), input_tokens // 2, output_tokens + 4, input_tokens // 2 + output_tokens + 9 FROM ou)
SELECT conversation_id, source_event_id, min(timestamp) AS timestamp, arg_max(model, (strlen(model), model)) AS model, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens, greatest(max(total_tokens), max(input_tokens) + max(output_tokens) + 5) AS total_tokens,
  row_number() OVER (PARTITION BY conversation_id ORDER BY min(timestamp), source_event_id) - 1 AS idx FROM two GROUP BY 1, 2""",
)
def opencode_merged_usage(spark, sf_dir):
    _, used = opencode.first_schema(_opencode_sessions(spark, sf_dir), *_opencode_first(spark, sf_dir))
    half = F.floor(F.col("input_tokens") / 2)
    again = used.withColumns({"timestamp": F.col("timestamp") - 1, "model": F.concat(F.lit("longer-"), F.coalesce("model", F.lit(""))), "input_tokens": half, "output_tokens": F.col("output_tokens") + 4, "total_tokens": half + F.col("output_tokens") + 9, "component_total_tokens": half + F.col("output_tokens") + 9})
    merged = database.merged_usage(used.unionByName(again))
    return merged.select("conversation_id", "source_event_id", "timestamp", "model", "input_tokens", "output_tokens", "total_tokens", F.col("idx").cast("long").alias("idx"))


@register(
    "opencode_residual",
    f"""WITH {_DUCK_OC_USAGE}, s AS (SELECT DISTINCT conv_id, 'c' || conv_id AS id, conv_id * 50 AS i, conv_id * 3 + conv_id AS o, conv_id AS r, CASE WHEN conv_id % 2 = 0 THEN 1.5 END AS c FROM tu),
q AS (SELECT conversation_id, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(reasoning_tokens) AS r, sum(total_tokens) AS t, sum(estimated_cost_usd) AS c FROM ou GROUP BY 1),
e AS (SELECT s.id AS conversation_id, CAST(greatest(s.i - coalesce(q.i, 0), 0) AS BIGINT) AS input_tokens, CAST(greatest(s.o - coalesce(q.o, 0), 0) AS BIGINT) AS output_tokens, CAST(greatest(s.r - coalesce(q.r, 0), 0) AS BIGINT) AS reasoning_tokens, CAST(greatest(s.i + s.o - coalesce(q.t, 0), 0) AS BIGINT) AS total_tokens,
  CASE WHEN s.c - coalesce(q.c, 0) > 2.220446049250313e-16 THEN s.c - coalesce(q.c, 0) END AS estimated_cost_usd FROM s LEFT JOIN q ON q.conversation_id = s.id WHERE s.i + s.o > 0 OR s.c IS NOT NULL)
SELECT * FROM e WHERE total_tokens > 0 OR estimated_cost_usd IS NOT NULL""",
)
def opencode_residual(spark, sf_dir):
    sessions = _opencode_sessions(spark, sf_dir)
    _, used = opencode.first_schema(sessions, *_opencode_first(spark, sf_dir))
    return opencode.session_usage(sessions, used).select("conversation_id", "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "estimated_cost_usd")


def _opencode_second(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("user", "synthetic", "skill", "shell", "compaction", "assistant", "assistant"))), (F.col("turn") % 7 + 1).cast("int"))
    content = F.array(F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.to_json(F.struct(F.lit("tool").alias("type"), F.lit("sed").alias("name"), F.struct(F.lit("boom").alias("error")).alias("state"))))
    plain = F.to_json(F.struct("text", F.lit("lint").alias("name"), F.lit("ls").alias("command"), F.col("text").alias("output"), F.col("text").alias("summary"), F.lit("r").alias("recent")))
    answer = F.when(F.col("turn") % 7 == 5, F.concat(F.lit('{"content":['), F.array_join(content, ","), F.lit("]}"))).otherwise(F.lit('{"error":{"b":1,"a":"x"}}'))
    return turns.select(F.concat_ws("-", F.lit("n"), "conv_id", "turn").alias("id"), F.concat(F.lit("c"), "conv_id").alias("session_id"), kind.alias("type"), F.col("turn").alias("seq"), F.col("turn").alias("time_created"), F.when(kind == "assistant", answer).otherwise(plain).alias("data"))


@register(
    "opencode_second_messages",
    f"""WITH {_DUCK_TURNS}, w AS (SELECT 'c' || conv_id AS conversation_id, turn, text, turn % 7 AS k FROM tu),
x AS (SELECT conversation_id, turn AS timestamp, CASE k WHEN 0 THEN 'user' WHEN 3 THEN 'tool' ELSE 'system' END AS role, CASE k WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '[Skill: lint]' || chr(10) || text WHEN 3 THEN '[Shell]' || chr(10) || 'Command: ls' || chr(10) || 'Output: ' || text ELSE '[Compaction summary]' || chr(10) || text || chr(10) || 'r' END AS content FROM w WHERE k < 5
  UNION ALL SELECT conversation_id, turn, 'assistant', text FROM w WHERE k = 5 UNION ALL SELECT conversation_id, turn, 'tool', '[Tool: sed]' || chr(10) || 'Error: boom' FROM w WHERE k = 5
  UNION ALL SELECT conversation_id, turn, 'assistant', '[Assistant error] {{"a":"x","b":1}}' FROM w WHERE k = 6)
SELECT * FROM x WHERE trim(content, ' ') <> ''""",
)
def opencode_second_messages(spark, sf_dir):
    said, _ = opencode.second_schema(_opencode_sessions(spark, sf_dir), _opencode_second(spark, sf_dir))
    return said.select("conversation_id", "timestamp", "role", "content")


@register(
    "opencode_failed_requests",
    f"WITH {_DUCK_TURNS} SELECT 'c' || conv_id AS conversation_id, turn AS timestamp, 0 AS api_calls, 1 AS request_attempts, 0 AS total_tokens, 'unknown' AS cost_status FROM tu WHERE turn % 7 = 6",
)
def opencode_failed_requests(spark, sf_dir):
    _, used = opencode.second_schema(_opencode_sessions(spark, sf_dir), _opencode_second(spark, sf_dir))
    return used.select("conversation_id", "timestamp", "api_calls", "request_attempts", "total_tokens", "cost_status")


@register(
    "opencode_sessions",
    f"""WITH RECURSIVE {_DUCK_TURNS}, s AS (SELECT DISTINCT 'c' || conv_id AS id, CASE WHEN conv_id % 5 IN (1, 2) THEN 'c' || (conv_id - 1) END AS parent, CASE conv_id % 5 WHEN 1 THEN 'child_agent' WHEN 2 THEN 'fork' ELSE 'top_level' END AS kind FROM tu),
r AS (SELECT id, id AS top, 0 AS k FROM s UNION ALL SELECT r.id, s.parent, k + 1 FROM r JOIN s ON s.id = r.top WHERE s.parent IS NOT NULL)
SELECT s.id AS external_id, parent AS parent_external_id, kind AS record_kind, (SELECT arg_max(top, k) FROM r WHERE r.id = s.id) AS logical_session_id FROM s""",
)
def opencode_sessions(spark, sf_dir):
    return opencode.session_facts(_opencode_sessions(spark, sf_dir)).select("external_id", "parent_external_id", "record_kind", "logical_session_id")


@register(
    "opencode_merged_sessions",
    f"""WITH {_DUCK_TURNS}, s AS (SELECT DISTINCT conv_id, 'c' || conv_id AS id FROM tu)
SELECT id AS external_id, conv_id - 3 AS started_at, conv_id + 9 AS ended_at, CASE WHEN conv_id % 2 = 0 THEN 'zz' || conv_id ELSE 't' || conv_id END AS title, CASE WHEN conv_id % 5 = 1 THEN 'child_agent' WHEN conv_id % 5 = 2 THEN 'fork' WHEN conv_id % 7 = 0 THEN 'test' ELSE 'top_level' END AS record_kind, conv_id % 7 = 0 AS is_synthetic FROM s""",
)
def opencode_merged_sessions(spark, sf_dir):
    own = opencode.session_facts(_opencode_sessions(spark, sf_dir)).withColumns({"started_at": F.col("time_created"), "ended_at": F.col("time_updated")}).drop("time_created", "time_updated")
    n = F.expr("CAST(substring(external_id, 2) AS BIGINT)")
    weak = F.when((n % 7 == 0) & ~(n % 5).isin(1, 2), "test").otherwise("recovered")
    other = own.withColumns({"started_at": n - 3, "ended_at": F.lit(None).cast("long"), "title": F.when(n % 2 == 0, F.concat(F.lit("zz"), n)).otherwise(" "), "record_kind": weak, "is_synthetic": n % 7 == 0})
    return opencode.merged_facts(own.unionByName(other)).select("external_id", "started_at", "ended_at", "title", "record_kind", "is_synthetic")


@register(
    "opencode_tree",
    f"""WITH {_DUCK_TURNS}, x AS (SELECT 'c' || conv_id AS conversation_id, turn AS timestamp, role, text AS content FROM tu WHERE trim(text, ' ') <> '' UNION ALL SELECT 'c' || conv_id, turn, role, '[Tool: sed]' FROM tu WHERE turn % 3 = 0) SELECT * FROM x""",
)
def opencode_tree(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    conv, ident = F.concat(F.lit("c"), "conv_id"), F.concat_ws("-", F.lit("m"), "conv_id", "turn")
    session = turns.select("conv_id").distinct().select(F.concat(F.lit("/r/session/p/"), conv, F.lit(".json")).alias("path"), F.to_json(F.struct(conv.alias("id"), F.lit("p").alias("projectID"))).alias("body"))
    message = turns.select(F.concat(F.lit("/r/message/"), conv, F.lit("/"), ident, F.lit(".json")).alias("path"), F.to_json(F.struct(ident.alias("id"), conv.alias("sessionID"), "role", F.struct(F.col("turn").alias("created")).alias("time"))).alias("body"))
    said = turns.select(F.concat(F.lit("/r/part/"), ident, F.lit("/t.json")).alias("path"), F.to_json(F.struct(ident.alias("messageID"), F.lit("text").alias("type"), "text")).alias("body"))
    tool = turns.where("turn % 3 = 0").select(F.concat(F.lit("/r/part/"), ident, F.lit("/u.json")).alias("path"), F.to_json(F.struct(ident.alias("messageID"), F.lit("tool").alias("type"), F.lit("sed").alias("name"))).alias("body"))
    _, messages, _, _ = opencode.tree(session.unionByName(message).unionByName(said).unionByName(tool))
    return messages.select("conversation_id", "timestamp", "role", "content")


# ---------------------------------------------------------------- files of lines
def _lines(rows: DataFrame, path) -> DataFrame:
    """Lines (conv_id, at, line) as a reader gives them: one file for each conversation, in splits of a few lines each."""
    return rows.select(path.alias("path"), F.floor(F.col("at") / 7).alias("block"), F.col("at").alias("row"), "line")


def _told(folded: L.Folded, name: str, *facts: str) -> DataFrame:
    """Messages or usage rows with facts of their file."""
    return lookup(getattr(folded, name), folded.facts.select("path", *facts), "path", "idx" if name == "messages" else "source_event_id", "inner")


def _message_lines(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir)
    answer = F.col("role") == "assistant"
    use = F.when(answer, F.struct(F.length("text").alias("input_tokens"), (F.col("turn") % 7).alias("output_tokens"), F.lit(2).alias("cache_read_input_tokens")))
    message = F.struct("role", F.col("text").alias("content"), F.when(answer, F.concat(F.lit("i"), F.floor(F.col("turn") / 4))).alias("id"), F.when(answer & (F.col("turn") % 3 == 1), F.concat(F.lit("m"), F.col("turn"))).alias("model"), use.alias("usage"))
    line = F.to_json(F.struct(F.when(answer, "assistant").otherwise("user").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.when(F.col("turn") % 2 == 0, F.col("turn") * 1000).alias("timestamp"), message.alias("message")))
    return _lines(turns.select("conv_id", F.col("turn").alias("at"), line.alias("line")), F.concat(F.lit("/p/"), F.when(F.col("conv_id") % 4 == 0, "subagents/").otherwise(""), F.col("conv_id").cast("string"), F.lit(".jsonl")))


_DUCK_ML = f"""{_DUCK_TURNS}, ml AS (SELECT *, last_value(CASE WHEN turn % 2 = 0 THEN turn * 1000 END IGNORE NULLS) OVER o AS now, last_value(CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'm' || turn END IGNORE NULLS) OVER o AS model FROM tu WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g') <> ''"


@register(
    "message_line_messages",
    f"WITH {_DUCK_ML} SELECT 's' || conv_id AS external_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, text AS content, now AS timestamp, model, CASE WHEN conv_id % 4 = 0 THEN 'child_agent' ELSE 'top_level' END AS record_kind FROM ml WHERE {_STRIP.format('text')}",
)
def message_line_messages(spark, sf_dir):
    found = _told(L.message_lines(_message_lines(spark, sf_dir)), "messages", "external_id", "record_kind")
    return found.select("external_id", F.col("idx").cast("long").alias("idx"), "role", "content", "timestamp", "model", "record_kind")


@register(
    "message_line_usage",
    f"""WITH {_DUCK_ML}, x AS (SELECT conv_id, 'message:i' || (turn // 4) AS source_event_id, now AS timestamp, model, length(text) AS input_tokens, turn % 7 AS output_tokens, length(text) + turn % 7 + 2 AS total_tokens, turn FROM ml WHERE role = 'assistant'),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, source_event_id ORDER BY total_tokens DESC, timestamp DESC NULLS LAST, turn) AS best FROM x)
SELECT 's' || conv_id AS external_id, source_event_id, timestamp, model, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(total_tokens AS BIGINT) AS total_tokens FROM y WHERE best = 1""",
)
def message_line_usage(spark, sf_dir):
    found = _told(L.message_lines(_message_lines(spark, sf_dir)), "usage", "external_id")
    return found.select("external_id", "source_event_id", "timestamp", "model", "input_tokens", "output_tokens", "total_tokens")


def _rollouts(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir)
    when = (F.col("turn") + 2_000_000_000).alias("timestamp")
    wrap = lambda kind, body: F.to_json(F.struct(F.lit(kind).alias("type"), when, body.alias("payload")))
    meta = wrap("session_meta", F.struct(F.concat(F.lit("r"), "conv_id").alias("id"), F.lit("openai").alias("model_provider"), F.when(F.col("conv_id") % 3 == 0, "cron-job").alias("originator")))
    said = wrap("response_item", F.struct(F.lit("message").alias("type"), F.when((F.col("turn") % 5 == 2) & (F.col("role") == "user"), "developer").otherwise(F.col("role")).alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), "text")).alias("content")))
    seen = lambda c: F.struct((c * 100).alias("input_tokens"), (c * 40).alias("cached_input_tokens"), (c * 7).alias("output_tokens"), (c * 107).alias("total_tokens"))
    count = wrap("event_msg", F.struct(F.lit("token_count").alias("type"), F.struct(F.when(F.col("turn") % 4 != 3, seen(F.floor(F.col("turn") / 2) + 1)).alias("total_token_usage"), seen(F.lit(2)).alias("last_token_usage")).alias("info")))
    parts = F.array(F.when(F.col("turn") == 0, meta), said, said, count)
    lines = turns.select("conv_id", "turn", F.posexplode(parts).alias("k", "line")).where("line is not null").select("conv_id", (F.col("turn") * 10 + F.col("k")).alias("at"), "line")
    return _lines(lines, F.concat(F.lit("/r/rollout-"), F.col("conv_id").cast("string"), F.lit(".jsonl")))


@register(
    "rollout_messages",
    f"""WITH {_DUCK_TURNS} SELECT 'r' || conv_id AS external_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, CASE WHEN turn % 5 = 2 AND role = 'user' THEN 'system' ELSE role END AS role, text AS content, (turn + 2000000000) * 1000 AS timestamp,
  CASE WHEN conv_id % 3 = 0 THEN 'automation' ELSE 'top_level' END AS record_kind FROM tu WHERE {_STRIP.format('text')}""",
)
def rollout_messages(spark, sf_dir):
    found = _told(L.rollouts(_rollouts(spark, sf_dir)), "messages", "external_id", "record_kind")
    return found.select("external_id", F.col("idx").cast("long").alias("idx"), "role", "content", "timestamp", "record_kind")


@register(
    "rollout_usage",
    f"""WITH {_DUCK_TURNS}, x AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN turn // 2 + 1 END AS mark FROM tu), y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, mark ORDER BY turn) AS rn FROM x)
SELECT 'r' || conv_id AS external_id, CASE WHEN mark IS NOT NULL THEN concat('codex-cumulative-v2:r', conv_id, ':', mark * 100, ':', mark * 40, ':', mark * 7, ':', mark * 107, ':200:80:14:0:214') END AS source_event_id, (turn + 2000000000) * 1000 AS timestamp, 120 AS input_tokens, 80 AS cache_read_tokens, 14 AS output_tokens, 214 AS total_tokens FROM y WHERE mark IS NULL OR rn = 1""",
)
def rollout_usage(spark, sf_dir):
    found = _told(L.rollouts(_rollouts(spark, sf_dir)), "usage", "external_id")
    return found.select("external_id", "source_event_id", "timestamp", "input_tokens", "cache_read_tokens", "output_tokens", "total_tokens")


def _trees(spark, sf_dir) -> DataFrame:
    turns = _turns(spark, sf_dir)
    head = F.to_json(F.struct(F.lit("session").alias("type"), F.concat(F.lit("t"), "conv_id").alias("id"), F.when(F.col("conv_id") % 6 == 0, "/tmp/x").otherwise("/work").alias("cwd"), F.element_at(F.array(F.lit("google"), F.lit("cursor"), F.lit("anthropic")), (F.col("conv_id") % 3 + 1).cast("int")).alias("provider"), F.lit("m0").alias("modelId")))
    change = F.to_json(F.struct(F.lit("model_change").alias("type"), F.concat(F.lit("m"), "turn").alias("modelId")))
    use = F.when(F.col("role") == "assistant", F.struct((F.length("text") + 50).alias("input"), F.lit(4).alias("output"), F.lit(30).alias("cacheRead"), F.lit(1000).alias("totalTokens"), F.struct(F.when(F.col("turn") % 3 == 0, 0.0).otherwise(0.5).alias("total")).alias("cost")))
    blocks = F.array(F.to_json(F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("thinking"))), F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.lit('{"type":"toolCall","name":"sed","arguments":{"z":1,"a":2}}'))
    said = F.concat(F.lit('{"type":"message","id":"e'), F.col("turn"), F.lit('","timestamp":'), F.col("turn") + 5, F.lit(',"message":{"role":"'), F.col("role"), F.lit('","content":['), F.array_join(blocks, ","), F.lit("]"), F.coalesce(F.concat(F.lit(',"usage":'), F.to_json(use)), F.lit("")), F.lit("}}"))
    parts = F.array(F.when(F.col("turn") == 0, head), F.when(F.col("turn") % 4 == 2, change), said)
    lines = turns.select("conv_id", "turn", F.posexplode(parts).alias("k", "line")).where("line is not null").select("conv_id", (F.col("turn") * 10 + F.col("k")).alias("at"), "line")
    return _lines(lines, F.concat(F.lit("/r/1_"), F.col("conv_id").cast("string"), F.lit(".jsonl")))


_DUCK_TREE = f"{_DUCK_TURNS}, tr AS (SELECT *, coalesce(last_value(CASE WHEN turn % 4 = 2 THEN 'm' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'm0') AS model FROM tu)"


@register(
    "tree_messages",
    f"""WITH {_DUCK_TREE} SELECT 't' || conv_id AS external_id, turn AS idx, role, '[Thinking] hm' || chr(10) || CASE WHEN text = '' THEN '' ELSE text || chr(10) END || '[Tool: sed] {{"a":2,"z":1}}' AS content, turn + 5 AS timestamp, model, CASE WHEN conv_id % 6 = 0 THEN 'test' ELSE 'top_level' END AS record_kind, conv_id % 6 = 0 AS is_synthetic FROM tr""",
)
def tree_messages(spark, sf_dir):
    found = _told(L.session_trees(_trees(spark, sf_dir)), "messages", "external_id", "record_kind", "is_synthetic")
    return found.select("external_id", F.col("idx").cast("long").alias("idx"), "role", "content", "timestamp", "model", "record_kind", "is_synthetic")


@register(
    "tree_usage",
    f"""WITH {_DUCK_TREE} SELECT 't' || conv_id AS external_id, concat('pi-message:e', turn, ':', turn + 5) AS source_event_id, model, CAST(length(text) + 50 - CASE WHEN conv_id % 3 = 0 THEN 30 ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN conv_id % 3 = 1 THEN length(text) + 84 ELSE 1000 END AS BIGINT) AS total_tokens,
  CASE conv_id % 3 WHEN 0 THEN 'pi.google.input-includes-cache-read.v1' WHEN 1 THEN 'pi.cursor-sdk.cumulative-reported-total.v1' ELSE 'pi.reported-total-with-additive-components.v1' END AS token_semantics, CASE WHEN turn % 3 = 0 THEN 'source_reported_zero' END AS cost_status FROM tr WHERE role = 'assistant'""",
)
def tree_usage(spark, sf_dir):
    found = _told(L.session_trees(_trees(spark, sf_dir)), "usage", "external_id")
    return found.select("external_id", "source_event_id", "model", "input_tokens", "total_tokens", "token_semantics", "cost_status")


@register("copied_sessions", "SELECT 't' || vec_id AS external_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id * 3 FROM documents WHERE doc_id IS NOT NULL)")
def copied_sessions(spark, sf_dir):
    own = _read(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), "vec_id").alias("external_id"))
    originals = _read(spark, sf_dir, "documents").select(F.concat(F.lit("t"), F.col("doc_id") * 3).alias("external_id"))
    return roots.without_copies(own, originals)


# ---------------------------------------------------------------- the store
def _scanned(spark, sf_dir) -> DataFrame:
    """The conversations as scanned records."""
    rows = _message_lines(spark, sf_dir)
    files = rows.groupBy("path").agg(F.lit(0).cast("long").alias("mtime"), F.sum(F.length("line")).alias("length"))
    return written(L.records(L.message_lines(rows), files, "claude_code", 3), "scan")


def _changed(found: DataFrame) -> DataFrame:
    """A later scan: of every third conversation the last turn is left out."""
    n = F.expr("CAST(substring(external_id, 2) AS BIGINT)")
    short = (n % 3 == 0) & (F.size("messages") > 1)
    return found.withColumns({"source_fingerprint": F.when(short, F.concat("source_fingerprint", F.lit("+"))).otherwise(F.col("source_fingerprint")), "messages": F.when(short, F.slice("messages", 1, F.size("messages") - 1)).otherwise(F.col("messages"))})


def _store(spark, sf_dir) -> Store:
    """A store of its own: all conversations, then an update of some and the deletion of others."""
    store = Store(spark, f"{shared_dir(spark)}/logloom-store-{uuid.uuid4().hex}")
    found = _scanned(spark, sf_dir)
    store.upsert(found, 1000)
    store.rebuild_index()
    store.upsert(_changed(found), 2000)
    dropped(found)
    there = store.table("conversations").where("CAST(substring(external_id, 2) AS BIGINT) % 10 <> 7").select("source_path", F.lit(True).alias("exists"))
    store.delete_missing(written(store.missing(there, ["claude_code"]), "missing"))
    store.refresh_index()
    return store


_DUCK_STORE = f"""{_DUCK_ML}, kept AS (SELECT conv_id, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS n, role, text AS content FROM ml WHERE {_STRIP.format('text')} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
st AS (SELECT * FROM kept WHERE conv_id % 10 <> 7 AND NOT (conv_id % 3 = 0 AND n > 1 AND idx = n - 1))"""


@register("store_messages", f"WITH {_DUCK_STORE} SELECT 's' || conv_id AS external_id, idx, role, content, sha256(content) AS content_hash FROM st")
def store_messages(spark, sf_dir):
    store = _store(spark, sf_dir)
    own = store.table("conversations").select(F.col("id").alias("conversation_id"), "external_id")
    return store.table("messages").join(own, "conversation_id").select("external_id", F.col("idx").cast("long").alias("idx"), "role", "content", "content_hash")


@register(
    "store_titles",
    f"""WITH {_DUCK_STORE}, f AS (SELECT conv_id, regexp_replace(split_part(arg_min(content, idx), chr(10), 1), chr(13) || '$', '') AS t FROM kept WHERE role = 'user' GROUP BY 1), c AS (SELECT DISTINCT conv_id, n FROM kept WHERE conv_id % 10 <> 7)
SELECT 's' || conv_id AS external_id, CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 2000 ELSE 1000 END AS indexed_at, CASE WHEN t IS NULL THEN 'Untitled' WHEN octet_length(encode(t)) <= 100 THEN t
  ELSE (SELECT max(p) FROM (SELECT substr(t, 1, k) AS p FROM range(1, 98) r(k)) WHERE octet_length(encode(p)) <= 97) || '...' END AS title FROM c LEFT JOIN f USING (conv_id)""",
)
def store_titles(spark, sf_dir):
    store = _store(spark, sf_dir)
    own = store.table("conversations")
    return titles(own, store.table("messages")).join(own.select("id", "external_id", "indexed_at"), "id").select("external_id", "indexed_at", "title")


@register("store_index", f"WITH {_DUCK_STORE} SELECT 's' || conv_id AS external_id, string_agg('[' || role || '] ' || content, chr(10) || chr(10) ORDER BY idx) AS content FROM st GROUP BY conv_id")
def store_index(spark, sf_dir):
    store = _store(spark, sf_dir)
    own = store.table("conversations").select("id", "external_id")
    return store.table("search_docs").join(own, "id").select("external_id", "content")


@register("store_usage_join", f"WITH {_DUCK_ML}, x AS (SELECT conv_id, turn // 4 AS i, max(length(text) + turn % 7 + 2) AS t FROM ml WHERE role = 'assistant' AND conv_id % 10 <> 7 GROUP BY 1, 2) SELECT 's' || conv_id AS logical_session_id, count(*) AS n, CAST(sum(t) AS BIGINT) AS total_tokens FROM x GROUP BY conv_id")
def store_usage_join(spark, sf_dir):
    store = _store(spark, sf_dir)
    rows = U.usage_rows(store.table("usage_events"), store.table("conversations"))
    return rows.groupBy("logical_session_id").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"))


@register("terminal_safe_titles", "SELECT page_id, regexp_replace(url, '[\\x00-\\x1f\\x7f-\\x9f]', chr(65533), 'g') AS url FROM pages")
def terminal_safe_titles(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.sanitized("url").alias("url"))

