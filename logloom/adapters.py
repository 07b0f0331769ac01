"""Maps the driver's tables onto the model, by expressions that Spark and DuckDB read alike.

``{ms}``, ``{k}`` and ``{div}`` differ between the two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canon, text
from .schema import AGENTS

AS_OF = 1_706_745_600_000  # 2024-02-01
SPARK = {"ms": "(unix_micros(CAST(ts AS TIMESTAMP)) div 1000)", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "div": "div", "str": "STRING"}
DUCK = {"ms": "(epoch_us(ts) // 1000)", "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "div": "//", "str": "VARCHAR"}

_AGENT = "CASE {x} % 9 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGENTS)) + " END"
_GRAIN = "CASE event_id % 10 WHEN 8 THEN 'interval_aggregate' WHEN 9 THEN 'session_aggregate' ELSE 'event' END"

EVENT = {
    "conversation_id": "user_id",
    "idx": "CAST(event_id AS INT)",
    "agent": _AGENT.format(x="event_id"),
    "workspace": "CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN '/repo/src' WHEN user_id % 3 = 1 THEN '/repo' ELSE '/repository' END",
    "logical_session_id": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('s', CAST(user_id % 40 AS {str})) END",
    "record_kind": "CASE event_id % 4 WHEN 0 THEN 'child_agent' WHEN 1 THEN 'automation' ELSE 'top_level' END",
    "is_synthetic": "event_id % 13 = 0",
    "usage_grain": _GRAIN,
    "timestamp": "CASE WHEN event_id % 10 < 8 AND event_id % 50 <> 1 THEN {ms} END",
    "interval_start": "CASE WHEN event_id % 10 >= 8 THEN {ms} END",
    "interval_end": "CASE event_id % 10 WHEN 8 THEN {ms} + 7200000 WHEN 9 THEN {ms} + 259200000 END",
    "provider": "CASE WHEN event_type = 'error' THEN NULL ELSE CASE event_id % 7 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'openai' WHEN 2 THEN 'Anthropic' WHEN 3 THEN 'google' WHEN 4 THEN 'x-ai' WHEN 5 THEN 'custom' ELSE 'ZAI' END END",
    "billing_base_url": "CASE event_id % 16 WHEN 0 THEN 'https://user@api.openai.com:443/v1' WHEN 1 THEN 'https://gateway.example.net/v1?x=1' WHEN 2 THEN 'API.X.AI./v1' END",
    "model": "CASE WHEN event_type = 'error' THEN NULL ELSE CASE event_id % 7 WHEN 0 THEN 'gpt-5.5' WHEN 1 THEN 'GPT-5' WHEN 2 THEN 'claude-opus-4-6' WHEN 3 THEN 'gemini-3.1-pro-preview' WHEN 4 THEN 'grok-4.3' WHEN 5 THEN 'openrouter/qwen3' ELSE 'glm-5' END END",
    "model_variant": "CASE event_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'high' WHEN 2 THEN 'low' END",
    "task": "CASE event_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'Review' END",
    "billing_mode": "CASE event_id % 12 WHEN 0 THEN 'batch' WHEN 1 THEN 'oauth-plan' END",
    "source_event_id": "CASE WHEN event_id % 3 = 0 THEN concat('e', CAST(event_id - event_id % 12 AS {str})) WHEN event_id % 97 = 1 THEN '' END",
    "api_calls": "1 + event_id % 3",
    "request_attempts": "2 + event_id % 3",
    "input_tokens": "{k} * 10",
    "output_tokens": "{k} * 4",
    "cache_read_tokens": "{k} * 3",
    "cache_write_tokens": "CASE WHEN event_id % 7 = 6 THEN {k} % 3 ELSE 0 END",
    "reasoning_tokens": "{k}",
    "total_tokens": "{k} * 17 + CASE WHEN event_id % 7 = 6 THEN {k} % 3 ELSE 0 END + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END",
    "reported_total_tokens": "CASE WHEN event_id % 9 < 7 THEN {k} * 17 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END END",
    "component_total_tokens": "{k} * 17 + CASE WHEN event_id % 7 = 6 THEN {k} % 3 ELSE 0 END",
    "token_semantics": "CASE event_id % 4 WHEN 0 THEN 'message-v1' WHEN 1 THEN 'cumulative-v2' END",
    "actual_cost_usd": "CASE WHEN event_type IN ('click', 'purchase') THEN value / 100 WHEN event_type = 'signup' THEN 0.0 END",
    "estimated_cost_usd": "CASE WHEN event_type = 'view' THEN value / 50 WHEN event_type = 'signup' THEN 0.0 END",
    "cost_status": "CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'included' WHEN 1 THEN 'source_reported_zero' WHEN 2 THEN 'Actual' ELSE 'contract' END END",
    "cost_source": "CASE WHEN event_type IN ('click', 'purchase') THEN 'ledger' END",
    "cost_currency": "CAST(NULL AS {str})",
    "pricing_version": "CASE WHEN event_id % 6 = 0 THEN 'v1' END",
}


def select_list(columns: dict[str, str], words: dict[str, str]) -> str:
    return ", ".join(f"{v.format(**words) if '{' in v else v} AS {k}" for k, v in columns.items())


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as usage rows joined with their conversation."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{v.format(**SPARK) if '{' in v else v} AS {k}" for k, v in EVENT.items()])
    empty = {c: F.lit(None).cast("string") for c in ("provider_family", "provider_inference_source", "provider_inference_confidence", "model_family")}
    longs = {c: F.col(c).cast("long") for c, v in EVENT.items() if c.endswith("_tokens") or c in ("api_calls", "request_attempts")}
    return canon.enrich(rows.withColumns({**empty, **longs}).withColumns({c: F.col(c).cast("double") for c in ("actual_cost_usd", "estimated_cost_usd")}))


def duck_usage() -> str:
    """The same rows as a DuckDB common table expression named u."""
    url = "lower(nullif(trim(billing_base_url), ''))"
    host = f"rtrim(regexp_extract(regexp_extract(regexp_extract(regexp_replace({url}, '^.*?://', ''), '^([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1), '.')"
    by_url = "CASE " + " ".join(f"WHEN {host} = '{d}' OR {host} LIKE '%.{d}' THEN '{f}'" for d, f in canon.PROVIDER_DOMAINS) + " END"
    by_name = "CASE lower(provider) " + " ".join(f"WHEN '{r}' THEN '{f}'" for f, raws in canon.PROVIDER_NAMES.items() for r in raws) + " END"
    model = "CASE " + " ".join(f"WHEN {' OR '.join(f'''lower(model) LIKE '{p}' ''' for p in ps)} THEN '{f}'" for ps, f in canon.MODEL_PATTERNS) + " END"
    return f"""u0 AS (SELECT {select_list(EVENT, DUCK)} FROM events),
u1 AS (SELECT u0.* EXCLUDE (cost_status, cost_currency),
  CASE WHEN billing_base_url IS NOT NULL THEN {by_url} ELSE {by_name} END AS provider_family,
  CASE WHEN billing_base_url IS NOT NULL THEN CASE WHEN {by_url} IS NOT NULL THEN 'billing_base_url' ELSE 'billing_base_url_unmapped' END
       WHEN provider IS NOT NULL THEN CASE WHEN {by_name} IS NOT NULL THEN 'raw_provider' ELSE 'raw_provider_unmapped' END END AS provider_inference_source,
  {model} AS model_family,
  coalesce(cost_status, CASE WHEN actual_cost_usd > 0 THEN 'reported_actual' WHEN estimated_cost_usd > 0 THEN 'source_estimated' ELSE 'unknown' END) AS cost_status FROM u0),
u AS (SELECT *, CASE WHEN provider_inference_source IS NULL THEN NULL WHEN provider_family IS NULL THEN 'none' ELSE 'high' END AS provider_inference_confidence,
  CASE WHEN usage_grain = 'event' THEN timestamp ELSE interval_start END AS s, CASE WHEN usage_grain = 'event' THEN timestamp ELSE interval_end END AS e,
  nullif(trim(source_event_id), '') AS sid,
  CASE WHEN actual_cost_usd > 0 OR actual_cost_usd = 0 AND lower(cost_status) IN ('actual', 'reported_actual') THEN actual_cost_usd END AS act,
  CASE WHEN estimated_cost_usd > 0 OR estimated_cost_usd = 0 AND lower(cost_status) IN ('estimated', 'source_estimated', 'source_reported_zero', 'included') THEN estimated_cost_usd END AS est
  FROM u1)"""


def duck_dedup(source: str = "u") -> str:
    """d: rows of ``source`` after the dedup merge, with ls and le (logical start and end)."""
    known = lambda c: f"(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 0 ELSE 1 END)"
    detail = " + ".join(f"(CASE WHEN {t}_tokens > 0 THEN 1 ELSE 0 END)" for t in ("input", "output", "cache_read", "cache_write", "reasoning"))
    order = "coalesce(timestamp, interval_start) ASC NULLS FIRST, conversation_id, idx"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY agent, sid ORDER BY {order}) AS rn,
    row_number() OVER (PARTITION BY agent, sid ORDER BY total_tokens DESC, {detail} DESC, (CASE WHEN s IS NULL THEN 0 ELSE 1 END) DESC, s ASC NULLS LAST,
      {known('provider')} DESC, {known('model')} DESC, {known('provider_family')} DESC, (CASE WHEN act IS NULL AND est IS NULL THEN 0 ELSE 1 END) DESC, conversation_id, {order}) AS best
  FROM {source}),
o2 AS (SELECT *, min(CASE WHEN usage_grain <> 'event' THEN rn END) OVER (PARTITION BY agent, sid) AS other FROM o),
o3 AS (SELECT *, min(s) OVER (PARTITION BY agent, sid) AS ms,
    min(CASE WHEN rn < other THEN s END) OVER (PARTITION BY agent, sid) AS prefix, max(CASE WHEN rn >= other THEN e END) OVER (PARTITION BY agent, sid) AS rest FROM o2),
d AS (SELECT *, CASE WHEN sid IS NULL THEN s ELSE ms END AS ls,
    CASE WHEN sid IS NULL THEN e WHEN other IS NULL THEN ms ELSE greatest(prefix, rest) END AS le FROM o3 WHERE sid IS NULL OR best = 1)"""


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of the conversations table."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    messages = rows.select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("idx"), "role", F.col("text").alias("content"), F.lit(None).cast("long").alias("timestamp"), F.lit(None).cast("string").alias("model"))
    own = rows.select("conv_id").distinct().selectExpr(
        "conv_id AS id", f"{_AGENT.format(x='conv_id')} AS agent", "CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 2 = 0 THEN '/repo/a' ELSE '/other' END AS workspace",
        "CASE WHEN conv_id % 6 = 0 THEN '' WHEN conv_id % 7 = 0 THEN NULL ELSE concat('s', CAST(conv_id % 30 AS STRING)) END AS logical_session_id", "1700000000000 + conv_id * 86400000 AS started_at",
        "concat('/logs/', CAST(conv_id AS STRING), '.jsonl') AS source_path", "conv_id * 1000 AS indexed_at",
    )
    return own, messages


DUCK_CONVERSATIONS = f"""c AS (SELECT DISTINCT conv_id AS id, {_AGENT.format(x='conv_id')} AS agent,
  CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 2 = 0 THEN '/repo/a' ELSE '/other' END AS workspace,
  CASE WHEN conv_id % 6 = 0 THEN '' WHEN conv_id % 7 = 0 THEN NULL ELSE concat('s', CAST(conv_id % 30 AS VARCHAR)) END AS logical_session_id,
  1700000000000 + conv_id * 86400000 AS started_at, conv_id * 1000 AS indexed_at FROM conversations),
m AS (SELECT conv_id AS conversation_id, turn AS idx, role, text AS content FROM conversations)"""


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    body = F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("doc_id").alias("id"), text.truncated(text.first_line(body), 100).alias("title"), body.alias("content"), text.preview(body).alias("preview"), F.expr(_AGENT.format(x="doc_id")).alias("agent"),
        F.expr("CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('/repo/', source) END").alias("workspace"), F.expr("concat('/logs/', CAST(doc_id AS STRING))").alias("source_path"),
        F.expr(f"CASE WHEN doc_id % 9 = 4 THEN NULL ELSE {AS_OF} - (doc_id % 500) * 43200000 END").cast("long").alias("created_at"),
    )


DUCK_DOCS = f"""docs AS (SELECT doc_id AS id, regexp_replace(split_part(coalesce(text, ''), chr(10), 1), chr(13) || '$', '') AS line, coalesce(text, '') AS content, {_AGENT.format(x='doc_id')} AS agent,
  CASE WHEN doc_id % 8 = 0 THEN '' ELSE concat('/repo/', source) END AS workspace,
  CASE WHEN doc_id % 9 = 4 THEN 0 ELSE {AS_OF} - (doc_id % 500) * 43200000 END AS created_at FROM documents WHERE doc_id IS NOT NULL)"""
