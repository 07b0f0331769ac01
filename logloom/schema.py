"""Tables, enumerations and versions of the model."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION, DOCUMENT_FORMAT = 4, 2

# Slugs with display names, accepted spellings, and parser revisions.
AGENTS = {
    "claude_code": "Claude Code",
    "codex": "Codex",
    "factory": "Factory Droid",
    "hermes": "Hermes Agent",
    "oh_my_pi": "Oh My Pi",
    "opencode": "OpenCode",
    "pi_agent": "Pi Agent",
    "prime_agent": "Prime Agent",
    "shuvlr": "shuvlr",
}
AGENT_ALIASES = {
    "claude": "claude_code",
    "claudecode": "claude_code",
    "factory_droid": "factory",
    "droid": "factory",
    "hermes_agent": "hermes",
    "hermesagent": "hermes",
    "ohmypi": "oh_my_pi",
    "omp": "oh_my_pi",
    "open_code": "opencode",
    "piagent": "pi_agent",
    "pi": "pi_agent",
    "primeagent": "prime_agent",
    "prime": "prime_agent",
}
PARSER_REVISIONS = {"claude_code": 3, "codex": 7, "hermes": 5, "opencode": 7, "pi_agent": 5, "factory": 5, "oh_my_pi": 5, "prime_agent": 5, "shuvlr": 5}
ROLES = {"user": "user", "assistant": "assistant", "tool": "tool", "toolresult": "tool", "tool_result": "tool", "system": "system"}
GRAINS = ("event", "interval_aggregate", "session_aggregate")
RANKINGS = ("recent", "balanced", "relevance", "newest", "oldest")
BUCKETS = ("auto", "day", "week", "month")


def parse_agent(text: str) -> str:
    """Slug of a slug or another accepted spelling, in any case."""
    low = text.strip().lower()
    slug = low if low in AGENTS else AGENT_ALIASES.get(low)
    if slug is None:
        raise ValueError(f"unknown agent: {text}")
    return slug


def parse_role(text: str | None) -> str | None:
    return ROLES.get(text.lower()) if isinstance(text, str) else None


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(spec: str) -> T.StructType:
    """From ``name type`` pairs; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (pair.split() for pair in spec.split(","))])


USAGE_COLUMNS = (
    "timestamp long, interval_start long, interval_end long, usage_grain string, provider string, provider_family string, "
    "provider_inference_source string, provider_inference_confidence string, model string, model_family string, model_variant string, "
    "task string, billing_base_url string, billing_mode string, source_event_id string, api_calls long, request_attempts long, "
    "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, total_tokens long, "
    "reported_total_tokens long, component_total_tokens long, token_semantics string, actual_cost_usd double, estimated_cost_usd double, "
    "cost_status string, cost_source string, cost_currency string, pricing_version string"
)
USAGE_RECORD = _struct(USAGE_COLUMNS)
MESSAGE_RECORD = _struct("idx int, role string, content string, timestamp long, model string")
SOURCE_FILE = _struct("path string, mtime long, size long")
CONVERSATION_RECORD = T.StructType(
    [
        *_struct("agent string, external_id string, title string, workspace string, source_path string, source_fingerprint string, source_mtime_max long, started_at long, ended_at long, logical_session_id string, parent_external_id string, record_kind string, is_synthetic boolean").fields,
        T.StructField("source_files", T.ArrayType(SOURCE_FILE)),
        T.StructField("messages", T.ArrayType(MESSAGE_RECORD)),
        T.StructField("usage", T.ArrayType(USAGE_RECORD)),
    ]
)
CONVERSATIONS = _struct("id long, agent string, external_id string, title string, workspace string, source_path string, started_at long, ended_at long, indexed_at long, source_mtime_max long, source_fingerprint string, logical_session_id string, parent_external_id string, record_kind string, is_synthetic boolean")
MESSAGES = _struct("conversation_id long, idx int, role string, content string, timestamp long, model string, content_hash string")
USAGE_EVENTS = T.StructType([*_struct("conversation_id long, idx int").fields, *USAGE_RECORD.fields])
EMBEDDINGS = _struct("conversation_id long, embedding array<float>")
