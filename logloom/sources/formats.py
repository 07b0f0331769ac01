"""Connectors of the line sources."""

from __future__ import annotations

from .base import Connector
from .lines import message_lines, rollout_objects, rollouts, session_trees
from .roots import ANY_NAME, SESSION_PATH

CONNECTORS = {
    "claude_code": Connector("claude_code", ("*.jsonl",), message_lines),
    "codex": Connector("codex", ("rollout-*.jsonl",), rollouts, ("rollout-*.json",), rollout_objects),
    **{a: Connector(a, ("*.jsonl",), session_trees, keep=None if a in ANY_NAME else SESSION_PATH, headers=True) for a in ("pi_agent", "factory", "oh_my_pi", "prime_agent", "shuvlr")},
}
