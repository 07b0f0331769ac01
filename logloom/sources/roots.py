"""Where the agents keep their files: default roots with overrides of the environment, detection, and the rules of the
family of session trees (which folders and names count, whose sessions are copies, whose parent a path names)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import reading, session_headers, walk
from .lines import read, some

# Folders below the home, and the variables that replace or add to them.
TREE_HOMES = (".pi/agent", ".shuvpi/agent", ".shuvhelm/pi-agent", ".shuvhelm/mate")
FAMILY = {"factory": ".factory", "oh_my_pi": ".omp/agent", "prime_agent": ".prime/agent", "shuvlr": ".shuvlr"}
#: Sources whose sessions may be copies of those of another one.
COPIES = {"oh_my_pi": "pi_agent"}
#: Lines of a file among which its header stands.
HEADER_LINES = 4
#: Sources of which any file counts, whatever its name.
ANY_NAME = ("shuvlr",)


def unique(paths) -> list[str]:
    """Paths in order without those that name the same place again."""
    seen: dict[str, str] = {}
    for p in paths:
        seen.setdefault(os.path.realpath(p), str(p))
    return list(seen.values())


def default_roots(agent: str, home: str | Path | None = None, env: Mapping[str, str] | None = None) -> list[str]:
    env = os.environ if env is None else env
    home = Path(home) if home is not None else Path.home()
    if agent == "claude_code":
        return [str(home / ".claude" / "projects")]
    if agent == "codex":
        at = Path(env.get("CODEX_HOME") or home / ".codex")
        return [str(at / "sessions"), str(at / "archived_sessions")]
    if agent == "hermes":
        at = Path(env.get("HERMES_HOME") or home / ".hermes")
        profiles = sorted(p for p in (at / "profiles").glob("*") if (p / "state.db").is_file())
        return [str(at), *map(str, profiles)]
    if agent == "opencode":
        at = home / ".local" / "share" / "opencode"
        return unique([env.get("OPENCODE_STORAGE_ROOT") or at / "storage", at])
    if agent == "pi_agent":
        more = [p for p in (env.get("LOGLOOM_TREE_DIRS") or "").split(os.pathsep) if p]
        own = [env["PI_CODING_AGENT_DIR"]] if env.get("PI_CODING_AGENT_DIR") else []
        shiv, claw = env.get("SHIV_AGENT_DIR") or home / ".local" / "share" / "shiv", env.get("OPENCLAW_HOME") or home / ".openclaw"
        return unique([*own, *more, *(home / h for h in TREE_HOMES), shiv, claw])
    return [str(home / FAMILY[agent])]


def session_folders(root: str) -> tuple[list[str], bool]:
    """(``sessions`` and ``agents/*/sessions`` below a root, complete); what is there and no folder, or cannot be
    listed, makes it incomplete."""
    out, complete, base = [], True, Path(root)
    try:
        agents = sorted((base / "agents").iterdir()) if (base / "agents").is_dir() else []
    except OSError:
        agents, complete = [], False
    for at in (base / "sessions", *(a / "sessions" for a in agents)):
        if at.is_dir():
            out.append(str(at))
        elif at.exists():
            complete = False
    return unique(out), complete


def detected(agent: str, roots: list[str]) -> bool:
    """Whether anything of an agent is there."""
    if agent in FAMILY or agent == "pi_agent":
        return any(folders or not complete for folders, complete in map(session_folders, roots))
    if agent == "hermes":
        return any((Path(r) / "state.db").is_file() for r in roots)
    return any(Path(r).is_dir() for r in roots)


# ---------------------------------------------------------------- session trees
def _is_uuid(text: str) -> bool:
    try:
        uuid.UUID(text)
    except ValueError:
        return False
    return True


def session_name(name: str) -> bool:
    """``time_id.jsonl``, ``session-time.jsonl`` or ``id.jsonl``."""
    return "_" in name or name.startswith("session-") or name.endswith(".jsonl") and _is_uuid(name.removesuffix(".jsonl"))


#: The same as a pattern for whole paths.
SESSION_PATH = r"/([^/]*_[^/]*|session-[^/]*|[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\.jsonl)$"


def session_ids(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Distinct ids in the headers, one of the first four lines, of the session files below the folders."""
    files, _ = walk(spark, folders, ("*.jsonl",), SESSION_PATH)
    lines = reading(spark, files, folders, ("*.jsonl",), lambda paths, glob: read(spark, paths, glob))
    if lines is None:
        return spark.createDataFrame([], "external_id string")
    head = lines.where((F.col("block") == 0) & some(F.col("line"))).withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("row"))).where(f"n <= {HEADER_LINES}")
    return session_headers(head.drop("n"), ("session", "session_start")).select(F.col("id").alias("external_id")).distinct()


def without_copies(conversations: DataFrame, originals: DataFrame) -> DataFrame:
    """Conversations whose session id is none of ``originals`` (external_id)."""
    known = originals.select(F.col("external_id")).where("external_id is not null").distinct()
    return conversations.join(known, "external_id", "left_anti").select(*conversations.columns)


def scan_roots(agent: str, roots: list[str]) -> list[str]:
    """The folders to read: of session trees those that hold sessions, else the roots that are there."""
    if agent in FAMILY or agent == "pi_agent":
        return unique(f for r in roots for f in session_folders(r)[0])
    return [r for r in roots if Path(r).is_dir()]


def unlisted(agent: str, roots: list[str]) -> bool:
    """Whether folders of session trees cannot be told, so that a scan of what is known is incomplete."""
    return (agent in FAMILY or agent == "pi_agent") and not all(complete for _, complete in map(session_folders, roots))
