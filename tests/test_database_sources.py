"""The two database sources and the JSON tree, on small stores of our own making."""

import base64
import json
import sqlite3

from pyspark.sql import functions as F

from logloom.operators.store import Store
from logloom.sources import database, hermes, opencode
from logloom.sources.base import scan
from logloom.streaming.ingest import index


def make(path, tables):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    for name, (columns, rows) in tables.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(columns.split(',')))})", rows)
    db.commit()
    db.close()


def test_hermes(spark, tmp_path):
    sessions = "id TEXT, source TEXT, model TEXT, started_at REAL, ended_at REAL, title TEXT, cwd TEXT, git_repo_root TEXT, parent_session_id TEXT, api_call_count INT, input_tokens INT, output_tokens INT, billing_provider TEXT, estimated_cost_usd REAL, cost_status TEXT"
    make(tmp_path / "home" / "state.db", {
        "sessions": (sessions, [
            ("top", "cli", "m-1", 1000.5, None, None, None, " /w ", None, 5, 70, 30, "openai", 0.5, "estimated"),
            ("kid", "subagent", "m-2", 1001, 1100, "Own", None, None, "top", -4, 0, 0, None, 0.0, "included"),
            ("grandkid", "cli", None, None, None, None, "", "", "kid", None, None, None, None, None, None),
            ("a", "cron", None, 1, 2, None, None, None, "b", 1, 1, 0, None, None, None),
            ("b", "test", None, 1, 2, None, None, None, "a", 1, 1, 0, None, None, None),
            ("stray", "webhook", None, 1, 2, None, None, None, "gone", 1, 1, 0, None, None, None),
            ("mute", "fixture", None, 1, 2, None, None, None, None, 0, 0, 0, None, None, None),
        ]),
        "messages": ("id INT, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, tool_name TEXT, timestamp REAL, active INT, compacted INT", [
            (1, "top", "user", "first line\nsecond", None, None, 1002, 1, 0),
            (2, "top", "assistant", json.dumps([{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]), json.dumps([{"function": {"name": "grep", "arguments": {"b": 1, "a": 2}}}, {"name": "ls"}]), None, 1003, 0, 1),
            (3, "top", "tool", "42", None, "grep", 1004, 1, 0),
            (4, "top", "user", "hidden", None, None, 1005, 0, 0),
            (5, "top", "alien", "?", None, None, 1005, 1, 0),
            (6, "grandkid", "user", "hi", None, None, 2000, 1, 0),
        ]),
        "session_model_usage": ("session_id TEXT, model TEXT, api_call_count INT, input_tokens INT, output_tokens INT, estimated_cost_usd REAL, cost_status TEXT, first_seen REAL, last_seen REAL", [
            ("top", "m-1", 2, 40, 10, 0.2, None, 1000, 1050), ("top", "m-0", 1, 10, 50, None, None, 1010, 1020), ("top", " ", 0, 0, 0, 0.0, None, 1, 1),
        ]),
    })
    found = hermes.scan(spark, [str(tmp_path)])
    assert found.complete
    got = {r.external_id: r for r in found.conversations.collect()}
    assert set(got) == {"top", "kid", "grandkid", "a", "b", "stray"}
    top = got["top"]
    assert (top.title, top.workspace, top.logical_session_id, top.record_kind, top.started_at, top.ended_at) == ("first line", "/w", "top", "top_level", 1000500, 1004000)
    assert [(m.idx, m.role, m.content) for m in top.messages] == [(0, "user", "first line\nsecond"), (1, "assistant", "x\ny"), (2, "tool", '[Tool: grep] {"a":2,"b":1}\n[Tool: ls]'), (3, "tool", "[Tool: grep]\n42")]
    assert [(u.usage_grain, u.model, u.api_calls, u.input_tokens, u.output_tokens, u.total_tokens) for u in top.usage] == [("interval_aggregate", "m-1", 2, 40, 10, 50), ("interval_aggregate", "m-0", 1, 10, 50, 60), ("session_aggregate", "m-1", 2, 20, 0, 0)]
    assert abs(top.usage[2].estimated_cost_usd - 0.3) < 1e-9 and top.usage[2].interval_start == 1000500 and top.usage[2].component_total_tokens == 0
    assert (got["kid"].workspace, got["kid"].logical_session_id, got["kid"].record_kind, got["kid"].usage[0].estimated_cost_usd, got["kid"].usage[0].cost_currency) == ("/w", "top", "child_agent", 0.0, "USD")
    assert (got["grandkid"].workspace, got["grandkid"].logical_session_id, got["grandkid"].title) == ("/w", "top", "hi")
    assert (got["a"].logical_session_id, got["b"].logical_session_id, got["stray"].logical_session_id) == ("a", "b", "gone")
    assert database.rows_of is not None and got["top"].source_path.endswith("/.logloom-sessions/hermes/dG9w")
    store = Store(spark, str(tmp_path / "store"))
    assert store.upsert(found.conversations, 5) == {"inserted": 6, "updated": 0} and store.upsert(found.conversations, 6) == {"inserted": 0, "updated": 0}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "state.db").write_bytes(b"no database at all" * 100)
    assert [r.source_path.endswith("bad/state.db") for r in hermes.scan(spark, [str(tmp_path)]).errors.collect()] == [True]


SESSION = "id TEXT, directory TEXT, title TEXT, time_created INT, time_updated INT, model TEXT, parent_id TEXT, agent TEXT, cost REAL, tokens_input INT, tokens_output INT, tokens_reasoning INT, tokens_cache_read INT, tokens_cache_write INT"


def test_opencode(spark, tmp_path):
    model = json.dumps({"modelID": "m-9", "providerID": "anthropic", "variant": "high"})
    attached = base64.b64encode(b"inside").decode()
    make(tmp_path / "one.db", {
        "session": (SESSION, [("s1", "/w", "", 100, 900, model, None, "build", 2.0, 50, 20, 10, 0, 0), ("s2", "/w", "Second", 100, 900, "plain-model", "s1", None, None, None, None, None, None, None), ("s3", "/w", "Empty", 1, 2, None, None, None, None, 0, 0, 0, 0, 0)]),
        "message": ("id TEXT, session_id TEXT, time_created INT, data TEXT", [
            ("m1", "s1", 110, json.dumps({"role": "user"})),
            ("m2", "s1", 120, json.dumps({"role": "assistant", "time": {"created": 125}, "modelID": "m-8", "providerID": "openai", "cost": 0.5, "tokens": {"input": 30, "output": 5, "reasoning": 5, "cache": {"read": 7}}})),
            ("m3", "s2", 130, json.dumps({"role": "user"})),
        ]),
        "part": ("id TEXT, message_id TEXT, time_created INT, data TEXT", [
            ("p1", "m1", 110, json.dumps({"type": "text", "text": "Please\nhelp"})),
            ("p2", "m2", 120, json.dumps({"type": "tool", "tool": "grep", "state": {"input": {"z": 1, "a": [2]}, "output": "found"}})),
            ("p3", "m2", 121, json.dumps({"type": "file", "filename": "n.txt", "mime": "text/plain", "data": attached})),
            ("p4", "m2", 122, json.dumps({"type": "patch", "files": ["x", "y"]})),
            ("p5", "m2", 123, json.dumps({"type": "step-start"})),
            ("p6", "m3", 130, json.dumps({"type": "subtask", "prompt": "go"})),
        ]),
    })
    make(tmp_path / "two.db", {
        "sessions": (SESSION, [("s1", "/w/longer", "A title", 90, 950, model, None, None, None, None, None, None, None, None)]),
        "session_message": ("id TEXT, session_id TEXT, type TEXT, seq INT, time_created INT, data TEXT", [
            ("m2", "s1", "assistant", 2, 120, json.dumps({"time": {"created": 125}, "content": [{"type": "text", "text": "done"}], "tokens": {"input": 28, "output": 9, "total": 60}, "model": {"id": "m-8", "providerID": "openai"}})),
            ("m5", "s1", "assistant", 3, 140, json.dumps({"error": {"name": "Late"}})),
            ("m6", "s1", "skill", 4, 150, json.dumps({"name": "lint", "text": "rules"})),
            ("m7", "s1", "shell", 5, 160, json.dumps({"command": "ls", "output": {"b": 1, "a": 2}})),
            ("m8", "s1", "user", 6, 170, json.dumps({"text": "see", "files": [{"name": "f"}]})),
        ]),
    })
    tree = tmp_path / "storage"
    for where, value in {
        "session/p/s4.json": {"id": "s4", "projectID": "p", "directory": "/t", "time": {"created": 5, "updated": 6}, "parentID": "s1"},
        "session/p/bad.json": {"id": "s5"},
        "message/s4/m9.json": {"id": "m9", "sessionID": "s4", "role": "assistant", "time": {"created": 7}, "tokens": {"input": 1, "output": 2}},
        "part/m9/p9.json": {"id": "p9", "messageID": "m9", "type": "text", "text": "tree"},
        "part/m9/p8.json": {"id": "p8", "messageID": "m9", "type": "tool", "name": "sed"},
        "message/lost/m10.json": {"id": "m10", "sessionID": "lost", "role": "user", "time": {"created": 50}},
        "part/m10/p10.json": {"id": "p10", "messageID": "m10", "type": "text", "text": "lone"},
    }.items():
        (tree / where).parent.mkdir(parents=True, exist_ok=True)
        (tree / where).write_text(json.dumps(value))
    (tree / "part/m9/p7.json").write_text('{"id": "p7", "messageID": "m9", "type": "text", "text": "half \\ud83d pair, whole \\ud83d\\ude00"}')
    found = opencode.scan(spark, [str(tmp_path)])
    got = {r.external_id: r for r in found.conversations.collect()}
    assert set(got) == {"s1", "s2", "s4"} and [r.source_path.rsplit("/", 1)[1] for r in found.errors.collect()] == ["bad.json"]
    s1 = got["s1"]
    assert (s1.title, s1.workspace, s1.started_at, s1.ended_at, s1.record_kind, s1.logical_session_id) == ("A title", "/w/longer", 110, 170, "top_level", "s1")
    assert [(m.role, m.content) for m in s1.messages] == [
        ("user", "Please\nhelp"), ("assistant", "[Attachment: n.txt (text/plain)]\ninside"), ("assistant", "done"), ("tool", "[Patch]\nx\ny"), ("tool", '[Tool: grep]\nInput: {"a":[2],"z":1}\nOutput: found'),
        ("assistant", '[Assistant error] {"name":"Late"}'), ("system", "[Skill: lint]\nrules"), ("tool", '[Shell]\nCommand: ls\nOutput: {"b":1,"a":2}'), ("user", "see\n[Attachment: f]"),
    ]
    use = {u.source_event_id: u for u in s1.usage}
    merged, failed, rest = use["opencode-message:s1:m2"], use["opencode-message:s1:m5"], use["opencode-session-aggregate:s1"]
    assert (merged.input_tokens, merged.output_tokens, merged.reasoning_tokens, merged.cache_read_tokens, merged.total_tokens, merged.reported_total_tokens, merged.provider) == (30, 10, 5, 7, 60, 60, "openai")
    assert (failed.api_calls, failed.request_attempts, failed.total_tokens) == (0, 1, 0)
    assert (rest.input_tokens, rest.output_tokens, rest.total_tokens, rest.model, rest.model_variant, rest.task) == (20, 20, 33, "m-9", "high", "build") and abs(rest.estimated_cost_usd - 1.5) < 1e-9
    assert (got["s2"].record_kind, got["s2"].logical_session_id, got["s2"].messages[0].content, got["s2"].messages[0].model) == ("child_agent", "s1", "[Subtask] go", "plain-model")
    assert [m.content for m in got["s4"].messages] == ["[Tool: sed]", "half � pair, whole \U0001f600", "tree"] and got["s4"].logical_session_id == "s1"
    lost = {r.external_id: r for r in opencode.scan(spark, [str(tmp_path)], recover=True).conversations.collect()}["lost"]
    assert (lost.title, lost.record_kind, lost.is_synthetic, lost.started_at) == ("Recovered OpenCode session lost", "recovered", True, 50)
    known = spark.createDataFrame([("s1",)], "external_id string")
    assert not opencode.disjoint(known, found.conversations) and opencode.disjoint(known, found.conversations.where("external_id != 's1'"))
    assert {r[0] for r in opencode.unindexed(spark, [str(tmp_path)], known).collect()} == {"s2", "s3", "s4", "s5"}


def test_merge_rules(spark):
    """Kinds, roots and texts of one session in two stores; equal rows without an event are one."""
    cols = "external_id string, started_at long, ended_at long, title string, workspace string, parent_external_id string, record_kind string, is_synthetic boolean, logical_session_id string"
    rows = spark.createDataFrame([("s", 5, 6, "bb", None, None, "top_level", False, "s"), ("s", 3, 4, "aaa", "/x", "p", "recovered", True, "root"), ("t", 1, 1, " ", None, "q", "fork", False, "t")], cols)
    got = {r.external_id: r for r in opencode.merged_facts(rows).collect()}
    assert (got["s"].started_at, got["s"].ended_at, got["s"].title, got["s"].record_kind, got["s"].is_synthetic, got["s"].logical_session_id) == (3, 6, "aaa", "top_level", True, "root")
    assert got["t"].logical_session_id == "q" and got["t"].title is None
    u = database.usage_frame(spark.createDataFrame([("s", None, 1, 5), ("s", None, 1, 5), ("s", " e ", 2, 3), ("s", "e", 1, 9)], "conversation_id string, source_event_id string, api_calls long, input_tokens long"))
    merged = database.merged_usage(u).orderBy("idx").collect()
    assert [(r.idx, r.api_calls, r.input_tokens, r.total_tokens) for r in merged] == [(0, 1, 5, 0), (1, 2, 9, 9)]


def test_index_of_databases(spark, tmp_path):
    """``index`` takes the database sources like the others."""
    make(tmp_path / "h" / "state.db", {"sessions": ("id TEXT, source TEXT, model TEXT, started_at REAL", [("z", "cli", "m", 1.0)]), "messages": ("id INT, session_id TEXT, role TEXT, content TEXT", [(1, "z", "user", "hello")])})
    store = Store(spark, str(tmp_path / "store"))
    from logloom.sources import connectors

    out = index(store, {"hermes": connectors()["hermes"]}, {"hermes": [str(tmp_path / "h")]}, now_ms=1000)
    assert index(store, {"hermes": connectors()["hermes"]}, {"hermes": [str(tmp_path / "h")]}, now_ms=4_000_000_000_000)["deleted"] == 0
    again = index(store, {"hermes": connectors()["hermes"]}, {"hermes": [str(tmp_path / "h")]}, now_ms=4_000_000_000_001)
    assert (again["inserted"], again["updated"], again["deleted"], again["complete"]) == (0, 0, 0, True)  # no file is as new as the last scan
    (tmp_path / "h" / "state.db-wal").touch()
    own, at = connectors()["hermes"], [str(tmp_path / "h")]
    first = scan(spark, own, at, 1000)
    assert not first.unchanged and scan(spark, own, at, 4_000_000_000_000, None, first.mark).unchanged and not scan(spark, own, at, 4_000_000_000_000, None, "0:0").unchanged
    assert out["inserted"] == 1 and out["complete"] and store.table("messages").select(F.col("content")).first()[0] == "hello"
    (tmp_path / "h" / "state.db").unlink()
    make(tmp_path / "h" / "state.db", {"sessions": ("id TEXT, source TEXT, model TEXT, started_at REAL", [("y", "cli", "m", 1.0)]), "messages": ("id INT, session_id TEXT, role TEXT, content TEXT", [(1, "y", "user", "other")])})
    out = index(store, {"hermes": connectors()["hermes"]}, {"hermes": [str(tmp_path / "h")]}, full=True, now_ms=2000)
    assert (out["inserted"], out["deleted"]) == (1, 1)
