"""Line sources as DataFrames, and ingestion that is complete and deletes only what is gone."""

import json
import os
import random
import shutil
import sqlite3

import pytest
from pyspark.sql import functions as F

from logloom.operators.store import Store
from logloom.sources import connectors, hermes, lines, opencode, wal
from logloom.sources.base import existence, scan, walk
from logloom.sources.formats import CONNECTORS
from logloom.streaming import ingest
from logloom.streaming.ingest import index

UUID = "123e4567-e89b-12d3-a456-426614174000"


def put(path, *rows, mtime=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    if mtime:
        os.utime(path, (mtime, mtime))
    return path


def said(text="hi", role="user", **more):
    return {"type": "message", "message": {"role": role, "content": text}} | more


def tree(path, ident, *rows, **more):
    return put(path, {"type": "session", "id": ident, "cwd": "/w"}, *(rows or (said(),)), **more)


def paths(store):
    return {r[0] for r in store.table("conversations").select("source_path").collect()}


# ---------------------------------------------------------------- lines
def test_state_is_carried_over_splits(spark):
    """Splits of any size give what one split gives."""
    rng = random.Random(3)
    rows = [(f"/f{f}", k, rng.choice([None, None, "a", "b"]), rng.random() < 0.5) for f in range(3) for k in range(40)]
    whole = None
    for size in (1, 3, 7, 100):
        frame = spark.createDataFrame([(p, k // size, k, v, o) for p, k, v, o in rows], "path string, block long, row long, v string, o boolean")
        got = sorted((r.path, r.row, r.v_now, r.v_before, r.o_count) for r in lines.running(frame, ["v"], ["v"], ["o"]).collect())
        whole = whole or got
        assert got == whole
    for p, k, now, before, n in whole:
        own = [x for x in rows if x[0] == p]
        assert now == next((v for _, j, v, _ in reversed(own) if j <= k and v), None) and before == next((v for _, j, v, _ in reversed(own) if j < k and v), None)
        assert n == sum(o for _, j, _, o in own if j < k)


def test_long_file_is_split(spark, tmp_path):
    """A file of many splits is read by many tasks and folds to one conversation."""
    rows = [{"type": "turn_context", "payload": {"model": "m1"}}]
    for k in range(3000):
        rows.append({"type": "response_item", "timestamp": 1_700_000_000 + k, "payload": {"role": "user" if k % 2 else "assistant", "content": [{"type": "text", "text": f"line {k // 2 * 2} " + "x" * 50}]}})
        if k == 1500:
            rows.append({"type": "turn_context", "payload": {"model": "m2"}})
    put(tmp_path / "rollout-1.jsonl", {"type": "session_meta", "payload": {"id": "s"}}, *rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = lines.read(spark, [str(tmp_path)], "*.jsonl")
        assert read.select("block").distinct().count() > 10 and read.rdd.getNumPartitions() > 10
        found = scan(spark, CONNECTORS["codex"], [str(tmp_path)])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    own = found.conversations.first()
    assert found.complete and [m.idx for m in own.messages] == list(range(3000)) and own.external_id == "s"
    assert all(m.content.startswith(f"line {k // 2 * 2} ") and m.model == ("m1" if k <= 1500 else "m2") for k, m in enumerate(own.messages))


def test_rollout_rules(spark, tmp_path):
    event = lambda kind, **x: {"type": "event_msg", "timestamp": "2024-01-01T00:00:00.500Z", "payload": {"type": kind} | x}
    last = {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 2}
    put(
        tmp_path / "rollout-a.jsonl", "", {"type": "session_meta", "payload": {"id": "own", "session_id": "root", "cwd": "/w", "originator": "Nightly Cron", "model_provider": "p1"}},
        event("user_message", message="<environment_context>x"), event("user_message", message="  do it\r\nnow "), event("user_message", message="  do it\r\nnow "), event("agent_reasoning", text="hm"),
        event("token_count", info={"last_token_usage": last}), event("token_count", info={"last_token_usage": last}), event("token_count", info=None),
        {"type": "response_item", "payload": {"type": "function_call", "content": "no message"}}, {"type": "response_item", "payload": {"role": "user", "content": "<user_shell_command>ls"}}, {"type": "response_item", "payload": "x"}, "5",
        {"type": "session_meta", "payload": {"id": "later", "cwd": "/v"}},
    )
    meta = {"type": "session_meta", "payload": {"id": "m", "source": {"subagent": {"thread_spawn": {"agent_role": "pi-x", "agent_path": "a/b/", "parent_thread_id": "up"}}}}}
    put(tmp_path / "rollout-b.jsonl", event("token_count", info={"last_token_usage": last}), meta, event("token_count", info={"last_token_usage": last}), event("agent_message", message="ok"))
    put(tmp_path / "rollout-c.json", {"session": {"cwd": "/z"}, "items": [{"role": "user", "content": ["q", {"text": "r"}], "timestamp": 1.5}, {"role": "alien", "content": "?"}, {"role": "assistant", "content": {"content": [{"content": [{"content": "deep"}]}]}}]})
    put(tmp_path / "rollout-d.json", "nope")
    put(tmp_path / "rollout-e.jsonl", {"type": "turn_context", "payload": {"model": "m"}})
    found = scan(spark, CONNECTORS["codex"], [str(tmp_path)])
    got = {r.source_path[-7:].split(".")[0][-1]: r for r in found.conversations.collect()}
    assert set(got) == {"a", "b", "c"} and [r.source_path.endswith("d.json") for r in found.errors.collect()] == [True]
    a, b, c = got["a"], got["b"], got["c"]
    assert [(m.role, m.content) for m in a.messages] == [("system", "<environment_context>x"), ("user", "  do it\r\nnow "), ("assistant", "hm"), ("tool", "<user_shell_command>ls")]
    assert (a.external_id, a.logical_session_id, a.workspace, a.title, a.record_kind, a.started_at) == ("own", "root", "/v", "do it", "automation", 1_704_067_200_500)
    assert [(u.input_tokens, u.total_tokens, u.provider, u.source_event_id) for u in a.usage] == [(6, 12, "p1", None)] * 2
    assert b.usage == [] and (b.title, b.record_kind, b.parent_external_id, b.logical_session_id) == ("Subagent: b", "child_agent", "up", "m")
    assert [(m.idx, m.content, m.timestamp) for m in c.messages] == [(0, "q\nr", 1500), (2, "deep", None)] and (c.workspace, c.title) == ("/z", "q")


def test_broken_lines_and_names(spark, tmp_path):
    """A broken line fails its file alone; names are no patterns."""
    answer = {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}], "usage": {"input_tokens": 18446744073709551615, "output_tokens": -3}}}
    for name in ("a [1] {x}*.jsonl", "b%20+ü.jsonl", "c\\d?.jsonl"):
        put(tmp_path / "sub [x]" / name, answer, "", "   ", {"type": "summary", "message": {"role": "user", "content": "no"}})
    put(tmp_path / "bad.jsonl", answer, '{"type": "user"')
    (tmp_path / "latin.jsonl").write_bytes(b'{"type": "user", "message": {"role": "user", "content": "\xff"}}')
    found = scan(spark, CONNECTORS["claude_code"], [str(tmp_path)])
    got = found.conversations.collect()
    assert {os.path.basename(r.source_path) for r in got} == {"a [1] {x}*.jsonl", "b%20+ü.jsonl", "c\\d?.jsonl"}
    assert {os.path.basename(r.source_path) for r in found.errors.collect()} == {"bad.jsonl", "latin.jsonl"}
    assert all([m.content for m in r.messages] == ["a\nb"] and [(u.input_tokens, u.output_tokens, u.total_tokens) for u in r.usage] == [((1 << 63) - 1, 0, (1 << 63) - 1)] for r in got)


def test_parents_by_headers(spark, tmp_path):
    """A parent is named by its file name, by a file of the scan, or by a file that this scan does not read."""
    at = tmp_path / "s"
    tree(at / "1_p.jsonl", "p-id", mtime=1000)
    tree(at / f"2_{UUID}.jsonl", "other", mtime=1000)
    put(at / "3_a.jsonl", {"type": "session", "id": "a", "parentSession": "1_p.jsonl"}, said())
    put(at / "4_b.jsonl", {"type": "session", "id": "b", "parentSession": str(at / f"2_{UUID}.jsonl")}, said())
    put(at / "5_c.jsonl", {"type": "session", "id": "c", "parentSession": "gone.jsonl"}, said())
    want = {"a": "p-id", "b": UUID, "c": None}
    for since in (None, 2_000_000):
        found = scan(spark, CONNECTORS["shuvlr"], [str(at)], since)
        got = {r.external_id: r.parent_external_id for r in found.conversations.collect()}
        assert {k: v for k, v in got.items() if k in want} == want and found.complete


# ---------------------------------------------------------------- ingestion
def test_copied_sessions_are_left_out(spark, tmp_path):
    """Sessions that stand among the originals, in files or in the store, are not indexed again."""
    std, omp = tmp_path / "std", tmp_path / "omp"
    tree(std / "1_a.jsonl", "one")
    put(std / "2_quiet.jsonl", {"type": "session", "id": "two"})  # no messages: in no row of the store
    for k, ident in enumerate(("one", "two", "own")):
        tree(omp / f"{k}_x.jsonl", ident)
    own = {a: CONNECTORS[a] for a in ("oh_my_pi", "pi_agent")}
    where = {"oh_my_pi": [str(omp)], "pi_agent": [str(std)]}
    store = Store(spark, str(tmp_path / "store"))
    assert index(store, own, where, dry_run=True)["insert"] == 2
    assert index(store, own, where, full=True, now_ms=4_000_000_000_000)["inserted"] == 2
    assert paths(store) == {str(std / "1_a.jsonl"), str(omp / "2_x.jsonl")}
    tree(std / "3_new.jsonl", "late")
    tree(omp / "4_x.jsonl", "late")
    tree(omp / "5_x.jsonl", "fresh")
    assert index(store, own, where, now_ms=4_000_000_000_001)["inserted"] == 2
    assert paths(store) == {str(std / "1_a.jsonl"), str(omp / "2_x.jsonl"), str(std / "3_new.jsonl"), str(omp / "5_x.jsonl")}
    assert index(Store(spark, str(tmp_path / "other")), own, {"oh_my_pi": [str(omp)]}, full=True)["inserted"] == 5  # without originals all count


def test_folder_that_cannot_be_listed(spark, tmp_path):
    """Its rows stay and the next scan has no time bound; a folder that is removed takes its rows along."""
    at = tmp_path / "logs"
    for f in ("a", "b", "c"):
        put(at / f / "x.jsonl", {"type": "user", "sessionId": f, "message": {"role": "user", "content": f}}, mtime=1000)
    own, where = {"claude_code": CONNECTORS["claude_code"]}, {"claude_code": [str(at)]}
    store = Store(spark, str(tmp_path / "store"))
    assert index(store, own, where, full=True, now_ms=5_000_000)["inserted"] == 3
    shutil.move(at / "b", tmp_path / "aside")
    os.symlink(at / "b", at / "b")  # a loop: whether anything is there cannot be told
    shutil.rmtree(at / "c")
    out = index(store, own, where, now_ms=6_000_000)
    assert not out["complete"] and out["deleted"] == 0 and len(paths(store)) == 3 and store.meta("last_scan_ts") == 5_000_000 and store.meta("plan:claude_code") == ingest.INCOMPLETE
    os.unlink(at / "b")
    shutil.move(tmp_path / "aside", at / "b")
    out = index(store, own, where, now_ms=7_000_000)
    assert out["complete"] and out["deleted"] == 1 and paths(store) == {str(at / "a" / "x.jsonl"), str(at / "b" / "x.jsonl")} and store.meta("last_scan_ts") == 7_000_000


def test_existence(spark, tmp_path):
    """A row whose file is there stays even if no root leads to it; what cannot be told is uncertain."""
    put(tmp_path / "in" / "x.jsonl", {"type": "user", "message": {"role": "user", "content": "x"}})
    put(tmp_path / "out" / "y.jsonl", {"type": "user", "message": {"role": "user", "content": "y"}})
    os.symlink(tmp_path / "loop", tmp_path / "loop")
    asked = [str(tmp_path / "in/x.jsonl"), str(tmp_path / "in/none"), str(tmp_path / "in/x.jsonl/z"), str(tmp_path / "loop/z"), "nosuchscheme://h/x"]
    assert [r.exists for r in existence(spark.createDataFrame([(p,) for p in asked], "source_path string").coalesce(1)).collect()] == [True, False, False, None, None]
    own, store = {"claude_code": CONNECTORS["claude_code"]}, Store(spark, str(tmp_path / "store"))
    assert index(store, own, {"claude_code": [str(tmp_path / "in"), str(tmp_path / "out")]}, full=True)["inserted"] == 2
    assert index(store, own, {"claude_code": [str(tmp_path / "in")]}, full=True)["deleted"] == 0
    found = scan(spark, own["claude_code"], [str(tmp_path / "in")])
    ghost = store.table("conversations").limit(1).withColumns({"id": F.lit(5).cast("long"), "source_path": F.lit(str(tmp_path / "loop/z"))})
    store.change({"conversations": ghost})
    assert {(r.source_path, r.state) for r in ingest.absent(store, "claude_code", found).collect()} == {(str(tmp_path / "loop/z"), "uncertain")}


def test_listing_over_many_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        put(tmp_path / f"d{k % 7}" / f"e{k % 5}" / f"{k}.jsonl", "{}")
    os.symlink(tmp_path, tmp_path / "d1" / "up")
    monkeypatch.setattr("logloom.sources.base.ENTRIES", 3)
    files, errors = walk(spark, [str(tmp_path), str(tmp_path / "d1"), str(tmp_path / "none")], ("*.jsonl",))
    assert files.count() == 40 and files.select("path").distinct().count() == 40 and errors.isEmpty()


def test_late_files_and_databases(spark, tmp_path):
    """What comes with an old time is found by the next incremental run, whichever source it is of."""
    every = connectors()
    own = {a: every[a] for a in ("claude_code", "hermes", "opencode")}
    where = {a: [str(tmp_path / a)] for a in own}
    home(tmp_path / "hermes" / "state.db", "h1")
    oc(tmp_path / "opencode" / "a.db", "o1")
    put(tmp_path / "claude_code" / "a.jsonl", {"type": "user", "message": {"role": "user", "content": "x"}})
    store = Store(spark, str(tmp_path / "store"))
    assert index(store, own, where, full=True, now_ms=4_000_000_000_000)["inserted"] == 3
    out = index(store, own, where, now_ms=4_000_000_000_001)
    assert (out["inserted"], out["updated"], out["deleted"]) == (0, 0, 0)
    home(tmp_path / "hermes" / "p" / "state.db", "h2")
    oc(tmp_path / "opencode" / "old.db", "o2", "o1")
    put(tmp_path / "claude_code" / "b.jsonl", {"type": "user", "message": {"role": "user", "content": "y"}})
    for p in (tmp_path / "hermes/p/state.db", tmp_path / "opencode/old.db", tmp_path / "claude_code/b.jsonl"):
        os.utime(p, (1000, 1000))
    out = index(store, own, where, now_ms=4_000_000_000_002)
    assert (out["inserted"], out["updated"], out["deleted"], out["complete"]) == (3, 0, 0, True)
    (tmp_path / "hermes/p/state.db").unlink()
    out = index(store, own, where, now_ms=4_000_000_000_003)
    assert (out["inserted"], out["deleted"]) == (0, 1) and len(paths(store)) == 5


# ---------------------------------------------------------------- databases
def home(path, *ids, wal_mode=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    if wal_mode:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("CREATE TABLE IF NOT EXISTS sessions (id TEXT, source TEXT, started_at REAL, parent_session_id TEXT, input_tokens INT, api_call_count INT, cwd TEXT)")
    db.execute("CREATE TABLE IF NOT EXISTS messages (id INT, session_id TEXT, role TEXT, content TEXT)")
    for k, i in enumerate(ids):
        db.execute("INSERT INTO sessions VALUES (?, 'cli', 1, ?, 5, 1, ?)", (i, ids[0] if k else None, None if k else f"/{path.parent.name}"))
        db.execute("INSERT INTO messages VALUES (?, ?, 'user', ?)", (k, i, f"{path.parent.name} {i}"))
    db.commit()
    return db


def oc(path, *ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE session (id TEXT, title TEXT, time_created INT)")
    db.execute("CREATE TABLE message (id TEXT, session_id TEXT, time_created INT, data TEXT)")
    db.execute("CREATE TABLE part (id TEXT, message_id TEXT, time_created INT, data TEXT)")
    for i in ids:
        db.execute("INSERT INTO session VALUES (?, ?, 1)", (i, i))
        db.execute("INSERT INTO message VALUES (?, ?, 1, ?)", ("m", i, json.dumps({"role": "user"}))) if i == ids[0] else None
    db.execute("INSERT INTO part VALUES ('p', 'm', 1, ?)", (json.dumps({"type": "text", "text": ids[0]}),))
    db.commit()
    db.close()


def test_many_databases_in_one_plan(spark, tmp_path):
    """Homes that share ids are told apart, and the number of jobs does not grow with them."""
    tracker = spark.sparkContext.statusTracker()

    def scanned(n):
        for k in range(n):
            home(tmp_path / str(n) / f"h{k}" / "state.db", "a", "b", f"own{k}").close()
        spark.sparkContext.setJobGroup(f"homes-{n}", "")
        found = hermes.scan(spark, [str(tmp_path / str(n))])
        rows = found.conversations.collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found.complete and len(rows) == 3 * n
        return rows, len(tracker.getJobIdsForGroup(f"homes-{n}"))

    (_, few), (rows, many) = scanned(2), scanned(50)
    assert many <= few + 2
    for r in rows:
        own = r.source_path.split("/.logloom")[0].rsplit("/", 1)[1]
        assert [m.content for m in r.messages] == [f"{own} {r.external_id}"] and r.logical_session_id == "a" and r.workspace == f"/{own}" and r.parent_external_id == (None if r.external_id == "a" else "a")
        assert [u.source_event_id for u in r.usage] == [f"hermes-session-aggregate:{r.external_id}"]


def test_databases_that_share_message_ids(spark, tmp_path):
    """Rows of two databases meet only where they are of one session."""
    oc(tmp_path / "a.db", "s1", "both")
    oc(tmp_path / "b.db", "s2", "both")
    got = {r.external_id: r for r in opencode.scan(spark, [str(tmp_path)]).conversations.collect()}
    assert {k: [m.content for m in r.messages] for k, r in got.items()} == {"s1": ["s1"], "s2": ["s2"]}


def test_log_beside_a_database(spark, tmp_path):
    """Committed rows of the log count, those of an open transaction and of a torn frame do not."""
    live = home(tmp_path / "live" / "state.db", "one", wal_mode=True)
    live.execute("INSERT INTO messages VALUES (9, 'one', 'user', 'committed')")
    live.commit()
    live.execute("PRAGMA cache_size=1")
    live.execute("INSERT INTO messages SELECT 10, 'one', 'user', hex(randomblob(3000)) FROM (SELECT 1 UNION SELECT 2 UNION SELECT 3 UNION SELECT 4)")
    live.execute("UPDATE messages SET content = content || 'open'")  # spilled to the log, not committed
    copies = {}
    for name in ("open", "torn", "salt", "none", "empty"):
        at = tmp_path / "copies" / name
        at.mkdir(parents=True)
        data, log = (tmp_path / "live/state.db").read_bytes(), (tmp_path / "live/state.db-wal").read_bytes()
        if name == "torn":
            log = log[:-100]
        if name == "salt":
            log = log[:16] + bytes(8) + log[24:]
        (at / "state.db").write_bytes(data)
        if name != "none":
            (at / "state.db-wal").write_bytes(b"" if name == "empty" else log)
        copies[name] = at
    found = hermes.scan(spark, [str(tmp_path / "copies")])
    got = {r.source_path.split("/.logloom")[0].rsplit("/", 1)[1]: sorted(m.content for m in r.messages) for r in found.conversations.collect()}
    assert got["open"] == got["torn"] == ["committed", "live one"]
    assert all("committed" not in got.get(n, []) for n in ("salt", "none", "empty"))
    live.rollback()
    live.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    live.execute("INSERT INTO messages VALUES (11, 'one', 'user', 'after')")
    live.commit()
    rows = hermes.scan(spark, [str(tmp_path / "live")]).conversations.collect()
    assert [m.content for m in rows[0].messages] == ["live one", "committed", "after"]
    live.close()


@pytest.mark.parametrize("size", [512, 4096])
def test_overlay_is_the_database(tmp_path, size):
    """Laying the log over the file gives what the library reads, after every commit."""
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute(f"PRAGMA page_size={size}")
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("PRAGMA wal_autocheckpoint=0")
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT)")
    rng = random.Random(size)
    for step in range(12):
        for _ in range(rng.randint(1, 30)):
            db.execute("INSERT INTO t (b) VALUES (?)", ("x" * rng.randint(1, 900),))
        db.execute("DELETE FROM t WHERE a % 5 = ?", (step % 5,))
        db.commit()
        if step == 6:
            db.execute("PRAGMA wal_checkpoint(RESTART)")
        own = wal.overlaid((tmp_path / "x.db").read_bytes(), (tmp_path / "x.db-wal").read_bytes())
        copy = sqlite3.connect(":memory:")
        copy.deserialize(own[:18] + b"\1\1" + own[20:])
        assert copy.execute("SELECT * FROM t").fetchall() == db.execute("SELECT * FROM t").fetchall()
        assert copy.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    db.close()


def test_unknown_enumerations_are_errors(spark, tmp_path):
    """A role or grain that the model lacks is no default."""
    put(tmp_path / "x.jsonl", {"type": "user", "message": {"role": "user", "content": "x"}})
    rows = scan(spark, CONNECTORS["claude_code"], [str(tmp_path)]).conversations
    for column, value in (("messages", F.transform("messages", lambda m: m.withField("role", F.lit("alien")))), ("agent", F.lit("nobody"))):
        with pytest.raises(Exception, match="unknown (role: alien|agent: nobody)"):
            Store(spark, str(tmp_path / f"store-{column}")).upsert(rows.withColumn(column, value), 1)


def test_sessions_are_recovered_on_request(spark, tmp_path):
    put(tmp_path / "message" / "lost" / "m.json", {"id": "m", "sessionID": "lost", "role": "user"})
    put(tmp_path / "part" / "m" / "p.json", {"messageID": "m", "type": "text", "text": "hi"})
    where = {"opencode": [str(tmp_path)]}
    for recover, n in ((False, 0), (True, 1)):
        own = {"opencode": connectors(recover)["opencode"]}
        store = Store(spark, str(tmp_path / f"store-{recover}"))
        assert index(store, own, where, full=True, now_ms=4_000_000_000_000)["inserted"] == n
        assert index(store, own, where, now_ms=4_000_000_000_001)["deleted"] == 0 and len(paths(store)) == n
