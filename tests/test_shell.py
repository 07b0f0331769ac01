"""Scopes, roots, the family of session trees, the report and the command line."""

import base64
import io
import json
import os
import re
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom import browse, cli, report, scope
from logloom.operators import usage as U
from logloom.sources import lines, roots
from logloom.streaming.refresh import Refresher, tried


def test_scope(tmp_path):
    main, linked = tmp_path / "main", tmp_path / "linked"
    (main / ".git" / "worktrees" / "w").mkdir(parents=True)
    (main / "src" / "deep").mkdir(parents=True)
    linked.mkdir()
    (linked / ".git").write_text(f"gitdir: {main}/.git/worktrees/w\n")
    (main / ".git" / "worktrees" / "w" / "gitdir").write_text(f"{linked}/.git\n")
    (main / ".git" / "worktrees" / "w" / "commondir").write_text("../..\n")
    for at in (main / "src" / "deep", linked):
        assert set(scope.resolve(at).roots) == {str(main), str(linked)}
    own = scope.resolve(main)
    assert own.primary == str(main) and own.short_label() == "main" and own.describe().endswith("(+1 linked root)")
    assert own.matches(None) and own.matches("") and own.matches(f"{linked}/x/") and not own.matches(f"{main}-other")
    second = tmp_path / "second"
    (second / ".jj").mkdir(parents=True)
    (tmp_path / "first" / ".jj" / "repo").mkdir(parents=True)
    (second / ".jj" / "repo").write_text(str(tmp_path / "first" / ".jj" / "repo"))
    assert set(scope.resolve(second).roots) == {str(second), str(tmp_path / "first")}
    os.symlink(main, tmp_path / "alias")
    assert scope.resolve(tmp_path / "alias").roots[:2] == (str(tmp_path / "alias"), str(main))
    assert scope.resolve("/") is None and scope.current(True) is None and scope.within("/a/b", "/a/") and not scope.within("/ab", "/a") and not scope.within("/a", "/")


def test_roots(tmp_path):
    env = {"CODEX_HOME": "/c", "PI_CODING_AGENT_DIR": str(tmp_path / "own"), "LOGLOOM_TREE_DIRS": f"{tmp_path}/more{os.pathsep}{tmp_path}/own", "HERMES_HOME": str(tmp_path / "h")}
    assert roots.default_roots("codex", tmp_path, env) == ["/c/sessions", "/c/archived_sessions"]
    trees = roots.default_roots("pi_agent", tmp_path, env)
    assert trees[:3] == [str(tmp_path / "own"), str(tmp_path / "more"), str(tmp_path / ".pi/agent")] and len(trees) == 8
    (tmp_path / "h" / "profiles" / "p").mkdir(parents=True)
    (tmp_path / "h" / "profiles" / "p" / "state.db").touch()
    assert roots.default_roots("hermes", tmp_path, env) == [str(tmp_path / "h"), str(tmp_path / "h/profiles/p")] and roots.detected("hermes", roots.default_roots("hermes", tmp_path, env))
    own = tmp_path / ".omp" / "agent"
    assert not roots.detected("oh_my_pi", [str(own)])
    (own / "agents" / "a" / "sessions").mkdir(parents=True)
    assert roots.session_folders(str(own)) == ([str(own / "agents/a/sessions")], True) and roots.detected("oh_my_pi", [str(own)])
    (own / "sessions").write_text("no folder")
    assert roots.session_folders(str(own)) == ([str(own / "agents/a/sessions")], False)
    assert roots.session_folders(str(tmp_path / "none")) == ([], True)


UUID = "123e4567-e89b-12d3-a456-426614174000"


def test_session_trees(spark, tmp_path):
    names = {"1_x.jsonl": True, "session-9.jsonl": True, f"{UUID}.jsonl": True, "notes.jsonl": False}
    assert all(roots.session_name(n) is want and bool(re.search(roots.SESSION_PATH, f"/r/{n}")) is want for n, want in names.items())
    folder = base64.urlsafe_b64encode(b"/my/work place").decode().rstrip("=")
    paths = spark.createDataFrame([(f"/a/2024_{UUID}.jsonl", f"/s/{folder}/a.jsonl"), (f"/x/{UUID}", "/s/--x--/a.jsonl"), ("/a/2024_x.jsonl", "/s/a b/x")], "a string, b string")
    assert [tuple(r) for r in paths.select(lines.id_of_name(F.col("a")), lines.workspace_of_folder(F.col("b"))).collect()] == [(UUID, "/my/work place"), (UUID, None), (None, None)]
    at = tmp_path / "std" / "sessions" / "w"
    at.mkdir(parents=True)
    (at / "1_a.jsonl").write_text(json.dumps({"type": "session", "id": "one"}))
    (at / "2_b.jsonl").write_text("x\n" * 5 + json.dumps({"type": "session", "id": "too late"}))
    known = roots.session_ids(spark, [str(tmp_path / "std"), str(tmp_path / "missing")])
    assert [r[0] for r in known.collect()] == ["one"]
    rows = spark.createDataFrame([("one", 1), ("two", 2), (None, 3)], "external_id string, n int")
    assert sorted(r.n for r in roots.without_copies(rows, known).collect()) == [2, 3]


def test_dates():
    day = cli.parse_date("2024-03-05")
    assert day == int(datetime(2024, 3, 5).astimezone().timestamp() * 1000) and cli.parse_until("2024-03-05") == day + 86_400_000 - 1
    assert cli.parse_date("2024-03-05T01:00:00+01:00") == 1_709_596_800_000 == cli.parse_until("2024-03-05T00:00:00Z")
    assert abs(cli.parse_date("today") - cli.parse_date("2d")) < 3 * 86_400_000
    for bad in ("-1d", "2024-02-30", "2024-03-05T01:00:00", "soon", "99999999999d"):
        with pytest.raises(ValueError):
            cli.parse_date(bad)
    assert cli.parse_duration("2h30m") == 9_000_000 and cli.parse_duration("15m") == 900_000
    with pytest.raises(ValueError):
        cli.parse_duration("soon")


def test_numbers():
    assert [report.compact(x) for x in (7, 1234, 12_345, 123_456, 9_990_000, 5 * 10**12)] == ["7", "1.23K", "12.3K", "123K", "9.99M", "5.00T"]
    assert [report.usd(x) for x in (None, float("nan"), 1234.567, -3)] == ["—", "—", "$1,234.57", "$0.00"]
    assert report.cut("abcdef", 4) == "abc…" and report.safe("a\x1b[1m‮b\n") == "a�[1m�b�" and report.escaped("<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;" and report.title_case("ab") == "Ab"
    rows = [{"key": k} for k in ("a", "b", U.UNKNOWN)]
    assert report.leading(rows, 1) == [rows[0], rows[2]] and report.leading(rows, 3) == rows


def test_command_line(spark, tmp_path, monkeypatch):
    """From files below a home to hits, statistics, a report as JSON, text and HTML, and a conversation."""
    monkeypatch.chdir(tmp_path)
    at = tmp_path / "home" / ".claude" / "projects" / "p"
    at.mkdir(parents=True)
    line = lambda **x: json.dumps(x) + "\n"
    use = {"input_tokens": 3, "output_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 0}
    (at / "a.jsonl").write_text(line(type="user", sessionId="s", cwd="/w", timestamp="2024-05-01T00:00:00Z", message={"role": "user", "content": "mend the <gasket>"}) + line(type="assistant", timestamp="2024-05-01T00:00:01Z", message={"role": "assistant", "id": "m1", "model": "<script>m", "provider": "anthropic", "content": "the gasket is mended", "usage": use}))
    data, home = str(tmp_path / "store"), str(tmp_path / "home")

    def call(*argv):
        out = io.StringIO()
        code = cli.run(["-g", "--data-dir", data, *argv], spark, out, home)
        return code, out.getvalue()

    assert call("index", "--dry-run")[1].startswith("insert 1") and "inserted 1" in call("index")[1]
    found = json.loads(call("--no-refresh", "search", "gasket", "--json", "--agent", "no such", "--since", "whenever")[1])
    assert found["total_hits"] == 1 and found["hits"][0]["title"] == "mend the <gasket>" and found["hits"][0]["created_at"].startswith("2024-05-01T00:00:00")
    assert "1. [claude_code] mend the <gasket> - 2024-05-01" in call("--no-refresh", "search", "gasket")[1]
    stats = json.loads(call("stats", "--json")[1])
    assert stats["agents"] == {"claude_code": {"conversations": 1, "messages": 2}} and stats["index_size_bytes"] > 0 and "scope" not in stats
    got = json.loads(call("--no-refresh", "usage", "--json", "--estimate-list-costs", "--since", "2024-04-01", "--until", "2024-06-01")[1])
    assert got["totals"]["total_tokens"] == 15 and got["by_model"][0]["label"] == "<script>m" and got["range"]["bucket"] == "week" and sum(p["total_tokens"] for p in got["trend"]) == 15 and len(got["trend"]) >= 9
    assert got["list_price_catalog_version"] and len([k for k in got if k.startswith("by_")]) == 17
    assert "15 tokens in 1 calls" in call("--no-refresh", "usage")[1] and "No usage matches." in call("--no-refresh", "usage", "--model", "other")[1]
    page = tmp_path / "out" / "deep" / "u.html"
    assert "Wrote usage report" in call("--no-refresh", "usage", "--html", str(page))[1]
    text = page.read_text()
    assert "<script" not in text and "&lt;script&gt;m" in text and "<svg viewBox" in text and "http" not in text and os.listdir(page.parent) == ["u.html"]
    code, shown = call("view", str(at / "a.jsonl"))
    assert code == 0 and "the gasket is mended" in shown and call("view", "/none")[0] == 1
    assert {r["slug"]: r["detected"] for r in json.loads(call("agents", "--json")[1])}["claude_code"] is True
    out = io.StringIO()
    assert cli.run(["-g", "--data-dir", data, "--no-refresh"], spark, out, home, keys=iter(["/gasket\n", "o\n", "b\n", "q\n"])) == 0
    assert "mend the <gasket>" in out.getvalue() and "the gasket is mended" in out.getvalue()
    for bad in (("usage", "--since", "soon"), ("usage", "--agent", "nobody"), ("usage", "--since", "2024-02-02", "--until", "2024-01-01")):
        with pytest.raises(ValueError):
            call("--no-refresh", *bad)
    with pytest.raises(SystemExit):
        call("index", "--full", "--rebuild")


def test_refresh_beside():
    tries = []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("another writer made state 4")
        return {"inserted": 1}

    waits = []
    assert tried(work, sleep=waits.append) == {"inserted": 1} and waits == [0.2, 0.4]
    with pytest.raises(RuntimeError):
        tried(lambda: (_ for _ in ()).throw(RuntimeError("disk full")), sleep=waits.append)
    assert len(waits) == 2
    gate = threading.Event()
    with Refresher(lambda: {"ok": gate.wait(10)}, every=60) as own:
        assert own.poll() is None and own.ask()
        while not own.busy:
            time.sleep(0.01)
        assert not own.ask()
        gate.set()
        while (found := own.poll()) is None:
            time.sleep(0.01)
        assert found == ("done", {"ok": True}) and not own.busy
    assert not own._thread.is_alive()
    with Refresher(lambda: 1 // 0, every=0.01) as own:
        while (found := own.poll()) is None:
            time.sleep(0.01)
    assert found[0] == "failed" and "ZeroDivisionError" in found[1]


def test_browsing():
    asked = []

    def find(q):
        asked.append(q)
        return {"total_hits": 2, "hits": [{"id": i, "agent": "codex", "title": f"title {i}\x1b", "created_at": "2024-01-02T", "snippet": "snip", "preview": ""} for i in (7, 8)]}

    own = browse.Browser(find, lambda i: {"agent": "codex", "source_path": "/p", "title": None, "messages": [{"role": "user", "content": f"say {i}"}]} if i == 8 else None, lambda: 1_700_000_000_000, ("/repo",))
    out = io.StringIO()
    browse.loop(own, ["/ words ", "t", "t", "r", "a", "g", "j", "j", "o", "j", "b", "k", "o", "?"], out)
    assert asked[0].text == "" and asked[1].text == "words" and asked[0].scope == ("/repo",) and asked[-1].scope is None
    assert asked[2].since == 1_699_920_000_000 or asked[2].since is not None
    assert asked[3].since == 1_700_000_000_000 - 7 * 86_400_000 and asked[4].ranking == "balanced" and asked[5].agent == "claude_code" and asked[5].limit == 50
    assert "say 8" in out.getvalue() and "\x1b" not in out.getvalue() and own.status == "The conversation is gone" and "q quit" in out.getvalue()
    assert all(len(line) <= 20 for line in own.lines(20, 6)) and len(own.lines(20, 6)) <= 6
    old = own.latest.ask()
    own.latest.ask()
    own.answer(old, {"total_hits": 99, "hits": []})
    assert own.total == 2
    own.refreshed(("failed", "x"))
    assert own.status == "Refresh failed: x"
    own.key("q")
    assert own.done
