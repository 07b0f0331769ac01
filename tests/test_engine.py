"""The reference engine: every query that has SQL against DuckDB on the smallest tables, and the store."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom import queries, source_queries
from logloom.functions import canon, cost, text
from logloom.operators import search, usage
from logloom.operators.store import Store, roots
from logloom.sources.base import scan
from logloom.sources.formats import CONNECTORS
from logloom.streaming.ingest import index

SF = "/root/testdata/sf0.001"
SOURCES = [n for n, f in queries.QUERIES.items() if f.__module__ == source_queries.__name__]


def canonical(rows):
    plain = lambda x: None if x is None or x != x else round(float(x), 4) if isinstance(x, (int, float)) or hasattr(x, "as_tuple") else str(x)
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["usage_totals", "usage_dedup", "usage_by_provider", "usage_coverage", "usage_trend_week", "usage_trend_sparse", "usage_list_price", "search_recent", "search_phrase", "hybrid_rrf", "logical_root", "usage_all_breakdowns", "usage_top_models", "hybrid_scoped", "dry_run_classes", "source_coverage", "message_dedup", *SOURCES])
def test_query_is_sql(spark, name):
    con = duckdb.connect()
    for t in "events documents embeddings pages conversations customer orders lineitem nation".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert canonical(tuple(r[c] for c in cols) for r in got.collect()) == canonical(tuple(r[i] for i in order) for r in want.fetchall())


def test_golden_price(spark):
    row = {"input_tokens": 1_000_000, "output_tokens": 1_000_000, "cache_read_tokens": 1_000_000, "cache_write_tokens": 0, "total_tokens": 3_000_000, "component_total_tokens": 3_000_000, "usage_grain": "event", "api_calls": 1, "provider": "openai", "provider_family": "openai", "model": "gpt-5.6", "billing_mode": None, "billing_base_url": None}
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    assert cost.with_list_cost(spark.createDataFrame([tuple(row.values())], schema)).first()["list_usd"] == 56.0


def test_text_rules(spark):
    rows = spark.createDataFrame([("é" * 60,), ("short",), (None,)], "t string").select(text.truncated("t", 100).alias("a"), text.preview("t", 7).alias("b")).collect()
    assert rows[0].a == "é" * 48 + "..." and rows[0].b == "ééé..." and rows[1].a == "short" and rows[2].a is None
    hosts = spark.createDataFrame([("https://u@[::1]:8/x",), ("API.x.ai./v1",), ("",)], "u string").select(canon.route_host("u").alias("h"))
    assert [r.h for r in hosts.collect()] == ["::1", "API.x.ai", None]


def test_saturation(spark):
    big = spark.createDataFrame([((1 << 63) - 1,), (5,)], "x long")
    assert big.agg(usage.saturating_sum("x")).first()[0] == (1 << 63) - 1


def test_roots_with_cycle(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 6), (6, 5), (7, 6), (8, 99)], "id long, parent long")
    assert {r.id: r.root for r in roots(rows).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 8}


def test_query_parsing():
    assert search.parse_query("Auth t_foo1") == [["Auth"], ["t_foo1"], ["t", "foo1"]]
    with pytest.raises(ValueError):
        usage.UsageFilters(since=2, until=1)


def test_index_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    use = {"input_tokens": 21, "output_tokens": 34, "cache_read_input_tokens": 55, "cache_creation_input_tokens": 8}
    line = lambda **x: json.dumps(x) + "\n"
    answer = line(type="assistant", timestamp="2024-01-01T00:00:01Z", message={"role": "assistant", "id": "answer-3", "model": "claude-x", "content": [{"type": "text", "text": "parser done"}], "usage": use})
    (logs / "a.jsonl").write_text(line(type="file-history-snapshot") + line(type="user", sessionId="s1", cwd="/repo", timestamp="2024-01-01T00:00:00Z", message={"role": "user", "content": "fix the parser\nplease"}) + answer + answer)
    (logs / "empty.jsonl").write_text("")
    store, connectors = Store(spark, str(tmp_path / "store")), {"claude_code": CONNECTORS["claude_code"]}
    assert index(store, connectors, {"claude_code": [str(logs)]}, dry_run=True)["insert"] == 1
    assert index(store, connectors, {"claude_code": [str(logs)]})["inserted"] == 1
    assert index(store, connectors, {"claude_code": [str(logs)]}, full=True)["inserted"] == 0
    row = store.table("usage_events").collect()
    assert len(row) == 1 and row[0].total_tokens == 118 and row[0].source_event_id == "message:answer-3"
    found = store.search(search.SearchQuery("parser"), 1_704_067_200_000).collect()
    assert len(found) == 1 and found[0].title == "fix the parser" and "<mark>parser</mark>" in found[0].snippet
    assert store.conversation(found[0].source_path)["messages"][0]["role"] == "user"
    (logs / "b.jsonl").write_text("not json")
    assert not scan(spark, CONNECTORS["claude_code"], [str(logs)]).complete
    (logs / "b.jsonl").unlink()
    (logs / "a.jsonl").unlink()
    assert index(store, connectors, {"claude_code": [str(logs)]}, full=True)["deleted"] == 1


def folded(spark, connector, path, lines):
    """Usage rows of one file's lines."""
    rows = spark.createDataFrame([(path, k // 2, k, json.dumps(x)) for k, x in enumerate(lines)], "path string, block long, row long, line string")
    return connector.fold(rows).usage.orderBy("order").collect()


def test_rollout_counters(spark):
    """A counter that is repeated counts once; input is what was not read from the cache."""
    last = {"input_tokens": 91, "cached_input_tokens": 17, "output_tokens": 23, "reasoning_output_tokens": 6, "total_tokens": 114}
    count = {"type": "event_msg", "timestamp": "2023-06-07T08:09:10Z", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 91, "output_tokens": 23}, "last_token_usage": last}}}
    meta = {"type": "session_meta", "payload": {"id": "roll-7", "model_provider": "openai"}}
    got = folded(spark, CONNECTORS["codex"], "/rollout-1.jsonl", [meta, count, count])
    assert [(u["input_tokens"], u["cache_read_tokens"], u["total_tokens"]) for u in got] == [(74, 17, 114)]
    assert got[0]["source_event_id"] == "codex-cumulative-v2:roll-7:91:0:23:0:91:17:23:6:114"


def test_tree_counters(spark):
    """One provider counts what it read from the cache within its input."""
    line = {"type": "message", "id": "e5", "timestamp": 1690000000123, "message": {"role": "assistant", "provider": "google", "content": [{"type": "text", "text": "y"}], "usage": {"input": 800, "output": 90, "cacheRead": 350, "totalTokens": 890}}}
    row = folded(spark, CONNECTORS["pi_agent"], "/x.jsonl", [line])[0]
    assert (row["input_tokens"], row["cache_read_tokens"], row["total_tokens"], row["source_event_id"]) == (450, 350, 890, "pi-message:e5:1690000000123")


def test_crash_between_steps(spark, tmp_path, monkeypatch):
    """A writer that dies before its state is there leaves the one before; two writers of one state cannot both win."""
    store = Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, [0.5])], "conversation_id long, embedding array<float>")
    store.change({"embeddings": one})
    with monkeypatch.context() as m:
        m.setattr(store, "_point", lambda state: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            store.change({"embeddings": one}, spark.createDataFrame([(1,)], "id long"))
    assert Store(spark, str(tmp_path / "store")).table("embeddings").count() == 1
    stale = store._state()
    store.set_meta(a=1)
    with pytest.raises(RuntimeError):
        store._point(stale)
    assert store.meta("a") == 1
    store.change({"embeddings": one}, spark.createDataFrame([(1,)], "id long"))
    assert store.table("embeddings").count() == 1
    reader = store.table("embeddings")
    store.set_meta(b=2)
    assert reader.count() == 1  # folders of the state before stay
    for k in range(2, 40):
        store.change({"embeddings": spark.createDataFrame([(k, [0.5])], "conversation_id long, embedding array<float>")})
    state = store._state()
    assert store.table("embeddings").count() == 39 and len(state["tables"]["embeddings"]) < 32
    with pytest.raises(RuntimeError):
        Store(spark, str(tmp_path / "store"), read_only=True).set_meta(c=3)


def test_incremental_scan_reads_changed_files(spark, tmp_path):
    """Files that are older than the cursor, or whose path is known, are listed and not read."""
    import os

    logs = tmp_path / "logs"
    logs.mkdir()
    for k in range(4):
        (logs / f"{k}.jsonl").write_text(json.dumps({"type": "user", "sessionId": f"s{k}", "message": {"role": "user", "content": "x" * 1000}}))
        os.utime(logs / f"{k}.jsonl", (1000 + k, 1000 + k))
    own = CONNECTORS["claude_code"]
    assert {r.external_id for r in scan(spark, own, [str(logs)], 1_002_000).conversations.collect()} == {"s2", "s3"}
    known = spark.createDataFrame([(str(logs / f"{k}.jsonl"),) for k in range(3)], "source_path string")
    assert [r.external_id for r in scan(spark, own, [str(logs), str(logs)], None, known).conversations.collect()] == ["s3"]
    both = scan(spark, own, [str(logs)], 1_003_000, known.where("source_path not like '%0.jsonl'"))
    assert {r.external_id for r in both.conversations.collect()} == {"s0", "s3"} and both.present.count() == 4
    every = spark.createDataFrame([(str(logs / f"{k}.jsonl"),) for k in range(4)], "source_path string")
    assert scan(spark, own, [str(logs)], None, every).conversations.count() == 0


def test_stream_retries_failed_files(spark, tmp_path):
    from logloom.streaming.ingest import stream

    logs = tmp_path / "logs"
    logs.mkdir()
    good = json.dumps({"type": "user", "sessionId": "a", "message": {"role": "user", "content": "hi"}})
    (logs / "a.jsonl").write_text(good)
    (logs / "b.jsonl").write_text(good[:-5])
    store = Store(spark, str(tmp_path / "store"))
    assert stream(store, CONNECTORS["claude_code"], [str(logs)], str(tmp_path / "cp")) == 1
    assert store.table("conversations").count() == 1 and store.table("failed").count() == 1
    (logs / "b.jsonl").write_text(good)
    stream(store, CONNECTORS["claude_code"], [str(logs)], str(tmp_path / "cp"))
    assert store.table("conversations").count() == 2 and store.table("failed").count() == 0


def rows_and_sql(spark, name, sf, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet{'/*.parquet' if sf != SF else ''}')")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.SQL[name]}) q")
    return canonical(map(tuple, got.collect())), canonical(want.fetchall())


def test_snippet_of_every_document(spark, tmp_path):
    texts = [None, "", "x" * 300, "x" * 301, "é" * 200, "a" + "é" * 200, "語" * 99 + "the end", "語" * 120, "y" * 200 + " the " + "z" * 300, "w" * 299 + "😀", "w" * 296 + "the😀"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (SF, str(tmp_path)):
        got, want = rows_and_sql(spark, "search_snippet", sf, "documents")
        assert got == want
    assert len(got) == len(texts)
    assert len(rows_and_sql(spark, "search_snippet", SF, "documents")[0]) == spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null").count()


def test_whole_messages(spark, tmp_path):
    rows = [(1, 0, "user", "same first words, one"), (1, 1, "user", "same first words, two"), (1, 2, "user", "same first words, one"), (21, 0, "user", "same first words, one"), (21, 1, "assistant", "same first words, one"), (21, 2, "assistant", None), (21, 3, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["message_dedup"](spark, str(tmp_path)).collect()
    assert sorted((r.conversation_id, r.role, r.content or "") for r in got) == sorted({(c, r, t or "") for c, _, r, t in rows})
    assert len(got) == 5
    got, want = rows_and_sql(spark, "message_dedup", SF, "conversations")
    assert got == want


def test_dry_run_of_whole_table(spark):
    got, want = rows_and_sql(spark, "dry_run_classes", SF, "documents")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got == want
    count = {r["class"]: r.n for r in queries.QUERIES["dry_run_classes"](spark, SF).collect()}
    assert set(count) == {"insert", "delete", "update", "unchanged"} and count["delete"] + count["update"] + count["unchanged"] == n == count["insert"] + count["update"] + count["unchanged"]


def test_migration_and_scope_case(spark, tmp_path):
    """An older store gets the columns that it lacks, once; what is below a root may differ in case."""
    import json as j

    at = tmp_path / "old"
    spark.createDataFrame([(1, "codex", "", "/Repo/X", "p")], "id long, agent string, external_id string, workspace string, source_path string").write.parquet(f"{at}/segment-000000000001-conversations-a")
    spark.createDataFrame([(1, 0, "", 5, 3, 0.5)], "conversation_id long, idx int, provider string, input_tokens long, output_tokens long, estimated_cost_usd double").write.parquet(f"{at}/segment-000000000001-usage_events-a")
    (at / "STATE-000000000001.json").write_text(j.dumps({"number": 1, "tables": {"conversations": [[1, "segment-000000000001-conversations-a"]], "usage_events": [[1, "segment-000000000001-usage_events-a"]]}, "gone": [], "meta": {"schema_version": 1}}))
    store = Store(spark, str(at))
    row, own = store.table("usage_events").first(), store.table("conversations").first()
    assert (row.provider, row.usage_grain, row.cost_status, own.record_kind, own.is_synthetic, own.logical_session_id) == (None, "event", "source_estimated", "top_level", False, None)
    n = store._state()["number"]
    assert Store(spark, str(at))._state()["number"] == n and store.meta("schema_version") == 4
    store.set_meta(schema_version=99)
    with pytest.raises(ValueError):
        Store(spark, str(at))
    rows = spark.createDataFrame([("/repo/x",), ("/REPO/x",), ("/REPO",), (None,)], "workspace string")
    assert rows.where(canon.in_scope("workspace", ["/repo"], True)).count() == 3 and rows.where(canon.in_scope("workspace", ["/repo"])).count() == 2
