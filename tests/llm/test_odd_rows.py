"""Rows that once were lost, overwritten or crashed a job."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.llm import chat, exact, minhash

T = " ".join(f"w{i}" for i in range(60))
NEAR = T + " more"


def test_near_dedup_by_text(spark):
    rows = [(3, T, 0), (5, "unique text of its own kind that nobody else has", 1), (5, NEAR, 2), (7, T, 3), (7, NEAR, 4), (None, T, 5), (8, None, 6), (8, "", 7)]
    docs = spark.createDataFrame([(i, t, n, "id", "mark", "node", "comp") for i, t, n in rows], "doc_id long, text string, n int, __id string, mark string, node string, comp string")
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.n for r in kept.collect()) == [0, 1, 5, 6, 7]
    pair = spark.createDataFrame([(3, T, 0), (3, NEAR, 1)], "doc_id long, text string, n int")
    assert minhash.dedup(pair).count() == 1


def test_exact_dedup_keeps_columns(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (4, None), (5, "")]
    names = ["__n", "__keep", "__sha", "__salt", "__at", "__text", "__fp", "row", "a.b"]
    docs = spark.createDataFrame([(i, t, *(f"{c}{k}" for c in names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = exact.dedup(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(2, "a"), (2, "b"), (None, "c"), (5, "")])
    assert all(len({r[c].removeprefix(c) for c in names}) == 1 for r in got)


def test_exact_dedup_of_a_hot_text(spark):
    """Half of all rows hold one text; each task sends at most one row of it on."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.groups(docs).groupBy("kept").agg(F.count("*"), F.max("group_size")).collect()
    assert {tuple(r) for r in got} == {(True, 2001, 2000), (False, 1999, 2000)}


@pytest.mark.parametrize("record", [{"messages": [{"role": "user"}]}, {"messages": [None]}, {"messages": ["x"]}, [], [1], 5, "x", None, {"foo": 1}, {}, {"prompt": 1, "response": "r"}, {"messages": {"role": "user", "content": "x"}}])
def test_odd_records_have_an_error(spark, record):
    rows = spark.createDataFrame([("a", json.dumps(record)), ("b", '{"prompt": "p", "response": "r"}')], "id string, record string")
    got = {r.id: r for r in chat.format_records(rows).collect()}
    assert got["a"].layout is None and got["a"].formatted == "" and got["a"].error
    assert chat.read_chat(got["b"].formatted) == [("user", "p"), ("assistant", "r")] and got["b"].error is None


def test_records_beside_their_layout(spark):
    records = [
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "image"}, "q"]}, {"role": "assistant", "content": None}], "system": "s"}, [("system", "s"), ("user", "p\nq"), ("assistant", "")]),
        ({"prompt": "p", "response": "r", "input": "i"}, [("user", "p"), ("assistant", "r")]),
        ({"messages": []}, []),
        ({"conversations": [{"from": "human", "value": "p"}], "system": ""}, [("user", "p")]),
    ]
    rows = spark.createDataFrame([(str(k), json.dumps(r)) for k, (r, _) in enumerate(records)] + [("x", "{no json"), ("y", None), ("z", "")], "id string, record string")
    got = {r.id: r for r in chat.format_records(rows).collect()}
    for k, (_, turns) in enumerate(records):
        assert chat.read_chat(got[str(k)].formatted) == turns and got[str(k)].error is None
    assert got["x"].error and got["y"].error is None and got["z"].error is None


def test_tables_with_more_columns(spark):
    flat = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    want = chat.read_back(chat.format_turns(flat)).collect()
    more = flat.withColumns({c: F.lit("clash") for c in ("system", "input", "part", "formatted", "prompt", "__t")})
    assert chat.read_back(chat.format_turns(more)).collect() == want
    nested = spark.createDataFrame([(1, "be brief", [("human", "q"), ("gpt", "a")])], "conv_id long, system string, conversations array<struct<from:string,value:string>>")
    assert "".join(r.formatted for r in chat.format_turns(nested).orderBy("part").collect()) == chat.format_chat([("system", "be brief"), ("user", "q"), ("assistant", "a")])[0]
