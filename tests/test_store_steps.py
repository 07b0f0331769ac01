"""The steps that the store's queries share: postings without a shuffle of their own, a scan that is parsed once."""

import logloom.source_queries as Q
from logloom.operators import search
from logloom.operators.store import Store

SF = "/root/testdata/sf0.001"
ROWS = [(1, "A title", "one Two two ONE. one"), (2, None, None), (3, "", "..."), (4, "x" * 50, "é É été 123 " + "w " * 700), (5, "b a b", "one " * 3)]


def _docs(spark):
    return spark.createDataFrame(ROWS, "id long, title string, content string")


def test_all_postings_are_the_postings(spark, monkeypatch):
    docs = _docs(spark)
    want = search.postings(docs).select("field", "term", "id", "length", "tf", "positions")
    for limit in (1, 4, 1 << 19):  # documents alone, some together, all together
        monkeypatch.setattr(search, "TERMS", limit)
        got = search.all_postings(docs)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert search.all_postings(docs.limit(0)).collect() == []


def test_stored_postings_move_once(spark):
    plan = Store._postings(_docs(spark).repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 2  # the one here and the store's own


def test_store_parses_its_lines_once(spark, monkeypatch):
    calls, own = [], Q.L.message_lines
    monkeypatch.setattr(Q.L, "message_lines", lambda lines: calls.append(1) or own(lines))
    Q._store(spark, SF)
    assert len(calls) == 1
