"""Passages are cut where a row lies: only their places go to the rows."""

from logloom.llm import suffix


def test_only_places_go_to_the_rows(spark):
    words = [f"é{k}w" for k in range(300)]
    same = " ".join(words[:60])
    rows = [(k, f"{' '.join(words[100 + 9 * k : 105 + 9 * k])} {same} end{k}", k) for k in range(5)]
    rows += [(7, "short", 7), (None, None, 8), (9, same, 9), (9, same, 10), (11, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    out = suffix.dedup_passages(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "MapInArrow" not in plan and "ArrowEvalPython" in plan
    got = sorted(((r.doc_id, r.text and r.text.split(), r.spans) for r in out.collect()), key=repr)
    want = [(k, words[100 + 9 * k : 105 + 9 * k] + [f"end{k}"], k) for k in range(5)] + [(7, ["short"], 7), (None, None, 8), (11, "", 11)]
    assert got == sorted(want, key=repr)
