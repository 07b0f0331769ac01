"""A stage of the pipeline runs one Python function at a time, so that an executor holds one worker a core."""

import re

import corpus_pipeline
from logloom.llm import common, exact, langid, linking, minhash, packing, suffix

SF = "/root/testdata/sf0.001"
_PYTHON, _MOVES = re.compile(r"MapInArrow|ArrowEvalPython|PythonMapInArrow"), re.compile(r"Exchange|InMemoryTableScan")


def most_in_a_stage(plan):
    """The most Python functions in one stage of a physical plan, as its tree is printed."""
    path, most = [], 0  # from the root: (depth, functions of the stage so far)
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        while path and path[-1][0] >= depth:
            path.pop()
        held = 0 if _MOVES.search(line) else (path[-1][1] if path else 0) + bool(_PYTHON.search(line))
        path.append((depth, held))
        most = max(most, held)
    return most


def test_one_python_function_in_a_stage(spark, monkeypatch):
    seen = {}

    def cut(df, name="t"):
        seen[name] = max(seen.get(name, 0), most_in_a_stage(df._jdf.queryExecution().executedPlan().toString()))
        return common.cut(df, name)

    for module in (corpus_pipeline, langid, exact, minhash, linking, suffix, packing):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", cut)
    last = corpus_pipeline.query(spark, SF)
    seen["packing"] = most_in_a_stage(last._jdf.queryExecution().executedPlan().toString())
    assert seen["anchors"] == seen["language_id"] == seen["suffix_array_dedup"] == 1
    assert {k: n for k, n in seen.items() if n > 1} == {}
