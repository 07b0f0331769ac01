"""The rest of sessions: tasks of a bounded number of sessions, whatever the tables hold."""

from pyspark.sql import functions as F

from logloom.sources import database, hermes


def test_sessions_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(hermes, "SESSIONS_A_TASK", 20, raising=False)
    sessions = spark.range(400).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("m").alias("model"), (F.col("id") % 7 + 3).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(1.0).alias("started_at"))
    models = spark.range(800).select(F.concat(F.lit("s"), F.col("id") % 200).alias("session_id"), F.concat(F.lit("m"), "id").alias("model"), F.lit(1).alias("input_tokens"), F.lit(0).alias("output_tokens"))
    times = sessions.select(F.col("id").alias("external_id"), database.epoch_millis("started_at").alias("started_at"), F.lit(None).cast("long").alias("ended_at"))
    rest = hermes.session_usage(sessions, hermes.model_usage(models), times)
    got = {r.conversation_id: (r.input_tokens, r.output_tokens, r.total_tokens, r.interval_start) for r in rest.collect()}
    want = {}
    for i in range(400):
        own, said = i % 7 + 3, 4 if i < 200 else 0
        left = (max(own - said, 0), 2, max(own + 2 - said, 0), 1000)
        if left[2]:
            want[f"s{i}"] = left
    assert got == want
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count(", 20") >= 2  # 400 sessions, 20 a task
