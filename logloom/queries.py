"""Queries over the driver's tables for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import canon, cost, text
from .operators import search as S
from .operators import usage as U
from .operators.usage import UsageFilters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- usage: totals and filters
_MONEY = ("actual_usd", "estimated_usd", "accounted_usd", "list_estimated_usd")
_SUMS = [f"{t}_tokens" for t in U.TOKENS]
_DUCK_TOTALS = (
    "count(*) AS events, CAST(sum(api_calls) AS BIGINT) AS api_calls, CAST(sum(request_attempts) AS BIGINT) AS request_attempts, count(DISTINCT conversation_id) AS conversations, "
    "count(DISTINCT concat(agent, ':', coalesce(logical_session_id, concat('record:', conversation_id)))) AS logical_sessions, "
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)
    + ", round(sum(act), 4) AS actual_usd, round(sum(est), 4) AS estimated_usd, round(sum(coalesce(act, est)), 4) AS accounted_usd, count(act) AS actual_events, count(est) AS estimated_events, "
    "CAST(coalesce(sum(CASE WHEN act IS NOT NULL OR est IS NOT NULL THEN total_tokens END), 0) AS BIGINT) AS covered_tokens"
)
_DUCK_LIST = "round(sum(usd), 4) AS list_estimated_usd, count(usd) AS list_estimated_events, CAST(coalesce(sum(CASE WHEN usd IS NOT NULL THEN total_tokens END), 0) AS BIGINT) AS list_estimated_tokens"
_NO_LIST = "CAST(NULL AS DOUBLE) AS list_estimated_usd, 0 AS list_estimated_events, 0 AS list_estimated_tokens"
_ALL = f"{_DUCK_TOTALS}, {_NO_LIST}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in df.columns if c in _MONEY or c.endswith("_percent")})


def _usage_sql(body: str, where: str = "TRUE", time: str = "TRUE") -> str:
    return f"WITH {A.duck_usage()}, f AS (SELECT * FROM u WHERE {where}), {A.duck_dedup('f')}, t AS (SELECT * FROM d WHERE {time}) {body}"


def _totals_query(name: str, filters: UsageFilters, where: str = "TRUE", time: str = "TRUE") -> None:
    @register(name, _usage_sql(f"SELECT {_ALL} FROM t", where, time))
    def query(spark, sf_dir):
        return _rounded(U.totals(U.select_rows(A.usage_rows(spark, sf_dir), filters)))


_SINCE, _UNTIL = 1_704_672_000_000, 1_705_881_600_000  # 2024-01-08, 2024-01-22
_totals_query("usage_totals", UsageFilters())
_totals_query("usage_organic", UsageFilters(exclude_synthetic=True), "NOT is_synthetic")
_totals_query("usage_time_filtered", UsageFilters(since=_SINCE, until=_UNTIL), time=f"ls >= {_SINCE} AND le <= {_UNTIL}")
_totals_query("usage_filter_agents", UsageFilters(agents=("codex", "hermes")), "agent IN ('codex', 'hermes')")
_totals_query("usage_filter_provider", UsageFilters(providers=(" OPENAI ",)), "lower(provider) = 'openai' OR provider_family = 'openai'")
_totals_query("usage_filter_provider_unknown", UsageFilters(providers=("unknown",)), "provider IS NULL OR provider_family IS NULL")
_totals_query("usage_filter_model", UsageFilters(models=("gpt", "glm-5")), "lower(model) IN ('gpt', 'glm-5') OR model_family IN ('gpt', 'glm-5')")
_totals_query("usage_filter_variant_task", UsageFilters(variants=("high", "unknown"), tasks=("REVIEW",)), "lower(coalesce(model_variant, 'unknown')) IN ('high', 'unknown') AND lower(task) = 'review'")
_totals_query("usage_filter_workspace", UsageFilters(workspace="/repo"), "workspace = '/repo'")
_totals_query("usage_filter_scope", UsageFilters(scope=("/repo/",)), "workspace IS NULL OR workspace = '/repo' OR workspace ILIKE '/repo/%'")


@register("usage_raw_totals", f"WITH {A.duck_usage()} SELECT {_ALL} FROM u")
def usage_raw_totals(spark, sf_dir):
    return _rounded(U.totals(A.usage_rows(spark, sf_dir)))


@register(
    "usage_dedup",
    _usage_sql("SELECT agent, sid AS source_event_id, conversation_id, idx, total_tokens, usage_grain, ls AS logical_start, le AS logical_end FROM t WHERE sid IS NOT NULL"),
)
def usage_dedup(spark, sf_dir):
    rows = U.deduplicate(A.usage_rows(spark, sf_dir)).where(canon.known("source_event_id"))
    return rows.select("agent", F.trim("source_event_id").alias("source_event_id"), "conversation_id", "idx", "total_tokens", "usage_grain", "logical_start", "logical_end")


# ---------------------------------------------------------------- usage: breakdowns, cost, coverage, trend
_STATUS = "CASE WHEN act IS NOT NULL THEN 'reported_actual' WHEN est IS NOT NULL THEN CASE WHEN lower(trim(cost_status)) IN ('included', 'source_reported_zero') THEN lower(trim(cost_status)) ELSE 'source_estimated' END WHEN trim(cost_status) <> '' AND lower(trim(cost_status)) <> 'unknown' THEN trim(cost_status) ELSE 'unavailable' END"


def _breakdown_query(name: str, column: str) -> None:
    value = _STATUS if column == "cost_status" else f"nullif(trim({column}), '')"
    label = f"coalesce({value}, 'Unknown')"
    if column == "agent":
        label = "CASE agent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.AGENTS.items()) + " END"
    sql = f"SELECT coalesce(lower({value}), '__unknown__') AS key, min({label}) AS label, {_ALL} FROM t GROUP BY 1"

    @register(f"usage_by_{name}", _usage_sql(sql))
    def query(spark, sf_dir):
        return _rounded(U.breakdown(U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters()), name))


for _name, _column in U.DIMENSIONS.items():
    _breakdown_query(_name, _column)


@register(
    "usage_all_breakdowns",
    _usage_sql(
        "SELECT dimension, key, min(label) AS label, count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS dimension, coalesce(lower({_STATUS if c == 'cost_status' else f'''nullif(trim({c}), '')'''}), '__unknown__') AS key, " + ("CASE agent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.AGENTS.items()) + " END" if c == "agent" else f"coalesce({_STATUS if c == 'cost_status' else f'''nullif(trim({c}), '')'''}, 'Unknown')") + " AS label, total_tokens FROM t" for n, c in U.DIMENSIONS.items())
        + ") GROUP BY 1, 2"
    ),
)
def usage_all_breakdowns(spark, sf_dir):
    return U.breakdowns(U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters())).select("dimension", "key", "label", "events", "total_tokens")


@register(
    "usage_by_provider_model",
    _usage_sql(
        f"""SELECT provider_key, model_key, arg_min(pl, rn2) AS provider_label, arg_min(ml, rn2) AS model_label, {_ALL} FROM (
  SELECT *, coalesce(lower(provider_family), '__unknown__') AS provider_key, coalesce(lower(model_family), '__unknown__') AS model_key, coalesce(provider_family, 'Unknown') AS pl, coalesce(model_family, 'Unknown') AS ml,
    row_number() OVER (ORDER BY coalesce(ls, -9000000000000000000), conversation_id, coalesce(source_event_id, ''), idx) AS rn2 FROM t) GROUP BY 1, 2"""
    ),
)
def usage_by_provider_model(spark, sf_dir):
    return _rounded(U.by_provider_model(U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters())))


@register(
    "usage_top_models",
    _usage_sql(
        f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY total_tokens DESC, api_calls DESC, key) AS rank FROM (
  SELECT coalesce(lower(model), '__unknown__') AS key, min(coalesce(model, 'Unknown')) AS label, {_ALL} FROM t GROUP BY 1)) WHERE rank <= 3 OR key = '__unknown__'"""
    ),
)
def usage_top_models(spark, sf_dir):
    rows = U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters())
    return _rounded(U.top(U.breakdown(rows, "model"), 3))


def _duck_prices() -> str:
    """Column usd by the catalog."""
    model = "regexp_extract(lower(trim(model)), '([^/]*)$', 1)"
    url = "lower(nullif(trim(billing_base_url), ''))"
    host = f"rtrim(regexp_extract(regexp_extract(regexp_extract(regexp_replace({url}, '^.*?://', ''), '^([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1), '.')"
    direct = " OR ".join(f"(provider_family = '{f}' AND CASE WHEN billing_base_url IS NOT NULL THEN {host} = '{h}' ELSE lower(trim(coalesce(provider, ''))) IN ({', '.join(repr(n) for n in cost.ROUTE_NAMES[f])}) END)" for f, h in cost.ROUTE_HOSTS.items())
    rows = []
    for f, patterns, rate, cached, write, out, tier, more_in, more_out in cost.PRICES:
        like = " OR ".join(f"{model} LIKE '{p}'" for p in patterns)
        size = "input_tokens + cache_read_tokens" + (" + cache_write_tokens" if write else "")
        a = f"(CASE WHEN {size} > {tier} THEN {more_in} ELSE 1 END)" if tier else "1"
        b = f"(CASE WHEN {size} > {tier} THEN {more_out} ELSE 1 END)" if tier else "1"
        gate = ("TRUE" if write else "cache_write_tokens = 0") + (" AND usage_grain = 'event' AND api_calls = 1" if tier else "")
        rows.append(f"WHEN provider_family = '{f}' AND ({like}) THEN CASE WHEN {gate} THEN (input_tokens * {rate} * {a} + cache_read_tokens * {cached} * {a} + cache_write_tokens * {write or 0} * {a} + output_tokens * {out} * {b}) / 1000000 END")
    modes = " AND ".join(f"lower(coalesce(billing_mode, '')) NOT LIKE '%{m}%'" for m in cost.UNFIT_MODES)
    return f"CASE WHEN total_tokens > 0 AND input_tokens + output_tokens + cache_read_tokens + cache_write_tokens = total_tokens AND component_total_tokens = total_tokens AND {modes} AND ({direct}) THEN CASE {' '.join(rows)} END END"


@register("usage_list_price", _usage_sql(f"SELECT conversation_id, idx, round(usd, 8) AS usd FROM (SELECT *, {_duck_prices()} AS usd FROM t)"))
def usage_list_price(spark, sf_dir):
    rows = U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters())
    rows = cost.with_list_cost(rows).withColumnRenamed("list_usd", "usd")
    return rows.select("conversation_id", "idx", F.round("usd", 8).alias("usd"))


@register("usage_list_cost_totals", _usage_sql(f"SELECT {_DUCK_TOTALS}, {_DUCK_LIST} FROM (SELECT *, {_duck_prices()} AS usd FROM t)"))
def usage_list_cost_totals(spark, sf_dir):
    return _rounded(U.totals(U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters(list_costs=True)), True))


def _duck_percent(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0.0 ELSE 100.0 * {a} / {b} END, 4)"


def _coverage_sql(where: str, time: str, bucket: str) -> str:
    n = lambda c, v="1": f"CAST(coalesce(sum(CASE WHEN {c} THEN {v} END), 0) AS BIGINT)"
    b = lambda x: f"date_trunc('{bucket}', to_timestamp({x} // 1000) AT TIME ZONE 'UTC')"
    dims = ("provider", "model", "provider_family", "model_family")
    slot = f"(CASE WHEN usage_grain = 'event' THEN ls IS NOT NULL ELSE {b('ls')} = {b('le')} END)"
    cols = {
        "ev": "count(*)", "calls": n("TRUE", "api_calls"), "tok": n("TRUE", "total_tokens"),
        "events_with_tokens": n("input_tokens > 0 OR output_tokens > 0 OR cache_read_tokens > 0 OR cache_write_tokens > 0 OR reasoning_tokens > 0 OR total_tokens > 0"),
        **{f"api_calls_with_{c}": n(f"trim({c}) <> ''", "api_calls") for c in dims}, **{f"tokens_with_{c}": n(f"trim({c}) <> ''", "total_tokens") for c in dims},
        "events_with_reported_total": n("reported_total_tokens IS NOT NULL"), "events_with_component_total": n("component_total_tokens IS NOT NULL"),
        "events_with_reconciled_total": n("reported_total_tokens = component_total_tokens"), "events_with_total_mismatch": n("reported_total_tokens <> component_total_tokens"),
        "events_with_token_semantics": n("trim(token_semantics) <> ''"), "tokens_with_token_semantics": n("trim(token_semantics) <> ''", "total_tokens"),
        "events_with_timestamp": n("usage_grain = 'event' AND ls IS NOT NULL"), "timestamped_tokens": n("usage_grain = 'event' AND ls IS NOT NULL", "total_tokens"),
        "timeline_allocated_tokens": n(slot, "total_tokens"), "covered": n("act IS NOT NULL OR est IS NOT NULL", "total_tokens"),
    }
    share = {
        "token_event_percent": ("events_with_tokens", "ev"), **{f"{c}_percent": (f"api_calls_with_{c}", "calls") for c in dims}, **{f"{c}_token_percent": (f"tokens_with_{c}", "tok") for c in dims},
        "reconcilable_total_percent": ("(events_with_reconciled_total + events_with_total_mismatch)", "ev"), "reconciled_total_percent": ("events_with_reconciled_total", "(events_with_reconciled_total + events_with_total_mismatch)"),
        "token_semantics_percent": ("events_with_token_semantics", "ev"), "token_semantics_token_percent": ("tokens_with_token_semantics", "tok"), "timestamp_percent": ("events_with_timestamp", "ev"), "timestamp_token_percent": ("timestamped_tokens", "tok"),
        "cost_token_percent": ("covered", "tok"), "timeline_allocated_token_percent": ("timeline_allocated_tokens", "tok"),
    }
    inner = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return _usage_sql(
        f"SELECT a.* EXCLUDE (ev, calls, tok, covered), tok - timeline_allocated_tokens AS temporally_unallocated_tokens, CAST(x.all_tok - tok AS BIGINT) AS temporally_excluded_tokens, r.n - x.n AS deduplicated_events, CAST(r.tok - x.all_tok AS BIGINT) AS deduplicated_tokens, "
        + ", ".join(f"{_duck_percent(*p)} AS {k}" for k, p in share.items()).replace("(tok", "(a.tok").replace(" tok ", " a.tok ")
        + f" FROM (SELECT {inner} FROM t) a, (SELECT count(*) AS n, sum(total_tokens) AS all_tok FROM d) x, (SELECT count(*) AS n, sum(total_tokens) AS rtok FROM f) r",
        where, time,
    ).replace("CAST(r.tok - x.all_tok", "CAST(r.rtok - x.all_tok")


@register("usage_coverage", _coverage_sql("NOT is_synthetic", f"ls >= {_SINCE} AND le <= {_UNTIL}", "day"))
def usage_coverage(spark, sf_dir):
    f = UsageFilters(exclude_synthetic=True, since=_SINCE, until=_UNTIL)
    return _rounded(U.coverage(A.usage_rows(spark, sf_dir), f, "day"))


def _trend_query(bucket: str, name: str | None = None, since: int | None = None) -> None:
    """A trend; by another ``name`` with a bucket that the span decides, or from so early on that empty buckets are left out."""
    name, start = name or bucket, _SINCE if since is None else since
    b = lambda x: f"date_trunc('{bucket}', CAST(to_timestamp({x} // 1000) AT TIME ZONE 'UTC' AS TIMESTAMP))"
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[bucket]
    label = {"day": "strftime(g, '%b %-d')", "week": "'Week of ' || strftime(g, '%b %-d')", "month": "strftime(g, '%b %Y')"}[bucket]
    last = b(f"(SELECT greatest(max(le), {A.AS_OF}) FROM t)")
    grid = f"SELECT unnest(generate_series({b(start)}, {last}, {step})) AS g"
    if since is not None:
        grid = f"SELECT {b('ls')} AS g FROM t WHERE usage_grain = 'event' OR {b('ls')} = {b('le')} UNION SELECT {b(start)} UNION SELECT {last}"
    sums = ", ".join(f"coalesce(x.{c}, 0) AS {c}" for c in ("events", "api_calls", "conversations", "logical_sessions", *_SUMS))
    sql = _usage_sql(
        f"""SELECT epoch_us(g) // 1000 AS bucket_start, {label} AS label, {sums}, x.actual_usd FROM ({grid}) LEFT JOIN (
  SELECT {b('ls')} AS k, {_ALL} FROM t WHERE usage_grain = 'event' OR {b('ls')} = {b('le')} GROUP BY 1) x ON x.k = g""",
        "TRUE", f"ls >= {start} AND le IS NOT NULL",
    )

    @register(f"usage_trend_{name}", sql)
    def query(spark, sf_dir):
        f = UsageFilters(since=start, bucket="auto" if name == "auto" else bucket)
        rows = U.select_rows(A.usage_rows(spark, sf_dir), f)
        out, _ = U.trend(rows, U.window(rows, f, A.AS_OF))
        return _rounded(out.select("bucket_start", "label", "events", "api_calls", "conversations", "logical_sessions", *_SUMS, "actual_usd"))


for _bucket in ("day", "week", "month"):
    _trend_query(_bucket)
_trend_query("day", "auto")
_trend_query("day", "sparse", -2_208_988_800_000)


@register("usage_unallocated", _usage_sql("SELECT agent, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM t WHERE usage_grain <> 'event' AND date_trunc('day', to_timestamp(ls // 1000) AT TIME ZONE 'UTC') <> date_trunc('day', to_timestamp(le // 1000) AT TIME ZONE 'UTC') GROUP BY 1"))
def usage_unallocated(spark, sf_dir):
    rows = U.select_rows(A.usage_rows(spark, sf_dir), UsageFilters())
    return rows.where((F.col("usage_grain") != "event") & U.allocated("day").isNull()).groupBy("agent").agg(U.saturating_sum("total_tokens").alias("tokens"))


# ---------------------------------------------------------------- canonical dimensions
@register("canonical_provider", f"WITH {A.duck_usage()} SELECT idx, provider_family, provider_inference_source, provider_inference_confidence FROM u")
def canonical_provider(spark, sf_dir):
    return A.usage_rows(spark, sf_dir).select("idx", "provider_family", "provider_inference_source", "provider_inference_confidence")


@register("canonical_model", f"WITH {A.duck_usage()} SELECT model, model_family, count(*) AS n FROM u GROUP BY 1, 2")
def canonical_model(spark, sf_dir):
    return A.usage_rows(spark, sf_dir).groupBy("model", "model_family").agg(F.count("*").alias("n"))


@register("route_host", "SELECT page_id, rtrim(regexp_extract(regexp_extract(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1), '.') AS host FROM pages WHERE url IS NOT NULL")
def route_host(spark, sf_dir):
    return _read(spark, sf_dir, "pages").where("url is not null").select("page_id", canon.route_host("url").alias("host"))


@register("parse_timestamp", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000 WHEN 1 THEN epoch_us(ts) // 1000 ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS ms FROM events")
def parse_timestamp(spark, sf_dir):
    ms = "unix_micros(CAST(ts AS TIMESTAMP))"
    raw = F.expr(f"CASE event_id % 3 WHEN 0 THEN CAST({ms} div 1000000 AS STRING) WHEN 1 THEN CAST({ms} div 1000 AS STRING) ELSE date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END")
    return _read(spark, sf_dir, "events").select("event_id", canon.parse_timestamp(raw).alias("ms"))


@register("resolved_cost_status", f"WITH {A.duck_usage()} SELECT {_STATUS} AS status, count(*) AS n FROM u GROUP BY 1")
def resolved_cost_status(spark, sf_dir):
    return cost.with_costs(A.usage_rows(spark, sf_dir)).groupBy(F.col("resolved_cost_status").alias("status")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- stores: coverage, stats, conversations
def _stored_events(spark, sf_dir):
    return A.usage_rows(spark, sf_dir).withColumn("conversation_id", F.col("conversation_id") % 50).drop("agent", "workspace", "logical_session_id")


@register(
    "source_coverage",
    f"""WITH {A.DUCK_CONVERSATIONS}, {A.duck_usage()},
mc AS (SELECT conversation_id, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS m FROM m GROUP BY 1),
uc AS (SELECT conversation_id % 50 AS conversation_id, count(*) AS u, sum(api_calls) AS a, sum(request_attempts) AS r, sum(total_tokens) AS t FROM u GROUP BY 1)
SELECT agent, count(*) AS transcript_records, count(DISTINCT coalesce(nullif(logical_session_id, ''), 'record:' || id)) AS logical_sessions, CAST(sum(coalesce(m, 0)) AS BIGINT) AS assistant_messages,
  CAST(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS BIGINT) AS assistant_records, CAST(sum(coalesce(u, 0)) AS BIGINT) AS usage_records, CAST(sum(CASE WHEN u > 0 THEN 1 ELSE 0 END) AS BIGINT) AS usage_bearing_records,
  CAST(sum(CASE WHEN m > 0 AND coalesce(u, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS assistant_without_usage_records, CAST(sum(coalesce(a, 0)) AS BIGINT) AS api_calls, CAST(sum(coalesce(r, 0)) AS BIGINT) AS request_attempts, CAST(sum(coalesce(t, 0)) AS BIGINT) AS total_tokens
FROM c LEFT JOIN mc ON mc.conversation_id = c.id LEFT JOIN uc ON uc.conversation_id = c.id GROUP BY agent""",
)
def source_coverage(spark, sf_dir):
    own, messages = A.conversations(spark, sf_dir)
    return U.source_coverage(own, messages, _stored_events(spark, sf_dir))


def _stats_query(name: str, scope, where: str) -> None:
    @register(
        name,
        f"""WITH {A.DUCK_CONVERSATIONS}, s AS (SELECT * FROM c WHERE {where})
SELECT s.agent, count(DISTINCT s.id) AS conversations, count(m.conversation_id) AS messages, (SELECT max(indexed_at) FROM c) AS last_indexed_at FROM s LEFT JOIN m ON m.conversation_id = s.id GROUP BY 1""",
    )
    def query(spark, sf_dir):
        from .operators.store import stats

        own, messages = A.conversations(spark, sf_dir)
        return stats(own, messages, scope)


_stats_query("stats_global", None, "TRUE")
_stats_query("stats_scoped", ("/repo",), "workspace IS NULL OR workspace = '' OR workspace = '/repo' OR workspace ILIKE '/repo/%'")


@register(
    "conversation_full_text",
    f"WITH {A.DUCK_CONVERSATIONS} SELECT conversation_id AS id, md5(string_agg('[' || role || '] ' || content, chr(10) || chr(10) ORDER BY idx)) AS digest, count(*) AS n FROM m GROUP BY 1",
)
def conversation_full_text(spark, sf_dir):
    from .operators.store import full_texts

    _, messages = A.conversations(spark, sf_dir)
    return full_texts(messages).select("id", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("n_messages").alias("n"))


@register(
    "conversation_title",
    f"""WITH {A.DUCK_CONVERSATIONS}, f AS (SELECT conversation_id AS id, arg_min(content, idx) AS t FROM m WHERE role = 'user' GROUP BY 1)
SELECT c.id, CASE WHEN f.t IS NULL THEN 'Untitled' WHEN octet_length(encode(split_part(t, chr(10), 1))) <= 100 THEN split_part(t, chr(10), 1)
  ELSE (SELECT max(p) FROM (SELECT substr(split_part(t, chr(10), 1), 1, n) AS p FROM range(1, 98) r(n)) WHERE octet_length(encode(p)) <= 97) || '...' END AS title
FROM c LEFT JOIN f ON f.id = c.id""",
)
def conversation_title(spark, sf_dir):
    from .operators.store import titles

    own, messages = A.conversations(spark, sf_dir)
    return titles(own.select("id", F.lit(None).cast("string").alias("title")), messages)


# ---------------------------------------------------------------- search
_DUCK_INDEX = f"""{A.DUCK_DOCS},
fields AS (SELECT id, 'content' AS field, content AS t FROM docs UNION ALL SELECT id, 'title', CASE WHEN octet_length(encode(line)) <= 100 THEN line ELSE (SELECT max(p) FROM (SELECT substr(line, 1, n) AS p FROM range(1, 98) r(n)) WHERE octet_length(encode(p)) <= 97) || '...' END FROM docs),
toks AS (SELECT id, field, list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'), lambda x: octet_length(encode(x)) < 40) AS w FROM fields),
sizes AS (SELECT field, count(*) AS n, avg(len(w)) AS a FROM toks GROUP BY 1)"""


def _duck_bm25(terms: list[str]) -> str:
    hits = " UNION ALL ".join(f"SELECT {i} AS alt, field, id, len(w) AS dl, len(list_filter(w, lambda x: x = '{t}')) AS tf FROM toks" for i, t in enumerate(terms))
    return f"""{_DUCK_INDEX}, h AS (SELECT * FROM ({hits}) WHERE tf > 0), df AS (SELECT alt, field, count(*) AS df FROM h GROUP BY 1, 2),
bm AS (SELECT h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS bm25 FROM h JOIN df USING (alt, field) JOIN sizes USING (field) GROUP BY 1)"""


_TERMS = ["thnd", "eau"]
_TEXT = " ".join(_TERMS)
_REC = f"(CASE WHEN ({A.AS_OF} - created_at) // 86400000 <= 0 THEN 1.0 WHEN ({A.AS_OF} - created_at) // 86400000 > 365 THEN 0.0 ELSE 1 - (({A.AS_OF} - created_at) // 86400000) / 365.0 END)"


@register("search_bm25", f"WITH {_duck_bm25(_TERMS)} SELECT id, round(bm25, 6) AS score FROM bm")
def search_bm25(spark, sf_dir):
    docs = A.search_docs(spark, sf_dir)
    return S.bm25(S.postings(docs), S.lengths(docs), S.parse_query(_TEXT)).select("id", F.round("score", 6).alias("score"))


@register("search_count", f"WITH {_duck_bm25(_TERMS)} SELECT count(*) AS total_hits FROM bm JOIN docs USING (id) WHERE agent = 'codex'")
def search_count(spark, sf_dir):
    return S.count(A.search_docs(spark, sf_dir), S.SearchQuery(_TEXT, agent="codex"))


@register(
    "search_phrase",
    f"""WITH {_DUCK_INDEX}, h AS (SELECT field, id FROM toks WHERE list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), 'of the') OR list_contains(w, 'of_the')) SELECT id FROM h GROUP BY 1""",
)
def search_phrase(spark, sf_dir):
    docs = A.search_docs(spark, sf_dir)
    return S.bm25(S.postings(docs), S.lengths(docs), S.parse_query("of_the")).select("id")


def _ranked_query(name: str, q: S.SearchQuery, where: str = "TRUE") -> None:
    words, recent = S.BLENDS[q.ranking]
    by_date = q.ranking in ("newest", "oldest") or not q.text and q.ranking != "relevance"
    date = f"created_at {'ASC' if q.ranking == 'oldest' else 'DESC'}"
    base = f"{_duck_bm25(q.text.split())}, x AS (SELECT docs.*, bm25 FROM docs JOIN bm USING (id) WHERE {where})" if q.text else f"{A.DUCK_DOCS}, x AS (SELECT *, {0.0 if by_date else 1.0} AS bm25 FROM docs WHERE {where})"
    score = f"{'0.0' if by_date else 'bm25'} * {words} + {_REC} * ({recent})"
    first = date if by_date else "bm25 DESC"
    last = date if by_date else "score DESC"
    sql = f"""WITH {base}, p AS (SELECT id, created_at, {score} AS score FROM x ORDER BY {first}, id LIMIT {q.limit} OFFSET {q.offset})
SELECT id, created_at, round(score, 6) AS score, row_number() OVER (ORDER BY {last}, id) AS rank FROM p"""

    @register(name, sql)
    def query(spark, sf_dir):
        page = S.search(A.search_docs(spark, sf_dir), q, A.AS_OF)
        return page.select("id", "created_at", F.round("score", 6).alias("score"), "rank")


_ranked_query("search_recent", S.SearchQuery(_TEXT))
_ranked_query("search_balanced", S.SearchQuery(_TEXT, ranking="balanced", limit=15))
_ranked_query("search_relevance", S.SearchQuery(_TEXT, ranking="relevance"))
_ranked_query("search_page2", S.SearchQuery(_TEXT, ranking="relevance", limit=10, offset=10))
_ranked_query("search_newest", S.SearchQuery(_TEXT, ranking="newest"))
_ranked_query("search_browse_newest", S.SearchQuery(""))
_ranked_query("search_browse_oldest", S.SearchQuery("", ranking="oldest"))
_ranked_query("search_browse_relevance", S.SearchQuery("", ranking="relevance"))
_ranked_query("search_filter_agent", S.SearchQuery(_TEXT, agent="codex"), "agent = 'codex'")
_ranked_query("search_filter_workspace", S.SearchQuery(_TEXT, workspace="/repo/src1"), "workspace = '/repo/src1'")
_ranked_query("search_filter_scope", S.SearchQuery(_TEXT, scope=("/repo/src1", "/repo/src2/")), "workspace IN ('', '/repo/src1', '/repo/src2') OR workspace LIKE '/repo/src1/%' OR workspace LIKE '/repo/src2/%'")
_ranked_query("search_filter_dates", S.SearchQuery("", since=A.AS_OF - 8_640_000_000, until=A.AS_OF - 864_000_000), f"created_at BETWEEN {A.AS_OF - 8_640_000_000} AND {A.AS_OF - 864_000_000}")


@register(
    "search_filter_scores",
    f"""WITH {_duck_bm25(_TERMS)}, s AS (SELECT count(*) AS n, count_if(agent = 'codex') AS a, count_if(workspace = '') AS e, count_if(workspace = '/repo/src1') AS o, count_if(workspace = '/repo') AS p FROM docs)
SELECT id, round(bm25 + ln(1 + (n - a + 0.5) / (a + 0.5)) + 1 + CASE WHEN workspace = '' THEN ln(1 + (n - e + 0.5) / (e + 0.5)) ELSE 0 END + CASE WHEN workspace = '/repo/src1' THEN ln(1 + (n - o + 0.5) / (o + 0.5)) WHEN workspace LIKE '/repo/src1/%' THEN 1 ELSE 0 END
  + CASE WHEN workspace = '/repo' THEN ln(1 + (n - p + 0.5) / (p + 0.5)) WHEN workspace LIKE '/repo/%' THEN 1 ELSE 0 END, 6) AS score
FROM bm JOIN docs USING (id), s WHERE agent = 'codex' AND (workspace IN ('', '/repo', '/repo/src1') OR workspace LIKE '/repo/%') AND created_at <= {A.AS_OF - 8_640_000}""",
)
def search_filter_scores(spark, sf_dir):
    q = S.SearchQuery(_TEXT, agent="codex", scope=("/repo/src1/", "/repo"), until=A.AS_OF - 8_640_000, filter_scores=True)
    return S.hits(A.search_docs(spark, sf_dir), q)[0].select("id", F.round("bm25", 6).alias("score"))


@register(
    "search_snippet",
    f"""WITH {A.DUCK_DOCS}, c AS (SELECT id, CASE WHEN strlen(content) <= 300 THEN content ELSE left(content, CAST(list_max(list_filter(range(0, 301), lambda i: strlen(left(content, i)) <= 300)) AS BIGINT)) || '...' END AS p FROM docs),
s AS (SELECT id, p, instr(lower(p), 'the') AS a FROM c)
SELECT id, CASE WHEN a > 0 THEN replace(substr(p, greatest(a - 50, 1), a + 103 - greatest(a - 50, 1)), 'the', '<mark>' || substr(p, a, 3) || '</mark>') WHEN length(p) > 150 THEN substr(p, 1, 150) || '...' ELSE p END AS snippet FROM s""",
)
def search_snippet(spark, sf_dir):
    return A.search_docs(spark, sf_dir).select("id", text.snippet("preview", "the").alias("snippet"))


@register("search_document_frequency", f"WITH {_DUCK_INDEX} SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT id, field, term, count(*) AS tf FROM (SELECT id, field, unnest(w) AS term FROM toks) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def search_document_frequency(spark, sf_dir):
    return S.postings(A.search_docs(spark, sf_dir)).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


_KNN = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT e FROM q)) AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50)"


def _vector(spark, sf_dir) -> list[float]:
    return _read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@register("knn_cosine", f"WITH {_KNN} SELECT id, round(similarity, 6) AS similarity FROM near")
def knn_cosine(spark, sf_dir):
    near = S.nearest(_read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 50, "vec_id")
    return near.select("id", F.round("similarity", 6).alias("similarity"))


@register(
    "hybrid_rrf",
    f"""WITH {_duck_bm25(_TERMS)}, {_KNN}, x AS (SELECT id, bm25 * 0.3 + {_REC} * 0.7 AS score FROM (SELECT docs.*, bm25 FROM docs JOIN bm USING (id)) ORDER BY bm25 DESC, id LIMIT 50),
k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS kr FROM (SELECT docs.id, b.bm25 * 0.3 + {_REC} * 0.7 AS score FROM docs JOIN (SELECT * FROM bm ORDER BY bm25 DESC, id LIMIT 50) b ON b.id = docs.id)),
v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS sr FROM near),
f AS (SELECT coalesce(k.id, v.id) AS id, kr, coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + sr), 0) AS score FROM k FULL JOIN v ON k.id = v.id ORDER BY score DESC, 1 LIMIT 50)
SELECT id, round(score, 8) AS score FROM f WHERE kr IS NOT NULL""",
)
def hybrid_rrf(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    out = S.hybrid(A.search_docs(spark, sf_dir), vectors, _vector(spark, sf_dir), S.SearchQuery(_TEXT, limit=50), A.AS_OF)
    return out.select("id", F.round("score", 8).alias("score"))


_IN_SCOPE = "(workspace IN ('', '/repo/src1', '/repo/src2') OR workspace LIKE '/repo/src1/%' OR workspace LIKE '/repo/src2/%')"


@register(
    "hybrid_scoped",
    f"""WITH {_duck_bm25(_TERMS)}, {_KNN}, kept AS (SELECT docs.*, bm25 FROM docs JOIN bm USING (id) WHERE {_IN_SCOPE} ORDER BY bm25 DESC, id LIMIT 50),
k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS kr FROM (SELECT id, bm25 * 0.3 + {_REC} * 0.7 AS score FROM kept)),
v AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS sr FROM near WHERE id IN (SELECT id FROM docs WHERE {_IN_SCOPE})),
f AS (SELECT coalesce(k.id, v.id) AS id, kr, coalesce(1.0 / (60 + kr), 0) + coalesce(1.0 / (60 + sr), 0) AS score FROM k FULL JOIN v ON k.id = v.id ORDER BY score DESC, 1 LIMIT 50)
SELECT id, round(score, 8) AS score FROM f WHERE kr IS NOT NULL""",
)
def hybrid_scoped(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    out = S.hybrid(A.search_docs(spark, sf_dir), vectors, _vector(spark, sf_dir), S.SearchQuery(_TEXT, limit=50, scope=("/repo/src1", "/repo/src2/")), A.AS_OF)
    return out.select("id", F.round("score", 8).alias("score"))


# ---------------------------------------------------------------- store: rules on rows
@register("message_dedup", "SELECT conversation_id, role, content, row_number() OVER (PARTITION BY conversation_id ORDER BY role, content) - 1 AS idx FROM (SELECT DISTINCT conv_id AS conversation_id, role, text AS content FROM conversations)")
def message_dedup(spark, sf_dir):
    from .operators.store import normalized_messages

    _, messages = A.conversations(spark, sf_dir)
    return normalized_messages(messages).select("conversation_id", "role", "content", F.col("idx").cast("long").alias("idx"))


@register(
    "logical_root",
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id - user_id % 5 + (user_id % 5 - 1) END AS parent FROM events),
r AS (SELECT id, id AS top, 0 AS k FROM e UNION ALL SELECT r.id, e.parent, k + 1 FROM r JOIN e ON e.id = r.top WHERE e.parent IS NOT NULL AND EXISTS (SELECT 1 FROM e x WHERE x.id = e.parent))
SELECT id, arg_max(top, k) AS root FROM r GROUP BY 1""",
)
def logical_root(spark, sf_dir):
    from .operators.store import roots

    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    parent = F.when(F.col("id") % 5 != 0, F.col("id") - 1)
    return roots(rows.select("id", parent.alias("parent")))


@register(
    "session_residual",
    f"WITH {A.duck_usage()}, p AS (SELECT conversation_id, sum(total_tokens) AS t FROM u WHERE usage_grain = 'event' GROUP BY 1), s AS (SELECT conversation_id, max(total_tokens) * 40 AS t FROM u GROUP BY 1) SELECT s.conversation_id, CAST(s.t - coalesce(p.t, 0) AS BIGINT) AS total_tokens FROM s LEFT JOIN p USING (conversation_id) WHERE s.t > coalesce(p.t, 0)",
)
def session_residual(spark, sf_dir):
    from .operators.store import residual

    rows = A.usage_rows(spark, sf_dir)
    sessions = rows.groupBy("conversation_id").agg((F.max("total_tokens") * 40).alias("total_tokens"))
    return residual(sessions, rows.where("usage_grain = 'event'"), ["total_tokens"])


@register(
    "dry_run_classes",
    """WITH o AS (SELECT doc_id AS k, md5(text) AS f, 1 AS o FROM documents), n AS (SELECT CASE WHEN doc_id % 4 = 0 THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN doc_id % 10 = 5 THEN 'x' ELSE md5(text) END AS f, 1 AS n FROM documents)
SELECT CASE WHEN o IS NULL THEN 'insert' WHEN n IS NULL THEN 'delete' WHEN o.f IS DISTINCT FROM n.f THEN 'update' ELSE 'unchanged' END AS class, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1""",
)
def dry_run_classes(spark, sf_dir):
    from .operators.store import change_classes

    docs = _read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("source_fingerprint"))
    old = docs.select(F.col("doc_id").cast("string").alias("source_path"), "source_fingerprint")
    key = F.when(F.col("doc_id") % 4 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    new = docs.select(key.cast("string").alias("source_path"), F.when(F.col("doc_id") % 10 == 5, "x").otherwise(F.col("source_fingerprint")).alias("source_fingerprint"))
    return change_classes(old, new).groupBy("class").agg(F.count("*").alias("n"))
