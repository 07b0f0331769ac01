"""Usage analytics: dimension filters, then dedup, then the time filter, then totals, breakdowns, coverage, trend.

Input rows are ``usage_rows``: usage events joined with their conversation (agent, workspace, logical session,
record kind, synthetic flag).  Everything is declarative; only spans and bucket counts, single rows, come to the
driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon, cost
from ..functions.canon import blank_to_null, known, recorded_cost, trimmed
from ..schema import AGENTS

UNKNOWN = "__unknown__"
LONG_MAX = (1 << 63) - 1
#: name of a breakdown -> column
DIMENSIONS = {
    "harness": "agent",
    "provider": "provider",
    "provider_family": "provider_family",
    "model": "model",
    "model_family": "model_family",
    "model_variant": "model_variant",
    "task": "task",
    "billing_mode": "billing_mode",
    "usage_grain": "usage_grain",
    "record_kind": "record_kind",
    "provider_inference_source": "provider_inference_source",
    "provider_inference_confidence": "provider_inference_confidence",
    "token_semantics": "token_semantics",
    "cost_status": "cost_status",
    "cost_source": "cost_source",
    "pricing_version": "pricing_version",
}
TOKENS = ("input", "output", "cache_read", "cache_write", "reasoning", "total")
MAX_DENSE = 10_000


@dataclass(frozen=True)
class UsageFilters:
    agents: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ()
    workspace: str | None = None
    scope: tuple[str, ...] | None = None
    exclude_synthetic: bool = False
    since: int | None = None
    until: int | None = None
    bucket: str = "auto"
    list_costs: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if self.since is not None and self.until is not None and self.since > self.until:
            raise ValueError("since is later than until")


def usage_rows(events: DataFrame, conversations: DataFrame) -> DataFrame:
    """usage_events joined with conversations; negative counters count as 0."""
    own = conversations.select(F.col("id").alias("conversation_id"), "agent", "workspace", "logical_session_id", "record_kind", "is_synthetic")
    counters = [f"{t}_tokens" for t in TOKENS] + ["api_calls", "request_attempts"]
    return events.withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("long") for c in counters}).join(own, "conversation_id")


def starts() -> Column:
    return F.when(F.col("usage_grain") == "event", F.col("timestamp")).otherwise(F.col("interval_start"))


def ends() -> Column:
    return F.when(F.col("usage_grain") == "event", F.col("timestamp")).otherwise(F.col("interval_end"))


def _one_of(values, *columns: str) -> Column:
    wanted = [v.strip().lower() for v in values]
    out = F.lit(False)
    for c in columns:
        out = out | F.lower(F.coalesce(blank_to_null(c), F.lit("unknown"))).isin(*wanted)
    return out


def filter_dimensions(rows: DataFrame, f: UsageFilters) -> DataFrame:
    if f.agents:
        rows = rows.where(F.col("agent").isin(*f.agents))
    if f.exclude_synthetic:
        rows = rows.where(~F.coalesce("is_synthetic", F.lit(False)))
    for values, columns in ((f.providers, ("provider", "provider_family")), (f.models, ("model", "model_family")), (f.variants, ("model_variant",)), (f.tasks, ("task",))):
        if values:
            # the family is asked only where the value named is not the raw column's "unknown"
            named = tuple(v for v in values if v.strip().lower() != "unknown")
            test = _one_of(values, columns[0])
            if len(columns) > 1 and named:
                test = test | _one_of(named, columns[1])
            if len(columns) > 1 and len(named) < len(values):
                test = test | _one_of(("unknown",), columns[1])
            rows = rows.where(test)
    if f.workspace is not None:
        rows = rows.where(F.col("workspace") == f.workspace)
    if f.scope is not None:
        rows = rows.where(canon.in_scope("workspace", f.scope))
    return rows


def _order() -> Column:
    """The order in which rows are read: nulls first."""
    at = F.coalesce("timestamp", "interval_start")
    return F.struct(at.isNotNull().alias("k"), at.alias("t"), F.col("conversation_id").alias("c"), F.col("idx").alias("i"))


def _preference() -> Column:
    detail = sum((F.when(F.col(f"{t}_tokens") > 0, 1).otherwise(0) for t in TOKENS[:-1]), F.lit(0))
    start = starts()
    has_cost = recorded_cost("actual_cost_usd", "cost_status", True).isNotNull() | recorded_cost("estimated_cost_usd", "cost_status", False).isNotNull()
    at = F.coalesce("timestamp", "interval_start")
    parts = [
        F.col("total_tokens"), detail, start.isNotNull(), -F.coalesce(start, F.lit(LONG_MAX)), known("provider"), known("model"), known("provider_family"),
        has_cost, -F.col("conversation_id"), at.isNull(), -F.coalesce(at, F.lit(0)), -F.col("idx"),
    ]  # fmt: skip  of equals the row read first
    return F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)])


def deduplicate(rows: DataFrame) -> DataFrame:
    """Merge rows with one (agent, trimmed source_event_id); rows without an id stay.  Adds logical_start, logical_end.

    Identified rows are aggregated with partial aggregation, so that a hot id is no hot task; rows without an id
    are not shuffled."""
    ident = blank_to_null("source_event_id")
    rows = rows.withColumns({"__id": ident, "logical_start": starts(), "logical_end": ends()})
    alone = rows.where(F.col("__id").isNull()).drop("__id")
    names = [c for c in rows.columns if c not in ("__id", "logical_start", "logical_end")]
    mine = rows.where(F.col("__id").isNotNull()).withColumn("__order", _order())
    keys = ["agent", "__id"]
    # the first row that is no plain event, in reading order
    other = F.when(F.col("usage_grain") != "event", F.col("__order"))
    merged = mine.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in names]), _preference()).alias("row"), F.min("logical_start").alias("logical_start"), F.min(other).alias("__other")
    )
    late = merged.where(F.col("__other").isNotNull()).select(*keys, "__other")
    ended = mine.join(late, keys).groupBy(*keys).agg(
        F.greatest(F.min(F.when(F.col("__order") < F.col("__other"), F.col("logical_start"))), F.max(F.when(F.col("__order") >= F.col("__other"), F.col("logical_end")))).alias("__end")
    )
    found = merged.join(ended, keys, "left")
    end = F.when(F.col("__other").isNull(), F.col("logical_start")).otherwise(F.col("__end"))
    # ``agent`` is a key and part of the row; the row's own fields are what comes out
    return found.select(*[F.col(f"row.{c}").alias(c) for c in names], "logical_start", end.alias("logical_end")).unionByName(alone.select(*names, "logical_start", "logical_end"))


def in_time(f: UsageFilters) -> Column:
    test = F.lit(True)
    if f.since is not None or f.until is not None:
        test = F.col("logical_start").isNotNull() & F.col("logical_end").isNotNull()
        if f.since is not None:
            test = test & (F.col("logical_start") >= f.since)
        if f.until is not None:
            test = test & (F.col("logical_end") <= f.until)
    return F.coalesce(test, F.lit(False))


def select_rows(rows: DataFrame, f: UsageFilters) -> DataFrame:
    return deduplicate(filter_dimensions(rows, f)).where(in_time(f))


def saturating_sum(x: Column | str) -> Column:
    total = F.coalesce(F.sum(canon.col(x).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def costed(selected: DataFrame, list_costs: bool = False) -> DataFrame:
    """With what ``total_columns`` and the cost dimension read."""
    return selected if "resolved_cost_status" in selected.columns else cost.with_costs(selected, list_costs)


def total_columns() -> list[Column]:
    actual, estimated, own = F.col("actual_usd"), F.col("estimated_usd"), F.col("list_usd")
    counted = lambda x: F.when(x, F.col("total_tokens"))
    return [
        F.count("*").alias("events"),
        saturating_sum("api_calls").alias("api_calls"),
        saturating_sum("request_attempts").alias("request_attempts"),
        F.countDistinct("conversation_id").alias("conversations"),
        F.countDistinct(F.struct("agent", F.coalesce("logical_session_id", F.concat(F.lit("record:"), F.col("conversation_id").cast("string"))))).alias("logical_sessions"),
        *[saturating_sum(f"{t}_tokens").alias(f"{t}_tokens") for t in TOKENS],
        F.sum(actual).alias("actual_usd"),
        F.sum(estimated).alias("estimated_usd"),
        F.sum(F.coalesce(actual, estimated)).alias("accounted_usd"),
        F.sum(own).alias("list_estimated_usd"),
        F.count(actual).alias("actual_events"),
        F.count(estimated).alias("estimated_events"),
        F.count(own).alias("list_estimated_events"),
        saturating_sum(counted(actual.isNotNull() | estimated.isNotNull())).alias("covered_tokens"),
        saturating_sum(counted(own.isNotNull())).alias("list_estimated_tokens"),
    ]


def totals(selected: DataFrame, list_costs: bool = False) -> DataFrame:
    return costed(selected, list_costs).agg(*total_columns())


def dimension(column: str) -> tuple[Column, Column]:
    """(key, label) of costed rows."""
    if column == "agent":
        names = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
        return F.col("agent"), F.coalesce(F.try_element_at(names, F.col("agent")), F.col("agent"))
    value = blank_to_null("resolved_cost_status" if column == "cost_status" else column)
    return F.coalesce(F.lower(value), F.lit(UNKNOWN)), F.coalesce(value, F.lit("Unknown"))


def breakdown(selected: DataFrame, name: str, list_costs: bool = False) -> DataFrame:
    """Totals by one dimension; the label is the smallest of its spellings; most tokens first."""
    key, label = dimension(DIMENSIONS[name])
    grouped = costed(selected, list_costs).withColumns({"__key": key, "__label": label}).groupBy(F.col("__key").alias("key"))
    return grouped.agg(F.min("__label").alias("label"), *total_columns()).orderBy(F.desc("total_tokens"), F.desc("api_calls"), "key")


def breakdowns(selected: DataFrame, names=tuple(DIMENSIONS), list_costs: bool = False) -> DataFrame:
    """All dimensions in one pass over the rows.

    Rows are first summed by all dimensions and what distinct counts need, so that what is taken once for each dimension
    are these sums and not the events."""
    session = F.struct("agent", F.coalesce("logical_session_id", F.concat(F.lit("record:"), F.col("conversation_id").cast("string"))))
    rows = costed(selected, list_costs)
    both = {n: dimension(DIMENSIONS[n]) for n in names}
    rows = rows.select(
        "conversation_id", session.alias("__session"), *[c.alias(f"__{k}_{n}") for n in names for k, c in zip("kl", both[n])], "api_calls", "request_attempts", *[f"{t}_tokens" for t in TOKENS], "actual_usd", "estimated_usd", "list_usd",
    )
    keys = ["conversation_id", "__session", *[f"__{k}_{n}" for n in names for k in "kl"]]
    exact = lambda x: F.sum(canon.col(x).cast("decimal(38,0)"))
    actual, estimated, own = F.col("actual_usd"), F.col("estimated_usd"), F.col("list_usd")
    whole = ["api_calls", "request_attempts", *[f"{t}_tokens" for t in TOKENS], "covered_tokens", "list_estimated_tokens"]
    parts = rows.groupBy(*keys).agg(
        F.count("*").alias("events"), *[exact(c).alias(c) for c in whole[:-2]], exact(F.when(actual.isNotNull() | estimated.isNotNull(), F.col("total_tokens"))).alias("covered_tokens"), exact(F.when(own.isNotNull(), F.col("total_tokens"))).alias("list_estimated_tokens"),
        F.sum(actual).alias("actual_usd"), F.sum(estimated).alias("estimated_usd"), F.sum(F.coalesce(actual, estimated)).alias("accounted_usd"), F.sum(own).alias("list_estimated_usd"),
        F.count(actual).alias("actual_events"), F.count(estimated).alias("estimated_events"), F.count(own).alias("list_estimated_events"),
    )
    pairs = [F.struct(F.lit(n).alias("dimension"), F.col(f"__k_{n}").alias("key"), F.col(f"__l_{n}").alias("label")) for n in names]
    each = parts.withColumn("__d", F.explode(F.array(*pairs))).select("*", "__d.*")
    top_ = F.lit(LONG_MAX).cast("decimal(38,0)")
    sums = {c: F.least(F.coalesce(F.sum(c), F.lit(0).cast("decimal(38,0)")), top_).cast("long") for c in whole}
    counts, money = ("events", "actual_events", "estimated_events", "list_estimated_events"), ("actual_usd", "estimated_usd", "accounted_usd", "list_estimated_usd")
    plain = {c: F.sum(c) for c in (*counts, *money)}
    distinct = {"conversations": F.countDistinct("conversation_id"), "logical_sessions": F.countDistinct("__session")}
    order = ["events", "api_calls", "request_attempts", "conversations", "logical_sessions", *[f"{t}_tokens" for t in TOKENS], *money, *counts[1:], "covered_tokens", "list_estimated_tokens"]
    return each.groupBy("dimension", "key").agg(F.min("label").alias("label"), *[(sums | plain | distinct)[c].alias(c) for c in order])


def top(breakdown_: DataFrame, n: int) -> DataFrame:
    """The first n keys by tokens, calls, key, and the unknown one if it is cut off.  ``rank`` counts rows in that order;
    each task keeps n rows, and only the unknown key's rank is counted over all."""
    from pyspark.sql import Window as W

    order = [F.desc("total_tokens"), F.desc("api_calls"), F.col("key")]
    first = breakdown_.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))  # of n rows
    own = breakdown_.where(F.col("key") == UNKNOWN)
    ahead = breakdown_.crossJoin(own.select(F.col("total_tokens").alias("__t"), F.col("api_calls").alias("__c")))  # by one row
    before = (F.col("total_tokens") > F.col("__t")) | (F.col("total_tokens") == F.col("__t")) & ((F.col("api_calls") > F.col("__c")) | (F.col("api_calls") == F.col("__c")) & (F.col("key") < UNKNOWN))
    rank = ahead.agg((F.sum(F.when(before, 1).otherwise(0)) + 1).alias("rank"))
    late = own.crossJoin(rank).where(F.col("rank") > n).select(*breakdown_.columns, F.col("rank").cast("long").alias("rank"))
    return first.unionByName(late)


def by_provider_model(selected: DataFrame, list_costs: bool = False) -> DataFrame:
    """Totals by (provider family, model family); labels are those of the first row in time."""
    pk, pl = dimension("provider_family")
    mk, ml = dimension("model_family")
    first = F.struct(F.coalesce("logical_start", F.lit(-LONG_MAX - 1)), "conversation_id", F.coalesce("source_event_id", F.lit("")), "idx")
    rows = costed(selected, list_costs).withColumns({"provider_key": pk, "model_key": mk, "__pl": pl, "__ml": ml, "__first": first})
    grouped = rows.groupBy("provider_key", "model_key").agg(F.min_by("__pl", "__first").alias("provider_label"), F.min_by("__ml", "__first").alias("model_label"), *total_columns())
    return grouped.orderBy(F.desc("total_tokens"), "provider_key", "model_key")


def bucket_start(ms: Column, bucket: str) -> Column:
    """Epoch milliseconds of the UTC day, Monday week or month; the session's zone is UTC."""
    return (F.unix_micros(F.date_trunc("day" if bucket == "auto" else bucket, F.timestamp_millis(ms))) / 1000).cast("long")


def allocated(bucket: str) -> Column:
    """The bucket that a row falls into; an aggregate only if it does whole."""
    first = bucket_start(F.col("logical_start"), bucket)
    return F.when((F.col("usage_grain") == "event") | (first == bucket_start(F.col("logical_end"), bucket)), first)


def coverage(rows: DataFrame, f: UsageFilters, bucket: str) -> DataFrame:
    """The coverage counters and percentages as one row."""
    chosen = filter_dimensions(rows, f)
    raw = chosen.agg(F.count("*").alias("raw_events"), saturating_sum("total_tokens").alias("raw_tokens"))
    merged = deduplicate(chosen).withColumn("__in", in_time(f))
    when = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    one, total, calls = F.lit(1), F.col("total_tokens"), F.col("api_calls")
    rep, com = F.col("reported_total_tokens"), F.col("component_total_tokens")
    actual = recorded_cost("actual_cost_usd", "cost_status", True).isNotNull() | recorded_cost("estimated_cost_usd", "cost_status", False).isNotNull()
    at = F.col("__in")
    slot = allocated(bucket)
    dims = {"provider": "provider", "model": "model", "provider_family": "provider_family", "model_family": "model_family"}
    out = merged.agg(
        when(at, one).alias("events"), when(at, calls).alias("api_calls"), when(at, total).alias("total_tokens"),
        when(at & canon.has_tokens(), one).alias("events_with_tokens"),
        *[when(at & known(c), calls).alias(f"api_calls_with_{n}") for n, c in dims.items()],
        *[when(at & known(c), total).alias(f"tokens_with_{n}") for n, c in dims.items()],
        when(at & rep.isNotNull(), one).alias("events_with_reported_total"),
        when(at & com.isNotNull(), one).alias("events_with_component_total"),
        when(at & (rep == com), one).alias("events_with_reconciled_total"),
        when(at & (rep != com), one).alias("events_with_total_mismatch"),
        when(at & known("token_semantics"), one).alias("events_with_token_semantics"),
        when(at & known("token_semantics"), total).alias("tokens_with_token_semantics"),
        when(at & (F.col("usage_grain") == "event") & F.col("logical_start").isNotNull(), one).alias("events_with_timestamp"),
        when(at & (F.col("usage_grain") == "event") & F.col("logical_start").isNotNull(), total).alias("timestamped_tokens"),
        when(at & slot.isNotNull(), total).alias("timeline_allocated_tokens"),
        when(~at, total).alias("temporally_excluded_tokens"),
        when(at & actual, total).alias("__covered"),
        F.count("*").alias("__events"), saturating_sum("total_tokens").alias("__tokens"),
    ).crossJoin(raw)  # fmt: skip  one row by one row
    c = F.col
    share = {
        "token_event_percent": ("events_with_tokens", "events"),
        "provider_percent": ("api_calls_with_provider", "api_calls"),
        "model_percent": ("api_calls_with_model", "api_calls"),
        "provider_family_percent": ("api_calls_with_provider_family", "api_calls"),
        "model_family_percent": ("api_calls_with_model_family", "api_calls"),
        "provider_token_percent": ("tokens_with_provider", "total_tokens"),
        "model_token_percent": ("tokens_with_model", "total_tokens"),
        "provider_family_token_percent": ("tokens_with_provider_family", "total_tokens"),
        "model_family_token_percent": ("tokens_with_model_family", "total_tokens"),
        "reconcilable_total_percent": ("__both", "events"),
        "reconciled_total_percent": ("events_with_reconciled_total", "__both"),
        "token_semantics_percent": ("events_with_token_semantics", "events"),
        "token_semantics_token_percent": ("tokens_with_token_semantics", "total_tokens"),
        "timestamp_percent": ("events_with_timestamp", "events"),
        "timestamp_token_percent": ("timestamped_tokens", "total_tokens"),
        "cost_token_percent": ("__covered", "total_tokens"),
        "timeline_allocated_token_percent": ("timeline_allocated_tokens", "total_tokens"),
    }
    out = out.withColumn("__both", c("events_with_reconciled_total") + c("events_with_total_mismatch"))
    out = out.withColumns({
        "temporally_unallocated_tokens": c("total_tokens") - c("timeline_allocated_tokens"),
        "deduplicated_events": c("raw_events") - c("__events"),
        "deduplicated_tokens": c("raw_tokens") - c("__tokens"),
        **{k: canon.percent(c(a), c(b)) for k, (a, b) in share.items()},
    })
    return out.drop("events", "api_calls", "total_tokens", "__covered", "__events", "__tokens", "__both", "raw_events", "raw_tokens")


@dataclass(frozen=True)
class Window:
    since: int | None
    until: int | None
    bucket: str
    observed_since: int | None
    observed_until: int | None


def window(selected: DataFrame, f: UsageFilters, as_of: int) -> Window:
    """Extent and bucket of the trend, from one row of bounds."""
    seen = selected.agg(F.min("logical_start").alias("a"), F.max("logical_end").alias("b")).first()
    since = f.since if f.since is not None else seen["a"]
    until = f.until
    if until is None:
        until = max(seen["b"] if seen["b"] is not None else as_of, as_of) if f.since is not None else seen["b"]
    bucket = f.bucket
    if bucket == "auto":
        days = (until - since) / 86_400_000 if since is not None and until is not None else 0
        bucket = "day" if days <= 60 else "week" if days <= 730 else "month"
    return Window(since, until, bucket, seen["a"], seen["b"])


def _floor(ms: int, bucket: str) -> datetime:
    day = datetime.fromtimestamp(ms / 1000, timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
    if bucket == "week":
        return datetime.fromtimestamp(day.timestamp() - 86_400 * day.weekday(), timezone.utc)
    return day.replace(day=1) if bucket == "month" else day


def label_of(start: Column, bucket: str) -> Column:
    at = F.timestamp_millis(start)
    if bucket == "month":
        return F.date_format(at, "MMM yyyy")
    return F.concat(F.lit("Week of " if bucket == "week" else ""), F.date_format(at, "MMM d"))


def trend(selected: DataFrame, w: Window, list_costs: bool = False) -> tuple[DataFrame, bool]:
    """Totals by bucket, with empty buckets filled in; beyond MAX_DENSE of them only those observed and both ends (True)."""
    spark = selected.sparkSession
    seen = costed(selected, list_costs).withColumn("bucket_start", allocated(w.bucket)).where("bucket_start is not null")
    sums = seen.groupBy("bucket_start").agg(*total_columns())
    ends_ = [w.since, w.until]
    if ends_ == [None, None]:
        bounds = sums.agg(F.min("bucket_start"), F.max("bucket_start")).first()
        ends_ = list(bounds)
    if ends_[0] is None and ends_[1] is None:
        return sums.withColumn("label", label_of(F.col("bucket_start"), w.bucket)), False
    first, last = (_floor(ends_[i] if ends_[i] is not None else ends_[1 - i], w.bucket) for i in (0, 1))
    step = {"day": 1, "week": 7, "month": 28}[w.bucket]
    sparse = (last - first).days // step > MAX_DENSE
    ms = [int(x.timestamp() * 1000) for x in (first, max(first, last))]
    if sparse:
        grid = spark.createDataFrame([(x,) for x in sorted(set(ms))], "bucket_start long").unionByName(sums.select("bucket_start")).distinct()
    else:
        unit = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[w.bucket]
        grid = spark.range(1).select(F.explode(F.sequence(F.timestamp_millis(F.lit(ms[0])), F.timestamp_millis(F.lit(ms[1])), F.expr(unit))).alias("t")).select((F.unix_micros("t") / 1000).cast("long").alias("bucket_start"))
    counts = [c for c, t in sums.dtypes if t == "bigint" and c != "bucket_start"]
    full = grid.join(sums, "bucket_start", "left").na.fill(0, counts)
    return full.withColumn("label", label_of(F.col("bucket_start"), w.bucket)).orderBy("bucket_start"), sparse


def source_coverage(conversations: DataFrame, messages: DataFrame, events: DataFrame) -> DataFrame:
    """Per agent what the whole store holds, whatever the filters."""
    m = messages.groupBy("conversation_id").agg(F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("m"))
    u = events.groupBy("conversation_id").agg(F.count("*").alias("u"), *[F.sum(c).alias(c) for c in ("api_calls", "request_attempts", "total_tokens")])
    rows = conversations.select(F.col("id").alias("conversation_id"), "agent", "logical_session_id").join(m, "conversation_id", "left").join(u, "conversation_id", "left").na.fill(0, ["m", "u", "api_calls", "request_attempts", "total_tokens"])
    session = F.coalesce(F.nullif("logical_session_id", F.lit("")), F.concat(F.lit("record:"), F.col("conversation_id").cast("string")))
    n = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return rows.groupBy("agent").agg(
        F.count("*").alias("transcript_records"), F.countDistinct(session).alias("logical_sessions"), F.sum("m").alias("assistant_messages"), n(F.col("m") > 0).alias("assistant_records"),
        F.sum("u").alias("usage_records"), n(F.col("u") > 0).alias("usage_bearing_records"), n((F.col("m") > 0) & (F.col("u") == 0)).alias("assistant_without_usage_records"),
        *[F.sum(c).alias(c) for c in ("api_calls", "request_attempts", "total_tokens")],
    ).orderBy("agent")
