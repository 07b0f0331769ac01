"""The usage report: one dictionary from the analytics, and its renderings as text and as a self-contained HTML page.

Everything here works on what the aggregations give, whose size the dimensions and buckets bound, not the events."""

from __future__ import annotations

import html
import os
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import cost
from .operators import usage as U
from .schema import AGENTS

MONEY = ("actual_usd", "estimated_usd", "accounted_usd", "list_estimated_usd")


# ---------------------------------------------------------------- building
def _row(df: DataFrame) -> dict:
    return df.first().asDict()


def build(events: DataFrame, conversations: DataFrame, messages: DataFrame, f: U.UsageFilters, now_ms: int | None = None) -> dict:
    """The whole report.  ``events`` and ``conversations`` are the store's tables."""
    now = now_ms if now_ms is not None else int(time.time() * 1000)
    rows = U.usage_rows(events, conversations)
    chosen = U.costed(U.select_rows(rows, f), f.list_costs)
    w = U.window(chosen, f, now)
    parts: dict[str, list[dict]] = {n: [] for n in U.DIMENSIONS}
    for r in U.breakdowns(chosen, list_costs=f.list_costs).collect():  # a row for each value of a dimension
        parts[r["dimension"]].append({k: v for k, v in r.asDict().items() if k != "dimension"})
    for own in parts.values():
        own.sort(key=lambda r: (-r["total_tokens"], -r["api_calls"], r["key"]))
    points, sparse = U.trend(chosen, w, f.list_costs)
    trend = [r.asDict() for r in points.orderBy("bucket_start").collect()]
    n = conversations.agg(F.count("*").alias("n")).first()["n"]
    return {
        "generated_at": now,
        "filters": {"agents": list(f.agents), "providers": list(f.providers), "models": list(f.models), "variants": list(f.variants), "tasks": list(f.tasks), "workspace": f.workspace, "scope_roots": list(f.scope) if f.scope is not None else None, "exclude_synthetic": f.exclude_synthetic, "estimate_list_costs": f.list_costs, "since": f.since, "until": f.until, "bucket": f.bucket},
        "range": {"requested_since": f.since, "requested_until": f.until, "effective_since": w.since, "effective_until": w.until, "observed_since": w.observed_since, "observed_until": w.observed_until, "bucket": w.bucket, "sparse": sparse},
        "totals": _row(U.totals(chosen, f.list_costs)),
        "organic_totals": _row(U.totals(chosen.where(~F.coalesce("is_synthetic", F.lit(False))), f.list_costs)),
        "coverage": _row(U.coverage(rows, f, w.bucket)),
        **{f"by_{n}": own for n, own in parts.items()},
        "by_provider_model": [r.asDict() for r in U.by_provider_model(chosen, f.list_costs).collect()],
        "trend": trend,
        "indexed_conversations": n,
        "indexed_messages": messages.count(),
        "source_coverage_scope": "all_indexed_records",
        "source_coverage": [r.asDict() for r in U.source_coverage(conversations, messages, events).collect()],
        "list_price_catalog_version": cost.CATALOG if f.list_costs else None,
    }


# ---------------------------------------------------------------- numbers and words
def count(value: int) -> str:
    return f"{value:,}"


def compact(value: int) -> str:
    for size, unit in ((10**12, "T"), (10**9, "B"), (10**6, "M"), (10**3, "K")):
        if value >= size:
            scaled = value / size
            return f"{scaled:.{0 if scaled >= 100 else 1 if scaled >= 10 else 2}f}{unit}"
    return count(value)


def usd(value: float | None) -> str:
    if value is None or value != value or abs(value) == float("inf"):
        return "—"
    return f"${int(max(value, 0.0) * 100 + 0.5) / 100:,.2f}"


def day(ms: int | None) -> str:
    if ms is None:
        return "Unknown date"
    at = datetime.fromtimestamp(ms / 1000).astimezone()
    return f"{at:%b} {at.day}, {at.year}"


def instant(ms: int) -> str:
    return f"{datetime.fromtimestamp(ms / 1000, timezone.utc):%Y-%m-%d %H:%M} UTC"


def title_case(text: str) -> str:
    return text[:1].upper() + text[1:]


def cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: max(0, most - 1)] + "…"


_TURNS = {0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}


def safe(text: str) -> str:
    """For a terminal: control characters and those that turn the direction are replaced."""
    return "".join("�" if ord(c) < 32 or 127 <= ord(c) < 160 or ord(c) in _TURNS else c for c in text)


def escaped(text) -> str:
    return html.escape(str(text), quote=True).replace("&#x27;", "&#39;")


def range_text(r: dict) -> str:
    a, b = r["requested_since"], r["requested_until"]
    if a is not None and b is not None:
        return f"{day(a)} – {day(b)}"
    return f"{day(a)} onward" if a is not None else f"Through {day(b)}" if b is not None else "All indexed time"


def filter_text(f: dict) -> str:
    out = [f"Harness {', '.join(AGENTS.get(a, a) for a in f['agents'])}"] if f["agents"] else []
    out += [f"{name} {', '.join(f[key])}" for name, key in (("Provider", "providers"), ("Model", "models"), ("Variant", "variants"), ("Task", "tasks")) if f[key]]
    if f["workspace"] is not None:
        out.append(f"Workspace {f['workspace']}")
    elif f["scope_roots"]:
        out.append(f"Project {f['scope_roots'][0]}")
    if f["exclude_synthetic"]:
        out.append("Organic only")
    if f["estimate_list_costs"]:
        out.append(f"List estimates {cost.CATALOG}")
    return " · ".join(out) or "All harnesses, providers, models, and workspaces"


def leading(rows: list[dict], n: int) -> list[dict]:
    """The first rows, and the unknown one where it is cut off."""
    return rows[:n] + [r for r in rows[n:] if r["key"] == U.UNKNOWN]


def percent(part: float, whole: float) -> float:
    return 100 * part / whole if whole else 0.0


# ---------------------------------------------------------------- text
SECTIONS = (("Harnesses", "by_harness"), ("Provider routes", "by_provider"), ("Provider families", "by_provider_family"), ("Models", "by_model"), ("Model families", "by_model_family"), ("Variants", "by_model_variant"), ("Tasks", "by_task"), ("Cost status", "by_cost_status"))


def _money(t: dict) -> str:
    parts = [f"{usd(t['accounted_usd'])} recorded"] if t["accounted_usd"] is not None else []
    parts += [f"≈{usd(t['list_estimated_usd'])} list"] if t["list_estimated_usd"] is not None else []
    return ", ".join(parts) or "no recorded cost"


def text(report: dict, top: int = 10) -> str:
    t, c = report["totals"], report["coverage"]
    out = ["Usage", "=====", "", f"Range:    {range_text(report['range'])}", f"Filters:  {safe(filter_text(report['filters']))}", f"As of:    {instant(report['generated_at'])}", ""]
    if not t["events"]:
        return "\n".join([*out, "No usage matches.", ""])
    out += [
        f"{compact(t['total_tokens'])} tokens in {count(t['api_calls'])} calls, {count(t['logical_sessions'])} sessions, {count(t['events'])} records",
        f"  input {compact(t['input_tokens'])} · output {compact(t['output_tokens'])} · cache read {compact(t['cache_read_tokens'])} · cache write {compact(t['cache_write_tokens'])} · reasoning {compact(t['reasoning_tokens'])}",
        f"  {_money(t)}; organic {compact(report['organic_totals']['total_tokens'])} tokens", "",
    ]
    for name, key in SECTIONS:
        rows = leading(report[key], top)
        if rows:
            out += [name, "-" * len(name)]
            out += [f"  {cut(safe(r['label']), 32):<32} {compact(r['total_tokens']):>8} {percent(r['total_tokens'], t['total_tokens']):>5.1f}% {count(r['api_calls']):>10} calls" for r in rows]
            out.append("")
    pairs = report["by_provider_model"][:top]
    if pairs:
        out += ["Provider and model", "------------------"]
        out += [f"  {cut(safe(r['provider_label'] + ' / ' + r['model_label']), 40):<40} {compact(r['total_tokens']):>8}" for r in pairs] + [""]
    out += ["Coverage", "--------"]
    out += [f"  {title_case(k.removesuffix('_percent').replace('_', ' ')):<34} {v:>5.1f}%" for k, v in c.items() if k.endswith("_percent")]
    out += [f"  Left out of the timeline: {count(c['temporally_unallocated_tokens'])} tokens; outside the range: {count(c['temporally_excluded_tokens'])}; repeated: {count(c['deduplicated_tokens'])}", ""]
    if report["trend"]:
        most = max(p["total_tokens"] for p in report["trend"]) or 1
        shown = report["trend"][-60:]
        out += [f"Trend by {report['range']['bucket']}" + (" (empty ones left out)" if report["range"]["sparse"] else ""), "-----"]
        out += [f"  {p['label']:<16} {compact(p['total_tokens']):>8} {'█' * round(30 * p['total_tokens'] / most)}" for p in shown] + [""]
    return "\n".join(out)


# ---------------------------------------------------------------- HTML
_STYLE = "body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#1d2329;background:#fff}h1{font-size:1.6rem}h2{font-size:1.1rem;margin-top:2rem}table{border-collapse:collapse;width:100%}td,th{padding:.25rem .5rem;text-align:right;border-bottom:1px solid #e3e6ea}td:first-child,th:first-child{text-align:left}.cards{display:grid;grid-template-columns:repeat(auto-fit,minmax(11rem,1fr));gap:1rem}.card{border:1px solid #e3e6ea;border-radius:.5rem;padding:.75rem}.card b{display:block;font-size:1.4rem}.bar{height:.5rem;background:#3a6ea5;border-radius:.25rem}.note{color:#5b6570}svg{width:100%;height:auto}@media(prefers-color-scheme:dark){body{background:#14171a;color:#e6e9ec}td,th,.card{border-color:#2b3137}}"
_TONES = ("#3a6ea5", "#4f9d69", "#c9822b", "#a34f6b", "#6b5ca5")


def _table(heads: list[str], rows: list[list[str]]) -> str:
    if not rows:
        return '<p class="note">Nothing to show.</p>'
    head = "".join(f"<th>{escaped(h)}</th>" for h in heads)
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>"


def _trend_svg(points: list[dict]) -> str:
    if not points:
        return '<p class="note">No dated usage.</p>'
    wide, high = 960, 220
    most, step = max(p["total_tokens"] for p in points) or 1, wide / len(points)
    bars = []
    for i, p in enumerate(points):
        h = high * p["total_tokens"] / most
        bars.append(f'<rect x="{i * step:.2f}" y="{high - h:.2f}" width="{max(0.5, step - 1):.2f}" height="{h:.2f}" fill="{_TONES[0]}"><title>{escaped(p["label"])}: {count(p["total_tokens"])} tokens</title></rect>')
    ends = f'<text x="0" y="{high + 18}" font-size="13">{escaped(points[0]["label"])}</text><text x="{wide}" y="{high + 18}" font-size="13" text-anchor="end">{escaped(points[-1]["label"])}</text>'
    return f'<svg viewBox="0 0 {wide} {high + 24}" role="img" aria-label="Tokens over time" preserveAspectRatio="xMidYMid meet"><g>{"".join(bars)}</g><g fill="currentColor">{ends}</g></svg>'


def _mix_svg(t: dict) -> str:
    parts = [(n, t[f"{n}_tokens"]) for n in ("input", "output", "cache_read", "cache_write")]
    whole, x, out = sum(v for _, v in parts) or 1, 0.0, []
    for (name, value), tone in zip(parts, _TONES):
        w = 960 * value / whole
        out.append(f'<rect x="{x:.2f}" y="0" width="{w:.2f}" height="28" fill="{tone}"><title>{name.replace("_", " ")}: {count(value)}</title></rect>')
        x += w
    return f'<svg viewBox="0 0 960 28" role="img" aria-label="Token mix">{"".join(out)}</svg><p class="note">' + " · ".join(f"{n.replace('_', ' ')} {compact(v)} ({percent(v, whole):.1f}%)" for n, v in parts) + "</p>"


def page(report: dict, top: int = 10) -> str:
    """A page that needs nothing else: styles and drawings are in it, labels are escaped."""
    t, c = report["totals"], report["coverage"]
    cards = [("Tokens", compact(t["total_tokens"])), ("Calls", count(t["api_calls"])), ("Sessions", count(t["logical_sessions"])), ("Recorded cost", usd(t["accounted_usd"])), ("Organic tokens", compact(report["organic_totals"]["total_tokens"]))]
    if t["list_estimated_usd"] is not None:
        cards.append(("List estimate", f"≈{usd(t['list_estimated_usd'])}"))
    body = [f"<h1>Usage</h1><p class=\"note\">{escaped(range_text(report['range']))} · {escaped(filter_text(report['filters']))} · as of {instant(report['generated_at'])}</p>"]
    body.append('<div class="cards">' + "".join(f'<div class="card">{escaped(n)}<b>{escaped(v)}</b></div>' for n, v in cards) + "</div>")
    body.append(f"<h2>Trend by {escaped(report['range']['bucket'])}</h2>" + _trend_svg(report["trend"]) + ('<p class="note">Empty buckets are left out.</p>' if report["range"]["sparse"] else ""))
    body.append("<h2>Token mix</h2>" + _mix_svg(t))
    for name, key in SECTIONS:
        rows = [[escaped(cut(r["label"], 80)), count(r["total_tokens"]), f"{percent(r['total_tokens'], t['total_tokens']):.1f}%<div class=\"bar\" style=\"width:{percent(r['total_tokens'], t['total_tokens']):.1f}%\"></div>", count(r["api_calls"]), usd(r["accounted_usd"])] for r in leading(report[key], top)]
        body.append(f"<h2>{escaped(name)}</h2>" + _table(["", "Tokens", "Share", "Calls", "Recorded cost"], rows))
    pairs = [[escaped(r["provider_label"]), escaped(r["model_label"]), count(r["total_tokens"]), count(r["api_calls"])] for r in report["by_provider_model"][:top]]
    body.append("<h2>Provider and model</h2>" + _table(["Provider", "Model", "Tokens", "Calls"], pairs))
    body.append("<h2>Coverage</h2>" + _table(["", "Percent"], [[escaped(title_case(k.removesuffix("_percent").replace("_", " "))), f"{v:.1f}"] for k, v in c.items() if k.endswith("_percent")]))
    own = [[escaped(AGENTS.get(r["agent"], r["agent"])), count(r["transcript_records"]), count(r["usage_records"]), count(r["assistant_without_usage_records"]), count(r["total_tokens"])] for r in report["source_coverage"]]
    body.append("<h2>Sources, whole store</h2>" + _table(["", "Records", "Usage rows", "Answers without usage", "Tokens"], own))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>Usage</title><style>{_STYLE}</style></head><body>{"".join(body)}</body></html>\n'


def write(path: str | Path, document: str) -> None:
    """Beside its place first, then renamed; folders are made."""
    path = Path(path)
    if not path.name:
        raise ValueError("the path must name a file")
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_name(f".{path.name}.{os.getpid()}.{time.time_ns() // 1000}.tmp")
    aside.write_text(document, encoding="utf-8")
    try:
        os.replace(aside, path)
    except OSError:
        aside.unlink(missing_ok=True)
        raise
