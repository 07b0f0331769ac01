"""The command line: search, index, stats, usage, agents, view; each also as JSON."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from . import report, scope
from .operators import search as S
from .operators.store import Store
from .operators.usage import UsageFilters
from .schema import AGENTS, BUCKETS, RANKINGS, parse_agent
from .sources import connectors, roots
from .streaming.ingest import index, is_fresh
from .streaming.refresh import Refresher

#: An index of this age is fresh; hits of a page; the constant of rank fusion.
MAX_AGE, LIMIT, RRF_K = "15m", 20, 60


# ---------------------------------------------------------------- arguments
def _midnight(day: date) -> int:
    return int(datetime(day.year, day.month, day.day).astimezone().timestamp() * 1000)


def _day(text: str) -> date | None:
    if text == "today":
        return datetime.now().date()
    return date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None


def parse_date(text: str) -> int:
    """Milliseconds of ``today``, ``7d`` (days ago), a date (its local midnight) or an RFC 3339 instant."""
    if re.fullmatch(r"[-+]?\d+d", text):
        days = int(text[:-1])
        if days < 0:
            raise ValueError(f"relative day count must not be negative: {text}")
        try:
            return int((datetime.now().astimezone() - timedelta(days=days)).timestamp() * 1000)
        except OverflowError:
            raise ValueError(f"date is outside of the supported range: {text}") from None
    try:
        day = _day(text)
        if day is not None:
            return _midnight(day)
        at = datetime.fromisoformat(text)
    except ValueError:
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"no date: {text}; use 2024-01-01, 7d, today or an RFC 3339 instant")
    return int(at.timestamp() * 1000)


def parse_until(text: str) -> int:
    """As ``parse_date``; a date includes its whole day."""
    try:
        day = _day(text)
    except ValueError:
        day = None
    return parse_date(text) if day is None else _midnight(day + timedelta(days=1)) - 1


def parse_duration(text: str) -> int:
    """Milliseconds of ``5m``, ``2h30m``, ``90s``, ``1d``."""
    parts = re.findall(r"(\d+)\s*(ms|s|m|h|d|w)", text.strip())
    if not parts or re.sub(r"\d+\s*(ms|s|m|h|d|w)|\s", "", text):
        raise ValueError(f"no duration: {text}")
    unit = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
    return sum(int(n) * unit[u] for n, u in parts)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logloom", description="Search and usage of coding-agent transcripts.")
    p.add_argument("-g", "--all", "--global", dest="everything", action="store_true", help="not only the project around this folder")
    p.add_argument("--no-auto-index", action="store_true")
    p.add_argument("--no-refresh", action="store_true")
    p.add_argument("--no-semantic", action="store_true")
    p.add_argument("--max-age", type=parse_duration, default=parse_duration(MAX_AGE))
    p.add_argument("--data-dir", default=str(Path.home() / ".local" / "share" / "logloom"))
    sub = p.add_subparsers(dest="command")
    q = sub.add_parser("search")
    q.add_argument("query")
    for name in ("agent", "workspace", "since", "until"):
        q.add_argument(f"--{name}")
    q.add_argument("--limit", type=int, default=LIMIT)
    q.add_argument("--offset", type=int, default=0)
    q.add_argument("--ranking", choices=RANKINGS, default="recent")
    q.add_argument("--semantic", action="store_true")
    q.add_argument("--rrf-k", type=int, default=RRF_K)
    q.add_argument("--json", action="store_true")
    q = sub.add_parser("index")
    one = q.add_mutually_exclusive_group()
    one.add_argument("--full", action="store_true")
    one.add_argument("--rebuild", action="store_true")
    q.add_argument("--dry-run", action="store_true")
    q = sub.add_parser("stats")
    q.add_argument("--json", action="store_true")
    q = sub.add_parser("usage")
    for name in ("provider", "model", "variant", "task"):
        q.add_argument(f"--{name}", action="append", default=[])
    q.add_argument("--agent", "--harness", action="append", default=[])
    for name in ("workspace", "since", "until"):
        q.add_argument(f"--{name}")
    q.add_argument("--exclude-synthetic", "--organic", action="store_true")
    q.add_argument("--estimate-list-costs", action="store_true")
    q.add_argument("--bucket", choices=BUCKETS, default="auto")
    q.add_argument("--top", type=int, default=10)
    out = q.add_mutually_exclusive_group()
    out.add_argument("--json", action="store_true")
    out.add_argument("--html")
    q = sub.add_parser("agents")
    q.add_argument("--json", action="store_true")
    q = sub.add_parser("view")
    q.add_argument("id_or_path")
    q.add_argument("--json", action="store_true")
    return p


# ---------------------------------------------------------------- results
def iso(ms: int | None) -> str:
    return "" if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc).isoformat()


def search_output(store: Store, q: S.SearchQuery, now_ms: int, vector: list[float] | None = None) -> dict:
    """query, total_hits, query_time_ms, hits; with a query ``vector``, keyword and vector hits are fused."""
    began = time.monotonic()
    docs, index_ = store.table("search_docs"), store.table("postings")
    sizes = S.sizes_of(docs)
    total = S.count(docs, q, index_, sizes).first()[0]
    page = S.search(docs, q, now_ms, index_, sizes)
    rows = [r.asDict() for r in page.orderBy("rank").collect()]
    vectors = store.table("embeddings").withColumnRenamed("conversation_id", "id")
    if vector is not None and not vectors.isEmpty():
        order = {r["id"]: r["score"] for r in S.hybrid(docs, vectors, vector, q, now_ms, index_, sizes).collect()}
        rows = sorted(({**r, "score": order[r["id"]]} for r in rows if r["id"] in order), key=lambda r: (-r["score"], r["id"]))
    hits = [{k: iso(r[k]) if k == "created_at" else r.get(k) for k in ("id", "agent", "title", "workspace", "source_path", "preview", "created_at", "score", "snippet")} for r in rows]
    return {"query": q.text, "total_hits": total, "query_time_ms": int((time.monotonic() - began) * 1000), "hits": hits}


def stats_output(store: Store, project: scope.ProjectScope | None) -> dict:
    from .operators.store import stats

    rows = [r.asDict() for r in stats(store.table("conversations"), store.table("messages"), None if project is None else project.roots).orderBy("agent").collect()]
    last = store.table("conversations").agg({"indexed_at": "max"}).first()[0]
    return {
        **({"scope": project.describe()} if project is not None else {}),
        "agents": {r["agent"]: {"conversations": r["conversations"], "messages": r["messages"]} for r in rows},
        "total_conversations": sum(r["conversations"] for r in rows), "total_messages": sum(r["messages"] for r in rows), "index_size_bytes": store.size(), "last_indexed_at": last,
    }


def agents_output(home: str | None = None) -> list[dict]:
    return [{"slug": a, "name": name, "detected": roots.detected(a, roots.default_roots(a, home))} for a, name in AGENTS.items()]


def found_roots(home: str | None = None) -> dict[str, list[str]]:
    """The folders to read of each agent that is there."""
    every = {a: roots.scan_roots(a, roots.default_roots(a, home)) for a in AGENTS}
    return {a: own for a, own in every.items() if own}


def run_index(store: Store, home: str | None = None, **options) -> dict:
    """An index run over what is there; the variable LOGLOOM_RECOVER_ORPHANS turns the recovery of lost sessions on."""
    recover = os.environ.get("LOGLOOM_RECOVER_ORPHANS", "").strip().lower() in ("1", "true", "yes", "on")
    unknown = frozenset(a for a in AGENTS if roots.unlisted(a, roots.default_roots(a, home)))
    return index(store, connectors(recover), found_roots(home), unlisted=unknown, **options)


def refresh(store: Store, args, home: str | None = None) -> dict | None:
    """An index run where the index is older than ``--max-age``."""
    if args.no_auto_index or args.no_refresh or is_fresh(store, int(time.time() * 1000), args.max_age):
        return None
    return run_index(store, home)


def run(argv: list[str], spark: SparkSession, out=sys.stdout, home: str | None = None, encode=None, keys=sys.stdin) -> int:
    """One command, or without one browsing by ``keys``, a line each; ``encode`` maps a text to a vector, where a model is at hand."""
    args = parser().parse_args(argv)
    say = lambda text="": print(text, file=out)
    as_json = lambda value: say(json.dumps(value, indent=2, ensure_ascii=False, default=str))
    if args.command == "agents":
        rows = agents_output(home)
        as_json(rows) if args.json else [say(f"{'✓' if r['detected'] else '✗'} {r['name']} - {'detected' if r['detected'] else 'not detected'}") for r in rows]
        return 0
    store, now = Store(spark, args.data_dir), int(time.time() * 1000)
    project = scope.current(args.everything)
    if args.command == "index":
        if args.rebuild and args.dry_run:
            raise SystemExit("--dry-run does not go with --rebuild")
        if args.rebuild:
            say(f"Rebuilt the index of {store.rebuild_index()} conversations")
            return 0
        found = run_index(store, home, full=args.full, dry_run=args.dry_run)
        say(", ".join(f"{k} {v}" for k, v in found.items() if isinstance(v, int)))
        return 0
    if args.command == "view":
        own = store.conversation(args.id_or_path)
        if own is None:
            print(f"Conversation not found: {args.id_or_path}", file=sys.stderr)
            return 1
        if args.json:
            as_json(own)
            return 0
        say(f"Agent: {AGENTS.get(own['agent'], own['agent'])}\nTitle: {report.safe(own.get('title') or '')}\nSource: {report.safe(own['source_path'])}\n\nMessages ({len(own['messages'])}):")
        for m in own["messages"]:
            say(f"\n[{m['role']}]\n" + "\n".join(map(report.safe, m["content"].split("\n"))))
        return 0
    if args.command == "stats":
        value = stats_output(store, project)
        if args.json:
            as_json(value)
        else:
            say(f"Conversations: {value['total_conversations']}\nMessages: {value['total_messages']}\nSize: {value['index_size_bytes']} bytes")
            [say(f"  {AGENTS.get(a, a)}: {n['conversations']} conversations, {n['messages']} messages") for a, n in value["agents"].items()]
        return 0
    if args.command is None:  # browse
        from .browse import Browser, loop

        work = Refresher(lambda: run_index(store, home))
        state = Browser(lambda q: search_output(store, q, int(time.time() * 1000)), store.conversation, lambda: int(time.time() * 1000), None if project is None else project.roots)
        with work:
            loop(state, (line.rstrip("\n") for line in keys), out, None if args.no_refresh else work)
        return 0
    refresh(store, args, home)
    roots_ = None if args.workspace is not None or project is None else project.roots
    if args.command == "search":
        def lenient(parse, text):  # what cannot be read here counts as not given
            try:
                return None if text is None else parse(text)
            except ValueError:
                return None

        q = S.SearchQuery(args.query, lenient(parse_agent, args.agent), args.workspace, roots_, lenient(parse_date, args.since), lenient(parse_until, args.until), args.limit, args.offset, args.ranking, rrf_k=args.rrf_k, filter_scores=True)
        value = search_output(store, q, now, encode(args.query) if encode is not None and args.semantic and not args.no_semantic else None)
        if args.json:
            as_json(value)
        else:
            say(f"Query: {args.query}\nFound {value['total_hits']} results in {value['query_time_ms']}ms\n")
            for i, h in enumerate(value["hits"], 1 + args.offset):
                say(f"{i}. [{h['agent']}] {report.safe(h['title'] or 'Untitled')} - {h['created_at'][:10]}\n   {report.safe(h['source_path'])}\n   {report.safe(report.cut(h['preview'] or '', 100))}\n")
        return 0
    since, until = args.since and parse_date(args.since), args.until and parse_until(args.until)
    f = UsageFilters(tuple(map(parse_agent, args.agent)), tuple(args.provider), tuple(args.model), tuple(args.variant), tuple(args.task), args.workspace, roots_, args.exclude_synthetic, since, until, args.bucket, args.estimate_list_costs)
    value = report.build(store.table("usage_events"), store.table("conversations"), store.table("messages"), f, now)
    if args.json:
        as_json(value)
    elif args.html:
        report.write(args.html, report.page(value, args.top))
        say(f"Wrote usage report to {args.html}")
    else:
        say(report.text(value, args.top))
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("logloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        sys.exit(run(sys.argv[1:], spark))
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(2)


if __name__ == "__main__":
    main()
