"""Browsing hits in a terminal: a state that keys change, its lines, and the loop that reads keys and shows them.

The state asks for hits and conversations through functions, so it knows nothing of Spark."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from .operators.search import SearchQuery
from .report import cut, safe
from .schema import AGENTS, RANKINGS
from .streaming.refresh import Latest, Refresher

#: Hits of a page, and the choices of the time filter in days (None: any; 0: today).
PAGE, TIMES = 50, {"any time": None, "today": 0, "7 days": 7, "30 days": 30, "90 days": 90}
HELP = "/text search  a agent  t time  r ranking  g scope  j k move  o open  b back  R refresh  ? help  q quit"


def since(choice: str, now_ms: int) -> int | None:
    """The start of a time choice; today begins with the local date, read as UTC."""
    days = TIMES[choice]
    if days is None:
        return None
    if days == 0:
        day = datetime.fromtimestamp(now_ms / 1000).date()
        return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)
    return now_ms - days * 86_400_000


@dataclass
class Browser:
    find: Callable[[SearchQuery], dict]
    load: Callable[[int], dict | None]
    clock: Callable[[], int]
    roots: tuple[str, ...] | None = None
    scoped: bool = True
    text: str = ""
    agent: str | None = None
    when: str = "any time"
    ranking: str = "recent"
    hits: list[dict] = field(default_factory=list)
    total: int = 0
    at: int = 0
    detail: dict | None = None
    top: int = 0
    status: str = ""
    help: bool = False
    done: bool = False
    latest: Latest = field(default_factory=Latest)

    def query(self) -> SearchQuery:
        scope = self.roots if self.scoped else None
        return SearchQuery(self.text, self.agent, None, scope, since(self.when, self.clock()), limit=PAGE, ranking=self.ranking)

    def search(self) -> None:
        mine = self.latest.ask()
        try:
            found = self.find(self.query())
        except ValueError as e:
            self.status = f"Search failed: {e}"
            return
        self.answer(mine, found)

    def answer(self, generation: int, found: dict) -> None:
        if self.latest.takes(generation):
            self.hits, self.total, self.at, self.status = found["hits"], found["total_hits"], 0, f"{found['total_hits']} hits"

    @staticmethod
    def _next(value, choices: Iterable):
        own = list(choices)
        return own[(own.index(value) + 1) % len(own)]

    def key(self, key: str) -> None:
        """One key, or ``/`` and a text."""
        if key == "q":
            self.done = True
        elif key == "?":
            self.help = not self.help
        elif self.detail is not None:
            if key == "b":
                self.detail, self.top = None, 0
            elif key in "jk":
                self.top = max(0, self.top + (1 if key == "j" else -1))
        elif key.startswith("/"):
            self.text = key[1:].strip()
            self.search()
        elif key in "atrg":
            if key == "a":
                self.agent = self._next(self.agent, [None, *AGENTS])
            elif key == "t":
                self.when = self._next(self.when, TIMES)
            elif key == "r":
                self.ranking = self._next(self.ranking, RANKINGS)
            else:
                self.scoped = not self.scoped
            self.search()
        elif key in "jk" and self.hits:
            self.at = min(len(self.hits) - 1, max(0, self.at + (1 if key == "j" else -1)))
        elif key == "o" and self.hits:
            self.detail, self.top = self.load(self.hits[self.at]["id"]), 0
            if self.detail is None:
                self.status = "The conversation is gone"

    def refreshed(self, event: tuple[str, object] | None) -> None:
        """What a refresh beside this gave."""
        if event is None:
            return
        if event[0] == "done":
            self.search()
        self.status = "Index refreshed" if event[0] == "done" else f"Refresh failed: {event[1]}"

    def lines(self, width: int = 100, height: int = 30) -> list[str]:
        """What is shown; labels are made safe."""
        scope = "project" if self.scoped and self.roots else "everything"
        bar = f"> {self.text or '(newest)'}   [{AGENTS.get(self.agent, 'all agents')}] [{self.when}] [{self.ranking}] [{scope}]"
        if self.help:
            body = HELP.split("  ")
        elif self.detail is not None:
            d = self.detail
            body = [d.get("title") or "Untitled", f"{AGENTS.get(d['agent'], d['agent'])} · {d['source_path']}", ""]
            for m in d["messages"]:
                body += [f"[{m['role']}]", *(m["content"] or "").split("\n"), ""]
            body = body[self.top :]
        else:
            body = []
            for i, h in enumerate(self.hits):
                body.append(f"{'▸' if i == self.at else ' '} {(h['created_at'] or '')[:10]:<10} {AGENTS.get(h['agent'], h['agent']):<14} {h['title'] or 'Untitled'}")
                if i == self.at:
                    body.append(f"      {h['snippet'] or h['preview'] or ''}")
            first = max(0, self.at + 3 - max(1, height - 3))
            body = body[first:] or ["No hits."]
        shown = [bar, *body[: max(1, height - 3)], self.status or HELP]
        return [cut(safe(line), width) for line in shown]


def loop(state: Browser, keys: Iterable[str], out=sys.stdout, refresher: Refresher | None = None) -> None:
    """Show, take a key, change the state, until done or without keys; a refresh's result is taken between keys."""
    state.search()
    print("\n".join(state.lines()), file=out)
    for key in keys:
        if refresher is not None:
            if key == "R":
                state.status = "Refreshing" if refresher.ask() else "A refresh is under way"
            state.refreshed(refresher.poll())
        state.key(key)
        if state.done:
            return
        print("\n".join(state.lines()), file=out)

