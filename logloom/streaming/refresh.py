"""Refreshing an index beside other work: one run at a time, tried again where another writer was first."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

#: How often a refresh is tried, the pause after the first failed try (it grows with each), the pause
#: between refreshes, in seconds.
ATTEMPTS, PAUSE, EVERY = 3, 0.2, 300.0


def contended(error: BaseException) -> bool:
    """Whether another writer was first, so that another try can succeed."""
    return "another writer" in str(error) or "locked" in str(error).lower() or "busy" in str(error).lower()


def tried(work: Callable[[], dict], attempts: int = ATTEMPTS, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> dict:
    for k in range(1, attempts + 1):
        try:
            return work()
        except RuntimeError as e:
            if k == attempts or not contended(e):
                raise
            sleep(pause * k)
    raise AssertionError("unreachable")


class Refresher:
    """A thread that runs ``work`` every so often, and when asked.  Results and errors are taken with ``poll``."""

    def __init__(self, work: Callable[[], dict], every: float = EVERY):
        self.work, self.every, self.busy = work, every, False
        self._results: list[tuple[str, object]] = []
        self._asked, self._stopped, self._lock = threading.Event(), threading.Event(), threading.Lock()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> Refresher:
        self._thread.start()
        return self

    def ask(self) -> bool:
        """Ask for a run now; False where one is under way."""
        if self.busy:
            return False
        self._asked.set()
        return True

    def poll(self) -> tuple[str, object] | None:
        """("done", result) or ("failed", message) of the oldest run that was not taken yet."""
        with self._lock:
            return self._results.pop(0) if self._results else None

    def _loop(self) -> None:
        while not self._stopped.is_set():
            self._asked.wait(self.every)
            self._asked.clear()
            if self._stopped.is_set():
                return
            self.busy = True
            try:
                found: tuple[str, object] = ("done", tried(self.work))
            except Exception as e:  # the thread goes on
                found = ("failed", f"{type(e).__name__}: {e}")
            self.busy = False
            with self._lock:
                self._results.append(found)

    def stop(self) -> None:
        self._stopped.set()
        self._asked.set()
        self._thread.join(10)

    def __enter__(self) -> Refresher:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()


class Latest:
    """Answers by generation: one that belongs to an older question than the last is left out."""

    def __init__(self) -> None:
        self.generation = 0

    def ask(self) -> int:
        self.generation += 1
        return self.generation

    def takes(self, generation: int) -> bool:
        return generation == self.generation
