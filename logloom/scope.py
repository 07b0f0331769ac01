"""The project around a folder: its repository root, linked worktrees and workspaces, in both spellings of their paths."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class ProjectScope:
    primary: str
    roots: tuple[str, ...]

    def describe(self) -> str:
        more = len(self.roots) - 1
        return shown(self.primary) + (f" (+{more} linked root{'' if more == 1 else 's'})" if more > 0 else "")

    def short_label(self) -> str:
        return Path(self.primary).name or shown(self.primary)

    def matches(self, workspace: str | None) -> bool:
        """A source that records no workspace belongs to every project."""
        own = (workspace or "").rstrip("/")
        return not own or any(within(own, root) for root in self.roots)


def within(path: str, root: str) -> bool:
    root = root.rstrip("/")
    return bool(root) and (path == root or path.startswith(root + "/"))


def shown(path: str) -> str:
    """With the home folder as ``~``."""
    home = str(Path.home())
    return "~" + path[len(home) :] if within(path, home) else path


def _line(path: Path) -> str | None:
    try:
        return path.read_text().strip()
    except OSError:
        return None


def repository(start: Path) -> Path | None:
    """The nearest folder upwards that is a checkout of either version control."""
    start = start if start.is_absolute() else start.resolve()
    return next((d for d in (start, *start.parents) if (d / ".git").exists() or (d / ".jj").is_dir()), None)


def common_git(root: Path) -> Path | None:
    """The git folder that all worktrees share."""
    mark = root / ".git"
    at = mark
    if mark.is_file():
        text = _line(mark)
        if text is None or not text.startswith("gitdir:"):
            return None
        at = root / text.removeprefix("gitdir:").strip()
        at = at.parent.parent if at.parent.name == "worktrees" else at
    elif not mark.is_dir():
        return None
    named = _line(at / "commondir")
    return (at / named).resolve() if named is not None else at


def resolve(cwd: str | Path) -> ProjectScope | None:
    """The scope of a folder, or None outside of any repository."""
    root = repository(Path(cwd))
    if root is None:
        return None
    found = {root}
    git = common_git(root)
    if git is not None:
        if git.name == ".git":
            found.add(git.parent)
        for entry in sorted((git / "worktrees").glob("*/gitdir")):
            linked = Path(_line(entry) or "").parent
            if linked.is_dir() and str(linked) != ".":
                found.add(linked)
    pointer = root / ".jj" / "repo"
    if pointer.is_file():
        main = Path(_line(pointer) or "")
        if main.parent.name == ".jj" and main.parent.parent.is_dir():
            found.add(main.parent.parent)
    spelled = [s for r in (root, *sorted(found)) for s in (str(r).rstrip("/"), str(r.resolve()).rstrip("/")) if s]
    return ProjectScope(str(root), tuple(dict.fromkeys(spelled)))


def current(everything: bool = False) -> ProjectScope | None:
    return None if everything else resolve(Path.cwd())
