"""Checkouts of source repositories on the driver, by the git program (SRC-01..SRC-04, INC-08)."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sparkloom.operators import catalog

Tell = Callable[[str], None]


def git(*args: str, cwd: Path | None = None) -> subprocess.CompletedProcess[str]:
    """A git command; without the program a result that failed."""
    if shutil.which("git") is None:
        return subprocess.CompletedProcess(args, 127, "", "git is not installed")
    return subprocess.run(["git", *args], cwd=cwd, capture_output=True, text=True, check=False)


@dataclass
class Checkout:
    """A repository under a folder; ``only`` limits what is checked out to some paths."""

    path: Path
    url: str
    branch: str
    only: Sequence[str] = field(default_factory=tuple)

    def there(self) -> bool:
        return self.path.exists()

    def head(self) -> str | None:
        """The first 12 digits of the commit that is checked out."""
        found = git("rev-parse", "HEAD", cwd=self.path) if self.there() else None
        return found.stdout.strip()[:12] if found and found.returncode == 0 else None

    def make(self, tell: Tell) -> bool:
        """A shallow clone, sparse if only some paths are wanted."""
        steps = [(("clone", "--depth=1", "--branch", self.branch, *(["--no-checkout"] if self.only else []), self.url, str(self.path)), None)]
        if self.only:
            steps += [(("sparse-checkout", "set", "--no-cone", *self.only), self.path), (("checkout", self.branch), self.path)]
        for args, cwd in steps:
            done = git(*args, cwd=cwd)
            if done.returncode:
                tell(f"{self.path.name}: {args[0]} failed: {done.stderr.strip()}")
                return False
        tell(f"{self.path.name}: cloned")
        return True

    def refresh(self, tell: Tell) -> bool:
        """Forward to the branch, by force if it was rewritten; whether the commit is another now."""
        before = self.head()
        if git("pull", "--ff-only", cwd=self.path).returncode:
            tell(f"{self.path.name}: no fast-forward, resetting")
            git("fetch", "--depth=1", "origin", self.branch, cwd=self.path)
            git("reset", "--hard", "FETCH_HEAD", cwd=self.path)
        changed = self.head() != before
        tell(f"{self.path.name}: {'updated' if changed else 'up to date'}")
        return changed


def checkouts(root: str) -> dict[str, Checkout]:
    """The registry's repositories under a local folder."""
    base = Path(root.removeprefix("file://"))
    return {name: Checkout(base / name, url, branch, tuple(only or ())) for name, url, branch, _, _, only in catalog.REPOS}


def download(root: str, names: Iterable[str] | None = None, tell: Tell = print) -> dict[str, bool]:
    """Make or refresh the named repositories, all without names; an unknown name fails alone."""
    known = checkouts(root)
    done = {}
    for name in known if names is None else names:
        if name not in known:
            tell(f"{name}: unknown repository")
            done[name] = False
            continue
        repo = known[name]
        if repo.there():
            repo.refresh(tell)
            done[name] = True
        else:
            repo.path.parent.mkdir(parents=True, exist_ok=True)
            done[name] = repo.make(tell)
    return done


def refreshed(root: str, tell: Tell = print) -> list[str]:
    """Refresh what is there; the names of repositories whose commit changed."""
    return [name for name, repo in checkouts(root).items() if repo.there() and repo.refresh(tell)]


def status(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, version, exists) of every repository of the registry."""
    rows = [(name, str(repo.path), repo.head(), repo.there()) for name, repo in checkouts(root).items()]
    return spark.createDataFrame(rows, "repo string, path string, version string, exists boolean")


def versions(root: str) -> dict[str, str]:
    """Commits of the repositories that are there, for the manifest."""
    return {name: head for name, repo in checkouts(root).items() if (head := repo.head())}
