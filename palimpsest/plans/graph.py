"""The commit graph: ancestry, order, and the ways to name a commit. It has no rows of tables, so it lives on the driver."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Commit:
    hash: str
    parents: tuple[str, ...]
    date: datetime
    author: str = ""
    email: str = ""
    message: str = ""
    height: int = 1
    #: Table name to the content hash of its snapshot.
    tables: dict[str, str] = field(default_factory=dict, compare=False)


class Graph:
    def __init__(self, commits: Iterable[Commit] = ()):
        self.commits: dict[str, Commit] = {}
        for c in commits:
            self.add(c)

    def add(self, commit: Commit) -> Commit:
        height = 1 + max((self.commits[p].height for p in commit.parents), default=0)
        self.commits[commit.hash] = commit = Commit(commit.hash, commit.parents, commit.date, commit.author, commit.email, commit.message, height, commit.tables)
        return commit

    def __getitem__(self, commit: str) -> Commit:
        return self.commits[commit]

    def ancestors(self, *heads: str) -> set[str]:
        """All that the heads reach, themselves included."""
        seen, todo = set(), [*heads]
        while todo:
            if (h := todo.pop()) not in seen:
                seen.add(h)
                todo += self.commits[h].parents
        return seen

    def ordered(self, commits: Iterable[str]) -> list[Commit]:
        """Newest first: by height, then date, then hash."""
        return sorted((self.commits[h] for h in commits), key=lambda c: (-c.height, -c.date.timestamp(), c.hash))

    def log(self, heads: Iterable[str], without: Iterable[str] = (), min_parents: int = 0, tables: Iterable[str] = (), limit: int | None = None) -> list[Commit]:
        """Commits that the heads reach and `without` doesn't. `tables` keeps those that changed one of them against their
        first parent, or for a merge against any; a commit without parents changes nothing in this sense."""
        kept = self.ordered(self.ancestors(*heads) - self.ancestors(*without))
        kept = [c for c in kept if len(c.parents) >= min_parents]
        if tables := [*tables]:
            kept = [c for c in kept if any(self.commits[p].tables.get(t) != c.tables.get(t) for p in c.parents for t in tables)]
        return kept[:limit]

    def merge_base(self, a: str, b: str) -> str | None:
        """The highest common ancestor; of several the one that sorts first by date and hash, as in `ordered`."""
        both = self.ordered(self.ancestors(a) & self.ancestors(b))
        return both[0].hash if both else None

    def has_ancestor(self, head: str, ancestor: str) -> bool:
        return ancestor in self.ancestors(head)

    def ahead_behind(self, base: str, branch: str) -> tuple[int, int]:
        a, b = self.ancestors(base), self.ancestors(branch)
        return len(b - a), len(a - b)

    def as_of(self, head: str, when: datetime) -> str | None:
        """The first commit, from the head in topological order, that isn't younger than `when`."""
        return next((c.hash for c in self.topological(head) if c.date <= when), None)

    def topological(self, head: str) -> Iterable[Commit]:
        """Children before parents; among those ready the highest and youngest first."""
        key = lambda h: (-self.commits[h].height, -self.commits[h].date.timestamp(), h)
        heap, seen = [key(head)], {head}
        while heap:
            c = self.commits[heapq.heappop(heap)[2]]
            yield c
            for p in c.parents:
                if p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, key(p))

    def first_parents(self, head: str) -> list[Commit]:
        out, h = [], head
        while h:
            out.append(c := self.commits[h])
            h = c.parents[0] if c.parents else None
        return out

    def walk(self, start: str, steps: str) -> str:
        """Follow ~n (n first parents up) and ^n (the n-th parent) from a commit."""
        at = start
        for kind, number in re.findall(r"([~^])(\d*)", steps):
            n = int(number) if number else 1
            for _ in range(n if kind == "~" else 1):
                parents = self.commits[at].parents
                i = 0 if kind == "~" else n - 1
                if n and i >= len(parents):
                    raise ValueError(f"{start}{steps}: no such ancestor")
                at = parents[i] if n else at
        return at


def split_range(spec: str) -> tuple[str, str, str] | None:
    """(kind, a, b) of a..b or a...b."""
    m = re.fullmatch(r"(.*?[^.])?(\.\.\.?)([^.].*)?", spec)
    return (m[2], m[1] or "HEAD", m[3] or "HEAD") if m else None


def endpoints(graph: Graph, spec: str, resolve: Callable[[str], str]) -> tuple[str, str]:
    """From and to of a range: a..b is (a, b); a...b is (their merge base, b)."""
    kind, a, b = split_range(spec)
    a, b = resolve(a), resolve(b)
    return (a, b) if kind == ".." else (graph.merge_base(a, b), b)
