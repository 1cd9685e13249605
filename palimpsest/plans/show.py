"""What the command line shows of a repo: logs as text, schemas, indexes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from palimpsest.plans.graph import Commit
from palimpsest.plans.store import Repo


def oneline(repo: Repo, *specs: str, limit: int | None = None) -> list[str]:
    """A line for each commit: its hash, refs and the first line of its message."""
    refs: dict[str, list[str]] = {}
    for kind, label in (("branch", ""), ("tag", "tag: ")):
        for n, h in sorted(repo.refs[kind].items()):
            refs.setdefault(h, []).append(label + n)
    out = []
    for r in repo.log(*specs, limit=limit).collect():
        said = f" ({', '.join(refs[r.commit_hash])})" if r.commit_hash in refs else ""
        out.append(f"{r.commit_hash[:8]}{said} {r.message.splitlines()[0] if r.message else ''}")
    return out


def graph(repo: Repo, head: str = "HEAD") -> list[str]:
    """The commits that a head reaches, children first, with the lines that lead to their parents: a column for each open line."""
    lanes: list[str] = []
    out = []
    for c in repo.graph.topological(repo.resolve(head)):
        if c.hash not in lanes:
            lanes.append(c.hash)
        at = lanes.index(c.hash)
        out.append(" ".join("*" if i == at else "|" for i in range(len(lanes))) + f" {c.hash[:8]} {c.message}")
        lanes = _next_lanes(lanes, at, c)
        if len(c.parents) > 1:
            out.append(" ".join("|" for _ in range(at + 1)) + "\\")
    return out


def _next_lanes(lanes: list[str], at: int, c: Commit) -> list[str]:
    fresh = [p for p in c.parents if p not in lanes]
    return [*lanes[:at], *fresh, *lanes[at + 1 :]]


def stat(repo: Repo, *specs: str) -> Iterator[tuple[str, str, dict]]:
    """(commit, table, counts) of each commit against its first parent; buckets that agree are counted from manifests."""
    for r in repo.log(*specs).collect():
        parents = repo.graph[r.commit_hash].parents
        old, new = repo.graph[parents[0]].tables if parents else {}, repo.graph[r.commit_hash].tables
        for t in sorted({*old, *new}):
            if old.get(t) != new.get(t):
                yield r.commit_hash, t, repo.diff_stat(parents[0] if parents else "EMPTY", r.commit_hash, t).first().asDict()


def diff_json(repo: Repo, a: str, b: str) -> dict:
    """The difference of two versions as a document: for each table what its schema and its rows changed, from and to."""
    tables = []
    shapes = {r.to_table_name or r.from_table_name: r for r in repo.schema_diff(a, b).collect()}
    for r in repo.diff_summary(a, b).collect():
        name = r.to_table_name or r.from_table_name
        rows = []
        if r.data_change and r.diff_type == "modified" and not ({*repo.keys(repo.manifest(a)[name])} ^ {*repo.keys(repo.manifest(b)[name])}):
            for d in repo.diff(a, b, name).toLocalIterator():
                side = lambda s: {c[len(s) :]: v for c, v in d.asDict().items() if c.startswith(s) and v is not None}  # noqa: B023, E731
                rows.append({"from_row": side("from_"), "to_row": side("to_")})
        shape = [shapes[name].from_create_statement, shapes[name].to_create_statement] if name in shapes else []
        tables.append({"name": name, "diff_type": r.diff_type, "schema_diff": shape, "data_diff": rows})
    return {"tables": tables}


def diff_text(repo: Repo, a: str, b: str, table: str) -> list[str]:
    """A table's difference, a line for each row: + added, - removed, < and > a row before and after it was changed."""
    columns = sorted({c[3:] for c in repo.diff(a, b, table).columns if c.startswith("to_")})
    out = ["  | " + " | ".join(columns)]
    for r in repo.diff(a, b, table).toLocalIterator():
        marks = {"added": [("+", "to_")], "removed": [("-", "from_")], "modified": [("<", "from_"), (">", "to_")]}[r.diff_type]
        out += [f"{m} | " + " | ".join("NULL" if getattr(r, s + c, None) is None else str(r[s + c]) for c in columns) for m, s in marks]
    return out


def schema_export(repo: Repo, *tables: str, as_of: str = "WORKING") -> str:
    """CREATE statements of tables (all of them without names), as a script that Session.run_script takes."""
    return "\n".join(repo.create_statement(n, h) for n, h in sorted(repo.manifest(as_of).items()) if not tables or n in tables)


def schema_tags(repo: Repo, as_of: str = "WORKING") -> list[tuple[str, str, int]]:
    """(table, column, tag): the tags given to columns, else a number that follows from the column's name."""
    import zlib

    out = []
    for n, h in sorted(repo.manifest(as_of).items()):
        tags = repo.store.facts(h).get("tags", {})
        out += [(n, f.name, tags.get(f.name, zlib.crc32(f"{n}.{f.name}".encode()) % (1 << 14))) for f in repo.store.schema(h).fields]
    return out


def indexes(repo: Repo, table: str) -> list[tuple[str, Sequence[str], bool]]:
    """(name, columns, unique) of a table's indexes."""
    facts = repo.facts(table)
    found = [(r["name"], r["columns"], True) for r in facts.get("rules", []) if r["kind"] == "unique index"]
    return found + [(x["name"], x["columns"], False) for x in facts.get("indexes", [])]
