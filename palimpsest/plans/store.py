"""A database of versioned tables: commits, refs, working sets, merges, and what can be asked of them.

Under the root folder: tables and manifests (see snapshots.py), and log/<number>.json, one file for each change of the state, which
has what is new (commits, entries of the ref log) and the refs and working sets as they are then; every so often a file has all.
A change is there once its number is taken, which one writer alone can do. A table's hash is that of its content.
"""

from __future__ import annotations

import copy
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import constraints, diff, history, merge, patch, schema
from palimpsest.operators.digest import place
from palimpsest.plans.graph import Commit, Graph, endpoints, split_range
from palimpsest.plans.snapshots import ROWS_PER_BUCKET, Files, Snapshots

WORKING, STAGED, EMPTY, HEAD = "WORKING", "STAGED", "EMPTY", "HEAD"
#: Every so many changes the log's file has the whole state.
WHOLE_EVERY = 32
#: Tries of a transaction that others' changes were merged into.
RETRIES = 5
CONFIG_TABLES = {
    "vc_docs": "doc_name string, doc_text string", "vc_ignore": "pattern string, ignored boolean", "vc_query_catalog": "id string, display_order long, name string, query string, description string",
    "vc_nonlocal_tables": "table_name string, target_ref string, ref_table string, options string", "vc_tests": "test_name string, test_group string, test_query string, assertion_type string, assertion_comparator string, assertion_value string",
    "vc_schemas": "type string, name string, fragment string, extra string, sql_mode string", "vc_procedures": "name string, create_stmt string, created_at timestamp, modified_at timestamp, sql_mode string",
}


class Conflict(Exception):
    """Someone else moved the ref in the meantime, or a merge needs decisions."""


class Broken(ValueError):
    """A row that breaks a constraint of its table."""


def matches(pattern: str, name: str) -> bool:
    """Table-name patterns: * and % stand for anything, ? for one character."""
    return bool(re.fullmatch("".join(".*" if c in "*%" else "." if c == "?" else re.escape(c) for c in pattern), name))


def ignored(name: str, patterns: Iterable[tuple[str, bool]]) -> bool:
    """Whether the most specific pattern that fits says so; of equally specific ones that disagree, ValueError."""
    fit = [(p, i) for p, i in patterns if matches(p, name)]
    best = [(p, i) for p, i in fit if not any(q != p and matches(p, q) and not matches(q, p) for q, _ in fit)]
    if len({i for _, i in best}) > 1:
        raise ValueError(f"patterns disagree about {name}: {', '.join(sorted(p for p, _ in best))}")
    return bool(best and best[0][1])


class Repo:
    """A branch of a versioned database, open for reading and writing.

    Data stays in Parquet and DataFrames; the driver holds names, hashes and the commit graph. Writing is optimistic: a
    save fails with Conflict if the state on disk has moved on since it was read; a transaction merges what others did.
    """

    def __init__(self, spark: SparkSession, root: str, branch: str = "main", author: str = "root <root@localhost>", now: Callable[[], datetime] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.root, self.branch, self.author = spark, root.rstrip("/"), branch, author
        self.now = now or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
        self.files, self.store = Files(spark), Snapshots(spark, self.root, rows_per_bucket)
        #: Whether rows are held against foreign keys, commits may have conflicts, and JSON columns are merged by key.
        self.options = {"foreign_key_checks": True, "force_commit": False, "merge_json": True}
        self._held: dict | None = None
        self._staging = f"{self.root}/staging/{uuid.uuid4().hex}"
        if names := [n for n in self.files.names(f"{self.root}/log") if re.fullmatch(r"\d+\.json", n)]:
            self._load(names)
        else:
            self.graph, self.version = Graph(), 0
            self.refs: dict[str, dict[str, str]] = {"branch": {}, "tag": {}, "stash": {}, "remote": {}}
            self.sets: dict[str, dict] = {}
            self.reflog: list[list[str]] = []
            self.config: dict[str, dict] = {"remotes": {}, "backups": {}, "auto": {}, "activity": {}, "statistics": {}}
            self._logged = (0, 0)
            first = self._commit_of({}, (), "Initialize data repository", self.author, self.now())
            self._move("branch", branch, first.hash)
            self.sets[branch] = {"working": {}, "staged": {}, "merge": None}
            self._save()

    # --- state

    def _load(self, names: Sequence[str] | None = None) -> None:
        names = names or [n for n in self.files.names(f"{self.root}/log") if re.fullmatch(r"\d+\.json", n)]
        states: list[dict] = []
        for n in reversed(names):
            states.insert(0, json.loads(self.files.read(f"{self.root}/log/{n}")))
            if states[0]["whole"]:
                break
        self.graph, self.reflog = Graph(), []
        for s in states:
            for c in s["commits"]:
                self.graph.add(Commit(c["hash"], tuple(c["parents"]), datetime.fromisoformat(c["date"]), c["author"], c["email"], c["message"], tables=c["tables"]))
            self.reflog += s["reflog"]
        self.refs, self.sets, self.config, self.version = (states[-1][k] for k in ("refs", "sets", "config", "version"))
        self._logged = (len(self.graph.commits), len(self.reflog))

    def _save(self) -> None:
        """Take the next number of the log; Conflict if someone else did since the state was read."""
        if self._held is not None:
            return
        version = self.version + 1
        whole = version % WHOLE_EVERY == 1
        done = (0, 0) if whole else self._logged
        fresh = [*self.graph.commits.values()][done[0] :]
        commits = [{"hash": c.hash, "parents": list(c.parents), "date": c.date.isoformat(), "author": c.author, "email": c.email, "message": c.message, "tables": c.tables} for c in fresh]
        state = {"version": version, "whole": whole, "commits": commits, "reflog": self.reflog[done[1] :], "refs": self.refs, "sets": self.sets, "config": self.config}
        if not self.files.write(f"{self.root}/log/{version:020d}.json", json.dumps(state), once=True):
            raise Conflict("the database has changed; open it again")
        self.version, self._logged = version, (len(self.graph.commits), len(self.reflog))

    def begin(self) -> None:
        """Start a transaction: changes are kept back until `end`."""
        if self._held is None:
            self._held = {"start": self._copied(), "points": {}}

    def _copied(self) -> dict:
        return {"refs": copy.deepcopy(self.refs), "sets": copy.deepcopy(self.sets), "config": copy.deepcopy(self.config), "reflog": len(self.reflog), "branch": self.branch, "commits": len(self.graph.commits)}

    def _restored(self, state: dict) -> None:
        self.refs, self.sets, self.config, self.branch = (copy.deepcopy(state[k]) for k in ("refs", "sets", "config", "branch"))
        del self.reflog[state["reflog"] :]
        for h in [*self.graph.commits][state["commits"] :]:
            del self.graph.commits[h]

    def savepoint(self, name: str) -> None:
        if self._held is not None:
            self._held["points"].pop(name, None)
            self._held["points"][name] = self._copied()

    def back_to(self, name: str) -> None:
        if self._held is None or name not in self._held["points"]:
            raise ValueError(f"no savepoint {name}")
        self._restored(self._held["points"][name])

    def rollback(self) -> None:
        if self._held is not None:
            self._restored(self._held["start"])
            self._held = None

    def end(self) -> None:
        """Make a transaction's changes visible. Where others changed the working set meanwhile, both are merged, with the state
        at the transaction's start as the base; rows or tables changed on both sides undo the transaction with Conflict."""
        if self._held is None:
            return
        start, self._held = self._held["start"], None
        for _ in range(RETRIES):
            try:
                return self._save()
            except Conflict:
                mine, base, mine_auto = self._set()["working"], start["sets"].get(self.branch, {}).get("working", {}), self.config["auto"]
                moved = self.refs["branch"].get(self.branch) != start["refs"]["branch"].get(self.branch)
                staged = self._set()["staged"] != start["sets"].get(self.branch, {}).get("staged")
                branch = self.branch
                self._load()
                if moved or branch not in self.sets:
                    raise Conflict("the branch has moved since the transaction began") from None
                if staged:
                    self.sets[branch]["staged"] = dict(mine)
                tables, stuck = self._merged_tables(base, self.sets[branch]["working"], mine)
                if stuck:
                    raise Conflict(f"this transaction conflicts with another one in {', '.join(stuck)}") from None
                self.sets[branch]["working"] = tables
                self.config["auto"] = {t: max(self.config["auto"].get(t, 0), n) for t, n in {**self.config["auto"], **mine_auto}.items()}
        raise Conflict("the database keeps changing")

    def _move(self, kind: str, name: str, commit: str | None) -> None:
        if commit is None:
            self.refs[kind].pop(name, None)
        else:
            self.refs[kind][name] = commit
            self.reflog.append([f"refs/{'heads' if kind == 'branch' else kind + 's'}/{name}", self.now().isoformat(), commit, self.graph[commit].message])

    def _commit_of(self, tables: dict[str, str], parents: Sequence[str], message: str, author: str, date: datetime) -> Commit:
        name, _, email = author.partition(" <")
        text = json.dumps([sorted(tables.items()), list(parents), message, author, date.isoformat()])
        return self.graph.add(Commit(hashlib.sha1(text.encode()).hexdigest()[:32], tuple(parents), date, name, email.rstrip(">"), message, tables=dict(tables)))

    # --- snapshots

    def write_table(self, name: str, df: DataFrame, keys: Sequence[str] = (), documents: Sequence[str] | None = None, facts: dict | None = None) -> str:
        """Store df as the table's working version; returns its content hash. `documents` are text columns of JSON, whose objects
        a merge joins by key; `facts` replaces what the table has beside rows (defaults, rules, indexes, ...)."""
        before = self._set()["working"].get(name)
        known = self.store.facts(before) if before else {}
        keys = list(keys) or [k for k in (self.keys(before) if before else []) if k in df.columns]
        facts = dict(known if facts is None else facts)
        if documents is not None:
            facts["json"] = [*documents]
        return self._keep(name, self.store.write(name, df, keys, facts))

    def _keep(self, name: str, table_hash: str) -> str:
        self._set()["working"][name] = table_hash
        self.config["activity"].setdefault(self.branch, {})["write"] = self.now().isoformat()
        self._save()
        return table_hash

    def snapshot(self, table_hash: str) -> DataFrame:
        return self.store.read(table_hash)

    def keys(self, table_hash: str) -> list[str]:
        return self.store.keys(table_hash)

    def _staged_rows(self, df: DataFrame) -> DataFrame:
        """df as a table written once, for steps that read it several times; a local list of rows is that already."""
        if df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation":
            return df
        path = f"{self._staging}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear_staging(self) -> None:
        self.files.delete(self._staging)

    # --- names of versions

    def head(self) -> str:
        return self.refs["branch"][self.branch]

    def resolve(self, spec: str | datetime) -> str:
        """A commit's hash from HEAD, a branch, a tag, a remote's branch, a hash or its start, any with ~n and ^n, or a time."""
        if isinstance(spec, datetime):
            found = self.graph.as_of(self.head(), spec)
            if found is None:
                raise ValueError(f"nothing as of {spec}")
            return found
        m = re.fullmatch(r"([^~^]+)([~^\d]*)", spec)
        name, steps = (m[1], m[2]) if m else (spec, "")
        if name.upper() == HEAD:
            at = self.head()
        else:
            name = name.removeprefix("refs/heads/").removeprefix("refs/tags/")
            at = next((self.refs[k][name] for k in ("branch", "tag", "remote", "stash") if name in self.refs[k]), None)
        if at is None:
            starts = [h for h in self.graph.commits if h.startswith(name)] if len(name) >= 6 else []
            if len(starts) != 1:
                raise ValueError(f"no such version: {spec}")
            at = starts[0]
        return self.graph.walk(at, steps)

    def manifest(self, spec: str | datetime) -> dict[str, str]:
        """Table names to content hashes of a version; WORKING, STAGED and EMPTY are versions, too. A version of another branch's
        working set is WORKING@<branch>."""
        if spec == EMPTY:
            return {}
        if isinstance(spec, str) and (m := re.fullmatch(rf"({WORKING}|{STAGED})(?:@(.+))?", spec)):
            return self.sets[m[2] or self.branch][m[1].lower()]
        return self.graph[self.resolve(spec)].tables

    def table(self, name: str, as_of: str | datetime = WORKING, schema_as: str | datetime | None = None) -> DataFrame:
        """A table of a version; `schema_as` reads it through the schema that another version has."""
        tables = self.manifest(as_of)
        self.config["activity"].setdefault(self.branch, {})["read"] = self.now().isoformat()
        if name in tables and schema_as is not None:
            return schema.conform(self.snapshot(tables[name]), self.table(name, schema_as).schema)
        if name not in tables:
            for pattern, ref, target in self._nonlocal():
                if matches(pattern, name):
                    return self.table(target or name, ref)
            raise ValueError(f"no table {name} as of {as_of}")
        return self.snapshot(tables[name])

    def _nonlocal(self) -> list[tuple[str, str, str]]:
        h = self.manifest(WORKING).get("vc_nonlocal_tables")
        return [(r["table_name"], r["target_ref"], r["ref_table"]) for r in self.snapshot(h).collect()] if h else []

    def row_count(self, name: str, as_of: str | datetime = WORKING) -> int:
        """From the manifest; no row is read."""
        return self.store.count(self.manifest(as_of)[name])

    def config_table(self, name: str, as_of: str | datetime = WORKING) -> DataFrame:
        h = self.manifest(as_of).get(name)
        return self.snapshot(h) if h else self.spark.createDataFrame([], CONFIG_TABLES[name])

    def register(self, as_of: str | datetime = WORKING, prefix: str = "") -> None:
        """All tables of a version as temporary views."""
        for name, h in self.manifest(as_of).items():
            self.snapshot(h).createOrReplaceTempView(prefix + name)

    # --- changing the working set

    def _set(self) -> dict:
        return self.sets[self.branch]

    def facts(self, name: str) -> dict:
        return self.store.facts(self._set()["working"][name])

    def set_facts(self, name: str, **changes) -> str:
        """Change what a table has beside rows. No piece is written."""
        h = self._set()["working"][name]
        facts = {**self.store.facts(h), **changes}
        return self._keep(name, self.store.write(name, self.snapshot(h), self.keys(h), facts, h, touched=[]))

    def drop_table(self, name: str) -> None:
        for child, h in self._set()["working"].items():
            if child != name and self.options["foreign_key_checks"] and any(r["kind"] == constraints.FOREIGN and r["parent"] == name for r in self.store.facts(h).get("rules", [])):
                raise Broken(f"{child} refers to {name}")
        del self._set()["working"][name]
        self._save()

    def rename_table(self, old: str, new: str) -> None:
        w = self._set()["working"]
        if new in w:
            raise ValueError(f"there is a table {new}")
        w[new] = w.pop(old)
        for child in [*w]:
            rules = self.facts(child).get("rules", [])
            if any(r.get("parent") == old for r in rules):
                self.set_facts(child, rules=[{**r, "parent": new} if r.get("parent") == old else r for r in rules])
        self._save()

    def copy_table(self, old: str, new: str) -> None:
        self._set()["working"][new] = self._set()["working"][old]
        self._save()

    def _rewrite(self, name: str, make: Callable[[DataFrame], DataFrame], touched: Iterable[int]) -> str:
        """Replace the rows of the touched buckets by what `make` makes of them; all other pieces stay as they are."""
        h, touched = self._set()["working"][name], sorted({*touched})
        if not touched:
            return h
        m = self.store.meta(h)
        if len(touched) == m["buckets"] or self.store.whole_again(h) or self.store.count(h) > 4 * self.store.rows_per_bucket * m["buckets"]:
            return self._keep(name, self.store.write(name, make(self.snapshot(h)), m["keys"], m["facts"], h))
        return self._keep(name, self.store.write(name, make(self.store.read(h, touched)), m["keys"], m["facts"], h, touched))

    def buckets_of(self, name: str, rows: DataFrame, names: dict[str, str] | None = None) -> list[int]:
        """The buckets of a table that rows belong to; `names` says which columns of theirs stand for the table's."""
        h = self._set()["working"][name]
        m, kinds = self.store.meta(h), self.store.schema(h)
        if m["buckets"] == 1:
            return [0]
        place_by = m["keys"] or kinds.names
        own = rows.select(*[F.col(f"`{(names or {}).get(c, c)}`").cast(kinds[c].dataType).alias(c) for c in place_by])
        return [r[0] for r in own.select(place(kinds, place_by, m["buckets"])).distinct().collect()]

    def insert(self, name: str, rows: DataFrame, mode: str = "error") -> str:
        """mode: error on an existing key, ignore such rows, or replace. Tables without keys take everything. Columns that rows
        lack get their default; rows are held against the table's rules. Only buckets that get rows are written."""
        h = self._set()["working"][name]
        kinds, keys, facts = self.store.schema(h), self.keys(h), self.store.facts(h)
        rows = self._staged_rows(self._completed(name, rows, kinds, facts))
        singles = [r["columns"] for r in facts.get("rules", []) if r["kind"] == constraints.UNIQUE]
        if mode == "ignore":
            fits = F.lit(True)
            for r in facts.get("rules", []):
                if r["kind"] == constraints.CHECK:
                    fits = fits & F.coalesce(F.expr(r["condition"]), F.lit(True))
            rows = rows.filter(fits)
            for columns in [keys, *singles] if keys else singles:
                rows = rows.dropDuplicates([*columns]) if columns == keys else constraints.first_of(rows, columns)
                rows = rows.join(self._near(name, rows, columns).select(*columns), [*columns], "left_anti").select(*kinds.names)
            rows = self._staged_rows(rows)
        elif mode == "replace":
            if keys:
                rows = diff.last_of(rows, keys)
            for columns in singles:
                self._remove(name, self.table(name).join(rows.select(*columns), [*columns], "left_semi").select(*keys).join(rows.select(*keys), [*keys], "left_anti") if keys else self.table(name).join(rows.select(*columns), [*columns], "left_semi"))
        if mode != "replace":
            for columns in [keys, *singles] if keys else singles:
                twice = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*columns)
                there = self._near(name, rows, columns).join(rows.select(*columns), [*columns], "left_semi").select(*columns)
                if bad := (twice.union(there) if mode == "error" else twice).first():
                    raise Broken(f"duplicate key in {name}: {', '.join(map(str, bad))}")
        self.hold(name, rows)
        put = (lambda now: diff.upsert(now, rows, keys)) if keys and mode == "replace" else (lambda now: now.unionByName(rows))
        return self._rewrite(name, put, self.buckets_of(name, rows))

    def _near(self, name: str, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Rows of the table that may have the values that rows have: of their buckets if the columns are the key."""
        h = self._set()["working"][name]
        return self.store.read(h, self.buckets_of(name, rows)) if [*columns] == self.keys(h) else self.snapshot(h)

    def _completed(self, name: str, rows: DataFrame, kinds: T.StructType, facts: dict) -> DataFrame:
        """rows with all of a table's columns: defaults, generated ones and numbers of its own."""
        auto, generated = facts.get("auto"), facts.get("generated", {})
        out = []
        for f in kinds.fields:
            if f.name in rows.columns and f.name not in generated:
                out.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
            else:
                default = facts.get("defaults", {}).get(f.name)
                if default is None and f.name != auto and f.name in [*facts.get("not_null", []), *self.keys(self._set()["working"][name])] and f.name not in generated:
                    raise Broken(f"{name}.{f.name} has no default")
                out.append((F.expr(default) if default is not None else F.lit(None)).cast(f.dataType).alias(f.name))
        rows = rows.select(*out)
        if auto:
            rows = self._staged_rows(rows.withColumn(auto, F.when(F.col(auto) != 0, F.col(auto))))
            start = self.config["auto"].get(name)
            if start is None:
                start = (self.table(name).agg(F.max(auto)).first()[0] or 0) + 1
            given, missing = rows.agg(F.max(auto), F.count_if(F.col(auto).isNull())).first()
            start = max(start, (given or 0) + 1)
            rows = constraints.numbered_nulls(rows, auto, start) if missing else rows
            self.config["last_insert_id"] = start if missing else None
            self.config["auto"][name] = max(start + missing, (given or 0) + 1)
        for c, e in generated.items():
            rows = rows.withColumn(c, F.expr(e).cast(kinds[c].dataType))
        return rows

    def hold(self, name: str, rows: DataFrame) -> None:
        """Raise Broken if one of the rows, which are to be put into the table, breaks a rule of its own or refers to no row."""
        facts, keys = self.facts(name), self.keys(self._set()["working"][name])
        if needed := [c for c in rows.columns if c in facts.get("not_null", []) or c in keys]:
            missing = rows.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in needed]).first()
            if bad := [c for c in needed if missing[c]]:
                raise Broken(f"{name}.{bad[0]} cannot be null")
        for r in facts.get("rules", []):
            if r["kind"] == constraints.CHECK and (r.get("enforced", True)) and constraints.check(rows, r["condition"]).limit(1).count():
                raise Broken(f"check constraint {r['name']} of {name} is violated")
            if r["kind"] == constraints.FOREIGN and self.options["foreign_key_checks"] and r["parent"] in self._set()["working"]:
                parent = rows if r["parent"] == name else None
                there = self.table(r["parent"]).select(*r["parent_columns"])
                there = there.union(parent.select(*r["parent_columns"])) if parent is not None else there
                if constraints.foreign_key(rows, r["columns"], there, r["parent_columns"]).limit(1).count():
                    raise Broken(f"foreign key {r['name']} of {name} is violated")

    def _referring(self, name: str) -> list[tuple[str, dict]]:
        return [(child, r) for child, h in self._set()["working"].items() for r in self.store.facts(h).get("rules", []) if r["kind"] == constraints.FOREIGN and r["parent"] == name]

    def _follow(self, name: str, gone: DataFrame, come: DataFrame | None = None, pairs: DataFrame | None = None) -> None:
        """What becomes of rows that refer to rows that go, by the rules' actions. `come` has the rows that stand for them, `pairs`
        both side by side, as _o_<column> and _n_<column>."""
        if not self.options["foreign_key_checks"]:
            return
        for child, r in self._referring(name):
            columns = r["parent_columns"]
            values = gone.select(*columns).distinct()
            if come is not None:
                values = values.join(come.select(*columns), [*columns], "left_anti")
            if child != name:
                left = self._staged_rows(values)
            else:
                left = values.cache()
            if left.isEmpty():
                continue
            there = self.table(child)
            hit = there.join(left.select(*[F.col(p).alias(f"_{i}") for i, p in enumerate(columns)]), [F.col(f"`{c}`") == F.col(f"_{i}") for i, c in enumerate(r["columns"])], "left_semi")
            action = r.get("on_delete" if come is None else "on_update", "restrict")
            if hit.isEmpty():
                continue
            if action in ("restrict", "no action"):
                raise Broken(f"rows of {child} refer to {name}")
            hit = self._staged_rows(hit)
            if action == "cascade" and come is None:
                self._remove(child, hit)
            elif action == "cascade" and pairs is not None:
                moved = pairs.select(*[F.col(f"_o_{c}") for c in columns], *[F.col(f"_n_{c}") for c in columns]).distinct()
                both = self._staged_rows(hit.join(moved, [hit[c] == moved[f"_o_{p}"] for c, p in zip(r["columns"], columns, strict=True)]))
                new = {c: F.col(f"_n_{p}").cast(hit.schema[c].dataType).alias(c) for c, p in zip(r["columns"], columns, strict=True)}
                checks, self.options["foreign_key_checks"] = self.options["foreign_key_checks"], False  # the parent's new rows come after
                self.replace_rows(child, both.select(*hit.columns), both.select(*[new.get(c, F.col(f"`{c}`")) for c in hit.columns]))
                self.options["foreign_key_checks"] = checks
            else:
                self.replace_rows(child, hit, hit.withColumns({c: F.lit(None).cast(hit.schema[c].dataType) for c in r["columns"]}))

    def _remove(self, name: str, rows: DataFrame) -> str:
        """Take rows out by key; without keys, as many copies of each as there are in `rows`."""
        h = self._set()["working"][name]
        keys = self.keys(h) or self.store.schema(h).names
        rows = self._staged_rows(rows)
        if rows.isEmpty():
            return h
        full = rows if {*self.store.schema(h).names} <= {*rows.columns} else self.store.read(h, self.buckets_of(name, rows)).join(rows.select(*keys), [*keys], "left_semi")
        self._follow(name, full)
        if not self.keys(h):
            return self._rewrite(name, lambda now: now.exceptAll(rows.select(*now.columns)), self.buckets_of(name, rows))
        return self._rewrite(name, lambda now: now.join(rows.select(*keys).distinct(), [now[k].eqNullSafe(rows[k]) for k in keys], "left_anti"), self.buckets_of(name, rows))

    def replace_rows(self, name: str, old: DataFrame, new: DataFrame, pairs: DataFrame | None = None) -> str:
        """Put `new` rows in the place of `old` ones, which are found by key (without keys, by all columns, copies included)."""
        h = self._set()["working"][name]
        keys = self.keys(h) or self.store.schema(h).names
        old, new = self._staged_rows(old), self._staged_rows(new)
        self.hold(name, new)
        if self.keys(h):
            left = new.join(old, [new[k].eqNullSafe(old[k]) for k in keys], "left_anti")
            if new.groupBy(*keys).count().filter("count > 1").limit(1).count() or self._near(name, left, keys).join(left.select(*keys), [*keys], "left_semi").limit(1).count():
                raise Broken(f"duplicate key in {name}")
        for r in self.facts(name).get("rules", []):
            if r["kind"] == constraints.UNIQUE:
                rest = self.snapshot(h).join(old.select(*keys), [*keys], "left_anti") if self.keys(h) else self.snapshot(h).limit(0)
                there = rest.select(*r["columns"]).join(new.select(*r["columns"]), [*r["columns"]], "left_semi")
                if constraints.unique(new, r["columns"]).limit(1).count() or there.limit(1).count():
                    raise Broken(f"duplicate key {r['name']} in {name}")
        self._follow(name, old, new, pairs)
        touched = {*self.buckets_of(name, old), *self.buckets_of(name, new)}
        if not self.keys(h):
            return self._rewrite(name, lambda now: now.exceptAll(old.select(*now.columns)).unionByName(new), touched)
        gone = old.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
        return self._rewrite(name, lambda now: now.join(gone, [F.col(f"`{k}`").eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)], "left_anti").unionByName(new), touched)

    def apply_rows(self, name: str, keys: DataFrame, rows: DataFrame) -> str:
        """Put rows in the place of those with the given keys, which may or may not be there; the tail of a change feed."""
        own = self.keys(self._set()["working"][name])
        gone = keys.select(*[F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(own)]).distinct()
        touched = {*self.buckets_of(name, keys), *self.buckets_of(name, rows)}
        return self._rewrite(name, lambda now: now.join(gone, [F.col(f"`{k}`").eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(own)], "left_anti").unionByName(rows), touched)

    def update(self, name: str, values: dict[str, str], where: str = "true") -> str:
        """Set columns by SQL expressions over the row, in rows that meet a condition. Reads and writes only buckets with such."""
        now, facts = self.table(name), self.facts(name)
        old = self._staged_rows(now.filter(where))
        kinds = now.schema
        exprs = {c: F.expr(e).cast(kinds[c].dataType) for c, e in values.items()}
        pairs = old.select(*[F.col(f"`{c}`").alias(f"_o_{c}") for c in kinds.names], *[exprs.get(c, F.col(f"`{c}`")).alias(f"_n_{c}") for c in kinds.names])
        new = old.select(*[exprs.get(c, F.col(f"`{c}`")).alias(c) for c in kinds.names])
        for c, e in facts.get("generated", {}).items():
            new = new.withColumn(c, F.expr(e).cast(kinds[c].dataType))
        return self.replace_rows(name, old, new, pairs)

    def delete(self, name: str, where: str = "true") -> str:
        if where == "true":
            h = self._set()["working"][name]
            self._follow(name, self.snapshot(h))
            return self._keep(name, self.store.write(name, self.snapshot(h).limit(0), self.keys(h), self.store.facts(h), h))
        return self._remove(name, self.table(name).filter(where))

    def delete_cascade(self, name: str, where: str, children: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> None:
        """Delete rows and what refers to them: (child table, its columns, this table's columns)."""
        gone = self._staged_rows(self.table(name).filter(where))
        for child, columns, parent_columns in children:
            targets = gone.select(*[F.col(p).alias(f"_{i}") for i, p in enumerate(parent_columns)])
            self._remove(child, self.table(child).join(targets, [F.col(c) == F.col(f"_{i}") for i, c in enumerate(columns)], "left_semi"))
        self._remove(name, gone)

    def alter(self, name: str, add: dict[str, str] | None = None, drop: Sequence[str] = (), cast: dict[str, str] | None = None, rename: dict[str, str] | None = None, keys: Sequence[str] | None = None, facts: dict | None = None, defaults: dict[str, str] | None = None, order: Sequence[str] = ()) -> str:
        """Change columns or keys. New columns hold their default in old rows; rules, defaults and indexes follow renamed columns
        and go with dropped ones. `order` puts the columns into an order."""
        h, renamed = self._set()["working"][name], rename or {}
        df = self.table(name).drop(*drop)
        for c, kind in (add or {}).items():
            df = df.withColumn(c, (F.expr(defaults[c]) if defaults and c in defaults else F.lit(None)).cast(kind))
        for c, kind in (cast or {}).items():
            df = df.withColumn(c, F.col(c).cast(kind))
        df = df.withColumnsRenamed(renamed)
        if order:
            df = df.select(*order)
        now = constraints.renamed_facts(dict(self.store.facts(h)), renamed, drop) if facts is None else facts
        before = [renamed.get(k, k) for k in self.keys(h)]
        new_keys = before if keys is None else [*keys]
        if keys is not None and new_keys and constraints.unique(df, new_keys).limit(1).count():
            raise Broken(f"rows of {name} share the key {', '.join(new_keys)}")
        return self._keep(name, self.store.write(name, df, new_keys, now))

    def add(self, *names: str) -> None:
        """Stage tables (all without names; ignored ones only by name)."""
        s, patterns = self._set(), [(r["pattern"], r["ignored"]) for r in self.config_table("vc_ignore").collect()]
        for name in names or {*s["working"], *s["staged"]}:
            if name in s["working"]:
                if names or name in s["staged"] or not ignored(name, patterns):
                    s["staged"][name] = s["working"][name]
            else:
                s["staged"].pop(name, None)
        self._save()

    def commit(self, message: str, all: bool = False, author: str | None = None, date: datetime | None = None, amend: bool = False, allow_empty: bool = False, skip_empty: bool = False) -> str | None:  # noqa: A002
        if all:
            self.add()
        s, parents = self._set(), [self.head()]
        if (s["merge"] or {}).get("conflicts") and not self.options["force_commit"]:
            raise Conflict(f"unresolved conflicts in {', '.join(s['merge']['conflicts'])}")
        if amend:
            parents = list(self.graph[self.head()].parents)
        if s["merge"]:
            parents.append(s["merge"]["theirs"])
        elif s["staged"] == self.graph[self.head()].tables and not amend and not allow_empty:
            if skip_empty:
                return None
            raise ValueError("nothing to commit")
        made = self._commit_of(s["staged"], parents, message, author or self.author, date or self.now())
        s["merge"] = None
        self._move("branch", self.branch, made.hash)
        self._save()
        if self._held is None:
            self.clear_staging()
        return made.hash

    def reset(self, spec: str = HEAD, hard: bool = False, tables: Sequence[str] = ()) -> None:
        """Unstage (tables, or all), or move the branch; hard takes the working set along."""
        s, to = self._set(), self.resolve(spec)
        if tables:
            for t in tables:
                if t in self.graph[to].tables:
                    s["staged"][t] = self.graph[to].tables[t]
                else:
                    s["staged"].pop(t, None)
        else:
            if to != self.head():
                self._move("branch", self.branch, to)
            s["staged"] = dict(self.graph[to].tables)
            if hard:
                s["working"], s["merge"] = dict(self.graph[to].tables), None
        self._save()

    def rm(self, *names: str, cached: bool = False) -> None:
        for n in names:
            self._set()["staged"].pop(n, None)
            if not cached:
                self._set()["working"].pop(n, None)
        self._save()

    def clean(self, *names: str) -> None:
        """Drop tables that no commit of HEAD and no stage knows."""
        s = self._set()
        for n in [n for n in s["working"] if n not in s["staged"] and n not in self.graph[self.head()].tables and (not names or n in names)]:
            del s["working"][n]
        self._save()

    def create_branch(self, name: str, at: str = HEAD) -> None:
        to = self.resolve(at)
        self._move("branch", name, to)
        self.sets[name] = {"working": dict(self.graph[to].tables), "staged": dict(self.graph[to].tables), "merge": None}
        self._save()

    def delete_branch(self, name: str) -> None:
        if name == self.branch:
            raise ValueError("the branch is checked out")
        self._move("branch", name, None)
        self.sets.pop(name, None)
        self._save()

    def rename_branch(self, old: str, new: str) -> None:
        self.refs["branch"][new], self.sets[new] = self.refs["branch"].pop(old), self.sets.pop(old)
        self.branch = new if self.branch == old else self.branch
        self._save()

    def checkout(self, name: str, new: bool = False, tables: Sequence[str] = ()) -> None:
        if tables:
            for t in tables:
                self._set()["working"][t] = self.manifest(name)[t]
            self._save()
            return
        if new:  # uncommitted changes come along
            self.create_branch(name)
            self.sets[name], self.sets[self.branch] = self.sets[self.branch], self.sets[name]
            self._save()
        if name not in self.refs["branch"]:
            raise ValueError(f"no branch {name}")
        self.branch = name

    def tag(self, name: str, at: str = HEAD, delete: bool = False) -> None:
        self._move("tag", name, None if delete else self.resolve(at))
        self._save()

    def stash(self, action: str = "push", name: str = "stash") -> None:
        """push, pop, apply, drop or clear. A stash is a commit of the working set on top of HEAD."""
        s, entries = self._set(), sorted((n for n in self.refs["stash"] if n.startswith(f"{name}@")), key=lambda n: int(n.rpartition("@")[2]))
        if action == "push":
            made = self._commit_of(s["working"], (self.head(),), f"WIP on {self.branch}", self.author, self.now())
            self._move("stash", f"{name}@{int(entries[-1].rpartition('@')[2]) + 1 if entries else 0}", made.hash)
            s["working"], s["staged"] = dict(self.graph[self.head()].tables), dict(self.graph[self.head()].tables)
        elif action == "clear":
            for n in entries:
                self._move("stash", n, None)
        else:
            if not entries:
                raise ValueError("no stash")
            at = self.refs["stash"][entries[-1]]
            if action in ("pop", "apply"):
                parent = self.graph[at].parents[0]
                s["working"], stuck = self._merged_tables(self.graph[parent].tables, s["working"], self.graph[at].tables)
                if stuck:
                    raise Conflict(f"stash conflicts with {', '.join(stuck)}")
            if action in ("pop", "drop"):
                self._move("stash", entries[-1], None)
        self._save()

    # --- merging

    def _common(self, *hashes: str | None, buckets: Iterable[int] | None = None, of: int = 0) -> list[DataFrame]:
        """Rows of the versions with the columns of the merged schema; an absent one is empty."""
        merged = schema.merge_schemas(*[self.store.schema(h) for h in hashes if h])
        read = lambda h: self.store.read(h, buckets, of) if buckets is not None else self.snapshot(h)
        return [schema.conform(read(h), merged) if h else self.spark.createDataFrame([], merged) for h in hashes]

    def _open_buckets(self, b: str | None, o: str, t: str) -> tuple[list[int] | None, list[int], int]:
        """(buckets that both sides changed, those that only theirs did, of how many): what a merge has to read, and to take over."""
        hashes = [h for h in (b, o, t) if h]
        if not self.store.same_shape(*hashes) or len({json.dumps(self.store.facts(h), sort_keys=True) for h in hashes}) > 1:
            return None, [], 0
        n = min(self.store.meta(h)["buckets"] for h in hashes)
        x, y, z = (self.store.coarse(h, n) for h in (b, o, t))
        theirs = [k for k in {*x, *y, *z} if z.get(k) != x.get(k) and z.get(k) != y.get(k)]
        return sorted(k for k in theirs if y.get(k) != x.get(k)), sorted(k for k in theirs if y.get(k) == x.get(k)), n

    def _merged_table(self, name: str, b: str | None, o: str, t: str, on_conflict: str = "ours") -> tuple[str, str | None, dict]:
        """(hash, artifacts, counts) of a three-way merge: artifacts is a folder of the conflicting rows, if there are any.

        Buckets that one side alone changed are taken by reference where the pieces fit, else their rows. Of those that both
        changed the rows are classified once, kept as a table, and split into merged and conflicting ones.
        """
        if self.keys(o) != self.keys(t):
            raise schema.SchemaConflict(f"{name} has different keys", "KeyChange")
        keys, (both, only, n) = self.keys(o), self._open_buckets(b, o, t)
        facts = schema.merge_facts(*[self.store.facts(h) if h else {} for h in (b, o, t)])
        mine, other = self.store.meta(o), self.store.meta(t)
        fits = both is not None and mine["buckets"] == n == other["buckets"] and mine["table"] == other["table"]
        taken = {k: other["pieces"].get(str(k)) for k in only} if fits else {}
        if both == [] and fits:
            return self.store.write(name, self.snapshot(o), keys, facts, o, touched=[], taken=taken), None, {}
        apart = None if both is None else both if fits else sorted([*both, *only])
        frames = self._common(b, o, t, buckets=apart, of=n)
        if keys:
            documents = [c for c in facts.get("json", []) if c in frames[0].columns] if self.options["merge_json"] else []
            known = self._staged_rows(merge.classified(*frames, keys, documents))
            columns = [c for c in frames[0].columns if c not in keys]
            rows, bad = merge.resolved(known, keys, columns, on_conflict), merge.conflicting(known, keys, columns)
            counts = {r["op"]: r["n"] for r in known.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
        else:
            bag = self._staged_rows(merge.bag_merge(*frames))
            rows = diff.copies(bag.filter("merged_n > 0"), "merged_n").select(*frames[0].columns)
            bad, counts = bag.filter("conflict"), {}
        if apart is None:
            h = self.store.write(name, rows, keys, facts)
        elif mine["buckets"] == n:
            h = self.store.write(name, rows, keys, facts, o, touched=apart, taken=taken)
        else:
            h = self.store.write(name, rows, keys, facts, o, touched=[k for k in range(mine["buckets"]) if k % n in {*apart}])
        folder = None
        if counts.get("divergentModifyConflict") or counts.get("divergentDeleteConflict") or (not keys and not bad.isEmpty()):
            folder = f"{self.root}/conflicts/{uuid.uuid4().hex}"
            bad.withColumn("vc_conflict_id", F.sha1(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).write.parquet(folder)
        return h, folder, counts

    def _merged_tables(self, base: dict, ours: dict, theirs: dict, on_conflict: str = "ours", found: dict | None = None) -> tuple[dict[str, str], list[str]]:
        """Manifest of the merge and tables with conflicts. Tables that one side left alone are taken by their hash. `found`
        gets the folders of conflicting rows, the counts, and schema conflicts by table; without it these raise."""
        out, stuck = dict(ours), []
        for name in sorted({*base, *ours, *theirs}):
            b, o, t = base.get(name), ours.get(name), theirs.get(name)
            if o == t or t == b:
                continue
            if o == b:
                if t is None:
                    out.pop(name)
                else:
                    out[name] = t
                continue
            if o is None or t is None:
                raise Conflict(f"{name} was deleted on one side and changed on the other")
            try:
                out[name], folder, counts = self._merged_table(name, b, o, t, on_conflict)
            except schema.SchemaConflict as e:
                if found is None:
                    raise
                found.setdefault("schema", {})[name] = f"{e.kind}: {e}"
                stuck.append(name)
                continue
            if found is not None:
                found.setdefault("counts", {})[name] = counts
            if folder:
                stuck.append(name)
                if found is not None:
                    found.setdefault("rows", {})[name] = folder
                else:
                    self.files.delete(folder)
        return out, stuck

    def merge(self, other: str, message: str | None = None, no_ff: bool = False, squash: bool = False, ff_only: bool = False, no_commit: bool = False, author: str | None = None) -> dict:
        """Merge a version into the branch; gives hash, fast_forward, conflicts and message. Tables with conflicting rows, with
        schemas that don't merge, or whose merged rows break a rule count as conflicts and are left to be resolved."""
        ours, theirs = self.head(), self.resolve(other)
        s = self._set()
        if s["working"] != self.graph[ours].tables or s["staged"] != self.graph[ours].tables:
            changed = {n for n in {*s["working"], *self.graph[ours].tables} if s["working"].get(n) != self.graph[ours].tables.get(n)}
            if changed & {n for n in {*self.graph[theirs].tables, *self.graph[ours].tables} if self.graph[theirs].tables.get(n) != self.graph[ours].tables.get(n)}:
                raise Conflict("commit or reset the changes of the working set first")
        base = self.graph.merge_base(ours, theirs)
        if base == theirs:
            return {"hash": ours, "fast_forward": False, "conflicts": 0, "message": "Everything up-to-date"}
        if base == ours and not no_ff and not squash:
            self.reset(theirs, hard=True)
            return {"hash": theirs, "fast_forward": True, "conflicts": 0, "message": "merge successful"}
        if ff_only:
            raise Conflict("not a fast forward")
        b, found = self.graph[base].tables if base else {}, {}
        tables, stuck = self._merged_tables(b, self.graph[ours].tables, self.graph[theirs].tables, found=found)
        s["working"] = dict(tables)
        changed = [n for n in tables if tables[n] != self.graph[ours].tables.get(n)]
        broken = sorted({r["table"] for r in self.verify_constraints(tables=changed).collect()}) if changed else []
        kept = sorted({*stuck, *broken})
        s["merge"] = None if squash and not kept else {"base": base, "ours": ours, "theirs": theirs, "conflicts": kept, **found, "broken": broken}
        if kept or no_commit or squash:
            if not kept:
                s["staged"] = dict(tables)
            self._save()
            return {"hash": "", "fast_forward": False, "conflicts": len(kept), "message": "conflicts found" if kept else "merge not committed"}
        s["staged"] = dict(tables)
        return {"hash": self.commit(message or f"Merge {other} into {self.branch}", author=author, allow_empty=True), "fast_forward": False, "conflicts": 0, "message": "merge successful"}

    def abort_merge(self) -> None:
        self.reset(hard=True)

    def _merge_state(self) -> dict:
        m = self._set()["merge"]
        if not m:
            raise ValueError("no merge is going on")
        return m

    def _settled(self, table: str) -> None:
        m = self._merge_state()
        for kind in ("rows", "schema"):
            m.get(kind, {}).pop(table, None)
        m["conflicts"] = [t for t in m["conflicts"] if t != table]
        self._save()

    def resolve_conflicts(self, table: str, side: str) -> None:
        """Take ours or theirs for a table's conflicting rows (for a schema conflict: the side's whole table)."""
        m = self._merge_state()
        if table in m.get("schema", {}):
            self._set()["working"][table] = self.graph[m[side]].tables[table]
        elif table in m.get("rows", {}) and side == "theirs":
            bad, keys = self.spark.read.parquet(m["rows"][table]), self.keys(self._set()["working"][table])
            columns = self.table(table).columns
            if keys:
                there = bad.filter("their_diff_type <> 'removed'").select(*[F.col(f"their_{c}").alias(c) for c in columns])
                old = bad.select(*[F.coalesce(f"our_{k}", f"their_{k}", f"base_{k}").alias(k) for k in keys])
                self._rewrite(table, lambda now: now.join(old, [now[k].eqNullSafe(old[k]) for k in keys], "left_anti").unionByName(there), self.buckets_of(table, old))
            else:
                rows = diff.copies(bad.filter("their_n > 0"), "their_n").select(*columns)
                old = bad.select(*columns)
                self._rewrite(table, lambda now: now.join(old, [now[c].eqNullSafe(old[c]) for c in columns], "left_anti").unionByName(rows), self.buckets_of(table, old))
        self._settled(table)

    def conflict_rows(self, table: str) -> DataFrame:
        """from_root_ish, base_*, our_*, our_diff_type, their_*, their_diff_type, vc_conflict_id of a merge's conflicting rows."""
        m = self._merge_state()
        folder = m.get("rows", {}).get(table)
        if folder is None:
            raise ValueError(f"no conflicting rows in {table}")
        return self.spark.read.parquet(folder).select(F.lit(m["theirs"]).alias("from_root_ish"), "*")

    def forget_conflicts(self, table: str, where: str = "true") -> None:
        """Take conflicts as resolved by what the table holds now; when none is left, the table is."""
        m, folder = self._merge_state(), f"{self.root}/conflicts/{uuid.uuid4().hex}"
        left = self.conflict_rows(table).filter(f"NOT coalesce({where}, false)").drop("from_root_ish")
        left.write.parquet(folder)
        m["rows"][table] = folder
        self._settled(table) if self.spark.read.parquet(folder).isEmpty() else self._save()

    def set_ours(self, table: str, values: dict[str, str], where: str = "true") -> None:
        """Write our side of conflicting rows, by expressions over the columns of conflict_rows, into the table."""
        keys, columns = self.keys(self._set()["working"][table]), self.table(table).columns
        bad = self.conflict_rows(table).filter(where)
        new = bad.select(*[(F.expr(values[f"our_{c}"]) if f"our_{c}" in values else F.coalesce(f"our_{c}", f"their_{c}") if c in keys else F.col(f"our_{c}")).alias(c) for c in columns])
        new = self._staged_rows(new)
        self.hold(table, new)
        self._rewrite(table, lambda now: diff.upsert(now, schema.conform(new, now.schema), keys), self.buckets_of(table, new))

    def preview_merge(self, left: str, right: str) -> list[tuple[str, int, int]]:
        """(table, conflicting rows, schema conflicts) of a merge that isn't made; only buckets that both changed are read."""
        out = []
        for name, b, o, t in self._to_merge(left, right):
            try:
                n = self.preview_conflicts(left, right, name).count()
                schema.merge_facts(*[self.store.facts(h) if h else {} for h in (b, o, t)])
                if n:
                    out.append((name, n, 0))
            except schema.SchemaConflict:
                out.append((name, None, 1))
        return out

    def _to_merge(self, left: str, right: str) -> list[tuple]:
        a, b = self.resolve(left), self.resolve(right)
        base = self.graph.merge_base(a, b)
        bt, ot, tt = (self.graph[x].tables if x else {} for x in (base, a, b))
        return [(n, bt.get(n), ot[n], tt[n]) for n in sorted({*ot} & {*tt}) if ot[n] != tt[n] and bt.get(n) not in (ot[n], tt[n])]

    def preview_conflicts(self, left: str, right: str, table: str) -> DataFrame:
        """The conflicting rows of a table in a merge that isn't made."""
        found = next(((b, o, t) for n, b, o, t in self._to_merge(left, right) if n == table), None)
        if found is None:
            h = self.graph[self.resolve(left)].tables[table]
            return merge.conflicts(*self._common(h, h, h, buckets=[], of=1), self.keys(h))
        if self.keys(found[1]) != self.keys(found[2]):
            raise schema.SchemaConflict(f"{table} has different keys", "KeyChange")
        both, _, n = self._open_buckets(*found)
        frames = self._common(*found, buckets=both, of=n)
        return merge.conflicts(*frames, self.keys(found[1])) if self.keys(found[1]) else merge.bag_merge(*frames).filter("conflict")

    def _apply(self, base: str, theirs: str, message: str, author: str, kind: str) -> dict:
        found: dict = {}
        tables, stuck = self._merged_tables(self.graph[base].tables, self.graph[self.head()].tables, self.graph[theirs].tables, found=found)
        s = self._set()
        s["working"] = dict(tables)
        changed = [n for n in tables if tables[n] != self.graph[self.head()].tables.get(n)]
        broken = sorted({r["table"] for r in self.verify_constraints(tables=changed).collect()}) if changed else []
        if stuck or broken:
            s["merge"] = {"base": base, "ours": self.head(), "theirs": theirs, "conflicts": sorted({*stuck, *broken}), **found, "broken": broken, "kind": kind, "message": message, "author": author}
            self._save()
            return {"hash": "", "data_conflicts": len(found.get("rows", {})), "schema_conflicts": len(found.get("schema", {})), "constraint_violations": len(broken)}
        s["staged"] = dict(tables)
        return {"hash": self.commit(message, author=author, allow_empty=True), "data_conflicts": 0, "schema_conflicts": 0, "constraint_violations": 0}

    def _continue(self, kind: str) -> str:
        m = self._merge_state()
        if m.get("kind") != kind or m["conflicts"]:
            raise Conflict("there are conflicts left" if m["conflicts"] else f"no {kind} is going on")
        self._set()["merge"], self._set()["staged"] = None, dict(self._set()["working"])
        return self.commit(m["message"], author=m["author"], allow_empty=True)

    def picked(self, spec: str) -> dict:
        """Hash and counts of conflicts of a cherry-pick; with conflicts the working set holds the merge, to be resolved."""
        c = self.graph[self.resolve(spec)]
        if len(c.parents) != 1:
            raise ValueError("only commits of one parent can be picked")
        return self._apply(c.parents[0], c.hash, c.message, f"{c.author} <{c.email}>", "cherry-pick")

    def reverted(self, spec: str) -> dict:
        c = self.graph[self.resolve(spec)]
        if len(c.parents) != 1:
            raise ValueError("only commits of one parent can be reverted")
        return self._apply(c.hash, c.parents[0], f'Revert "{c.message}"', self.author, "revert")

    def cherry_pick(self, spec: str) -> str:
        return self._or_conflict(self.picked(spec))

    def revert(self, spec: str) -> str:
        return self._or_conflict(self.reverted(spec))

    def _or_conflict(self, made: dict) -> str:
        if not made["hash"]:
            stuck = self._merge_state()["conflicts"]
            self.reset(hard=True)
            raise Conflict(f"conflicts in {', '.join(stuck)}")
        return made["hash"]

    def rebase_plan(self, onto: str) -> list[list]:
        """Start an interactive rebase: (order, action, commit, message) of the branch's own commits, oldest first, without merges.
        The plan is the table vc_rebase until it is carried out."""
        to = self.resolve(onto)
        own = [c for c in self.graph.log([self.head()], [to]) if len(c.parents) == 1]
        plan = [[i + 1, "pick", c.hash, c.message] for i, c in enumerate(reversed(own))]
        if not plan:
            raise ValueError("nothing to rebase")
        self._set()["rebase"] = {"onto": to, "plan": plan, "from": self.head()}
        self._save()
        return plan

    def continue_rebase(self) -> str:
        """Carry out the plan. `edit` stops after its commit, until this is called again."""
        r = self._set().get("rebase")
        if not r:
            raise ValueError("no rebase is going on")
        self._set()["rebase"] = None
        plan = sorted(r["plan"])
        if not r.get("begun"):
            if plan and plan[0][1] in ("squash", "fixup"):
                self._set()["rebase"] = r
                raise ValueError("the first commit can't be squashed")
            self.reset(r["onto"], hard=True)
        while plan:
            _, action, spec, message = plan.pop(0)
            self._step(action, spec, message)
            if action == "edit":
                self._set()["rebase"] = {**r, "plan": plan, "begun": True}
                break
        self._save()
        return self.head()

    def abort_rebase(self) -> None:
        r = self._set().pop("rebase", None)
        if r:
            self.reset(r["from"], hard=True)

    def _step(self, action: str, spec: str, message: str | None = None) -> None:
        action, _, text = action.partition(":")
        if action == "drop":
            return
        c = self.graph[self.resolve(spec)]
        before = self.graph[self.head()].message
        self.cherry_pick(c.hash)
        if action in ("squash", "fixup"):
            last = self.graph[self.head()]
            made = self._commit_of(last.tables, self.graph[last.parents[0]].parents, before if action == "fixup" else f"{before}\n\n{c.message}", self.author, self.now())
            self._move("branch", self.branch, made.hash)
        elif action == "reword":
            self.commit(text or message or c.message, amend=True)

    def rebase(self, onto: str, plan: Sequence[tuple[str, str]] | None = None) -> str:
        """Put the branch's own commits on another version. plan: (pick | drop | squash | fixup | reword:<message>, commit), oldest
        first; merges are left out of the one made here."""
        to = self.resolve(onto)
        own = [c for c in self.graph.log([self.head()], [to]) if len(c.parents) == 1]
        plan = plan or [("pick", c.hash) for c in reversed(own)]
        self.reset(to, hard=True)
        for action, spec in plan:
            self._step(action, spec)
        self._save()
        return self.head()

    def squash_history(self, since: str, message: str) -> str:
        """Make one commit of all that came after `since` on the line of first parents."""
        base = self.resolve(since)
        if base not in {c.hash for c in self.graph.first_parents(self.head())}:
            raise ValueError("not on the line of first parents")
        made = self._commit_of(self.graph[self.head()].tables, (base,), message, self.author, self.now())
        self._move("branch", self.branch, made.hash)
        self._save()
        return made.hash

    def filter_branch(self, name: str, change: Callable[[DataFrame], DataFrame]) -> str:
        """Rewrite the line of first parents with a query applied to a table at every commit."""
        done: dict[str, str] = {}
        parent: tuple[str, ...] = ()
        for c in reversed(self.graph.first_parents(self.head())):
            tables = dict(c.tables)
            if name in tables:
                h = tables[name]
                if h not in done:
                    done[h] = self.store.write(name, change(self.snapshot(h)), self.keys(h), self.store.facts(h))
                tables[name] = done[h]
            parent = (self._commit_of(tables, parent, c.message, f"{c.author} <{c.email}>", c.date).hash,)
        self._move("branch", self.branch, parent[0])
        self.reset(hard=True)
        return parent[0]

    # --- questions

    def _pair(self, a: str, b: str | None) -> tuple[dict[str, str], dict[str, str]]:
        if b is None:
            if not split_range(a):
                raise ValueError("two versions, or a range")
            a, b = endpoints(self.graph, a, self.resolve)
        return self.manifest(a), self.manifest(b)

    def diff(self, a: str, b: str | None, table: str, renamed: dict[str, str] | None = None, merge_base: bool = False, where: str | None = None, kinds: Sequence[str] = (), limit: int | None = None, reverse: bool = False, **options) -> DataFrame:
        """Row diff of a table between versions (or over a range a..b, a...b); only buckets whose digests differ are read.

        merge_base compares with the common ancestor instead of a; where is a condition over the diff's columns, kinds keeps some
        diff types, limit is a number of rows, reverse swaps the versions.
        """
        if merge_base:
            a = self.graph.merge_base(self.resolve(a), self.resolve(b or HEAD))
        old, new = (m.get(table) for m in self._pair(a, b))
        if old is None and new is None:
            raise ValueError(f"no table {table} in either version")
        old, new = (new, old) if reverse else (old, new)
        if old and new and self.keys(old) != self.keys(new):
            raise ValueError(f"the keys of {table} differ")
        out = diff.row_diff(*self.store.both(old, new), self.keys(new or old), renamed, **options)
        out = out.filter(where) if where else out
        out = out.filter(F.col("diff_type").isin([*kinds])) if kinds else out
        return out.limit(limit) if limit is not None else out

    def diff_stat(self, a: str, b: str | None = None, table: str | None = None) -> DataFrame:
        """Counts of rows and cells for each table that differs. Buckets that agree are counted from the manifests."""
        old, new = self._pair(a, b)
        out = None
        for name in [table] if table else sorted({*old, *new}):
            o, n = old.get(name), new.get(name)
            if o == n:
                continue
            keys, frames = self.keys(n or o), self.store.both(o, n)
            same = self.store.equal_rows(o, n) if o and n else 0
            one = diff.diff_stat(*frames, keys, name, same) if keys else diff.bag_stat(*frames).withColumn("table_name", F.lit(name))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise ValueError("no table differs")
        return out

    def _same_rows(self, a: str, b: str) -> bool:
        x, y = self.store.coarse(a, 1), self.store.coarse(b, 1)
        return x == y and self.store.meta(a)["schema"] == self.store.meta(b)["schema"]

    def diff_summary(self, a: str, b: str | None = None) -> DataFrame:
        """(from_table_name, to_table_name, diff_type, data_change, schema_change): from the manifests alone, no table is read.
        A table that went and one that came are one renamed if they share a column and their key."""
        old, new = self._pair(a, b)
        rows = []
        gone, came = {n for n in old if n not in new}, {n for n in new if n not in old}
        for n in sorted(gone):
            twin = next((m for m in sorted(came) if {*self.store.schema(old[n]).names} & {*self.store.schema(new[m]).names} and self.keys(old[n]) == self.keys(new[m])), None)
            if twin:
                came.discard(twin)
                rows.append((n, twin, "renamed", not self._same_rows(old[n], new[twin]), True))
            else:
                rows.append((n, "", "dropped", bool(self.store.count(old[n])), True))
        rows += [("", n, "added", bool(self.store.count(new[n])), True) for n in came]
        for n in {*old} & {*new}:
            if old[n] != new[n]:
                rows.append((n, n, "modified", not self._same_rows(old[n], new[n]), self._shape(old[n]) != self._shape(new[n])))
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "from_table_name string, to_table_name string, diff_type string, data_change boolean, schema_change boolean")

    def _shape(self, h: str) -> tuple:
        m = self.store.meta(h)
        return m["schema"], m["keys"], m["facts"]

    def create_statement(self, name: str, h: str) -> str:
        return schema.create_statement(name, self.store.schema(h), self.keys(h), self.store.facts(h))

    def schema_diff(self, a: str, b: str | None = None) -> DataFrame:
        old, new = self._pair(a, b)

        def ddl(name: str, h: str | None) -> str:
            return self.create_statement(name, h) if h else ""

        rows = [(n if n in old else "", n if n in new else "", ddl(n, old.get(n)), ddl(n, new.get(n))) for n in sorted({*old, *new})]
        return self.spark.createDataFrame([r for r in rows if r[2] != r[3]], "from_table_name string, to_table_name string, from_create_statement string, to_create_statement string")

    def patch(self, a: str, b: str | None = None, table: str | None = None) -> DataFrame:
        """Statements that turn one version into the other; of data only buckets that differ are read."""
        old, new = self._pair(a, b)
        out = None
        for name in [table] if table else sorted({*old, *new}):
            o, n = old.get(name), new.get(name)
            if o != n:
                before, after = self.store.both(o, n) if o and n else (self.snapshot(o) if o else None, self.snapshot(n) if n else None)
                one = patch.table_patch(name, before, after, self.keys(n or o), self.store.facts(n) if n else {}, self.store.facts(o) if o else {})
                out = one if out is None else out.union(one)
        return out if out is not None else self.spark.createDataFrame([], "table_name string, diff_type string, statement string, phase int")

    def _line(self, table: str, with_working: bool = False) -> list[tuple[str, str, object, str | None]]:
        """(commit, author, date, hash of the table) along the line of first parents, newest first."""
        line = [(c.hash, c.author, c.date, c.tables.get(table)) for c in self.graph.first_parents(self.head())]
        if with_working and (h := self._set()["working"].get(table)) != line[0][3]:
            line.insert(0, (WORKING, None, None, h))
        return line

    def history(self, table: str, commits: Sequence[str] | None = None) -> DataFrame:
        """The table's rows at every commit that HEAD reaches. A snapshot that several commits share is read once."""
        wanted = [self.resolve(c) for c in commits] if commits else None
        every = [(c.hash, c.author, c.date, c.tables.get(table)) for c in self.graph.topological(self.head()) if wanted is None or c.hash in wanted]
        return history.shared_history([v for v in every if v[3]], {h: self.snapshot(h) for _, _, _, h in every if h})

    def _chain(self, table: str, with_working: bool = False) -> list[history.Version]:
        """Versions of the table along the line of first parents, oldest first, those that changed it; of two neighbours
        with comparable buckets only rows of buckets that differ from one of them matter, which `changes` reads."""
        line = [v for v in reversed(self._line(table, with_working))]
        return [v for i, v in enumerate(line) if (i == 0 and v[3]) or (i and line[i - 1][3] != v[3])]

    def _changed_rows(self, chain: Sequence[tuple]) -> tuple[list[history.Version], DataFrame | None]:
        """The chain's snapshots without the buckets that no version of the chain changed, and these, if there are any."""
        hashes = [v[3] for v in chain if v[3]]
        if len(hashes) > 1 and len(hashes) == len(chain) and self.store.same_shape(*hashes):
            n = min(self.store.meta(h)["buckets"] for h in hashes)
            parts = [self.store.coarse(h, n) for h in hashes]
            open_ = sorted(k for k in {k for p in parts for k in p} if len({p.get(k) for p in parts}) > 1)
            closed = sorted({k for k in parts[0]} - {*open_})
            return [(c, a, d, self.store.read(h, open_, n)) for c, a, d, h in chain], self.store.read(hashes[0], closed, n) if closed else None
        return [(c, a, d, self.snapshot(h) if h else None) for c, a, d, h in chain], None

    def blame(self, table: str) -> DataFrame:
        """For each row of HEAD the commit that added it or changed it last: one shuffle for the whole chain."""
        h = self.graph[self.head()].tables.get(table)
        if not h:
            raise ValueError(f"no table {table}")
        if not self.keys(h):
            raise ValueError("blame needs a key")
        chain = [v for v in self._chain(table) if v[3] is not None]
        versions = [(c, a, d, self.snapshot(x)) for c, a, d, x in chain]
        return history.blame(versions, self.keys(h), [self.graph[v[0]].message for v in chain], [self.graph[v[0]].email for v in chain])

    def diff_table(self, table: str, to_commits: Sequence[str] | None = None) -> DataFrame:
        """Differences of the table between each commit and the one before on the line of first parents, and of the working set
        against HEAD, with commit columns: one shuffle of the rows that changed at all."""
        h = self._set()["working"].get(table) or self.graph[self.head()].tables.get(table)
        if not h:
            raise ValueError(f"no table {table}")
        chain, parents = self._chain(table, with_working=True), self._parents_on(self._line(table, True))
        versions, never = self._changed_rows(chain)
        out = history.chain_diffs(versions, self.keys(h), parents, self.store.schema(h))
        if never is not None:  # rows that nothing changed after they came
            out = out.unionByName(history.chain_diffs([(*versions[0][:3], never)], self.keys(h), parents, self.store.schema(h)))
        return out.filter(F.col("to_commit").isin([*to_commits])) if to_commits is not None else out

    def _parents_on(self, line: Sequence[tuple]) -> dict[str, tuple]:
        return {v[0]: (line[i + 1][0], line[i + 1][2]) for i, v in enumerate(line[:-1])}

    def commit_diff(self, table: str, from_commit: str, to_commit: str) -> DataFrame:
        """Differences of the table between any two commits, with commit columns."""
        ends = [WORKING if x == WORKING else self.resolve(x) for x in (from_commit, to_commit)]
        dates = [None if x == WORKING else self.graph[x].date for x in ends]
        rows = self.diff(*ends, table)
        return rows.withColumns({"to_commit": F.lit(ends[1]), "to_commit_date": F.lit(dates[1]).cast("timestamp"), "from_commit": F.lit(ends[0]), "from_commit_date": F.lit(dates[0]).cast("timestamp")})

    def column_diffs(self) -> DataFrame:
        """(commit_hash, table_name, column_name, committer, email, date, message, diff_type): for each commit the columns that it
        added, dropped or changed values of. Only buckets that differ are read, and of a table that came or went none."""
        out, line = None, self.graph.first_parents(self.head())
        fixed = []
        for c, p in zip(line, [*line[1:], None], strict=True):
            before = p.tables if p else {}
            for name in sorted({*c.tables, *before}):
                old, new = before.get(name), c.tables.get(name)
                if old == new:
                    continue
                facts = (c.hash, name, c.author, c.email, c.date, c.message)
                if old is None or new is None:
                    fixed += [(*facts, x, "added" if new else "removed") for x in self.store.schema(new or old).names]
                    continue
                one = diff.column_diff(*self.store.both(old, new), self.keys(new)).select(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(facts, ("commit_hash", "table_name", "committer", "email", "date", "message"), ("string", "string", "string", "string", "timestamp", "string"), strict=True)], "column_name", "diff_type")
                out = one if out is None else out.unionByName(one)
        rest = self.spark.createDataFrame(fixed, "commit_hash string, table_name string, committer string, email string, date timestamp, message string, column_name string, diff_type string")
        return rest if out is None else rest.unionByName(out)

    def workspace(self, table: str) -> DataFrame:
        """(id, staged, diff_type, to_*, from_*) of what is staged against HEAD and unstaged against the stage."""
        a = self.diff(HEAD, STAGED, table).withColumn("staged", F.lit(True)) if any(table in self.manifest(v) for v in (HEAD, STAGED)) else None
        b = self.diff(STAGED, WORKING, table).withColumn("staged", F.lit(False))
        both = b if a is None else a.unionByName(b, allowMissingColumns=True)
        own = [c for c in both.columns if c not in ("staged", "diff_type")]
        return both.select(F.sha1(F.to_json(F.struct(*both.columns), {"ignoreNullFields": "false"})).alias("id"), "staged", "diff_type", *own)

    def stage_rows(self, table: str, where: str, staged: bool = True) -> None:
        """Stage (or unstage) single changes, those of the workspace that meet a condition."""
        keys, h = self.keys(self._set()["working"][table]), self._set()["staged"].get(table)
        changes = self._staged_rows(self.workspace(table).filter(F.col("staged") != F.lit(staged)).filter(where))
        columns, side, other = self.table(table).columns, *(("to", "from") if staged else ("from", "to"))
        here = self.snapshot(h) if h else self.table(table).limit(0)
        old = changes.select(*[F.coalesce(f"to_{k}", f"from_{k}").alias(k) for k in keys])
        new = changes.filter(F.col("diff_type") != ("removed" if staged else "added")).select(*[F.col(f"{side}_{c}").alias(c) for c in columns])
        rows = here.join(old, [here[k].eqNullSafe(old[k]) for k in keys], "left_anti").unionByName(new)
        self._set()["staged"][table] = self.store.write(table, rows, keys, self.facts(table), h)
        self._save()

    def discard_rows(self, table: str, where: str) -> None:
        """Undo single unstaged changes in the working set."""
        keys = self.keys(self._set()["working"][table])
        changes = self._staged_rows(self.workspace(table).filter("NOT staged").filter(where))
        columns = self.table(table).columns
        old = changes.select(*[F.coalesce(f"to_{k}", f"from_{k}").alias(k) for k in keys])
        new = changes.filter("diff_type <> 'added'").select(*[F.col(f"from_{c}").alias(c) for c in columns])
        self._rewrite(table, lambda now: now.join(old, [now[k].eqNullSafe(old[k]) for k in keys], "left_anti").unionByName(new), self.buckets_of(table, old))

    def unscoped_diff(self) -> DataFrame:
        """(commit_hash, table_name, committer, email, date, message, data_change, schema_change) of each commit against its
        first parent, and of STAGED and WORKING, from manifests alone."""
        rows = []
        for c in self.graph.topological(self.head()):
            parent = self.graph[c.parents[0]].tables if c.parents else {}
            for n in sorted({*c.tables, *parent}):
                o, t = parent.get(n), c.tables.get(n)
                if o != t:
                    rows.append((c.hash, n, c.author, c.email, c.date, c.message, *self._kinds(o, t)))
        s = self._set()
        for label, before, after in ((STAGED, self.graph[self.head()].tables, s["staged"]), (WORKING, s["staged"], s["working"])):
            rows += [(label, n, None, None, None, None, *self._kinds(before.get(n), after.get(n))) for n in sorted({*before, *after}) if before.get(n) != after.get(n)]
        return self.spark.createDataFrame(rows, "commit_hash string, table_name string, committer string, email string, date timestamp, message string, data_change boolean, schema_change boolean")

    def _kinds(self, o: str | None, t: str | None) -> tuple[bool, bool]:
        if not (o and t):
            return bool(self.store.count(o or t)), True
        return not self._same_rows(o, t), self._shape(o) != self._shape(t)

    LOG = "commit_hash string, committer string, email string, date timestamp, message string, commit_order long"

    def log(self, *specs: str, without: Sequence[str] = (), min_parents: int = 0, tables: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        heads, out = [], [self.resolve(w) for w in without]
        for s in specs or (HEAD,):
            if s.startswith("^"):
                out.append(self.resolve(s[1:]))
            elif r := split_range(s):
                a, b = self.resolve(r[1]), self.resolve(r[2])
                heads += [b] if r[0] == ".." else [a, b]
                out += [a] if r[0] == ".." else [x for x in [self.graph.merge_base(a, b)] if x]
            else:
                heads.append(self.resolve(s))
        found = self.graph.log(heads, out, min_parents, tables, limit)
        return self.spark.createDataFrame([(c.hash, c.author, c.email, c.date, c.message, c.height) for c in found], self.LOG)

    def commits(self) -> DataFrame:
        return self.spark.createDataFrame([(c.hash, c.author, c.email, c.date, c.message, c.height) for c in self.graph.ordered(self.graph.ancestors(*self.refs["branch"].values()))], self.LOG)

    def commit_ancestors(self) -> DataFrame:
        rows = [(c.hash, p, i) for c in self.graph.commits.values() for i, p in enumerate(c.parents or (None,))]
        return self.spark.createDataFrame(rows, "commit_hash string, parent_hash string, parent_index int")

    def branches(self) -> DataFrame:
        rows = [(n, h, self.graph[h].author, self.graph[h].email, self.graph[h].date, self.graph[h].message, self.sets[n]["working"] != self.graph[h].tables or self.sets[n]["staged"] != self.graph[h].tables) for n, h in sorted(self.refs["branch"].items())]
        return self.spark.createDataFrame(rows, "name string, hash string, latest_committer string, latest_committer_email string, latest_commit_date timestamp, latest_commit_message string, dirty boolean")

    def tags(self) -> DataFrame:
        return self.spark.createDataFrame([(n, h, self.graph[h].author, self.graph[h].date, self.graph[h].message) for n, h in sorted(self.refs["tag"].items())], "tag_name string, tag_hash string, tagger string, date timestamp, message string")

    def stashes(self) -> DataFrame:
        return self.spark.createDataFrame([(n, h, self.graph[h].message) for n, h in sorted(self.refs["stash"].items())], "name string, hash string, commit_message string")

    def ref_log(self, ref: str | None = None) -> DataFrame:
        """(ref, ref_timestamp, commit_hash, commit_message), newest first, without repeats of one ref in a row."""
        rows, last = [], {}
        for r, when, commit, message in self.reflog:
            if (ref is None or r.endswith(f"/{ref}") or r == ref) and last.get(r) != commit:
                rows.append((r, datetime.fromisoformat(when), commit, message))
                last[r] = commit
        return self.spark.createDataFrame(rows[::-1], "ref string, ref_timestamp timestamp, commit_hash string, commit_message string")

    def remote_branches(self) -> DataFrame:
        rows = [(f"remotes/{n}", h, self.graph[h].author, self.graph[h].email, self.graph[h].date, self.graph[h].message) for n, h in sorted(self.refs["remote"].items())]
        return self.spark.createDataFrame(rows, "name string, hash string, latest_committer string, latest_committer_email string, latest_commit_date timestamp, latest_commit_message string")

    def branch_activity(self) -> DataFrame:
        when = lambda t: datetime.fromisoformat(t) if t else None
        rows = [(n, *(when(self.config["activity"].get(n, {}).get(k)) for k in ("read", "write"))) for n in sorted(self.refs["branch"])]
        return self.spark.createDataFrame(rows, "branch string, last_read timestamp, last_write timestamp")

    def _status(self) -> list[tuple[str, bool, str]]:
        s, rows = self._set(), []
        for staged, old, new in ((True, self.graph[self.head()].tables, s["staged"]), (False, s["staged"], s["working"])):
            rows += [(n, staged, "new table" if n not in old else "deleted" if n not in new else "modified") for n in sorted({*old, *new}) if old.get(n) != new.get(n)]
        m = s["merge"] or {}
        rows += [(t, False, "schema conflict" if t in m.get("schema", {}) else "conflict") for t in m.get("conflicts", []) if t not in m.get("broken", []) or t in m.get("rows", {})]
        return rows + [(t, False, "constraint violation") for t in m.get("broken", []) if t in m["conflicts"]]

    def status(self) -> DataFrame:
        return self.spark.createDataFrame(self._status(), "table_name string, staged boolean, status string")

    def status_ignored(self) -> DataFrame:
        """status with whether a pattern of vc_ignore takes the table out of `add`."""
        patterns = [(r["pattern"], r["ignored"]) for r in self.config_table("vc_ignore").collect()]
        return self.spark.createDataFrame([(*r, r[2] == "new table" and not r[1] and ignored(r[0], patterns)) for r in self._status()], "table_name string, staged boolean, status string, ignored boolean")

    def rebase_table(self) -> DataFrame:
        plan = (self._set().get("rebase") or {}).get("plan", [])
        return self.spark.createDataFrame([(float(o), *r) for o, *r in plan], "rebase_order double, action string, commit_hash string, commit_message string")

    def merge_status(self) -> DataFrame:
        m = self._set()["merge"]
        return self.spark.createDataFrame([(bool(m), m["theirs"] if m else None, ", ".join(m["conflicts"]) if m else None)], "is_merging boolean, source_commit string, unmerged_tables string")

    def branch_status(self, base: str, *branches: str) -> DataFrame:
        rows = [(b, *self.graph.ahead_behind(self.resolve(base), self.resolve(b))) for b in branches]
        return self.spark.createDataFrame(rows, "branch string, commits_ahead long, commits_behind long")

    def hash_of(self, spec: str = HEAD) -> str:
        return self.resolve(spec)

    def hash_of_table(self, table: str, as_of: str = WORKING) -> str:
        return self.manifest(as_of)[table]

    def hash_of_db(self, as_of: str = WORKING) -> str:
        return hashlib.sha1(json.dumps(sorted(self.manifest(as_of).items())).encode()).hexdigest()[:32]

    def add_rule(self, table: str, rule: dict, check: bool = True) -> None:
        """A constraint of a table, as operators.constraints reads it; rows that there are have to meet it already."""
        facts = self.facts(table)
        rule = {**rule, "name": rule.get("name") or constraints.name_of(table, rule, facts.get("rules", []))}
        if any(r["name"] == rule["name"] for r in facts.get("rules", [])):
            raise ValueError(f"there is a constraint {rule['name']}")
        if rule["kind"] == constraints.FOREIGN and not rule.get("parent_columns"):
            rule["parent_columns"] = self.keys(self._set()["working"][rule["parent"]])
        tables = {n: self.snapshot(h) for n, h in self.manifest(WORKING).items()}
        if check and (rule["kind"] != constraints.FOREIGN or (self.options["foreign_key_checks"] and rule["parent"] in tables)) and constraints.breaking(tables, {**rule, "table": table})[0].limit(1).count():
            raise Broken(f"rows of {table} violate {rule['name']}")
        self.set_facts(table, rules=[*facts.get("rules", []), rule])

    def drop_rule(self, table: str, name: str) -> None:
        rules = self.facts(table).get("rules", [])
        if all(r["name"] != name for r in rules):
            raise ValueError(f"no constraint {name}")
        self.set_facts(table, rules=[r for r in rules if r["name"] != name])

    def rules(self, as_of: str = WORKING) -> list[dict]:
        """All constraints of a version, with their tables; not-null columns are rules, too."""
        out = []
        for n, h in sorted(self.manifest(as_of).items()):
            facts = self.store.facts(h)
            out += [{**r, "table": n} for r in facts.get("rules", [])]
            out += [{"table": n, "kind": constraints.NOT_NULL, "columns": [c], "name": c} for c in facts.get("not_null", [])]
        return out

    def verify_constraints(self, rules: Sequence[dict] | None = None, as_of: str = WORKING, tables: Sequence[str] | None = None) -> DataFrame:
        """(table, violation_type, n, violation_info) of the rules given, or of all the database has. `tables` are the ones that
        changed: rules of theirs, and foreign keys that refer to them."""
        there = {n: self.snapshot(h) for n, h in self.manifest(as_of).items()}
        known = [r for r in (self.rules(as_of) if rules is None else rules) if r["table"] in there and r.get("parent", r["table"]) in there]
        known = [r for r in known if tables is None or r["table"] in tables or r.get("parent") in tables]
        if not known:
            return self.spark.createDataFrame([], "table string, violation_type string, n long, violation_info string")
        return constraints.violations(there, known)

    def violating_rows(self, table: str) -> DataFrame:
        """Rows of a table that break one of its rules, with violation_type and violation_info."""
        out, tables = None, {n: self.snapshot(h) for n, h in self.manifest(WORKING).items()}
        for r in self.rules():
            if r["table"] == table and r.get("parent", table) in tables:
                bad, info = constraints.breaking(tables, r)
                one = bad.withColumns({"violation_type": F.lit(r["kind"]), "violation_info": F.lit(info)})
                out = one if out is None else out.union(one)
        return out if out is not None else self.table(table).limit(0).withColumns({"violation_type": F.lit(""), "violation_info": F.lit("")})

    def analyze(self, table: str, buckets: int = 20) -> None:
        """Compute a table's statistics and keep them with the database, under the table's content hash."""
        from palimpsest.operators import stats

        h = self._set()["working"][table]
        df = self.snapshot(h)
        rows = [r.asDict() for r in stats.column_stats(df).collect()]
        key = self.keys(h)
        histogram = [{k: str(v) for k, v in r.asDict().items()} for r in stats.histogram(df, key[0], buckets).collect()] if key and rows else []
        self.config["statistics"][table] = {"hash": h, "columns": rows, "histogram": histogram}
        self._save()

    def statistics(self) -> DataFrame:
        """Kept statistics: (table_name, column_name, row_count, null_count, distinct_count, lower_bound, upper_bound, current)."""
        rows = [(t, c["column_name"], c["row_count"], c["null_count"], c["distinct_count"], c["lower_bound"], c["upper_bound"], s["hash"] == self._set()["working"].get(t)) for t, s in sorted(self.config["statistics"].items()) for c in s["columns"]]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, row_count long, null_count long, distinct_count long, lower_bound string, upper_bound string, current boolean")

    def schema_conflicts(self) -> DataFrame:
        """(table_name, base_schema, our_schema, their_schema, description) of tables whose schemas a merge can't join."""
        m, rows = self._set()["merge"] or {}, []
        for name, said in sorted(m.get("schema", {}).items()):
            hashes = [self.graph[m[k]].tables.get(name) if m[k] else None for k in ("base", "ours", "theirs")]
            rows.append((name, *[self.create_statement(name, h) if h else None for h in hashes], said))
        return self.spark.createDataFrame(rows, "table_name string, base_schema string, our_schema string, their_schema string, description string")

    # --- indexes and lookups

    def lookup(self, table: str, values: Sequence, as_of: str | datetime = WORKING) -> DataFrame:
        """Rows whose (single) key is one of the values: only the buckets that such keys belong to are read."""
        h = self.manifest(as_of)[table]
        m, kinds = self.store.meta(h), self.store.schema(h)
        key = m["keys"][0]
        wanted = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(key, kinds[key].dataType)]))
        buckets = [r[0] for r in wanted.select(place(kinds, [key], m["buckets"])).distinct().collect()]
        return self.store.read(h, buckets).filter(F.col(f"`{key}`").isin([*values]))

    def _index_columns(self, table: str, index: str, as_of: str | datetime) -> tuple[str, list[str], list[str]]:
        h = self.manifest(as_of)[table]
        facts = self.store.facts(h)
        every = {r["name"]: r["columns"] for r in facts.get("rules", []) if r["kind"] == constraints.UNIQUE} | {x["name"]: x["columns"] for x in facts.get("indexes", [])}
        if index not in every:
            raise ValueError(f"no index {index} of {table}")
        return h, every[index], [*every[index], *[k for k in self.keys(h) if k not in every[index]]]

    def index_rows(self, table: str, index: str, as_of: str | datetime = WORKING, rebuild: bool = False) -> DataFrame:
        """A secondary index: its columns and the key, in files by ranges of the columns and sorted by them, so that a filter on
        them reads few files and row groups. It is made when first asked for, and kept for each content of the table."""
        h, by, columns = self._index_columns(table, index, as_of)
        path = f"{self.root}/indexes/{h}-{index}"
        if rebuild:
            self.files.delete(path)
        if not self.files.exists(f"{path}/_SUCCESS"):
            rows = self.snapshot(h).select(*columns)
            rows.repartitionByRange(*by).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.snapshot(h).select(*columns).schema).parquet(path)

    def index_lookup(self, table: str, index: str, where: str, columns: Sequence[str] = (), as_of: str | datetime = WORKING) -> DataFrame:
        """Rows that meet a condition on an index's columns. If the index has all columns asked for, the table is not read;
        else only the buckets of the keys that the index gives are."""
        found = self.index_rows(table, index, as_of).filter(where)
        h, _, covered = self._index_columns(table, index, as_of)
        wanted = [*columns] or self.store.schema(h).names
        if {*wanted} <= {*covered}:
            return found.select(*wanted)
        keys, kinds = self.keys(h), self.store.schema(h)
        rows = self._staged_rows(found.select(*keys).distinct())
        buckets = [r[0] for r in rows.select(place(kinds, keys, self.store.meta(h)["buckets"])).distinct().collect()]
        return self.store.read(h, buckets).join(rows, keys, "left_semi").select(*wanted)

    def clone(self, root: str) -> Repo:
        """A copy of the database's folder under another root; also what a backup is. Its branches are the copy's remote ones."""
        conf = self.spark._jsc.hadoopConfiguration()
        (fs, a), (to, b) = self.files.at(self.root), self.files.at(root)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, conf)
        made = Repo(self.spark, root, self.branch, self.author, self.now, self.store.rows_per_bucket)
        made.config["remotes"]["origin"] = {"url": self.root}
        made.refs["remote"] = {f"origin/{n}": h for n, h in made.refs["branch"].items()}
        made._save()
        return made
