"""SQL text over a repo: versions of tables, table functions, system tables, procedures, and changes, on top of Spark SQL.

Statements are cut into tokens and translated (dialect.py); tables of a version, table functions and system tables become temporary
views. All else is Spark's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import jsonx
from palimpsest.operators import constraints, diff, stats
from palimpsest.plans import quality_tests
from palimpsest.plans.catalog import information_schema
from palimpsest.plans.dialect import Group, Scope, Translator, find, is_string, literal, mysql_to_spark, name, spark_type, split, statements, text, tokens, tree, unquoted, value, word
from palimpsest.plans.store import CONFIG_TABLES, WORKING, Repo

__all__ = ["Session", "mysql_to_spark", "spark_type", "statements", "tokens"]

CONFIG_KEYS = {"vc_docs": ["doc_name"], "vc_ignore": ["pattern"], "vc_query_catalog": ["id"], "vc_nonlocal_tables": ["table_name"], "vc_tests": ["test_name"], "vc_schemas": ["type", "name"], "vc_procedures": ["name"]}
_FUNCTIONS = ("vc_diff", "vc_diff_stat", "vc_diff_summary", "vc_schema_diff", "vc_patch", "vc_log", "vc_query_diff", "vc_json_diff", "vc_preview_merge_conflicts", "vc_preview_merge_conflicts_summary", "vc_reflog", "vc_branch_status", "vc_test_run")
_HELP = {
    "add": "stage tables", "commit": "record the staged tables as a commit", "branch": "make, rename or delete branches", "checkout": "go to another branch or restore tables", "tag": "make or delete tags", "merge": "merge a version",
    "conflicts_resolve": "take one side of a table's conflicts", "cherry_pick": "apply a commit", "revert": "undo a commit", "reset": "unstage, or move the branch", "rm": "remove tables", "clean": "drop tables that no commit knows",
    "stash": "put changes aside", "rebase": "put a branch's commits on another version", "squash_history": "make one commit of several", "verify_constraints": "look for rows that break rules", "count_commits": "commits ahead and behind",
    "remote": "name remotes", "backup": "name or make backups", "clone": "copy the database", "undrop": "bring a dropped table back", "update_column_tag": "give a column a tag", "stats_once": "compute statistics", "stats_purge": "drop statistics", "stats_info": "show what statistics there are",
}


def register_functions(spark) -> None:
    """Functions of JSON documents that Spark lacks, under names of their own, as Arrow-batched Python."""
    if getattr(spark, "_palimpsest_functions", False):
        return

    def change(kind: pd.Series, document: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([jsonx.changed(k, d, list(p), list(v)) for k, d, p, v in zip(kind, document, paths, values, strict=True)], dtype=object)

    def pair(kind: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jsonx.paired(k, x, y) for k, x, y in zip(kind, a, b, strict=True)], dtype=object)

    spark.udf.register("vc_json_change", F.pandas_udf(change, "string"))
    spark.udf.register("vc_json_pair", F.pandas_udf(pair, "string"))
    spark._palimpsest_functions = True


class Session(Scope):
    """SQL over a repo: session.sql(text) gives a DataFrame."""

    def __init__(self, repo: Repo, database: str = "main_db"):
        self.repo, self.spark, self.database, self.made = repo, repo.spark, database, 0
        self.variables: dict[str, object] = {}
        self.system: dict[str, object] = {
            "autocommit": 1, "foreign_key_checks": 1, "sql_mode": "ONLY_FULL_GROUP_BY", "vc_transaction_commit": 0, "vc_transaction_commit_message": "", "vc_allow_commit_conflicts": 0, "vc_force_transaction_commit": 0,
            "vc_override_schema": None, "vc_dont_merge_json": 0, "vc_show_branch_databases": 0, "vc_show_system_tables": 0, "vc_author_name": None, "vc_author_email": None, "vc_author_date": None, "version": "8.0.0",
        }
        self.prepared: dict[str, str] = {}
        self.temporary: dict[str, DataFrame] = {}
        self.dropped: dict[str, str] = {}
        self.counts = {"found": 0, "changed": -1}
        self.versions: list[object] = []
        self._filters: dict[str, str] = {}
        self._pinned: tuple[str, str, list] | None = None
        register_functions(self.spark)

    # --- what names mean

    def _revision(self, said: str) -> str:
        """A branch's working set by its name, any other version by what it resolves to."""
        return f"{WORKING}@{said}" if said in self.repo.refs["branch"] else said

    def _moment(self, version: object) -> object:
        if isinstance(version, tuple):
            return datetime.fromisoformat(version[1])
        if isinstance(version, str) and version.upper() in ("WORKING", "STAGED", "HEAD"):
            return version.upper()
        return version

    def relation(self, parts: list[str], version: object, alias: bool) -> str | None:
        own, where = parts[-1], parts[:-1]
        at = self._moment(version) if version is not None else self.versions[-1] if self.versions else WORKING
        if where and where[0].lower() == "information_schema":
            return self._named(information_schema(self, own.lower()), own, alias)
        if where and "/" in where[0] and version is None:
            at = self._revision(where[0].partition("/")[2])
        low = own.lower()
        if low in self.temporary and not where:
            return self._named(self.temporary[low], own, alias)
        known = {n.lower(): n for n in self.repo.manifest(at)}
        if low in known:
            override = self.system["vc_override_schema"]
            if self._pinned is not None and not override and self._pinned[0] == low and self.repo.keys(self.repo.manifest(at)[known[low]]) == [self._pinned[1]]:
                return self._named(self.repo.lookup(known[low], self._pinned[2], at), own, alias)
            return self._named(self.repo.table(known[low], at, override if override and known[low] in self.repo.manifest(override) else None), own, alias)
        if low in (views := self.views(at)):
            self.versions.append(at)
            try:
                return f"({Translator(self).statement(views[low])})" + ("" if alias else f" AS `{own}`")
            finally:
                self.versions.pop()
        found = self.system_table(own, at)
        if found is None and any(True for _ in self.repo._nonlocal()):
            found = self.repo.table(own, at)
        return None if found is None else self._named(found, own, alias)

    def _named(self, df: DataFrame, own: str, alias: bool) -> str:
        return self._view(df) + ("" if alias else f" AS `{own}`")

    def _view(self, df: DataFrame) -> str:
        self.made += 1
        df.createOrReplaceTempView(view := f"vc_view_{id(self)}_{self.made}")
        return view

    def views(self, at: object = WORKING) -> dict[str, str]:
        """Names in lower case to queries."""
        h = self.repo.manifest(at).get("vc_schemas")
        return {r["name"].lower(): r["fragment"] for r in self.repo.snapshot(h).filter("type = 'view'").collect()} if h else {}

    def variable(self, token: str) -> str:
        if token.startswith("@@"):
            return self._literal(self._system(token[2:]))
        return self._literal(self.variables.get(token[1:].strip("`").lower()))

    def _literal(self, v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float, Decimal)):
            return str(v)
        if isinstance(v, datetime):
            return f"TIMESTAMP_NTZ '{v}'"
        return f"DATE '{v}'" if isinstance(v, date) else literal(str(v))

    def _system(self, said: str) -> object:
        r, key = self.repo, re.sub(r"^(session|global|local)\.", "", said.lower()).strip("`")
        refs = {f"{self.database}_head": r.head, f"{self.database}_head_ref": lambda: f"refs/heads/{r.branch}", f"{self.database}_working": lambda: r.hash_of_db("WORKING"), f"{self.database}_staged": lambda: r.hash_of_db("STAGED"), f"{self.database}_default_branch": lambda: next(iter(r.refs["branch"]))}
        if key in refs:
            return refs[key]()
        return self.system.get(key)

    def call(self, name_: str, args: list[list]) -> str | None:
        """Scalar functions of the repo and the session, as literals."""
        r, v = self.repo, lambda i: self._argument(args[i])
        known: dict[str, Callable[[], object]] = {
            "vc_hashof": lambda: r.hash_of(v(0)) if args else r.hash_of(), "hashof": lambda: r.hash_of(v(0)), "vc_hashof_table": lambda: r.hash_of_table(v(0), *[v(i) for i in range(1, len(args))]), "vc_hashof_db": lambda: r.hash_of_db(v(0) if args else WORKING),
            "active_branch": lambda: r.branch, "vc_merge_base": lambda: r.graph.merge_base(r.resolve(v(0)), r.resolve(v(1))), "has_ancestor": lambda: r.graph.has_ancestor(r.resolve(v(0)), r.resolve(v(1))), "vc_version": lambda: "1.0", "vc_storage_format": lambda: "parquet",
            "vc_join_cost": lambda: self._cost(v(0)), "database": lambda: self.database, "schema": lambda: self.database, "user": lambda: r.author.partition(" <")[2].rstrip(">") or r.author, "current_user": lambda: r.author.partition(" <")[2].rstrip(">") or r.author,
            "version": lambda: self.system["version"], "found_rows": lambda: self.counts["found"], "row_count": lambda: self.counts["changed"], "last_insert_id": lambda: r.config.get("last_insert_id") or 0,
            "load_file": lambda: self._file(v(0)),
        }
        if name_ == "st_aswkt" or name_ == "st_astext":
            return self._wkt(args[0])
        if name_ not in known:
            return None
        found = known[name_]()
        return f"X'{found.hex()}'" if isinstance(found, bytes) else self._literal(found)

    def _file(self, path: str) -> bytes | None:
        from palimpsest.sources import files

        return files.load_file(self.spark, path)

    def _cost(self, query: str) -> float:
        """Spark's own estimate of a query's size in bytes, as its cost."""
        return float(str(self.sql(query)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def _wkt(self, arg: list) -> str:
        """A point, line or polygon as text: by the type that the expression has."""
        e = Translator(self).expression(arg)
        number = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST(floor({x}) AS BIGINT) AS STRING) ELSE CAST({x} AS STRING) END"
        said = text(arg).lower()
        kinds = {f.name.lower(): f.dataType for h in self.repo.manifest(WORKING).values() for f in self.repo.store.schema(h).fields}
        kind = kinds.get(said.rpartition(".")[2].strip("` "))
        if said.startswith(("linestring", "st_line")) or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)) or "linestring" in said:
            return f"concat('LINESTRING(', array_join(transform({e}, p -> concat({number('p.x')}, ' ', {number('p.y')})), ','), ')')"
        if said.startswith("polygon") or (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)):
            ring = f"concat('(', array_join(transform(r, p -> concat({number('p.x')}, ' ', {number('p.y')})), ','), ')')"
            return f"concat('POLYGON(', array_join(transform({e}, r -> {ring}), ','), ')')"
        return f"concat('POINT(', {number(f'({e}).x')}, ' ', {number(f'({e}).y')}, ')')"

    def _argument(self, items: list) -> object:
        """An argument's value: a literal, a variable, or whatever expression, computed."""
        if len(items) == 1 and is_string(items[0]):
            return value(items[0])
        if len(items) == 1 and isinstance(items[0], str) and items[0].startswith("@") and not items[0].startswith("@@"):
            return self.variables.get(items[0][1:].lower())
        if len(items) == 1 and isinstance(items[0], str) and re.fullmatch(r"[A-Za-z_`][\w`]*", items[0]) and word(items[0]) not in ("null", "true", "false"):
            return name(items[0])
        return self.spark.sql(f"SELECT {Translator(self).expression(items)} AS v").first()[0]

    def recursive(self, name_: str, columns: list[str], base: list, step: list, t: Translator) -> str:
        """WITH RECURSIVE ... UNION: rows are added until a round brings none that is new. Each round is a table of its own, so
        that plans don't grow."""
        seen = self.spark.sql(t.query(base))
        seen = self.repo._staged_rows(seen.toDF(*(columns or seen.columns)).distinct())
        fresh = seen
        while not fresh.isEmpty():
            t.replaced[name_.lower()] = self._view(fresh)
            came = self.spark.sql(t.query(step)).toDF(*seen.columns)
            came = came.select(*[F.col(f.name).cast(f.dataType) for f in seen.schema.fields])
            fresh = self.repo._staged_rows(came.distinct().join(seen, [came[c].eqNullSafe(seen[c]) for c in seen.columns], "left_anti"))
            seen = self.repo._staged_rows(seen.unionByName(fresh))
        return self._view(seen)

    # --- relations that Spark doesn't know

    def system_table(self, own: str, at: object = WORKING) -> DataFrame | None:
        r, n = self.repo, own.lower()
        plain = {
            "vc_log": r.log, "vc_commits": r.commits, "vc_commit_ancestors": r.commit_ancestors, "vc_branches": r.branches, "vc_remote_branches": r.remote_branches, "vc_tags": r.tags, "vc_stashes": r.stashes,
            "vc_status": r.status, "vc_status_ignored": r.status_ignored, "vc_merge_status": r.merge_status, "vc_branch_activity": r.branch_activity, "vc_diff": r.unscoped_diff, "vc_statistics": self._statistics, "vc_conflicts": self._conflicts,
            "vc_remotes": lambda: self._config("remotes"), "vc_backups": lambda: self._config("backups"), "vc_column_diff": r.column_diffs, "vc_rebase": r.rebase_table,
            "vc_constraint_violations": r.verify_constraints, "vc_schema_conflicts": r.schema_conflicts, "vc_help": lambda: self.spark.createDataFrame([(f"vc_{k}", "procedure", v) for k, v in _HELP.items()], "name string, type string, synopsis string"),
        }
        if n in plain:
            return plain[n]()
        if n in CONFIG_TABLES:
            return r.config_table(n, at)
        if n.startswith("vc_commit_diff_"):
            ends = {k: v for k, v in self._filters.items() if k in ("to_commit", "from_commit")}
            if len(ends) < 2:
                raise ValueError(f"{own} needs to_commit = ... and from_commit = ... in WHERE")
            both = [self.repo.resolve(v) if v.upper() not in ("WORKING",) else WORKING for v in (ends["from_commit"], ends["to_commit"])]
            rows = r.commit_diff(self._own(own[15:]), *both)
            return rows.withColumns({"from_commit": F.lit(ends["from_commit"]), "to_commit": F.lit(ends["to_commit"])})
        if self._pinned is None and n.startswith("vc_index_"):
            table, _, index = n[9:].partition("__")
            return r.index_rows(self._own(table), index, at)
        for prefix, make in (("vc_diff_", r.diff_table), ("vc_history_", r.history), ("vc_blame_", r.blame), ("vc_workspace_", r.workspace), ("vc_conflicts_", r.conflict_rows), ("vc_constraint_violations_", r.violating_rows)):
            if n.startswith(prefix):
                return make(self._own(own[len(prefix) :]))
        return None

    def _own(self, said: str) -> str:
        every = {**self.repo.graph[self.repo.head()].tables, **self.repo.manifest(WORKING)}
        return next((t for t in every if t.lower() == said.lower()), said)

    def _config(self, kind: str) -> DataFrame:
        return self.spark.createDataFrame([(n, v["url"]) for n, v in sorted(self.repo.config[kind].items())], "name string, url string")

    def _conflicts(self) -> DataFrame:
        m = self.repo.sets[self.repo.branch]["merge"] or {}
        return self.spark.createDataFrame([(t, self.repo.conflict_rows(t).count()) for t in sorted(m.get("rows", {}))], "table string, num_conflicts long")

    def _statistics(self) -> DataFrame:
        """Kept statistics, where ANALYZE has made some; else computed now."""
        if self.repo.config["statistics"]:
            return self.repo.statistics()
        out = None
        for own, h in self.repo.manifest(WORKING).items():
            one = stats.column_stats(self.repo.snapshot(h)).withColumn("table_name", F.lit(own))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.repo.statistics()

    def table_function(self, n: str, args: list[list]) -> str | None:
        if n not in _FUNCTIONS:
            return None
        return self._view(self.function(n, [self._argument(a) for a in args]))

    def function(self, n: str, args: list) -> DataFrame:
        r = self.repo
        flags, plain, options = [], [], {}
        rest = iter(args)
        for a in rest:
            if isinstance(a, str) and a in ("--include-cols", "--filter", "--limit", "--where"):
                options[a[2:]] = next(rest)
            elif isinstance(a, str) and a.startswith("--") and n != "vc_log":
                flags.append(a)
            else:
                plain.append(a)
        if n == "vc_diff":
            a, b, t = (plain[0], None, plain[1]) if ".." in plain[0] else plain[:3]
            kinds = {"added": "added", "modified": "modified", "removed": "removed", "dropped": "removed"}
            include = [c.strip() for c in options["include-cols"].split(",")] if "include-cols" in options else []
            rows = r.diff(a, b, self._own(t), skinny="--skinny" in flags, include=include, merge_base="--merge-base" in flags, reverse="--reverse" in flags, where=options.get("where"), limit=int(options["limit"]) if "limit" in options else None, kinds=[kinds[options["filter"]]] if "filter" in options else ())
            old, new = self._hashes(a, b)
            dates = [r.graph[x].date if x in r.graph.commits else None for x in (old, new)]
            return rows.withColumns({"from_commit": F.lit(old), "from_commit_date": F.lit(dates[0]).cast("timestamp"), "to_commit": F.lit(new), "to_commit_date": F.lit(dates[1]).cast("timestamp")})
        if n in ("vc_diff_stat", "vc_patch"):
            f = r.diff_stat if n == "vc_diff_stat" else r.patch
            return f(plain[0], None, *plain[1:]) if ".." in plain[0] else f(*plain)
        if n in ("vc_diff_summary", "vc_schema_diff"):
            out = (r.diff_summary if n == "vc_diff_summary" else r.schema_diff)(*plain[: 1 if ".." in plain[0] else 2])
            table = plain[1:] if ".." in plain[0] else plain[2:]
            return out.filter(F.lit(table[0]).isin(F.col("from_table_name"), F.col("to_table_name"))) if table else out
        if n == "vc_log":
            return self._log(args)
        if n == "vc_query_diff":
            first, second = self.sql(plain[0]), self.sql(plain[1])
            return diff.query_diff(first, second, [c.strip() for c in plain[2].split(",")] if len(plain) > 2 else None)
        if n == "vc_json_diff":
            return self.spark.createDataFrame([*jsonx.differences(*map(jsonx.parse, plain))], "diff_type string, path string, from_value string, to_value string")
        if n == "vc_preview_merge_conflicts_summary":
            return self.spark.createDataFrame(r.preview_merge(*plain), "table string, num_data_conflicts long, num_schema_conflicts long")
        if n == "vc_preview_merge_conflicts":
            return r.preview_conflicts(*plain)
        if n == "vc_reflog":
            return r.ref_log(*plain)
        if n == "vc_branch_status":
            if not plain:
                raise ValueError("a base is needed")
            return r.branch_status(*plain)
        tests = [t.asDict() for t in r.config_table("vc_tests").collect()]
        out = None
        for pattern in plain or ["*"]:
            one = quality_tests.run(self.spark, tests, pattern, self.sql)
            out = one if out is None else out.union(one)
        return out

    def _hashes(self, a: str, b: str | None) -> tuple[str, str]:
        from palimpsest.plans.graph import endpoints

        if b is None:
            return endpoints(self.repo.graph, a, self.repo.resolve)
        return tuple(x if x in ("WORKING", "STAGED", "EMPTY") else self.repo.resolve(x) for x in (a, b))

    def _log(self, args: list) -> DataFrame:
        specs, options, rest, parents, decorate = [], {}, iter(args), False, None
        for a in rest:
            if a == "--not":
                options["without"] = [*rest]
            elif a == "--merges":
                options["min_parents"] = 2
            elif a == "--min-parents":
                options["min_parents"] = int(next(rest))
            elif a == "--tables":
                options["tables"] = next(rest).split(",")
            elif a in ("-n", "--number"):
                options["limit"] = int(next(rest))
            elif a == "--all":
                specs += list(self.repo.refs["branch"])
            elif a == "--parents":
                parents = True
            elif a == "--decorate":
                decorate = next(rest)
            elif not a.startswith("--"):
                specs.append(a)
        out = self.repo.log(*specs, **options)
        commits = self.repo.graph.commits
        if parents:
            known = self.spark.createDataFrame([(h, ", ".join(c.parents)) for h, c in commits.items()], "commit_hash string, parents string")
            out = out.join(F.broadcast(known), "commit_hash")
        if decorate and decorate != "no":
            refs: dict[str, list[str]] = {}
            for kind, label in (("branch", "refs/heads/" if decorate == "full" else ""), ("tag", "tag: refs/tags/" if decorate == "full" else "tag: ")):
                for n, h in sorted(self.repo.refs[kind].items()):
                    refs.setdefault(h, []).append(label + n)
            out = out.join(F.broadcast(self.spark.createDataFrame([(h, ", ".join(refs.get(h, []))) for h in commits], "commit_hash string, refs string")), "commit_hash")
        return out.orderBy(F.desc("commit_order"), F.desc("date"), "commit_hash") if parents or decorate else out

    # --- statements

    def translate(self, sql: str | list) -> str:
        items = tree(sql) if isinstance(sql, str) else sql
        toks = _flat(items)
        self._filters = {toks[i].lower().rpartition(".")[2]: value(toks[i + 2]) for i in range(len(toks) - 2) if toks[i].lower().rpartition(".")[2] in ("to_commit", "from_commit") and toks[i + 1] == "=" and is_string(toks[i + 2])}
        for i in range(len(toks) - 2):
            if toks[i].lower() in ("to_commit", "from_commit") and toks[i + 1] == "=" and not is_string(toks[i + 2]) and toks[i + 2].startswith("@"):
                self._filters[toks[i].lower()] = str(self.variables.get(toks[i + 2][1:].lower()))
            if toks[i].lower() in ("to_commit", "from_commit") and toks[i + 1] == "=" and toks[i + 2].lower() in ("vc_hashof", "hashof"):
                self._filters[toks[i].lower()] = self.repo.hash_of(value(toks[i + 4]))
        self._pinned = self._pins(items)
        try:
            return Translator(self).query(items)
        finally:
            self._pinned = None

    def _pins(self, items: list) -> tuple[str, str, list] | None:
        """(table, column, values) of a query of one table whose WHERE, a list of ANDs, has column = or IN whole numbers or texts.
        If the column is the key, only these keys' buckets have to be read."""
        start, where = find(items, "from"), find(items, "where")
        if word(items[0]) != "select" or start < 0 or where < 0 or any(word(x) in ("union", "intersect", "except", "or", "join", "lateral") or x == "," for x in items[start:] if not isinstance(x, Group)):
            return None
        if any(isinstance(x, Group) and any(word(y) == "select" for y in _flat(x)) for x in items):
            return None
        table = name(items[start + 1]) if isinstance(items[start + 1], str) else ""
        if start + 2 < len(items) and items[start + 2] == ".":
            return None
        end = next((i for i in range(where, len(items)) if word(items[i]) in ("group", "order", "limit", "having", "window", "for")), len(items))
        for part in split([w if word(w) != "and" else "AND" for w in items[where + 1 : end]], "AND"):
            part = part[2:] if len(part) > 3 and part[1] == "." else part
            plain = lambda x: isinstance(x, str) and (is_string(x) or re.fullmatch(r"\d+", x))
            told = lambda x: value(x) if is_string(x) else int(x)
            if len(part) == 3 and part[1] == "=" and isinstance(part[0], str) and plain(part[2]):
                found = [told(part[2])]
            elif len(part) == 3 and word(part[1]) == "in" and isinstance(part[2], Group) and part[2] and all(x == "," or plain(x) for x in part[2]):
                found = [told(x) for x in part[2] if x != ","]
            else:
                continue
            own = self._own(table)
            at = self.repo.manifest(WORKING).get(own)
            column = name(part[0])
            if at and self.repo.keys(at) == [column] and isinstance(self.repo.store.schema(at)[column].dataType, T.IntegralType if all(isinstance(v, int) for v in found) else T.StringType):
                return own.lower(), column, found
        return None

    def sql(self, sql: str) -> DataFrame:
        """Run one statement: a query, CALL procedure(...), or a change of data, tables, variables or transactions."""
        items = tree(sql)
        while items and items[-1] == ";":
            items.pop()
        if not items:
            return self._ok()
        w = word(items[0])
        own = getattr(self, f"_run_{w}", None)
        if own is not None:
            return own(items)
        if w in ("insert", "replace", "update", "delete", "truncate", "create", "drop", "alter", "rename", "load", "analyze"):
            return self._changed(items, sql)
        if (at := find(items, "into")) > 0 and w in ("select", "with"):
            return self._into(items, at)
        if "ONLY_FULL_GROUP_BY" not in str(self.system["sql_mode"]).upper():
            items = _any_values(items)
        if Translator(self).is_query(items) and word(items[0]) == "select" and find(items, "into") < 0:
            out = self.spark.sql(self.translate(items))
            if "sql_calc_found_rows" in (word(x) for x in items):
                self.counts["found"] = self.spark.sql(self.translate(items[: find(items, "limit")] if find(items, "limit") > 0 else items)).count()
            return out
        return self.spark.sql(self.translate(items))

    def _ok(self) -> DataFrame:
        return self.spark.createDataFrame([], "ok int")

    def _changed(self, items: list, sql: str) -> DataFrame:
        if not self.system["autocommit"]:
            self.repo.begin()
        held = self.repo._held is not None
        self.change(items, sql)
        if not held:
            self._auto_commit()
        return self._ok()

    def _auto_commit(self) -> None:
        """A commit of all changes, if the session makes one of every transaction."""
        if int(self.system["vc_transaction_commit"] or 0):
            self.repo.commit(str(self.system["vc_transaction_commit_message"] or "Transaction commit"), all=True, skip_empty=True, author=self._author())
        self.repo.clear_staging()

    def _author(self) -> str | None:
        n, e = self.system["vc_author_name"], self.system["vc_author_email"]
        return f"{n or self.repo.author.partition(' <')[0]} <{e or self.repo.author.partition(' <')[2].rstrip('>')}>" if n or e else None

    def run_script(self, script: str) -> DataFrame | None:
        out = None
        for s in statements(script):
            out = self.sql(s)
        return out

    # transactions, variables, prepared statements

    def _run_start(self, items: list) -> DataFrame:
        self.repo.begin()
        return self._ok()

    _run_begin = _run_start

    def _run_commit(self, items: list) -> DataFrame:
        self.repo.end()
        self._auto_commit()
        return self._ok()

    def _run_rollback(self, items: list) -> DataFrame:
        if (at := find(items, "to")) > 0:
            self.repo.back_to(name(items[-1]))
        else:
            self.repo.rollback()
        return self._ok()

    def _run_savepoint(self, items: list) -> DataFrame:
        self.repo.savepoint(name(items[1]))
        return self._ok()

    def _run_release(self, items: list) -> DataFrame:
        if self.repo._held:
            self.repo._held["points"].pop(name(items[-1]), None)
        return self._ok()

    def _run_use(self, items: list) -> DataFrame:
        said = "".join(name(x) for x in items[1:])
        if "/" in said:
            self.repo.checkout(said.partition("/")[2])
        return self._ok()

    def _run_set(self, items: list) -> DataFrame:
        for one in split(items[1:]):
            at = next((i for i, x in enumerate(one) if x in ("=", ":=")), -1)
            if at < 0:
                continue  # SET NAMES and the like
            target, said = one[at - 1], one[at + 1 :]
            bare = len(said) == 1 and isinstance(said[0], str) and word(said[0]) in ("on", "off", "default")
            v = {"on": 1, "off": 0}.get(word(said[0])) if bare else self._argument([Group(said)] if Translator(self).is_query(said) else said)
            if target.startswith("@") and not target.startswith("@@"):
                self.variables[target[1:].strip("`").lower()] = v
                continue
            key = re.sub(r"^@@", "", target)
            key = re.sub(r"^(session|global|local|persist)\.", "", key.lower()).strip("`")
            v = int(v) if isinstance(v, bool) else v
            self.system[key] = v
            if key == "foreign_key_checks":
                self.repo.options["foreign_key_checks"] = bool(int(v))
            elif key in ("vc_allow_commit_conflicts", "vc_force_transaction_commit"):
                self.repo.options["force_commit"] = bool(int(v))
            elif key == "vc_dont_merge_json":
                self.repo.options["merge_json"] = not int(v)
            elif key == f"{self.database}_head_ref":
                self.repo.checkout(str(v).removeprefix("refs/heads/"))
        return self._ok()

    def _run_prepare(self, items: list) -> DataFrame:
        said = items[3]
        self.prepared[name(items[1]).lower()] = str(self.variables[said[1:].lower()]) if said.startswith("@") else value(said)
        return self._ok()

    def _run_execute(self, items: list) -> DataFrame:
        toks = tokens(self.prepared[name(items[1]).lower()])
        given = iter([self.variable(x) for x in items[3:] if x != ","])
        return self.sql(" ".join(next(given) if t == "?" else t for t in toks))

    def _run_deallocate(self, items: list) -> DataFrame:
        self.prepared.pop(name(items[-1]).lower(), None)
        return self._ok()

    def _into(self, items: list, at: int) -> DataFrame:
        """SELECT ... INTO @variables, or INTO OUTFILE 'path' [FIELDS ...]."""
        if word(items[at + 1]) in ("outfile", "dumpfile"):
            from palimpsest.sources import files

            rest = items[at + 3 :]
            end = next((i for i, x in enumerate(rest) if word(x) in ("from", "where", "order", "limit", "group")), len(rest))
            files.write_delimited(self.spark.sql(self.translate(items[:at] + rest[end:])), value(items[at + 2]), **files.field_options(rest[:end]))
            return self._ok()
        names = []
        end = at + 1
        while end < len(items) and isinstance(items[end], str) and (items[end].startswith("@") or items[end] == ","):
            names += [items[end][1:].lower()] if items[end] != "," else []
            end += 1
        rows = self.spark.sql(self.translate(items[:at] + items[end:])).limit(2).collect()
        if len(rows) > 1:
            raise ValueError("the query gives more than one row")
        for i, n in enumerate(names):
            self.variables[n] = rows[0][i] if rows else None
        return self._ok()

    # looking at tables

    def _run_explain(self, items: list) -> DataFrame:
        if len(items) == 2 or (len(items) > 2 and items[2] == "."):
            return self._run_describe(items)
        rest = [x for x in items[1:] if word(x) not in ("plan", "format", "tree") and x != "="] if word(items[1]) in ("plan", "format") else items[1:]
        return self.spark.sql(f"EXPLAIN FORMATTED {self.translate(rest)}")

    def _run_describe(self, items: list) -> DataFrame:
        return information_schema(self, "describe", self._own(name(items[-1])))

    _run_desc = _run_describe

    def _run_show(self, items: list) -> DataFrame:
        said = [word(x) for x in items[1:] if isinstance(x, str)]
        said = [w for w in said if w not in ("full", "global", "session")]
        like = value(items[find(items, "like") + 1]) if find(items, "like") > 0 else None
        at: object = WORKING
        if find(items, "as", "of") > 0:
            at = self._moment(unquoted(items[find(items, "as", "of") + 2]))
        if said[0] == "create":
            own = name(items[3])
            if said[1] == "view":
                return self.spark.createDataFrame([(own, f"CREATE VIEW `{own}` AS {self.views(at)[own.lower()]}")], "View string, `Create View` string")
            h = self.repo.manifest(at)[self._own(own)]
            return self.spark.createDataFrame([(own, self.repo.create_statement(own, h).rstrip(";"))], "Table string, `Create Table` string")
        of = next((name(items[i + 1]) for i, x in enumerate(items) if word(x) in ("from", "in") and i + 1 < len(items)), None)
        out = information_schema(self, f"show {said[0]}", of, at)
        return out.filter(F.col(f"`{out.columns[0]}`").like(like)) if like else out

    # --- changes

    def _target(self, items: list, i: int) -> tuple[str, int]:
        """The table named at i, and where its name ends. A table of the session's own configuration is made if need be."""
        parts, j = [name(items[i])], i + 1
        while j + 1 < len(items) and items[j] == ".":
            parts.append(name(items[j + 1]))
            j += 2
        if len(parts) > 1 and "/" in parts[0] and parts[0].partition("/")[2] != self.repo.branch:
            raise ValueError("check the branch out to change it")
        own = self._own(parts[-1])
        if own.lower() in CONFIG_TABLES and own.lower() not in self.repo.manifest(WORKING):
            self.repo.write_table(own.lower(), self.spark.createDataFrame([], CONFIG_TABLES[own.lower()]), CONFIG_KEYS[own.lower()])
        return own, j

    def change(self, items: list | str, sql: str = "") -> None:
        """INSERT, REPLACE, UPDATE, DELETE, TRUNCATE, CREATE, ALTER, DROP, RENAME, LOAD DATA and ANALYZE, as new snapshots."""
        if isinstance(items, str):
            items, sql = tree(items), items
        getattr(self, f"_change_{word(items[0])}")(items, sql)

    def _change_insert(self, items: list, sql: str) -> None:
        verb, i, ignore = word(items[0]), 1, False
        while word(items[i]) in ("ignore", "low_priority", "delayed", "high_priority", "into"):
            ignore |= word(items[i]) == "ignore"
            i += 1
        table, i = self._target(items, i)
        if table.lower() in self.temporary:
            self.temporary[table.lower()] = self.repo._staged_rows(self.temporary[table.lower()].union(self._rows(table, items[i:], self.temporary[table.lower()].schema, {})[0]))
            return
        h = self.repo.manifest(WORKING).get(table)
        if h is None:
            raise ValueError(f"no table {table}")
        rows, alias, updates = self._rows(table, items[i:], self.repo.store.schema(h), self.repo.store.facts(h))
        before = self.repo.row_count(table)
        if updates:
            self._upsert(table, rows, alias, updates)
        else:
            self.repo.insert(table, rows, "replace" if verb == "replace" else "ignore" if ignore else "error")
        self.counts["changed"] = self.repo.row_count(table) - before

    _change_replace = _change_insert

    def _rows(self, table: str, rest: list, schema: T.StructType, facts: dict) -> tuple[DataFrame, str, list[tuple[str, list]]]:
        """What an INSERT puts in: rows, the alias they have, and what ON DUPLICATE KEY UPDATE says."""
        updates: list[tuple[str, list]] = []
        if (at := find(rest, "on", "duplicate", "key", "update")) >= 0:
            for one in split(rest[at + 4 :]):
                eq = one.index("=")
                updates.append((name(one[eq - 1]), one[eq + 1 :]))
            rest = rest[:at]
        names = schema.names
        if rest and isinstance(rest[0], Group) and not Translator(self).is_query(rest[0]):
            names, rest = [name(c) for c in rest[0] if c != ","], rest[1:]
            names = [next((s for s in schema.names if s.lower() == n.lower()), n) for n in names]
        alias, w = "new", word(rest[0])
        if unknown := [n for n in names if n not in schema.names]:
            raise ValueError(f"no column {unknown[0]} in {table}")
        kinds = {f.name: f.dataType for f in schema.fields}
        if w in ("values", "value"):
            end = find(rest, "as") if find(rest, "as") >= 0 else len(rest)
            if end < len(rest):
                alias = name(rest[end + 1])
            t = Translator(self)
            values = []
            for row in split(rest[1:end]):
                cells = split(row[-1]) if row[-1] else []
                if not cells and not values:
                    names = []
                if len(cells) != len(names):
                    raise ValueError("as many values as columns are needed")
                values.append([self._cell(c, n, kinds, facts, t) for c, n in zip(cells, names, strict=True)])
            if not names:
                rows = self.spark.range(len(values)).select()
            else:
                plain = all("(" not in c or c[:1] == "'" for v in values for c in v)
                listed = f"SELECT * FROM VALUES {', '.join('(' + ', '.join(v) + ')' for v in values)}" if plain else " UNION ALL ".join(f"SELECT {', '.join(v)}" for v in values)
                rows = self.spark.sql(listed).toDF(*names)
        elif w == "set":
            pairs = [(name(p[0]), p[2:]) for p in split(rest[1:])]
            t = Translator(self)
            names = [n for n, _ in pairs]
            rows = self.spark.sql(f"SELECT {', '.join(self._cell(c, n, kinds, facts, t) for n, c in pairs)}").toDF(*names)
        else:
            rows = self.spark.sql(self.translate(rest))
            if len(rows.columns) != len(names):
                raise ValueError("as many values as columns are needed")
            rows = rows.toDF(*[f"c{i}" for i in range(len(names))]).toDF(*names)
        def fitted(n: str):
            if isinstance(kinds[n], (T.ArrayType, T.StructType)) and isinstance(rows.schema[n].dataType, T.StringType):
                return F.from_json(F.col(f"`{n}`"), kinds[n]).alias(n)
            if isinstance(kinds[n], T.BinaryType) and isinstance(rows.schema[n].dataType, T.StringType):
                return F.encode(F.col(f"`{n}`"), "UTF-8").alias(n)
            return F.col(f"`{n}`").cast(kinds[n]).alias(n)
        return rows.select(*[fitted(n) for n in names]) if names else rows, alias, updates

    def _cell(self, items: list, column: str, kinds: dict, facts: dict, t: Translator) -> str:
        if len(items) == 1 and word(items[0]) == "default":
            kind = kinds[column].simpleString()
            return f"CAST({facts.get('defaults', {}).get(column, 'NULL')} AS {kind})"
        if len(items) == 1 and is_string(items[0]) and isinstance(kinds[column], (T.ArrayType, T.StructType)):
            return f"from_json({literal(value(items[0]))}, '{kinds[column].simpleString()}')"
        if isinstance(kinds[column], T.BooleanType) and len(items) == 1 and isinstance(items[0], str) and re.fullmatch(r"\d+", items[0]):
            return str(int(items[0]) != 0).lower()
        return t.expression(items)

    def _upsert(self, table: str, rows: DataFrame, alias: str, updates: list[tuple[str, list]]) -> None:
        """ON DUPLICATE KEY UPDATE: a row whose key, or unique columns, the table has changes that row, by expressions over it and
        the new values. Rows of one statement with the same key come one after the other, a round for each."""
        r = self.repo
        h = r.manifest(WORKING)[table]
        schema, facts = r.store.schema(h), r.store.facts(h)
        rows = r._staged_rows(r._completed(table, rows, schema, facts))
        keys = [k for k in [r.keys(h), *[x["columns"] for x in facts.get("rules", []) if x["kind"] == constraints.UNIQUE]] if k]
        if not keys:
            r.insert(table, rows)
            return
        t = Translator(self)
        expressions = {c: F.expr(t.expression(_renamed(e, table, alias, schema.names))).cast(schema[c].dataType) for c, e in updates}
        w = Window.partitionBy(*[f"`{k}`" for k in keys[0]]).orderBy("_id")
        numbered = r._staged_rows(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_round", F.row_number().over(w)))
        for i in range(1, (numbered.agg(F.max("_round")).first()[0] or 0) + 1):
            now = numbered.filter(F.col("_round") == i).drop("_round", "_id")
            for k in keys:
                there = r._near(table, now, k)
                fresh = now.select(*[F.col(f"`{c}`").alias(f"vc_new_{c}") for c in schema.names])
                joined = r._staged_rows(there.join(fresh, [F.col(f"`{c}`") == F.col(f"`vc_new_{c}`") for c in k]))
                old = joined.select(*[F.col(f"`{c}`") for c in schema.names])
                new = joined.select(*[expressions.get(c, F.col(f"`{c}`")).alias(c) for c in schema.names])
                if not joined.isEmpty():
                    r.replace_rows(table, old, new)
                met = joined.select(*[F.col(f"`vc_new_{c}`").alias(c) for c in k])
                now = r._staged_rows(now.join(met, [*k], "left_anti").select(*schema.names))
            if not now.isEmpty():
                r.insert(table, now)

    def _change_update(self, items: list, sql: str) -> None:
        """UPDATE of one table or of a join; changed rows are found by a query, then replaced by key."""
        set_at, where = find(items, "set"), find(items, "where")
        source = [x for x in items[1:set_at] if word(x) not in ("ignore", "low_priority")]
        tail = next((i for i in range(set_at, len(items)) if word(items[i]) in ("order", "limit")), len(items))
        assigns = split(items[set_at + 1 : where if where > 0 else tail])
        if word(source[0]).startswith(("vc_workspace_", "vc_conflicts_")):
            return self._change_special(name(source[0]), assigns, items[where + 1 : tail] if where > 0 else [])
        tables = self._tables(source)
        by: dict[str, dict[str, list]] = {}
        for one in assigns:
            eq = one.index("=")
            column = name(one[eq - 1])
            owner = name(one[eq - 3]) if eq >= 3 else next((a for a, t in tables.items() if column.lower() in (c.lower() for c in self._columns(t))), None)
            owner = next((a for a in tables if a.lower() == str(owner).lower()), None)
            if owner is None:
                raise ValueError(f"no column {column}")
            by.setdefault(owner, {})[next(c for c in self._columns(tables[owner]) if c.lower() == column.lower())] = one[eq + 1 :]
        self.counts["changed"] = 0
        for owner, values in by.items():
            table = tables[owner]
            facts, columns = self.repo.facts(table), self._columns(table)
            kinds = self.repo.table(table).schema
            picked = Group()
            for c in columns:
                picked += [owner, ".", f"`{c}`", "AS", f"`_o_{c}`", ","]
            for c in columns:
                e = values.get(c, [owner, ".", f"`{c}`"])
                if len(e) == 1 and word(e[0]) == "default":
                    e = tree(facts.get("defaults", {}).get(c, "NULL"))
                picked += [Group(e), "AS", f"`_n_{c}`", ","]
            rows = self.spark.sql(self.translate(["SELECT", *picked[:-1], "FROM", *source, *(items[where:] if where > 0 else items[tail:])]))
            keys = self.repo.keys(self.repo.manifest(WORKING)[table])
            rows = self.repo._staged_rows(rows.dropDuplicates([f"_o_{k}" for k in keys]) if keys and len(tables) > 1 else rows)

            def new_value(c: str) -> object:
                v = F.col(f"`_n_{c}`")
                if isinstance(kinds[c].dataType, (T.ArrayType, T.StructType)) and isinstance(rows.schema[f"_n_{c}"].dataType, T.StringType):
                    v = F.from_json(v, kinds[c].dataType)
                return v.cast(kinds[c].dataType).alias(c)

            new = rows.select(*[new_value(c) for c in columns])
            for c, e in facts.get("generated", {}).items():
                new = new.withColumn(c, F.expr(e).cast(kinds[c].dataType))
            self.repo.replace_rows(table, rows.select(*[F.col(f"`_o_{c}`").alias(c) for c in columns]), new.select(*columns), rows.select(*[F.col(f"`_o_{c}`") for c in columns], *[new_value(c).alias(f"_n_{c}") for c in columns]))
            self.counts["changed"] += rows.count()

    def _change_special(self, said: str, assigns: list[list], where: list) -> None:
        condition = Translator(self).expression(where) if where else "true"
        if said.lower().startswith("vc_workspace_"):
            flag = next(self._argument(a[2:]) for a in assigns if name(a[0]).lower() == "staged")
            return self.repo.stage_rows(self._own(said[13:]), condition, bool(flag))
        values = {name(a[0]): Translator(self).expression(a[2:]) for a in assigns}
        return self.repo.set_ours(self._own(said[13:]), values, condition)

    def _columns(self, table: str) -> list[str]:
        return self.repo.store.schema(self.repo.manifest(WORKING)[table]).names

    def _tables(self, source: list) -> dict[str, str]:
        """Aliases to the tables of a from-clause."""
        out, expect, i = {}, True, 0
        while i < len(source):
            w = word(source[i])
            if w in ("join", "straight_join") or source[i] == ",":
                expect = True
                i += 1
                continue
            if expect and isinstance(source[i], str) and re.match(r"[\w`]", source[i]) and w not in ("inner", "left", "right", "cross", "natural", "outer"):
                table, i = self._target(source, i)
                i += i < len(source) and word(source[i]) == "as"
                follows = i < len(source) and isinstance(source[i], str) and re.match(r"[\w`]", source[i]) and word(source[i]) not in ("join", "inner", "left", "right", "on", "using", "cross", "natural", "straight_join", "set", "where", "order", "limit")
                if table in self.repo.manifest(WORKING):
                    out[name(source[i]) if follows else table] = table
                expect = False
                i += bool(follows)
                continue
            if expect and isinstance(source[i], Group):
                expect = False
            i += 1
        return out

    def _change_delete(self, items: list, sql: str) -> None:
        if word(items[1]) == "from" and find(items, "using") < 0:
            end = next((i for i in range(2, len(items)) if word(items[i]) in ("where", "order", "limit")), len(items))
            said = name(items[2])
            condition = items[end + 1 :] if end < len(items) and word(items[end]) == "where" else []
            if said.lower().startswith(("vc_workspace_", "vc_conflicts_")):
                text_ = Translator(self).expression(condition) if condition else "true"
                return (self.repo.discard_rows if said.lower().startswith("vc_workspace_") else self.repo.forget_conflicts)(self._own(said[13:]), text_)
            table, after = self._target(items, 2)
            before = self.repo.row_count(table)
            if end == len(items):
                self.repo.delete(table)
            else:
                self.repo._remove(table, self.spark.sql(self.translate(["SELECT", "*", "FROM", *items[2:]])))
            self.counts["changed"] = before - self.repo.row_count(table)
            return None
        at = find(items, "from")
        if word(items[1]) == "from":  # DELETE FROM a, b USING ...
            using = find(items, "using")
            wanted, source = items[2:using], items[using + 1 :]
        else:
            wanted, source = items[1:at], items[at + 1 :]
        end = next((i for i, x in enumerate(source) if word(x) in ("where", "order", "limit")), len(source))
        tables = self._tables(source[:end])
        found = {}
        for one in split(wanted):
            owner = next(a for a in tables if a.lower() == name(one[0]).lower())
            found[owner] = self.repo._staged_rows(self.spark.sql(self.translate(["SELECT", "DISTINCT", owner, ".", "*", "FROM", *source])))
        for owner, rows in found.items():
            self.repo._remove(tables[owner], rows)
        return None

    def _change_truncate(self, items: list, sql: str) -> None:
        table, _ = self._target(items, 2 if word(items[1]) == "table" else 1)
        self.repo.delete(table)
        self.repo.config["auto"].pop(table, None)

    def _change_rename(self, items: list, sql: str) -> None:
        for one in split(items[2:]):
            self.repo.rename_table(self._own(name(one[0])), name(one[-1]))

    def _change_analyze(self, items: list, sql: str) -> None:
        for one in split(items[2:]):
            self.repo.analyze(self._own(name(one[0])))

    def _change_load(self, items: list, sql: str) -> None:
        """LOAD DATA [LOCAL] INFILE 'path' [REPLACE | IGNORE] INTO TABLE t [FIELDS ...] [LINES ...] [IGNORE n LINES] [(columns)]."""
        from palimpsest.sources import files

        at, into = find(items, "infile"), find(items, "into")
        table, i = self._target(items, into + 2)
        rest = items[i:]
        columns = [name(c) for c in rest[-1] if c != ","] if rest and isinstance(rest[-1], Group) else self._columns(table)
        skip = int(rest[find(rest, "ignore") + 1]) if find(rest, "ignore") >= 0 else 0
        mode = word(items[into - 1]) if word(items[into - 1]) in ("replace", "ignore") else "ignore" if find(items, "local") > 0 else "error"
        rows = files.read_delimited(self.spark, value(items[at + 1]), columns, skip, **files.field_options(rest))
        kinds = self.repo.table(table).schema
        rows = rows.select(*[c for c in columns if c in kinds.names])
        self.repo.insert(table, files.typed(rows, T.StructType([kinds[c] for c in rows.columns])), mode)

    # --- tables, views, procedures

    def _change_create(self, items: list, sql: str) -> None:
        w = [word(x) for x in items[1:8]]
        if "view" in w and ("table" not in w or w.index("view") < w.index("table")):
            return self._create_view(items, sql, replace="replace" in w)
        if w[0] in ("procedure",) or "procedure" in w[:4]:
            return self._create_procedure(items, sql)
        if "index" in w[:2]:
            return self._create_index(items)
        if w[0] in ("database", "schema"):
            return None
        temporary = w[0] == "temporary"
        i = 2 + temporary
        exists = find(items, "if", "not", "exists")
        i += 3 * (exists == i)
        own = name(items[i])
        rest = items[i + 1 :]
        if own in self.repo.manifest(WORKING) and not temporary:
            if exists >= 0:
                return None
            raise ValueError(f"there is a table {own}")
        if rest and word(rest[0]) == "like":
            like = self._own(name(rest[1]))
            h = self.repo.manifest(WORKING)[like]
            facts = {**self.repo.store.facts(h), "rules": [r for r in self.repo.store.facts(h).get("rules", []) if r["kind"] != constraints.FOREIGN]}
            self.repo.write_table(own, self.repo.snapshot(h).limit(0), self.repo.keys(h), facts=facts)
            return None
        body = rest[0] if rest and isinstance(rest[0], Group) and not Translator(self).is_query(rest[0]) else None
        query = rest[1:] if body is not None else rest
        query = query[next((k for k, x in enumerate(query) if word(x) in ("select", "with", "values", "table") or isinstance(x, Group)), len(query)) :]
        schema, keys, facts, rules = self._definition(own, body) if body is not None else (None, [], {}, [])
        rows = self.spark.sql(self.translate(query)) if query else None
        if schema is None:
            df = rows
        else:
            df = self.spark.createDataFrame([], schema)
            if rows is not None:
                df = rows.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], *[c for c in rows.columns if c not in schema.names])
        if temporary:
            self.temporary[own.lower()] = df
            return None
        self.repo.write_table(own, df, keys, facts=facts)
        for r in rules:
            self.repo.add_rule(own, r)
        start = find(rest, "auto_increment")
        if start >= 0 and start + 2 < len(rest) and rest[start + 1] == "=":
            self.repo.config["auto"][own] = int(rest[start + 2])
        return None

    def _definition(self, table: str, body: Group) -> tuple[T.StructType, list[str], dict, list[dict]]:
        fields, keys, facts, rules = [], [], {"defaults": {}, "not_null": [], "json": [], "generated": {}, "indexes": [], "auto": None}, []
        for one in split(body):
            rule, index, primary = self._rule(one)
            if primary is not None:
                keys = primary
            elif rule is not None:
                rules.append(rule)
            elif index is not None:
                facts["indexes"].append(index)
            else:
                f, own_rules, is_key = self._column(one, facts)
                fields.append(f)
                rules += own_rules
                keys += [f.name] * is_key
        return T.StructType(fields), keys, facts, rules

    def _rule(self, items: list) -> tuple[dict | None, dict | None, list[str] | None]:
        """(rule, index, primary key): which of them a part of a table's definition is."""
        items, said = [*items], None
        if word(items[0]) == "constraint":
            said = name(items[1]) if isinstance(items[1], str) and word(items[1]) not in ("primary", "unique", "foreign", "check") else None
            items = items[2 if said else 1 :]
        w = word(items[0])
        columns = lambda g: [name(x[0]) for x in split(g)]
        group = next((x for x in items if isinstance(x, Group)), None)
        if w == "primary":
            return None, None, columns(group)
        if w == "foreign":
            at = find(items, "references")
            rule = {"kind": constraints.FOREIGN, "columns": columns(group), "parent": self._own(name(items[at + 1])), "parent_columns": columns(items[at + 2]) if at + 2 < len(items) and isinstance(items[at + 2], Group) else [], "name": said}
            return {**rule, **_actions(items[at:])}, None, None
        if w == "check":
            return {"kind": constraints.CHECK, "condition": Translator(self).expression(group), "name": said, **({"enforced": False} if find(items, "not", "enforced") > 0 else {})}, None, None
        if w == "unique":
            named = [x for x in items[1:] if isinstance(x, str) and word(x) not in ("key", "index")]
            return {"kind": constraints.UNIQUE, "columns": columns(group), "name": said or (name(named[0]) if named else None)}, None, None
        if w in ("key", "index", "fulltext", "spatial", "vector") and group is not None:
            named = [x for x in items[1 : items.index(group)] if word(x) not in ("key", "index")]
            return None, {"name": name(named[0]) if named else "_".join(columns(group)), "columns": columns(group), **({"kind": w} if w in ("fulltext", "spatial", "vector") else {})}, None
        return None, None, None

    def _column(self, items: list, facts: dict) -> tuple[T.StructField, list[dict], bool]:
        """A column's definition: its field, rules, and whether it is the key; the rest goes into facts."""
        own, i = name(items[0]), 2
        kind = items[1]
        if i < len(items) and isinstance(items[i], Group):
            kind, i = f"{kind}({text(items[i])})", i + 1
        while i < len(items) and word(items[i]) in ("unsigned", "signed", "zerofill"):
            kind, i = f"{kind} {items[i]}", i + 1
        t, rules, is_key = Translator(self), [], False
        for k in ("defaults", "generated"):
            facts.setdefault(k, {}).pop(own, None)
        for k in ("not_null", "json"):
            facts[k] = [c for c in facts.get(k, []) if c != own]
        if word(items[1]) == "json":
            facts["json"].append(own)
        while i < len(items):
            w, after = word(items[i]), word(items[i + 1]) if i + 1 < len(items) and isinstance(items[i + 1], str) else ""
            if w == "not" and after == "null":
                facts["not_null"].append(own)
                i += 2
            elif w == "default":
                e, end = t._primary(items, i + 1)
                if e != "NULL" and e.lower() != "null":
                    facts["defaults"][own] = e
                i = end
            elif w == "auto_increment":
                facts["auto"] = own
                i += 1
            elif w == "primary" or (w == "key" and not is_key):
                is_key = True
                i += 1 + (after == "key")
            elif w == "unique":
                rules.append({"kind": constraints.UNIQUE, "columns": [own], "name": None})
                i += 1 + (after == "key")
            elif w == "check":
                rules.append({"kind": constraints.CHECK, "condition": t.expression(items[i + 1]), "name": None})
                i += 2
            elif w == "references":
                rules.append({"kind": constraints.FOREIGN, "columns": [own], "parent": self._own(name(items[i + 1])), "parent_columns": [name(c) for c in items[i + 2] if c != ","], "name": None, **_actions(items[i:])})
                i = len(items)
            elif w == "as" or (w == "generated" and after == "always"):
                at = i + (3 if w == "generated" else 1)
                facts["generated"][own] = t.expression(items[at])
                i = at + 1
            elif w == "on" and after == "update":
                i += 3 + (i + 3 < len(items) and isinstance(items[i + 3], Group))
            elif w in ("comment", "collate", "column_format", "storage") or (w == "character" and after == "set"):
                i += 2 + (w == "character")
            elif w in ("first", "after"):
                break
            else:
                i += 1
        return T.StructField(own, T._parse_datatype_string(spark_type(kind))), rules, is_key

    def _change_alter(self, items: list, sql: str) -> None:
        if word(items[1]) != "table":
            if word(items[1]) == "view":
                return self._create_view(["CREATE", *items[1:]], sql, replace=True)
            return None
        table, i = self._target(items, 2)
        for one in split(items[i:]):
            table = self._alter(table, one)
        return None

    def _alter(self, table: str, items: list) -> str:
        r, verb = self.repo, word(items[0])
        h = r.manifest(WORKING)[table]
        facts, keys, columns = dict(r.store.facts(h)), r.keys(h), r.store.schema(h).names
        rest = items[1:]
        if verb in ("add", "modify", "change", "drop", "alter") and rest and word(rest[0]) == "column":
            rest = rest[1:]
        w = word(rest[0]) if rest else ""
        if verb == "add":
            if isinstance(rest[0], Group):
                for one in split(rest[0]):
                    self._alter(table, ["ADD", *one])
                return table
            rule, index, primary = self._rule(rest)
            if primary is not None:
                r.alter(table, keys=primary)
            elif rule is not None:
                r.add_rule(table, rule)
            elif index is not None:
                r.set_facts(table, indexes=[*facts.get("indexes", []), index])
            else:
                f, rules, is_key = self._column(rest, facts)
                if f.name in facts.get("not_null", []) and f.name not in facts.get("defaults", {}) and f.name not in facts.get("generated", {}) and f.name != facts.get("auto"):
                    zero = "''" if isinstance(f.dataType, T.StringType) else "0" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else None
                    fill = {f.name: zero} if zero is not None and r.row_count(table) else {}
                else:
                    fill = {f.name: {**facts.get("defaults", {}), **facts.get("generated", {})}.get(f.name)} if f.name in {**facts.get("defaults", {}), **facts.get("generated", {})} else {}
                r.alter(table, add={f.name: f.dataType.simpleString()}, facts=facts, defaults=fill, order=_ordered([*columns, f.name], f.name, rest), keys=[*keys, f.name] if is_key else None)
                for rule in rules:
                    r.add_rule(table, rule)
        elif verb == "drop":
            if w == "primary":
                r.alter(table, keys=[])
            elif w in ("constraint", "foreign", "check", "index", "key"):
                said = name(rest[-1])
                if any(x["name"] == said for x in facts.get("indexes", [])):
                    r.set_facts(table, indexes=[x for x in facts["indexes"] if x["name"] != said])
                else:
                    r.drop_rule(table, said)
            else:
                if not any(c.lower() == name(rest[0]).lower() for c in columns):
                    raise ValueError(f"no column {name(rest[0])}")
                r.alter(table, drop=[next(c for c in columns if c.lower() == name(rest[0]).lower())])
        elif verb in ("modify", "change"):
            old = name(rest[0])
            rest = rest if verb == "modify" else rest[1:]
            if name(rest[0]) != old:
                r.alter(table, rename={old: name(rest[0])})
                h = r.manifest(WORKING)[table]
                facts, columns = dict(r.store.facts(h)), r.store.schema(h).names
            if facts.get("auto") == name(rest[0]):
                facts["auto"] = None
            f, rules, _ = self._column(rest, facts)
            if f.name in facts["not_null"] and constraints.not_null(r.table(table), [f.name]).limit(1).count():
                raise ValueError(f"{table}.{f.name} has nulls")
            r.alter(table, cast={f.name: f.dataType.simpleString()}, facts=facts, order=_ordered(columns, f.name, rest))
            for rule in rules:
                r.add_rule(table, rule)
        elif verb == "alter":
            own, defaults = name(rest[0]), dict(facts.get("defaults", {}))
            if word(rest[1]) == "set":
                defaults[own] = Translator(self).expression(rest[3:])
            else:
                defaults.pop(own, None)
            r.set_facts(table, defaults=defaults)
        elif verb == "rename":
            if w == "column":
                r.alter(table, rename={name(rest[1]): name(rest[3])})
            elif w in ("index", "key"):
                a, b = name(rest[1]), name(rest[3])
                r.set_facts(table, indexes=[{**x, "name": b} if x["name"] == a else x for x in facts.get("indexes", [])], rules=[{**x, "name": b} if x["name"] == a else x for x in facts.get("rules", [])])
            else:
                r.rename_table(table, name(rest[-1]))
                return name(rest[-1])
        elif verb == "auto_increment":
            r.config["auto"][table] = int(items[-1])
            r._save()
        return table

    def _create_view(self, items: list, sql: str, replace: bool) -> None:
        at = next(i for i, x in enumerate(items) if word(x) == "view")
        own, as_at = name(items[at + 1]), find(items, "as", start=at)
        query = _source(items[as_at + 1 :])
        if isinstance(items[at + 2], Group):
            names = ", ".join(text([c]) for c in items[at + 2] if c != ",")
            query = f"WITH vc_body ({names}) AS ({query}) SELECT * FROM vc_body"
        if not replace and own.lower() in self.views():
            raise ValueError(f"there is a view {own}")
        self.translate(query)
        self._target(["vc_schemas"], 0)
        row = self.spark.createDataFrame([("view", own, query, "{}", str(self.system["sql_mode"]))], CONFIG_TABLES["vc_schemas"])
        self.repo.insert("vc_schemas", row, "replace")

    def _create_index(self, items: list) -> None:
        unique, at = word(items[1]) == "unique", find(items, "index")
        own, table = name(items[at + 1]), self._own(name(items[find(items, "on") + 1]))
        columns = [name(x[0]) for x in split(next(x for x in items if isinstance(x, Group)))]
        if unique:
            self.repo.add_rule(table, {"kind": constraints.UNIQUE, "columns": columns, "name": own})
        else:
            kind = {} if word(items[1]) == "index" else {"kind": word(items[1])}
            self.repo.set_facts(table, indexes=[*self.repo.facts(table).get("indexes", []), {"name": own, "columns": columns, **kind}])

    def _create_procedure(self, items: list, sql: str) -> None:
        at = find(items, "procedure")
        own = name(items[at + 1])
        self._target(["vc_procedures"], 0)
        now = self.repo.now()
        self.repo.insert("vc_procedures", self.spark.createDataFrame([(own, sql.strip().rstrip(";"), now, now, str(self.system["sql_mode"]))], CONFIG_TABLES["vc_procedures"]))

    def _procedure(self, said: str, args: list[list]) -> DataFrame:
        """Run a stored procedure: its statements one after the other, parameters standing for their values."""
        row = self.repo.config_table("vc_procedures").filter(F.lower("name") == said.lower()).first()
        if row is None:
            raise ValueError(f"no procedure {said}")
        items = tree(row["create_stmt"])
        at = find(items, "procedure")
        params = [(word(p[0]) if word(p[0]) in ("in", "out", "inout") else "in", name(p[1] if word(p[0]) in ("in", "out", "inout") else p[0])) for p in split(items[at + 2])]
        body = items[at + 3 :]
        while body and word(body[0]) not in ("begin", "select", "insert", "update", "delete", "replace", "call", "set", "with"):
            body = body[1:]
        body = body[1:-1] if word(body[0]) == "begin" else body
        bound = {}
        for (kind, p), a in zip(params, args, strict=True):
            if kind == "in":
                bound[p.lower()] = self._literal(self._argument(a))
            else:
                bound[p.lower()] = a[0]
        out = self._ok()
        for one in split(body, ";"):
            if one:
                out = self.sql(_source(_bound(one, bound)))
        return out

    def _change_drop(self, items: list, sql: str) -> None:
        r, w = self.repo, word(items[1])
        temporary = w == "temporary"
        kind = word(items[2]) if temporary else w
        exists = find(items, "if", "exists")
        start = exists + 2 if exists >= 0 else 3 if temporary else 2
        if kind == "index":
            table = self._own(name(items[find(items, "on") + 1]))
            self._alter(table, ["DROP", "INDEX", items[2]])
            return
        for one in split(items[start:]):
            own = name(one[0])
            if kind == "table":
                if own.lower() in self.temporary:
                    del self.temporary[own.lower()]
                    continue
                own = self._own(own)
                if own in r.manifest(WORKING):
                    self.dropped[own] = r.manifest(WORKING)[own]
                    r.drop_table(own)
                elif exists < 0:
                    raise ValueError(f"no table {own}")
            elif kind == "view":
                if own.lower() in self.views():
                    r.delete("vc_schemas", f"type = 'view' AND lower(name) = {literal(own.lower())}")
                elif exists < 0:
                    raise ValueError(f"no view {own}")
            elif kind == "procedure":
                if exists < 0 and not r.config_table("vc_procedures").filter(F.lower("name") == own.lower()).count():
                    raise ValueError(f"no procedure {own}")
                if "vc_procedures" in r.manifest(WORKING):
                    r.delete("vc_procedures", f"lower(name) = {literal(own.lower())}")

    # --- procedures

    def _run_call(self, items: list) -> DataFrame:
        said = name(items[1]).lower()
        given = split(items[2]) if len(items) > 2 else []
        n = said.removeprefix("vc_")
        if not said.startswith("vc_") and n not in _HELP:
            return self._procedure(name(items[1]), given)
        args = [str(a) if a is not None else "" for a in (self._argument(g) for g in given)]
        return self.procedure(n, args)

    def procedure(self, n: str, args: list[str]) -> DataFrame:
        r, flags = self.repo, {}
        plain, rest = [], iter(args)
        for a in rest:
            if a in ("-m", "--message", "--author", "--date", "-b", "-n", "-B", "--from", "--to"):
                flags[{"-m": "m", "--message": "m", "-B": "b"}.get(a, a.lstrip("-"))] = next(rest)
            elif a in ("-am", "-Am"):
                flags["a"], flags["m"] = True, next(rest)
            elif a.startswith("-") and len(a) > 1:
                flags[a.lstrip("-")] = True
            else:
                plain.append(a)
        one = lambda kind, *v: self.spark.createDataFrame([v], kind)
        if n == "add":
            r.add(*([] if {"A", "all", "a"} & {*flags} or plain == ["."] else [self._own(p) for p in plain]))
        elif n in ("commit", "commit_hash_out"):
            date_ = flags.get("date") or self.system["vc_author_date"]
            if "force" in flags:
                r.options["force_commit"] = True
            h = r.commit(flags.get("m", "") or (r.graph[r.head()].message if "amend" in flags else ""), all=bool({"a", "A", "all", "ALL"} & {*flags}), author=flags.get("author") or self._author(), date=datetime.fromisoformat(str(date_)) if date_ else None, amend="amend" in flags, allow_empty="allow-empty" in flags, skip_empty="skip-empty" in flags)
            return one("hash string", h)
        elif n == "branch":
            if {"d", "D", "delete"} & {*flags}:
                for p in plain:
                    r.delete_branch(p)
            elif {"m", "M", "move"} & {*flags}:
                r.rename_branch(*plain)
            elif {"c", "copy"} & {*flags}:
                r.create_branch(plain[1], plain[0])
            else:
                r.create_branch(*plain)
        elif n == "checkout":
            if "b" in flags:
                if plain:
                    r.create_branch(flags["b"], plain[0])
                r.checkout(flags["b"], new=not plain)
            elif plain[0] in r.refs["branch"]:
                r.checkout(plain[0])
            else:
                r.checkout("HEAD", tables=[self._own(p) for p in plain])
        elif n == "tag":
            r.tag(*plain, delete="d" in flags)
        elif n == "merge":
            if "abort" in flags:
                r.abort_merge()
            else:
                m = r.merge(plain[0], flags.get("m"), "no-ff" in flags, "squash" in flags, "ff-only" in flags, "no-commit" in flags, self._author())
                return one("hash string, fast_forward int, conflicts int, message string", m["hash"], int(m["fast_forward"]), m["conflicts"], m["message"])
        elif n == "conflicts_resolve":
            tables = [t for t in r._merge_state()["conflicts"]] if plain == ["."] else [self._own(t) for t in plain]
            for t in tables:
                r.resolve_conflicts(t, "ours" if "ours" in flags else "theirs")
        elif n in ("cherry_pick", "revert"):
            kind = n.replace("_", "-")
            if "abort" in flags:
                r.reset(hard=True)
            elif "continue" in flags:
                return one("hash string", r._continue(kind))
            else:
                m = r.picked(plain[0]) if n == "cherry_pick" else r.reverted(plain[0])
                return one("hash string, data_conflicts long, schema_conflicts long, constraint_violations long", *m.values())
        elif n == "reset":
            tables = [self._own(p) for p in plain if self._own(p) in {**r.manifest(WORKING), **r.manifest("STAGED")}]
            r.reset(plain[0] if plain and not tables and plain[0] != "." else "HEAD", hard="hard" in flags, tables=tables)
        elif n in ("rm", "clean"):
            plain = [self._own(p) for p in plain]
            r.rm(*plain, cached="cached" in flags) if n == "rm" else r.clean(*plain) if "dry-run" not in flags else None
        elif n == "stash":
            r.stash(*plain)
        elif n == "rebase":
            if "abort" in flags:
                r.abort_rebase()
            elif "continue" in flags:
                return one("status int, message string", 0, f"rebased: {r.continue_rebase()}")
            elif {"i", "interactive"} & {*flags}:
                r.rebase_plan(plain[0])
                return one("status int, message string", 0, "interactive rebase started; edit vc_rebase, then call with --continue")
            else:
                return one("hash string", r.rebase(plain[0]))
        elif n == "squash_history":
            return one("hash string", r.squash_history(plain[0], flags.get("m", "squashed")))
        elif n == "verify_constraints":
            changed = None if "all" in flags else [t for t, h in r.manifest(WORKING).items() if r.graph[r.head()].tables.get(t) != h]
            rules = r.verify_constraints(tables=[self._own(p) for p in plain] or changed)
            broken = rules.limit(1).count()
            return one("violations int", int(broken > 0))
        elif n == "count_commits":
            return one("ahead long, behind long", *r.graph.ahead_behind(r.resolve(flags["to"]), r.resolve(flags["from"])))
        elif n in ("remote", "backup"):
            kind = "remotes" if n == "remote" else "backups"
            if plain[0] == "add":
                r.config[kind][plain[1]] = {"url": plain[2]}
            elif plain[0] in ("remove", "rm"):
                del r.config[kind][plain[1]]
            elif plain[0] in ("sync", "sync-url"):
                r.clone(r.config[kind][plain[1]]["url"] if plain[0] == "sync" else plain[1])
            r._save()
        elif n == "clone":
            r.clone(plain[-1])
        elif n == "undrop":
            for t in plain:
                r._keep(t, self.dropped.pop(t))
        elif n == "update_column_tag":
            t = self._own(plain[0])
            r.set_facts(t, tags={**r.facts(t).get("tags", {}), plain[1]: int(plain[2])})
        elif n == "stats_once":
            for t in r.manifest(WORKING):
                r.analyze(t)
        elif n in ("stats_purge", "stats_stop"):
            r.config["statistics"] = {} if n == "stats_purge" else r.config["statistics"]
            r._save()
        elif n == "stats_info":
            return one("info string", json.dumps({"tables": sorted(r.config["statistics"])}))
        elif n == "gc":
            r.clear_staging()
        else:
            raise ValueError(f"no procedure {n}")
        return one("status int", 0)


def _flat(items: list) -> list[str]:
    out: list[str] = []
    for x in items:
        out += ["(", *_flat(x), ")"] if isinstance(x, Group) else [x]
    merged: list[str] = []
    for x in out:
        if merged and merged[-1].endswith(".") and not is_string(merged[-1]):
            merged[-1] += x
        elif x == "." and merged:
            merged[-1] += x
        else:
            merged.append(x)
    return [x for x in merged if x not in ("(", ")") or True]


def _any_values(items: list) -> list:
    """A grouped SELECT with any value of the plain columns that it selects and doesn't group by, as without ONLY_FULL_GROUP_BY."""
    at, start = find(items, "group", "by"), find(items, "from")
    if word(items[0]) != "select" or at < 0 or start < 0:
        return items
    grouped = {text(g).lower().rpartition(".")[2] for g in split(items[at + 2 :][: next((i for i, x in enumerate(items[at + 2 :]) if word(x) in ("having", "order", "limit", "with")), len(items))])}
    out = [items[0]]
    for i, one in enumerate(split(items[1:start])):
        bare = one[:1] if len(one) == 1 or word(one[1]) == "as" else one[:3] if len(one) >= 3 and one[1] == "." else None
        if bare and all(isinstance(x, str) for x in bare) and re.fullmatch(r"[A-Za-z_`][\w`]*", bare[-1]) and name(bare[-1]).lower() not in grouped:
            one = ["any_value", Group(bare), "AS", one[-1] if len(one) > len(bare) else bare[-1]]
        out += ([","] if i else []) + one
    return [*out, *items[start:]]


def _source(items: list) -> str:
    """Tokens as the SQL they came from, but for spaces and comments."""
    return " ".join(f"({_source(x)})" if isinstance(x, Group) else x for x in items)


def _bound(items: list, bound: dict[str, str]) -> list:
    return [Group(_bound(x, bound)) if isinstance(x, Group) else bound.get(word(x).strip("`"), x) if word(x) else x for x in items]


def _renamed(items: list, table: str, alias: str, columns: list[str]) -> list:
    """An expression of ON DUPLICATE KEY UPDATE: VALUES(c) and alias.c are the new row's, table.c and c the old one's."""
    out: list = []
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, Group):
            out.append(Group(_renamed(x, table, alias, columns)))
        elif word(x) == "values" and i + 1 < len(items) and isinstance(items[i + 1], Group):
            out.append(f"`vc_new_{name(items[i + 1][0])}`")
            i += 1
        elif i + 2 < len(items) and items[i + 1] == "." and name(x).lower() in (alias.lower(), table.lower()):
            out.append(f"`vc_new_{name(items[i + 2])}`" if name(x).lower() == alias.lower() else f"`{name(items[i + 2])}`")
            i += 2
        else:
            out.append(x)
        i += 1
    return out


def _actions(items: list) -> dict[str, str]:
    """ON DELETE and ON UPDATE of a foreign key."""
    out = {}
    for event in ("delete", "update"):
        if (at := find(items, "on", event)) >= 0:
            first, second = word(items[at + 2]), word(items[at + 3]) if at + 3 < len(items) else ""
            out[f"on_{event}"] = "set null" if first == "set" and second == "null" else "no action" if first == "no" else first
    return out


def _ordered(columns: list[str], own: str, items: list) -> list[str]:
    """The columns with one of them put FIRST or AFTER another, if the definition says so."""
    last = [x for x in items if isinstance(x, str)]
    rest = [c for c in columns if c != own]
    if word(last[-1]) == "first":
        return [own, *rest]
    if len(last) > 1 and word(last[-2]) == "after":
        at = next(i for i, c in enumerate(rest) if c.lower() == name(last[-1]).lower())
        return [*rest[: at + 1], own, *rest[at + 1 :]]
    return columns


