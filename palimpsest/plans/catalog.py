"""information_schema and SHOW over a repo: from manifests alone, no rows are read but statistics that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palimpsest.operators import constraints
from palimpsest.operators.schema import type_name
from palimpsest.plans.store import CONFIG_TABLES, WORKING


def information_schema(session, what: str, of: str | None = None, at: object = WORKING) -> DataFrame:
    """A table of information_schema, or what a SHOW or DESCRIBE gives."""
    r, db, spark = session.repo, session.database, session.spark
    manifest = r.manifest(at)
    tables = {n: (r.store.schema(h), r.keys(h), r.store.facts(h), h) for n, h in sorted(manifest.items())}
    shown = {n: t for n, t in tables.items() if n not in CONFIG_TABLES or session.system.get("vc_show_system_tables")}

    def columns(n: str) -> list[tuple]:
        schema, keys, facts, _ = tables[n]
        uniques = [x["columns"][0] for x in facts.get("rules", []) if x["kind"] == constraints.UNIQUE]
        indexed = [x["columns"][0] for x in facts.get("indexes", [])] + [x["columns"][0] for x in facts.get("rules", []) if x["kind"] == constraints.FOREIGN]
        out = []
        for i, f in enumerate(schema.fields):
            kind = "json" if f.name in facts.get("json", []) else type_name(f.dataType)
            key = "PRI" if f.name in keys else "UNI" if f.name in uniques else "MUL" if f.name in indexed else ""
            extra = "auto_increment" if f.name == facts.get("auto") else "GENERATED" if f.name in facts.get("generated", {}) else ""
            default = facts.get("defaults", {}).get(f.name)
            default = default[1:-1] if default and default[:1] == "'" else default
            out.append((f.name, i + 1, kind, "NO" if f.name in keys or f.name in facts.get("not_null", []) else "YES", key, default, extra))
        return out

    def indexes(n: str) -> list[tuple]:
        _, keys, facts, h = tables[n]
        found = [("PRIMARY", 0, keys)] if keys else []
        found += [(x["name"], 0, x["columns"]) for x in facts.get("rules", []) if x["kind"] == constraints.UNIQUE]
        found += [(x["name"], 1, x["columns"]) for x in facts.get("indexes", [])]
        return [(n, name, non, i + 1, c) for name, non, cs in found for i, c in enumerate(cs)]

    if what == "describe" or what in ("show columns", "show fields"):
        own = session._own(of)
        if own not in tables:
            df = session.sql(f"SELECT * FROM `{of}`")
            return spark.createDataFrame([(f.name, type_name(f.dataType), "YES", "", None, "") for f in df.schema.fields], "Field string, Type string, Null string, Key string, Default string, Extra string")
        return spark.createDataFrame([(c, k, null, key, d, x) for c, _, k, null, key, d, x in columns(own)], "Field string, Type string, Null string, Key string, Default string, Extra string")
    if what == "show tables":
        names = [*shown, *(v for v in sorted(session.views(at)))]
        return spark.createDataFrame([(n,) for n in sorted(names)], f"Tables_in_{db} string")
    if what in ("show databases", "show schemas", "schemata"):
        names = [db, *([f"{db}/{b}" for b in sorted(r.refs["branch"])] if session.system.get("vc_show_branch_databases") else []), "information_schema"]
        return spark.createDataFrame([(n,) for n in names], "Database string" if what != "schemata" else "schema_name string")
    if what in ("show index", "show indexes", "show keys"):
        return spark.createDataFrame([(t, non, n, i, c) for t, n, non, i, c in indexes(session._own(of))], "Table string, Non_unique int, Key_name string, Seq_in_index int, Column_name string")
    if what == "show variables":
        refs = {f"{db}_head": r.head(), f"{db}_head_ref": f"refs/heads/{r.branch}", f"{db}_working": r.hash_of_db("WORKING"), f"{db}_staged": r.hash_of_db("STAGED")}
        return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted({**session.system, **refs}.items())], "Variable_name string, Value string")
    if what in ("show warnings", "show errors"):
        return spark.createDataFrame([], "Level string, Code int, Message string")
    if what == "show procedure":
        return r.config_table("vc_procedures").selectExpr(f"'{db}' AS Db", "name AS Name", "'PROCEDURE' AS Type")
    if what == "show table":
        return spark.createDataFrame([(n, r.store.count(t[3])) for n, t in shown.items()], "Name string, Rows long")
    if what == "tables":
        rows = [(db, n, "BASE TABLE", r.store.count(t[3]), r.config["auto"].get(n)) for n, t in shown.items()] + [(db, n, "VIEW", None, None) for n in session.views(at)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string, table_rows long, auto_increment long")
    if what == "columns":
        rows = [(db, n, c, i, d, null, k, key, x) for n in shown for c, i, k, null, key, d, x in columns(n)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string, column_key string, extra string")
    if what == "views":
        return spark.createDataFrame([(db, n, q) for n, q in session.views(at).items()], "table_schema string, table_name string, view_definition string")
    if what == "statistics":
        return spark.createDataFrame([(db, *x) for n in shown for x in indexes(n)], "table_schema string, table_name string, index_name string, non_unique int, seq_in_index int, column_name string")
    rules = [(n, x) for n, t in shown.items() for x in t[2].get("rules", [])]
    if what == "table_constraints":
        kinds = {constraints.FOREIGN: "FOREIGN KEY", constraints.UNIQUE: "UNIQUE", constraints.CHECK: "CHECK"}
        rows = [(db, "PRIMARY", n, "PRIMARY KEY") for n, t in shown.items() if t[1]] + [(db, x["name"], n, kinds[x["kind"]]) for n, x in rules]
        return spark.createDataFrame(rows, "constraint_schema string, constraint_name string, table_name string, constraint_type string")
    if what == "key_column_usage":
        rows = [(db, "PRIMARY", n, c, i + 1, None, None) for n, t in shown.items() for i, c in enumerate(t[1])]
        rows += [(db, x["name"], n, c, i + 1, x.get("parent"), x["parent_columns"][i] if "parent_columns" in x else None) for n, x in rules if x.get("columns") for i, c in enumerate(x["columns"])]
        return spark.createDataFrame(rows, "constraint_schema string, constraint_name string, table_name string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string")
    if what == "referential_constraints":
        rows = [(db, x["name"], n, x["parent"], x.get("on_update", "no action").upper(), x.get("on_delete", "no action").upper()) for n, x in rules if x["kind"] == constraints.FOREIGN]
        return spark.createDataFrame(rows, "constraint_schema string, constraint_name string, table_name string, referenced_table_name string, update_rule string, delete_rule string")
    if what == "check_constraints":
        return spark.createDataFrame([(db, x["name"], x["condition"]) for _, x in rules if x["kind"] == constraints.CHECK], "constraint_schema string, constraint_name string, check_clause string")
    if what == "routines":
        return r.config_table("vc_procedures").selectExpr(f"'{db}' AS routine_schema", "name AS routine_name", "'PROCEDURE' AS routine_type", "create_stmt AS routine_definition")
    if what == "column_statistics":
        return r.statistics().selectExpr(f"'{db}' AS schema_name", "table_name", "column_name", "to_json(struct(row_count, null_count, distinct_count, lower_bound, upper_bound)) AS histogram")
    raise ValueError(f"not known: {what}")
