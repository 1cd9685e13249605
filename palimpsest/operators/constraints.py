"""Rows that break a table's constraints."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREIGN, UNIQUE, CHECK, NOT_NULL = "foreign key", "unique index", "check constraint", "not null"


def foreign_key(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows whose key no parent row has. A null in any key column exempts a row."""
    there = parent.select(*[F.col(p).alias(f"_{i}") for i, p in enumerate(parent_columns)])
    whole = child.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return whole.join(there, [F.col(c) == F.col(f"_{i}") for i, c in enumerate(columns)], "left_anti")


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that share their values of the columns with another row. A null in any of them exempts a row."""
    whole = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    twice = whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*columns)
    return whole.join(twice, list(columns), "left_semi").select(*df.columns)


def check(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is false; unknown (null) passes."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~F.coalesce(c, F.lit(True)))


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(" OR ".join(f"`{c}` IS NULL" for c in columns))


def violations(tables: dict[str, DataFrame], rules: Sequence[dict]) -> DataFrame:
    """(table, violation_type, n, violation_info) for each rule that some row breaks.

    A rule is {"table", "kind": foreign key | unique index | check constraint | not null, ...} with columns, parent and
    parent_columns, or condition.
    """
    out = None
    for r in rules:
        bad, info = breaking(tables, r)
        one = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(r["table"]).alias("table"), F.lit(r["kind"]).alias("violation_type"), "n", F.lit(info).alias("violation_info"))
        out = one if out is None else out.union(one)
    return out.filter("n > 0")


def breaking(tables: dict[str, DataFrame], rule: dict) -> tuple[DataFrame, str]:
    """Rows that break a rule, and the rule in words."""
    df = tables[rule["table"]]
    if rule["kind"] == FOREIGN:
        return foreign_key(df, rule["columns"], tables[rule["parent"]], rule["parent_columns"]), f"{','.join(rule['columns'])} -> {rule['parent']}({','.join(rule['parent_columns'])})"
    if rule["kind"] == UNIQUE:
        return unique(df, rule["columns"]), ",".join(rule["columns"])
    if rule["kind"] == CHECK:
        return check(df, rule["condition"]), rule["condition"]
    return not_null(df, rule["columns"]), ",".join(rule["columns"])


def first_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with one row for each value of the columns; rows with a null among these all stay."""
    whole = " AND ".join(f"`{c}` IS NOT NULL" for c in columns)
    return df.filter(whole).dropDuplicates([*columns]).unionByName(df.filter(f"NOT ({whole})"))


def name_of(table: str, rule: dict, others: Sequence[dict]) -> str:
    """A name for a rule without one."""
    stem = {FOREIGN: f"{table}_ibfk", UNIQUE: "_".join(rule.get("columns", [])), CHECK: f"{table}_chk"}[rule["kind"]]
    taken, n = {r["name"] for r in others}, 1
    if rule["kind"] == UNIQUE and stem not in taken:
        return stem
    while f"{stem}_{n}" in taken:
        n += 1
    return f"{stem}_{n}"


def renamed_facts(facts: dict, renamed: dict[str, str], dropped: Sequence[str] = ()) -> dict:
    """Defaults, rules and indexes of a table some of whose columns have new names or are gone. A rule of a dropped column goes;
    a check that names one can't stay either."""
    new = lambda c: renamed.get(c, c)

    def text(e: str) -> str:
        return re.sub(r"`?\b(\w+)\b`?", lambda m: f"`{renamed[m[1]]}`" if m[1] in renamed else m[0], e) if renamed else e

    def names(e: str) -> set[str]:
        return {*re.findall(r"\w+", e)}

    out = dict(facts)
    for kind in ("defaults", "generated"):
        out[kind] = {new(c): text(e) for c, e in facts.get(kind, {}).items() if c not in dropped}
    for kind in ("not_null", "json"):
        out[kind] = [new(c) for c in facts.get(kind, []) if c not in dropped]
    out["auto"] = None if facts.get("auto") in dropped else new(facts["auto"]) if facts.get("auto") else None
    out["indexes"] = [{**x, "columns": [new(c) for c in x["columns"]]} for x in facts.get("indexes", []) if not {*x["columns"]} & {*dropped}]
    rules = []
    for r in facts.get("rules", []):
        if {*r.get("columns", [])} & {*dropped} or (r["kind"] == CHECK and names(r["condition"]) & {*dropped}):
            continue
        r = {**r, **({"columns": [new(c) for c in r["columns"]]} if "columns" in r else {}), **({"condition": text(r["condition"])} if "condition" in r else {})}
        rules.append(r)
    out["rules"] = rules
    return out


def numbered_nulls(df: DataFrame, column: str, start: int) -> DataFrame:
    """df with nulls of the column numbered from `start` on, in df's own order; df has to be a table or a list of rows, which
    gives its rows in one order each time."""
    from palimpsest.operators.diff import numbered

    kind = df.schema[column].dataType
    new = numbered(df.filter(F.col(column).isNull()), "_no").withColumn(column, (F.col("_no") + (start - 1)).cast(kind)).drop("_no")
    return df.filter(F.col(column).isNotNull()).unionByName(new)


def auto_increment(df: DataFrame, column: str, start: int, order: Sequence[str]) -> DataFrame:
    """df with nulls of the column numbered from `start` on, by `order` among them: ranks within ranges, then offsets.

    Only bounds and sizes of the ranges reach the driver; no task sees all rows.
    """
    from palimpsest.operators.diff import offsets, ranged

    new = df.filter(F.col(column).isNull())
    ranges = ranged(new, order)
    sizes = {r["_p"]: r["n"] for r in ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df
    w = Window.partitionBy("_p").orderBy(*order)
    placed = ranges.withColumn("_r", F.row_number().over(w)).join(offsets(df.sparkSession, sorted(sizes.items()), start), "_p")
    given = placed.withColumn(column, (F.col("_before") + F.col("_r") - 1).cast(df.schema[column].dataType)).select(*df.columns)
    return df.filter(F.col(column).isNotNull()).unionByName(given)
