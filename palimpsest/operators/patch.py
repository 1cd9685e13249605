"""SQL statements that turn one version of a table into another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import diff, schema

_NUMBERS = (T.NumericType,)


def literal(column: Column, kind: T.DataType) -> Column:
    """A value as SQL text: NULL, a number as it is, a binary in hexadecimal, anything else quoted."""
    if isinstance(kind, _NUMBERS):
        text = column.cast("string")
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "1").otherwise("0")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("0x"), F.hex(column))
    else:
        plain = F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string")
        text = F.concat(F.lit("'"), F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def _list(parts: Sequence[Column], sep: str) -> Column:
    return F.concat_ws(sep, *parts)


def insert_statement(table: str, names: Sequence[str], kinds: dict[str, T.DataType], prefix: str = "") -> Column:
    columns = ",".join(f"`{c}`" for c in names)
    return F.concat(F.lit(f"INSERT INTO `{table}` ({columns}) VALUES ("), _list([literal(F.col(prefix + c), kinds[c]) for c in names], ","), F.lit(");"))


def _where(keys: Sequence[str], kinds: dict[str, T.DataType], prefix: str) -> Column:
    return _list([F.concat(F.lit(f"`{k}`="), literal(F.col(prefix + k), kinds[k])) for k in keys], " AND ")


def data_statements(table: str, before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(diff_type, statement): DELETE, UPDATE (only of the columns that changed) and INSERT, from the row diff, as text."""
    kinds = {f.name: f.dataType for f in [*before.schema.fields, *after.schema.fields]}
    rows = diff.row_diff(before, after, keys)
    names = after.columns
    if not keys:
        gone = F.concat(F.lit(f"DELETE FROM `{table}` WHERE "), _list([F.concat(F.lit(f"`{c}`<=>"), literal(F.col(f"from_{c}"), kinds[c])) for c in names], " AND "), F.lit(" LIMIT 1;"))
        return rows.select("diff_type", F.when(F.col("diff_type") == diff.ADDED, insert_statement(table, names, kinds, "to_")).otherwise(gone).alias("statement"))
    changed = [F.when(diff.differs(F.col(f"from_{c}"), F.col(f"to_{c}")), F.concat(F.lit(f"`{c}`="), literal(F.col(f"to_{c}"), kinds[c]))) if c in before.columns else F.concat(F.lit(f"`{c}`="), literal(F.col(f"to_{c}"), kinds[c])) for c in names if c not in keys]
    update = F.concat(F.lit(f"UPDATE `{table}` SET "), _list(changed, ",") if changed else F.lit(""), F.lit(" WHERE "), _where(keys, kinds, "to_"), F.lit(";"))
    delete = F.concat(F.lit(f"DELETE FROM `{table}` WHERE "), _where(keys, kinds, "from_"), F.lit(";"))
    statement = F.when(F.col("diff_type") == diff.ADDED, insert_statement(table, names, kinds, "to_")).when(F.col("diff_type") == diff.REMOVED, delete).otherwise(update)
    return rows.select("diff_type", statement.alias("statement"))


def table_patch(table: str, before: DataFrame | None, after: DataFrame | None, keys: Sequence[str], facts: dict | None = None, old_facts: dict | None = None) -> DataFrame:
    """(table_name, diff_type schema or data, statement, phase): run by phase. A dropped table needs no deletes."""
    spark = (after if after is not None else before).sparkSession
    kind = "table_name string, diff_type string, statement string, phase int"
    if after is None:
        return spark.createDataFrame([(table, "schema", f"DROP TABLE `{table}`;", 0)], kind)
    if before is None:
        first = [schema.create_statement(table, after.schema, keys, facts)]
        data = after.select(F.lit(table), F.lit("data"), insert_statement(table, after.columns, {f.name: f.dataType for f in after.schema.fields}), F.lit(1))
    else:
        first = schema.alter_statements(table, before.schema, after.schema, keys, facts, old_facts)
        data = data_statements(table, before, after, keys).select(F.lit(table), F.lit("data"), "statement", F.lit(1))
    return spark.createDataFrame([(table, "schema", s, 0) for s in first], kind).union(data)


def dump(table: str, df: DataFrame, keys: Sequence[str] = (), batch: int = 1) -> DataFrame:
    """(statement): the table as INSERT statements, `batch` rows in each; the CREATE statement is schema.create_statement."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if batch == 1:
        return df.select(insert_statement(table, df.columns, kinds).alias("statement"))
    values = F.concat(F.lit("("), _list([literal(F.col(c), kinds[c]) for c in df.columns], ","), F.lit(")"))
    group = F.floor(F.monotonically_increasing_id() / batch)
    head = f"INSERT INTO `{table}` ({','.join(f'`{c}`' for c in df.columns)}) VALUES "
    return df.select(values.alias("v"), group.alias("g")).groupBy("g").agg(F.concat(F.lit(head), F.concat_ws(",", F.collect_list("v")), F.lit(";")).alias("statement")).select("statement")
