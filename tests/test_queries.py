"""Every registered query of the engine against DuckDB on the same files."""

import datetime
import decimal
import math

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e8 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall()
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def test_plans_push_filters_and_prune_columns(spark):
    def text(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    plan = text("point_lookup")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,77)]" in plan
    assert "o_orderdate" not in text("scan_filter").split("ReadSchema")[1]
    assert text("merge_classify").count("Exchange hashpartitioning") == 2  # by key, then by outcome: no join
    assert "SortMergeJoin" not in text("blame")


def test_altered_columns_come_once_in_order_and_can_be_written(spark, con, tmp_path):
    df = QUERIES["sql_alter"](spark, SF)
    assert df.columns == con.sql(ORACLE_SQL["sql_alter"]).columns
    df.withColumn("b", df.b.cast("string")).write.parquet(f"{tmp_path}/out")
