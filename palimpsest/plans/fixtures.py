"""Versions of the test tables, derived by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
KEYS, VALUES = ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def orders_with(status: str = "o_orderstatus", priority: str = "o_orderpriority", key: str = "o_orderkey") -> str:
    return f"SELECT {key} AS o_orderkey, o_custkey, {status} AS o_orderstatus, o_totalprice, o_orderdate, {priority} AS o_orderpriority FROM orders"


V1 = f"SELECT {COLUMNS} FROM orders WHERE o_orderkey % 10 <> 0"
V2 = orders_with("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END") + " WHERE o_orderkey % 11 <> 0"

#: A chain of six commits; each key's status changes once, so that blame tells them apart.
PLACES = range(6)
CHAIN = [orders_with(f"CASE WHEN o_orderkey % 6 <= {i} THEN concat('S', CAST(o_orderkey % 6 AS VARCHAR(10))) ELSE o_orderstatus END") + f" WHERE o_orderkey % 10 < {4 + i}" for i in PLACES]
COMMITS = [f"c{i}" for i in PLACES]
DATES = [f"2024-01-0{i + 1} 00:00:00" for i in PLACES]

#: Three ways: both sides change, delete and insert.
BASE = f"SELECT {COLUMNS} FROM orders"
OURS = (
    orders_with("CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE o_orderstatus END") + " WHERE o_orderkey % 17 <> 0 UNION ALL "
    + orders_with(key="o_orderkey + 10000000") + " WHERE o_orderkey % 19 = 0"
)
THEIRS = (
    orders_with("CASE WHEN o_orderkey % 35 = 0 THEN 'A' WHEN o_orderkey % 15 = 0 THEN 'B' ELSE o_orderstatus END", "CASE WHEN o_orderkey % 4 = 0 THEN 'P' ELSE o_orderpriority END") + " WHERE o_orderkey % 23 <> 0 UNION ALL "
    + orders_with(priority="CASE WHEN o_orderkey % 76 = 0 THEN 'Q' ELSE o_orderpriority END", key="o_orderkey + 10000000") + " WHERE o_orderkey % 38 = 0 UNION ALL "
    + orders_with(key="o_orderkey + 20000000") + " WHERE o_orderkey % 41 = 0"
)

#: A table without keys, with rows of several copies.
BAG_FROM = "SELECT l_suppkey, CAST(l_quantity AS INT) AS qty FROM lineitem WHERE l_orderkey % 10 <> 0"
BAG_TO = "SELECT l_suppkey, CAST(l_quantity AS INT) AS qty FROM lineitem WHERE l_orderkey % 11 <> 0"
