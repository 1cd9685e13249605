"""Runs the stored tests of a database: a query and what is expected of its result."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_DATES = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S")


def coerced(expected: str, actual: object) -> object:
    """The expected value, of the actual one's kind. "0" and "1" stay numbers where a truth value is expected to compare."""
    if expected.upper() == "NULL":
        return None
    if isinstance(actual, bool):
        return {"true": True, "false": False, "1": True, "0": False}[expected.lower()]
    if isinstance(actual, (int, float, Decimal)):
        return Decimal(expected)
    if isinstance(actual, (date, datetime)):
        for f in _DATES:
            try:
                parsed = datetime.strptime(expected, f)
                return parsed if isinstance(actual, datetime) else parsed.date()
            except ValueError:
                continue
        raise ValueError(f"no date: {expected}")
    return expected


def check(df: DataFrame, kind: str, comparator: str, expected: str) -> str:
    """"" if the result is as expected, else what is wrong."""
    compare = COMPARE.get(comparator)
    if compare is None:
        return f"unknown comparator: {comparator}"
    if kind == "expected_rows":
        found: object = df.count()
        want: object = int(expected)
    elif kind == "expected_columns":
        found, want = (len(df.columns) if df.limit(1).count() else 0), int(expected)
    elif kind == "expected_single_value":
        rows = df.limit(2).collect()
        if len(rows) != 1 or len(df.columns) != 1:
            return f"expected one value, got {'more than ' * (len(rows) > 1)}{min(len(rows), 1)} rows and {len(df.columns)} columns"
        found = rows[0][0]
        try:
            want = coerced(expected, found)
        except (ValueError, KeyError, InvalidOperation):
            return f"cannot compare {found!r} with {expected!r}"
        if isinstance(found, (int, float, Decimal)) and not isinstance(found, bool):
            found = Decimal(str(found))
        if found is None or want is None:
            same = found is want
            return "" if (comparator == "==") == same and comparator in ("==", "!=") else f"expected {comparator} {expected}, got {found}"
    else:
        return f"unknown assertion: {kind}"
    return "" if compare(found, want) else f"expected {comparator} {expected}, got {found}"


def run(spark: SparkSession, tests: Iterable[dict], pattern: str = "*", sql: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(test_name, test_group_name, query, status PASS or FAIL, message) of the tests of a name or a group, or of all."""
    rows = []
    for t in tests:
        if pattern not in ("*", t["test_name"], t.get("test_group")):
            continue
        query = t["test_query"].strip().rstrip(";")
        if not query.lower().startswith(("select", "with", "show", "values")):
            message = "only queries can be tested"
        else:
            try:
                message = check((sql or spark.sql)(query), t["assertion_type"], t["assertion_comparator"], t["assertion_value"])
            except Exception as e:  # a broken query is a failed test
                message = f"query error: {str(e).splitlines()[0][:300]}"
        rows.append((t["test_name"], t.get("test_group"), query, "FAIL" if message else "PASS", message))
    return spark.createDataFrame(rows, "test_name string, test_group_name string, query string, status string, message string")
