"""JSON documents in text columns: differences by path, changes at a path, and three-way merge.

Spark's JSON functions read but do not change documents, so these run as Arrow-batched Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _MISSING:
    """Stands for what isn't there; a class, which workers import instead of getting a copy."""



def canonical(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def parse(text: str | None) -> object:
    return _MISSING if text is None else json.loads(text)


def differences(a: object, b: object, path: str = "$") -> Iterator[tuple[str, str, str | None, str | None]]:
    """(diff_type, path, from, to): objects by key, arrays by index; what only one side has is one entry, however deep."""
    if a is _MISSING and b is _MISSING:
        return
    if a is _MISSING:
        yield "added", path, None, canonical(b)
    elif b is _MISSING:
        yield "removed", path, canonical(a), None
    elif isinstance(a, dict) and isinstance(b, dict):
        for k in sorted({*a, *b}):
            yield from differences(a.get(k, _MISSING), b.get(k, _MISSING), f"{path}.{k}" if re.fullmatch(r"\w+", k) else f"{path}.{json.dumps(k)}")
    elif isinstance(a, list) and isinstance(b, list):
        for i in range(max(len(a), len(b))):
            yield from differences(a[i] if i < len(a) else _MISSING, b[i] if i < len(b) else _MISSING, f"{path}[{i}]")
    elif canonical(a) != canonical(b):
        yield "modified", path, canonical(a), canonical(b)


def json_diff(df: DataFrame, before: str, after: str, keys: Sequence[str]) -> DataFrame:
    """keys, diff_type, path, from_value, to_value for each place where the documents differ. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*r[:-2], *d) for r in b.itertuples(index=False, name=None) for d in differences(parse(r[-2]), parse(r[-1]))]
            yield pd.DataFrame(rows, columns=[*keys, "diff_type", "path", "from_value", "to_value"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, before, after).mapInPandas(run, f"{kinds}, diff_type string, path string, from_value string, to_value string")


def _steps(path: str) -> list[str | int]:
    return [int(i) if i else k.strip('"') for k, i in re.findall(r'\.("[^"]*"|\w+)|\[(\d+)\]', path)]


def _at(document: object, path: str, change: Callable[[object, str | int], None], make: bool) -> object:
    steps, here = _steps(path), document
    for s in steps[:-1]:
        if isinstance(here, dict) and s not in here and make:
            here[s] = {}
        try:
            here = here[s]
        except (KeyError, IndexError, TypeError):
            return document
    if steps:
        change(here, steps[-1])
    return document


def _has(holder: object, key: str | int) -> bool:
    return key in holder if isinstance(holder, dict) else isinstance(holder, list) and isinstance(key, int) and key < len(holder)


def _mutator(path: str, insert: bool, replace: bool) -> Callable[[str, object], str]:
    def one(text: str, value: object) -> str:
        def change(holder: object, key: str | int) -> None:
            if _has(holder, key):
                if replace:
                    holder[key] = value
            elif insert:
                if isinstance(holder, dict):
                    holder[key] = value
                elif isinstance(holder, list):
                    holder.append(value)

        return json.dumps(_at(json.loads(text), path, change, insert and replace), separators=(",", ":"), ensure_ascii=False)

    return one


def _applied(document: Column | str, value: Column, one: Callable[[str, object], str]) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t, (json.loads(v) or [None])[0]) for t, v in zip(texts, values, strict=True)], dtype=object)

    return run(document, F.to_json(F.array(value), {"ignoreNullFields": "false"}))  # as JSON text, which keeps whole numbers whole beside nulls


def json_set(document: Column | str, path: str, value: Column) -> Column:
    """Put a value at a path, whether or not there is one; missing objects on the way are made."""
    return _applied(document, value, _mutator(path, True, True))


def json_insert(document: Column | str, path: str, value: Column) -> Column:
    return _applied(document, value, _mutator(path, True, False))


def json_replace(document: Column | str, path: str, value: Column) -> Column:
    return _applied(document, value, _mutator(path, False, True))


def json_remove(document: Column | str, path: str) -> Column:
    def one(text: str, _: object) -> str:
        def change(holder: object, key: str | int) -> None:
            if _has(holder, key):
                del holder[key]

        return json.dumps(_at(json.loads(text), path, change, False), separators=(",", ":"), ensure_ascii=False)

    return _applied(document, F.lit(0), one)


def _appended(text: str, path: str, value: object) -> str:
    """The value put at the end of the array at a path; another value there becomes an array first."""
    def change(holder: object, key: str | int) -> None:
        if _has(holder, key):
            holder[key] = [*holder[key], value] if isinstance(holder[key], list) else [holder[key], value]

    document = json.loads(text)
    if path == "$":
        document = [*document, value] if isinstance(document, list) else [document, value]
    return json.dumps(_at(document, path, change, False), separators=(",", ":"), ensure_ascii=False)


def changed(kind: str, document: str | None, paths: list, values: list) -> str | None:
    """JSON_SET, _INSERT, _REPLACE, _REMOVE and _ARRAY_APPEND of one document; values are JSON text. A null path gives null."""
    if document is None or any(p is None for p in paths):
        return None
    for p, v in zip(paths, values, strict=True):
        said = None if v is None else json.loads(v)
        if kind == "append":
            document = _appended(document, p, said)
        elif kind == "remove":
            def gone(holder: object, key: str | int) -> None:
                if _has(holder, key):
                    del holder[key]

            document = json.dumps(_at(json.loads(document), p, gone, False), separators=(",", ":"), ensure_ascii=False)
        else:
            document = _mutator(p, kind != "replace", kind != "insert")(document, said)
    return document


def _contains(a: object, b: object) -> bool:
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(_contains(x, b) for x in a)
    return canonical(a) == canonical(b)


def _preserved(a: object, b: object) -> object:
    """JSON_MERGE_PRESERVE: objects merge, values of one key and all else become arrays."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _preserved(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    return [*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])]


def paired(kind: str, a: str | None, b: str | None) -> str | None:
    """JSON_MERGE_PATCH, _MERGE_PRESERVE, _CONTAINS and _OVERLAPS of two documents; the last two give 1 or 0."""
    if a is None or b is None:
        return None
    x, y = json.loads(a), json.loads(b)
    if kind == "contains":
        return str(int(_contains(x, y)))
    if kind == "overlaps":
        if isinstance(x, dict) and isinstance(y, dict):
            return str(int(any(k in y and canonical(x[k]) == canonical(y[k]) for k in x)))
        listed = lambda v: v if isinstance(v, list) else [v]
        return str(int(bool({canonical(v) for v in listed(x)} & {canonical(v) for v in listed(y)})))
    return json.dumps(merge_patch(x, y) if kind == "patch" else _preserved(x, y), separators=(",", ":"), ensure_ascii=False)


def merge_patch(a: object, b: object) -> object:
    """RFC 7396: objects merge, null takes a key out, all else replaces."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def json_merge_patch(document: Column | str, other: Column) -> Column:
    return _applied(document, other, lambda t, o: t if o is None else json.dumps(merge_patch(json.loads(t), json.loads(o)), separators=(",", ":"), ensure_ascii=False))


def three_way(base: object, ours: object, theirs: object) -> tuple[object, bool]:
    """(merged, conflict): keys of objects merge by themselves; anything else that both changed to differ conflicts."""
    same = lambda x, y: x is y or (x is not _MISSING and y is not _MISSING and canonical(x) == canonical(y))
    if same(ours, theirs) or same(theirs, base):
        return ours, False
    if same(ours, base):
        return theirs, False
    if isinstance(ours, dict) and isinstance(theirs, dict) and (isinstance(base, dict) or base is _MISSING):
        out, bad, b = {}, False, base if isinstance(base, dict) else {}
        for k in {**ours, **theirs, **b}:
            value, clash = three_way(b.get(k, _MISSING), ours.get(k, _MISSING), theirs.get(k, _MISSING))
            bad = bad or clash
            if value is not _MISSING:
                out[k] = value
        return out, bad
    return ours, True


def json_merge(base: Column | str, ours: Column | str, theirs: Column | str) -> Column:
    """struct<merged: string, conflict: boolean> of a three-way merge of documents."""

    @F.pandas_udf("merged string, conflict boolean")
    def run(b: pd.Series, o: pd.Series, t: pd.Series) -> pd.DataFrame:
        done = [three_way(*map(parse, x)) for x in zip(b, o, t, strict=True)]
        return pd.DataFrame({"merged": [None if m is _MISSING else canonical(m) for m, _ in done], "conflict": [c for _, c in done]})

    return run(base, ours, theirs)
