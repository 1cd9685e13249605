"""Hashes of rows, where a key's rows are kept, and digests of tables that don't depend on an order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def hashable(f: T.StructField) -> Column:
    """A column as one that xxhash64 takes and that tells different values apart: nested ones as JSON text."""
    c = F.col(f"`{f.name}`")
    return c if isinstance(f.dataType, _PLAIN) else F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})


def place(schema: T.StructType, columns: Sequence[str], buckets: int) -> Column:
    """The bucket of a row. Without columns it goes by all of them."""
    fields = [schema[c] for c in columns] or schema.fields
    return F.pmod(F.xxhash64(*[hashable(f) for f in fields]), F.lit(buckets)).cast("int")


def digests(df: DataFrame, *by: str) -> DataFrame:
    """(by..., n, a, b, c, d): the number of rows and sums of the halves of two 64-bit hashes of each row.

    Sums, not exclusive ors: copies of a row count. A null has a flag of its own in the hashes, which Spark's skip it. Combined
    before the shuffle; the sums of parts are the sums of the whole.
    """
    parts = [x for f in df.schema.fields if f.name not in by for c in [hashable(f)] for x in (c, c.isNull())]
    low, halves = (1 << 32) - 1, []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *parts)
        halves += [h.bitwiseAND(low), F.shiftrightunsigned(h, 32)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in zip(halves, "abcd", strict=True)])
