"""Vector distances and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; null if a vector has no length."""
    return 1 - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b)))


def string_to_vector(c: Column) -> Column:
    return F.from_json(c, "array<float>")


def vector_to_string(c: Column) -> Column:
    return F.to_json(c)


def nearest(df: DataFrame, column: str, query: DataFrame, query_column: str, k: int, keys: Sequence[str]) -> DataFrame:
    """(keys, distance): the k rows nearest to the one row of `query`, by squared distance, ties by key.

    The query row is broadcast (one row); each task keeps its own k best, and those meet: no sort of all rows.
    """
    one = query.limit(1).select(F.col(query_column).alias("_q"))
    scored = df.crossJoin(F.broadcast(one)).select(*keys, F.round(l2_squared(F.col(column), F.col("_q")), 6).alias("distance"))
    return scored.orderBy("distance", *keys).limit(k)


#: Rows and queries of a block; each block of queries meets each of rows at once.
BLOCK = 512


def nearest_each(df: DataFrame, column: str, query: DataFrame, query_column: str, k: int, key: str, query_key: str) -> DataFrame:
    """(query_<key>, key, distance): for every row of `query` the k rows of df nearest to it, by squared distance, ties by key.

    Queries go in blocks against blocks of all rows; of each two blocks only the k best of a query go on, and those meet. A
    null vector, or one of another length than the query's, is near to nothing. Keys are longs.
    """
    import numpy as np

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    def best(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for rows, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for size in {len(q["v"]) for q in asked}:
                    fit = [r for r in rows if len(r["v"]) == size]
                    if fit:
                        own, vectors = np.array([r["i"] for r in fit]), np.array([r["v"] for r in fit], np.float64)
                        for q in asked:
                            if len(q["v"]) == size:
                                d = np.round(((vectors - np.array(q["v"], np.float64)) ** 2).sum(axis=1), 6)
                                out += [(q["i"], int(own[i]), float(d[i])) for i in np.lexsort([own, d])[:k]]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["q", "k", "distance"])

    def blocks(rows: DataFrame, name: str, vector: str, out: str) -> DataFrame:
        known = rows.filter(F.col(vector).isNotNull()).select(F.col(name).cast("long").alias("i"), F.col(vector).alias("v"))
        n = max(1, -(-known.count() // BLOCK))
        return known.groupBy(F.pmod(F.xxhash64("i"), F.lit(n))).agg(F.collect_list(F.struct("i", "v")).alias(out)).select(out)

    found = blocks(df, key, column, "rows").crossJoin(blocks(query, query_key, query_column, "asked")).mapInArrow(best, "q long, k long, distance double")
    w = Window.partitionBy("q").orderBy("distance", "k")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(F.col("q").alias(f"query_{key}"), F.col("k").alias(key), "distance")
