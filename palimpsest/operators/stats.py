"""Statistics of columns: histograms, most common values, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, row_count, distinct_count, lower_bound, upper_bound): buckets of about equal row counts; equal values share one.

    Values are counted first, so that what is ranked are different values, and their ranks come from ranges whose bounds and
    sizes alone meet on the driver: no task ranks all of them.
    """
    from palimpsest.operators.diff import offsets, ranged

    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = ranged(counts, [column])
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return df.sparkSession.createDataFrame([], "bucket int, row_count long, distinct_count long").withColumns({"lower_bound": F.lit(None).cast(df.schema[column].dataType), "upper_bound": F.lit(None).cast(df.schema[column].dataType)})
    from pyspark.sql import Window

    within = F.sum("n").over(Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.withColumn("within", F.coalesce(within, F.lit(0))).join(offsets(df.sparkSession, sorted(sizes.items())), "_p")
    rank = F.col("_before") + F.col("within")
    bucketed = ranked.withColumn("bucket", F.floor(rank * buckets / F.lit(total)).cast("int"))
    return bucketed.groupBy("bucket").agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("distinct_count"), F.min(column).alias("lower_bound"), F.max(column).alias("upper_bound"))


def most_common(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def column_stats(df: DataFrame) -> DataFrame:
    """(column_name, row_count, null_count, distinct_count, lower_bound, upper_bound) of columns that are no floating numbers.

    One scan, whatever the number of columns: each row is one for each column, values are counted by column and value (combined
    before the shuffle), and those counts are summed by column.
    """
    kinds = [f for f in df.schema.fields if not isinstance(f.dataType, (T.DoubleType, T.FloatType, T.ArrayType, T.MapType, T.StructType))]
    if not kinds:
        return df.sparkSession.createDataFrame([], "column_name string, row_count long, null_count long, distinct_count long, lower_bound string, upper_bound string")
    known = df.select(*[F.col(f"`{f.name}`") for f in kinds])
    cells = known.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{f.name}`").cast("string").alias("v")) for i, f in enumerate(kinds)])).alias("c")).select("c.i", "c.v")
    counted = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("i").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("v").alias("distinct_count"))
    ends = known.agg(*[x for i, f in enumerate(kinds) for x in (F.min(f"`{f.name}`").cast("string").alias(f"l{i}"), F.max(f"`{f.name}`").cast("string").alias(f"u{i}"))])
    ends = ends.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.col(f"l{i}").alias("lower_bound"), F.col(f"u{i}").alias("upper_bound")) for i, f in enumerate(kinds)])).alias("e")).select("e.*")
    empty = F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("null_count", F.lit(0)).alias("null_count"), F.coalesce("distinct_count", F.lit(0)).alias("distinct_count")
    return ends.join(per, "i", "left").select("column_name", *empty, "lower_bound", "upper_bound")


def approximate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.approx_count_distinct(column).alias("distinct_about"), F.percentile_approx(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("quartiles_about"))
