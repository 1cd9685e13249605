"""Differences between two versions of a table: rows, cells, schemas of results, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED, MODIFIED, REMOVED = "added", "modified", "removed"
#: Rows of the sample for each range whose bounds it gives.
SAMPLED = 20


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality: null and null are the same, null and a value are not."""
    return ~a.eqNullSafe(b)


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def sides(before: DataFrame, after: DataFrame, keys: Sequence[str], renamed: dict[str, str] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Both versions side by side, joined on their keys: from_<c>, to_<c>, and whether each side has the row.

    `renamed` maps a column's old name to its new one. A missing column of one side is null there. Presence is a flag of
    its own, since a row of nulls is a row. Returns the frame and the columns of each side by their new names.
    """
    names = renamed or {}
    before = before.withColumnsRenamed(names)
    old, new = before.columns, after.columns
    a = before.select(*[F.col(c).alias(f"from_{c}") for c in old], F.lit(True).alias("in_from"))
    b = after.select(*[F.col(c).alias(f"to_{c}") for c in new], F.lit(True).alias("in_to"))
    on = [F.col(f"from_{k}").eqNullSafe(F.col(f"to_{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    for c in old:
        if c not in new:
            joined = joined.withColumn(f"to_{c}", F.lit(None).cast(before.schema[c].dataType))
    for c in new:
        if c not in old:
            joined = joined.withColumn(f"from_{c}", F.lit(None).cast(after.schema[c].dataType))
    return joined, old, new


def diff_type() -> Column:
    return F.when(F.col("in_from").isNull(), ADDED).when(F.col("in_to").isNull(), REMOVED).otherwise(MODIFIED)


def row_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], renamed: dict[str, str] | None = None, skinny: bool = False, include: Sequence[str] = ()) -> DataFrame:
    """Rows that differ, as to_<c>..., from_<c>..., diff_type (added, modified, removed).

    One shuffle of each side by key (none where both are bucketed by it). Without keys the tables are bags of rows
    (bag_diff). `skinny` keeps the keys, the columns that changed in some modified row, and `include`; it takes one
    aggregate over the difference to find them.
    """
    if not keys:
        return bag_diff(before, after)
    joined, old, new = sides(before, after, keys, renamed)
    columns = [*new, *[c for c in old if c not in new]]
    changed = any_of([differs(F.col(f"from_{c}"), F.col(f"to_{c}")) for c in columns if c not in keys])
    out = joined.filter(F.col("in_from").isNull() | F.col("in_to").isNull() | changed).withColumn("diff_type", diff_type())
    if skinny:
        others = [c for c in columns if c not in keys]
        seen = out.agg(*[F.max(differs(F.col(f"from_{c}"), F.col(f"to_{c}"))).alias(c) for c in others]).first() if others else {}
        columns = [c for c in columns if c in keys or c in include or (c in others and seen[c])]
    return out.select(*[f"to_{c}" for c in columns if c in new or skinny], *[f"from_{c}" for c in columns if c in old or skinny], "diff_type")


def bag_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of tables without keys: a row that the new version has n times more is added n times, never modified."""
    columns = after.columns
    sized = before.select(*columns, F.lit(-1).cast("long").alias("n")).union(after.select(*columns, F.lit(1).cast("long").alias("n")))
    delta = sized.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
    one_each = copies(delta, "n")
    to = [F.when(F.col("n") > 0, F.col(c)).alias(f"to_{c}") for c in columns]
    of = [F.when(F.col("n") < 0, F.col(c)).alias(f"from_{c}") for c in columns]
    return one_each.select(*to, *of, F.when(F.col("n") > 0, ADDED).otherwise(REMOVED).alias("diff_type"))


#: Copies that one array has; more are dealt in blocks of so many, so that no array grows with a row's copies.
COPIES = 1 << 16


def copies(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as the size of the number n says, n included."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.abs(n) - 1) / COPIES).cast("long"))
    block = df.filter(F.col(n) != 0).withColumn("_block", F.explode(blocks))
    size = F.least(F.lit(COPIES).cast("long"), F.abs(n) - F.col("_block") * COPIES)
    return block.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), size.cast("int")))).drop("_block", "_copy")


def bag_stat(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows_added and rows_deleted of tables without keys; the other figures of diff_stat are null for these."""
    columns = after.columns
    sized = before.select(*columns, F.lit(-1).cast("long").alias("n")).union(after.select(*columns, F.lit(1).cast("long").alias("n")))
    delta = sized.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n <> 0")
    return delta.agg(
        F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).cast("long").alias("rows_added"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).cast("long").alias("rows_deleted")
    )


def diff_stat(before: DataFrame, after: DataFrame, keys: Sequence[str], table: str = "", same: int = 0) -> DataFrame:
    """One row: rows unmodified, added, deleted and modified, and the same of cells, with both versions' sizes.

    Cells of rows added and deleted are counted by the new version's width; a column that only one version has adds its
    cells to the added or the deleted ones, and one cell to each modified row. Where both versions have as many cells, the
    larger of the two counts is both. `same` rows of both versions, known to be equal, were left out of the frames.
    """
    joined, old, new = sides(before, after, keys)
    shared = [c for c in new if c in old and c not in keys]
    changed = F.lit(0)
    for c in shared:
        changed = changed + differs(F.col(f"from_{c}"), F.col(f"to_{c}")).cast("int")
    gone_or_new = [differs(F.col(f"from_{c}"), F.col(f"to_{c}")) for c in {*old} ^ {*new}]
    both = F.col("in_from") & F.col("in_to")
    modified = both & ((changed > 0) | any_of(gone_or_new))

    def count(condition: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))

    sums = joined.agg(
        (count(F.col("in_from")) + same).alias("old_row_count"), (count(F.col("in_to")) + same).alias("new_row_count"), count(F.col("in_from").isNull()).alias("rows_added"),
        count(F.col("in_to").isNull()).alias("rows_deleted"), count(modified).alias("rows_modified"), F.coalesce(F.sum(F.when(modified, changed + len({*old} ^ {*new}))), F.lit(0)).cast("long").alias("cells_modified"),
    )
    cells = sums.withColumn("old_cell_count", F.col("old_row_count") * len(old)).withColumn("new_cell_count", F.col("new_row_count") * len(new))
    grown = F.col("new_cell_count") - F.col("old_cell_count")
    added, deleted = F.col("rows_added") * len(new), F.col("rows_deleted") * len(new)
    level = F.greatest(added, deleted)
    return cells.select(
        F.lit(table).alias("table_name"), (F.col("old_row_count") - F.col("rows_deleted") - F.col("rows_modified")).alias("rows_unmodified"), "rows_added", "rows_deleted", "rows_modified",
        F.when(grown == 0, level).when(grown > 0, grown + deleted).otherwise(added).cast("long").alias("cells_added"),
        F.when(grown == 0, level).when(grown > 0, deleted).otherwise(added - grown).cast("long").alias("cells_deleted"),
        "cells_modified", "old_row_count", "new_row_count", "old_cell_count", "new_cell_count",
    )


def column_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(column_name, diff_type) of columns added, removed, or modified in some row: one aggregate over the joined sides."""
    joined, old, new = sides(before, after, keys)
    both = [c for c in new if c in old]
    touched = joined.agg(*[F.coalesce(F.max(differs(F.col(f"from_{c}"), F.col(f"to_{c}"))), F.lit(False)).alias(c) for c in both])
    stacked = touched.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("hit")) for c in both])).alias("e"))
    out = stacked.filter("e.hit").select("e.column_name", F.lit(MODIFIED).alias("diff_type"))
    fixed = [(c, ADDED) for c in new if c not in old] + [(c, REMOVED) for c in old if c not in new]
    return out.union(before.sparkSession.createDataFrame(fixed, "column_name string, diff_type string")) if fixed else out


def query_diff(first: DataFrame, second: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Difference of two queries' results, as from_*, to_*, diff_type (added, modified, deleted).

    With keys, rows are matched by them. Without, rows are compared by their place in the order that each query gives.
    Results of different schemas have nothing in common: all of the first is deleted, all of the second added.
    """
    if [(f.name, f.dataType) for f in first.schema] != [(f.name, f.dataType) for f in second.schema]:
        a = first.select(*[F.col(c).alias(f"from_{c}") for c in first.columns], *[F.lit(None).cast(second.schema[c].dataType).alias(f"to_{c}") for c in second.columns], F.lit("deleted").alias("diff_type"))
        b = second.select(*[F.lit(None).cast(first.schema[c].dataType).alias(f"from_{c}") for c in first.columns], *[F.col(c).alias(f"to_{c}") for c in second.columns], F.lit(ADDED).alias("diff_type"))
        return a.union(b)
    columns = first.columns
    if not keys:
        first, second, keys = numbered(first), numbered(second), ["row_no"]
    joined, _, _ = sides(first, second, keys)
    changed = any_of([differs(F.col(f"from_{c}"), F.col(f"to_{c}")) for c in columns if c not in keys])
    kind = F.when(F.col("in_from").isNull(), ADDED).when(F.col("in_to").isNull(), "deleted").otherwise(MODIFIED)
    out = joined.filter(F.col("in_from").isNull() | F.col("in_to").isNull() | changed)
    return out.select(*[f"from_{c}" for c in columns], *[f"to_{c}" for c in columns], kind.alias("diff_type"))


def numbered(df: DataFrame, name: str = "row_no") -> DataFrame:
    """df's rows numbered from 1 in their order, without gathering them: numbers within partitions plus the sizes before.

    Partition sizes, one number for each, are all that the driver sees, and go back as a small table that is joined. The order
    is that of the partitions.
    """
    placed = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect()
    return placed.join(offsets(df.sparkSession, [(r["_p"], r["n"]) for r in sizes]), "_p").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, name)


def offsets(spark, sizes: Sequence[tuple[int, int]], start: int = 0) -> DataFrame:
    """(_p, _before): how many rows come before each part, from the parts' sizes in order; two numbers for each, to be broadcast."""
    rows, total = [], start
    for p, n in sizes:
        rows.append((p, total))
        total += n
    return F.broadcast(spark.createDataFrame(rows, "_p long, _before long"))


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with _p, the number of the range of `order` that a row lies in; ranges ascend, and null comes first.

    The bounds are rows of a sample that is drawn once, so that each run of a plan deals rows alike. `repartitionByRange` draws
    its sample anew each time, and sizes counted in one run don't fit the ranges of another.
    """
    import pyarrow as pa

    spark, names = df.sparkSession, [f"_{i}" for i in range(len(order))]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*[F.col(c).alias(k) for c, k in zip(order, names, strict=True)])
    rows = keys.count()
    drawn = (keys.sample(SAMPLED * n / rows) if rows > SAMPLED * n else keys).orderBy(*names).toArrow()
    cuts = pa.array(sorted({len(drawn) * i // n for i in range(1, n)} - {0}), pa.int64())
    bounds = spark.createDataFrame(drawn.take(cuts), keys.schema).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_bounds"))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length() or 1))])
    own = F.struct(*[F.col(c).alias(k) for c, k in zip(order, names, strict=True)])
    search = F.aggregate(steps, F.lit(0), lambda low, k: F.when(F.get("_bounds", low + k - 1) <= own, low + k).otherwise(low))
    return df.crossJoin(F.broadcast(bounds)).withColumn("_p", search.cast("long")).drop("_bounds")


def latest_by_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key's rows the last one by `order`."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with one key the last in their own order."""
    last = rows.withColumn("_id", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns]), "_id").alias("r"))
    return last.select("r.*")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with rows put in: a row of an existing key replaces it."""
    return table.join(rows, [table[k].eqNullSafe(rows[k]) for k in keys], "left_anti").unionByName(rows, allowMissingColumns=True)
