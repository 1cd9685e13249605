"""Three-way merge of two versions of a table that grew from one base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import jsonx
from palimpsest.operators.diff import any_of, differs

#: What became of a key, seen from both sides.
UNCHANGED = "unchanged"
CONFLICTS = ("divergentModifyConflict", "divergentDeleteConflict")


def three_sides(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with base_<c>, our_<c>, their_<c> and a presence flag of each side (in_base, in_ours, in_theirs).

    The three versions are stacked and gathered by key in one aggregate, which takes one shuffle where two joins take more,
    and combines before it. Keys are unique in each version.
    """
    columns = [c for c in base.columns if c not in keys]
    tagged = [df.select(*keys, *columns, F.lit(i).alias("side")) for i, df in enumerate((base, ours, theirs))]
    stacked = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    value = F.struct(*columns) if columns else F.struct(F.lit(True).alias("_"))
    names = ("base", "our", "their")
    held = stacked.groupBy(*keys).agg(*[F.first(F.when(F.col("side") == i, value), ignorenulls=True).alias(n) for i, n in enumerate(names)])
    flat = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in names for c in columns]
    return held.select(*keys, *flat, *[F.col(n).isNotNull().alias(f"in_{n}") for n in names]).withColumnsRenamed({"in_our": "in_ours", "in_their": "in_theirs"})


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return ~any_of([differs(F.col(f"{a}_{c}"), F.col(f"{b}_{c}")) for c in columns])


def classify(joined: DataFrame, columns: Sequence[str]) -> Column:
    """Of a row of three_sides: which side added, changed or deleted it, and how two changes meet.

    Cells merge one by one: two changes of a row conflict only if some cell was changed to different values on both sides.
    Of an insert on both sides every differing cell conflicts, since there is no base to tell who changed it.
    """
    b, o, t = F.col("in_base"), F.col("in_ours"), F.col("in_theirs")
    ob, tb, ot = _same("our", "base", columns), _same("their", "base", columns), _same("our", "their", columns)
    clash = any_of([differs(F.col(f"our_{c}"), F.col(f"their_{c}")) & differs(F.col(f"our_{c}"), F.col(f"base_{c}")) & differs(F.col(f"their_{c}"), F.col(f"base_{c}")) for c in columns])
    return (
        F.when(~b & o & ~t, "leftAdd").when(~b & ~o & t, "rightAdd").when(~b & ot, "convergentAdd").when(~b, "divergentModifyConflict")
        .when(~o & ~t, "convergentDelete")
        .when(~o, F.when(tb, "leftDelete").otherwise("divergentDeleteConflict")).when(~t, F.when(ob, "rightDelete").otherwise("divergentDeleteConflict"))
        .when(ob & tb, UNCHANGED).when(tb, "leftModify").when(ob, "rightModify").when(ot, "convergentModify")
        .when(clash, "divergentModifyConflict").otherwise("divergentModifyResolved")
    )


def classified(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], documents: Sequence[str] = ()) -> DataFrame:
    """three_sides with op. Columns of JSON in `documents` merge by key: where that succeeds, both sides hold the result."""
    joined = three_sides(base, ours, theirs, keys)
    columns = [c for c in base.columns if c not in keys]
    if not documents:
        return joined.withColumn("op", classify(joined, columns))
    resolved = F.lit(False)
    for c in documents:
        b, o, t = (F.col(f"{s}_{c}") for s in ("base", "our", "their"))
        both = F.col("in_ours") & F.col("in_theirs") & differs(o, t) & differs(o, b) & differs(t, b)
        joined = joined.withColumn("_m", jsonx.json_merge(b, F.when(both, o), F.when(both, t))).withColumn("_ok", both & ~F.col("_m.conflict"))
        joined = joined.withColumns({f"our_{c}": F.when(F.col("_ok"), F.col("_m.merged")).otherwise(o), f"their_{c}": F.when(F.col("_ok"), F.col("_m.merged")).otherwise(t), f"_ok_{c}": F.col("_ok")}).drop("_m", "_ok")
        resolved = resolved | F.col(f"_ok_{c}")
    op = classify(joined, columns)
    return joined.withColumn("op", F.when(resolved & (op == "convergentModify"), "divergentModifyResolved").otherwise(op)).drop(*[f"_ok_{c}" for c in documents])


def merge_counts(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return classified(base, ours, theirs, keys).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def merged_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], on_conflict: str = "ours", documents: Sequence[str] = ()) -> DataFrame:
    """The merged table: cell by cell the side that changed; conflicting rows as `on_conflict` says (ours or theirs)."""
    return resolved(classified(base, ours, theirs, keys, documents), keys, [c for c in base.columns if c not in keys], on_conflict)


def resolved(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], on_conflict: str = "ours") -> DataFrame:
    """The merged table of `classified` rows."""
    conflict = F.col("op").isin(*CONFLICTS)
    side = "our" if on_conflict == "ours" else "their"
    alive = F.when(conflict, F.col(f"in_{on_conflict}")).otherwise(~F.col("op").isin("convergentDelete", "leftDelete", "rightDelete"))

    def cell(c: str) -> Column:
        b, o, t = F.col(f"base_{c}"), F.col(f"our_{c}"), F.col(f"their_{c}")
        merged = F.when(~F.col("in_ours"), t).when(~F.col("in_theirs"), o).when(differs(o, b), o).otherwise(t)
        return F.when(conflict, F.col(f"{side}_{c}")).otherwise(merged).alias(c)

    return rows.filter(alive).select(*keys, *[cell(c) for c in columns])


def side_type(side: str, columns: Sequence[str]) -> Column:
    """What a side did to a conflicting row: added, removed, modified or unmodified."""
    there = F.col("in_ours") if side == "our" else F.col("in_theirs")
    return F.when(~F.col("in_base"), "added").when(~there, "removed").when(_same(side, "base", columns), "unmodified").otherwise("modified")


def conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str], documents: Sequence[str] = ()) -> DataFrame:
    """Conflicting rows as base_<c>, our_<c>, our_diff_type, their_<c>, their_diff_type; a side without the row is null."""
    return conflicting(classified(base, ours, theirs, keys, documents), keys, [c for c in base.columns if c not in keys])


def conflicting(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The conflicts among `classified` rows."""
    rows = rows.filter(F.col("op").isin(*CONFLICTS))

    def of(side: str, there: str) -> list[Column]:
        return [*[F.when(F.col(there), F.col(k)).alias(f"{side}_{k}") for k in keys], *[F.col(f"{side}_{c}") for c in columns]]

    return rows.select(*of("base", "in_base"), *of("our", "in_ours"), side_type("our", columns).alias("our_diff_type"), *of("their", "in_theirs"), side_type("their", columns).alias("their_diff_type"))


def cherry_pick(onto: DataFrame, commit: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """onto with what commit changed against its parent."""
    return merged_rows(parent, onto, commit, keys)


def revert(onto: DataFrame, commit: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """onto without what commit changed: a merge whose base is the commit and whose other side is its parent."""
    return merged_rows(commit, onto, parent, keys)


def bag_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Tables without keys: each row with its three cardinalities, the merged one, and whether both sides changed it.

    A cardinality that one side changed is taken from it; one that both changed is a conflict, even if they agree, and
    ours stays.
    """
    columns = base.columns
    stacked = None
    for i, df in enumerate((base, ours, theirs)):
        one = df.select(*columns, *[F.lit(int(i == j)).cast("long").alias(n) for j, n in enumerate(("base_n", "our_n", "their_n"))])
        stacked = one if stacked is None else stacked.union(one)
    held = stacked.groupBy(*columns).agg(*[F.sum(n).alias(n) for n in ("base_n", "our_n", "their_n")])
    ours_changed, theirs_changed = F.col("our_n") != F.col("base_n"), F.col("their_n") != F.col("base_n")
    return held.withColumn("conflict", ours_changed & theirs_changed).withColumn("merged_n", F.when(ours_changed, F.col("our_n")).otherwise(F.col("their_n")))
