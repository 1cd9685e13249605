"""Questions over a chain or graph of commits: history, blame, which commit changed what."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.diff import ADDED, MODIFIED, REMOVED, any_of, copies, differs, row_diff
from palimpsest.operators.digest import digests

#: (commit_hash, committer, commit_date, snapshot); the snapshot is None where the table wasn't there.
Version = tuple[str, str, object, DataFrame | None]


def _stamped(df: DataFrame, commit: str, committer: str, date: object) -> DataFrame:
    return df.withColumns({"commit_hash": F.lit(commit), "committer": F.lit(committer), "commit_date": F.lit(date).cast("timestamp")})


def history(versions: Iterable[Version], columns: Sequence[str] | None = None, commits: Sequence[str] | None = None) -> DataFrame:
    """The table's rows at every commit, with commit_hash, committer and commit_date.

    Commits that are not asked for are left out before a plan is made, so that asking for one reads one snapshot. A column that
    a snapshot lacks, or has with another type than the newest one, is null there.
    """
    kept = [v for v in versions if v[3] is not None and (commits is None or v[0] in commits)]
    if not kept:
        raise ValueError("no commit has the table")
    newest = kept[0][3].schema
    names = list(columns or newest.names)
    out = None
    for commit, committer, date, df in kept:
        here = {f.name: f.dataType for f in df.schema}
        aligned = df.select(*[F.col(c) if here.get(c) == newest[c].dataType else F.lit(None).cast(newest[c].dataType).alias(c) for c in names])
        stamped = _stamped(aligned, commit, committer, date)
        out = stamped if out is None else out.unionByName(stamped)
    return out


def shared_history(versions: Sequence[tuple[str, str, object, str]], snapshots: dict[str, DataFrame]) -> DataFrame:
    """history() of (commit_hash, committer, commit_date, content hash): each snapshot is read once, however many commits share it.

    A snapshot's commits are a small table that its rows are joined with.
    """
    if not versions:
        raise ValueError("no commit has the table")
    by: dict[str, list[tuple]] = {}
    for commit, committer, date, content in versions:
        by.setdefault(content, []).append((commit, committer, date))
    newest = snapshots[versions[0][3]].schema
    out = None
    for content, commits in by.items():
        df = snapshots[content]
        here = {f.name: f.dataType for f in df.schema}
        aligned = df.select(*[F.col(f"`{c}`") if here.get(c) == newest[c].dataType else F.lit(None).cast(newest[c].dataType).alias(c) for c in newest.names])
        if len(commits) == 1:
            one = _stamped(aligned, *commits[0])
        else:
            one = aligned.crossJoin(F.broadcast(df.sparkSession.createDataFrame(commits, "commit_hash string, committer string, commit_date timestamp")))
        out = one if out is None else out.unionByName(one)
    return out


def diff_history(pairs: Iterable[tuple[Version, Version | None]], keys: Sequence[str], to_commits: Sequence[str] | None = None) -> DataFrame:
    """Row differences of given (commit, parent) pairs, with to_commit, to_commit_date, from_commit, from_commit_date: a join for
    each pair. For a chain, where each commit is the next one's parent, see chain_diffs.

    A pair whose snapshots are one object (same content hash in the store) has no difference and no plan.
    """
    out = None
    for (commit, _, date, after), parent in pairs:
        if to_commits is not None and commit not in to_commits:
            continue
        before = parent[3] if parent else None
        if after is before:
            continue
        empty = (after if after is not None else before).limit(0)
        one = row_diff(before if before is not None else empty, after if after is not None else empty, keys).withColumns({
            "to_commit": F.lit(commit), "to_commit_date": F.lit(date).cast("timestamp"),
            "from_commit": F.lit(parent[0] if parent else None).cast("string"), "from_commit_date": F.lit(parent[2] if parent else None).cast("timestamp"),
        })
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no commit changed the table")
    return out


def chain_diffs(versions: Sequence[Version], keys: Sequence[str], parents: dict[str, tuple[str, object]] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Row differences of each version of a linear chain against the one before, oldest first in `versions`: to_*, from_*,
    diff_type, to_commit, to_commit_date, from_commit, from_commit_date.

    All versions are stacked with their place and each key's rows compared with the ones before: one shuffle for any number of
    commits, where a join for each pair takes two each. Columns are those of `schema` (of the last version without it); what a
    version lacks, or has of another type, is null. Without keys, rows are counted by version instead. `parents` says which
    commit, and of when, each one is compared with, where that isn't the one before in the chain.
    """
    schema = schema or next(v[3].schema for v in reversed(versions) if v[3] is not None)
    names, spark = schema.names, next(v[3] for v in versions if v[3] is not None).sparkSession
    stacked = None
    for i, (_, _, _, df) in enumerate(versions):
        if df is not None:
            here = {f.name: f.dataType for f in df.schema}
            one = df.select(*[(F.col(f"`{f.name}`") if here.get(f.name) == f.dataType else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields], F.lit(i).alias("_place"))
            stacked = one if stacked is None else stacked.unionByName(one)
    if len(versions) == 1:
        none = [F.lit(None).cast(f.dataType).alias(f"from_{f.name}") for f in schema.fields]
        found = stacked.select(F.col("_place").alias("place"), *[F.col(f"`{c}`").alias(f"to_{c}") for c in names], *none, F.lit(ADDED).alias("diff_type"))
    elif keys:
        others, last = [c for c in names if c not in keys], len(versions) - 1
        w = Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy("_place")
        row = F.struct(*[F.col(f"`{c}`") for c in names])
        walked = stacked.select(row.alias("row"), "_place", F.lag(row).over(w).alias("was"), F.lag("_place").over(w).alias("at"), F.lead("_place").over(w).alias("next"))
        follows = F.coalesce(F.col("at") == F.col("_place") - 1, F.lit(False))
        changed = any_of([differs(F.col("row")[c], F.col("was")[c]) for c in others])
        none = F.lit(None).cast(T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
        kind = F.when(~follows, ADDED).when(changed, MODIFIED)
        gone = (F.col("_place") < last) & F.coalesce(F.col("next") > F.col("_place") + 1, F.lit(True))
        events = F.array(
            F.struct(F.col("_place").alias("place"), F.col("row").alias("new"), F.when(follows, F.col("was")).otherwise(none).alias("old"), kind.alias("diff_type")),
            F.struct((F.col("_place") + 1).alias("place"), none.alias("new"), F.col("row").alias("old"), F.when(gone, REMOVED).alias("diff_type")),
        )
        found = walked.select(F.explode(events).alias("e")).filter("e.diff_type IS NOT NULL").select("e.*")
        found = found.select("place", *[F.col("new")[c].alias(f"to_{c}") for c in names], *[F.col("old")[c].alias(f"from_{c}") for c in names], "diff_type")
    else:
        counted = stacked.groupBy(*[f"`{c}`" for c in names], "_place").agg(F.count(F.lit(1)).alias("n"))
        steps = F.array(F.struct(F.col("_place").alias("place"), F.col("n").alias("by")), F.struct((F.col("_place") + 1).alias("place"), (-F.col("n")).alias("by")))
        moved = counted.select(*[f"`{c}`" for c in names], F.explode(steps).alias("s")).filter(F.col("s.place") < len(versions)).groupBy(*[f"`{c}`" for c in names], F.col("s.place").alias("place")).agg(F.sum("s.by").alias("n"))
        each = copies(moved.filter("n <> 0"), "n")
        to = [F.when(F.col("n") > 0, F.col(f"`{c}`")).alias(f"to_{c}") for c in names]
        of = [F.when(F.col("n") < 0, F.col(f"`{c}`")).alias(f"from_{c}") for c in names]
        found = each.select("place", *to, *of, F.when(F.col("n") > 0, ADDED).otherwise(REMOVED).alias("diff_type"))
    facts = []
    for i, (commit, _, date, _) in enumerate(versions):
        parent = (parents or {}).get(commit) or ((versions[i - 1][0], versions[i - 1][2]) if i else (None, None))
        facts.append((i, commit, date, *parent))
    table = spark.createDataFrame([(i, c, _moment(d), p, _moment(e)) for i, c, d, p, e in facts], "place int, to_commit string, to_commit_date timestamp, from_commit string, from_commit_date timestamp")
    return found.join(F.broadcast(table), "place").drop("place")


def _moment(date: object) -> object:
    return datetime.fromisoformat(date) if isinstance(date, str) else date


def chain_changes(versions: Sequence[Version], keys: Sequence[str]) -> DataFrame:
    """For a linear chain: each key's changes, without a join for each pair of commits.

    All snapshots are stacked with their place in the chain, and each key's rows are compared with those before: one shuffle
    for the whole chain. Gives the key, place, and diff_type of the commits that added, modified or removed it.
    """
    columns = [c for c in versions[-1][3].columns if c not in keys]
    stacked = None
    for i, (_, _, _, df) in enumerate(versions):
        one = df.select(*keys, *columns, F.lit(i).alias("place"))
        stacked = one if stacked is None else stacked.unionByName(one)
    w = Window.partitionBy(*keys).orderBy("place")
    before = {f"_{c}": F.lag(c).over(w) for c in columns}
    walked = stacked.withColumns(before | {"_place": F.lag("place").over(w), "_next": F.lead("place").over(w)})
    same = F.col("_place") == F.col("place") - 1
    changed = any_of([differs(F.col(c), F.col(f"_{c}")) for c in columns])
    kind = F.when(~F.coalesce(same, F.lit(False)), "added").when(changed, "modified")
    gone = (F.col("place") < len(versions) - 1) & (F.col("_next").isNull() | (F.col("_next") > F.col("place") + 1))
    events = F.array(F.struct(F.col("place").alias("place"), kind.alias("diff_type")), F.struct((F.col("place") + 1).alias("place"), F.when(gone, "removed").alias("diff_type")))
    return walked.select(*keys, F.explode(events).alias("e")).filter("e.diff_type IS NOT NULL").select(*keys, "e.place", "e.diff_type")


def blame(versions: Sequence[Version], keys: Sequence[str], messages: Sequence[str] | None = None, emails: Sequence[str] | None = None) -> DataFrame:
    """For each row of the last version of a chain: the commit that last added or modified it, with its date and committer (and
    email and message). The commits are a small table that is joined by place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("place"))
    last = chain_changes(versions, keys).withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND diff_type <> 'removed'")
    more = {n: v for n, v in (("email", emails), ("message", messages)) if v}
    rows = [(i, v[0], _moment(v[2]), v[1], *[x[i] for x in more.values()]) for i, v in enumerate(versions)]
    kinds = "place int, commit string, commit_date timestamp, committer string" + "".join(f", {n} string" for n in more)
    return last.join(F.broadcast(versions[-1][3].sparkSession.createDataFrame(rows, kinds)), "place").select(*keys, "commit", "commit_date", "committer", *more)


def table_hash(df: DataFrame) -> DataFrame:
    """(n, digest): a content hash that no order of rows changes, and that copies of rows do change; one aggregate, combined
    before its shuffle."""
    return digests(df).select("n", F.concat_ws("-", "n", "a", "b", "c", "d").alias("digest"))


def rewritten(versions: Iterable[tuple[str, DataFrame]], change: Callable[[DataFrame], DataFrame]) -> list[tuple[str, DataFrame]]:
    """Every snapshot of a branch passed through one query; snapshots of unchanged content are shared, not done again."""
    done: dict[int, DataFrame] = {}
    return [(commit, done.setdefault(id(df), change(df))) for commit, df in versions]
