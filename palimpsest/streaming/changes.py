"""Change feeds: produced from two versions, and applied as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import diff


def row_events(before: DataFrame, after: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """(op: insert, update or delete; table; before and after images as structs): what a replica has to do."""
    rows = diff.row_diff(before, after, keys)
    op = F.when(F.col("diff_type") == diff.ADDED, "insert").when(F.col("diff_type") == diff.REMOVED, "delete").otherwise("update")
    images = [F.when(F.col("diff_type") != without, F.struct(*[F.col(f"{side}_{c}").alias(c) for c in df.columns])).alias(name) for side, without, name, df in (("from", diff.ADDED, "before", before), ("to", diff.REMOVED, "after", after))]
    return rows.select(F.lit(table).alias("table"), op.alias("op"), *images)


def wanted(table: str, database: str, do: Iterable[tuple[str, str]] = (), ignore: Iterable[tuple[str, str]] = ()) -> bool:
    """Whether a replica follows a table: the do-list first (if there is one for the database), then the ignore-list."""
    do, ignore = {(d.lower(), t.lower()) for d, t in do}, {(d.lower(), t.lower()) for d, t in ignore}
    me, mine = (database.lower(), table.lower()), {d for d, _ in do}
    if database.lower() in mine and me not in do:
        return False
    return me not in ignore


def net_changes(events: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """Of each key's events the last one by position."""
    return diff.latest_by_key(events, keys, position)


def apply_batch(table: DataFrame, events: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """table after the events: (columns of the table, op, position columns). A delete takes its key out, all else puts it in."""
    last = net_changes(events, keys, position)
    kept = table.join(last.select(*keys), list(keys), "left_anti").select(*table.columns)
    return kept.unionByName(last.filter("op <> 'delete'").select(*table.columns))


def follow(repo, table: str, stream: DataFrame, keys: Sequence[str], position: Sequence[str], checkpoint: str, commit: bool = True, accept: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Apply a stream of events to a table of a repo, a commit for each micro-batch.

    The number of the last batch is kept with the database's state, by checkpoint, and changes with it at once; a batch that was
    applied before a restart is skipped, so that each is applied once. Only buckets that the batch touches are written.
    """
    def step(batch: DataFrame, number: int) -> None:
        done = repo.config.setdefault("positions", {})
        if done.get(checkpoint, -1) >= number:
            return
        last = repo._staged_rows(net_changes(accept(batch) if accept else batch, keys, position))
        repo.begin()  # rows, position and commit become visible together
        try:
            repo.apply_rows(table, last.select(*keys), last.filter("op <> 'delete'").select(*repo.table(table).columns))
            done[checkpoint] = number
            if commit:
                repo.commit(f"batch {number} of {table}", all=True, allow_empty=True)
        except Exception:
            repo.rollback()
            raise
        repo.end()
        repo.clear_staging()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and kind; events later than the watermark are left out by the engine's own rule."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    counted = stream.withWatermark(time, late).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
