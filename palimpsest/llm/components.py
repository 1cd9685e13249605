"""Connected components of a graph of long ids, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, shuffled, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Edges are (a, b), a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(shuffled(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(shuffled(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return small.filter("a > b").distinct()


def _settled(batches: Iterator) -> Iterator:
    """The result from all edges in one task."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["node", "root"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) of every node with an edge that isn't its component's least id. Edges: (a, b) in any order.

    Alternating large and small stars (Kiveris et al., 2014) need a number of rounds that grows with the logarithm of the
    component, not with its diameter. Each round's edges are a table in the shared folder; a node with many edges is met
    by sums that combine before the shuffle and by joins that Spark can split. An empty table gives no rows. From `few` edges on down
    one task settles what is left, as many rounds over next to no rows would.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots._palimpsest_path = now._palimpsest_path
            return roots
        if state[0] <= few:
            roots = stored(now.coalesce(1).mapInArrow(_settled, "node long, root long"), "roots")
            discard(now)
            return roots
        before, last, now = state, now, stored(_stars(now), "edges")
        discard(last)
