"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import digest52, read, unit
from palimpsest.llm.quality import _let

SEED = "shard"
#: Ranges of a key's digest that a shard is cut into for numbering its rows; no task numbers a whole shard.
RANGES = 256


def race(key: Column, shard: Column, weight: Column, seed: str = SEED) -> Column:
    """The time at which a shard wins a key: exponential with the shard's weight as rate, so the first to win takes it."""
    return -F.ln(unit(F.lit(seed), key, shard)) / weight


def rendezvous(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """The shard (0 to len(weights) - 1) that wins the key. Only the key, the weights and the seed count.

    A further shard wins a key only from what the others had; taking one away deals out its keys alone.
    A null key is one key like any other. Weights are positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    return F.array_min(times(key, weights, seed))["i"]


def times(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """Each shard's time for the key, with the shard's number."""
    lanes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    return F.transform(lanes, lambda s: F.struct(race(key, s["i"], s["w"], seed).alias("t"), s["i"].alias("i")))


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None, overhead: int = 16) -> DataFrame:
    """Per row: the key, size, text_crc32, law, shard, slot (gapless in the shard) and the shard with one more shard.

    Slots follow the digest of the key, then the key; rows of one key and text may swap slots, being equal.
    A null text has no bytes. An empty table gives no rows. Other columns of df are neither read nor kept.
    The numbering shuffles keys and sizes, no texts: rows are counted by shard and digest range (at most
    n_shards * RANGES counts, which bounds what is broadcast), then numbered within their range.
    """
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    both = _let(times(key, [*weights, sum(weights) / n_shards]), lambda t: F.struct(F.array_min(F.slice(t, 1, n_shards))["i"].alias("shard"), F.array_min(t)["i"].alias("grown_shard")))
    placed = df.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        both.alias("both"),
        digest52(F.lit(SEED), key).alias("at"),
    ).select("doc_id", "size", "text_crc32", "both.shard", "both.grown_shard", "at", F.shiftright("at", 44).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at", "doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op10_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"), 40)


def _digest(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 13) AS BIGINT)"


SQL = f"""
WITH lanes AS (SELECT unnest(range(41)) AS i),
times AS (
  SELECT doc_id, i, -ln(({_digest("'shard:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || i")} + 0.5) / 4503599627370496.0) AS t
  FROM documents CROSS JOIN lanes),
won AS (SELECT doc_id, CAST(arg_min(i, t) FILTER (WHERE i < 40) AS INTEGER) AS shard, CAST(arg_min(i, t) AS INTEGER) AS grown_shard FROM times GROUP BY doc_id),
table256 AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
summed AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * coalesce(strlen(text), 0), 2), lambda p: CAST('0x' || substr(h, p, 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
  FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), table256)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY {_digest("'shard:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")}, doc_id, text_crc32) - 1 AS slot,
  grown_shard
FROM summed JOIN won USING (doc_id)
"""
