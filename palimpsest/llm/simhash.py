"""SimHash fingerprints and near-duplicate components by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, read, shuffled, stored
from palimpsest.llm.components import components

SHINGLE, SEED = 4, 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is in over half of the XXH64 (seed 42) of the shingles; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        ends, starts = [len(joined)], [0]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        ends = (ends[shingle - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id and the fingerprint as a long of the same bits. A null text has no words."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


#: Radius of a link; a pair this close has a half (32 bits) that differs in no more than two bits.
RADIUS = 4
#: In a bucket of up to so many different fingerprints the colliding pairs are verified one by one. The members of larger
#: ones meet on all variants of their 64 bits instead, where a bucket is a clique and its pairs need not be listed.
VERIFY_UP_TO = 256


def _masks(bits: int, radius: int) -> list[int]:
    out = [0] + [1 << i for i in range(bits)]
    if radius > 1:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _variants(column, masks: list[int]):
    return F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: column.bitwiseXOR(m)))


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among different fingerprints that connect all within RADIUS: whole balls of 64 bits.

    Every fingerprint emits its 2,081 variants within half the radius. Two that meet on a variant are within RADIUS of each
    other, and any two within RADIUS meet; so a star around the least of each bucket (2,081 members at most) says it all.
    """
    met = fps.select(_variants(F.col("fp"), _masks(64, 2)).alias("v"), "fp")
    hubs = met.withColumn("hub", F.min("fp").over(Window.partitionBy("v")))
    return hubs.filter("fp > hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def _meets_here(v: Column, x: Column, y: Column) -> Column:
    """Whether v is the one variant on which a pair x < y counts, of those that both emit: in the upper half if that is near
    enough, and there x itself or, of two differing bits, x with the lower one changed."""
    low = (1 << 32) - 1
    upper, apart = F.shiftrightunsigned(v, 32) == 1, x.bitwiseXOR(y)
    differing = F.when(upper, F.shiftrightunsigned(apart, 32)).otherwise(apart.bitwiseAND(low))
    own = F.when(upper, F.shiftrightunsigned(x, 32)).otherwise(x.bitwiseAND(low))
    step = F.when(F.bit_count(differing) == 2, differing.bitwiseAND(-differing)).otherwise(F.lit(0).cast("long"))
    return (upper | (F.bit_count(F.shiftrightunsigned(apart, 32)) > 2)) & (v.bitwiseAND(low) == own.bitwiseXOR(step))


def links(fps: DataFrame, verify_up_to: int = VERIFY_UP_TO) -> DataFrame:
    """Links (a, b) that connect all different fingerprints within RADIUS and no others.

    Meet in the middle by halves: of two fingerprints within four bits, one half is within two, so every fingerprint emits
    the variants of each half within half of that (2 * 33 rows, where whole balls take 2,081), and those that share a
    variant are verified, each pair on one of the variants that both emit. Members of a bucket with more than `verify_up_to` meet by whole balls (ball_links).
    """
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half = F.transform(F.array(*[F.lit(m) for m in _masks(32, 1)]), lambda m: F.shiftrightunsigned("fp", 32).bitwiseXOR(m).bitwiseOR(1 << 32))
    other = F.transform(F.array(*[F.lit(m) for m in _masks(32, 1)]), lambda m: F.col("fp").bitwiseAND((1 << 32) - 1).bitwiseXOR(m))
    met = fps.repartition(partitions).select(  # dealt in turns, since one by fp would be dropped as redundant after an aggregate that left few tasks
        F.explode(F.concat(half, other)).alias("v"), "fp"
    )
    sizes = met.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = met.join(shuffled(sizes.filter(F.col("n") <= verify_up_to)), "v").groupBy("v").agg(F.collect_list("fp").alias("fps"))
    close = F.flatten(F.transform("fps", lambda x: F.transform(F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS) & _meets_here(F.col("v"), x, y)), lambda y: F.struct(y.alias("a"), x.alias("b")))))
    verified = buckets.select(F.explode(close).alias("e")).select("e.a", "e.b")
    dense = met.join(shuffled(sizes.filter(F.col("n") > verify_up_to)), "v", "left_semi").select("fp").distinct()
    return verified.union(ball_links(dense)).distinct()


def classes(prints: DataFrame, verify_up_to: int = VERIFY_UP_TO) -> DataFrame:
    """(doc_id, fp) with component_id, the least doc_id whose fingerprint is reachable over links (its own included).

    Equal fingerprints are one node, so copies add no pairs. Rows without words (fingerprint 0) link like any other; a null
    doc_id is nobody's least. An empty table gives no rows.
    """
    prints = stored(prints, "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp"), verify_up_to))
    placed = least.join(shuffled(roots), least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(shuffled(placed.join(shuffled(firsts), "root").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir):
    found = classes(fingerprints(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
