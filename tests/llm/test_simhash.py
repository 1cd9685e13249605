import random

import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import components, simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_fingerprints(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, "One two"), (903, "ÀB\x0bC d\x85e F g \t h" * 30), (904, "One two"), (904, "One two")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp int")
    found = simhash.fingerprints(df).collect()
    assert sorted((r.doc_id, r.fp % (1 << 64)) for r in found) == sorted((i, brute_print(t)) for i, t in rows)


def planted(seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            prints.append(at)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                at ^= 1 << b
    return prints + [0, 1, (1 << 64) - 1, (1 << 63) - 1]


def check(spark, prints, verify_up_to):
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in simhash.classes(df, verify_up_to).collect()}
    roots = brute_classes(prints)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(roots[p], i)
    assert found == {i: least[roots[p]] for i, p in enumerate(prints)}


def test_classes_by_halves(spark):
    check(spark, planted(1), 256)


def test_classes_by_whole_balls_where_buckets_are_large(spark):
    check(spark, planted(2), 2)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(3, 7), (3, 7), (None, 7), (5, 8), (None, -1)], "doc_id long, fp long")
    assert sorted(map(str, simhash.classes(df).collect())) == sorted(map(str, df.select("doc_id", "fp", F.when(F.col("fp") > 0, 3).alias("component_id")).collect()))
    assert simhash.classes(df.limit(0)).collect() == []


def test_no_table_goes_through_the_driver(spark, tmp_path):
    """Few fingerprints have many variants, which Spark's guess of sizes doesn't see."""
    spark.range(50).selectExpr("id AS doc_id", "xxhash64(id div 5) ^ shiftleft(1L, cast(id % 5 AS int) * 9) AS fp").write.parquet(f"{tmp_path}/p")
    prints = spark.read.parquet(f"{tmp_path}/p")
    links = simhash.links(prints.select("fp"))
    for df in (links, simhash.classes(prints), components._stars(links)):
        for plan in (df._jdf.queryExecution().executedPlan().toString(), (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]):
            assert "Join" in plan and "Broadcast" not in plan
