import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, quality, sharding, versions

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "", None, " \t\n", "one", "a b c a b c", "a b c\nd e f\n\na b c\n d e f", "x " * 300, "# ## *$%& |<> !\n#", "é à\x0bü\x0c" * 40, "a\x85b\xa0c \x1c d",
    "the cat sat on the mat the cat sat on the mat\n" * 9, "w1 w2 w3 w4 w5 " * 200, "line\r\nline\r\n", "tail  \n", "same text here", "same text here",
]


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = quality.judge(df, []).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(df.limit(0), []).collect() == []


def test_list_finds_the_rules_that_made_the_labels():
    rng = random.Random(2)
    cuts = {"a": [0.1, 0.5, 0.9], "b": [1.0, 2.0], "c": [5.0]}
    cells = []
    for _ in range(3000):
        bins = (rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 1))
        bad = bins[0] == 3 or (bins[1] == 2 and bins[2] == 0)
        cells.append((bins, (bad, not bad), (0, 0)) if rng.random() < 0.6 else (bins, (0, 0), (bad, not bad)))
    rules = quality.cover(cells, cuts)
    assert {str(r).split("  ")[0] for r in rules} == {"drop if a > 0.9", "drop if b > 2 and c <= 5"} or len(rules) in (2, 3)
    assert all(r.right == r.met for r in rules)


def test_quality_learns_from_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(quality.labelled(docs, labels))
    met = quality.judge(docs, rules).join(labels, "doc_id").filter("NOT base_failed")
    assert met.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.97
    assert quality.fit(quality.labelled(docs, labels.limit(0))) == []
    assert "CASE WHEN" in str(quality.verdict([quality.Rule((quality.Condition("words", True, 5.0),), 1, 1)]))


def test_mixing_and_sharding_equal_their_sql(spark):
    rows = [(i, t, "en", [None, "a", "b", "b"][i % 4], 5, "extra") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "b", 5, "twice"), (3, "one", "en", "b", 5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mix_copy string")
    con = duckdb.connect()
    con.register("frame", df.select("doc_id", "text", "lang", "source", "n_chars").toPandas().astype({"text": object}))
    con.execute("CREATE TABLE documents AS SELECT * REPLACE (CASE WHEN text IS NULL OR text = 'NaN' THEN NULL ELSE text END AS text) FROM frame")
    got = sorted(map(str, (tuple(r) for r in mixing.mix(df.drop("mix_copy")).select("doc_id", "mix_copy", "mix_key").collect())))
    assert got == sorted(map(str, con.sql(f"SELECT doc_id, mix_copy, mix_key FROM ({mixing.SQL})").fetchall()))
    got = sorted(tuple(r) for r in sharding.shard(df, 40).select("doc_id", "size", "shard", "slot", "grown_shard").collect())
    want = sorted(con.sql(f"SELECT DISTINCT doc_id, shard, grown_shard FROM ({sharding.SQL})").fetchall())
    assert sorted({(r[0], r[2], r[4]) for r in got}) == want


def test_shards(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(df, 40).collect()
    by = {}
    for r in rows:
        assert r.size == len(f"é{r.doc_id}".encode()) + 16 and r.text_crc32 == zlib.crc32(f"é{r.doc_id}".encode()) and r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 40 < sum(r.grown_shard == 40 for r in rows) < 160
    grown = {r.doc_id: r.shard for r in sharding.shard(df, 41).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in rows)
    heavy = Counter(r.shard for r in sharding.shard(df, 3, weights=[1, 1, 2]).collect())
    assert 1850 < heavy[2] < 2150
    odd = spark.createDataFrame([(None, None), (None, None), (1, "")], "doc_id long, text string")
    assert sorted(r.size for r in sharding.shard(odd, 2).collect()) == [16, 16, 16]
    assert sharding.shard(odd.limit(0), 2).collect() == []


def test_mixing_rates(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") < 2700, "hot").otherwise("rare").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(df, target={"hot": 0.5, "rare": 0.5}).groupBy("source").count().collect()}
    assert abs(got["hot"] - 1500) < 150 and abs(got["rare"] - 1500) < 400
    assert mixing.mix(df, target={"rare": 1.0}).filter("source = 'hot'").count() == 0
    many = mixing.mix(df, target={"rare": 1.0}, budget=100.0).filter("source = 'rare'").count()
    assert abs(many - 300_000) < 6_000
    assert mixing.mix(df.limit(0)).collect() == []
    keys = [r.mix_key for r in mixing.mix(df).collect()]
    assert keys == sorted(keys)  # one order over all partitions


def brute_digest_sets(text):
    out = []
    for line in (text or "").split("\n"):
        parts = re.split(r"(?<=[.!?])\s+", line) if len(line) > versions.LONG_LINE else [line]
        out += [p for p in parts if p.strip(" \t\n\x0b\x0c\r")]
    return set(out)


def test_versions(spark):
    rng = random.Random(7)
    long = "\n".join(f"line {rng.random()}" for _ in range(700))
    texts = [*TEXTS, long, long + "\nmore", "Sentence one. Sentence two! Third? " * 60, *["\n".join(f"p{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40))) for _ in range(40)]]
    ids = sorted(rng.sample(range(-50, 10_000), len(texts)))
    rows = list(zip(ids, texts, strict=True))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    versions.BLOCK, kept = 9, versions.BLOCK
    found = {r.doc_id: r for r in versions.versions(spark.createDataFrame([(*r, "z") for r in shuffled], "doc_id long, text string, k string")).collect()}
    versions.BLOCK = kept
    assert len(found) == len(rows)
    prints = {}
    for n, (i, t) in enumerate(rows):
        t, after, r = t or "", rows[(n + 1) % len(rows)][1] or "", found[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited == edited
        a, b, c = map(brute_digest_sets, (t, edited, after))
        for near, x in ((r.near_edited, b), (r.near_next, c)):
            assert near == pytest.approx(1.0 if not a and not x else 1 - len(a ^ x) / (len(a) + len(x)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert versions.versions(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = versions.versions(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()
    assert (one.edited, one.near_next, one.near_edited) == ("aa", 1.0, 0.0)


def test_peeling_is_what_finds_differences(spark):
    data = [([1, 2, 3, 4], [3, 4, 5]), ([], [9]), ([7], [7]), ([], []), (list(range(100)), list(range(50, 130))), (list(range(5000)), list(range(3, 9000))), (None, [1])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(data[:-1])], "row long, a array<bigint>, b array<bigint>")
    versions.FIRST, kept = 0.5, versions.FIRST  # tables too small at first: retried with larger ones
    rows = {r.row: r for r in versions.differing(df, ["row"], keep=True).collect()}
    versions.FIRST = kept
    for i, (a, b) in enumerate(data[:-1]):
        r = rows[i]
        assert (sorted(r.ours), sorted(r.theirs)) == (sorted({*a} - {*b}), sorted({*b} - {*a}))
        assert (r.n_ours, r.n_theirs, r["size"]) == (len(r.ours), len(r.theirs), len(a) + len(b))
    assert rows[0].cells >= 24 and rows[4].cells >= 192 and rows[5].cells > 10_000
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
