import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language


def brute_length(rows, lang, text, alphabet_seen):
    """Bits of text under one language's tree, straight from the counts."""
    counts = {}
    for x, order, gram, n in rows:
        if x == lang:
            counts.setdefault((order, gram >> 8), {})[gram & 255] = n

    def cost(context, b):
        known = counts.get((len(context), int.from_bytes(context, "big")))
        lower = 8.0 if not context else cost(context[1:], b)
        if not known:
            return lower
        n, d = sum(known.values()), len(known)
        return -math.log2(known[b] / (n + d)) if b in known else -math.log2(d / (n + d)) + lower

    bits = 0.0
    for i, b in enumerate(text):
        context = text[max(0, i - language.ORDER) : i]
        while any(c not in alphabet_seen for c in context):
            context = context[1:]
        bits += cost(context, b) if b in alphabet_seen else cost(context, b)
    return bits


def test_code_lengths_equal_a_walk_over_the_trees(spark):
    rng = random.Random(1)
    train = [("aa", "".join(rng.choice("abc ") for _ in range(300))), ("bb", "".join(rng.choice("bcdé ") for _ in range(300)))]
    df = spark.createDataFrame(train, "lang string, text string")
    rows = sorted((r.lang, r.ord, r.gram, r.n) for r in language.gram_counts(df).collect())
    trees = language.Trees(rows)
    seen = {g for _, o, g, _ in rows if o == 0}
    texts = [b"abca", b"", "dé zz日 abc".encode(), b"q", "abcd ".encode() * 40]
    got = trees.lengths(texts)
    for t, bits in zip(texts, got, strict=True):
        for lang, x in zip(trees.langs, bits, strict=True):
            assert x == pytest.approx(brute_length(rows, lang, t, seen), rel=1e-4)
    language.CHUNK, kept = 7, language.CHUNK
    assert trees.lengths(texts) == pytest.approx(got, rel=1e-5)
    language.CHUNK = kept


def test_held_out_accuracy(spark):
    r = language.op3_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert r.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 34 ½ _", "a"), (4, "hello there", None), (5, "hello", "en"), (5, "hello", "en")], "doc_id long, text string, lang string")
    trees = language.fit(df.select("lang", "text"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, trees).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("a", "en") and 0 <= got[4][1] <= 1
    nothing = language.fit(df.select("lang", "text").limit(0))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}
    assert language.predict(df.limit(0), trees).collect() == []


def test_a_sample_takes_copies_one_by_one(spark, monkeypatch):
    """5,000 copies among 5,100 rows: about ROWS_PER_LANGUAGE rows are read, not all copies or none."""
    seen = {}

    def counted(sample):
        seen["rows"] = sample.count()
        return spark.createDataFrame([], "lang string, ord int, gram long, n long")

    monkeypatch.setattr(language, "gram_counts", counted)
    df = spark.range(5100).selectExpr("'en' AS lang", "IF(id < 5000, 'one text', concat('text ', id)) AS text", "id AS row")
    language.fit(df)
    assert abs(seen["rows"] - language.ROWS_PER_LANGUAGE) < language.ROWS_PER_LANGUAGE // 10
