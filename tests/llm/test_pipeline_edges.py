"""run() on tables that are empty, have nulls, repeated ids, copies, very long texts and columns of clashing names."""

import random

import corpus_pipeline
from palimpsest.llm import encoding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows, labels=(), more=None):
    df = spark.createDataFrame(rows, DOCS)
    (more(df) if more else df).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    found = corpus_pipeline.run(spark, folder(spark, tmp_path, []))
    assert found.collect() == [] and found.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_pieces"]


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, b, long = words(80), words(80), words(60_000)
    rows = [(None, None, None, None, None), (None, a, "en", None, None), (1, "", "en", "web", 0), (2, b, "en", "web", len(b)), (2, a + " " + words(60), "en", "web", 1), (3, b, "en", "web", len(b)), (4, long, "en", "web", len(long)), (5, " ".join(long.split()[:200]) + " " + words(900), "en", "web", 7)]
    clash = lambda df: df.selectExpr("*", "1 AS ids", "2 AS kept", "'x' AS mix_copy", "3 AS n_pieces", "4 AS score", "5 AS spans", "6 AS node")
    docs = spark.read.parquet(folder(spark, tmp_path, rows, more=clash) + "/documents.parquet")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        stages[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert len(stages["toxicity"]) == 8  # nothing was learned, so nothing goes
    left = sorted((str(r.doc_id), (r.text or "")[:40]) for r in stages["simhash"])
    assert len(left) == 6 and ("3", b[:40]) not in left  # a copy of b, and one of the two texts without words
    cut = {(r.doc_id, r.text) for r in stages["substrings"]}
    assert any(i == 5 and len(t.split()) == 900 for i, t in cut if t) and any(i == 4 and t == long for i, t in cut)
    pieces = encoding.Pieces()
    assert all(pieces.decode(r.ids) == r.text for r in stages["encoding"] if r.text is not None)
