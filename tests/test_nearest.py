import random

from palimpsest.functions import vectors


def test_nearest_to_each_query_over_several_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(60)] + [(98, None), (99, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.BLOCK, kept = 7, vectors.BLOCK
    found = vectors.nearest_each(df, "embedding", df.filter("vec_id % 2 = 0"), "embedding", 4, "vec_id", "vec_id").collect()
    assert vectors.nearest_each(df, "embedding", df.filter("vec_id = 1000"), "embedding", 4, "vec_id", "vec_id").collect() == []
    vectors.BLOCK = kept
    want = [(i, k, d) for i, v in rows if i % 2 == 0 and v for d, k in sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in rows if w and len(w) == len(v))[:4]]
    assert sorted(map(tuple, found)) == sorted(want)
