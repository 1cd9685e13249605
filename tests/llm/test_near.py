"""The near-duplicate stage against a plain version that compares every two texts."""

import random

import duckdb

import corpus_pipeline
from palimpsest.llm import near
from palimpsest.llm.components import components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    """For each text the least index reachable over similarities of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                i_, j_ = sorted((find(i), find(j)))
                root[j_] = i_
    return [find(i) for i in range(len(texts))]


def planted(seed):
    """Texts of their own, and copies with a few words changed, some of them copies of copies."""
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "two words", "Two  WORDS", "a b c d e", "a b c d e f"]
    for _ in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            for _ in range(max(1, round(len(words) * rng.choice([0.002, 0.01, 0.02, 0.025, 0.04])))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 5000)}"
            texts.append(" ".join(words))
    hot = [f"h{i}" for i in range(300)]
    for i in range(60):
        words = hot[:]
        words[rng.randrange(300)] = f"y{i}"
        texts.append(" ".join(words))
    license = " ".join(f"l{i}" for i in range(30))
    texts += [license + " " + " ".join(f"z{i}_{k}" for k in range(5 + i)) for i in range(40)]
    return texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_from_080_on_go(spark):
    for seed in (1, 2):
        texts = planted(seed)
        ids = random.Random(seed).sample(range(10_000), len(texts))
        order = sorted(range(len(texts)), key=lambda k: ids[k])
        roots = plain_components([texts[k] for k in order])
        want = sorted(ids[order[r]] for r in set(roots))
        got = sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, frame(spark, list(zip(ids, texts, strict=True))).repartition(5), "").collect())
        assert got == want
    assert corpus_pipeline.without_near_copies(spark, frame(spark, []), "").collect() == []


def test_ids_neither_join_nor_lose_rows(spark):
    """Null ids and ids that repeat with other texts; of near copies the first by id, null last, then by text."""
    def text(name, edit=""):
        return " ".join(f"{name}{i}" for i in range(100)) + edit

    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c", " end")), (None, None), (3, text("d")), (3, text("e")), (3, text("e")), (2, text("e", " end")), (4, text("a", " end")), (7, ""), (5, text("f")), (None, text("f"))]
    want = [(None, text("b")), (None, text("c")), (3, text("d")), (2, text("e", " end")), (4, text("a", " end")), (7, ""), (5, text("f"))]
    for n in (1, 6):
        got = corpus_pipeline.without_near_copies(spark, frame(spark, rows).repartition(n), "").collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_no_table_goes_through_the_driver(spark, tmp_path, monkeypatch):
    """Plans of small tables have no broadcast but that of the nodes asked for, and of frequent shingles FREQUENT are known at most."""
    spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(f"a b c d e f{i % 3} g h i j k{i}" for i in range(40))], "node long, t binary").write.parquet(f"{tmp_path}/t")
    texts = spark.read.parquet(f"{tmp_path}/t")
    prints = near.marked(texts)
    roots = spark.createDataFrame([(1, 0)], "node long, root long")
    for df in (near.fitting(near.ball_pairs(prints), prints), near.shared_tokens(prints, roots)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    tokens, counts = near._frequent(texts)
    assert sorted(counts.tolist(), reverse=True) == [40, *[n for n in (14, 13, 13) for _ in range(5)]] and (tokens[1:] > tokens[:-1]).all()
    for most, left in ((16, 16), (15, 6), (5, 1), (0, 0)):
        monkeypatch.setattr(near, "FREQUENT", most)
        assert len(near._frequent(texts)[0]) == left


def test_run_equals_a_plain_version_at_080(spark):
    """run() as a whole, the near copies from 0.8 on by comparing every two texts that share a shingle."""
    from palimpsest.llm import mixing, toxicity
    from tests.llm.test_texts import brute_dedup

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = toxicity.learned(spark, sf)
    channel = model.channel()
    left = {i: r.text or "" for i, r in docs.items() if model.score(model.evidence(channel, r.text or "")) < 0.5}
    assert 0 < len(docs) - len(left) < len(docs) // 4
    ids = sorted(left)
    roots = plain_components([left[i] for i in ids])
    left = {ids[r]: left[ids[r]] for r in set(roots)}
    cut = brute_dedup(list(left.items()))
    left = {i: (cut[i][2] if cut[i][1] else t) for i, t in left.items() if cut[i][1] < cut[i][0] or not cut[i][1]}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, t, docs[i].lang, docs[i].source, len(t)) for i, t in left.items()])
    want = sorted((i, t) for i, t in con.sql(f"SELECT doc_id, text FROM ({mixing.SQL})").fetchall())
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_members_of_a_large_group_meet_by_differences(spark, monkeypatch):
    """Copies of a text with up to five words changed, which are similar to it up to three: few of the pairs left are compared."""
    rng = random.Random(7)
    texts = planted(3)[:40]
    for _ in range(120):
        words = [f"h{i}" for i in range(150)]
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 2, 3, 4, 5])):
            words[at] = rng.choice([f"y{rng.randint(0, 10**6)}", "often", f"z{at}"])
        texts.append(" ".join(words))
    monkeypatch.setattr(near, "FEW", 3)
    made, pairs = near.differing_pairs, []
    monkeypatch.setattr(near, "differing_pairs", lambda *x: (pairs.append(made(*x).distinct().count()), made(*x))[1])
    want = sorted(set(plain_components(texts)))
    monkeypatch.setattr(near, "ROUNDS", 0)
    got = sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, frame(spark, list(enumerate(texts))).repartition(3), "").collect())
    assert got == want
    assert len(pairs) == 1 and pairs[0] < 1_000, pairs


def test_a_node_meets_its_root_once(spark):
    met = spark.createDataFrame([(t, x, 9, *[x] * 4, t) for x in (1, 2, 3) for t in (5, 6, 7)], "token long, node long, n int, f0 long, f1 long, f2 long, f3 long, p int")
    rows = near.rooted(met, spark.createDataFrame([(3, 1)], "node long, root long"))
    assert sorted((r.token, r.node, r.root, r.p) for r in rows.collect()) == [(t, x, {3: 1}.get(x, x), 5) for t in (5, 6, 7) for x in (1, 2, 3)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join LeftOuter") < plan.index("Aggregate")


def test_few_links_are_connected_by_one_task(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-200, 200), rng.randint(-200, 200)) for _ in range(190)] + [(i, i + 1) for i in range(1000, 1040)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = sorted(map(tuple, components(df).collect()))
    assert len(want) > 150 and want == sorted(map(tuple, components(df, 1000).collect())) == sorted(map(tuple, components(df, 150).collect()))
    roots = components(df.limit(60), 1000)
    rest = near.stored(df, "links")
    assert sorted(map(tuple, near.joined(roots, rest).collect())) == want


def stored_plans(monkeypatch):
    """What near.stored is given from now on: (name, plan, rows)."""
    made, real = [], near.stored
    monkeypatch.setattr(near, "stored", lambda df, name: (out := real(df, name), made.append((name, df._jdf.queryExecution().optimizedPlan().toString(), out.count())))[0])
    return made


def test_prefixes_are_dealt_by_token_once(spark, monkeypatch):
    """Tokens of three nodes of two roots, of one root, of one node, and two of the very same nodes."""
    tokens = {1: [10, 11, 12], 2: [10, 11, 13, 14], 3: [11, 12, 13, 14], 4: [10, 15]}
    known = spark.createDataFrame(list(tokens.items()), "node long, tokens array<long>")
    made = stored_plans(monkeypatch)
    found = near.shared_tokens(known, spark.createDataFrame([(4, 1), (3, 2)], "node long, root long"))
    plans = [plan for _, plan, _ in made] + [found._jdf.queryExecution().optimizedPlan().toString()]
    assert sum(plan.count("Generate posexplode") for plan in plans) == 1
    assert sorted(map(tuple, found.collect())) == [(10, 1, 3, 1, 0), (10, 2, 3, 2, 0), (10, 4, 3, 1, 0), (11, 1, 3, 1, 1), (11, 2, 3, 2, 1), (11, 3, 3, 2, 0), (12, 1, 2, 1, 2), (12, 3, 2, 2, 1)]


def test_differences_take_only_texts_that_are_asked_for(spark, monkeypatch):
    texts = spark.createDataFrame([(i, bytearray(f"a b c d e f g h i j k{i % 5}".encode())) for i in range(40)], "node long, t binary")
    made = stored_plans(monkeypatch)
    found = near.differing(spark.createDataFrame([(1, 2), (1, 6), (3, 2)], "hub long, node long"), texts)
    assert sorted((r.hub, r.node, r.linked, r.d) for r in found.collect()) == [(1, 2, False, 2), (1, 6, True, 0), (3, 2, False, 2)]
    assert [n for name, _, n in made if name == "near-texts"] == [4]
