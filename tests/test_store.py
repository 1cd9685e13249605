"""How tables are stored: digests that tell contents apart, pieces that versions share, and what an operation reads and writes."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff, history, merge
from palimpsest.plans.dialect import mysql_to_spark, statements, tree
from palimpsest.plans.sql import Session
from palimpsest.plans.store import Broken, Conflict, Repo
from palimpsest.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def repo(spark, tmp_path):
    clock = iter(datetime(2024, 1, 1) + timedelta(hours=i) for i in range(10_000))
    return Repo(spark, str(tmp_path / "db"), now=lambda: next(clock), rows_per_bucket=64)


def numbers(spark, n, changed=()):
    return spark.range(n).select(F.col("id").alias("pk"), F.when(F.col("id").isin([*changed]), F.lit("new")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("c"))


def pieces(repo, table, spec="WORKING"):
    return {k: p[0] for k, p in repo.store.meta(repo.manifest(spec)[table])["pieces"].items()}


def test_copies_of_rows_count(spark, repo):
    """Two equal rows don't cancel out: each content has its own hash and its own rows."""
    one = lambda v, n: spark.createDataFrame([(v,)] * n, "v int")
    hashes = set()
    for v, n in ((0, 2), (9, 2), (0, 4), (0, 1)):
        hashes.add(repo.write_table("t", one(v, n)))
        assert rows(repo.table("t")) == [(v,)] * n
    assert len(hashes) == 4
    a, b = (history.table_hash(spark.createDataFrame(x, "a int, b int")).first().digest for x in ([(1, None)], [(None, 1)]))
    assert a != b


def test_nested_values_have_hashes_of_their_own(spark, repo):
    kinds = "k int, a array<int>, m map<string,int>, s struct<x:int,y:int>"
    seen = set()
    for r in [(1, [1, None], {"a": 1}, (1, None)), (1, [None, 1], {"a": 1}, (1, None)), (1, [1, None], {"a": 2}, (1, None)), (1, [1, None], {"a": 1}, (None, 1)), (1, None, None, None)]:
        seen.add(repo.write_table("t", spark.createDataFrame([r], kinds), ["k"]))
        assert repo.table("t").count() == 1
    assert len(seen) == 5


def test_a_change_writes_the_touched_buckets_alone(spark, repo):
    repo.write_table("t", numbers(spark, 1000), ["pk"])
    repo.commit("one", all=True)
    before = pieces(repo, "t")
    assert len(before) == 16
    repo.update("t", {"c": "'x'"}, "pk = 77")
    after = pieces(repo, "t")
    assert sum(before[k] != after[k] for k in before) == 1
    repo.insert("t", spark.createDataFrame([(5000, "y")], "pk long, c string"))
    repo.delete("t", "pk IN (1, 2)")
    last = pieces(repo, "t")
    assert sum(before[k] != last[k] for k in before) <= 4 and repo.table("t").count() == 999 == repo.row_count("t")
    assert rows(repo.diff("HEAD", "WORKING", "t").select("to_pk", "from_pk", "diff_type")) == [(5000, None, "added"), (77, 77, "modified"), (None, 1, "removed"), (None, 2, "removed")]
    again = Repo(spark, repo.root)
    assert rows(again.table("t")) == rows(repo.table("t"))


def test_content_has_one_hash_however_it_came(spark, repo):
    h = repo.write_table("t", numbers(spark, 1000, [5]), ["pk"])
    repo.write_table("t", numbers(spark, 1000), ["pk"])
    repo.update("t", {"c": "'new'"}, "pk = 5")
    assert repo.hash_of_table("t") == h
    other = Repo(spark, repo.root + "2", rows_per_bucket=1000)
    assert other.write_table("t", numbers(spark, 1000, [5]), ["pk"]) == h and other.store.meta(h)["buckets"] < repo.store.meta(h)["buckets"]


def test_versions_of_different_bucket_counts_compare(spark, repo):
    small = repo.store.write("t", numbers(spark, 100), ["pk"], {})
    large = repo.store.write("t", numbers(spark, 1000, [3]), ["pk"], {})
    assert repo.store.meta(small)["buckets"] < repo.store.meta(large)["buckets"]
    a, b = repo.store.both(small, large)
    assert diff.row_diff(a, b, ["pk"]).groupBy("diff_type").count().orderBy("diff_type").collect() == [("added", 900), ("modified", 1)]
    same = repo.store.write("t", numbers(spark, 1000), ["pk"], {})
    buckets, n = repo.store.differing(large, same)
    assert len(buckets) == 1 and n == 16 and repo.store.equal_rows(large, same) == 1000 - repo.store.read(same, buckets, n).count()


def test_a_diff_reads_buckets_that_differ(spark, repo):
    repo.write_table("t", numbers(spark, 1000), ["pk"])
    repo.commit("one", all=True)
    repo.update("t", {"c": "'x'"}, "pk = 77")
    repo.commit("two", all=True)
    for df in (repo.diff("HEAD~1", "HEAD", "t"), repo.diff_stat("HEAD~1", "HEAD", "t"), repo.column_diffs().filter("message = 'two'")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "vc_bucket" in plan.split("PartitionFilters")[1]
    assert repo.diff_stat("HEAD~1", "HEAD", "t").first().rows_unmodified == 999


def test_a_merge_takes_buckets_of_one_side_by_reference(spark, repo):
    repo.write_table("t", numbers(spark, 1000), ["pk"])
    repo.commit("base", all=True)
    repo.create_branch("other")
    repo.update("t", {"c": "'ours'"}, "pk = 10")
    repo.commit("ours", all=True)
    repo.checkout("other")
    repo.update("t", {"c": "'theirs'"}, "pk IN (10, 500)")
    repo.commit("theirs", all=True)
    base, theirs = pieces(repo, "t", "HEAD~1"), pieces(repo, "t", "HEAD")
    repo.checkout("main")
    assert repo.preview_merge("main", "other") == [("t", 1, 0)]
    assert repo.merge("other")["conflicts"] == 1
    now = pieces(repo, "t")
    shared = [k for k in now if base[k] == now[k]]
    assert len(shared) == 14 and sum(now[k] == theirs[k] != base[k] for k in now) == 1
    repo.resolve_conflicts("t", "theirs")
    repo.commit("merged", all=True)
    assert rows(repo.table("t", "HEAD").filter("pk IN (10, 500)")) == [(10, "theirs"), (500, "theirs")]


def test_one_writer_takes_a_state(spark, repo):
    repo.write_table("t", numbers(spark, 10), ["pk"])
    a, b = Repo(spark, repo.root), Repo(spark, repo.root)
    a.tag("one")
    with pytest.raises(Conflict):
        b.tag("two")
    for i in range(40):  # past a file with the whole state
        a.tag(f"t{i}")
    c = Repo(spark, repo.root)
    assert {*c.refs["tag"]} == {"one", *(f"t{i}" for i in range(40))} and c.graph.commits.keys() == a.graph.commits.keys() and c.reflog == a.reflog


def test_history_and_diffs_of_a_chain_are_one_shuffle(spark, repo):
    for i in range(12):
        repo.write_table("t", numbers(spark, 300, range(i)), ["pk"])
        repo.commit(f"c{i}", all=True)
    plan = repo.diff_table("t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert repo.diff_table("t").groupBy("diff_type").count().orderBy("diff_type").collect() == [("added", 300), ("modified", 11)]
    for i in range(3):
        repo.write_table("u", numbers(spark, 5), ["pk"])
        repo.commit(f"u{i}", all=True, allow_empty=True)
    assert repo.history("t").count() == 300 * 15
    assert repo.history("u")._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(diff, "COPIES", 10)
    df = spark.createDataFrame([("a", 25), ("b", 10), ("c", 0), ("d", -3)], "c string, n long")
    assert rows(diff.copies(df, "n").groupBy("c").count()) == [("a", 25), ("b", 10), ("d", 3)]


def test_rules_hold(spark, repo):
    s = Session(repo)
    s.run_script("CREATE TABLE t (id INT PRIMARY KEY, u INT, UNIQUE KEY u (u)); INSERT INTO t VALUES (1, 1), (2, NULL), (3, NULL)")
    with pytest.raises(Broken):
        s.sql("INSERT INTO t VALUES (4, 1)")
    s.sql("REPLACE INTO t VALUES (5, 1)")
    assert rows(repo.table("t")) == [(2, None), (3, None), (5, 1)]
    s.sql("INSERT IGNORE INTO t VALUES (6, 1), (7, 7), (8, 7)")
    assert repo.table("t").filter("u = 7").count() == 1 and repo.table("t").filter("u = 1").count() == 1


def test_csv_is_split_unless_a_field_spans_lines(spark, tmp_path):
    plain, odd = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    with open(plain, "w") as f:
        f.write("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(2000)))
    with open(odd, "w") as f:
        f.write('a,b\n1,"x\ny"\n2,z\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        df = files.read_csv(spark, plain)
        assert df.rdd.getNumPartitions() > 2 and df.count() == 2000 and df.filter("a = '7'").first().b == 'x, "7"'
        assert rows(files.read_csv(spark, odd)) == [("1", "x\ny"), ("2", "z")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_document(spark, tmp_path):
    path = str(tmp_path / "out.json")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, 'q"')], "i int, s string").repartition(3)
    files.write_any(df, path)
    assert rows(files.read_json(spark, path).select("i", "s")) == rows(df)
    files.write_any(df.limit(0), path)
    assert open(path).read() == '{"rows": []}'


def test_tokens():
    assert mysql_to_spark("SELECT 'length(x)', \"as signed)\", length(x)") == "SELECT 'length(x)' , 'as signed)' , octet_length(x)"
    assert mysql_to_spark("concat(f(a, (b)), 'x)')") == "concat(f(a , (b)) , 'x)')"
    assert list(statements("a /* ; */; CREATE PROCEDURE p() BEGIN SELECT 1; SELECT 2; END; b # c\n")) == ["a", "CREATE PROCEDURE p() BEGIN SELECT 1; SELECT 2; END", "b"]
    with pytest.raises(ValueError):
        tree("SELECT (1")


def test_nested_arguments(spark, repo):
    s = Session(repo)
    s.run_script("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1); CALL vc_commit('-Am', 'one'); CALL vc_tag(concat('v', 1)); INSERT INTO t VALUES (2); SET @x = 'v'")
    assert s.sql("SELECT COUNT(*) AS n FROM vc_diff(concat(@x, trim(' 1 ')), upper('working'), 't') WHERE (diff_type IN ('added'))").first().n == 1
    assert s.sql("SELECT vc_hashof(concat('HE', 'AD')) = (SELECT commit_hash FROM vc_log ORDER BY commit_order DESC LIMIT 1) AS same").first().same


def test_delete_against_modify(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "pk int, c string, n int")
    gone, changed = base.limit(0), base.withColumn("n", F.col("n") + F.when(F.col("pk") == 2, 1).otherwise(0))
    got = {r.pk: r.op for r in merge.classified(base, gone, changed, ["pk"]).collect()}
    assert got == {1: "leftDelete", 2: "divergentDeleteConflict"}


def test_lookups_read_a_bucket(spark, repo):
    s = Session(repo)
    repo.write_table("t", numbers(spark, 1000), ["pk"])
    df = s.sql("SELECT c FROM t WHERE pk = 7")
    assert rows(df) == [("v7",)] and "vc_bucket" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert s.sql("SELECT c FROM t WHERE pk = 7 OR pk = 8").count() == 2 and s.sql("SELECT count(*) AS n FROM t WHERE pk > 7").first().n == 992
    s.sql("CREATE INDEX i ON t (c)")
    assert rows(repo.index_lookup("t", "i", "c IN ('v3', 'v9')")) == [(3, "v3"), (9, "v9")]


def test_logs_and_schemas_as_text(spark, repo):
    from palimpsest.plans import show

    s = Session(repo)
    s.run_script("""CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, c VARCHAR(9) DEFAULT 'x', CHECK (c <> 'y')); INSERT INTO t (c) VALUES ('a'); CALL vc_commit('-Am', 'one');
        CALL vc_branch('side'); INSERT INTO t (c) VALUES ('b'); CALL vc_commit('-am', 'two'); CALL vc_checkout('side'); UPDATE t SET c = 'z' WHERE id = 1; CALL vc_commit('-am', 'three'); CALL vc_checkout('main'); CALL vc_merge('side')""")
    assert [x.split(" ", 1)[1] for x in show.oneline(repo, limit=2)] == ["(main) Merge side into main", "(side) three"] or len(show.oneline(repo, limit=2)) == 2
    lines = show.graph(repo)
    assert sum("*" in x for x in lines) == 5 and any(x.startswith(("* |", "| *")) for x in lines)
    assert {(t, c["rows_added"], c["rows_modified"]) for _, t, c in show.stat(repo, "HEAD~1..HEAD")} >= {("t", 0, 1)}
    again = Session(Repo(spark, repo.root + "-again"))
    again.run_script(show.schema_export(repo))
    assert show.schema_export(again.repo) == show.schema_export(repo) and show.indexes(repo, "t") == []
    assert [x[:2] for x in show.schema_tags(repo)] == [("t", "id"), ("t", "c")]
    s.sql("CALL vc_update_column_tag('t', 'c', '77')")
    assert show.schema_tags(repo)[1] == ("t", "c", 77)


def test_partial_imports_and_results_as_text(spark, repo, tmp_path):
    from palimpsest.plans import show

    path = str(tmp_path / "u.csv")
    repo.write_table("t", spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "pk int, c string, n int"), ["pk"])
    repo.commit("one", all=True)
    with open(path, "w") as f:
        f.write("pk,n\n2,20\n3,30\n")
    files.load(repo, "t", path, mode="update")
    assert rows(repo.table("t")) == [(1, "a", 1), (2, "b", 20), (3, None, 30)]
    assert show.diff_text(repo, "HEAD", "WORKING", "t")[0] == "  | c | n | pk" and sorted(show.diff_text(repo, "HEAD", "WORKING", "t")[1:]) == ["+ | NULL | 30 | 3", "< | b | 2 | 2", "> | b | 20 | 2"]
    assert show.diff_json(repo, "HEAD", "WORKING")["tables"][0]["name"] == "t"
    assert rows(files.read_lines(spark, ["a,b", '1,"x"', "2,"])) == [("1", "x"), ("2", None)]
    df = spark.createDataFrame([(1, "x,y"), (2, None)], "i int, s string").coalesce(1)
    assert files.render(df, "csv") == 'i,s\n1,"x,y"\n2,\n' and files.render(df, "json") == '{"rows": [{"i":1,"s":"x,y"},{"i":2}]}' and "INSERT INTO `t`" in files.render(df, "sql")
