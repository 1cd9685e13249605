from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import jsonx, mysql, spatial
from palimpsest.operators import constraints, diff, merge, patch, schema, stats
from palimpsest.plans import quality_tests
from palimpsest.plans.graph import Commit, Graph, split_range
from palimpsest.plans.sql import Session, mysql_to_spark, spark_type, statements
from palimpsest.plans.store import Conflict, Repo, ignored, matches
from palimpsest.sources import files
from palimpsest.streaming import changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def repo(spark, tmp_path):
    clock = iter(datetime(2024, 1, 1) + timedelta(hours=i) for i in range(10_000))
    return Repo(spark, str(tmp_path / "db"), now=lambda: next(clock))


def table(spark, data, kind="pk int, c string, n int"):
    return spark.createDataFrame(data, kind)


# --- graph


def graph():
    edges = [("r", ()), ("a", ("r",)), ("b", ("a",)), ("x", ("a",)), ("m", ("b", "x")), ("p", ("b",)), ("q", ("x", "b"))]
    return Graph(Commit(h, p, datetime(2024, 1, 1 + i), tables={"t": h}) for i, (h, p) in enumerate(edges))


def test_graph():
    g = graph()
    assert g.ancestors("m") == {"m", "b", "x", "a", "r"} and g.merge_base("b", "x") == "a" and g.merge_base("m", "q") == "x"
    assert [c.hash for c in g.log(["m"], ["b"])] == ["m", "x"] and g.ahead_behind("b", "m") == (2, 0)
    assert g.walk("m", "~2") == "a" and g.walk("m", "^2") == "x" and g.walk("m", "^2~1") == "a" and g.walk("m", "~") == "b"
    assert g.as_of("m", datetime(2024, 1, 2, 5)) == "a" and g.as_of("m", datetime(2023, 1, 1)) is None
    assert split_range("a..b") == ("..", "a", "b") and split_range("a...b") == ("...", "a", "b") and split_range("ab") is None and split_range("..b") == ("..", "HEAD", "b")
    with pytest.raises(ValueError):
        g.walk("r", "~1")


def test_patterns():
    assert matches("a%", "abc") and matches("a?c", "abc") and not matches("a?", "abc") and matches("*", "x.y")
    assert ignored("tmp_keep", [("tmp_*", True), ("tmp_keep", False)]) is False and ignored("tmp_x", [("tmp_*", True)])
    with pytest.raises(ValueError):
        ignored("ab", [("a*", True), ("*b", False)])


# --- differences


def test_row_diff_and_stat(spark):
    a = table(spark, [(1, "x", None), (2, "y", 5), (3, None, None), (4, "z", 1)])
    b = table(spark, [(1, "x", None), (2, "y", None), (4, "z", 1), (None, "q", 2)])
    got = {(r.to_pk, r.from_pk): r.diff_type for r in diff.row_diff(a, b, ["pk"]).collect()}
    assert got == {(2, 2): "modified", (None, 3): "removed", (None, None): "added"}
    s = diff.diff_stat(a, b, ["pk"], "t").first()
    assert (s.rows_unmodified, s.rows_added, s.rows_deleted, s.rows_modified, s.cells_modified, s.cells_added, s.cells_deleted) == (2, 1, 1, 1, 1, 3, 3)
    skinny = diff.row_diff(a.filter("pk = 2"), b.filter("pk = 2"), ["pk"], skinny=True)
    assert skinny.columns == ["to_pk", "to_n", "from_pk", "from_n", "diff_type"]
    wider = diff.row_diff(a, b.withColumn("d", F.lit(7)), ["pk"])
    assert "to_d" in wider.columns and "from_d" not in wider.columns and wider.filter("diff_type = 'modified'").count() == 3
    renamed = diff.row_diff(a, b.withColumnRenamed("n", "k"), ["pk"], renamed={"n": "k"})
    assert renamed.filter("diff_type = 'modified'").count() == 1
    assert diff.row_diff(a, a, ["pk"]).count() == 0


def test_bags(spark):
    a, b = table(spark, [(1,), (1,), (2,), (None,)], "v int"), table(spark, [(1,), (2,), (2,), (2,), (None,)], "v int")
    assert sorted((r.to_v, r.from_v, r.diff_type) for r in diff.row_diff(a, b, []).collect() if r.to_v) == [(2, None, "added")] * 2
    assert diff.bag_diff(a, b).filter("diff_type = 'removed'").count() == 1
    m = {r.v: (r.merged_n, r.conflict) for r in merge.bag_merge(a, b, a.union(a.filter("v = 2"))).collect()}
    assert m == {1: (1, False), 2: (3, True), None: (1, False)}


def test_query_diff_by_place(spark):
    a, b = table(spark, [("a",), ("b",), ("c",)], "v string").coalesce(1), table(spark, [("a",), ("c",)], "v string").coalesce(1)
    assert rows(diff.query_diff(a, b).select("from_v", "to_v", "diff_type")) == [("b", "c", "modified"), ("c", None, "deleted")]


def three(spark):
    base = table(spark, [(i, "b", i) for i in range(1, 9)])
    ours = table(spark, [(1, "o", 1), (2, "b", 2), (4, "b", 4), (5, "o", 5), (6, "o", 6), (7, "b", 7), (8, "b", 8), (20, "n", 0), (21, "n", 1)])
    theirs = table(spark, [(1, "b", 1), (2, "t", 2), (3, "b", 3), (5, "o", 5), (6, "t", 60), (7, "t", 7), (20, "n", 0), (21, "n", 2), (22, "r", 1)])
    return base, ours, theirs


def test_merge_and_its_mirror(spark):
    b, o, t = three(spark)
    got = {r.pk: r.op for r in merge.classified(b, o, t, ["pk"]).collect()}
    assert got == {1: "leftModify", 2: "rightModify", 3: "leftDelete", 4: "rightDelete", 5: "convergentModify", 6: "divergentModifyConflict", 7: "rightModify", 8: "rightDelete", 20: "convergentAdd", 21: "divergentModifyConflict", 22: "rightAdd"}
    mirror = {"left": "right", "right": "left"}
    flipped = {r.pk: r.op for r in merge.classified(b, t, o, ["pk"]).collect()}
    assert flipped == {k: next((mirror[s] + v[len(s) :] for s in mirror if v.startswith(s)), v) for k, v in got.items()}
    assert rows(merge.merged_rows(b, o, t, ["pk"], "ours")) == rows(merge.merged_rows(b, t, o, ["pk"], "theirs"))
    assert {r.our_pk: (r.our_diff_type, r.their_diff_type) for r in merge.conflicts(b, o, t, ["pk"]).collect()} == {6: ("modified", "modified"), 21: ("added", "added")}


def test_cells_merge(spark):
    b, o, t = (table(spark, [(1, c, n)]) for c, n in (("x", None), ("y", None), ("x", 5)))
    assert rows(merge.merged_rows(b, o, t, ["pk"])) == [(1, "y", 5)]
    assert merge.conflicts(b, o, t, ["pk"]).count() == 0
    gone = b.limit(0)
    assert {r.op for r in merge.classified(b, gone, t, ["pk"]).collect()} == {"divergentDeleteConflict"}
    assert rows(merge.revert(t, t, b, ["pk"])) == rows(b) and rows(merge.cherry_pick(o, t, b, ["pk"])) == [(1, "y", 5)]


def test_constraints(spark):
    child = table(spark, [(1, "a", 1), (2, "b", None), (3, "c", 9)])
    parent = table(spark, [(1,), (2,)], "k int")
    assert rows(constraints.foreign_key(child, ["n"], parent, ["k"])) == [(3, "c", 9)]
    assert constraints.unique(table(spark, [(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 1)]), ["c", "n"]).count() == 2
    assert rows(constraints.check(child, "n < 5")) == [(3, "c", 9)] and constraints.not_null(child, ["n"]).count() == 1
    filled = constraints.auto_increment(table(spark, [(None, "b", 1), (5, "a", 1), (None, "c", 1)]), "pk", 6, ["c"])
    assert rows(filled.select("pk", "c")) == [(5, "a"), (6, "b"), (7, "c")]


@pytest.fixture
def many_ranges(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.range(0, 20_000, 1, 3)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_auto_increment_numbers_each_once_when_ranges_are_sampled(many_ranges):
    """Names come twice, one in a hundred is null; ids are by name, null first, without gaps."""
    name = F.when(F.col("id") % 100 > 0, F.format_string("n%06d", F.col("id") * 7919 % 10_000))
    df = many_ranges.select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("pk"), name.alias("c"), (F.col("id") % 3).alias("n"))
    filled = constraints.auto_increment(df, "pk", 200_000, ["c", "n"]).filter("pk >= 200000").orderBy("pk").collect()
    want = df.filter("pk IS NULL").orderBy("c", "n").collect()
    assert [r.pk for r in filled] == [*range(200_000, 215_000)] and [r[1:] for r in filled] == [r[1:] for r in want]


def test_histogram_when_ranges_are_sampled(many_ranges):
    """Values 0 to 9,999 of two rows each, dealt in no order, and nulls: ten buckets of equal counts."""
    df = many_ranges.select((F.col("id") * 7919 % 10_000).alias("v")).union(many_ranges.limit(5).select(F.lit(None).cast("long")))
    assert rows(stats.histogram(df, "v", 10)) == [(i, 2_000, 1_000, 1_000 * i, 1_000 * i + 999) for i in range(10)]


def test_ranges_ascend_and_share_the_rows(many_ranges):
    placed = diff.ranged(many_ranges.withColumn("k", -F.col("id") * F.col("id")), ["k"])
    parts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("_p").collect()
    assert [r["_p"] for r in parts] == [0, 1, 2, 3] and all(a.high < b.low for a, b in zip(parts, parts[1:])) and max(r.n for r in parts) < 10_000
    assert rows(diff.ranged(many_ranges.limit(0), ["id"])) == []
    assert {r["_p"] for r in diff.ranged(many_ranges.select(F.lit(None).cast("string").alias("c"), F.lit(1).alias("k")), ["c", "k"]).collect()} == {3}


def test_schema_merge(spark):
    from pyspark.sql import types as T

    s = lambda t: T.StructType([T.StructField(p.split()[0], T._parse_datatype_string(p.split()[1])) for p in t.split(", ")]) if t else T.StructType()
    assert schema.merge_schemas(s("a int, b int"), s("a bigint, b int"), s("a int, b int, c string")).simpleString() == "struct<a:bigint,b:int,c:string>"
    assert schema.merge_schemas(s("a int, b int"), s("a int"), s("a int, b int")).names == ["a"]
    with pytest.raises(schema.SchemaConflict):
        schema.merge_schemas(s("a int"), s("a int, c int"), s("a int, c string"))
    with pytest.raises(schema.SchemaConflict):
        schema.merge_schemas(s("a int, b int"), s("a int"), s("a int, b bigint"))
    assert "PRIMARY KEY (`a`)" in schema.create_statement("t", s("a int"), ["a"])


# --- repo


def test_repo_round(spark, repo):
    repo.write_table("t", table(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 3)]), ["pk"])
    assert rows(repo.status()) == [("t", False, "new table")]
    first = repo.commit("first", all=True)
    repo.update("t", {"c": "'z'"}, "pk = 2")
    repo.delete("t", "pk = 3")
    repo.insert("t", table(spark, [(4, "d", 4)]))
    assert rows(repo.diff("HEAD", "WORKING", "t").select("to_pk", "from_pk", "diff_type")) == [(2, 2, "modified"), (4, None, "added"), (None, 3, "removed")]
    with pytest.raises(ValueError):
        repo.insert("t", table(spark, [(4, "again", 4)]))
    second = repo.commit("second", all=True)
    assert rows(repo.table("t", first)) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)] and rows(repo.table("t", "HEAD~1")) == rows(repo.table("t", first))
    assert {r.pk: r.commit for r in repo.blame("t").collect()} == {1: first, 2: second, 4: second}
    assert repo.history("t").count() == 6 and repo.history("t", [first]).count() == 3
    s = repo.diff_stat(first, second).first()
    assert (s.rows_added, s.rows_deleted, s.rows_modified) == (1, 1, 1)
    assert rows(repo.diff_summary(first, second)) == [("t", "t", "modified", True, False)]
    assert [r.message for r in repo.log().collect()] == ["second", "first", "Initialize data repository"]
    assert repo.diff("HEAD~1..HEAD", None, "t").count() == 3 and repo.unscoped_diff().count() == 2 + 1 * (repo.manifest("STAGED") != repo.manifest("WORKING"))
    assert repo.diff_table("t").filter(F.col("to_commit") == second).count() == 3
    h = repo.hash_of_table("t")
    repo.write_table("t", repo.table("t").orderBy(F.desc("pk")), ["pk"])
    assert repo.hash_of_table("t") == h and repo.commit("none", all=True, skip_empty=True) is None
    again = Repo(spark, repo.root)
    assert again.hash_of_db() == repo.hash_of_db() and rows(again.table("t")) == rows(repo.table("t"))
    again.tag("v1")
    with pytest.raises(Conflict):
        repo.tag("v2")


def test_branches_and_merges(spark, repo):
    repo.write_table("t", three(spark)[0], ["pk"])
    repo.commit("base", all=True)
    repo.create_branch("other")
    repo.write_table("t", three(spark)[1], ["pk"])
    repo.commit("ours", all=True)
    repo.checkout("other")
    repo.write_table("t", three(spark)[2], ["pk"])
    repo.write_table("u", table(spark, [(1, "u", 1)]), ["pk"])
    repo.commit("theirs", all=True)
    repo.checkout("main")
    assert repo.preview_merge("main", "other") == [("t", 2, 0)] and rows(repo.branch_status("main", "other")) == [("other", 1, 1)]
    got = repo.merge("other")
    assert got["conflicts"] == 1 and repo.merge_status().first().is_merging and repo.conflict_rows("t").count() == 2
    repo.resolve_conflicts("t", "theirs")
    repo.commit("merged", all=True)
    assert rows(repo.table("t")) == rows(merge.merged_rows(*three(spark), ["pk"], "theirs")) and repo.table("u").count() == 1
    assert len(repo.graph[repo.head()].parents) == 2 and repo.log("main", without=["other"]).count() == 2
    repo.create_branch("ff")
    repo.checkout("ff")
    repo.delete("t", "pk = 1")
    repo.commit("less", all=True)
    repo.checkout("main")
    assert repo.merge("ff")["fast_forward"] and repo.table("t").filter("pk = 1").count() == 0
    repo.revert("HEAD")
    assert repo.table("t").filter("pk = 1").count() == 1
    assert repo.ref_log("main").count() == len({r.commit_hash for r in repo.ref_log("main").collect()})


def test_stash_rebase_squash_filter(spark, repo):
    repo.write_table("t", table(spark, [(1, "a", 1)]), ["pk"])
    base = repo.commit("base", all=True)
    repo.insert("t", table(spark, [(2, "b", 2)]))
    repo.stash()
    assert repo.table("t").count() == 1 and repo.stashes().count() == 1
    repo.stash("pop")
    assert repo.table("t").count() == 2 and repo.stashes().count() == 0
    repo.commit("two", all=True)
    repo.create_branch("side", base)
    repo.checkout("side")
    for i in (10, 11):
        repo.insert("t", table(spark, [(i, "s", i)]))
        repo.commit(f"side {i}", all=True)
    repo.rebase("main")
    assert rows(repo.table("t").select("pk")) == [(1,), (10,), (11,), (2,)] and [r.message for r in repo.log("main..side").collect()] == ["side 11", "side 10"]
    repo.squash_history("main", "both")
    assert [r.message for r in repo.log("main..side").collect()] == ["both"] and repo.table("t", "HEAD").count() == 4
    repo.filter_branch("t", lambda df: df.withColumn("c", F.upper("c")))
    assert rows(repo.table("t", "HEAD").select("c").distinct()) == [("A",), ("B",), ("S",)]
    repo.write_table("junk", table(spark, [(1, "a", 1)]))
    repo.clean()
    assert "junk" not in repo.manifest("WORKING")


def test_patch_turns_one_version_into_the_other(spark, repo):
    a, b = table(spark, [(1, "it's", 1), (2, "b", None), (3, "c", 3)]), table(spark, [(1, "it's", 9), (2, "back\\slash", None), (5, None, 5)])
    repo.write_table("t", a, ["pk"])
    repo.commit("a", all=True)
    session = Session(repo)
    for r in patch.table_patch("t", a, b, ["pk"]).orderBy("phase").collect():
        session.sql(r.statement)
    assert rows(repo.table("t")) == rows(b)


# --- SQL


def test_sql_session(spark, repo):
    s = Session(repo)
    s.run_script("""
        CREATE TABLE t (pk INT PRIMARY KEY, c VARCHAR(20), n INT UNSIGNED);
        INSERT INTO t VALUES (1, 'a', 1), (2, 'b; c', NULL);
        CALL vc_commit('-A', '-m', 'one'); CALL vc_tag('v1');
        INSERT INTO t (pk, c) VALUES (3, 'd'); UPDATE t SET c = 'z', n = 7 WHERE pk = 1; DELETE FROM t WHERE pk = 2;
        CALL vc_commit('-A', '-m', 'two')
    """)
    assert rows(s.sql("SELECT pk, c FROM t")) == [(1, "z"), (3, "d")]
    assert rows(s.sql("SELECT pk FROM t AS OF 'v1' WHERE pk > 0")) == [(1,), (2,)] and s.sql("SELECT * FROM t AS OF 'HEAD~1' x JOIN t ON x.pk = t.pk").count() == 1
    assert rows(s.sql("SELECT to_pk, diff_type FROM vc_diff('v1', 'HEAD', 't') WHERE diff_type <> 'removed'")) == [(1, "modified"), (3, "added")]
    assert s.sql("SELECT message FROM vc_log ORDER BY commit_order DESC").first().message == "two"
    assert s.sql("SELECT * FROM vc_log('HEAD', '^v1')").count() == 1 and s.sql("SELECT * FROM vc_history_t").count() == 4
    assert s.sql("SELECT rows_added FROM vc_diff_stat('v1..HEAD', 't')").first()[0] == 1
    assert rows(s.sql("SELECT pk, message FROM vc_blame_t")) == [(1, "two"), (3, "two")]
    assert rows(s.sql("SELECT diff_type, path FROM vc_json_diff('{\"a\": 1}', '{\"a\": 2, \"b\": []}')")) == [("added", "$.b"), ("modified", "$.a")]
    assert s.sql("SELECT diff_type FROM vc_query_diff('SELECT pk FROM t AS OF ''v1''', 'SELECT pk FROM t')").count() >= 1
    s.sql("REPLACE INTO t VALUES (3, 'r', 1)")
    s.sql("INSERT IGNORE INTO t VALUES (3, 'never', 1), (4, 'e', 1)")
    assert rows(s.sql("SELECT pk, c FROM t WHERE pk > 2")) == [(3, "r"), (4, "e")]
    s.sql("ALTER TABLE t ADD COLUMN extra BIGINT")
    s.sql("ALTER TABLE t DROP COLUMN n")
    assert repo.table("t").columns == ["pk", "c", "extra"] and s.sql("SELECT * FROM vc_schema_diff('HEAD', 'WORKING')").count() == 1
    s.run_script("CALL vc_checkout('-b', 'side'); CALL vc_commit('-am', 'shape'); CALL vc_checkout('main')")
    assert s.sql("SELECT name FROM vc_branches").count() == 2 and s.sql("CALL vc_merge('side')").first().fast_forward == 1
    assert list(statements("a; 'b;c' ; -- x;\n d")) == ["a", "'b;c'", "d"]


def test_sql_constraints_and_documents(spark, repo):
    s = Session(repo)
    s.run_script("""
        CREATE TABLE p (id INT PRIMARY KEY);
        CREATE TABLE t (pk INT, r INT NOT NULL, d JSON, PRIMARY KEY (pk), CONSTRAINT fk FOREIGN KEY (r) REFERENCES p (id), UNIQUE KEY u (r), CHECK (pk < 10));
        INSERT INTO p VALUES (1); SET foreign_key_checks = 0; INSERT INTO t VALUES (1, 1, '{"a":1,"b":1}'), (9, 2, NULL);
        CALL vc_commit('-A', '-m', 'one'); CALL vc_branch('other');
        UPDATE t SET d = '{"a":2,"b":1}' WHERE pk = 1; CALL vc_commit('-am', 'ours'); CALL vc_checkout('other');
        UPDATE t SET d = '{"a":1,"b":3}' WHERE pk = 1; CALL vc_commit('-am', 'theirs'); CALL vc_checkout('main')
    """)
    assert rows(s.sql("SELECT violation_type, n FROM vc_constraint_violations")) == [("foreign key", 1)]
    assert rows(s.sql("SELECT pk, violation_type FROM vc_constraint_violations_t")) == [(9, "foreign key")]
    assert s.sql("CALL vc_verify_constraints('--all')").first()[0] == 1 and s.sql("CALL vc_verify_constraints()").first()[0] == 0
    assert s.sql("CALL vc_merge('other')").first().conflicts == 1 and rows(s.sql("SELECT table_name, status FROM vc_status WHERE NOT staged")) == [("t", "constraint violation"), ("t", "modified")]
    s.run_script("DELETE FROM t WHERE pk = 9; CALL vc_conflicts_resolve('--ours', 't'); CALL vc_commit('-A', '-m', 'merged')")
    assert rows(s.sql("SELECT pk, violation_type FROM vc_constraint_violations_t")) == []
    assert rows(s.sql("SELECT d FROM t WHERE pk = 1")) == [('{"a":2,"b":3}',)]
    assert s.sql("SELECT vc_hashof('HEAD') AS h, active_branch() AS b, has_ancestor('HEAD', 'other') AS a").first() == (repo.head(), "main", True)
    assert repo.table("t", "HEAD", schema_as="HEAD~1").columns == ["pk", "r", "d"] and s.sql("SELECT * FROM vc_schema_conflicts").count() == 0


def test_spellings(spark):
    assert mysql_to_spark("date_add(d, INTERVAL 3 DAY)") == "(d + INTERVAL 3 DAY)" and mysql_to_spark("CAST(x AS SIGNED)") == "CAST(x AS BIGINT)"
    assert spark_type("int unsigned") == "bigint" and spark_type("decimal(65,30)") == "string" and spark_type("TINYINT(1)") == "boolean" and spark_type("varchar(20)") == "string"
    df = spark.sql("SELECT TIMESTAMP'2024-02-29 13:05:09' AS t, 'b' AS s")
    r = df.select(mysql.date_format(F.col("t"), "%Y/%m/%d %H-%i '%s' day").alias("f"), mysql.date_add(F.col("t"), 1, "YEAR").alias("y"), mysql.date_add(F.col("t"), 2, "HOUR").alias("h"), mysql.field(F.col("s"), "a", "b").alias("i"), mysql.timestampdiff("MONTH", F.lit("2024-01-31").cast("timestamp"), F.col("t")).alias("m"), mysql.bin_to_uuid(mysql.uuid_to_bin(F.lit("00112233-4455-6677-8899-aabbccddeeff"))).alias("u")).first()
    assert r.f == "2024/02/29 13-05 '09' day" and r.y == datetime(2025, 2, 28, 13, 5, 9) and r.h == datetime(2024, 2, 29, 15, 5, 9) and r.i == 2 and r.u.startswith("00112233-4455")


# --- JSON, space, tests of data


def test_json(spark):
    assert [*jsonx.differences({"a": [1, 2], "b": {"c": 1}}, {"a": [1, 3, 4], "b": {}})] == [("modified", "$.a[1]", "2", "3"), ("added", "$.a[2]", None, "4"), ("removed", "$.b.c", "1", None)]
    df = spark.createDataFrame([('{"a":1,"b":{"c":2}}', '{"a":5,"b":{"c":2}}', '{"a":1,"b":{"c":3},"d":4}')], "b string, o string, t string")
    assert df.select(jsonx.json_merge("b", "o", "t").alias("m")).first().m == ('{"a":5,"b":{"c":3},"d":4}', False)
    assert df.select(jsonx.json_merge("b", "o", F.lit('{"a":6}')).alias("m")).first().m.conflict
    r = df.select(jsonx.json_set("b", "$.b.x", F.lit(1)).alias("s"), jsonx.json_insert("b", "$.a", F.lit(9)).alias("i"), jsonx.json_replace("b", "$.z", F.lit(9)).alias("r"), jsonx.json_remove("b", "$.b.c").alias("d"), jsonx.json_merge_patch("b", F.lit('{"a":null,"e":1}')).alias("p")).first()
    assert tuple(r) == ('{"a":1,"b":{"c":2,"x":1}}', '{"a":1,"b":{"c":2}}', '{"a":1,"b":{"c":2}}', '{"a":1,"b":{}}', '{"b":{"c":2},"e":1}')


def test_space(spark):
    df = spark.createDataFrame([("POINT(1 2.5)", "LINESTRING(0 0, 3 4, 3 5)"), ("nope", "nope")], "p string, l string")
    got = [tuple(r) for r in df.select(spatial.as_wkt(spatial.point_from_wkt(F.col("p"))), spatial.length(spatial.line_from_wkt(F.col("l"))), spatial.within_polygon(spatial.point_from_wkt(F.col("p")), [(0, 0), (4, 0), (4, 4), (0, 4)])).collect()]
    assert got[0] == ("POINT(1 2.5)", 6.0, True) and got[1][0] is None


def test_data_tests(spark):
    spark.range(3).createOrReplaceTempView("three")
    make = lambda n, q, k, c, v: {"test_name": n, "test_group": "g", "test_query": q, "assertion_type": k, "assertion_comparator": c, "assertion_value": v}
    tests = [
        make("a", "SELECT * FROM three", "expected_rows", "==", "3"), make("b", "SELECT count(*) FROM three", "expected_single_value", ">", "5"), make("c", "SELECT id, id FROM three", "expected_columns", "==", "2"),
        make("d", "SELECT * FROM nothing_here", "expected_rows", "==", "0"), make("e", "SELECT true", "expected_single_value", "==", "true"), make("f", "DROP TABLE x", "expected_rows", "==", "0"), make("g", "SELECT DATE'2024-01-02'", "expected_single_value", ">=", "2024-01-01"),
    ]
    assert {r.test_name: r.status for r in quality_tests.run(spark, tests).collect()} == {"a": "PASS", "b": "FAIL", "c": "PASS", "d": "FAIL", "e": "PASS", "f": "FAIL", "g": "PASS"}


# --- files and streams


def test_files(spark, repo, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('pk,name,zip,price,day,note\n1,"a, b",00123,1.5,2024-01-02,""\n2,"line\nend",00456,2,2024-01-03,\n')
    raw = files.read_csv(spark, path)
    assert [(r.note, r.name) for r in raw.orderBy("pk").collect()] == [("", "a, b"), (None, "line\nend")]
    assert files.infer(raw).simpleString() == "struct<pk:int,name:string,zip:string,price:double,day:date,note:string>"
    files.load(repo, "t", path, keys=["pk"], mapping={"name": "title"})
    assert repo.table("t").columns[:2] == ["pk", "title"]
    for kind in ("csv", "psv", "jsonl", "parquet"):
        out = str(tmp_path / f"out.{kind}")
        files.write_any(repo.table("t"), out)
        back = files.typed(files.read_any(spark, out), repo.table("t").schema)
        assert rows(back) == rows(repo.table("t")), kind
    files.write_any(repo.table("t"), str(tmp_path / "out.sql"), table="t", keys=["pk"])
    text = [r.value for r in spark.read.text(str(tmp_path / "out.sql")).collect()]
    assert sum(x.startswith("INSERT INTO `t`") for x in text) == 2
    with open(path, "w") as f:
        f.write("pk,title\n2,new\n9,nine\nbad,x\n")
    files.load(repo, "t", path, mode="update", keep_going=True)
    assert rows(repo.table("t").select("pk", "title")) == [(1, "a, b"), (2, "new"), (9, "nine")]


def test_change_feed_stream(spark, repo, tmp_path):
    a, b = table(spark, [(1, "a", 1), (2, "b", 2)]), table(spark, [(1, "z", 1), (3, "c", 3)])
    events = changes.row_events(a, b, ["pk"], "t")
    assert rows(events.groupBy("op").count()) == [("delete", 1), ("insert", 1), ("update", 1)]
    feed = events.select(F.coalesce("after.pk", "before.pk").alias("pk"), "after.c", "after.n", "op", F.lit(1).alias("seq"))
    feed = feed.union(table(spark, [(1, "y", 0, "insert", 0)], "pk int, c string, n int, op string, seq int"))
    feed.coalesce(1).write.parquet(str(tmp_path / "feed"))
    repo.write_table("t", a, ["pk"])
    repo.commit("start", all=True)
    for _ in range(2):
        stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
        changes.follow(repo, "t", stream, ["pk"], ["seq"], str(tmp_path / "mark")).awaitTermination()
    assert rows(repo.table("t", "HEAD")) == rows(b) and repo.log().count() == 3
    assert changes.wanted("t", "db", do=[("db", "t")]) and not changes.wanted("u", "db", do=[("db", "t")]) and not changes.wanted("t", "db", [("db", "t")], [("DB", "T")]) and changes.wanted("u", "other", do=[("db", "t")])


def test_windows_of_events(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, m // 60, m % 60), "a" if m % 20 else "b") for m in range(0, 120, 10)], "ts timestamp, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = changes.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "kind")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("SELECT sum(n) FROM counted")) == [(12,)]
