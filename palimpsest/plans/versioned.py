"""Registered queries that go through a repo and its SQL: databases are built in the shared folder, changed, merged and asked.

Each has DuckDB's SQL over the same versions of the same tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import fixtures as fx
from palimpsest.plans.sql import Session
from palimpsest.plans.store import Repo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Rows of a bucket here: few, so that tables of every size have several.
ROWS_PER_BUCKET = 4096
_built: dict[tuple, Session] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on one machine, where that is unset, a new one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_palimpsest_repos", None) or tempfile.mkdtemp(prefix="palimpsest-")
        spark._palimpsest_repos = found
    return found


def fresh(spark: SparkSession, sf_dir: str, tables: Sequence[str]) -> Session:
    """A session on a new database, with the folder's tables as views beside it. Commits are a day apart, from 2024-01-01 on."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    days = iter(datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(1_000_000))
    return Session(Repo(spark, f"{shared_folder(spark).rstrip('/')}/palimpsest-repos/{uuid.uuid4().hex}", now=lambda: next(days), rows_per_bucket=ROWS_PER_BUCKET))


def register(name: str, query: Query, oracle: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, oracle


def asked(name: str, build: Callable[[SparkSession, str], Session], sql: str, oracle: str) -> None:
    """A question to a database that several queries share and none changes; it is built once for each session and folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
        if key not in _built:
            _built[key] = build(spark, sf_dir)
        return _built[key].sql(sql)

    register(name, run, oracle)


def scripted(name: str, tables: str, script: str, sql: str, oracle: str) -> None:
    """A script on a database of its own, then a question."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = fresh(spark, sf_dir, tables.split())
        s.run_script(script)
        return s.sql(sql)

    register(name, run, oracle)


# --- a chain of commits

NAMES = [*fx.KEYS, *fx.VALUES]


def chain(spark: SparkSession, sf_dir: str) -> Session:
    """Six commits c0 to c5 of orders on main, each with a tag of its name and dated as fixtures.DATES; a branch `side` from c2."""
    s = fresh(spark, sf_dir, ["orders"])
    for i, text in enumerate(fx.CHAIN):
        s.repo.write_table("orders", spark.sql(text), fx.KEYS)
        s.repo.commit(f"commit c{i}", all=True, date=datetime.fromisoformat(fx.DATES[i]))
        s.repo.tag(f"c{i}")
        if i == 2:
            s.repo.create_branch("side")
    return s


_PAIR_COLUMNS = ", ".join(f"b.{c} AS to_{c}" for c in NAMES) + ", " + ", ".join(f"a.{c} AS from_{c}" for c in NAMES)
_DIFFERS = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in fx.VALUES)


def pair(a: str, b: str) -> str:
    return f"SELECT {_PAIR_COLUMNS}, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS diff_type FROM ({a}) a FULL OUTER JOIN ({b}) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR {_DIFFERS}"


_SIDES = ", ".join(f"to_{c}, from_{c}" for c in NAMES)
asked("repo_as_of_tag", chain, "SELECT * FROM orders AS OF 'c3'", fx.CHAIN[3])
asked("repo_as_of_parent", chain, "SELECT o.o_orderkey, o.o_orderstatus FROM orders AS OF 'HEAD~2' o WHERE o.o_orderkey % 2 = 0", f"SELECT o_orderkey, o_orderstatus FROM ({fx.CHAIN[3]}) WHERE o_orderkey % 2 = 0")
asked("repo_as_of_time", chain, "SELECT * FROM orders AS OF TIMESTAMP '2024-01-03 12:00:00'", fx.CHAIN[2])
asked("repo_as_of_join", chain, "SELECT n.o_orderkey, n.o_orderstatus AS now, p.o_orderstatus AS before FROM orders n JOIN orders AS OF 'c0' AS p ON n.o_orderkey = p.o_orderkey WHERE n.o_orderstatus <> p.o_orderstatus", f"SELECT n.o_orderkey, n.o_orderstatus AS now, p.o_orderstatus AS before FROM ({fx.CHAIN[5]}) n JOIN ({fx.CHAIN[0]}) p USING (o_orderkey) WHERE n.o_orderstatus <> p.o_orderstatus")
asked("repo_revision_database", chain, "SELECT * FROM `main_db/c1`.orders UNION ALL SELECT * FROM `main_db/side`.orders", f"SELECT * FROM ({fx.CHAIN[1]}) UNION ALL SELECT * FROM ({fx.CHAIN[2]})")
asked("repo_diff", chain, f"SELECT {_SIDES}, diff_type FROM vc_diff('c1', 'c4', 'orders')", pair(fx.CHAIN[1], fx.CHAIN[4]))
asked("repo_diff_range", chain, "SELECT diff_type, COUNT(*) AS n FROM vc_diff('c0..c5', 'orders') GROUP BY diff_type", f"SELECT diff_type, COUNT(*) AS n FROM ({pair(fx.CHAIN[0], fx.CHAIN[5])}) GROUP BY diff_type")
asked("repo_diff_three_dots", chain, "SELECT diff_type, COUNT(*) AS n FROM vc_diff('main...side~1', 'orders') GROUP BY diff_type UNION ALL SELECT diff_type, COUNT(*) FROM vc_diff('side...main', 'orders') GROUP BY diff_type", f"SELECT diff_type, COUNT(*) AS n FROM ({pair(fx.CHAIN[2], fx.CHAIN[5])}) GROUP BY diff_type")
asked("repo_diff_filtered", chain, f"SELECT {_SIDES}, diff_type FROM vc_diff('c1', 'c4', 'orders') WHERE to_o_totalprice > 200000 AND diff_type = 'added'", f"SELECT * FROM ({pair(fx.CHAIN[1], fx.CHAIN[4])}) WHERE to_o_totalprice > 200000 AND diff_type = 'added'")
asked("repo_diff_skinny", chain, "SELECT * EXCEPT (from_commit, to_commit, from_commit_date, to_commit_date) FROM vc_diff('--skinny', '--filter', 'modified', 'c1', 'c4', 'orders')", f"SELECT to_o_orderkey, to_o_orderstatus, from_o_orderkey, from_o_orderstatus, diff_type FROM ({pair(fx.CHAIN[1], fx.CHAIN[4])}) WHERE diff_type = 'modified'".replace("SELECT to_o_orderkey, to_o_orderstatus, from_o_orderkey, from_o_orderstatus, diff_type", "SELECT " + ", ".join(f"to_{c}" for c in NAMES) + ", " + ", ".join(f"from_{c}" for c in NAMES) + ", diff_type"))
_STAT = f"""WITH a AS ({fx.CHAIN[1]}), b AS ({fx.CHAIN[4]}), j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, {' + '.join(f'CAST(a.{c} IS DISTINCT FROM b.{c} AS BIGINT)' for c in fx.VALUES)} AS cells FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey),
s AS (SELECT COUNT(ak) AS old_row_count, COUNT(bk) AS new_row_count, COUNT(*) FILTER (WHERE ak IS NULL) AS rows_added, COUNT(*) FILTER (WHERE bk IS NULL) AS rows_deleted, COUNT(*) FILTER (WHERE ak = bk AND cells > 0) AS rows_modified, CAST(SUM(CASE WHEN ak = bk THEN cells ELSE 0 END) AS BIGINT) AS cells_modified FROM j)
SELECT 'orders' AS table_name, old_row_count - rows_deleted - rows_modified AS rows_unmodified, rows_added, rows_deleted, rows_modified, rows_added * 6 AS cells_added, rows_deleted * 6 AS cells_deleted, cells_modified, old_row_count, new_row_count, old_row_count * 6 AS old_cell_count, new_row_count * 6 AS new_cell_count FROM s"""
asked("repo_diff_stat", chain, "SELECT * FROM vc_diff_stat('c1', 'c4', 'orders')", _STAT)
asked("repo_diff_summary", chain, "SELECT * FROM vc_diff_summary('EMPTY', 'c0') UNION ALL SELECT * FROM vc_diff_summary('c0..c5')", "SELECT '' AS from_table_name, 'orders' AS to_table_name, 'added' AS diff_type, true AS data_change, true AS schema_change UNION ALL SELECT 'orders', 'orders', 'modified', true, false")
asked("repo_log", chain, "SELECT message, commit_order, date FROM vc_log WHERE commit_order > 1", "SELECT * FROM (VALUES " + ", ".join(f"('commit c{i}', CAST({i + 2} AS BIGINT), TIMESTAMP '{d}')" for i, d in enumerate(fx.DATES)) + ") t(message, commit_order, date)")
asked("repo_log_range", chain, "SELECT message FROM vc_log('c1..c4') UNION ALL SELECT message FROM vc_log('main', '--not', 'side')", "SELECT * FROM (VALUES ('commit c2'), ('commit c3'), ('commit c4'), ('commit c3'), ('commit c4'), ('commit c5')) t(message)")
asked("repo_log_tables", chain, "SELECT message, parents = vc_hashof('c3') AS follows FROM vc_log('c4', '--tables', 'orders', '--parents', '-n', '2')", "SELECT * FROM (VALUES ('commit c4', true), ('commit c3', false)) t(message, follows)")
asked("repo_commits", chain, "SELECT c.message, a.parent_index, p.message AS parent FROM vc_commit_ancestors a JOIN vc_commits c ON c.commit_hash = a.commit_hash LEFT JOIN vc_commits p ON p.commit_hash = a.parent_hash", "SELECT 'Initialize data repository' AS message, 0 AS parent_index, NULL AS parent UNION ALL SELECT 'commit c' || i, 0, CASE WHEN i = 0 THEN 'Initialize data repository' ELSE 'commit c' || (i - 1) END FROM (SELECT unnest(range(6)) AS i)")
asked("repo_branches", chain, "SELECT name, latest_commit_message, dirty FROM vc_branches", "SELECT * FROM (VALUES ('main', 'commit c5', false), ('side', 'commit c2', false)) t(name, latest_commit_message, dirty)")
asked("repo_tags", chain, "SELECT tag_name, message FROM vc_tags", "SELECT 'c' || i AS tag_name, 'commit c' || i AS message FROM (SELECT unnest(range(6)) AS i)")
asked("repo_reflog", chain, "SELECT ref, commit_message FROM vc_reflog('main')", "SELECT 'refs/heads/main' AS ref, 'Initialize data repository' AS commit_message UNION ALL SELECT 'refs/heads/main', 'commit c' || i FROM (SELECT unnest(range(6)) AS i)")
asked("repo_graph_functions", chain, "SELECT vc_merge_base('main', 'side') = vc_hashof('c2') AS base, has_ancestor('main', 'side') AS a, has_ancestor('side', 'main') AS b, active_branch() AS branch, vc_hashof_db('c5') = vc_hashof_db() AS db, vc_hashof_table('orders') = vc_hashof_table('orders', 'c5') AS t, vc_hashof_table('orders', 'c4') = vc_hashof_table('orders') AS other, @@main_db_head = vc_hashof('HEAD') AS head", "SELECT true AS base, true AS a, false AS b, 'main' AS branch, true AS db, true AS t, false AS other, true AS head")
asked("repo_branch_status", chain, "SELECT * FROM vc_branch_status('main', 'side', 'c5')", "SELECT * FROM (VALUES ('side', CAST(0 AS BIGINT), CAST(3 AS BIGINT)), ('c5', CAST(0 AS BIGINT), CAST(0 AS BIGINT))) t(branch, commits_ahead, commits_behind)")
asked("repo_count_commits", chain, "CALL vc_count_commits('--from', 'side', '--to', 'main')", "SELECT CAST(0 AS BIGINT) AS ahead, CAST(3 AS BIGINT) AS behind")
_HISTORY = " UNION ALL ".join(f"SELECT *, 'c{i}' AS tag, TIMESTAMP '{fx.DATES[i]}' AS commit_date FROM ({t})" for i, t in enumerate(fx.CHAIN))
asked("repo_history", chain, f"SELECT {', '.join('h.' + c for c in NAMES)}, t.tag_name AS tag, h.commit_date FROM vc_history_orders h JOIN vc_tags t ON h.commit_hash = t.tag_hash", _HISTORY)
_WALK = """WITH h AS (SELECT *, CAST(substr(tag, 2) AS INT) AS place FROM ({})),
w AS (SELECT *, lag(place) OVER k AS p, lag(o_orderstatus) OVER k AS s FROM h WINDOW k AS (PARTITION BY o_orderkey ORDER BY place))
SELECT o_orderkey, 'commit c' || max(place) FILTER (WHERE p IS DISTINCT FROM place - 1 OR s <> o_orderstatus) AS message, 'root' AS committer FROM w GROUP BY o_orderkey HAVING max(w.place) = 5"""
asked("repo_blame", chain, "SELECT o_orderkey, message, committer FROM vc_blame_orders", _WALK.format(_HISTORY))
_EMPTY = f"SELECT * FROM ({fx.CHAIN[0]}) WHERE FALSE"
asked("repo_diff_table", chain, f"SELECT {_SIDES}, diff_type, t.tag_name AS tag, d.from_commit_date FROM vc_diff_orders d JOIN vc_tags t ON d.to_commit = t.tag_hash WHERE t.tag_name <> 'c0'", " UNION ALL ".join(f"SELECT *, 'c{i}' AS tag, TIMESTAMP '{fx.DATES[i - 1]}' AS from_commit_date FROM ({pair(fx.CHAIN[i - 1], fx.CHAIN[i])})" for i in fx.PLACES if i))
asked("repo_diff_table_first", chain, "SELECT diff_type, COUNT(*) AS n, COUNT(from_o_orderkey) AS old FROM vc_diff_orders WHERE to_commit = vc_hashof('c0') GROUP BY diff_type", f"SELECT 'added' AS diff_type, COUNT(*) AS n, CAST(0 AS BIGINT) AS old FROM ({fx.CHAIN[0]})")
asked("repo_commit_diff", chain, f"SELECT {_SIDES}, diff_type FROM vc_commit_diff_orders WHERE to_commit = vc_hashof('c4') AND from_commit = vc_hashof('c1')", pair(fx.CHAIN[1], fx.CHAIN[4]))
asked("repo_column_diff", chain, "SELECT message, table_name, column_name, diff_type FROM vc_column_diff WHERE column_name IN ('o_orderkey', 'o_orderstatus')", "SELECT * FROM (SELECT 'commit c' || i AS message, 'orders' AS table_name, c AS column_name, CASE WHEN i = 0 THEN 'added' ELSE 'modified' END AS diff_type FROM (SELECT unnest(range(6)) AS i), (VALUES ('o_orderkey'), ('o_orderstatus')) t(c))")
asked("repo_unscoped_diff", chain, "SELECT message, table_name, data_change, schema_change FROM vc_diff WHERE table_name = 'orders'", "SELECT 'commit c' || i AS message, 'orders' AS table_name, true AS data_change, i = 0 AS schema_change FROM (SELECT unnest(range(6)) AS i)")
asked("repo_query_diff", chain, "SELECT * FROM vc_query_diff('SELECT o_orderkey, o_orderstatus FROM orders AS OF ''c1''', 'SELECT o_orderkey, o_orderstatus FROM orders AS OF ''c4''', 'o_orderkey')", f"SELECT a.o_orderkey AS from_o_orderkey, a.o_orderstatus AS from_o_orderstatus, b.o_orderkey AS to_o_orderkey, b.o_orderstatus AS to_o_orderstatus, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS diff_type FROM ({fx.CHAIN[1]}) a FULL OUTER JOIN ({fx.CHAIN[4]}) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
asked("repo_row_count", chain, "SELECT table_name, table_rows FROM information_schema.tables WHERE table_name = 'orders'", f"SELECT 'orders' AS table_name, COUNT(*) AS table_rows FROM ({fx.CHAIN[5]})")
asked("repo_prepared_as_of", chain, "SELECT COUNT(*) AS n FROM orders AS OF 'c0' WHERE EXISTS (SELECT 1 FROM vc_diff('c0', 'c1', 'orders') d WHERE d.to_o_orderkey = o_orderkey)", f"SELECT COUNT(*) AS n FROM ({fx.CHAIN[0]}) WHERE o_orderkey IN (SELECT to_o_orderkey FROM ({pair(fx.CHAIN[0], fx.CHAIN[1])}))")

# --- three-way merges


def three(spark: SparkSession, sf_dir: str) -> Session:
    """base, then ours on main and theirs on a branch, and the merge of both, left with its conflicts."""
    s = fresh(spark, sf_dir, ["orders"])
    s.repo.write_table("orders", spark.sql(fx.BASE), fx.KEYS)
    s.repo.commit("base", all=True)
    s.repo.create_branch("other")
    s.repo.write_table("orders", spark.sql(fx.OURS), fx.KEYS)
    s.repo.commit("ours", all=True)
    s.repo.checkout("other")
    s.repo.write_table("orders", spark.sql(fx.THEIRS), fx.KEYS)
    s.repo.commit("theirs", all=True)
    s.repo.checkout("main")
    return s


def merged(spark: SparkSession, sf_dir: str) -> Session:
    s = three(spark, sf_dir)
    s.sql("CALL vc_merge('other')")
    return s


def resolved(spark: SparkSession, sf_dir: str) -> Session:
    s = merged(spark, sf_dir)
    s.run_script("CALL vc_conflicts_resolve('--theirs', 'orders'); CALL vc_commit('-A', '-m', 'merged')")
    return s


def merge_queries(merged_sql: Callable[[str, str], str], conflict_sql: str, three_sql: str, conflict: str) -> None:
    """Registered with the SQL that queries.py has for the kernels."""
    asked("repo_merge", merged, "SELECT * FROM orders", merged_sql("our", "in_o"))
    names = ", ".join(f"{s}_{c}" for s in ("base", "our", "their") for c in NAMES)
    asked("repo_conflicts", merged, f"SELECT {names}, our_diff_type, their_diff_type FROM vc_conflicts_orders WHERE from_root_ish = vc_hashof('other')", conflict_sql)
    asked("repo_conflicts_count", merged, "SELECT `table`, num_conflicts FROM vc_conflicts", f"{three_sql} SELECT 'orders' AS \"table\", COUNT(*) AS num_conflicts FROM j WHERE {conflict}")
    asked("repo_merge_status", merged, "SELECT m.is_merging, m.unmerged_tables, m.source_commit = vc_hashof('other') AS theirs, s.status FROM vc_merge_status m, vc_status s WHERE s.status = 'conflict'", "SELECT true AS is_merging, 'orders' AS unmerged_tables, true AS theirs, 'conflict' AS status")
    asked("repo_preview", three, "SELECT * FROM vc_preview_merge_conflicts_summary('main', 'other')", f"{three_sql} SELECT 'orders' AS \"table\", COUNT(*) AS num_data_conflicts, CAST(0 AS BIGINT) AS num_schema_conflicts FROM j WHERE {conflict}")
    asked("repo_preview_rows", three, f"SELECT {names}, our_diff_type, their_diff_type FROM vc_preview_merge_conflicts('main', 'other', 'orders')", conflict_sql)
    asked("repo_resolve_theirs", resolved, "SELECT * FROM orders AS OF 'HEAD'", merged_sql("their", "in_t"))
    asked("repo_merge_log", resolved, "SELECT message, commit_order FROM vc_log('--merges') UNION ALL SELECT message, commit_order FROM vc_log('HEAD^2') WHERE commit_order = 3", "SELECT * FROM (VALUES ('merged', CAST(4 AS BIGINT)), ('theirs', CAST(3 AS BIGINT))) t(message, commit_order)")


# --- scripts

_NATION = "CREATE TABLE n (id INT PRIMARY KEY, name VARCHAR(25) NOT NULL, region INT, hits INT DEFAULT 0); INSERT INTO n (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation;"
scripted("repo_cherry_pick", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_checkout('-b', 'side'); UPDATE n SET hits = 5 WHERE id < 5; CALL vc_commit('-am', 'hits'); UPDATE n SET name = 'x' WHERE id = 7; CALL vc_commit('-am', 'x'); CALL vc_checkout('main'); DELETE FROM n WHERE id = 20; CALL vc_commit('-am', 'less'); CALL vc_cherry_pick('side~1')", "SELECT * FROM n", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, CASE WHEN n_nationkey < 5 THEN 5 ELSE 0 END AS hits FROM nation WHERE n_nationkey <> 20")
scripted("repo_revert", "nation", _NATION + "CALL vc_commit('-Am', 'base'); UPDATE n SET hits = id; CALL vc_commit('-am', 'hits'); UPDATE n SET name = 'x' WHERE id = 7; CALL vc_commit('-am', 'x'); CALL vc_revert('HEAD~1')", "SELECT n.*, (SELECT message FROM vc_log('-n', '1')) AS last FROM n", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 7 THEN 'x' ELSE n_name END AS name, n_regionkey AS region, 0 AS hits, 'Revert \"hits\"' AS last FROM nation")
scripted("repo_rebase", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_branch('side'); DELETE FROM n WHERE id = 3; CALL vc_commit('-am', 'main'); CALL vc_checkout('side'); UPDATE n SET hits = 1 WHERE id = 4; CALL vc_commit('-am', 'a'); UPDATE n SET hits = 2 WHERE id = 5; CALL vc_commit('-am', 'b'); UPDATE n SET hits = 3 WHERE id = 6; CALL vc_commit('-am', 'c'); CALL vc_rebase('main')", "SELECT l.message, COUNT(n.id) AS n, SUM(n.hits) AS hits FROM vc_log('main..side') l, n GROUP BY l.message", "SELECT m AS message, COUNT(*) AS n, CAST(6 AS BIGINT) AS hits FROM nation, (VALUES ('a'), ('b'), ('c')) t(m) WHERE n_nationkey <> 3 GROUP BY m")
scripted("repo_rebase_interactive", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_branch('side'); DELETE FROM n WHERE id = 3; CALL vc_commit('-am', 'main'); CALL vc_checkout('side'); UPDATE n SET hits = 1 WHERE id = 4; CALL vc_commit('-am', 'a'); UPDATE n SET hits = 2 WHERE id = 5; CALL vc_commit('-am', 'b'); CALL vc_rebase('-i', 'main')", "SELECT rebase_order, action, commit_message FROM vc_rebase", "SELECT * FROM (VALUES (CAST(1 AS DOUBLE), 'pick', 'a'), (CAST(2 AS DOUBLE), 'pick', 'b')) t(rebase_order, action, commit_message)")
scripted("repo_squash_stash", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_tag('t'); UPDATE n SET hits = 1; CALL vc_commit('-am', 'a'); UPDATE n SET hits = 2 WHERE id > 9; CALL vc_commit('-am', 'b'); CALL vc_squash_history('t', '-m', 'both'); UPDATE n SET hits = 9 WHERE id = 0; CALL vc_stash('push', 's'); UPDATE n SET name = 'w' WHERE id = 1; CALL vc_stash('pop', 's')", "SELECT n.*, (SELECT COUNT(*) FROM vc_log('t..HEAD')) AS commits FROM n", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'w' ELSE n_name END AS name, n_regionkey AS region, CASE WHEN n_nationkey = 0 THEN 9 WHEN n_nationkey > 9 THEN 2 ELSE 1 END AS hits, CAST(1 AS BIGINT) AS commits FROM nation")
scripted("repo_reset_checkout", "nation", _NATION + "CALL vc_commit('-Am', 'base'); UPDATE n SET hits = 1 WHERE id = 1; CALL vc_add('n'); UPDATE n SET hits = 2 WHERE id = 2; CALL vc_reset('n'); UPDATE n SET hits = 3 WHERE id = 3; CREATE TABLE extra (a INT); CALL vc_add('extra')", "SELECT * FROM vc_status", "SELECT * FROM (VALUES ('n', false, 'modified'), ('extra', true, 'new table')) t(table_name, staged, status)")
scripted("repo_workspace", "nation", _NATION + "CALL vc_commit('-Am', 'base'); UPDATE n SET hits = 7 WHERE id IN (2, 3, 4); DELETE FROM n WHERE id = 9; UPDATE vc_workspace_n SET staged = TRUE WHERE to_id = 2 OR from_id = 9; DELETE FROM vc_workspace_n WHERE to_id = 3", "SELECT staged, diff_type, coalesce(to_id, from_id) AS id, from_hits, to_hits FROM vc_workspace_n", "SELECT * FROM (VALUES (true, 'modified', 2, 0, 7), (true, 'removed', 9, 0, NULL), (false, 'modified', 4, 0, 7)) t(staged, diff_type, id, from_hits, to_hits)")
scripted("repo_status_ignored", "region", "INSERT INTO vc_ignore VALUES ('tmp_%', TRUE), ('tmp_keep', FALSE); CREATE TABLE tmp_a (a INT); CREATE TABLE tmp_keep (a INT); CALL vc_add('-A')", "SELECT table_name, staged, ignored FROM vc_status_ignored", "SELECT * FROM (VALUES ('vc_ignore', true, false), ('tmp_keep', true, false), ('tmp_a', false, true)) t(table_name, staged, ignored)")
scripted("repo_schema_diff", "region", "CREATE TABLE t (pk INT PRIMARY KEY, c VARCHAR(9)); CALL vc_commit('-Am', 'one'); ALTER TABLE t ADD COLUMN d INT NOT NULL DEFAULT 5", "SELECT * FROM vc_schema_diff('HEAD', 'WORKING')", "SELECT 't' AS from_table_name, 't' AS to_table_name, 'CREATE TABLE `t` (' || chr(10) || '  `pk` int NOT NULL,' || chr(10) || '  `c` longtext,' || chr(10) || '  PRIMARY KEY (`pk`)' || chr(10) || ');' AS from_create_statement, 'CREATE TABLE `t` (' || chr(10) || '  `pk` int NOT NULL,' || chr(10) || '  `c` longtext,' || chr(10) || '  `d` int NOT NULL DEFAULT 5,' || chr(10) || '  PRIMARY KEY (`pk`)' || chr(10) || ');' AS to_create_statement")
scripted("repo_patch", "nation", _NATION + "CALL vc_commit('-Am', 'base'); UPDATE n SET hits = 1, name = 'it''s' WHERE id = 3; DELETE FROM n WHERE id > 22; INSERT INTO n VALUES (77, 'new', NULL, 1)", "SELECT diff_type, statement FROM vc_patch('HEAD', 'WORKING', 'n')", "SELECT 'data' AS diff_type, 'DELETE FROM `n` WHERE `id`=' || n_nationkey || ';' AS statement FROM nation WHERE n_nationkey > 22 UNION ALL SELECT 'data', 'UPDATE `n` SET `name`=''it''''s'',`hits`=1 WHERE `id`=3;' UNION ALL SELECT 'data', 'INSERT INTO `n` (`id`,`name`,`region`,`hits`) VALUES (77,''new'',NULL,1);'")
scripted("repo_keyless", "lineitem", f"CREATE TABLE b AS {fx.BAG_FROM}; CALL vc_commit('-Am', 'one'); DELETE FROM b WHERE qty > 40; INSERT INTO b SELECT l_suppkey, CAST(l_quantity AS INT) FROM lineitem WHERE l_orderkey % 11 = 0; CALL vc_commit('-Am', 'two')", "SELECT s.rows_added, s.rows_deleted, d.n, d.a, (SELECT COUNT(*) FROM b) AS total FROM vc_diff_stat('HEAD~1', 'HEAD', 'b') s, (SELECT COUNT(*) AS n, COUNT(to_qty) AS a FROM vc_diff_b WHERE to_commit = vc_hashof('HEAD')) d", "WITH o AS (SELECT l_suppkey, qty, COUNT(*) AS k FROM (" + fx.BAG_FROM + ") GROUP BY ALL), e AS (SELECT l_suppkey, qty, COUNT(*) AS k FROM (SELECT * FROM (" + fx.BAG_FROM + ") WHERE qty <= 40 UNION ALL SELECT l_suppkey, CAST(l_quantity AS INT) FROM lineitem WHERE l_orderkey % 11 = 0) GROUP BY ALL), x AS (SELECT coalesce(e.k, 0) - coalesce(o.k, 0) AS d, e.k FROM o FULL JOIN e ON o.l_suppkey = e.l_suppkey AND o.qty = e.qty) SELECT CAST(SUM(greatest(d, 0)) AS BIGINT) AS rows_added, CAST(SUM(greatest(-d, 0)) AS BIGINT) AS rows_deleted, CAST(SUM(abs(d)) AS BIGINT) AS n, CAST(SUM(greatest(d, 0)) AS BIGINT) AS a, CAST(SUM(k) AS BIGINT) AS total FROM x")
scripted("repo_copies_have_their_hash", "region", "CREATE TABLE a (v INT); INSERT INTO a VALUES (0), (0); CREATE TABLE b (v INT); INSERT INTO b VALUES (9), (9); CALL vc_commit('-Am', 'one'); DELETE FROM a; INSERT INTO a VALUES (9), (9)", "SELECT v, COUNT(*) AS n, vc_hashof_table('a') = vc_hashof_table('b') AS same, vc_hashof_table('a', 'HEAD') = vc_hashof_table('b') AS before FROM a GROUP BY v", "SELECT 9 AS v, CAST(2 AS BIGINT) AS n, true AS same, false AS before")
scripted("repo_violations", "nation region", "SET foreign_key_checks = 0; CREATE TABLE r AS SELECT * FROM region WHERE r_regionkey > 1; ALTER TABLE r ADD PRIMARY KEY (r_regionkey); CREATE TABLE n (id INT PRIMARY KEY, region INT, FOREIGN KEY fk (region) REFERENCES r (r_regionkey)); INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation", "SELECT v.violation_type, v.violation_info, v.id, v.region, c.n FROM vc_constraint_violations_n v, vc_constraint_violations c", "SELECT 'foreign key' AS violation_type, 'region -> r(r_regionkey)' AS violation_info, n_nationkey AS id, n_regionkey AS region, (SELECT COUNT(*) FROM nation WHERE n_regionkey <= 1) AS n FROM nation WHERE n_regionkey <= 1")
scripted("repo_merge_violations", "nation region", "CREATE TABLE r AS SELECT * FROM region; ALTER TABLE r ADD PRIMARY KEY (r_regionkey); CREATE TABLE n (id INT PRIMARY KEY, region INT, FOREIGN KEY (region) REFERENCES r (r_regionkey)); INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey < 3; CALL vc_commit('-Am', 'base'); CALL vc_branch('other'); INSERT INTO n VALUES (100, 4); CALL vc_commit('-am', 'child'); CALL vc_checkout('other'); DELETE FROM r WHERE r_regionkey = 4; CALL vc_commit('-am', 'parent'); CALL vc_checkout('main'); CALL vc_merge('other')", "SELECT s.table_name, s.status, v.id, v.region FROM vc_status s, vc_constraint_violations_n v WHERE s.status = 'constraint violation'", "SELECT 'n' AS table_name, 'constraint violation' AS status, 100 AS id, 4 AS region")
scripted("repo_schema_merge", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_branch('other'); ALTER TABLE n ADD COLUMN a INT DEFAULT 3; UPDATE n SET hits = 1 WHERE id = 1; CALL vc_commit('-am', 'a'); CALL vc_checkout('other'); ALTER TABLE n DROP COLUMN region; UPDATE n SET name = 'y' WHERE id = 1; CALL vc_commit('-am', 'b'); CALL vc_checkout('main'); CALL vc_merge('other')", "SELECT * FROM n", "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'y' ELSE n_name END AS name, CASE WHEN n_nationkey = 1 THEN 1 ELSE 0 END AS hits, 3 AS a FROM nation")
scripted("repo_schema_conflicts", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_branch('other'); ALTER TABLE n ADD COLUMN a INT; CALL vc_commit('-am', 'a'); CALL vc_checkout('other'); ALTER TABLE n ADD COLUMN a VARCHAR(9); CALL vc_commit('-am', 'b'); CALL vc_checkout('main'); CALL vc_merge('other')", "SELECT table_name, description, (SELECT num_schema_conflicts FROM vc_preview_merge_conflicts_summary('main', 'other')) AS n FROM vc_schema_conflicts", "SELECT 'n' AS table_name, 'NameCollision: a has types int and string' AS description, CAST(1 AS BIGINT) AS n")
scripted("repo_conflicts_edit", "nation", _NATION + "CALL vc_commit('-Am', 'base'); CALL vc_branch('other'); UPDATE n SET hits = 1 WHERE id < 4; CALL vc_commit('-am', 'a'); CALL vc_checkout('other'); UPDATE n SET hits = 2 WHERE id < 3; CALL vc_commit('-am', 'b'); CALL vc_checkout('main'); CALL vc_merge('other'); UPDATE vc_conflicts_n SET our_hits = their_hits + 10 WHERE our_id = 1; DELETE FROM vc_conflicts_n WHERE our_id IN (0, 1)", "SELECT n.id, n.hits, c.our_id AS open FROM n, vc_conflicts_n c WHERE n.id < 5", "SELECT * FROM (VALUES (0, 1, 2), (1, 12, 2), (2, 1, 2), (3, 1, 2), (4, 0, 2)) t(id, hits, open)")
scripted("repo_json_merge", "region", "CREATE TABLE d (id INT PRIMARY KEY, j JSON); INSERT INTO d VALUES (1, '{\"a\":1,\"b\":{\"c\":2}}'), (2, '{\"k\":0}'); CALL vc_commit('-Am', 'base'); CALL vc_branch('other'); UPDATE d SET j = JSON_SET(j, '$.a', 5) WHERE id = 1; UPDATE d SET j = JSON_SET(j, '$.k', 1) WHERE id = 2; CALL vc_commit('-am', 'a'); CALL vc_checkout('other'); UPDATE d SET j = JSON_SET(j, '$.b.c', 3, '$.n', 'x') WHERE id = 1; UPDATE d SET j = JSON_SET(j, '$.k', 2) WHERE id = 2; CALL vc_commit('-am', 'b'); CALL vc_checkout('main'); CALL vc_merge('other')", "SELECT d.id, d.j, c.our_id AS conflict FROM d, vc_conflicts_d c", "SELECT * FROM (VALUES (1, '{\"a\":5,\"b\":{\"c\":3},\"n\":\"x\"}', 2), (2, '{\"k\":1}', 2)) t(id, j, conflict)")
scripted("repo_filter_and_docs", "region", "INSERT INTO vc_docs VALUES ('README.md', 'hello'); INSERT INTO vc_query_catalog VALUES ('q1', 1, 'all', 'SELECT 1', 'd'); INSERT INTO vc_tests VALUES ('t1', 'g', 'SELECT COUNT(*) FROM vc_docs', 'expected_single_value', '==', '1'), ('t2', 'g', 'SELECT 5', 'expected_single_value', '<', '5'); CALL vc_commit('-Am', 'docs')", "SELECT t.test_name, t.status, d.doc_text, q.name FROM vc_test_run('*') t, vc_docs d, vc_query_catalog q", "SELECT * FROM (VALUES ('t1', 'PASS', 'hello', 'all'), ('t2', 'FAIL', 'hello', 'all')) t(test_name, status, doc_text, name)")
scripted("repo_nonlocal", "region", "CREATE TABLE shared AS SELECT * FROM region; CALL vc_commit('-Am', 'base'); CALL vc_tag('old'); CALL vc_checkout('-b', 'side'); DROP TABLE shared; CALL vc_commit('-Am', 'gone'); INSERT INTO vc_nonlocal_tables VALUES ('lib_%', 'old', 'shared', 'immediate')", "SELECT * FROM lib_regions", "SELECT * FROM region")
scripted("repo_statistics", "customer", "CREATE TABLE c AS SELECT c_custkey, c_nationkey, c_mktsegment FROM customer; ALTER TABLE c ADD PRIMARY KEY (c_custkey); ANALYZE TABLE c", "SELECT column_name, row_count, null_count, distinct_count, lower_bound, upper_bound, current FROM vc_statistics", " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, CAST(0 AS BIGINT) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, CAST(MIN({c}) AS VARCHAR) AS lower_bound, CAST(MAX({c}) AS VARCHAR) AS upper_bound, true AS current FROM customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment")))
scripted("repo_diff_vc_schemas", "region", "CREATE VIEW v AS SELECT 1 AS one; CALL vc_commit('-Am', 'one'); CREATE OR REPLACE VIEW v AS SELECT 2 AS one; CALL vc_commit('-Am', 'two')", "SELECT l.message, d.diff_type, d.to_name, h.n FROM vc_diff_vc_schemas d JOIN vc_log l ON l.commit_hash = d.to_commit, (SELECT COUNT(*) AS n FROM vc_history_vc_schemas) h", "SELECT * FROM (VALUES ('one', 'added', 'v', CAST(2 AS BIGINT)), ('two', 'modified', 'v', CAST(2 AS BIGINT))) t(message, diff_type, to_name, n)")
scripted("repo_remotes", "region", "CALL vc_remote('add', 'origin', 'file:///a'); CALL vc_backup('add', 'safe', 'file:///b'); CREATE TABLE t (a INT); CALL vc_commit('-Am', 'one')", "SELECT 'remote' AS kind, name, url FROM vc_remotes UNION ALL SELECT 'backup', name, url FROM vc_backups UNION ALL SELECT 'branch', branch, CAST(last_write IS NOT NULL AS STRING) FROM vc_branch_activity", "SELECT * FROM (VALUES ('remote', 'origin', 'file:///a'), ('backup', 'safe', 'file:///b'), ('branch', 'main', 'true')) t(kind, name, url)")
scripted("repo_auto_commit", "region", "SET @@vc_transaction_commit = 1; SET @@vc_transaction_commit_message = 'auto'; CREATE TABLE t (a INT PRIMARY KEY); INSERT INTO t VALUES (1); START TRANSACTION; INSERT INTO t VALUES (2); INSERT INTO t VALUES (3); COMMIT", "SELECT message, COUNT(*) AS n, (SELECT COUNT(*) FROM t AS OF 'HEAD') AS t FROM vc_log WHERE message = 'auto' GROUP BY message", "SELECT 'auto' AS message, CAST(3 AS BIGINT) AS n, CAST(3 AS BIGINT) AS t")

# --- SQL beyond Spark's

_T = "CREATE TABLE t (id INT PRIMARY KEY, c VARCHAR(20), n INT DEFAULT 5); INSERT INTO t (id, c) VALUES (1, 'a'), (2, 'b'); INSERT INTO t VALUES (3, 'c', 10);"
scripted("sql_on_duplicate", "region", _T + "INSERT INTO t VALUES (1, 'z', 5), (9, 'new', 1) ON DUPLICATE KEY UPDATE n = n + 100 + VALUES(n), c = concat(c, '!'); INSERT INTO t VALUES (2, 'x', 1), (2, 'y', 2) AS new ON DUPLICATE KEY UPDATE c = concat(t.c, new.c), n = new.n", "SELECT * FROM t", "SELECT * FROM (VALUES (1, 'a!', 110), (9, 'new', 1), (2, 'bxy', 2), (3, 'c', 10)) t(id, c, n)")
scripted("sql_literals", "region", "CREATE TABLE t (id INT, s VARCHAR(99)); INSERT INTO t VALUES (1, 'length(x)'), (2, 'a as signed)'), (3, 'it''s -- no comment'), (4, \"say \\\"hi\\\" ; ->> '$.a'\"), (5, 'FROM t AS OF ''v1''')", "SELECT id, s, s = 'length(x)' AS f, length(s) AS n FROM t", "SELECT id, s, s = 'length(x)' AS f, strlen(s) AS n FROM (VALUES (1, 'length(x)'), (2, 'a as signed)'), (3, 'it''s -- no comment'), (4, 'say \"hi\" ; ->> ''$.a'''), (5, 'FROM t AS OF ''v1''')) t(id, s)")
scripted("sql_defaults", "region", "CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, c VARCHAR(9) NOT NULL DEFAULT 'd', n INT DEFAULT (2 + 3), g INT AS (n * 2)); INSERT INTO t (c) VALUES ('a'), ('b'); INSERT INTO t (n) VALUES (7); INSERT INTO t (id, c, n) VALUES (10, 'x', DEFAULT), (NULL, 'y', NULL); INSERT INTO t () VALUES (); UPDATE t SET n = 1, c = DEFAULT WHERE id = 2; ALTER TABLE t ALTER COLUMN n SET DEFAULT 8; INSERT INTO t (c) VALUES ('z')", "SELECT * FROM t", "SELECT * FROM (VALUES (1, 'a', 5, 10), (2, 'd', 1, 2), (3, 'd', 7, 14), (10, 'x', 5, 10), (11, 'y', NULL, NULL), (12, 'd', 5, 10), (13, 'z', 8, 16)) t(id, c, n, g)")
scripted("sql_auto_increment_select", "nation", "CREATE TABLE t (id BIGINT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(30)); INSERT INTO t VALUES (5, 'five'); INSERT INTO t (name) SELECT n_name FROM nation", "SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, MIN(id) AS low, MAX(id) AS high, LAST_INSERT_ID() AS last FROM t", "SELECT COUNT(*) + 1 AS n, COUNT(*) + 1 AS ids, 5 AS low, COUNT(*) + 5 AS high, 6 AS last FROM nation")


def refused(name: str, tables: str, script: str, statements: Sequence[str], expected: Sequence[bool]) -> None:
    """Which statements a database refuses, and that a refused one changes nothing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = fresh(spark, sf_dir, tables.split())
        s.run_script(script)
        rows = []
        for i, text in enumerate(statements):
            before = s.repo.hash_of_db()
            try:
                s.sql(text)
                rows.append((i, False, s.repo.hash_of_db() != before))
            except ValueError:
                rows.append((i, True, s.repo.hash_of_db() != before))
        return spark.createDataFrame(rows, "i int, refused boolean, changed boolean")

    register(name, run, "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(e).lower()}, {str(not e).lower()})" for i, e in enumerate(expected)) + ") t(i, refused, changed)")


refused("sql_enforced", "region", "CREATE TABLE p (id INT PRIMARY KEY); INSERT INTO p VALUES (1), (2); CREATE TABLE t (id INT PRIMARY KEY, u INT UNIQUE, n INT NOT NULL, c INT, p INT, CONSTRAINT low CHECK (c < 10), CONSTRAINT fk FOREIGN KEY (p) REFERENCES p (id)); INSERT INTO t VALUES (1, 1, 1, 1, 1)",
        ["INSERT INTO t VALUES (1, 2, 2, 2, 1)", "INSERT INTO t VALUES (2, 1, 2, 2, 1)", "INSERT INTO t VALUES (2, 2, NULL, 2, 1)", "INSERT INTO t VALUES (2, 2, 2, 10, 1)", "INSERT INTO t VALUES (2, 2, 2, NULL, 3)", "INSERT INTO t (id, u) VALUES (2, 2)", "INSERT INTO t VALUES (2, NULL, 2, NULL, NULL), (3, NULL, 2, 9, 2)", "INSERT INTO t VALUES (4, 4, 4, 4, 1), (4, 5, 4, 4, 1)", "DELETE FROM p WHERE id = 1", "UPDATE t SET u = 1 WHERE id = 2", "UPDATE t SET id = 1 WHERE id = 2", "UPDATE t SET c = 50 WHERE id = 3", "UPDATE p SET id = 9 WHERE id = 2", "ALTER TABLE t ADD CONSTRAINT pos CHECK (id > 5)", "ALTER TABLE t DROP CONSTRAINT low", "INSERT INTO t VALUES (4, 4, 4, 400, 1)", "DROP TABLE p", "TRUNCATE TABLE t"],
        [True, True, True, True, True, True, False, True, True, True, True, True, True, True, False, False, True, False])
scripted("sql_add_constraint", "region", "CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE t (id INT PRIMARY KEY, p INT, c INT); ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (p) REFERENCES p (id) ON DELETE CASCADE; ALTER TABLE t ADD CONSTRAINT low CHECK (c < 10), ADD UNIQUE KEY u (c); CREATE INDEX i ON t (p)", "SELECT constraint_name, table_name, constraint_type, (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 't') AS columns FROM information_schema.table_constraints", "SELECT * FROM (VALUES ('PRIMARY', 'p', 'PRIMARY KEY', CAST(3 AS BIGINT)), ('PRIMARY', 't', 'PRIMARY KEY', 3), ('f', 't', 'FOREIGN KEY', 3), ('low', 't', 'CHECK', 3), ('u', 't', 'UNIQUE', 3)) t(constraint_name, table_name, constraint_type, columns)")
scripted("sql_cascade", "nation region", "CREATE TABLE r (id INT PRIMARY KEY); CREATE TABLE n (id INT PRIMARY KEY, r INT, FOREIGN KEY (r) REFERENCES r (id) ON DELETE CASCADE ON UPDATE CASCADE); CREATE TABLE s (id INT PRIMARY KEY, n INT, FOREIGN KEY (n) REFERENCES n (id) ON DELETE SET NULL); INSERT INTO r SELECT r_regionkey FROM region; INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO s SELECT n_nationkey, n_nationkey FROM nation; DELETE FROM r WHERE id = 2; UPDATE r SET id = 33 WHERE id = 3", "SELECT s.id, s.n, n.r FROM s LEFT JOIN n ON s.n = n.id", "SELECT n_nationkey AS id, CASE WHEN n_regionkey <> 2 THEN n_nationkey END AS n, CASE n_regionkey WHEN 2 THEN NULL WHEN 3 THEN 33 ELSE n_regionkey END AS r FROM nation")
scripted("sql_views", "nation", _NATION + "CREATE VIEW low AS SELECT id, name FROM n WHERE id < 9; CREATE VIEW lower_still (k) AS SELECT id FROM low WHERE id < 4; CALL vc_commit('-Am', 'one'); CALL vc_tag('v1'); DELETE FROM n WHERE id = 2; CREATE OR REPLACE VIEW low AS SELECT id, name FROM n WHERE id < 6", "SELECT 'now' AS at, l.id, s.k FROM low l LEFT JOIN lower_still s ON s.k = l.id UNION ALL SELECT 'v1', id, NULL FROM low AS OF 'v1'", "SELECT 'now' AS at, n_nationkey AS id, CASE WHEN n_nationkey < 4 THEN n_nationkey END AS k FROM nation WHERE n_nationkey < 6 AND n_nationkey <> 2 UNION ALL SELECT 'v1', n_nationkey, NULL FROM nation WHERE n_nationkey < 9")
scripted("sql_variables", "customer nation", "SET @top = (SELECT MAX(n_nationkey) FROM nation), @low := 3; SELECT COUNT(*), MIN(c_custkey) INTO @n, @first FROM customer; SET @text = 'it''s'", "SELECT c_custkey, @n AS n, @text AS s, @first + @low AS f FROM customer WHERE c_nationkey = @top", "SELECT c_custkey, (SELECT COUNT(*) FROM customer) AS n, 'it''s' AS s, (SELECT MIN(c_custkey) FROM customer) + 3 AS f FROM customer WHERE c_nationkey = (SELECT MAX(n_nationkey) FROM nation)")
scripted("sql_prepared", "nation", _NATION + "CALL vc_commit('-Am', 'one'); CALL vc_tag('v1'); UPDATE n SET hits = 1 WHERE id = 3; SET @a = 'v1', @b = 'WORKING'; PREPARE q FROM 'SELECT to_id, from_hits, to_hits FROM vc_diff(?, ?, ''n'')'; SET @d = 'UPDATE n SET hits = ? WHERE id = ?'; PREPARE u FROM @d; SET @v = 8, @i = 4; EXECUTE u USING @v, @i", "EXECUTE q USING @a, @b", "SELECT * FROM (VALUES (3, 0, 1), (4, 0, 8)) t(to_id, from_hits, to_hits)")
scripted("sql_update_join", "nation region", _NATION + "CREATE TABLE r AS SELECT r_regionkey AS id, r_name AS name FROM region; UPDATE n JOIN r ON n.region = r.id SET n.hits = r.id * 10, n.name = concat(n.name, '/', r.name) WHERE r.id < 3; UPDATE n AS x SET x.hits = -1 ORDER BY id DESC LIMIT 2", "SELECT * FROM n", "SELECT n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN n_name || '/' || r_name ELSE n_name END AS name, n_regionkey AS region, CASE WHEN n_nationkey >= 23 THEN -1 WHEN n_regionkey < 3 THEN n_regionkey * 10 ELSE 0 END AS hits FROM nation JOIN region ON n_regionkey = r_regionkey")
scripted("sql_delete_join", "nation region", _NATION + "CREATE TABLE r AS SELECT r_regionkey AS id, r_name AS name FROM region; DELETE n FROM n JOIN r ON n.region = r.id WHERE r.id = 1; DELETE FROM n USING n JOIN r ON n.region = r.id WHERE r.id = 2 AND n.id > 9; DELETE FROM n WHERE region = 4 ORDER BY id LIMIT 1; DELETE FROM n WHERE id IN (SELECT id FROM r WHERE id = 0)", "SELECT id FROM n", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 1 AND NOT (n_regionkey = 2 AND n_nationkey > 9) AND n_nationkey <> (SELECT MIN(n_nationkey) FROM nation WHERE n_regionkey = 4) AND n_nationkey <> 0")
scripted("sql_replace_ignore", "region", _T + "REPLACE INTO t VALUES (3, 'r', 1), (3, 'rr', 2); INSERT IGNORE INTO t VALUES (3, 'never', 1), (4, 'e', 1), (4, 'f', 2); INSERT INTO t SET id = 6, c = 'set'", "SELECT id, c = 'never' AS never, n FROM t WHERE id <> 4 UNION ALL SELECT id, c IN ('e', 'f'), 0 FROM t WHERE id = 4", "SELECT * FROM (VALUES (1, false, 5), (2, false, 5), (3, false, 2), (6, false, 5), (4, true, 0)) t(id, never, n)")
scripted("sql_alter", "nation", _NATION + "ALTER TABLE n ADD COLUMN a INT DEFAULT 7 FIRST, ADD b VARCHAR(5) AFTER id; ALTER TABLE n RENAME COLUMN region TO r; ALTER TABLE n MODIFY COLUMN r BIGINT; ALTER TABLE n CHANGE hits seen DOUBLE; ALTER TABLE n DROP COLUMN name; RENAME TABLE n TO m; CREATE TABLE l LIKE m; ALTER TABLE l DROP PRIMARY KEY", "SELECT m.*, (SELECT COUNT(*) FROM information_schema.columns WHERE table_name = 'l' AND column_key = '') AS k FROM m", "SELECT 7 AS a, n_nationkey AS id, NULL AS b, CAST(n_regionkey AS BIGINT) AS r, CAST(0 AS DOUBLE) AS seen, CAST(5 AS BIGINT) AS k FROM nation".replace("7 AS a,", "7 AS a,"))
scripted("sql_transactions", "region", _T + "START TRANSACTION; INSERT INTO t VALUES (7, 'in', 1); SAVEPOINT s; DELETE FROM t; ROLLBACK TO s; COMMIT; BEGIN; UPDATE t SET c = 'lost'; ROLLBACK", "SELECT * FROM t", "SELECT * FROM (VALUES (1, 'a', 5), (2, 'b', 5), (3, 'c', 10), (7, 'in', 1)) t(id, c, n)")
scripted("sql_recursive_distinct", "nation", "CREATE TABLE e (a INT, b INT); INSERT INTO e VALUES (1, 2), (2, 3), (3, 1), (3, 4), (7, 8)", "WITH RECURSIVE r (n) AS (SELECT 1 UNION SELECT b FROM e JOIN r ON e.a = r.n) SELECT n FROM r", "SELECT * FROM (VALUES (1), (2), (3), (4)) t(n)")
scripted("sql_procedure", "nation", _NATION + "CREATE PROCEDURE bump (IN k INT, IN by_ INT) BEGIN UPDATE n SET hits = hits + by_ WHERE id = k; UPDATE n SET name = concat(name, '*') WHERE id = k; END; CALL bump(3, 4); CALL bump(3, 5)", "SELECT n.id, n.name, n.hits, p.name AS procedure FROM n, vc_procedures p WHERE n.id IN (2, 3)", "SELECT n_nationkey AS id, CASE n_nationkey WHEN 3 THEN n_name || '**' ELSE n_name END AS name, CASE n_nationkey WHEN 3 THEN 9 ELSE 0 END AS hits, 'bump' AS procedure FROM nation WHERE n_nationkey IN (2, 3)")
scripted("sql_json", "region", "CREATE TABLE d (id INT PRIMARY KEY, j JSON); INSERT INTO d VALUES (1, '{\"a\": 1, \"b\": [1, 2, {\"c\": \"x\"}]}'), (2, JSON_OBJECT('a', 7, 's', 'it')), (3, NULL); UPDATE d SET j = JSON_REMOVE(JSON_SET(j, '$.n.m', 5, '$.a', NULL), '$.s') WHERE id = 2", "SELECT id, j->>'$.b[2].c' AS c, j->'$.b[2].c' AS q, JSON_EXTRACT(j, '$.a') AS a, JSON_LENGTH(j) AS n, JSON_VALID(j) AS v, JSON_CONTAINS(j, '1', '$.a') AS has, JSON_MERGE_PATCH(j, '{\"z\":0}') AS m, JSON_ARRAY(id, 'x') AS l FROM d", "SELECT * FROM (VALUES (1, 'x', '\"x\"', '1', 2, 1, 1, '{\"a\":1,\"b\":[1,2,{\"c\":\"x\"}],\"z\":0}', '[1,\"x\"]'), (2, NULL, NULL, 'null', 2, 1, 0, '{\"a\":null,\"n\":{\"m\":5},\"z\":0}', '[2,\"x\"]'), (3, NULL, NULL, NULL, NULL, 0, NULL, NULL, '[3,\"x\"]')) t(id, c, q, a, n, v, has, m, l)")
scripted("sql_json_table", "events", "CREATE TABLE d (id INT PRIMARY KEY, j JSON); INSERT INTO d VALUES (1, '{\"items\": [{\"k\": 5, \"s\": \"a\"}, {\"k\": 6}]}'), (2, '{\"items\": []}')", "SELECT d.id, t.n, t.k, t.s FROM d, JSON_TABLE(d.j, '$.items[*]' COLUMNS (n FOR ORDINALITY, k INT PATH '$.k', s VARCHAR(9) PATH '$.s' DEFAULT 'none' ON EMPTY)) AS t", "SELECT * FROM (VALUES (1, 1, 5, 'a'), (1, 2, 6, 'none')) t(id, n, k, s)")
scripted("sql_json_aggregates", "nation", "CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(5)); INSERT INTO t VALUES (1, 'b'), (2, 'a'), (3, 'b')", "SELECT JSON_LENGTH(JSON_ARRAYAGG(id)) AS n, GROUP_CONCAT(DISTINCT s ORDER BY s DESC SEPARATOR '; ') AS g, GROUP_CONCAT(id) AS ids, JSON_EXTRACT(JSON_OBJECTAGG(id, s), '$.\"2\"') AS two FROM t", "SELECT 3 AS n, 'b; a' AS g, '1,2,3' AS ids, '\"a\"' AS two")
scripted("sql_vectors", "embeddings", "CREATE TABLE v (id INT PRIMARY KEY, e VECTOR(2), VECTOR INDEX ix (e)); INSERT INTO v VALUES (1, '[1, 2]'), (2, STRING_TO_VECTOR('[4, 6]')), (3, '[0, 0]')", "SELECT id, VEC_DISTANCE(e, '[1, 2]') AS d, ROUND(VEC_DISTANCE_COSINE(e, '[2, 1]'), 6) AS c, VECTOR_TO_STRING(e) AS s FROM v ORDER BY VEC_DISTANCE('[1, 2]', e) LIMIT 2", "SELECT * FROM (VALUES (1, 0.0, ROUND(1 - 4 / 5.0, 6), '[1.0,2.0]'), (3, 5.0, NULL, '[0.0,0.0]')) t(id, d, c, s)")
scripted("sql_fulltext", "benchmark", "CREATE TABLE b AS SELECT item_id, text FROM benchmark; ALTER TABLE b ADD FULLTEXT KEY ft (text)", "SELECT item_id FROM b WHERE MATCH (text) AGAINST ('the was')", "SELECT item_id FROM benchmark WHERE len(list_intersect(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda w: w <> ''), ['the', 'was'])) > 0")
scripted("sql_spatial", "region", "CREATE TABLE g (id INT PRIMARY KEY, p POINT, l LINESTRING); INSERT INTO g VALUES (1, POINT(1, 2.5), ST_GeomFromText('LINESTRING(0 0, 3 4, 3 5)')), (2, ST_GeomFromText('POINT(9 9)'), NULL)", "SELECT id, ST_X(p) AS x, ST_AsWKT(p) AS w, ST_AsText(l) AS lt, ST_Length(l) AS len, ROUND(ST_Distance(p, POINT(1, 0)), 6) AS d, ST_Within(p, POLYGON(LINESTRING(POINT(0,0), POINT(5,0), POINT(5,5), POINT(0,5), POINT(0,0)))) AS i FROM g", "SELECT * FROM (VALUES (1, 1.0, 'POINT(1 2.5)', 'LINESTRING(0 0,3 4,3 5)', 6.0, 2.5, true), (2, 9.0, 'POINT(9 9)', NULL, NULL, ROUND(sqrt(145), 6), false)) t(id, x, w, lt, len, d, i)")
scripted("sql_dates", "orders", "CREATE TABLE o AS SELECT o_orderkey, o_orderdate FROM orders", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m/%d') AS f, DATE_ADD(o_orderdate, INTERVAL 40 DAY) AS a, TIMESTAMPDIFF(DAY, '1992-01-01', o_orderdate) AS d, DATEDIFF(o_orderdate, '1995-06-17') AS e, MONTHNAME(o_orderdate) AS m, DAYNAME(o_orderdate) AS w, STR_TO_DATE('03/05/2024', '%d/%m/%Y') AS s, EXTRACT(YEAR FROM o_orderdate) AS y, CONVERT_TZ(o_orderdate, '+00:00', '+02:00') AS tz, TO_DAYS(o_orderdate) - 719528 AS days FROM o", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS f, CAST(o_orderdate + INTERVAL 40 DAY AS TIMESTAMP) AS a, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d, datediff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) AS e, monthname(o_orderdate) AS m, dayname(o_orderdate) AS w, TIMESTAMP '2024-05-03' AS s, year(o_orderdate) AS y, o_orderdate + INTERVAL 2 HOUR AS tz, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
scripted("sql_strings", "customer", "CREATE TABLE c AS SELECT c_custkey, c_name, c_mktsegment FROM customer", "SELECT c_custkey, LENGTH('é') AS l, CHAR_LENGTH('é') AS cl, STRCMP(c_name, c_mktsegment) AS cmp, FIELD(c_mktsegment, 'AUTOMOBILE', 'BUILDING') AS f, ELT(2, 'a', 'b') AS e, INSERT(c_name, 1, 3, 'x') AS i, MID(c_name, 2, 3) AS m, FIND_IN_SET('b', 'a,b,c') AS fs, SUBSTRING_INDEX(c_name, '#', 1) AS si, TO_BASE64(c_name) AS b, TRUNCATE(-1.567, 2) AS t, 7 DIV 2 AS dv, 7 / 0 AS dz, 7 MOD 0 AS mz, IF(c_custkey > 5, 'y', 'n') AS yn, CONVERT(c_custkey, CHAR) AS ch, CAST('12' AS SIGNED) AS sg, REGEXP_LIKE(c_name, '^cust', 'i') AS rl, REGEXP_SUBSTR(c_name, '[1-9]+$') AS rs, c_mktsegment COLLATE utf8mb4_0900_ai_ci = 'building' AS ci FROM c", "SELECT c_custkey, 2 AS l, 1 AS cl, CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END AS cmp, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS f, 'b' AS e, 'x' || substr(c_name, 4) AS i, substr(c_name, 2, 3) AS m, 2 AS fs, split_part(c_name, '#', 1) AS si, base64(encode(c_name)) AS b, -1.56 AS t, 3 AS dv, NULL AS dz, NULL AS mz, CASE WHEN c_custkey > 5 THEN 'y' ELSE 'n' END AS yn, CAST(c_custkey AS VARCHAR) AS ch, 12 AS sg, regexp_matches(c_name, '^cust', 'i') AS rl, CASE WHEN regexp_matches(c_name, '[1-9]+$') THEN regexp_extract(c_name, '[1-9]+$') END AS rs, lower(c_mktsegment) = 'building' AS ci FROM customer")
scripted("sql_limit_hints", "customer nation", "CREATE TABLE c AS SELECT c_custkey, c_nationkey FROM customer; CREATE TABLE n AS SELECT * FROM nation", "SELECT /*+ HASH_JOIN(c, n) */ c.c_custkey, n.n_name FROM c STRAIGHT_JOIN n ON c.c_nationkey = n.n_nationkey ORDER BY c.c_custkey LIMIT 5, 7", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 7 OFFSET 5")
scripted("sql_dual_show", "region", "CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(9) DEFAULT 'x')", "DESCRIBE t", "SELECT * FROM (VALUES ('id', 'int', 'NO', 'PRI', NULL, ''), ('s', 'longtext', 'YES', '', 'x', '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")")
scripted("sql_show_tables", "region", "CREATE TABLE a (i INT); CREATE TABLE b (i INT); CREATE VIEW v AS SELECT 1 AS x FROM DUAL", "SHOW TABLES LIKE '%'", "SELECT * FROM (VALUES ('a'), ('b'), ('v')) t(\"Tables_in_main_db\")")


scripted("sql_any_value", "nation", _NATION + "SET sql_mode = 'STRICT_TRANS_TABLES'", "SELECT region, n.hits, COUNT(*) AS k FROM n GROUP BY region", "SELECT n_regionkey AS region, 0 AS hits, COUNT(*) AS k FROM nation GROUP BY n_regionkey")
asked("repo_point_lookup", chain, "SELECT * FROM orders WHERE o_orderkey = 77 AND o_custkey > 0", f"SELECT * FROM ({fx.CHAIN[5]}) WHERE o_orderkey = 77 AND o_custkey > 0")
asked("repo_lookup_list", chain, "SELECT o.o_orderkey, o.o_orderstatus FROM orders AS OF 'c2' o WHERE o.o_orderkey IN (1, 2, 13, 45, 999) ORDER BY o_orderkey LIMIT 4", f"SELECT o_orderkey, o_orderstatus FROM ({fx.CHAIN[2]}) WHERE o_orderkey IN (1, 2, 13, 45, 999) ORDER BY o_orderkey LIMIT 4")


def _indexed(ask: Callable[[Session], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, "indexed")
        if key not in _built:
            s = fresh(spark, sf_dir, ["customer"])
            s.run_script("CREATE TABLE c AS SELECT * FROM customer; ALTER TABLE c ADD PRIMARY KEY (c_custkey); CREATE INDEX by_nation ON c (c_nationkey, c_acctbal)")
            _built[key] = s
        return ask(_built[key])

    return run


register("index_covering", _indexed(lambda s: s.repo.index_lookup("c", "by_nation", "c_nationkey = 7", ["c_custkey", "c_acctbal"])), "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7")
register("index_lookup", _indexed(lambda s: s.repo.index_lookup("c", "by_nation", "c_nationkey BETWEEN 3 AND 4 AND c_acctbal < 500")), "SELECT * FROM customer WHERE c_nationkey BETWEEN 3 AND 4 AND c_acctbal < 500")
register("index_ordered", _indexed(lambda s: s.sql("SELECT c_nationkey, c_acctbal, c_custkey FROM vc_index_c__by_nation ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey DESC LIMIT 9")), "SELECT c_nationkey, c_acctbal, c_custkey FROM customer ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey DESC LIMIT 9")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir, ["nation"])
    out = f"{shared_folder(spark).rstrip('/')}/palimpsest-repos/out-{uuid.uuid4().hex}"
    s.run_script(_NATION + f"""UPDATE n SET region = NULL WHERE id = 3; SELECT id, name, region INTO OUTFILE '{out}' FIELDS TERMINATED BY ',' ENCLOSED BY '"' FROM n WHERE id < 9;
        CREATE TABLE m (id INT PRIMARY KEY, name VARCHAR(25), region INT); LOAD DATA INFILE '{out}' INTO TABLE m FIELDS TERMINATED BY ',' ENCLOSED BY '"' (id, name, region)""")
    return s.sql("SELECT * FROM m")


register("sql_load_data", _files, "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS region FROM nation WHERE n_nationkey < 9")


def _conflicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions on one database: changes of different rows meet, changes of the same cell don't."""
    a = fresh(spark, sf_dir, ["nation"])
    a.run_script(_NATION)
    rows = []
    for own, other in (("UPDATE n SET hits = 1 WHERE id = 1", "UPDATE n SET hits = 2 WHERE id = 2"), ("UPDATE n SET hits = 3 WHERE id = 3", "UPDATE n SET hits = 4 WHERE id = 3")):
        r = a.repo
        b = Session(Repo(spark, r.root, now=r.now, rows_per_bucket=ROWS_PER_BUCKET))
        b.sql("START TRANSACTION")
        b.sql(other)
        a.sql(own)
        try:
            b.sql("COMMIT")
            rows.append(True)
        except Exception:
            rows.append(False)
        a = Session(Repo(spark, r.root, now=r.now, rows_per_bucket=ROWS_PER_BUCKET))
    return a.sql(f"SELECT id, hits, {str(rows[0]).lower()} AS first, {str(rows[1]).lower()} AS second FROM n WHERE id < 5")


register("sql_two_sessions", _conflicting, "SELECT * FROM (VALUES (0, 0, true, false), (1, 1, true, false), (2, 2, true, false), (3, 3, true, false), (4, 0, true, false)) t(id, hits, first, second)")


def _clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fresh(spark, sf_dir, ["nation"])
    s.run_script(_NATION + "CALL vc_commit('-Am', 'base'); CALL vc_branch('side')")
    made = Session(s.repo.clone(f"{s.repo.root}-copy"))
    made.sql("DELETE FROM n WHERE id > 3")
    return made.sql("SELECT r.name, r.latest_commit_message AS message, COUNT(*) AS n FROM vc_remote_branches r, n GROUP BY ALL")


register("repo_clone", _clone, "SELECT * FROM (VALUES ('remotes/origin/main', 'base', CAST(4 AS BIGINT)), ('remotes/origin/side', 'base', 4)) t(name, message, n)")
