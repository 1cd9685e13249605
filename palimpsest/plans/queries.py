"""The registered queries of the engine and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fulltext, jsonx, mysql, spatial, vectors
from palimpsest.operators import constraints, diff, history, merge, patch, stats
from palimpsest.plans import fixtures as fx
from palimpsest.plans import versioned
from palimpsest.plans.graph import Commit, Graph
from palimpsest.plans.relational import PAIRS, SAME
from palimpsest.plans.store import matches

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]


def views(spark: SparkSession, sf_dir: str, names: Sequence[str] = TABLES) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, [t for t in TABLES if t in text])
        return spark.sql(text)

    return run


def over(*texts: str):
    """A query of the DataFrames of some SQL texts: f(frames...) -> DataFrame."""

    def make(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, [t for t in TABLES if any(t in x for x in texts)])
            return f(*[spark.sql(x) for x in texts])

        return run

    return make


QUERIES: dict[str, Query] = {n: sql(t) for n, t in SAME.items()} | {n: sql(t) for n, (t, _) in PAIRS.items()}
ORACLE_SQL: dict[str, str] = dict(SAME) | {n: t for n, (_, t) in PAIRS.items()}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE_SQL[name] = oracle


# --- differences of two versions

_CHANGED = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in fx.VALUES)
_BOTH = f"WITH a AS ({fx.V1}), b AS ({fx.V2}), j AS (SELECT {', '.join(f'b.{c} AS to_{c}' for c in [*fx.KEYS, *fx.VALUES])}, {', '.join(f'a.{c} AS from_{c}' for c in [*fx.KEYS, *fx.VALUES])}, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS diff_type FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR {_CHANGED})"
register("diff_rows", over(fx.V1, fx.V2)(lambda a, b: diff.row_diff(a, b, fx.KEYS)), f"{_BOTH} SELECT * FROM j")
register("diff_added", over(fx.V1, fx.V2)(lambda a, b: diff.row_diff(a, b, fx.KEYS).filter("diff_type = 'added'")), f"{_BOTH} SELECT * FROM j WHERE diff_type = 'added'")
register("diff_removed", over(fx.V1, fx.V2)(lambda a, b: diff.row_diff(a, b, fx.KEYS).filter("diff_type = 'removed'")), f"{_BOTH} SELECT * FROM j WHERE diff_type = 'removed'")
register("diff_where", over(fx.V1, fx.V2)(lambda a, b: diff.row_diff(a, b, fx.KEYS).filter("to_o_totalprice > 200000")), f"{_BOTH} SELECT * FROM j WHERE to_o_totalprice > 200000")
register("diff_reversed", over(fx.V2, fx.V1)(lambda a, b: diff.row_diff(a, b, fx.KEYS).groupBy("diff_type").agg(F.count(F.lit(1)).alias("n"))),
         f"{_BOTH} SELECT CASE diff_type WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE diff_type END AS diff_type, COUNT(*) AS n FROM j GROUP BY 1")
_MODIFIED_1 = f"SELECT {fx.COLUMNS} FROM orders"
_MODIFIED_2 = fx.orders_with("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END")
register("diff_skinny", over(_MODIFIED_1, _MODIFIED_2)(lambda a, b: diff.row_diff(a, b, fx.KEYS, skinny=True, include=["o_custkey"])),
         f"SELECT b.o_orderkey AS to_o_orderkey, b.o_custkey AS to_o_custkey, b.o_orderstatus AS to_o_orderstatus, a.o_orderkey AS from_o_orderkey, a.o_custkey AS from_o_custkey, a.o_orderstatus AS from_o_orderstatus, 'modified' AS diff_type FROM ({_MODIFIED_1}) a JOIN ({_MODIFIED_2}) b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus")
_STAT = f"""WITH a AS ({fx.V1}), b AS ({fx.V2}), j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, {' + '.join(f'CAST(a.{c} IS DISTINCT FROM b.{c} AS BIGINT)' for c in fx.VALUES)} AS cells FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey),
s AS (SELECT COUNT(ak) AS old_row_count, COUNT(bk) AS new_row_count, COUNT(*) FILTER (WHERE ak IS NULL) AS rows_added, COUNT(*) FILTER (WHERE bk IS NULL) AS rows_deleted, COUNT(*) FILTER (WHERE ak = bk AND cells > 0) AS rows_modified, CAST(SUM(CASE WHEN ak = bk THEN cells ELSE 0 END) AS BIGINT) AS cells_modified FROM j)
SELECT 'orders' AS table_name, old_row_count - rows_deleted - rows_modified AS rows_unmodified, rows_added, rows_deleted, rows_modified, rows_added * 6 AS cells_added, rows_deleted * 6 AS cells_deleted, cells_modified, old_row_count, new_row_count, old_row_count * 6 AS old_cell_count, new_row_count * 6 AS new_cell_count FROM s"""
register("diff_stat", over(fx.V1, fx.V2)(lambda a, b: diff.diff_stat(a, b, fx.KEYS, "orders")), _STAT)
_BAG = f"WITH d AS (SELECT l_suppkey, qty, SUM(n) AS n FROM (SELECT *, -1 AS n FROM ({fx.BAG_FROM}) x UNION ALL SELECT *, 1 AS n FROM ({fx.BAG_TO}) y) z GROUP BY l_suppkey, qty HAVING SUM(n) <> 0)"
register("diff_keyless", over(fx.BAG_FROM, fx.BAG_TO)(diff.bag_diff), f"{_BAG} SELECT CASE WHEN n > 0 THEN l_suppkey END AS to_l_suppkey, CASE WHEN n > 0 THEN qty END AS to_qty, CASE WHEN n < 0 THEN l_suppkey END AS from_l_suppkey, CASE WHEN n < 0 THEN qty END AS from_qty, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS diff_type FROM (SELECT *, unnest(range(CAST(abs(n) AS BIGINT))) AS copy FROM d)")
register("diff_stat_keyless", over(fx.BAG_FROM, fx.BAG_TO)(diff.bag_stat), f"{_BAG} SELECT CAST(SUM(greatest(n, 0)) AS BIGINT) AS rows_added, CAST(SUM(greatest(-n, 0)) AS BIGINT) AS rows_deleted FROM d")
register("column_diff", over(fx.V1, fx.V2)(lambda a, b: diff.column_diff(a, b, fx.KEYS)),
         f"WITH a AS ({fx.V1}), b AS ({fx.V2}), j AS (SELECT {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in [*fx.KEYS, *fx.VALUES])} FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, 'modified' AS diff_type WHERE EXISTS (SELECT 1 FROM j WHERE a_{c} IS DISTINCT FROM b_{c})" for c in [*fx.KEYS, *fx.VALUES]))
_Q1 = "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey"
_Q2 = "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY o_custkey"
register("query_diff_pk", over(_Q1, _Q2)(lambda a, b: diff.query_diff(a, b, ["o_custkey"])),
         f"SELECT a.o_custkey AS from_o_custkey, a.n AS from_n, b.o_custkey AS to_o_custkey, b.n AS to_n, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'deleted' ELSE 'modified' END AS diff_type FROM ({_Q1}) a FULL OUTER JOIN ({_Q2}) b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n")
_P1, _P2 = "SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 4 <> 0 ORDER BY n_nationkey"
register("query_diff_positional", over(_P1, _P2)(diff.query_diff),
         f"WITH a AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation), b AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_nationkey % 4 <> 0) SELECT a.n_name AS from_n_name, a.n_regionkey AS from_n_regionkey, b.n_name AS to_n_name, b.n_regionkey AS to_n_regionkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS diff_type FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.n_name IS DISTINCT FROM b.n_name OR a.n_regionkey IS DISTINCT FROM b.n_regionkey")
register("query_diff_schemas", over("SELECT r_regionkey FROM region", "SELECT r_name FROM region")(diff.query_diff),
         "SELECT r_regionkey AS from_r_regionkey, CAST(NULL AS VARCHAR) AS to_r_name, 'deleted' AS diff_type FROM region UNION ALL SELECT NULL, r_name, 'added' FROM region")
register("table_hash_equal", over(fx.V1, fx.V1, fx.V2)(lambda a, b, c: history.table_hash(a).withColumnRenamed("digest", "x").crossJoin(F.broadcast(history.table_hash(b.orderBy("o_custkey")).select(F.col("digest").alias("y")))).crossJoin(F.broadcast(history.table_hash(c).select(F.col("digest").alias("z")))).select(F.expr("x = y").alias("same"), F.expr("x = z").alias("other"))), "SELECT TRUE AS same, FALSE AS other")
register("upsert", over(fx.V1, fx.V2)(lambda a, b: diff.upsert(a, b, fx.KEYS)), f"SELECT * FROM ({fx.V1}) a ANTI JOIN ({fx.V2}) b USING (o_orderkey) UNION ALL {fx.V2}")
register("insert_ignore", over(fx.V1, fx.V2)(lambda a, b: a.union(b.join(a, fx.KEYS, "left_anti").select(*a.columns))), f"{fx.V1} UNION ALL SELECT * FROM ({fx.V2}) b ANTI JOIN ({fx.V1}) a USING (o_orderkey)")

# --- chains: history, blame, log


def chain(frames: Sequence[DataFrame]) -> list[history.Version]:
    return [(c, "root", d, f) for c, d, f in zip(fx.COMMITS, fx.DATES, frames, strict=True)]


_HISTORY = " UNION ALL ".join(f"SELECT *, '{c}' AS commit_hash, 'root' AS committer, TIMESTAMP '{d}' AS commit_date FROM ({t})" for c, d, t in zip(fx.COMMITS, fx.DATES, fx.CHAIN, strict=True))
register("history", over(*fx.CHAIN)(lambda *f: history.history(chain(f)[::-1])), _HISTORY)
register("history_filtered", over(*fx.CHAIN)(lambda *f: history.history(chain(f), commits=["c2"]).filter("o_orderstatus = 'S1'")), f"SELECT * FROM ({_HISTORY}) WHERE commit_hash = 'c2' AND o_orderstatus = 'S1'")
_WALK = f"""WITH h AS (SELECT *, CAST(substr(commit_hash, 2) AS INT) AS place FROM ({_HISTORY})),
w AS (SELECT *, lag(place) OVER k AS p, lead(place) OVER k AS nx, lag(o_orderstatus) OVER k AS s FROM h WINDOW k AS (PARTITION BY o_orderkey ORDER BY place)),
e AS (SELECT o_orderkey, place, CASE WHEN p IS DISTINCT FROM place - 1 THEN 'added' WHEN s <> o_orderstatus THEN 'modified' END AS diff_type FROM w
  UNION ALL SELECT o_orderkey, place + 1, 'removed' FROM w WHERE place < 5 AND nx IS DISTINCT FROM place + 1)"""
register("chain_changes", over(*fx.CHAIN)(lambda *f: history.chain_changes(chain(f), fx.KEYS)), f"{_WALK} SELECT * FROM e WHERE diff_type IS NOT NULL")
register("blame", over(*fx.CHAIN)(lambda *f: history.blame(chain(f), fx.KEYS)), f"{_WALK} SELECT o_orderkey, 'c' || max(place) AS commit, TIMESTAMP '2024-01-01' + max(place) * INTERVAL 1 DAY AS commit_date, 'root' AS committer FROM e JOIN (SELECT o_orderkey FROM h WHERE place = 5) USING (o_orderkey) WHERE diff_type IS NOT NULL GROUP BY o_orderkey")


def _pair_diff(i: int, parent: int | None) -> str:
    before = fx.CHAIN[parent] if parent is not None else f"SELECT * FROM ({fx.CHAIN[i]}) WHERE FALSE"
    names = [*fx.KEYS, *fx.VALUES]
    return f"SELECT {', '.join(f'b.{c} AS to_{c}' for c in names)}, {', '.join(f'a.{c} AS from_{c}' for c in names)}, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS diff_type, 'c{i}' AS to_commit, TIMESTAMP '{fx.DATES[i]}' AS to_commit_date, {f''''c{parent}' ''' if parent is not None else 'CAST(NULL AS VARCHAR)'} AS from_commit, {f'''TIMESTAMP '{fx.DATES[parent]}' ''' if parent is not None else 'CAST(NULL AS TIMESTAMP)'} AS from_commit_date FROM ({before}) a FULL OUTER JOIN ({fx.CHAIN[i]}) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR {_CHANGED}"


def _pairs(frames: Sequence[DataFrame]) -> list:
    line = chain(frames)
    return [(v, line[i - 1] if i else None) for i, v in enumerate(line)]


_DIFFS = " UNION ALL ".join(_pair_diff(i, i - 1 if i else None) for i in fx.PLACES)
register("diff_table", over(*fx.CHAIN)(lambda *f: history.diff_history(_pairs(f), fx.KEYS)), _DIFFS)
register("commit_diff", over(*fx.CHAIN)(lambda *f: history.diff_history([(chain(f)[4], chain(f)[1])], fx.KEYS)), _pair_diff(4, 1))
register("as_of_version", over(*fx.CHAIN)(lambda *f: history.history(chain(f), commits=["c3"]).select(*fx.KEYS, *fx.VALUES)), fx.CHAIN[3])


def _as_of_timestamp(*frames: DataFrame) -> DataFrame:
    from datetime import datetime

    graph = Graph(Commit(c, (fx.COMMITS[i - 1],) if i else (), datetime.fromisoformat(fx.DATES[i])) for i, c in enumerate(fx.COMMITS))
    return history.history(chain(frames), commits=[graph.as_of("c5", datetime(2024, 1, 3, 12))]).select(*fx.KEYS, *fx.VALUES)


register("as_of_timestamp", over(*fx.CHAIN)(_as_of_timestamp), fx.CHAIN[2])

#: A small graph: r - a - b - m - e, and a - x - y - m, with a side line a - s.
_EDGES = [("r", ()), ("a", ("r",)), ("b", ("a",)), ("x", ("a",)), ("y", ("x",)), ("m", ("b", "y")), ("e", ("m",)), ("s", ("a",))]


def toy_graph() -> Graph:
    from datetime import datetime

    return Graph(Commit(h, p, datetime(2024, 1, 1 + i), "root", "root@localhost", f"commit {h}", tables={"t": "1" if h in "rab" else h}) for i, (h, p) in enumerate(_EDGES))


def _log(**options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(c.hash, c.message, c.height) for c in toy_graph().log(**options)], "commit_hash string, message string, commit_order long")

    return run


_EDGE_SQL = "WITH RECURSIVE edges(c, p) AS (VALUES " + ", ".join(f"('{h}', {f"'{x}'" if x else 'NULL'})" for h, p in _EDGES for x in (p or (None,))) + ")"
_REACH = f"{_EDGE_SQL}, reach(h, c) AS (SELECT DISTINCT c, c FROM edges UNION SELECT reach.h, edges.p FROM reach JOIN edges ON reach.c = edges.c WHERE edges.p IS NOT NULL), heights AS (SELECT h, 0 AS z FROM reach WHERE FALSE), high(c, n) AS (SELECT c, 1 FROM edges WHERE p IS NULL UNION SELECT edges.c, high.n + 1 FROM edges JOIN high ON edges.p = high.c), tall AS (SELECT c, CAST(max(n) AS BIGINT) AS commit_order FROM high GROUP BY c)"
_SHOW = "SELECT c AS commit_hash, 'commit ' || c AS message, commit_order FROM tall WHERE c IN"
register("log", _log(heads=["e"]), f"{_REACH} {_SHOW} (SELECT c FROM reach WHERE h = 'e')")
register("log_dotdot", _log(heads=["e"], without=["b"]), f"{_REACH} {_SHOW} (SELECT c FROM reach WHERE h = 'e') AND c NOT IN (SELECT c FROM reach WHERE h = 'b')")
register("log_threedot", _log(heads=["b", "y"], without=["a"]), f"{_REACH} {_SHOW} (SELECT c FROM reach WHERE h IN ('b', 'y')) AND c NOT IN (SELECT c FROM reach WHERE h = 'a')")
register("log_merges", _log(heads=["e"], min_parents=2), f"{_REACH} {_SHOW} (SELECT c FROM edges GROUP BY c HAVING COUNT(p) > 1)")
register("log_tables", _log(heads=["e"], tables=["t"]), f"{_REACH} {_SHOW} ('x', 'y', 'm', 'e')")
register("commit_ancestors", lambda spark, sf: spark.createDataFrame([(c.hash, p, i) for c in toy_graph().commits.values() for i, p in enumerate(c.parents or (None,))], "commit_hash string, parent_hash string, parent_index int"),
         f"{_EDGE_SQL} SELECT c AS commit_hash, p AS parent_hash, CAST(row_number() OVER (PARTITION BY c ORDER BY p = 'y') - 1 AS INT) AS parent_index FROM edges")
register("merge_base", lambda spark, sf: spark.createDataFrame([(a, b, toy_graph().merge_base(a, b)) for a, b in (("b", "y"), ("e", "s"), ("m", "b"))], "a string, b string, base string"),
         f"{_REACH}, pairs(a, b) AS (VALUES ('b', 'y'), ('e', 's'), ('m', 'b')) SELECT a, b, arg_max(x.c, commit_order) AS base FROM pairs JOIN reach x ON x.h = a JOIN reach y ON y.h = b AND x.c = y.c JOIN tall ON tall.c = x.c GROUP BY a, b")
register("branch_status", lambda spark, sf: spark.createDataFrame([(b, *toy_graph().ahead_behind("b", b)) for b in ("y", "e", "s")], "branch string, commits_ahead long, commits_behind long"),
         f"{_REACH} SELECT h AS branch, COUNT(*) FILTER (WHERE c NOT IN (SELECT c FROM reach WHERE h = 'b')) AS commits_ahead, (SELECT COUNT(*) FROM reach z WHERE z.h = 'b' AND z.c NOT IN (SELECT c FROM reach y WHERE y.h = r.h)) AS commits_behind FROM reach r WHERE h IN ('y', 'e', 's') GROUP BY h")
register("has_ancestor", lambda spark, sf: spark.createDataFrame([(h, a, toy_graph().has_ancestor(h, a)) for h, a in (("e", "x"), ("b", "x"), ("s", "r"))], "head string, ancestor string, has boolean"),
         f"{_REACH}, q(head, ancestor) AS (VALUES ('e', 'x'), ('b', 'x'), ('s', 'r')) SELECT head, ancestor, EXISTS (SELECT 1 FROM reach WHERE h = head AND c = ancestor) AS has FROM q")

# --- three-way merge

_THREE = f"WITH b AS ({fx.BASE}), o AS ({fx.OURS}), t AS ({fx.THEIRS}), k AS (SELECT o_orderkey FROM b UNION SELECT o_orderkey FROM o UNION SELECT o_orderkey FROM t), j0 AS (SELECT k.o_orderkey, b.o_orderkey IS NOT NULL AS in_b, o.o_orderkey IS NOT NULL AS in_o, t.o_orderkey IS NOT NULL AS in_t, {', '.join(f'b.{c} AS base_{c}, o.{c} AS our_{c}, t.{c} AS their_{c}' for c in fx.VALUES)} FROM k LEFT JOIN b USING (o_orderkey) LEFT JOIN o USING (o_orderkey) LEFT JOIN t USING (o_orderkey)), "
_EQ = {n: " AND ".join(f"{a}_{c} IS NOT DISTINCT FROM {b}_{c}" for c in fx.VALUES) for n, a, b in (("ob", "our", "base"), ("tb", "their", "base"), ("ot", "our", "their"))}
_CLASH = " OR ".join(f"(our_{c} IS DISTINCT FROM their_{c} AND our_{c} IS DISTINCT FROM base_{c} AND their_{c} IS DISTINCT FROM base_{c})" for c in fx.VALUES)
_THREE += f"""j AS (SELECT *, CASE WHEN NOT in_b AND NOT in_t THEN 'leftAdd' WHEN NOT in_b AND NOT in_o THEN 'rightAdd' WHEN NOT in_b AND ({_EQ['ot']}) THEN 'convergentAdd' WHEN NOT in_b THEN 'divergentModifyConflict'
 WHEN NOT in_o AND NOT in_t THEN 'convergentDelete' WHEN NOT in_o THEN CASE WHEN {_EQ['tb']} THEN 'leftDelete' ELSE 'divergentDeleteConflict' END WHEN NOT in_t THEN CASE WHEN {_EQ['ob']} THEN 'rightDelete' ELSE 'divergentDeleteConflict' END
 WHEN ({_EQ['ob']}) AND ({_EQ['tb']}) THEN 'unchanged' WHEN {_EQ['tb']} THEN 'leftModify' WHEN {_EQ['ob']} THEN 'rightModify' WHEN {_EQ['ot']} THEN 'convergentModify' WHEN {_CLASH} THEN 'divergentModifyConflict' ELSE 'divergentModifyResolved' END AS op FROM j0)"""
_CONFLICT = "op IN ('divergentModifyConflict', 'divergentDeleteConflict')"


def _merged_sql(side: str, flag: str) -> str:
    cells = ", ".join(f"CASE WHEN {_CONFLICT} THEN {side}_{c} WHEN NOT in_o THEN their_{c} WHEN NOT in_t THEN our_{c} WHEN our_{c} IS DISTINCT FROM base_{c} THEN our_{c} ELSE their_{c} END AS {c}" for c in fx.VALUES)
    return f"{_THREE} SELECT o_orderkey, {cells} FROM j WHERE CASE WHEN {_CONFLICT} THEN {flag} ELSE op NOT IN ('convergentDelete', 'leftDelete', 'rightDelete') END"


def _type_sql(side: str, flag: str, eq: str) -> str:
    return f"CASE WHEN NOT in_b THEN 'added' WHEN NOT {flag} THEN 'removed' WHEN {eq} THEN 'unmodified' ELSE 'modified' END AS {side}_diff_type"


_CONFLICT_SQL = f"{_THREE} SELECT " + ", ".join(f"CASE WHEN in_{s[0]} THEN o_orderkey END AS {s}_o_orderkey, {', '.join(f'{s}_{c}' for c in fx.VALUES)}" for s in ("base", "our", "their")) + f", {_type_sql('our', 'in_o', _EQ['ob'])}, {_type_sql('their', 'in_t', _EQ['tb'])} FROM j WHERE {_CONFLICT}"
_merging = over(fx.BASE, fx.OURS, fx.THEIRS)
register("merge_classify", _merging(lambda b, o, t: merge.merge_counts(b, o, t, fx.KEYS)), f"{_THREE} SELECT op, COUNT(*) AS n FROM j GROUP BY op")
register("merge_rows", _merging(lambda b, o, t: merge.merged_rows(b, o, t, fx.KEYS)), _merged_sql("our", "in_o"))
register("resolve_theirs", _merging(lambda b, o, t: merge.merged_rows(b, o, t, fx.KEYS, "theirs")), _merged_sql("their", "in_t"))
register("merge_conflicts", _merging(lambda b, o, t: merge.conflicts(b, o, t, fx.KEYS)), _CONFLICT_SQL)
register("merge_preview", _merging(lambda b, o, t: merge.conflicts(b, o, t, fx.KEYS).agg(F.count(F.lit(1)).alias("num_data_conflicts")).select(F.lit("orders").alias("table"), "num_data_conflicts", F.lit(0).cast("long").alias("num_schema_conflicts"))), f"{_THREE} SELECT 'orders' AS \"table\", COUNT(*) AS num_data_conflicts, CAST(0 AS BIGINT) AS num_schema_conflicts FROM j WHERE {_CONFLICT}")
_ONTO = fx.orders_with(priority="CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderpriority END")
_PARENT, _PICKED = f"SELECT {fx.COLUMNS} FROM orders", fx.orders_with("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END") + " WHERE o_orderkey % 8 <> 0 OR o_orderkey % 3 = 0"
_PICK_SQL = fx.orders_with("CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END", "CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderpriority END") + " WHERE o_orderkey % 8 <> 0 OR o_orderkey % 3 = 0"
register("cherry_pick", over(_ONTO, _PICKED, _PARENT)(lambda a, c, p: merge.cherry_pick(a, c, p, fx.KEYS)), _PICK_SQL)
register("revert", over(_PICK_SQL, _PICKED, _PARENT)(lambda a, c, p: merge.revert(a, c, p, fx.KEYS)), fx.orders_with(priority="CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderpriority END"))
_BAG_THEIRS = "SELECT l_suppkey, CAST(l_quantity AS INT) AS qty FROM lineitem WHERE l_orderkey % 13 <> 0"
_BAG_BASE = "SELECT l_suppkey, CAST(l_quantity AS INT) AS qty FROM lineitem"
register("merge_keyless", over(_BAG_BASE, fx.BAG_TO, _BAG_THEIRS)(merge.bag_merge),
         f"SELECT *, our_n <> base_n AND their_n <> base_n AS conflict, CASE WHEN our_n <> base_n THEN our_n ELSE their_n END AS merged_n FROM (SELECT l_suppkey, qty, COUNT(*) AS base_n, COUNT(*) FILTER (WHERE k % 11 <> 0) AS our_n, COUNT(*) FILTER (WHERE k % 13 <> 0) AS their_n FROM (SELECT l_suppkey, CAST(l_quantity AS INT) AS qty, l_orderkey AS k FROM lineitem) GROUP BY 1, 2)")

# --- constraints

_PARENTS = "SELECT o_orderkey FROM orders WHERE o_orderkey % 13 <> 0"
register("viol_fk", over("SELECT * FROM lineitem", _PARENTS)(lambda c, p: constraints.foreign_key(c, ["l_orderkey"], p, ["o_orderkey"])), f"SELECT * FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN ({_PARENTS})")
register("viol_fk_nullable", over("SELECT c_custkey, NULLIF(c_nationkey, 4) AS k FROM customer", "SELECT n_nationkey FROM nation WHERE n_nationkey > 6")(lambda c, p: constraints.foreign_key(c, ["k"], p, ["n_nationkey"])), "SELECT c_custkey, c_nationkey AS k FROM customer WHERE c_nationkey <= 6 AND c_nationkey <> 4")
register("viol_unique", over("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem")(lambda d: constraints.unique(d, ["l_orderkey", "l_linenumber"])), "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
register("viol_check", over("SELECT c_custkey, c_acctbal, NULLIF(c_nationkey, 3) AS k FROM customer")(lambda d: constraints.check(d, "c_acctbal >= 0 AND k < 20")), "SELECT c_custkey, c_acctbal, NULLIF(c_nationkey, 3) AS k FROM customer WHERE NOT (c_acctbal >= 0 AND NULLIF(c_nationkey, 3) < 20)")
register("viol_notnull", over("SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer")(lambda d: constraints.not_null(d, ["k"])), "SELECT c_custkey, CAST(NULL AS INT) AS k FROM customer WHERE c_nationkey = 3")
_RULES = [
    {"table": "orders", "kind": "foreign key", "columns": ["o_custkey"], "parent": "customer", "parent_columns": ["c_custkey"]}, {"table": "lineitem", "kind": "unique index", "columns": ["l_orderkey", "l_linenumber"]},
    {"table": "customer", "kind": "check constraint", "condition": "c_acctbal >= 0"}, {"table": "customer", "kind": "not null", "columns": ["c_name"]},
]
register("verify_constraints", over("SELECT * FROM orders", "SELECT * FROM customer", "SELECT * FROM lineitem")(lambda o, c, li: constraints.violations({"orders": o, "customer": c, "lineitem": li}, _RULES)),
         "SELECT * FROM (SELECT 'orders' AS \"table\", 'foreign key' AS violation_type, COUNT(*) AS n, 'o_custkey -> customer(c_custkey)' AS violation_info FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem', 'unique index', COUNT(*), 'l_orderkey,l_linenumber' FROM (SELECT COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 1 UNION ALL SELECT 'customer', 'check constraint', COUNT(*), 'c_acctbal >= 0' FROM customer WHERE c_acctbal < 0) WHERE n > 0")

# --- patches, statistics, change feeds

register("patch_statements", over(fx.V1, fx.V2)(lambda a, b: patch.data_statements("orders", a.select("o_orderkey", "o_orderstatus"), b.select("o_orderkey", "o_orderstatus"), fx.KEYS)),
         f"SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS diff_type, CASE WHEN a.o_orderkey IS NULL THEN 'INSERT INTO `orders` (`o_orderkey`,`o_orderstatus`) VALUES (' || b.o_orderkey || ',''' || b.o_orderstatus || ''');' WHEN b.o_orderkey IS NULL THEN 'DELETE FROM `orders` WHERE `o_orderkey`=' || a.o_orderkey || ';' ELSE 'UPDATE `orders` SET `o_orderstatus`=''' || b.o_orderstatus || ''' WHERE `o_orderkey`=' || b.o_orderkey || ';' END AS statement FROM ({fx.V1}) a FULL OUTER JOIN ({fx.V2}) b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
register("dump_inserts", over("SELECT n_nationkey, n_name FROM nation")(lambda d: patch.dump("nation", d)), "SELECT 'INSERT INTO `nation` (`n_nationkey`,`n_name`) VALUES (' || n_nationkey || ',''' || n_name || ''');' AS statement FROM nation")
_FEED = "SELECT event_id, user_id AS k, event_type AS v, event_id % 5 = 0 AS gone FROM events"
register("cdc_apply", over(_FEED)(lambda e: diff.latest_by_key(e, ["k"], ["event_id"]).filter("NOT gone").select("k", "v")), f"SELECT k, arg_max(v, event_id) AS v FROM ({_FEED}) GROUP BY k HAVING NOT arg_max(gone, event_id)")
register("stats_histogram", over("SELECT o_custkey FROM orders")(lambda d: stats.histogram(d, "o_custkey", 20)),
         "WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS i, COUNT(*) OVER () AS total FROM orders), b AS (SELECT o_custkey, CAST(floor((min(i) OVER (PARTITION BY o_custkey) - 1) * 20 / total) AS INT) AS bucket FROM r) SELECT bucket, COUNT(*) AS row_count, COUNT(DISTINCT o_custkey) AS distinct_count, MIN(o_custkey) AS lower_bound, MAX(o_custkey) AS upper_bound FROM b GROUP BY bucket")
register("stats_mcv", over("SELECT l_suppkey FROM lineitem")(lambda d: stats.most_common(d, "l_suppkey", 3)), "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 3")
register("stats_table", over("SELECT * FROM customer")(stats.column_stats),
         " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, CAST(MIN({c}) AS VARCHAR) AS lower_bound, CAST(MAX({c}) AS VARCHAR) AS upper_bound FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).join(["SELECT * FROM (", ") x"]))
register("auto_increment", over("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS id, c_name FROM customer")(lambda d: constraints.auto_increment(d, "id", 100000, ["c_name"])), "SELECT CASE WHEN c_custkey % 2 = 1 THEN 99999 + row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_name) ELSE c_custkey END AS id, c_name FROM customer")

# --- functions that Spark lacks

register("mysql_functions", over("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")(lambda d: d.select("c_custkey", mysql.field(F.col("c_mktsegment"), "AUTOMOBILE", "BUILDING").alias("f"), mysql.substring_index(F.col("c_name"), "#", 1).alias("s"), mysql.find_in_set("BUILDING", F.lit("A,BUILDING,C")).alias("i"), mysql.elt(2, "a", "b").alias("e"), mysql.format_number(F.col("c_acctbal"), 2).alias("n"))),
         "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 0 END AS f, split_part(c_name, '#', 1) AS s, 2 AS i, 'b' AS e, format('{:,.2f}', c_acctbal) AS n FROM customer")
register("mysql_date_format", over("SELECT o_orderkey, o_orderdate FROM orders")(lambda d: d.select("o_orderkey", mysql.date_format(F.col("o_orderdate"), "%Y-%m-%d %H:%i:%s").alias("a"), mysql.date_format(F.col("o_orderdate"), "%d/%c/%y").alias("b"), mysql.timestampdiff("DAY", F.lit("1992-01-01").cast("timestamp"), F.col("o_orderdate")).alias("days"))),
         "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%d/%-m/%y') AS b, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
register("vector_topk", over("SELECT vec_id, embedding FROM embeddings")(lambda d: vectors.nearest(d, "embedding", d.filter("vec_id = 7"), "embedding", 10, ["vec_id"])),
         "SELECT e.vec_id, ROUND(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, e.vec_id LIMIT 10")
register("vector_topk_each", over("SELECT vec_id, embedding FROM embeddings")(lambda d: vectors.nearest_each(d, "embedding", d.filter("vec_id % 50 = 0"), "embedding", 10, "vec_id", "vec_id")),
         "SELECT query_vec_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_vec_id ORDER BY distance, vec_id) AS r FROM (SELECT q.vec_id AS query_vec_id, e.vec_id, ROUND(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))), 6) AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE r <= 10")
register("vector_cosine", over("SELECT vec_id, embedding FROM embeddings")(lambda d: d.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.transform("embedding", lambda x: x * 2 + 1)), 5).alias("d"))),
         "SELECT vec_id, ROUND(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 5) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(embedding, lambda x: CAST(x * 2 + 1 AS DOUBLE)) AS b FROM embeddings)")
register("fulltext_match", over("SELECT item_id, text FROM benchmark")(lambda d: fulltext.match_any(d, ["text"], "the was") .select("item_id")), "SELECT item_id FROM benchmark WHERE len(list_intersect(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda w: w <> ''), ['the', 'was'])) > 0")
register("fulltext_index", over("SELECT doc_id, text FROM documents")(lambda d: fulltext.inverted_index(d, "doc_id", ["text"]).groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))),
         "SELECT word, COUNT(DISTINCT doc_id) AS docs, COUNT(*) AS n FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_'']+'), lambda w: w <> '')) AS word FROM documents) GROUP BY word")
_POINTS = "SELECT c_custkey, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer"
register("spatial_box", over(_POINTS)(lambda d: d.filter(spatial.within_box(spatial.point("x", "y"), -5, 2, 40.5, 9)).select("c_custkey", spatial.as_wkt(spatial.point(F.floor("x"), "y")).alias("wkt"))), f"SELECT c_custkey, 'POINT(' || CAST(floor(x) AS BIGINT) || ' ' || CAST(y AS BIGINT) || ')' AS wkt FROM ({_POINTS}) WHERE x BETWEEN -5 AND 40.5 AND y BETWEEN 2 AND 9")
register("spatial_distance", over(_POINTS)(lambda d: d.select("c_custkey", F.round(spatial.distance(spatial.point("x", "y"), spatial.point(F.lit(1.0), F.lit(2.0))), 6).alias("d"))), f"SELECT c_custkey, ROUND(sqrt((x - 1) * (x - 1) + (y - 2) * (y - 2)), 6) AS d FROM ({_POINTS})")
_JSONS = "SELECT event_id, props, concat('{\"k\": ', CAST(event_id % 3 AS VARCHAR(9)), ', \"n\": [1, ', CAST(event_id % 2 AS VARCHAR(9)), ']}') AS other FROM events"
register("json_diff", over(_JSONS)(lambda d: jsonx.json_diff(d, "props", "other", ["event_id"])),
         f"SELECT event_id, 'modified' AS diff_type, '$.k' AS path, json_extract_string(props, '$.k') AS from_value, json_extract_string(other, '$.k') AS to_value FROM ({_JSONS}) WHERE json_extract_string(props, '$.k') <> json_extract_string(other, '$.k') UNION ALL SELECT event_id, 'added', '$.n', NULL, '[1,' || (event_id % 2) || ']' FROM ({_JSONS})")
register("json_set", over("SELECT event_id, props FROM events")(lambda d: d.select("event_id", jsonx.json_set("props", "$.new.deep", F.col("event_id")).alias("j"))), "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"new\":{\"deep\":' || event_id || '}}' AS j FROM events")
register("wildcard_tables", lambda spark, sf: spark.createDataFrame([(t,) for t in TABLES if matches("%on%", t)], "name string"), "SELECT * FROM (VALUES ('region'), ('nation'), ('conversations')) AS t(name)")
register("fast_count", over("SELECT * FROM lineitem")(lambda d: d.agg(F.count(F.lit(1)).alias("n"))), "SELECT COUNT(*) AS n FROM lineitem")


versioned.merge_queries(_merged_sql, _CONFLICT_SQL, _THREE, _CONFLICT)
QUERIES.update(versioned.QUERIES)
ORACLE_SQL.update(versioned.ORACLE_SQL)


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["diff_stat"](spark, "/root/testdata/sf0.001")
