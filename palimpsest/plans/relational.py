"""The relational surface as queries: (name: SQL for Spark, SQL for DuckDB), or one text where both read it alike."""

from __future__ import annotations

MONEY = "CAST(ROUND(CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE), 2) AS DOUBLE)"


def money(column: str) -> str:
    return MONEY.format(column)


SAME = {
    # scans, predicates
    "scan_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'",
    "point_lookup": "SELECT * FROM orders WHERE o_orderkey = 77",
    "range_scan": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999",
    "in_list": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 3, 5, 7)",
    "like_filter": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r_n%' AND p_brand NOT LIKE '%2%'",
    "case_when": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class FROM customer",
    "three_valued": "SELECT c_custkey, NULLIF(c_nationkey, 3) > 2 AS over, NULLIF(c_nationkey, 3) IS NULL AS gone, NOT (NULLIF(c_nationkey, 3) = 5) AS other FROM customer",
    "exists_correlated": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)",
    "not_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
    "generated_column": "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS INT) * 2 AS double_quantity FROM lineitem",
    # joins
    "join_inner": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 250000",
    "join_full": "SELECT a.c_custkey AS a_key, b.s_suppkey AS b_key FROM customer a FULL OUTER JOIN supplier b ON a.c_custkey = b.s_suppkey",
    "join_cross": "SELECT a.r_name AS a_name, b.n_name AS b_name FROM region a CROSS JOIN nation b",
    "join_theta": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_using": "SELECT n_nationkey, n_name, c_custkey FROM nation JOIN (SELECT c_nationkey AS n_nationkey, c_custkey FROM customer) x USING (n_nationkey)",
    "join_natural": "SELECT n_nationkey, n_name, c_custkey FROM nation NATURAL JOIN (SELECT c_nationkey AS n_nationkey, c_custkey FROM customer) x",
    "join_self_versions": "SELECT a.o_orderkey, a.o_orderstatus AS now, b.o_orderstatus AS before FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) b ON a.o_orderkey = b.o_orderkey",
    "join_range": "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 200",
    "join_nulls_excluded": "SELECT a.c_custkey FROM customer a LEFT JOIN (SELECT NULLIF(n_nationkey, 3) AS k FROM nation) b ON a.c_nationkey = b.k WHERE b.k IS NOT NULL",
    # aggregation
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "count_column": "SELECT COUNT(NULLIF(c_nationkey, 3)) AS n FROM customer",
    "agg_group": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {money('l_extendedprice')} AS price, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_avg": "SELECT o_orderpriority, ROUND(AVG(CAST(o_orderkey AS DOUBLE)), 4) AS mean_key FROM orders GROUP BY o_orderpriority",
    "agg_deviation": "SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 6) AS sd, ROUND(VAR_SAMP(l_quantity), 6) AS var FROM lineitem GROUP BY l_returnflag",
    "agg_bits": "SELECT o_orderstatus, BIT_AND(o_orderkey) AS b_and, BIT_OR(o_orderkey) AS b_or, BIT_XOR(o_orderkey) AS b_xor FROM orders GROUP BY o_orderstatus",
    "agg_rollup": f"SELECT l_returnflag, l_linestatus, {money('l_quantity')} AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "group_by_alias": "SELECT o_orderkey % 7 AS rest, COUNT(*) AS n FROM orders GROUP BY rest",
    # windows
    "win_row_number": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer",
    "win_percent_rank": "SELECT c_custkey, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 9) AS p, ROUND(CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 9) AS c FROM customer",
    "win_ntile": "SELECT c_custkey, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS quartile FROM customer",
    "win_nth_value": "SELECT c_custkey, NTH_VALUE(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM customer",
    "win_lead_lag": "SELECT o_orderkey, LAG(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, LEAD(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
    "win_first_last": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER w AS first, LAST_VALUE(o_orderkey) OVER w AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_rows_frame": "SELECT o_orderkey, SUM(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM (SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS DECIMAL(18,0)) AS o_custkey FROM orders) x",
    "win_range_frame": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 40 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "win_range_interval": "SELECT event_id, COUNT(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_named": "SELECT o_orderkey, COUNT(*) OVER w AS n, MAX(o_totalprice) OVER w AS high FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "win_total_share": "SELECT c_custkey, c_nationkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS peers, MIN(c_acctbal) OVER (PARTITION BY c_nationkey) AS low FROM customer",
    # order, limit
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40",
    "distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) x WHERE k <= 3",
    # sets, CTEs
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte": "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 10) SELECT c_name, n FROM top JOIN customer ON o_custkey = c_custkey",
    "recursive_cte": "WITH RECURSIVE steps(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM steps WHERE n < 20) SELECT n, f FROM steps",
    "derived_table": "SELECT seg, MAX(n) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) x GROUP BY seg",
    "values": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(i, s)",
    # functions
    "fn_strings": "SELECT c_custkey, UPPER(c_mktsegment) AS u, LOWER(c_name) AS l, LENGTH(c_name) AS n, SUBSTRING(c_name, 3, 4) AS s, REPLACE(c_name, '0', '-') AS r, CONCAT(c_mktsegment, '/', c_name) AS c, REVERSE(c_name) AS v, LPAD(CAST(c_custkey AS VARCHAR(20)), 12, '*') AS p, TRIM(CONCAT('  ', c_name, ' ')) AS t, LEFT(c_name, 3) AS lf, RIGHT(c_name, 3) AS rg, REPEAT('ab', 3) AS rp FROM customer",
    "fn_math": "SELECT o_orderkey, ABS(o_custkey - 500) AS a, FLOOR(o_totalprice) AS f, CEIL(o_totalprice) AS c, ROUND(SQRT(o_totalprice), 6) AS q, POWER(2, o_orderkey % 10) AS p, o_orderkey % 7 AS m, SIGN(o_custkey - 500) AS s, GREATEST(o_custkey, 300) AS g, LEAST(o_custkey, 300) AS l, ROUND(LN(o_totalprice), 6) AS ln FROM orders",
    "fn_null": "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS c, NULLIF(c_mktsegment, 'BUILDING') AS n FROM customer",
    "fn_cast": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS d, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST('12' AS INT) + o_custkey AS i FROM orders",
    "fn_hash": "SELECT c_custkey, MD5(c_name) AS m FROM customer",
}

PAIRS = {
    "nullsafe_equal": ("SELECT a.c_custkey, a.k <=> b.k AS same FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT c_custkey, NULLIF(c_nationkey, 5) AS k FROM customer) b ON a.c_custkey = b.c_custkey",
                       "SELECT a.c_custkey, a.k IS NOT DISTINCT FROM b.k AS same FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT c_custkey, NULLIF(c_nationkey, 5) AS k FROM customer) b ON a.c_custkey = b.c_custkey"),
    "regexp": ("SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '#') AS r FROM part WHERE p_name RLIKE '(ing|t)$'", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '#', 'g') AS r FROM part WHERE regexp_matches(p_name, '(ing|t)$')"),
    "join_semi": ("SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey"),
    "join_hints": ("SELECT /*+ MERGE(customer) */ o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_lateral": ("SELECT n_name, x.c_custkey FROM nation, LATERAL (SELECT MAX(c_custkey) AS c_custkey FROM customer WHERE c_nationkey = n_nationkey) x", "SELECT n_name, x.c_custkey FROM nation, LATERAL (SELECT MAX(c_custkey) AS c_custkey FROM customer WHERE c_nationkey = n_nationkey) x"),
    "agg_listagg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_any_value": ("SELECT c_nationkey, any_value(c_nationkey) AS k FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, any_value(c_nationkey) AS k FROM customer GROUP BY c_nationkey"),
    "fn_dates": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d, quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM-dd') AS f, CAST(date_format(o_orderdate + INTERVAL 40 DAYS, 'yyyy-MM-dd') AS STRING) AS later, CAST(datediff(CAST(o_orderdate AS DATE), DATE'1992-01-01') AS BIGINT) AS days FROM orders",
                 "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, strftime(o_orderdate, '%Y-%m-%d') AS f, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS later, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders"),
    "fn_time_buckets": ("SELECT date_trunc('HOUR', ts) AS hour, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2", "SELECT date_trunc('hour', ts) AS hour, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"),
    "fn_bits": ("SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 256 AS o, o_orderkey ^ 1023 AS x, shiftleft(o_orderkey, 3) AS l, shiftright(o_orderkey, 2) AS r, CAST(bit_count(o_orderkey) AS INT) AS b FROM orders", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 256 AS o, xor(o_orderkey, 1023) AS x, o_orderkey << 3 AS l, o_orderkey >> 2 AS r, CAST(bit_count(o_orderkey) AS INT) AS b FROM orders"),
    "fn_div_by_zero": ("SELECT o_orderkey, try_divide(o_orderkey, o_orderkey % 3) AS d, o_orderkey div 7 AS i FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey / (o_orderkey % 3) END AS d, o_orderkey // 7 AS i FROM orders"),
    "fn_encodings": ("SELECT c_custkey, hex(encode(c_name, 'UTF-8')) AS h, base64(encode(c_name, 'UTF-8')) AS b, sha2(c_name, 256) AS s, octet_length(c_name) AS n FROM customer", "SELECT c_custkey, hex(c_name) AS h, base64(encode(c_name)) AS b, sha256(c_name) AS s, CAST(strlen(c_name) AS INT) AS n FROM customer"),
    "json_extract": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "json_keys": ("SELECT event_id, CAST(size(json_object_keys(props)) AS INT) AS n FROM events", "SELECT event_id, CAST(len(json_keys(props)) AS INT) AS n FROM events"),
    "json_build": ("SELECT c_custkey, to_json(named_struct('k', c_nationkey, 's', c_mktsegment)) AS j FROM customer", "SELECT c_custkey, CAST(to_json({'k': c_nationkey, 's': c_mktsegment}) AS VARCHAR) AS j FROM customer"),
    "json_table": ("SELECT event_id, e.key AS name, e.value AS value FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) e AS key, value", "SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"),
    "collation": ("SELECT c_mktsegment, c_custkey FROM customer WHERE collate(c_mktsegment, 'UTF8_LCASE') = 'building'", "SELECT c_mktsegment, c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
}
