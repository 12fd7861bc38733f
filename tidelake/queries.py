"""The registered queries over the driver's tables, each with its oracle.

``SAME`` holds texts that both engines read alike; ``PAIRS`` holds (Spark,
DuckDB) texts where the dialects differ. Money is compared in integer cents,
every sort has a unique last key, and every NULL order is spelled out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidelake.operators.session import LakeSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = """
SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_quantity,
       CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag NULLS LAST, l_linestatus NULLS LAST
"""

SAME: dict[str, str] = {
    "flagship_grouped_sum": FLAGSHIP,
    # projection and filter
    "scan_projection_alias": "SELECT c_custkey AS customer_id, c.c_name AS customer_name, c_mktsegment FROM customer c",
    "wildcard_limit": "SELECT * FROM (SELECT * FROM nation ORDER BY n_nationkey NULLS LAST LIMIT 10) t",
    "filter_compare_eq": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2",
    "filter_compare_gt": "SELECT p_partkey, p_size FROM part WHERE p_size > 45",
    "filter_compare_gte": "SELECT p_partkey, p_size FROM part WHERE p_size >= 49",
    "filter_compare_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 3",
    "filter_compare_lte": "SELECT p_partkey, p_size FROM part WHERE p_size <= 2",
    "filter_reversed_literal": "SELECT p_partkey FROM part WHERE 48 < p_size",
    "filter_not_equal": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus != 'O'",
    "filter_and_flatten": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' AND (l_linenumber = 1 AND l_discount > 0.02))",
    "filter_or_not": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT (c_nationkey < 20)",
    "filter_in_list": "SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 3)",
    "filter_not_in": "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (0, 3)",
    "filter_is_null": "SELECT p_partkey FROM part WHERE NULLIF(p_size, 7) IS NULL",
    "filter_is_not_null": "SELECT p_partkey FROM part WHERE NULLIF(p_size, 7) IS NOT NULL",
    "filter_null_comparison": "SELECT p_partkey FROM part WHERE p_size = NULL",
    "filter_boolean_is_true": "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000) IS TRUE AND (NULLIF(o_orderstatus, 'P') = 'F') IS NOT TRUE",
    "filter_boolean_is_unknown": "SELECT o_orderkey FROM orders WHERE (NULLIF(o_orderstatus, 'F') = 'O') IS NULL",
    "filter_boolean_column": "SELECT k FROM (SELECT o_orderkey AS k, o_totalprice > 150000 AS big FROM orders) t WHERE big AND NOT (k % 2 = 0)",
    "filter_between": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_linenumber NOT BETWEEN 2 AND 9",
    "filter_like_ilike": "SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL' OR p_name ILIKE '%GREEN%' OR p_brand NOT LIKE 'Brand%'",
    "filter_distinct_from": "SELECT p_partkey FROM part WHERE NULLIF(p_size, 7) IS DISTINCT FROM NULLIF(p_size, 9) AND NULLIF(p_size, 50) IS NOT DISTINCT FROM p_size",
    "computed_projection": "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'large' ELSE 'small' END AS size_class, CAST(ROUND(o_totalprice * 100) AS BIGINT) * 2 - 1 AS doubled FROM orders",
    "boolean_columns": "SELECT o_orderkey, o_orderstatus = 'F' AS finished, o_totalprice > 1000 AND o_orderstatus = 'O' AS open_large FROM orders",
    # subqueries
    "scalar_subquery": "SELECT p_partkey FROM part WHERE p_size > (SELECT AVG(p_size) FROM part)",
    "in_subquery_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "exists_semi": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)",
    "not_exists_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "correlated_scalar": "SELECT n_nationkey, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n",
    "derived_table_count": "SELECT COUNT(*) AS high_rows FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 20) filtered",
    "cte_grouped_sum": "WITH base AS (SELECT o_orderstatus, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders) SELECT o_orderstatus, CAST(SUM(cents) AS BIGINT) AS total_cents FROM base GROUP BY o_orderstatus",
    "cte_alias_projection": "WITH a AS (SELECT p_partkey AS id, p_size AS value FROM part), b AS (SELECT id, value + 1 AS next_value FROM a WHERE value < 5) SELECT id, next_value FROM b",
    "cte_column_list": "WITH t(id, size_of) AS (SELECT p_partkey, p_size FROM part) SELECT id, size_of FROM t WHERE size_of > 40",
    "derived_column_list": "SELECT q.k, q.n FROM (SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus) AS q(k, n)",
    "cte_reused_join": "WITH t AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM t a JOIN t b ON a.o_custkey = b.o_custkey WHERE b.n >= 20",
    # aggregates
    "count_star": "SELECT COUNT(*) AS row_count FROM lineitem",
    "count_column": "SELECT COUNT(NULLIF(p_size, 7)) AS sized, COUNT(*) AS all_rows FROM part",
    "sum_cents": "SELECT CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM orders",
    "avg_rounded": "SELECT p_brand, ROUND(AVG(p_size), 6) AS mean_size FROM part GROUP BY p_brand",
    "min_max_string_int": "SELECT MIN(n_name) AS first_name, MAX(n_name) AS last_name, MIN(n_nationkey) AS lo, MAX(n_nationkey) AS hi FROM nation",
    "min_max_dates": "SELECT o_orderstatus, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day FROM orders GROUP BY o_orderstatus",
    "bool_and_or": "SELECT n_regionkey, BOOL_AND(n_nationkey >= 0) AS all_named, BOOL_OR(n_name LIKE 'A%') AS any_a FROM nation GROUP BY n_regionkey",
    "group_by_multi": "SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "group_by_null_key": "SELECT NULLIF(p_size, 7) AS size_key, COUNT(*) AS n FROM part GROUP BY NULLIF(p_size, 7)",
    "group_by_modulo": "SELECT o_orderkey % 256 AS bucket, COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderkey % 256",
    "group_by_all": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL",
    "empty_global_agg": "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS total, MIN(p_name) AS first_name, AVG(p_size) AS mean FROM part WHERE p_size < 0",
    "having_sum": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15",
    "select_distinct": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag",
    "agg_filter_clause": "SELECT n_regionkey, COUNT(*) FILTER (WHERE n_nationkey > 10) AS late, CAST(SUM(n_nationkey) FILTER (WHERE n_nationkey < 10) AS BIGINT) AS early FROM nation GROUP BY n_regionkey",
    "case_conditional_sum": "SELECT CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM orders",
    "two_level_aggregate": "SELECT n AS orders_per_customer, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n",
    "aggregate_states": "SELECT CAST(SUM(n) AS BIGINT) AS rows_all, MAX(n) AS most, MIN(n) AS least, COUNT(*) AS parts FROM (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey) t",
    "spill_style_expanded_groupby": "SELECT l_partkey % 97 AS a, l_suppkey % 13 AS b, l_linenumber + 1 AS c, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_partkey % 97, l_suppkey % 13, l_linenumber + 1",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT p_brand, p_size, COUNT(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    # windows
    "row_number_external_sort": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS LAST) AS BIGINT) AS place FROM orders",
    "rank_dense_rank": "SELECT c_custkey, CAST(RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS LAST) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment NULLS LAST) AS BIGINT) AS d FROM customer",
    "percent_rank_cume_dist": "SELECT c_custkey, ROUND(PERCENT_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_custkey NULLS LAST), 9) AS p, ROUND(CUME_DIST() OVER (PARTITION BY c_nationkey ORDER BY c_custkey NULLS LAST), 9) AS c FROM customer",
    "lag_lead": "SELECT event_id, LAG(event_id, 1) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST) AS before_id, LEAD(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST) AS after_id FROM events",
    "running_sum_rows": "SELECT o_orderkey, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM orders",
    "moving_sum_range": "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS near_sizes FROM part",
    "ntile": "SELECT s_suppkey, CAST(NTILE(4) OVER (ORDER BY s_suppkey NULLS LAST) AS BIGINT) AS quarter FROM supplier",
    "first_last_value": "SELECT c_custkey, FIRST_VALUE(c_custkey) OVER w AS first_key, LAST_VALUE(c_custkey) OVER w AS last_key FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "window_over_aggregate": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS all_n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    # sort and limit
    "order_nulls_default": "SELECT p_partkey, NULLIF(p_size, 50) AS size_or_null FROM part ORDER BY NULLIF(p_size, 50) DESC NULLS FIRST, p_partkey NULLS LAST",
    "order_multi_key": "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer ORDER BY c_mktsegment NULLS LAST, c_nationkey DESC NULLS FIRST, c_custkey NULLS LAST",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS LAST LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey NULLS LAST LIMIT 20 OFFSET 35",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    # set operations
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT p_size AS k FROM part",
    "intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey AS k FROM region",
    "except": "SELECT p_size AS k FROM part EXCEPT SELECT s_nationkey AS k FROM supplier",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey AS k FROM region",
    # joins
    "self_join_inner": "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "self_left_join": "SELECT a.n_nationkey AS k, b.n_name AS partner FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_nationkey + 20",
    "self_right_join": "SELECT a.n_name AS partner, b.n_nationkey AS k FROM nation a RIGHT JOIN nation b ON a.n_nationkey = b.n_nationkey + 20",
    "self_full_join": "SELECT a.n_nationkey AS k, b.n_nationkey AS shifted FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey + 5",
    "cross_join_small": "SELECT a.r_regionkey AS a_key, b.r_regionkey AS b_key FROM region a CROSS JOIN region b",
    "comma_join": "SELECT a.r_name AS r, COUNT(*) AS n FROM region a, nation b WHERE a.r_regionkey = b.n_regionkey GROUP BY a.r_name",
    "nested_join": "SELECT c.c_custkey, r.r_name FROM customer c JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey",
    "join_using": "SELECT o_custkey, COUNT(*) AS n FROM orders JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 0) t USING (o_custkey) GROUP BY o_custkey",
    "star_join_revenue_by_nation": """
SELECT n_name, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "broadcast_dim_join": "SELECT r_name, COUNT(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    # scalar expressions
    "arith_cast_case": "SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS twice, p_size + 3 - 1 AS moved, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS word, -p_size AS negative FROM part",
    "modulo": "SELECT p_partkey, p_size % 7 AS m, (0 - p_size) % 7 AS minus_m FROM part",
    "date_literal_filter": "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'",
    "extract_year_month": "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, COUNT(*) AS n FROM orders GROUP BY 1, 2",
    "ceil_floor_round": "SELECT o_orderkey, CAST(CEIL(o_totalprice) AS BIGINT) AS up, CAST(FLOOR(o_totalprice) AS BIGINT) AS down, CAST(ROUND(o_totalprice) AS BIGINT) AS near, ABS(0 - o_custkey) AS size FROM orders",
    "trim_position": "SELECT n_nationkey, TRIM(CONCAT('  ', n_name, ' ')) AS trimmed, CAST(POSITION('A' IN n_name) AS BIGINT) AS at_a, UPPER(n_name) AS up, LOWER(n_name) AS low FROM nation",
    "substring_from_for": "SELECT n_nationkey, SUBSTRING(n_name FROM 2 FOR 3) AS middle, SUBSTRING(n_name, 1, 2) AS head FROM nation",
    "length_sum": "SELECT CAST(SUM(LENGTH(c_name)) AS BIGINT) AS name_chars FROM customer",
    "coalesce_nullif": "SELECT p_partkey, COALESCE(NULLIF(p_size, 7), -1) AS size_or, GREATEST(p_size, 25) AS hi, LEAST(p_size, 25) AS lo FROM part",
    "string_functions": "SELECT c_custkey, REPLACE(c_name, '#', '-') AS dashed, CONCAT(c_mktsegment, ':', c_name) AS joined, REVERSE(c_name) AS back, LPAD(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS padded FROM customer",
    "math_functions": "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS root, ROUND(POWER(p_size, 2), 3) AS square, ROUND(LN(p_size + 1), 9) AS log, CAST(SIGN(p_size - 25) AS BIGINT) AS side FROM part",
    "double_quoted_identifier": 'SELECT "o_orderkey" AS "Order Key" FROM orders WHERE "o_orderstatus" = \'P\'',
}

PAIRS: dict[str, tuple[str, str]] = {
    "filter_rlike": ("SELECT p_partkey FROM part WHERE p_brand RLIKE '^Brand#[1-2]'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[1-2]')"),
    "filter_similar_to": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#[12]%'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[12].*$')"),
    "filter_similar_to_classes": (
        "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand[#%]([1-2]_|3[^3-9]+)' OR p_type NOT SIMILAR TO '%(STEEL|TIN!%)' ESCAPE '!'",
        "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand[#%]([1-2].|3[^3-9]+)$', 's') OR NOT regexp_matches(p_type, '^.*(STEEL|TIN%)$', 's')",
    ),
    "filter_any_all": ("SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (array(1, 3, 5)) OR n_nationkey > ALL (array(20, 22))", "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY([1, 3, 5]) OR (n_nationkey > 20 AND n_nationkey > 22)"),
    "filter_any_subquery": (
        "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    ),
    "json_arrows": ("SELECT event_id, props ->> 'k' AS as_text, props -> 'k' AS as_json FROM events", "SELECT event_id, props ->> '$.k' AS as_text, CAST(props -> '$.k' AS VARCHAR) AS as_json FROM events"),
    "at_time_zone_syntax": ("SELECT event_id, ts AT TIME ZONE 'America/New_York' AS utc FROM events", "SELECT event_id, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM events"),
    "convert_syntax": ("SELECT p_partkey, CONVERT(p_size, VARCHAR) AS as_text, CONVERT(p_retailprice, BIGINT) AS whole FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS as_text, CAST(trunc(p_retailprice) AS BIGINT) AS whole FROM part"),
    "array_agg_filter_order": (
        "SELECT n_regionkey, array_join(ARRAY_AGG(n_name ORDER BY n_name DESC) FILTER (WHERE n_nationkey > 5), ',') AS names, size(ARRAY_AGG(NULLIF(n_nationkey, 3))) AS all_rows FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC) FILTER (WHERE n_nationkey > 5), ',') AS names, CAST(len(array_agg(NULLIF(n_nationkey, 3))) AS INT) AS all_rows FROM nation GROUP BY n_regionkey",
    ),
    "array_agg_window": (
        "SELECT n_nationkey, array_join(ARRAY_AGG(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS so_far FROM nation",
        "SELECT n_nationkey, array_to_string(array_agg(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS so_far FROM nation",
    ),
    "string_agg_ordered": ("SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "types_decimal_binary_ntz": (
        "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2)) AS exact, hex(CAST(o_orderstatus AS BINARY)) AS bytes, CAST(o_orderdate AS TIMESTAMP_NTZ) AS local_time FROM orders",
        "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2)) AS exact, hex(CAST(o_orderstatus AS BLOB)) AS bytes, o_orderdate AS local_time FROM orders",
    ),
    "filter_is_unknown": ("SELECT p_partkey FROM part WHERE (NULLIF(p_size, 7) > 3) IS UNKNOWN", "SELECT p_partkey FROM part WHERE (NULLIF(p_size, 7) > 3) IS NULL"),
    "array_agg_sorted": (
        "SELECT n_regionkey, array_join(transform(array_sort(transform(collect_list(struct(NULLIF(n_nationkey, 3) AS x)), e -> e.x)), e -> coalesce(cast(e AS STRING), 'NULL')), ',') AS keys FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(list_transform(list_sort(array_agg(NULLIF(n_nationkey, 3)), 'ASC', 'NULLS LAST'), lambda e: coalesce(CAST(e AS VARCHAR), 'NULL')), ',') AS keys FROM nation GROUP BY n_regionkey",
    ),
    "integer_division": ("SELECT p_partkey, p_size / 2 AS half, p_size div 2 AS whole FROM part", "SELECT p_partkey, p_size / 2 AS half, CAST(p_size // 2 AS BIGINT) AS whole FROM part"),
    "overlay": ("SELECT n_nationkey, overlay(n_name PLACING 'xx' FROM 2 FOR 1) AS put FROM nation", "SELECT n_nationkey, substr(n_name, 1, 1) || 'xx' || substr(n_name, 3) AS put FROM nation"),
    "trim_sides": ("SELECT n_nationkey, trim(LEADING 'A' FROM n_name) AS l, trim(TRAILING 'A' FROM n_name) AS t FROM nation", "SELECT n_nationkey, ltrim(n_name, 'A') AS l, rtrim(n_name, 'A') AS t FROM nation"),
    "at_time_zone": ("SELECT event_id, to_utc_timestamp(ts, 'America/New_York') AS utc FROM events", "SELECT event_id, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM events"),
    "date_arithmetic": ("SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 30) AS due, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INT) AS age FROM orders"),
    "date_trunc_month": ("SELECT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start, COUNT(*) AS n FROM orders GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, COUNT(*) AS n FROM orders GROUP BY 1"),
    "json_access_props": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "collate_compare": ("SELECT n_nationkey FROM nation WHERE n_name COLLATE UTF8_LCASE = lower(n_name) COLLATE UTF8_LCASE", "SELECT n_nationkey FROM nation WHERE lower(n_name) = lower(n_name)"),
    "convert_types": ("SELECT p_partkey, CAST(CAST(p_size AS STRING) AS BIGINT) AS as_int, CAST(p_size AS DOUBLE) AS as_double FROM part", "SELECT p_partkey, CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS as_int, CAST(p_size AS DOUBLE) AS as_double FROM part"),
    "struct_and_array_access": ("SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).a AS a, array(n_nationkey, n_regionkey)[1] AS second FROM nation", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).a AS a, [n_nationkey, n_regionkey][2] AS second FROM nation"),
    "percentile_within_group": ("SELECT p_brand, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS mid FROM part GROUP BY p_brand", "SELECT p_brand, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS DOUBLE) AS mid FROM part GROUP BY p_brand"),
    "ordered_string_agg": ("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
}


def plain(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a text over the driver's tables as Parquet datasets of one session."""
    session = LakeSession(spark)
    for name in TABLES:
        if name in sql:
            session.open_parquet(name, f"{sf_dir}/{name}.parquet")
    return session.frame(sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidelake import lakequeries

    found = {name: partial(plain, text) for name, text in SAME.items()}
    found |= {name: partial(plain, text) for name, (text, _) in PAIRS.items()}
    return found | lakequeries.queries()


def oracle_sql() -> dict[str, str]:
    from tidelake import lakequeries

    return SAME | {name: text for name, (_, text) in PAIRS.items()} | lakequeries.oracle_sql()
