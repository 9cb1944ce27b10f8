"""The relational surface: scans, predicates, joins, aggregation, windows, sorting, sets, generators.

PAIRS: name -> (Spark SQL, SQL of the second engine or None where the text serves both).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import compat

from .common import read, sql

PAIRS: dict[str, tuple[str, str | None]] = {
    "agg_decimal": ("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS STRING) AS s, CAST(max(CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_tax AS DECIMAL(5,3))) AS STRING) AS m, CAST(min(CAST(l_quantity AS DECIMAL(6,2)) - CAST(l_discount AS DECIMAL(4,2))) AS STRING) AS d, count(CAST(l_extendedprice AS DECIMAL(6,2))) AS fits FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS VARCHAR) AS s, CAST(max(CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_tax AS DECIMAL(5,3))) AS VARCHAR) AS m, CAST(min(CAST(l_quantity AS DECIMAL(6,2)) - CAST(l_discount AS DECIMAL(4,2))) AS VARCHAR) AS d, count(TRY_CAST(l_extendedprice AS DECIMAL(6,2))) AS fits FROM lineitem GROUP BY l_returnflag"),
    "fn_session": ("SELECT n_nationkey, current_database() AS d, current_catalog() AS c, version() LIKE '4.%' AS v FROM nation", "SELECT n_nationkey, 'default' AS d, 'spark_catalog' AS c, true AS v FROM nation"),
    # scans and predicates
    "scan_project_filter": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07", None),
    "filter_source_predicates": ("SELECT c_custkey, c_name FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_mktsegment IN ('MACHINERY')) AND NOT c_acctbal < 0 AND c_name LIKE 'Customer%1' AND c_nationkey IS NOT NULL", None),
    "filter_like_rlike": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name RLIKE '^(red|blue) '", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR regexp_matches(p_name, '^(red|blue) ')"),
    "filter_not_in_list": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)", None),
    "filter_nullsafe": ("SELECT e.event_id, (nullif(event_type, 'click') <=> NULL) AS was_click FROM events e", "SELECT e.event_id, (nullif(event_type, 'click') IS NOT DISTINCT FROM NULL) AS was_click FROM events e"),
    "case_when_if": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band, if(o_custkey % 2 = 0, 'even', 'odd') AS parity FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM orders"),
    "cast_rules": ("SELECT c_custkey, CAST(c_name AS INT) AS bad, CAST(substr(c_name, 10) AS BIGINT) AS num, CAST(c_acctbal AS BIGINT) AS whole, CAST(c_nationkey AS STRING) AS s FROM customer", "SELECT c_custkey, TRY_CAST(c_name AS INT) AS bad, CAST(substr(c_name, 10) AS BIGINT) AS num, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(c_nationkey AS VARCHAR) AS s FROM customer"),
    "values_inline": ("SELECT a, b FROM VALUES (1, 'one'), (2, 'two'), (3, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(a, b)"),
    "range_function": ("SELECT id FROM range(0, 100, 7)", "SELECT range AS id FROM range(0, 100, 7)"),
    "cte_chain": ("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT c_custkey, c_name, round(total, 2) AS total FROM top JOIN customer ON o_custkey = c_custkey", None),
    "subquery_scalar": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", None),
    "subquery_scalar_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "subquery_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", None),
    "subquery_exists": ("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l_quantity = 50)", None),
    "subquery_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "subquery_not_in_nulls": ("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM customer WHERE c_acctbal > 9990)", None),
    # joins
    "join_inner_multi": ("SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name", None),
    "join_left_outer": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "join_right_outer": ("SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", None),
    "join_full_outer": ("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) FULL OUTER JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) ON c_custkey = s_suppkey", None),
    "join_left_semi": ("SELECT s_suppkey, s_name FROM supplier LEFT SEMI JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49", "SELECT s_suppkey, s_name FROM supplier SEMI JOIN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) ON s_suppkey = l_suppkey"),
    "join_left_anti": ("SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey", "SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey"),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_natural": ("SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier)", None),
    "join_natural_outer": ("SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) NATURAL FULL JOIN (SELECT r_regionkey + 20 AS k, r_name AS y FROM region)", None),
    "join_using": ("SELECT k, count(*) AS n FROM (SELECT l_orderkey AS k FROM lineitem) JOIN (SELECT o_orderkey AS k FROM orders) USING (k) GROUP BY k", None),
    "join_nullsafe": ("SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 1) AS a FROM customer) JOIN (SELECT nullif(s_nationkey, 1) AS b FROM supplier) ON a <=> b", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 1) AS a FROM customer) JOIN (SELECT nullif(s_nationkey, 1) AS b FROM supplier) ON a IS NOT DISTINCT FROM b"),
    "join_theta": ("SELECT a.s_suppkey AS x, count(*) AS lower FROM supplier a JOIN supplier b ON a.s_acctbal > b.s_acctbal GROUP BY a.s_suppkey", None),
    "join_hint_broadcast": ("SELECT /*+ MAPJOIN(n) */ n_name, count(*) AS c FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS c FROM customer JOIN nation n ON c_nationkey = n_nationkey GROUP BY n_name"),
    "join_hint_shuffle_hash": ("SELECT /*+ SHUFFLE_HASH(o) */ c_mktsegment, count(*) AS c FROM customer JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS c FROM customer JOIN orders o ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "join_hint_merge": ("SELECT /*+ MERGE(o) */ o_orderstatus, count(*) AS c FROM lineitem JOIN orders o ON l_orderkey = o_orderkey GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS c FROM lineitem JOIN orders o ON l_orderkey = o_orderkey GROUP BY o_orderstatus"),
    "join_interval": ("SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAYS GROUP BY o_orderpriority", None),
    "join_existence": ("SELECT c_custkey FROM customer WHERE c_acctbal > 9900 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)", None),
    # aggregation
    "agg_pricing_summary": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_global": ("SELECT count(*) AS n, count(DISTINCT o_custkey) AS custs, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", None),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15", None),
    "agg_group_by_ordinal": ("SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT o_orderstatus, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1, 2"),
    "agg_cube": ("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS TINYINT) AS g1, CAST(grouping(o_orderpriority) AS TINYINT) AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, grouping_id() AS gid, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())", None),
    "agg_distinct_multi": ("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(DISTINCT l_partkey, l_suppkey) AS pairs FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY l_returnflag"),
    "agg_filter_clause": ("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey", None),
    "agg_moments": ("SELECT event_type, round(stddev_samp(value), 4) AS sd, round(stddev_pop(value), 4) AS sdp, round(var_samp(value), 4) AS v, round(var_pop(value), 4) AS vp FROM events GROUP BY event_type", None),
    "agg_skew_kurtosis": ("SELECT round(skewness(value), 4) AS sk, round(kurtosis(value), 4) AS ku FROM events", "WITH m AS (SELECT avg(value) AS mu FROM events), d AS (SELECT avg(power(value - mu, 2)) AS m2, avg(power(value - mu, 3)) AS m3, avg(power(value - mu, 4)) AS m4 FROM events, m) SELECT round(m3 / power(m2, 1.5), 4) AS sk, round(m4 / (m2 * m2) - 3, 4) AS ku FROM d"),
    "agg_corr_covar": ("SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem", None),
    "agg_percentile": ("SELECT o_orderstatus, round(percentile(o_totalprice, 0.5), 4) AS med, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus"),
    "agg_collect": ("SELECT n_regionkey, concat_ws(',', sort_array(collect_list(n_name))) AS names, size(collect_set(n_regionkey)) AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(count(DISTINCT n_regionkey) AS INT) AS k FROM nation GROUP BY n_regionkey"),
    "agg_argmax": ("SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY o_custkey"),
    "agg_first_last_ordered": ("SELECT user_id, first(event_id) AS f, last(event_id) AS l FROM (SELECT user_id, first_value(event_id) OVER w AS event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS f, arg_min(event_id, (ts, event_id)) AS l FROM events GROUP BY user_id"),
    "agg_bool": ("SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'P') AS some_p FROM orders GROUP BY o_custkey", None),
    "agg_bits": ("SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey", None),
    "agg_distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "agg_pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority"),
    # windows
    "window_rank_family": ("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)", "SELECT o_orderkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)"),
    "window_distribution": ("SELECT o_orderkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INT) AS q FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)"),
    "window_lead_lag": ("SELECT event_id, lead(event_type) OVER w AS nxt, lag(event_type, 2, 'none') OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "window_first_last": ("SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "window_rows_frame": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders", None),
    "window_range_frame": ("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem", None),
    "window_range_following": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM orders", None),
    "window_running_total": ("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS running FROM events", None),
    "window_over_aggregate": ("SELECT c_nationkey, c_mktsegment, count(*) AS n, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY c_nationkey, c_mktsegment", "SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS INT) AS r FROM customer GROUP BY c_nationkey, c_mktsegment"),
    "window_top_per_group": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3", None),
    # sort and limit
    "sort_limit_topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "sort_nulls_ordinal": ("SELECT n_name, nullif(n_regionkey, 2) AS r FROM nation ORDER BY 2 NULLS LAST, 1 LIMIT 12", None),
    "limit_constant_expr": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 2 + 1", None),
    "distribute_sort_by": ("SELECT l_orderkey, l_linenumber FROM lineitem DISTRIBUTE BY l_orderkey SORT BY l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem"),
    "cluster_by": ("SELECT c_custkey, c_nationkey FROM customer CLUSTER BY c_nationkey", "SELECT c_custkey, c_nationkey FROM customer"),
    # sets
    "set_union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "set_union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "set_except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "set_intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "set_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    # generators
    "gen_explode": ("SELECT doc_id, w FROM documents LATERAL VIEW explode(split(source, 'r')) t AS w", "SELECT doc_id, unnest(string_split(source, 'r')) AS w FROM documents"),
    "gen_posexplode": ("SELECT p_partkey, pos, w FROM part LATERAL VIEW posexplode(split(p_name, ' ')) t AS pos, w", "SELECT p_partkey, CAST(i - 1 AS INT) AS pos, string_split(p_name, ' ')[i] AS w FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)"),
    "gen_explode_map": ("SELECT n_nationkey, k, v FROM nation LATERAL VIEW explode(map('name', n_name, 'region', CAST(n_regionkey AS STRING))) t AS k, v", "SELECT n_nationkey, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation"),
    "gen_lateral_outer": ("SELECT r_regionkey, x FROM region LATERAL VIEW OUTER explode(filter(array(1, 2), y -> r_regionkey > 2)) t AS x", "SELECT r_regionkey, x FROM region LEFT JOIN (VALUES (1), (2)) t(x) ON r_regionkey > 2"),
    "gen_stack": ("SELECT n_nationkey, k, v FROM nation LATERAL VIEW stack(2, 'key', n_nationkey, 'region', n_regionkey) t AS k, v", "SELECT n_nationkey, 'key' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey FROM nation"),
    "gen_inline": ("SELECT r_name, a, b FROM region LATERAL VIEW inline(array(struct(1 AS a, r_regionkey AS b), struct(2 AS a, r_regionkey + 10 AS b))) t AS a, b", "SELECT r_name, 1 AS a, r_regionkey AS b FROM region UNION ALL SELECT r_name, 2, r_regionkey + 10 FROM region"),
    "gen_json_tuple": ("SELECT event_id, k FROM events LATERAL VIEW json_tuple(props, 'k') t AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
}


def _dataframe_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    total = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return c.join(total, c.c_custkey == total.o_custkey, "left").select("c_custkey", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


def _dataframe_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), F.nullif("c_nationkey", F.lit(4)).alias("nat"))
    return c.na.drop(subset=["nat"]).na.fill({"seg": "none"}).na.replace({"MACHINERY": "M"}, subset=["seg"])


def _dataframe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's last click before it: one sort by user, no range join."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", click.alias("click")).where("event_type = 'error'").select("event_id", "click")


def _approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group the exact number, and by how many tenths of it the estimate is off, rounded down."""
    o = read(spark, sf_dir, "orders")
    both = o.groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.countDistinct("o_custkey").alias("customers"))
    return both.select("o_orderpriority", "customers", F.floor(10 * F.abs(F.col("a") - F.col("customers")) / F.col("customers")).cast("long").alias("tenths_off"))


def _approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an accuracy above the number of rows the approximate percentile is an exact one."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.percentile_approx("o_totalprice", [0.25, 0.5, 0.9], 100_000_000).alias("p"))


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of every group hold all its rows, and their weighted centres its mean."""
    h = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.histogram_numeric("o_totalprice", F.lit(5)).alias("h")).select("o_orderpriority", F.explode("h").alias("b"))
    return h.groupBy("o_orderpriority").agg(F.sum("b.y").cast("long").alias("n"), F.count(F.lit(1)).alias("bins"), F.round(F.sum(F.col("b.x") * F.col("b.y")) / F.sum("b.y"), 2).alias("mean"))


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without replacement: one of all rows is the table, two parts of a split add up to it, and a tenth is near a tenth."""
    n = read(spark, sf_dir, "lineitem")
    k = n.sample(fraction=0.1, seed=7).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("k"))
    whole = n.sample(fraction=1.0, seed=3).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    first, second = n.randomSplit([0.3, 0.7], 5)
    parts = first.unionAll(second).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("split"), F.countDistinct("l_orderkey", "l_linenumber").alias("different"))
    return whole.join(parts, "l_returnflag").join(k, "l_returnflag").select("l_returnflag", "n", "quantity", "split", "different", (F.abs(F.col("k") - 0.1 * F.col("n")) < 0.03 * F.col("n")).alias("near"))


def _freq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "orders").stat.freqItems(["o_orderstatus"], 0.2)
    return found.select(F.explode("o_orderstatus_freqItems").alias("item")).where(F.col("item").isin("F", "O", "P"))


def _pandas_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate: the geometric mean, as expressions of a fold's parts."""
    o = read(spark, sf_dir, "orders").where("o_totalprice > 0")
    return o.groupBy("o_orderstatus").agg(F.round(F.exp(F.avg(F.log("o_totalprice"))), 2).alias("gmean"))


def _pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(discounted("l_extendedprice", "l_discount"), 4).alias("net"))


def _map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keep(batches):
        for pdf in batches:
            yield pdf[pdf.value > pdf.value.clip(upper=50)][["event_id", "value"]]

    return read(spark, sf_dir, "events").select("event_id", "value").mapInPandas(keep, "event_id long, value double")


def _cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def merge(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(merge, "k int, customers long, suppliers long")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return compat.with_index(o, "o_orderdate", "o_orderkey").select("o_orderkey", "at")


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort-merge join on a key that nine tenths of one side share: that side is summed by the key before it moves,
    so a key has one row however many share it."""
    li = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 10 == 0, F.col("l_suppkey")).otherwise(1).alias("k"), "l_quantity")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = li.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").alias("quantity"))
    return s.hint("merge").join(li, s.s_suppkey == li.k).groupBy("s_nationkey").agg(F.sum("rows").alias("n"), F.sum("quantity").alias("quantity"))


FRAMES = {
    "df_zip_with_index": (_indexed, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS at FROM orders"),
    "join_skewed": (_skewed, "SELECT s_nationkey, count(*) AS n, sum(l_quantity) AS quantity FROM supplier JOIN (SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_suppkey ELSE 1 END AS k, l_quantity FROM lineitem) ON s_suppkey = k GROUP BY s_nationkey"),
    "df_join_agg": (_dataframe_join_agg, "SELECT c_custkey, round(coalesce(sum(o_totalprice), 0.0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "df_na_functions": (_dataframe_na, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' WHEN c_mktsegment = 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS seg, c_nationkey AS nat FROM customer WHERE c_nationkey <> 4"),
    "df_asof_join": (_dataframe_asof, "SELECT event_id, click FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click FROM events) WHERE event_type = 'error'"),
    "agg_approx_distinct": (_approx_distinct, "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(0 AS BIGINT) AS tenths_off FROM orders GROUP BY o_orderpriority"),
    "agg_approx_percentile": (_approx_percentile, "SELECT o_orderpriority, quantile_disc(o_totalprice, [0.25, 0.5, 0.9]) AS p FROM orders GROUP BY o_orderpriority"),
    "agg_histogram_numeric": (_histogram, "SELECT o_orderpriority, count(*) AS n, CAST(5 AS BIGINT) AS bins, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY o_orderpriority"),
    "sample_fraction": (_sample, "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, count(*) AS split, count(DISTINCT (l_orderkey, l_linenumber)) AS different, true AS near FROM lineitem GROUP BY l_returnflag"),
    "agg_freq_items": (_freq_items, "SELECT DISTINCT o_orderstatus AS item FROM orders"),
    "udaf_geometric_mean": (_pandas_udaf, "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS gmean FROM orders WHERE o_totalprice > 0 GROUP BY o_orderstatus"),
    "udf_pandas": (_pandas_udf, "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"),
    "udf_map_in_pandas": (_map_in_pandas, "SELECT event_id, value FROM events WHERE value > 50"),
    "udf_cogroup": (_cogroup, "SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k"),
}

QUERIES = {name: sql(text) for name, (text, _) in PAIRS.items()} | {name: f for name, (f, _) in FRAMES.items()}
ORACLE_SQL = {name: other or text for name, (text, other) in PAIRS.items()} | {name: text for name, (_, text) in FRAMES.items()}
