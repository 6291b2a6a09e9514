"""Reading statements over the catalog, with the same question in plain SQL.

``STATEMENTS`` maps a name to the statement and, where DuckDB words it
differently, its counterpart; else the counterpart is the statement with the
bare table names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docloom.sources.tables import catalog

STATEMENTS: dict[str, str | tuple[str, str]] = {
    # Projections and predicates.
    "sql_select_where": "SELECT c_custkey, c_name, c_acctbal FROM {tpch.sales.customer} WHERE c_acctbal > 5000 AND c_nationkey <> 3",
    "sql_alias_star": "SELECT r_regionkey AS k, r_name AS name FROM {tpch.geo.region}",
    "sql_in_between": "SELECT p_partkey, upper(p_type) AS kind FROM {tpch.catalog.part} WHERE p_size IN (1, 5, 9) OR p_retailprice BETWEEN 900 AND 1000",
    "sql_is_null": "SELECT count(*) AS n FROM {tpch.sales.customer} WHERE c_acctbal IS NOT NULL AND NOT (c_mktsegment IS NULL)",
    "sql_case_distinct": "SELECT DISTINCT c_mktsegment AS seg, CASE WHEN c_acctbal >= 5000 THEN 'senior' ELSE 'junior' END AS band FROM {tpch.sales.customer}",
    "sql_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM {tpch.sales.orders}",
    "sql_arithmetic": ("SELECT p_partkey, p_size + 1 AS a, p_size * 2 - 3 AS b, p_size div 7 AS c, p_size % 7 AS d, -p_size AS e FROM {tpch.catalog.part}",
                       "SELECT p_partkey, p_size + 1 AS a, p_size * 2 - 3 AS b, (p_size // 7)::BIGINT AS c, p_size % 7 AS d, -p_size AS e FROM part"),
    "sql_divide_by_zero": ("SELECT p_partkey, try_divide(p_size, p_size - p_size) AS x FROM {tpch.catalog.part}",
                           "SELECT p_partkey, CAST(NULL AS DOUBLE) AS x FROM part"),
    "sql_bit_operators": ("SELECT p_partkey, p_size & 5 AS a, p_size | 8 AS b, ~p_size AS c, shiftleft(p_size, 2) AS d, shiftright(p_size, 1) AS e FROM {tpch.catalog.part}",
                          "SELECT p_partkey, p_size & 5 AS a, p_size | 8 AS b, ~p_size AS c, p_size << 2 AS d, p_size >> 1 AS e FROM part"),
    "sql_quoted_identifiers": ("SELECT `c_name` AS `the name` FROM {tpch.sales.customer} WHERE `c_custkey` < 10", 'SELECT c_name AS "the name" FROM customer WHERE c_custkey < 10'),
    "sql_comments": "SELECT count(*) AS n -- all of them\nFROM {tpch.sales.orders} /* orders */ WHERE o_totalprice > 1000",
    "sql_like": ("SELECT p_partkey FROM {tpch.catalog.part} WHERE p_type ILIKE '%a%' AND p_name LIKE '%1%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%a%' AND p_name LIKE '%1%'"),
    "sql_null_safe": ("SELECT count(*) AS n FROM {tpch.sales.orders} WHERE o_orderstatus <=> 'F'", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F'"),
    "sql_concat": "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR(9)) AS x FROM {tpch.geo.nation}",
    "sql_cast": ("SELECT e.event_id, CAST(e.value AS bigint) AS whole, try_cast(e.event_type AS int) AS none FROM {app.stream.events} e", "SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, TRY_CAST(event_type AS INT) AS none FROM events"),
    "sql_values": ("SELECT v.col1 AS a, v.col2 AS b, n.n AS n FROM (VALUES (1, 'x'), (2, 'y')) v CROSS JOIN (SELECT count(*) AS n FROM {tpch.geo.region}) n",
                   "SELECT v.a, v.b, n.n FROM (VALUES (1, 'x'), (2, 'y')) v(a, b) CROSS JOIN (SELECT count(*) AS n FROM region) n"),
    # Joins.
    "join_inner": "SELECT n_name, r_name FROM {tpch.geo.nation} JOIN {tpch.geo.region} ON n_regionkey = r_regionkey",
    "join_cross_partition": "SELECT c.c_custkey, n.n_name FROM {tpch.sales.customer} c JOIN {tpch.geo.nation} n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal < 0",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM {tpch.geo.nation} a JOIN {tpch.geo.nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_left_anti": "SELECT c.c_custkey FROM {tpch.sales.customer} c LEFT JOIN {tpch.sales.orders} o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "join_comma": "SELECT s.s_name, n.n_name FROM {tpch.catalog.supplier} s, {tpch.geo.nation} n WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000",
    "join_theta": "SELECT a.r_name AS a, b.r_name AS b FROM {tpch.geo.region} a JOIN {tpch.geo.region} b ON a.r_regionkey < b.r_regionkey",
    "join_cross": "SELECT a.r_name AS a, b.n_name AS b FROM {tpch.geo.region} a CROSS JOIN {tpch.geo.nation} b",
    "join_using": ("SELECT k, a.n_name AS n, b.r_name AS r FROM (SELECT n_regionkey AS k, n_name FROM {tpch.geo.nation}) a JOIN (SELECT r_regionkey AS k, r_name FROM {tpch.geo.region}) b USING (k)",
                   "SELECT n_regionkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_natural": ("SELECT n, r FROM (SELECT n_regionkey AS k, n_name AS n FROM {tpch.geo.nation}) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS r FROM {tpch.geo.region}) b",
                     "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_right": "SELECT c.c_custkey, n.n_name FROM {tpch.sales.customer} c RIGHT JOIN {tpch.geo.nation} n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9500",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM (SELECT * FROM {tpch.sales.customer} WHERE c_custkey <= 60) c FULL OUTER JOIN (SELECT * FROM {tpch.catalog.supplier} WHERE s_suppkey BETWEEN 40 AND 90) s ON c.c_custkey = s.s_suppkey",
    "join_semi_exists": "SELECT c.c_custkey FROM {tpch.sales.customer} c WHERE EXISTS (SELECT 1 FROM {tpch.sales.orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)",
    "join_not_exists": "SELECT p_partkey FROM {tpch.catalog.part} p WHERE NOT EXISTS (SELECT 1 FROM {tpch.sales.lineitem} l WHERE l.l_partkey = p.p_partkey)",
    "join_in_subquery": "SELECT o_orderkey FROM {tpch.sales.orders} WHERE o_custkey IN (SELECT c_custkey FROM {tpch.sales.customer} WHERE c_mktsegment = 'BUILDING')",
    "join_json_each": ("SELECT e.event_id, v.key AS member, cast(v.value AS bigint) AS x FROM {app.stream.events} e, LATERAL variant_explode(try_parse_json(e.props)) v WHERE e.event_id % 10 = 0",
                       "SELECT event_id, 'k' AS member, CAST(json_extract(props, '$.k') AS BIGINT) AS x FROM events WHERE event_id % 10 = 0"),
    # Whole tables, where the statements of these names above take a part.
    "join_json_each_all": ("SELECT e.event_id, v.key AS member, cast(v.value AS bigint) AS x FROM {app.stream.events} e, LATERAL variant_explode(try_parse_json(e.props)) v",
                           "SELECT event_id, m AS member, CAST(json_extract(props, '$.\"' || m || '\"') AS BIGINT) AS x FROM (SELECT event_id, props, unnest(json_keys(props)) AS m FROM events)"),
    "join_full_all": "SELECT c.c_custkey, s.s_suppkey FROM {tpch.sales.customer} c FULL OUTER JOIN {tpch.catalog.supplier} s ON c.c_custkey = 20 * s.s_suppkey",
    "sql_quoted_identifiers_all": ("SELECT `c_name` AS `the name` FROM {tpch.sales.customer}", 'SELECT c_name AS "the name" FROM customer'),
    # Aggregates.
    "agg_count_where": "SELECT count(*) AS n, count(o_custkey) AS m FROM {tpch.sales.orders} WHERE o_orderstatus = 'F'",
    "agg_sum_empty": "SELECT sum(p_size) AS s, count(*) AS n FROM {tpch.catalog.part} WHERE p_size < 0",
    "agg_all": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS least, max(l_extendedprice) AS most FROM {tpch.sales.lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_orderpriority, count(*) AS n FROM {tpch.sales.orders} GROUP BY o_orderpriority HAVING count(*) >= 4",
    "agg_having_alias": ("SELECT n_regionkey, count(*) AS n FROM {tpch.geo.nation} GROUP BY n_regionkey HAVING n >= 4", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= 4"),
    "agg_group_expression": "SELECT p_size % 5 AS bucket, count(*) AS n FROM {tpch.catalog.part} GROUP BY p_size % 5",
    "agg_count_distinct": "SELECT count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderstatus) AS s FROM {tpch.sales.orders}",
    "agg_filter": "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS debt, count(*) AS n FROM {tpch.sales.customer} GROUP BY c_mktsegment",
    "agg_total": "SELECT COALESCE(sum(CAST(p_size AS double)), 0.0) AS t FROM {tpch.catalog.part} WHERE p_size > 1000",
    "agg_string": ("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM {tpch.geo.nation} GROUP BY n_regionkey",
                   "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_of_join": "SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {tpch.sales.orders} o JOIN {tpch.sales.customer} c ON o.o_custkey = c.c_custkey JOIN {tpch.geo.nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "agg_bare_column": ("SELECT c_nationkey, max(c_acctbal) AS most, max_by(c_name, struct(c_acctbal, c_custkey)) AS who FROM {tpch.sales.customer} GROUP BY c_nationkey",
                        "SELECT c_nationkey, max(c_acctbal) AS most, arg_max(c_name, (c_acctbal, c_custkey)) AS who FROM customer GROUP BY c_nationkey"),
    # Windows.
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {tpch.sales.orders}",
    "win_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM {tpch.catalog.part}",
    "win_percent": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS c FROM {tpch.catalog.part}",
    "win_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM {tpch.sales.customer}",
    "win_lag_lead": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2, -1) OVER w AS later FROM {app.stream.events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_first_last_nth": "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 3) OVER w AS t FROM {app.stream.events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_running_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS upto FROM {tpch.sales.orders}",
    "win_rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM {app.stream.events}",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {tpch.catalog.part}",
    "win_filter": ("SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS f FROM {tpch.sales.orders}",
                   "SELECT o_orderkey, sum(1) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders"),
    # The same operators where they return rows on these tables.
    "sql_like_found": ("SELECT p_partkey FROM {tpch.catalog.part} WHERE p_brand LIKE 'Brand#_' AND p_name LIKE '%1%'", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_' AND p_name LIKE '%1%'"),
    "join_anti_found": "SELECT c.c_custkey FROM {tpch.sales.customer} c LEFT JOIN {tpch.catalog.supplier} s ON c.c_custkey = s.s_suppkey WHERE s.s_suppkey IS NULL",
    "join_not_exists_found": "SELECT c.c_custkey FROM {tpch.sales.customer} c WHERE NOT EXISTS (SELECT 1 FROM {tpch.catalog.supplier} s WHERE s.s_suppkey = c.c_custkey)",
    "set_except_found": "SELECT c_custkey AS k FROM {tpch.sales.customer} EXCEPT SELECT s_suppkey FROM {tpch.catalog.supplier}",
    # Order and limits.
    "order_limit_offset": "SELECT c_custkey, c_acctbal FROM {tpch.sales.customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5",
    "order_nulls": "SELECT e.user_id, count(*) AS n FROM {app.stream.events} e GROUP BY e.user_id ORDER BY 2 DESC NULLS LAST, 1 LIMIT 7",
    # Set operations.
    "set_union_all": "SELECT c_nationkey AS k FROM {tpch.sales.customer} UNION ALL SELECT s_nationkey FROM {tpch.catalog.supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {tpch.sales.customer} UNION SELECT s_nationkey FROM {tpch.catalog.supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {tpch.sales.customer} INTERSECT SELECT s_nationkey FROM {tpch.catalog.supplier}",
    "set_except": "SELECT n_nationkey AS k FROM {tpch.geo.nation} EXCEPT SELECT s_nationkey FROM {tpch.catalog.supplier} WHERE s_acctbal > 0",
    "set_left_to_right": "(SELECT r_regionkey AS k FROM {tpch.geo.region} UNION SELECT n_nationkey FROM {tpch.geo.nation}) INTERSECT SELECT n_regionkey FROM {tpch.geo.nation} WHERE n_regionkey > 1",
    # Subqueries and common tables.
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {tpch.sales.orders} GROUP BY o_custkey), top AS (SELECT max(t) AS t FROM big) SELECT b.o_custkey FROM big b JOIN top ON b.t = top.t",
    "cte_recursive": ("WITH RECURSIVE steps(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM steps WHERE n < 20) SELECT s.n, r.r_name FROM steps s JOIN {tpch.geo.region} r ON s.n % 5 = r.r_regionkey",
                      "WITH RECURSIVE steps(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM steps WHERE n < 20) SELECT s.n, r.r_name FROM steps s JOIN region r ON s.n % 5 = r.r_regionkey"),
    "subquery_scalar": "SELECT c_custkey FROM {tpch.sales.customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {tpch.sales.customer})",
    "subquery_correlated": "SELECT p.p_partkey FROM {tpch.catalog.part} p WHERE p.p_retailprice > (SELECT avg(q.p_retailprice) FROM {tpch.catalog.part} q WHERE q.p_brand = p.p_brand)",
    # Partitions as one relation: of equal keys the later keyspace's row.
    "partition_one_per_id": ("SELECT id, r_name, n_name FROM {tpch.geo}",
                             "SELECT coalesce(CAST(r_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR)) AS id, CASE WHEN n_nationkey IS NULL THEN r_name END AS r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_nationkey"),
    "partition_join_keyspace": ("SELECT g.id, c.c_name FROM {tpch.geo} g JOIN {tpch.sales.customer} c ON c.c_custkey = CAST(g.id AS bigint)",
                                "SELECT CAST(n_nationkey AS VARCHAR) AS id, c_name FROM nation JOIN customer ON c_custkey = n_nationkey"),
    "partition_count": ("SELECT count(*) AS n FROM {tpch.geo}", "SELECT count(*) AS n FROM (SELECT r_regionkey FROM region UNION SELECT n_nationkey FROM nation)"),
}


def plain(statement: str) -> str:
    """The statement over bare table names."""
    return re.sub(r"\{\w+\.\w+\.(\w+)\}", r"\1", statement)


def _query(statement: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalog(spark, sf_dir).sql(statement)

    return run


QUERIES = {name: _query(s if isinstance(s, str) else s[0]) for name, s in STATEMENTS.items()}
SQL = {name: plain(s) if isinstance(s, str) else s[1] for name, s in STATEMENTS.items()}
