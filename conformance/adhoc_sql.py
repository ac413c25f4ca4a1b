"""Ad-hoc queries as a user would type them: one for each part of the SQL surface."""

from __future__ import annotations

ADHOC = {
    "sql_join_inner": """
        SELECT n.n_name, o.o_orderstatus, COUNT(*) AS orders, MAX(o.o_totalprice) AS max_price
        FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        GROUP BY n.n_name, o.o_orderstatus
    """,
    "sql_join_left": """
        SELECT c.c_custkey, COUNT(o.o_orderkey) AS orders, MIN(o.o_orderdate) AS first_order
        FROM customer c
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey
        GROUP BY c.c_custkey
    """,
    "sql_join_semi": """
        SELECT c_custkey, c_nationkey
        FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """,
    "sql_join_anti": """
        SELECT c_custkey, c_nationkey
        FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
    """,
    "sql_join_range": """
        SELECT l.l_linestatus, COUNT(*) AS late_lines
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
            AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '400' DAY
        GROUP BY l.l_linestatus
    """,
    "sql_window_rank": """
        SELECT o_custkey, o_orderkey, o_totalprice, price_rank
        FROM (
            SELECT o_custkey, o_orderkey, o_totalprice,
                   CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS price_rank
            FROM orders
        ) ranked
        WHERE price_rank <= 3
    """,
    "sql_window_frame": """
        SELECT user_id, event_id,
               COUNT(*) OVER (
                   PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW
               ) AS recent_events,
               MAX(value) OVER (
                   PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW
               ) AS recent_max
        FROM events
    """,
    "sql_union": """
        SELECT c_nationkey AS nationkey, 'customer' AS kind FROM customer
        UNION
        SELECT s_nationkey, 'supplier' FROM supplier
    """,
    "sql_intersect": """
        SELECT c_nationkey AS nationkey FROM customer
        INTERSECT
        SELECT s_nationkey FROM supplier
    """,
    "sql_except": """
        SELECT p_partkey AS partkey FROM part
        EXCEPT
        SELECT l_partkey FROM lineitem WHERE l_quantity > 45
    """,
    "sql_rollup": """
        SELECT l_returnflag, l_linestatus, COUNT(*) AS line_count, MAX(l_quantity) AS max_quantity
        FROM lineitem
        GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
    "sql_grouping_sets": """
        SELECT o_orderstatus, o_orderpriority, COUNT(*) AS orders
        FROM orders
        GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
    """,
    "sql_cte_subquery": """
        WITH spending AS (
            SELECT o_custkey, COUNT(*) AS orders, MAX(o_totalprice) AS top_price
            FROM orders GROUP BY o_custkey
        )
        SELECT o_custkey, orders, top_price
        FROM spending
        WHERE orders > (SELECT AVG(orders) FROM spending)
    """,
    "sql_case_string_date": """
        SELECT CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size_class,
               UPPER(SUBSTRING(o_orderpriority, 1, 1)) AS priority_mark,
               CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS order_year,
               COUNT(*) AS orders
        FROM orders
        GROUP BY 1, 2, 3
    """,
}
