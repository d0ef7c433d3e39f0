"""Registered queries in the engine's own dialect: tables are registered, and parser, binder and settings build the frame.

Each has SQL for checking, in which the dialect's rules are spelt out: INT is 64-bit, truth values are numbers, `/` of
integers truncates, AND, OR and NOT treat NULL as false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")
OFF = {"hash": "enable_hashjoin", "merge": "enable_mergejoin", "nestloop": "enable_nestloop", "lookup": "enable_indexnlj"}

#: name: (statement, SQL that checks it (None: the same text), the only join method allowed, if any)
STATEMENTS: dict[str, tuple[str, str | None, str | None]] = {
    "sql_select_star": ("SELECT * FROM nation n WHERE n.n_regionkey = 1", 'SELECT CAST(n_nationkey AS BIGINT) AS "n.n_nationkey", n_name AS "n.n_name", CAST(n_regionkey AS BIGINT) AS "n.n_regionkey" FROM nation WHERE n_regionkey = 1', None),
    "sql_output_names": ("SELECT n.n_name, n_nationkey + 1, count(*) FROM nation n GROUP BY n.n_name, n_nationkey", 'SELECT n_name AS "n.n_name", CAST(n_nationkey + 1 AS BIGINT) AS "(n_nationkey + 1)", count(*) AS "count(*)" FROM nation GROUP BY n_name, n_nationkey', None),
    "sql_literals": ("SELECT 7 / 2 AS half, -7 / 2 AS low, 7 / 0 AS nothing, 7.0 / 2 AS real, 1 < 2 AS less, TRUE AS yes, 'it''s' AS words, 1e3 AS big FROM region WHERE r_regionkey = 1", "SELECT CAST(3 AS BIGINT) AS half, CAST(-3 AS BIGINT) AS low, CAST(NULL AS BIGINT) AS nothing, CAST(3.5 AS DOUBLE) AS real, CAST(1 AS BIGINT) AS less, CAST(1 AS BIGINT) AS yes, 'it''s' AS words, CAST(1000 AS DOUBLE) AS big", None),
    "sql_precedence": ("SELECT p_partkey FROM part WHERE NOT p_size > 10 AND p_retailprice < 1000 OR p_size = 3 + 2 * 4 OR (p_size = 20 OR p_size = 21) AND p_retailprice > 1100", None, None),
    "sql_ranges_and_lists": ("SELECT p_partkey, p_size * 2 - 1 AS odd FROM part WHERE p_size BETWEEN 5 AND 30 AND p_size NOT IN (7, 8) AND p_brand <> 'Brand#11' AND p_size NOT BETWEEN 20 AND 22", "SELECT p_partkey, CAST(p_size * 2 - 1 AS BIGINT) AS odd FROM part WHERE p_size BETWEEN 5 AND 30 AND p_size NOT IN (7, 8) AND p_brand <> 'Brand#11' AND p_size NOT BETWEEN 20 AND 22", None),
    "sql_null_is_false": ("SELECT count(*) AS n FROM part WHERE NOT (p_size / (p_size - 10) > 1) AND NOT (1 / 0 = 1)", "SELECT count(*) AS n FROM part WHERE NOT coalesce(trunc(p_size / nullif(p_size - 10, 0)) > 1, false)", None),
    "sql_nulls_of_frames": ("SELECT count(*) AS n FROM documents WHERE NOT (lang = 'en' AND source <> 'books')", "SELECT count(*) AS n FROM documents WHERE NOT (coalesce(lang = 'en', false) AND coalesce(source <> 'books', false))", None),
    "sql_truth_of_values": ("SELECT count(*) AS n FROM part WHERE p_name AND NOT p_size - 10 OR 0", "SELECT count(*) AS n FROM part WHERE p_name <> '' AND p_size = 10", None),
    "sql_constant_condition": ("SELECT n_name FROM nation WHERE 1 = 0", None, None),
    "sql_contradiction": ("SELECT n_name FROM nation WHERE n_nationkey = 3 AND n_nationkey = 4", None, None),
    "sql_same_table_equality": ("SELECT n_name FROM nation WHERE n_nationkey = n_regionkey", None, None),
    "sql_join_on": ("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2", None, None),
    "sql_class_closure": ("SELECT s_suppkey, c_custkey FROM supplier, nation, customer WHERE s_nationkey = n_nationkey AND n_nationkey = c_nationkey AND c_nationkey < 3", None, None),
    "sql_constant_of_class": ("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_custkey = 42", None, None),
    "sql_theta_join": ("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey + 1 < b.n_nationkey", "SELECT CAST(a.n_nationkey AS BIGINT) AS low, CAST(b.n_nationkey AS BIGINT) AS high FROM nation a JOIN nation b ON a.n_nationkey + 1 < b.n_nationkey", None),
    "sql_expression_join": ("SELECT a.n_name AS one, b.n_name AS two FROM nation a, nation b WHERE a.n_nationkey * 2 = b.n_nationkey - 1", None, None),
    "sql_cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None, None),
    "sql_hash_join": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", None, "hash"),
    "sql_merge_join": ("SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey", "SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM orders, lineitem WHERE o_orderkey = l_orderkey", "merge"),
    "sql_nested_loop_join": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", None, "nestloop"),
    "sql_index_loop_join": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", None, "lookup"),
    "sql_grouping": ("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber) AS total, min(l_quantity) AS least, max(l_extendedprice) AS most, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, min(l_quantity) AS least, max(l_extendedprice) AS most, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "sql_empty_aggregate": ("SELECT count(*) AS n, count(p_size) AS sizes, sum(p_size) AS total, min(p_name) AS first, avg(p_size) AS mean FROM part WHERE p_size > 1000", "SELECT count(*) AS n, count(p_size) AS sizes, CAST(sum(p_size) AS BIGINT) AS total, min(p_name) AS first, avg(p_size) AS mean FROM part WHERE p_size > 1000", None),
    "sql_keys_only": ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", None, None),
    "sql_group_by_constant": ("SELECT count(*) AS n FROM customer GROUP BY 1", "SELECT count(*) AS n FROM customer", None),
    "sql_after_aggregation": ("SELECT p_brand, max(p_size) - min(p_size) + 1 AS span, sum(p_size) / count(*) AS mean FROM part GROUP BY p_brand", "SELECT p_brand, CAST(max(p_size) - min(p_size) + 1 AS BIGINT) AS span, CAST(sum(p_size) // count(*) AS BIGINT) AS mean FROM part GROUP BY p_brand", None),
    "sql_repeated_aggregate": ("SELECT n_regionkey AS r, count(*) AS n, count(*) * 2 AS twice FROM nation GROUP BY n_regionkey", "SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, CAST(count(*) * 2 AS BIGINT) AS twice FROM nation GROUP BY n_regionkey", None),
    "sql_hidden_aggregate": ("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 3", None, None),
    "sql_order_by_position": ("SELECT p_partkey, p_size AS size FROM part ORDER BY 2 DESC, 1 LIMIT 9", "SELECT p_partkey, CAST(p_size AS BIGINT) AS size FROM part ORDER BY p_size DESC, p_partkey LIMIT 9", None),
    "sql_order_by_alias": ("SELECT p_partkey AS k, p_size * 3 AS t FROM part ORDER BY t, k DESC LIMIT 9", "SELECT p_partkey AS k, CAST(p_size * 3 AS BIGINT) AS t FROM part ORDER BY t, k DESC LIMIT 9", None),
    "sql_order_by_hidden_column": ("SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 9", None, None),
    "sql_limit_zero": ("SELECT n_name FROM nation LIMIT 0", None, None),
}


def engine(spark: SparkSession, folder: str) -> Engine:
    e = Engine(spark)
    for name in TABLES:
        e.register(name, table(spark, folder, name))
    return e


def made(text: str, only: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = engine(spark, folder)
        for method, setting in OFF.items():
            e.execute(f"SET {setting} = {'on' if only in (None, method) else 'off'}")
        return e.execute(text).frame

    return run


def column_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What ANALYZE finds of a table, without the sketched number of distinct values."""
    return engine(spark, folder).execute("SHOW STATS part").frame.select("column", "type", "min", "max").filter("type = 'int'")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: made(text, only) for name, (text, _, only) in STATEMENTS.items()} | {"sql_show_stats": column_statistics}


def oracle_sql() -> dict[str, str]:
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'int' AS type, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM part" for c in ("p_partkey", "p_size"))
    return {name: sql or text for name, (text, sql, _) in STATEMENTS.items()} | {"sql_show_stats": each}
