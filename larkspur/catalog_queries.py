"""Registered queries over the relational tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.semantics import int_div, real_div, truthy
from .operators.aggregates import frequent, grouped, top
from .operators.joins import inner, inner_on
from .operators.order import pairs_below
from .sources.tables import table

c = F.col
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """t.orders reads the orders table."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._folder, name)


def query(sql: str):
    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__], _SQL[f.__name__] = (lambda spark, folder: f(Tables(spark, folder))), sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# scans, filters


@query("SELECT r_regionkey, r_name FROM region")
def scan_seq(t):
    return t.region.select("r_regionkey", "r_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 5")
def filter_eq_int(t):
    return t.nation.filter(c("n_nationkey") == 5).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_text(t):
    return t.customer.filter(c("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_linenumber <> 3 AND l_discount >= 0.05 AND l_tax < 0.04")
def filter_cmp_all(t):
    kept = t.lineitem.filter((c("l_quantity") > 10) & (c("l_quantity") <= 20) & (c("l_linenumber") != 3) & (c("l_discount") >= 0.05) & (c("l_tax") < 0.04))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 15")
def filter_between(t):
    return t.part.filter(c("p_size").between(10, 15)).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def filter_not_between(t):
    return t.part.filter(~c("p_size").between(5, 45)).select("p_partkey", "p_size")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(t):
    return t.customer.filter(c("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 2, 3)")
def filter_not_in(t):
    return t.nation.filter(~c("n_regionkey").isin(1, 2, 3)).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'O') AND (o_totalprice < 50000 OR o_custkey < 100)")
def filter_or_not(t):
    return t.orders.filter(~(c("o_orderstatus") == "O") & ((c("o_totalprice") < 50000) | (c("o_custkey") < 100))).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber = l_suppkey")
def filter_same_rel_eq(t):
    return t.lineitem.filter(c("l_linenumber") == c("l_suppkey")).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT r_regionkey, r_name FROM region WHERE 1 = 0")
def filter_const_false(t):
    return t.region.filter(F.lit(1) == F.lit(0)).select("r_regionkey", "r_name")


@query("SELECT r_regionkey FROM region WHERE r_regionkey = 3 AND r_regionkey = 4")
def filter_contradiction(t):
    return t.region.filter((c("r_regionkey") == 3) & (c("r_regionkey") == 4)).select("r_regionkey")


@query("SELECT p_partkey FROM part WHERE NOT coalesce((p_size // nullif(p_size - p_size, 0)) > 1, false)")
def not_null_collapse(t):
    return t.part.filter(~truthy(int_div(c("p_size"), c("p_size") - c("p_size")) > 1, "bool", True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name <> '' AND p_size - 10 <> 0")
def filter_truthy(t):
    return t.part.filter(truthy(c("p_name"), "text", False) & truthy(c("p_size") - 10, "int", False)).select("p_partkey")


# projections


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, -l_linenumber AS negated, l_linenumber * 2 + 1 AS odd FROM lineitem")
def project_arith(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(c("l_extendedprice") * (1 - c("l_discount")), 4).alias("revenue"), (-c("l_linenumber")).alias("negated"), (c("l_linenumber") * 2 + 1).alias("odd"))


@query("SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS sevenths FROM part")
def project_int_div(t):
    return t.part.select("p_partkey", int_div(c("p_size"), F.lit(7)).alias("sevenths"))


@query("SELECT p_partkey, round(p_retailprice / nullif(CAST(p_size - 10 AS DOUBLE), 0), 6) AS ratio FROM part")
def project_div_zero(t):
    return t.part.select("p_partkey", F.round(real_div(c("p_retailprice"), c("p_size") - 10), 6).alias("ratio"))


@query("SELECT o_orderkey, CAST(o_totalprice > 100000 AS BIGINT) AS large FROM orders")
def project_bool_int(t):
    return t.orders.select("o_orderkey", (c("o_totalprice") > 100000).cast("bigint").alias("large"))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hash(t):
    return inner(t.orders, t.customer, c("o_custkey") == c("c_custkey"), "hash").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_merge(t):
    return inner(t.orders, t.lineitem, c("o_orderkey") == c("l_orderkey"), "merge").select("o_orderkey", "l_linenumber", "l_quantity")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast_lookup(t):
    return inner(t.supplier, t.nation, c("s_nationkey") == c("n_nationkey"), "lookup").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2")
def join_index_lookup(t):
    return inner(t.supplier, t.nation.filter(c("n_regionkey") == 2), c("s_nationkey") == c("n_nationkey"), "lookup").select("s_suppkey", "n_nationkey")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")
def join_theta(t):
    return inner(t.supplier, t.nation, c("s_nationkey") < c("n_nationkey"), "lookup").select("s_suppkey", "n_nationkey")


@query("SELECT count(*) AS n FROM part, supplier WHERE p_partkey + 50 < s_suppkey")
def join_theta_arith(t):
    return pairs_below(t.part, c("p_partkey") + 50, t.supplier, c("s_suppkey"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return inner(t.region, t.nation, None).select("r_name", "n_name")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def join_multi_key(t):
    return inner(t.supplier, t.customer, (c("s_nationkey") == c("c_nationkey")) & (c("s_suppkey") == c("c_custkey"))).select("s_suppkey", "c_custkey")


@query("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
def join_expr_eq(t):
    a, b = t.nation.select(c("n_nationkey").alias("low")), t.nation.select(c("n_nationkey").alias("high"))
    return inner(a, b, c("low") + 1 == c("high"))


@query("SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t):
    a = t.nation.select(c("n_name").alias("first_name"), c("n_regionkey").alias("ra"))
    b = t.nation.select(c("n_name").alias("second_name"), c("n_regionkey").alias("rb"))
    return inner(a, b, c("ra") == c("rb")).select("first_name", "second_name")


@query("SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_many_to_many(t):
    """Rows of a key are counted on both sides before the join, so that a common key makes one row instead of all pairs."""
    customers = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    suppliers = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return inner(customers, suppliers, c("c_nationkey") == c("s_nationkey")).agg(F.coalesce(F.sum(c("customers") * c("suppliers")), F.lit(0)).alias("n"))


@query("""SELECT count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM region JOIN nation ON r_regionkey = n_regionkey
JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE r_name = 'ASIA'""")
def join_4way(t):
    nations = inner(t.nation, t.region.filter(c("r_name") == "ASIA"), c("n_regionkey") == c("r_regionkey"), "lookup")
    customers = inner(t.customer, nations, c("c_nationkey") == c("n_nationkey"), "lookup")
    orders = inner(t.orders, customers, c("o_custkey") == c("c_custkey"))
    return inner(t.lineitem, orders, c("l_orderkey") == c("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT s_suppkey, c_custkey FROM supplier, nation, customer WHERE s_nationkey = n_nationkey AND n_nationkey = c_nationkey AND n_nationkey < 3")
def equiv_transitive(t):
    # the edge and the bounds that the two equalities imply
    suppliers, customers = t.supplier.filter(c("s_nationkey") < 3).select("s_suppkey", "s_nationkey"), t.customer.filter(c("c_nationkey") < 3).select("c_custkey", "c_nationkey")
    pairs = inner_on(suppliers, customers, "s_nationkey", "c_nationkey")
    return inner(pairs, t.nation.filter(c("n_nationkey") < 3), (c("s_nationkey") == c("n_nationkey")) & (c("c_nationkey") == c("n_nationkey")), "lookup").select("s_suppkey", "c_custkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 42")
def const_propagation(t):
    return inner(t.orders, t.customer, c("o_custkey") == c("c_custkey")).filter(c("o_custkey") == 42).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey BETWEEN 100 AND 103")
def range_propagation(t):
    return inner(t.orders, t.lineitem, c("o_orderkey") == c("l_orderkey")).filter(c("o_orderkey").between(100, 103)).select("o_orderkey", "l_linenumber")


# aggregation


def _totals():
    return [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderpriority").alias("first_priority"), F.max("o_totalprice").alias("largest")]


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderpriority) AS first_priority, max(o_totalprice) AS largest FROM orders")
def agg_global(t):
    return grouped(t.orders, [], _totals())


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderpriority) AS first_priority, max(o_totalprice) AS largest FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    return grouped(t.orders.filter(c("o_orderkey") < 0), [], _totals())


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group(t):
    return grouped(t.lineitem, [c("l_returnflag"), c("l_linestatus")], [F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean")])


@query("SELECT CAST(p_size // 10 AS BIGINT) AS tens, count(*) AS n FROM part GROUP BY p_size // 10")
def agg_group_expr(t):
    return grouped(t.part, [int_div(c("p_size"), F.lit(10)).alias("tens")], [F.count(F.lit(1)).alias("n")])


@query("SELECT c_mktsegment, max(c_custkey) - min(c_custkey) + count(*) AS span FROM customer GROUP BY c_mktsegment")
def agg_post_expr(t):
    return grouped(t.customer, [c("c_mktsegment")], [(F.max("c_custkey") - F.min("c_custkey") + F.count(F.lit(1))).alias("span")])


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def agg_over_join(t):
    return grouped(inner(t.customer, t.nation, c("n_nationkey") == c("c_nationkey"), "lookup"), [c("n_name")], [F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_keys_only(t):
    return grouped(t.orders, [c("o_orderstatus"), c("o_orderpriority")], [])


@query("SELECT count(p_size // nullif(p_size - 10, 0)) AS defined, count(*) AS n FROM part")
def agg_count_expr(t):
    return t.part.agg(F.count(int_div(c("p_size"), c("p_size") - 10)).alias("defined"), F.count(F.lit(1)).alias("n"))


# order, limit


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def top_n(t):
    return top(t.orders.select("o_orderkey", "o_totalprice"), [c("o_totalprice").desc(), c("o_orderkey").asc()], 7)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")
def top_n_agg(t):
    return top(grouped(t.orders, [c("o_custkey")], [F.count(F.lit(1)).alias("n")]), [c("n").desc(), c("o_custkey").asc()], 5)


@query("SELECT p_partkey, p_size AS extent FROM part ORDER BY extent DESC, 1")
def sort_ordinal_alias(t):
    return t.part.select("p_partkey", c("p_size").alias("extent")).orderBy(c("extent").desc(), c("p_partkey").asc())


@query("SELECT p_partkey FROM part ORDER BY p_retailprice, p_partkey")
def sort_hidden_key(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey").select("p_partkey")


@query("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY max(c_acctbal) DESC, c_mktsegment LIMIT 3")
def sort_hidden_agg(t):
    ranked = grouped(t.customer, [c("c_mktsegment")], [F.max("c_acctbal").alias("most")])
    return top(ranked, [c("most").desc(), c("c_mktsegment").asc()], 3).select("c_mktsegment")


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
def limit_ordered(t):
    return top(t.region.select("r_regionkey", "r_name"), [c("r_regionkey").asc()], 3)


@query("SELECT r_regionkey FROM region LIMIT 0")
def limit_zero(t):
    return t.region.select("r_regionkey").limit(0)


# statistics


@query("SELECT o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 1 ORDER BY rows DESC, value LIMIT 32")
def stats_mcv(t):
    return frequent(t.orders, "o_orderstatus")


@query("SELECT min(p_size) AS least, max(p_size) AS most, count(*) AS n, count(DISTINCT p_size) AS distinct_sizes, round(avg(length(p_name) + 3), 4) AS width FROM part")
def stats_minmax_width(t):
    return t.part.agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.count(F.lit(1)).alias("n"), F.countDistinct("p_size").alias("distinct_sizes"), F.round(F.avg(F.length("p_name") + 3), 4).alias("width"))


@query("""SELECT bucket, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM
(SELECT o_totalprice, CAST(ntile(64) OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS bucket FROM orders) GROUP BY bucket""")
def stats_hist_equidepth(t):
    """Equal-depth buckets with global ranks from range partitions: no window over all rows."""
    rows = t.orders.select("o_totalprice", "o_orderkey").repartitionByRange("o_totalprice", "o_orderkey").withColumn("part", F.spark_partition_id())
    bases = rows.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = bases.agg(F.sum("count").alias("total"))
    ranked = rows.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("o_totalprice", "o_orderkey")))
    ranked = ranked.join(F.broadcast(bases.crossJoin(total)), "part")  # one row per partition
    rank, each, extra = c("base") + c("local") - 1, F.floor(c("total") / 64), c("total") % 64
    bucket = F.when(rank < extra * (each + 1), F.floor(rank / (each + 1))).otherwise(extra + F.floor((rank - extra * (each + 1)) / F.greatest(each, F.lit(1)))) + 1
    return ranked.groupBy(bucket.cast("bigint").alias("bucket")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("""SELECT round(avg(CASE WHEN o_totalprice >= before THEN 1.0 ELSE 0.0 END), 6) AS correlation FROM
(SELECT o_totalprice, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE before IS NOT NULL""")
def stats_correlation(t):
    """Share of neighbours in order of o_orderkey that do not fall; neighbours meet within range partitions, and the ends
    of partitions meet in a window over one row per partition."""
    from .operators.order import neighbours_in_order

    return neighbours_in_order(t.orders, "o_orderkey", "o_totalprice")
