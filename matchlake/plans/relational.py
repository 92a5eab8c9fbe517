"""Relational baseline on the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.plans.common import query, table


@query(
    "pricing_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY 1, 2",
)
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-01-01'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


@query(
    "revenue_by_nation",
    "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("top_customers", "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20")
def top_customers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "total").orderBy(F.desc("total"), "c_custkey").limit(20)


@query("semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def anti_join(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(returned, "p_partkey", "left_anti").select("p_partkey")


@query("full_outer", "SELECT coalesce(a.k, b.k) AS nation, a.c AS customers, b.s AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full")


@query("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    return both.subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("approximate_distinct")
def approximate_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query(
    "ranking_windows",
    "SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)",
)
def ranking_windows(spark, sf_dir):
    w, o = W.partitionBy("o_custkey").orderBy("o_orderdate"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.lag("o_orderkey", 1, -1).over(o).alias("previous"), F.round(F.sum("o_totalprice").over(o.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running")
    )
