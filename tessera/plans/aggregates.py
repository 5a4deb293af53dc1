"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import table, tables


def _money(c: str):
    return F.col(c).cast("decimal(12,2)")


def customer_totals(spark: SparkSession, d: str) -> DataFrame:
    """A1"""
    t = _money("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(t).cast("double").alias("total"), (F.sum(t).cast("double") / F.count("*")).alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2: one scan, partial sums, no join."""
    price, disc, tax, qty = _money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)"), _money("l_quantity")
    n = F.count("*")
    return (
        table(spark, d, "lineitem")
        .where("l_shipdate <= timestamp_ntz '1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(qty).cast("double").alias("sum_qty"),
            F.sum(price).cast("double").alias("sum_base_price"),
            F.sum(price * (1 - disc)).cast("double").alias("sum_disc_price"),
            F.sum(price * (1 - disc) * (1 + tax)).cast("double").alias("sum_charge"),
            (F.sum(qty).cast("double") / n).alias("avg_qty"),
            (F.sum(price).cast("double") / n).alias("avg_price"),
            (F.sum(disc).cast("double") / n).alias("avg_disc"),
            n.alias("count_order"),
        )
    )


def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3"""
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").cast("bigint").alias("purchases"), F.count(F.when(F.col("value") > 50, 1)).alias("large"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("last_error"))


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """A4"""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("n"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A5"""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(*[F.round(F.percentile("c_acctbal", F.lit(q)), 4).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("p90", 0.9))], F.mode("c_nationkey", True).alias("nation"))


def moments(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[(F.round(x, 6) + 0.0).alias(n) for n, x in (("var_qty", F.var_pop("l_quantity")), ("sd_tax", F.stddev_samp("l_tax")), ("corr_qp", F.corr("l_quantity", "l_extendedprice")), ("covar_dt", F.covar_samp("l_discount", "l_tax")))])


def shape(spark: SparkSession, d: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.skewness("value"), 6).alias("skew"), F.round(F.kurtosis("value"), 6).alias("kurt"))


def arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    """A8"""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"))


def rollup_sets(spark: SparkSession, d: str) -> DataFrame:
    """A9"""
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), F.sum("p_size").cast("bigint").alias("size"))


def cube_sets(spark: SparkSession, d: str) -> DataFrame:
    """A9"""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"))


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """A9"""
    return spark.sql("SELECT event_type, user_id, count(*) AS n FROM {events} GROUP BY GROUPING SETS ((event_type), (user_id), ())", **tables(spark, d, "events"))


def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    """A10: stated values, so that no pass over the data looks for them."""
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(f"n_{c.lower()}") for c in ("F", "O", "P")])


def unpivot_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A10"""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size"), F.length("p_name").cast("bigint").alias("name_length"))
    return p.unpivot("p_partkey", ["size", "name_length"], "measure", "amount")


def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """The names of each region's nations in the order of their keys."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return n.select("n_regionkey", F.array_join(F.col("x.n_name"), ",").alias("names"))


def map_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by nation, as text in the order of keys."""
    per = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = per.groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n")))).alias("m"))
    return m.select("n_regionkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("suppliers"))


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """A sketch; the exact figure beside it is what tests compare it with."""
    return table(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.countDistinct("l_partkey").alias("exact"))


_FNS = (customer_totals, pricing_summary, conditional_counts, distinct_counts, percentiles, moments, shape, arg_extremes, rollup_sets, cube_sets, grouping_sets, pivot_status, unpivot_sizes, ordered_lists, map_aggregate, approx_distinct)
QUERIES = {f.__name__: f for f in _FNS}
ORACLE_SQL = {
    "customer_totals": """
        SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
               CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last
        FROM orders GROUP BY 1""",
    "pricing_summary": """
        WITH l AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(l_extendedprice AS DECIMAL(12,2)) AS p,
                          CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t
                   FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02')
        SELECT l_returnflag, l_linestatus, CAST(sum(q) AS DOUBLE) AS sum_qty, CAST(sum(p) AS DOUBLE) AS sum_base_price,
               CAST(sum(p * (1 - d)) AS DOUBLE) AS sum_disc_price, CAST(sum(p * (1 - d) * (1 + t)) AS DOUBLE) AS sum_charge,
               CAST(sum(q) AS DOUBLE) / count(*) AS avg_qty, CAST(sum(p) AS DOUBLE) / count(*) AS avg_price,
               CAST(sum(d) AS DOUBLE) / count(*) AS avg_disc, count(*) AS count_order
        FROM l GROUP BY 1, 2""",
    "conditional_counts": """
        SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 50) AS large,
               max(event_id) FILTER (WHERE event_type = 'error') AS last_error FROM events GROUP BY 1""",
    "distinct_counts": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, count(*) AS n FROM lineitem GROUP BY 1",
    "percentiles": """
        SELECT s.c_mktsegment, q1, median, p90, nation FROM
            (SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.9), 4) AS p90 FROM customer GROUP BY 1) s
        JOIN (SELECT c_mktsegment, arg_min(c_nationkey, (-n, c_nationkey)) AS nation
              FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1) m USING (c_mktsegment)""",
    "moments": """
        SELECT l_returnflag, round(var_pop(l_quantity), 6) + 0.0 AS var_qty, round(stddev_samp(l_tax), 6) + 0.0 AS sd_tax,
               round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS corr_qp, round(covar_samp(l_discount, l_tax), 6) + 0.0 AS covar_dt FROM lineitem GROUP BY 1""",
    "shape": """
        SELECT e.event_type, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 6) AS skew,
               round(avg(pow(value - m, 4)) / pow(avg(pow(value - m, 2)), 2) - 3, 6) AS kurt
        FROM events e JOIN (SELECT event_type, avg(value) AS m FROM events GROUP BY 1) a USING (event_type) GROUP BY 1""",
    "arg_extremes": """
        SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest
        FROM orders GROUP BY 1""",
    "rollup_sets": "SELECT p_brand, p_type, grouping(p_brand, p_type) AS level, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "cube_sets": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "pivot_status": """
        SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
               count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1""",
    "unpivot_sizes": """
        SELECT p_partkey, 'size' AS measure, CAST(p_size AS BIGINT) AS amount FROM part
        UNION ALL SELECT p_partkey, 'name_length', length(p_name) FROM part""",
    "ordered_lists": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
    "map_aggregate": """
        SELECT n_regionkey, string_agg(n_name || '=' || n, ';' ORDER BY n_name) AS suppliers
        FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
}
