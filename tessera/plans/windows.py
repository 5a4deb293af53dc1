"""Window functions, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.sessions import sessionize
from tessera.operators.topk import top_k
from tessera.operators.ordered import frame_counts
from tessera.tables import table


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """W1"""
    w = W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    t = W.partitionBy("c_nationkey").orderBy("c_mktsegment")
    long = {"row_number": F.row_number().over(w), "rank": F.rank().over(t), "dense_rank": F.dense_rank().over(t), "quarter": F.ntile(4).over(w)}
    return table(spark, d, "customer").select("c_custkey", *[x.cast("bigint").alias(n) for n, x in long.items()], F.percent_rank().over(t).alias("percent_rank"), F.cume_dist().over(t).alias("cume_dist"))


def analytic(spark: SparkSession, d: str) -> DataFrame:
    """W2"""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("second_after"), F.first("o_orderkey").over(whole).alias("first"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


def rows_frame(spark: SparkSession, d: str) -> DataFrame:
    """Moving sum of three, in cents."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(12,2)")).over(w).cast("double").alias("moving"), F.count("*").over(w).alias("n"))


def range_frame(spark: SparkSession, d: str) -> DataFrame:
    """Events of the user in the hour up to each; a user with very many is many tasks' work."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return frame_counts(e, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000).select("event_id", "n")


def above_average(spark: SparkSession, d: str) -> DataFrame:
    """A filter on a window."""
    cents = F.round(F.col("s_acctbal").cast("decimal(12,2)") * 100).cast("bigint")
    w = W.partitionBy("s_nationkey")
    return table(spark, d, "supplier").withColumn("cents", cents).withColumn("total", F.sum("cents").over(w)).withColumn("n", F.count("*").over(w)).where("cents * n > total").select("s_suppkey", "s_nationkey", "cents")


def top_k_by_group(spark: SparkSession, d: str) -> DataFrame:
    """W6"""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, 3, [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_custkey"]).withColumn("rank", F.col("rank").cast("bigint"))


def top_k_overall(spark: SparkSession, d: str) -> DataFrame:
    """W6"""
    return top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events with gaps under 30 minutes."""
    s = sessionize(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 1800, ["event_id"])
    return s.groupBy("user_id", F.col("session").cast("bigint").alias("session")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    """S1"""
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


def except_set(spark: SparkSession, d: str) -> DataFrame:
    """S1"""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, d, "lineitem").select("l_orderkey"))


def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    """S1"""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


_FNS = (ranking, analytic, rows_frame, range_frame, above_average, top_k_by_group, top_k_overall, sessions, union_distinct, except_set, intersect_all)
QUERIES = {f.__name__: f for f in _FNS}
ORACLE_SQL = {
    "ranking": """
        SELECT c_custkey, row_number() OVER w AS row_number, rank() OVER t AS rank, dense_rank() OVER t AS dense_rank, ntile(4) OVER w AS quarter,
               percent_rank() OVER t AS percent_rank, cume_dist() OVER t AS cume_dist
        FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), t AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)""",
    "analytic": """
        SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS second_after,
               first_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first,
               nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "rows_frame": """
        SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) AS moving, count(*) OVER w AS n
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
    "above_average": """
        WITH s AS (SELECT s_suppkey, s_nationkey, CAST(round(CAST(s_acctbal AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents FROM supplier)
        SELECT s_suppkey, s_nationkey, cents FROM s QUALIFY cents * count(*) OVER (PARTITION BY s_nationkey) > sum(cents) OVER (PARTITION BY s_nationkey)""",
    "top_k_by_group": """
        SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders QUALIFY rank <= 3""",
    "top_k_overall": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sessions": """
        WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS new
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, ts, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)
        SELECT user_id, session, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM s GROUP BY 1, 2""",
    "union_distinct": "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer",
    "except_set": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
}
