"""Scans, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.asof import asof_join
from tessera.operators.contains import substring_join
from tessera.operators.ranges import interval_join, overlap_join
from tessera.tables import table, tables


def scan_filter_project(spark: SparkSession, d: str) -> DataFrame:
    """J1"""
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1996-01-01' AND l_quantity < 10").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """J2"""
    items = table(spark, d, "lineitem").select("l_orderkey")
    return table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderdate")


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """J2"""
    items = table(spark, d, "lineitem").select("l_orderkey")
    return table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")


def full_join(spark: SparkSession, d: str) -> DataFrame:
    """suppliers' and customers' counts by nation."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("debtors"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), F.coalesce("suppliers", F.lit(0)).cast("bigint").alias("suppliers"), F.coalesce("debtors", F.lit(0)).cast("bigint").alias("debtors"))


def star_join(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by region and year over five tables; the optimizer orders the joins."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue"))
    return (
        items.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", F.year("o_orderdate").cast("bigint").alias("year"))
        .agg(F.sum("revenue").cast("double").alias("revenue"))
    )


def time_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a user's events, the second at most an hour later; joined on user and hour, then compared."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = e.select("user_id", F.col("event_id").alias("first_id"), F.col("us").alias("from_us"))
    second = e.select("user_id", F.col("event_id").alias("second_id"), F.col("us").alias("second_us"))
    hour = 3_600_000_000
    found = interval_join(second, first, F.col("second_us"), F.col("from_us") + 1, F.col("from_us") + hour + 1, hour, ["user_id"])
    return found.select("user_id", "first_id", "second_id")


def bucketed_range_join(spark: SparkSession, d: str) -> DataFrame:
    """J4 without an equal key: parts whose price lies in the tenth above a smaller part's size class."""
    parts = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("bigint").alias("cents"))
    classes = table(spark, d, "part").groupBy("p_brand").agg(F.min(F.round(F.col("p_retailprice").cast("decimal(12,2)") * 100).cast("bigint")).alias("low"))
    found = interval_join(parts, classes, F.col("cents"), F.col("low"), F.col("low") + 500, 500)
    return found.groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("cents").cast("bigint").alias("cents"))


def history_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """J4 over two tables of intervals: what two sources said of a client at one time; a saying holds until the source's next one."""
    c = table(spark, d, "client_changes").where("client_id IS NOT NULL AND valid_at IS NOT NULL").select("client_id", "source", F.unix_micros(F.col("valid_at").cast("timestamp")).alias("at")).distinct()
    spans = c.withColumn("until", F.lead("at").over(W.partitionBy("client_id", "source").orderBy("at"))).where("until IS NOT NULL")
    crm, web = (spans.where(F.col("source") == s).select("client_id", F.col("at").alias(f"{s}_from"), F.col("until").alias(f"{s}_to")) for s in ("crm", "web"))
    day = 86_400_000_000
    return overlap_join(crm, web, (F.col("crm_from"), F.col("crm_to")), (F.col("web_from"), F.col("web_to")), day, ["client_id"])


def asof_previous(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's latest view before it."""
    e = table(spark, d, "events")
    kinds = e.select("event_id", "user_id", "ts", "event_type")
    buys = kinds.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views_ = kinds.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_ts"), F.col("event_id").alias("seen_id"))
    return asof_join(buys, views_, ["user_id"], "ts", "seen_ts", ["seen_id"]).select("event_id", "user_id", "seen_id")


def subqueries(spark: SparkSession, d: str) -> DataFrame:
    """A correlated scalar, EXISTS and LATERAL in one statement."""
    return spark.sql("""
        SELECT c.c_custkey, n.n_name, last.latest,
               (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n_orders
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey,
             LATERAL (SELECT max(o_orderdate) AS latest FROM {orders} o WHERE o.o_custkey = c.c_custkey) last
        WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
    """, **tables(spark, d, "orders", "customer", "nation"))


def contained_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name contains a type's name."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    types = table(spark, d, "part").select(F.lower("p_type").alias("kind")).distinct()
    return substring_join(parts, types, F.lower("p_name"), F.col("kind"), ["p_partkey"])


def contained_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the benchmark passages that they contain."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return substring_join(documents, items, F.col("text"), F.col("passage"), ["doc_id"]).select("doc_id", "item_id")


def recursive_cte(spark: SparkSession, d: str) -> DataFrame:
    """Nations by steps through keys that follow each other within a region."""
    return spark.sql("""
        WITH RECURSIVE walk(n_nationkey, n_regionkey, step) AS (
            SELECT n_nationkey, n_regionkey, 0 FROM {nation} WHERE n_nationkey < 5
            UNION ALL
            SELECT n.n_nationkey, n.n_regionkey, w.step + 1
            FROM walk w JOIN {nation} n ON n.n_regionkey = w.n_regionkey AND n.n_nationkey = w.n_nationkey + 5)
        SELECT n_nationkey, n_regionkey, step FROM walk
    """, **tables(spark, d, "nation"))


QUERIES = {f.__name__: f for f in (scan_filter_project, semi_join, anti_join, full_join, star_join, time_range_join, bucketed_range_join, history_overlaps, asof_previous, subqueries, contained_names, contained_passages, recursive_cte)}
ORACLE_SQL = {
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity < 10",
    "semi_join": "SELECT o_orderkey, o_orderdate FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey",
    "anti_join": "SELECT o_orderkey, o_orderdate FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "full_join": """
        SELECT coalesce(s_nationkey, c_nationkey) AS nation, CAST(coalesce(suppliers, 0) AS BIGINT) AS suppliers, CAST(coalesce(debtors, 0) AS BIGINT) AS debtors
        FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
        FULL JOIN (SELECT c_nationkey, count(*) AS debtors FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON s_nationkey = c_nationkey""",
    "star_join": """
        SELECT r_name, CAST(year(o_orderdate) AS BIGINT) AS year,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "time_range_join": """
        SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b
        ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""",
    "bucketed_range_join": """
        WITH p AS (SELECT p_brand, CAST(round(CAST(p_retailprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents FROM part),
        c AS (SELECT p_brand, min(cents) AS low FROM p GROUP BY 1)
        SELECT c.p_brand, count(*) AS parts, CAST(sum(cents) AS BIGINT) AS cents FROM p JOIN c ON cents >= low AND cents < low + 500 GROUP BY 1""",
    "history_overlaps": """
        WITH c AS (SELECT DISTINCT client_id, source, epoch_us(valid_at) AS us FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL),
        s AS (SELECT *, lead(us) OVER (PARTITION BY client_id, source ORDER BY us) AS until FROM c)
        SELECT a.client_id, a.us AS crm_from, a.until AS crm_to, b.us AS web_from, b.until AS web_to
        FROM s a JOIN s b ON a.client_id = b.client_id AND a.us < b.until AND b.us < a.until
        WHERE a.source = 'crm' AND b.source = 'web' AND a.until IS NOT NULL AND b.until IS NOT NULL""",
    "asof_previous": """
        SELECT b.event_id, b.user_id, v.event_id AS seen_id
        FROM (SELECT * FROM events WHERE event_type = 'purchase') b
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts > v.ts""",
    "subqueries": """
        SELECT c.c_custkey, n.n_name, last.latest, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders
        FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey,
             LATERAL (SELECT max(o_orderdate) AS latest FROM orders o WHERE o.o_custkey = c.c_custkey) last
        WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
    "contained_names": """
        SELECT p_partkey, kind FROM part JOIN (SELECT DISTINCT lower(p_type) AS kind FROM part) ON contains(lower(p_name), kind)""",
    "contained_passages": "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)",
    "recursive_cte": """
        WITH RECURSIVE walk(n_nationkey, n_regionkey, step) AS (
            SELECT n_nationkey, n_regionkey, 0 FROM nation WHERE n_nationkey < 5
            UNION ALL
            SELECT n.n_nationkey, n.n_regionkey, w.step + 1
            FROM walk w JOIN nation n ON n.n_regionkey = w.n_regionkey AND n.n_nationkey = w.n_nationkey + 5)
        SELECT n_nationkey, n_regionkey, step FROM walk""",
}
