"""Queries with user-defined functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.user import batches_of, halves, kind_counts, running_balance, spread, vowel_count
from tessera.tables import table


def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", vowel_count()(F.col("p_name")).alias("vowels"))


def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(spread()(F.col("value")).alias("spread"))


def udf_grouped_map(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value").cast("decimal(12,2)") * F.when(F.col("event_type") == "purchase", -100).otherwise(100)).cast("long").alias("cents"))
    return e.groupBy("user_id").applyInPandas(running_balance(), "user_id long, event_id long, balance long")


def udf_map_batches(spark: SparkSession, d: str) -> DataFrame:
    wide = batches_of(lambda f: f.assign(wide=f["p_name"].str.len() * f["p_size"].astype("int64"))[["p_partkey", "wide"]])
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size").mapInPandas(wide, "p_partkey long, wide long")


def udf_table(spark: SparkSession, d: str) -> DataFrame:
    spark.udtf.register("halves", halves())
    return spark.sql("SELECT p_partkey, place, half FROM {names}, LATERAL halves(p_name)", names=table(spark, d, "part").select("p_partkey", "p_name"))


def udf_partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    """U5 over a partitioned table, with columns by its arguments: a client's clicks of some kinds."""
    spark.udtf.register("kind_counts", kind_counts())
    clicks = table(spark, d, "clicks").select("client_id", "kind")
    return spark.sql("SELECT * FROM kind_counts(TABLE(SELECT client_id, kind FROM {clicks}) PARTITION BY (client_id), 'view, purchase, error')", clicks=clicks)


QUERIES = {f.__name__: f for f in (udf_scalar, udf_aggregate, udf_grouped_map, udf_map_batches, udf_table, udf_partitioned_table)}
ORACLE_SQL = {
    "udf_partitioned_table": """
        SELECT client_id, count(*) FILTER (kind = 'view') AS n_view, count(*) FILTER (kind = 'purchase') AS n_purchase, count(*) FILTER (kind = 'error') AS n_error
        FROM clicks GROUP BY client_id""",
    "udf_scalar": "SELECT p_partkey, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS vowels FROM part",
    "udf_aggregate": "SELECT user_id, max(value) - min(value) AS spread FROM events GROUP BY 1",
    "udf_grouped_map": """
        WITH c AS (SELECT user_id, event_id, CAST(round(CAST(value AS DECIMAL(12,2)) * CASE WHEN event_type = 'purchase' THEN -100 ELSE 100 END) AS BIGINT) AS cents FROM events),
        s AS (SELECT user_id, event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM c)
        SELECT user_id, event_id, CAST(total - least(0, min(total) OVER (PARTITION BY user_id ORDER BY event_id)) AS BIGINT) AS balance FROM s""",
    "udf_map_batches": "SELECT p_partkey, CAST(length(p_name) * p_size AS BIGINT) AS wide FROM part",
    "udf_table": """
        SELECT p_partkey, CAST(0 AS INTEGER) AS place, left(p_name, length(p_name) // 2) AS half FROM part
        UNION ALL SELECT p_partkey, 1, substring(p_name, length(p_name) // 2 + 1) FROM part""",
}
