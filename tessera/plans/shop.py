"""Sketches, quantiles, orders and graphs over the shop's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordered import ranks, running_totals
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.reach import reachable_through
from tessera.operators.written import written
from tessera.tables import table


def merged_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of each day's clicks, stored, and merged by kind without reading a click again.

    Whether each is within its stated bound of the exact figure: clients by HLL (2 ** 12
    registers, 3 standard errors of 1.04 / 64) and by theta (2 ** 12 entries, 3 of 1 / 64), and
    the median's rank by KLL (k = 200, 1.65 %; 3 % are allowed).
    """
    c = table(spark, d, "clicks").where("kind IS NOT NULL AND client_id IS NOT NULL AND value IS NOT NULL")
    daily = c.groupBy("kind", F.date_trunc("day", "ts").alias("day")).agg(F.hll_sketch_agg("client_id", 12).alias("hll"), F.theta_sketch_agg("client_id", 12).alias("theta"), F.kll_sketch_agg_double("value", 200).alias("kll"))
    merged = written(daily, "sketches").groupBy("kind").agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("hll"), F.theta_sketch_estimate(F.theta_union_agg("theta")).alias("theta"), F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("kll"), F.lit(0.5)).alias("median"))
    exact = c.join(F.broadcast(merged.select("kind", "median")), "kind").groupBy("kind").agg(F.countDistinct("client_id").alias("clients"), F.count(F.lit(1)).alias("clicks"), F.count_if(F.col("value") < F.col("median")).alias("under"), F.count_if(F.col("value") <= F.col("median")).alias("upto"))
    near = lambda about, share: F.abs(F.col(about) - F.col("clients")) <= F.lit(3 * share) * F.col("clients")
    ranked = (F.col("under") <= 0.53 * F.col("clicks")) & (F.col("upto") >= 0.47 * F.col("clicks"))
    return exact.join(merged, "kind").select("kind", "clicks", "clients", near("hll", 1.04 / 64).alias("hll_near"), near("theta", 1 / 64).alias("theta_near"), ranked.alias("median_near"))


def quantiles_by_flag(spark: SparkSession, d: str) -> DataFrame:
    """A5 by groups of which one holds three quarters of the rows."""
    found = exact_quantiles(table(spark, d, "sale_lines"), ["flag"], F.col("amount"), (0.0, 0.1, 0.5, 0.99, 1.0))
    return found.select("flag", "fraction", F.round("quantile", 6).alias("quantile"))


def quantiles_of_all(spark: SparkSession, d: str) -> DataFrame:
    """A5 over the whole table as one group."""
    found = exact_quantiles(table(spark, d, "sale_lines"), [], F.col("amount"), (0.25, 0.5, 0.9))
    return found.select("fraction", F.round("quantile", 6).alias("quantile"))


def _sales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sales").where("total IS NOT NULL").select("sale_id", F.round(F.col("total").cast("decimal(12,2)") * 100).cast("bigint").alias("cents"))


def global_ranks(spark: SparkSession, d: str) -> DataFrame:
    """W1 over a whole table: each sale's rank by its total."""
    return ranks(_sales(spark, d), "cents", "sale_id").select("sale_id", "cents", "rank")


def global_running_sum(spark: SparkSession, d: str) -> DataFrame:
    """W3 over a whole table: sales in the order of their totals, numbered and summed up."""
    return running_totals(_sales(spark, d), ["cents", "sale_id"], {"so_far": "cents"})


def item_steps(spark: SparkSession, d: str) -> DataFrame:
    """J8 on data of any size: how many steps each item is from item 0, where one line of a sale leads to the next."""
    x = table(spark, d, "sale_lines").where("sale_id IS NOT NULL AND line_no IS NOT NULL").select("sale_id", "line_no", "item_id")
    # A sale and a line's number are a gate: lines of one number may be very many in a sale.
    gate = lambda line: F.struct("sale_id", line.cast("long").alias("line_no")).alias("gate")
    enters = x.select(F.col("item_id").alias("source"), gate(F.col("line_no").cast("long") + 1))
    leaves = x.select(gate(F.col("line_no")), F.col("item_id").alias("target"))
    return reachable_through(spark.range(1).select(F.col("id").alias("node")), enters, leaves).select(F.col("node").alias("item_id"), "step")


QUERIES = {f.__name__: f for f in (merged_sketches, quantiles_by_flag, quantiles_of_all, global_ranks, global_running_sum, item_steps)}
_CENTS = "(SELECT sale_id, CAST(round(CAST(total AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents FROM sales WHERE total IS NOT NULL)"
ORACLE_SQL = {
    "merged_sketches": """
        SELECT kind, count(*) AS clicks, count(DISTINCT client_id) AS clients, true AS hll_near, true AS theta_near, true AS median_near
        FROM clicks WHERE kind IS NOT NULL AND client_id IS NOT NULL AND value IS NOT NULL GROUP BY 1""",
    "quantiles_by_flag": """
        SELECT flag, f AS fraction, round(CASE f WHEN 0 THEN quantile_cont(amount, 0) WHEN 0.1 THEN quantile_cont(amount, 0.1) WHEN 0.5 THEN quantile_cont(amount, 0.5)
               WHEN 0.99 THEN quantile_cont(amount, 0.99) ELSE quantile_cont(amount, 1) END, 6) AS quantile
        FROM sale_lines, (SELECT unnest([CAST(0 AS DOUBLE), 0.1, 0.5, 0.99, 1]) AS f) GROUP BY flag, f""",
    "quantiles_of_all": """
        SELECT f AS fraction, round(CASE f WHEN 0.25 THEN quantile_cont(amount, 0.25) WHEN 0.5 THEN quantile_cont(amount, 0.5) ELSE quantile_cont(amount, 0.9) END, 6) AS quantile
        FROM sale_lines, (SELECT unnest([CAST(0.25 AS DOUBLE), 0.5, 0.9]) AS f) GROUP BY f""",
    "global_ranks": f"SELECT sale_id, cents, rank() OVER (ORDER BY cents) AS rank FROM {_CENTS}",
    "global_running_sum": f"""
        SELECT sale_id, cents, row_number() OVER w AS position, CAST(sum(cents) OVER w AS BIGINT) AS so_far FROM {_CENTS}
        WINDOW w AS (ORDER BY cents, sale_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "item_steps": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT a.item_id AS source, b.item_id AS target FROM sale_lines a JOIN sale_lines b ON b.sale_id = a.sale_id AND b.line_no = a.line_no + 1
            WHERE a.item_id IS NOT NULL AND b.item_id IS NOT NULL),
        walk(item_id, step) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS INTEGER) UNION SELECT target, CAST(step + 1 AS INTEGER) FROM walk JOIN e ON source = item_id WHERE step < 25)
        SELECT item_id, min(step) AS step FROM walk GROUP BY 1""",
}
