"""F7 over times that come as text: the instants of the shop's stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.tables import table


def stamp_instants(spark: SparkSession, d: str) -> DataFrame:
    """Each stamp's form and instant in UTC; whether the clock showed its local time twice (then the first counts) or never.

    A slashed time of which day and month may change places is read as most of its source's decided ones;
    in a source without a majority it has no instant, nor have texts without a form or a date.
    """
    s = table(spark, d, "stamps").select("stamp_id", "source", "zone", "raw", times.form(F.col("raw")).alias("form"))
    s = s.withColumn("order", times.slashed_order(F.col("raw"), F.col("form")))
    votes = s.where("form = 'slashed'").groupBy(F.col("source").alias("of")).agg(F.sum(F.when(F.col("order"), 1).when(~F.col("order"), -1).otherwise(0)).alias("votes"))
    most = F.when(F.col("votes") > 0, True).when(F.col("votes") < 0, False)
    read = s.join(votes, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("day_first", F.coalesce("order", most))
    local = read.withColumn("local", times.parts_of(F.col("raw"), F.col("form"), F.col("day_first")))
    by_zone = F.when(F.col("form") != "offset", times.local_instants(F.col("local"), F.col("zone")))
    found = local.select("stamp_id", "form", times.stated_instant(F.col("raw"), F.col("form"), F.col("local")).alias("stated"), by_zone.alias("at"))
    return found.select("stamp_id", "form", F.coalesce("stated", "at.first").alias("at_utc"), F.coalesce(F.col("at.first") != F.col("at.last"), F.lit(False)).alias("twice"), F.coalesce("at.skipped", F.lit(False)).alias("never"))


QUERIES = {"stamp_instants": stamp_instants}
_FORM = " ".join(f"WHEN regexp_matches(r, '{p}') THEN '{n}'" for n, p in times.FORMS.items())
ORACLE_SQL = {
    "stamp_instants": f"""
        WITH t AS (SELECT stamp_id, source, zone, trim(raw) AS r, CASE WHEN r IS NULL THEN NULL {_FORM} END AS form FROM stamps),
        o AS (SELECT *, CASE WHEN form = 'slashed' THEN CAST(r[1:2] AS INTEGER) END AS a, CASE WHEN form = 'slashed' THEN CAST(r[4:5] AS INTEGER) END AS b FROM t),
        v AS (SELECT *, CASE WHEN a > 12 AND b <= 12 THEN 1 WHEN a <= 12 AND b > 12 THEN -1 ELSE 0 END AS vote FROM o),
        w AS (SELECT *, CASE WHEN vote <> 0 THEN vote ELSE sum(vote) OVER (PARTITION BY source) END AS day_first FROM v),
        l AS (
            SELECT stamp_id, zone, form,
                   CASE form WHEN 'iso' THEN try_strptime(r, '%Y-%m-%d %H:%M:%S') WHEN 'dotted' THEN try_strptime(r, '%d.%m.%Y %H:%M:%S')
                             WHEN 'named' THEN try_strptime(r, '%d %b %Y %H:%M') WHEN 'half_day' THEN try_strptime(r, '%m/%d/%Y %I:%M %p') WHEN 'compact' THEN try_strptime(r, '%Y%m%d')
                             WHEN 'slashed' THEN CASE WHEN day_first > 0 THEN try_strptime(r, '%d/%m/%Y %H:%M') WHEN day_first < 0 THEN try_strptime(r, '%m/%d/%Y %H:%M') END END AS local,
                   CASE form WHEN 'seconds' THEN TIMESTAMP '1970-01-01' + to_seconds(CAST(r AS BIGINT)) WHEN 'millis' THEN TIMESTAMP '1970-01-01' + to_milliseconds(CAST(r AS BIGINT))
                             WHEN 'offset' THEN try_strptime(r[1:19], '%Y-%m-%dT%H:%M:%S') - CASE WHEN r LIKE '%Z' THEN INTERVAL 0 MINUTE ELSE
                                 to_minutes((CAST(r[21:22] AS INTEGER) * 60 + CAST(right(r, 2) AS INTEGER)) * CASE WHEN r[20] = '-' THEN -1 ELSE 1 END) END END AS stated
            FROM w),
        u AS (SELECT *, timezone('UTC', timezone(zone, local)) AS u FROM l),
        e AS (SELECT *, timezone(zone, timezone('UTC', u)) AS back, u - INTERVAL 1 HOUR AS sooner, timezone(zone, timezone('UTC', u - INTERVAL 1 HOUR)) = local AS same FROM u)
        SELECT stamp_id, form, coalesce(stated, CASE WHEN same THEN sooner ELSE u END) AS at_utc, coalesce(same, false) AS twice, coalesce(back <> local, false) AS never FROM e
    """,
}
