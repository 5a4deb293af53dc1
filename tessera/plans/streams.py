"""Structured Streaming over the events, each drained into a table.

In append mode a window is emitted once the watermark, an hour behind the latest
event, has passed its end; the oracles leave out the windows still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.funnels import STORE, funnels
from tessera.streaming.runner import drain, drain_arrivals, events
from tessera.streaming.sessions import closed_sessions
from tessera.tables import table

_LATE = "1 hour"


def _span(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.col("w.start").cast("timestamp_ntz"), "end": F.col("w.end").cast("timestamp_ntz")}).drop("w")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """E1"""
    e = events(spark, d).withWatermark("ts", _LATE)
    return _span(drain(e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("total"))))


def stream_tumbling_complete(spark: SparkSession, d: str) -> DataFrame:
    """E1 in complete mode: open windows too."""
    return _span(drain(events(spark, d).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")), "complete"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """E2"""
    e = events(spark, d).withWatermark("ts", _LATE)
    return _span(drain(e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """E3"""
    e = events(spark, d).withWatermark("ts", _LATE)
    return _span(drain(e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))))


def stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the user's views up to half an hour before."""
    e = events(spark, d)
    v = e.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("view_id"), F.col("ts").alias("viewed")).withWatermark("viewed", _LATE)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought")).withWatermark("bought", _LATE)
    return drain(p.join(v, F.expr("user_id = viewer AND viewed <= bought AND viewed >= bought - INTERVAL 30 MINUTES")).select("user_id", "purchase_id", "view_id"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """E5: a user's event types, each once."""
    e = events(spark, d).select("user_id", "event_type", "ts").withWatermark("ts", "3650 days")
    return drain(e.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


def stream_dedup_hourly(spark: SparkSession, d: str) -> DataFrame:
    """E5: a user's event types, each once an hour; what the watermark has passed leaves the state."""
    e = events(spark, d).withWatermark("ts", _LATE).select("user_id", "event_type", F.window("ts", "1 hour").alias("w"))
    return _span(drain(e.dropDuplicates(["user_id", "event_type", "w"]))).drop("end")


def _add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, most = state.get if state.exists else (0, 0)
    for b in batches:
        n, most = n + len(b), max(most, int(b["event_id"].max()))
    state.update((n, most))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_event": [most]})


def stream_state(spark: SparkSession, d: str) -> DataFrame:
    """A state of its own per user; of its updates the last counts."""
    s = events(spark, d).select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(_add, "user_id long, n long, last_event long", "n long, most long", "update", GroupStateTimeout.NoTimeout)
    return drain(s, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("last_event").alias("last_event"))


def stream_timers(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as a state of its own, which timers close and evict."""
    e = events(spark, d).withWatermark("ts", _LATE)
    return drain(closed_sessions(e, "user_id", "ts", 1800)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of events that arrive in four portions and out of order.

    Of seven events one is six hours late and one half an hour; the watermark drops
    those whose hour it has passed.
    """
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) + CASE event_id % 7 WHEN 0 THEN 21600000000 WHEN 1 THEN 1800000000 ELSE 0 END").alias("at"))
    portions = _portions(e, "at")
    hourly = drain_arrivals(portions, lambda s: s.withWatermark("ts", _LATE).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")))
    return _span(hourly).drop("end")


def _portions(rows: DataFrame, time: str, n: int = 4) -> list[DataFrame]:
    """``rows`` in ``n`` portions of equal spans of ``time``; an empty table is one empty portion."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    cuts = [] if low is None else [low + (high - low) * i // n for i in range(1, n)]
    inside = lambda a, b: (F.lit(a is None) | (F.col(time) >= F.lit(a))) & (F.lit(b is None) | (F.col(time) < F.lit(b)))
    return [rows.where(inside(a, b)).drop(time) for a, b in pairwise([None, *cuts, None])]


def _clicks(spark: SparkSession, d: str, *kinds: str) -> list[DataFrame]:
    """Clicks of these kinds in the order in which they arrived, in four portions: late, repeated and out of order as they are."""
    c = table(spark, d, "clicks").where(F.col("kind").isin(*kinds) & F.col("client_id").isNotNull() & F.col("click_id").isNotNull() & F.col("arrived_at").isNotNull() & F.col("ts").isNotNull())
    return _portions(c.select("click_id", "client_id", "kind", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("at")), "at")


def stream_funnel(spark: SparkSession, d: str) -> DataFrame:
    """A view, a click and a purchase of a client, each within half an hour of the one before, over late arrivals.

    States of values, lists and maps (``transformWithStateInPandas``), put in order by timers and evicted by them.
    """
    within, keep = 1800, 400 * 86_400
    run = lambda s: funnels(s.withWatermark("ts", _LATE), "client_id", "ts", "click_id", "kind", ["view", "click", "purchase"], within, keep)
    found = drain_arrivals(_clicks(spark, d, "view", "click", "purchase"), run, STORE)
    names = ("view_id", "click_id", "purchase_id")
    took = (F.unix_micros(F.element_at("times", -1)) - F.unix_micros(F.element_at("times", 1))).alias("took_us")
    return found.select("client_id", "nth", *[F.col("ids")[i].alias(n) for i, n in enumerate(names)], took)


def stream_outer_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the client's views up to half an hour before; one without comes out when the watermark has passed it."""

    def run(s: DataFrame) -> DataFrame:
        # A view is in the half hour of its time and in the next, a purchase in its own: a client's rows of all times would meet each other.
        slot = lambda c: F.floor(F.unix_seconds(c) / 1800)
        v = s.where("kind = 'view'").select(F.col("client_id").alias("viewer"), F.col("click_id").alias("view_id"), F.col("ts").alias("viewed")).withWatermark("viewed", _LATE)
        v = v.withColumn("view_slot", F.explode(F.array(slot("viewed"), slot("viewed") + 1)))
        p = s.where("kind = 'purchase'").select("client_id", F.col("click_id").alias("purchase_id"), F.col("ts").alias("bought")).withWatermark("bought", _LATE).withColumn("slot", slot("bought"))
        return p.join(v, F.expr("client_id = viewer AND slot = view_slot AND viewed <= bought AND viewed >= bought - INTERVAL 30 MINUTES"), "left_outer").select("client_id", "purchase_id", "view_id")

    return drain_arrivals(_clicks(spark, d, "view", "purchase"), run).distinct()


def stream_dedup_late(spark: SparkSession, d: str) -> DataFrame:
    """E5: each click once, though it comes again; what is over an hour behind is late, and its state gone."""
    kinds = ("view", "click", "purchase", "signup", "error")
    kept = drain_arrivals(_clicks(spark, d, *kinds), lambda s: s.withWatermark("ts", _LATE).dropDuplicatesWithinWatermark(["click_id"]))
    return kept.select("click_id", "client_id", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"))


_FNS = (stream_tumbling, stream_tumbling_complete, stream_sliding, stream_sessions, stream_interval_join, stream_dedup, stream_dedup_hourly, stream_state, stream_timers, stream_late, stream_funnel, stream_outer_join, stream_dedup_late)
QUERIES = {f.__name__: f for f in _FNS}
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _accepted(kinds: str, mark: str) -> str:
    """Clicks that aren't late: those behind the watermark that the portions before theirs have left are."""
    return f"""
        a AS (SELECT click_id, client_id, kind, ts, epoch_us(ts) AS us, epoch_us(arrived_at) AS arrived FROM clicks
              WHERE kind IN ({kinds}) AND client_id IS NOT NULL AND click_id IS NOT NULL AND arrived_at IS NOT NULL AND ts IS NOT NULL),
        s AS (SELECT min(arrived) AS low, max(arrived) - min(arrived) AS span FROM a),
        p AS (SELECT a.*, CASE WHEN arrived < low + span // 4 THEN 0 WHEN arrived < low + span * 2 // 4 THEN 1 WHEN arrived < low + span * 3 // 4 THEN 2 ELSE 3 END AS portion FROM a, s),
        g AS (SELECT portion, {mark} AS top FROM p GROUP BY portion),
        m AS (SELECT portion, max(top) OVER (ORDER BY portion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 3600000 AS mark FROM g),
        f AS (SELECT max(top) // 1000 - 3600000 AS final FROM g),
        ok AS (SELECT DISTINCT click_id, client_id, kind, ts, us FROM p JOIN m USING (portion) WHERE us IS NOT NULL AND (mark IS NULL OR us > mark * 1000))"""


ORACLE_SQL = {
    "stream_funnel": f"""
        WITH {_accepted("'view', 'click', 'purchase'", "max(us)")},
        n AS (SELECT ok.*, row_number() OVER (PARTITION BY client_id ORDER BY us, click_id, kind = 'purchase', kind = 'click') AS r FROM ok, f WHERE us < final * 1000),
        w AS (SELECT *, max(CASE WHEN kind = 'view' THEN r END) OVER w AS lv, max(CASE WHEN kind = 'click' THEN r END) OVER w AS lc, max(CASE WHEN kind = 'purchase' THEN r END) OVER w AS lp
              FROM n WINDOW w AS (PARTITION BY client_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT b.client_id, row_number() OVER (PARTITION BY b.client_id ORDER BY b.r) AS nth, v.click_id AS view_id, c.click_id AS click_id, b.click_id AS purchase_id, b.us - v.us AS took_us
        FROM w b JOIN w c ON c.client_id = b.client_id AND c.r = b.lc JOIN w v ON v.client_id = c.client_id AND v.r = c.lv
        WHERE b.kind = 'purchase' AND coalesce(b.lp, 0) < b.lc AND b.us - c.us <= 1800000000 AND c.us - v.us <= 1800000000""",
    "stream_outer_join": f"""
        WITH {_accepted("'view', 'purchase'", "least(max(max(us) FILTER (kind = 'view')) OVER (ORDER BY portion), max(max(us) FILTER (kind = 'purchase')) OVER (ORDER BY portion))")},
        b AS (SELECT DISTINCT client_id, click_id, us FROM ok WHERE kind = 'purchase'),
        v AS (SELECT DISTINCT client_id, click_id, us FROM ok WHERE kind = 'view')
        SELECT b.client_id, b.click_id AS purchase_id, v.click_id AS view_id
        FROM b JOIN v ON v.client_id = b.client_id AND v.us <= b.us AND v.us >= b.us - 1800000000
        UNION SELECT b.client_id, b.click_id, NULL FROM b, f
        WHERE b.us < final * 1000 AND NOT EXISTS (SELECT 1 FROM v WHERE v.client_id = b.client_id AND v.us <= b.us AND v.us >= b.us - 1800000000)""",
    "stream_dedup_late": f"""
        WITH {_accepted("'view', 'click', 'purchase', 'signup', 'error'", "max(us)")} SELECT click_id, client_id, kind, ts FROM ok""",
    "stream_tumbling": f"""
        SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS n,
               CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total
        FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK}""",
    "stream_tumbling_complete": """
        SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM events GROUP BY 1, 2""",
    "stream_sliding": f"""
        WITH w AS (SELECT date_trunc('hour', ts) - unnest([INTERVAL 0 HOUR, INTERVAL 1 HOUR]) AS start FROM events)
        SELECT start, start + INTERVAL 2 HOUR AS "end", count(*) AS n FROM w GROUP BY 1 HAVING start + INTERVAL 2 HOUR <= {_MARK}""",
    "stream_sessions": f"""
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
        HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}""",
    "stream_timers": f"""
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k
        HAVING epoch_ms(max(ts) + INTERVAL 30 MINUTE) < epoch_ms({_MARK})""",
    "stream_interval_join": """
        SELECT p.user_id, p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v
        ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 30 MINUTE
        WHERE p.event_type = 'purchase' AND v.event_type = 'view'""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_dedup_hourly": "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS start FROM events",
    "stream_late": f"""
        WITH a AS (SELECT ts, epoch_us(ts) + CASE event_id % 7 WHEN 0 THEN 21600000000 WHEN 1 THEN 1800000000 ELSE 0 END AS arrived FROM events),
        s AS (SELECT min(arrived) AS low, max(arrived) - min(arrived) AS span FROM a),
        p AS (SELECT ts, CASE WHEN arrived < low + span // 4 THEN 0 WHEN arrived < low + span * 2 // 4 THEN 1 WHEN arrived < low + span * 3 // 4 THEN 2 ELSE 3 END AS portion FROM a, s),
        m AS (SELECT portion, max(max(ts)) OVER (ORDER BY portion ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM p GROUP BY portion)
        SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM p JOIN m USING (portion)
        WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark
        GROUP BY 1 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK}""",
    "stream_state": "SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1",
}
