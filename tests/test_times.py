"""Times as text, and local times as instants, against the zoneinfo module."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.plans.times import stamp_instants

UTC = dt.timezone.utc


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_local_instants(spark, session_zone):
    """Every half hour around changes of offset, in zones of several rules, whatever the session's zone."""
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Chatham"]
    days = [dt.datetime(2024, m, d) for m, d in ((3, 10), (3, 31), (4, 7), (9, 29), (10, 6), (10, 27), (11, 3), (7, 1))]
    rows = [(z, d + dt.timedelta(minutes=15 * k)) for z in zones for d in days for k in range(24)]
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        df = spark.createDataFrame([(z, t.isoformat(" ")) for z, t in rows], "z string, t string").withColumn("local", F.col("t").cast("timestamp_ntz"))
        got = df.select("z", "local", times.local_instants(F.col("local"), F.col("z")).alias("at")).select("z", "local", "at.*").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert len(got) == len(rows)
    folds = gaps = 0
    for r in got:
        zone = ZoneInfo(r["z"])
        two = [r["local"].replace(tzinfo=zone, fold=f).astimezone(UTC) for f in (0, 1)]
        real = [u for u in two if u.astimezone(zone).replace(tzinfo=None) == r["local"]]
        assert r["skipped"] == (not real), r
        want = (min(real), max(real)) if real else (two[0], two[0])
        assert (r["first"].replace(tzinfo=UTC), r["last"].replace(tzinfo=UTC)) == want, r
        folds, gaps = folds + (len(set(real)) == 2), gaps + (not real)
    assert folds and gaps


FORMS = [
    ("2024-02-09T02:07:34+05:30", "offset", "2024-02-08 20:37:34"), ("2024-07-31T11:07:52-0800", "offset", "2024-07-31 19:07:52"), (" 2024-09-06T16:32:23Z ", "offset", "2024-09-06 16:32:23"),
    ("2024-10-16 05:45:30", "iso", "2024-10-16 03:45:30"), ("26.01.2024 17:55:06", "dotted", "2024-01-26 16:55:06"), ("05 Nov 2024 02:48", "named", "2024-11-05 01:48:00"), ("05 Now 2024 02:48", "named", None),
    ("04/26/2024 12:42 PM", "half_day", "2024-04-26 10:42:00"), ("04/26/2024 12:05 AM", "half_day", "2024-04-25 22:05:00"), ("04/26/2024 13:05 AM", "half_day", None), ("20240502", "compact", "2024-05-01 22:00:00"),
    ("1733025832", "seconds", "2024-12-01 04:03:52"), ("1733942329007", "millis", "2024-12-11 18:38:49.007000"), ("30.02.2024 10:00:00", "dotted", None), ("2024-01-01 10:00:60", "iso", None), ("2024-01-01 24:00:00", "iso", None),
    ("2024-03", None, None), ("", None, None), ("n/a", None, None), (None, None, None), ("x" * 100_000, None, None), ("٢٠٢٤٠٥٠٢", None, None),
]


def _stamps(spark, folder, rows):
    schema = "stamp_id long, source string, zone string, raw string, of string, votes int, local int"
    spark.createDataFrame([(i, s, "Europe/Berlin", raw, "x", 1, 2) for i, (s, raw) in enumerate(rows)], schema).write.parquet(f"{folder}/stamps.parquet")
    return [r for r in sorted(stamp_instants(spark, str(folder)).collect(), key=lambda r: r["stamp_id"])]


def test_forms(spark, tmp_path):
    got = _stamps(spark, tmp_path, [("s", raw) for raw, _, _ in FORMS])
    assert [(r["form"], None if r["at_utc"] is None else str(r["at_utc"])) for r in got] == [(form, at) for _, form, at in FORMS]


def test_order_by_source(spark, tmp_path):
    """Most of a source's decided times count, but not for one that has a single reading; a source without a majority has none."""
    rows = [("d", "13/01/2024 10:00"), ("d", "14/01/2024 10:00"), ("d", "01/15/2024 10:00"), ("d", "02/03/2024 10:00"), ("m", "01/15/2024 10:00"), ("m", "02/03/2024 10:00"), ("n", "02/03/2024 10:00"), (None, "02/13/2024 10:00"), (None, "02/03/2024 10:00"), ("d", "13/13/2024 10:00")]
    got = [r["at_utc"] and (r["at_utc"].month, r["at_utc"].day) for r in _stamps(spark, tmp_path, rows)]
    assert got == [(1, 13), (1, 14), (1, 15), (3, 2), (1, 15), (2, 3), None, (2, 13), (2, 3), None]


def test_empty(spark, tmp_path):
    assert _stamps(spark, tmp_path, []) == []
