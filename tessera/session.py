"""The session that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time stamps without a zone are read as UTC; ANSI errors and adaptive execution stay on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, name: str = "tessera", **conf: str) -> SparkSession:
    """A session with SETTINGS; conf has more settings, with _ for each dot."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
