"""Session builder with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "broadsheet", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution.

    master is left to spark-submit unless given. Keyword settings use ``__`` for the dots
    (``spark__sql__shuffle__partitions="8"``).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
