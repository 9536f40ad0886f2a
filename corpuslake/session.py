"""A session with the settings that the engine's results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corpuslake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
