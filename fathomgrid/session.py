"""Sessions with the settings that the library's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans, no other assumption about the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(app: str = "fathomgrid", **settings: str) -> SparkSession:
    """A session; settings that the cluster gives are left as they are, but for SETTINGS."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
