"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "asofkit", **conf) -> SparkSession:
    """A session in UTC with adaptive execution; partition counts stay the cluster's business."""
    builder = (SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
