"""Session defaults: UTC, adaptive plans, skewed joins split."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "buildscope", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
