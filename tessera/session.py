"""The session the tests and the bench use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword arguments add settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    out = builder.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out
