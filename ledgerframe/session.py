"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, adaptive plans, filters pushed into Python data sources, later map entries win.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"} | more
    return SparkSession.builder.master(master).appName("ledgerframe").config(map=settings).getOrCreate()
