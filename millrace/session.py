"""Session defaults: UTC, adaptive execution, Arrow batches bounded by bytes as well as rows."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "millrace", **conf: str) -> SparkSession:
    """A session with this library's defaults. Master and number of shuffle partitions are set only where they are named here, so that
    those of spark-submit or of Spark's own configuration hold otherwise."""
    b = SparkSession.builder.appName(app)
    if master is not None:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
