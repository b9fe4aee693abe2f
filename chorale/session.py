"""Session settings that the library expects; every query also runs in a session made elsewhere."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "chorale", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and bench; on a cluster the submitter's settings win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CHORALE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
