"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every plan in this package assumes; sizes stay with the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = 8, memory: str = "8g", name: str = "silkmoth") -> SparkSession:
    """A session for tests and the local bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
