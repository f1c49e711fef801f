"""Session defaults used by tests, bench and examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Values that keep secrets out of plans shown by explain() and the UI.
REDACTION = "(?i)(key|secret|passphrase)"


def get_spark(app: str = "cloakframe", cores: str | None = None, **conf: str) -> SparkSession:
    """Local session; on a cluster the session comes from spark-submit."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.redaction.options.regex", REDACTION)
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
