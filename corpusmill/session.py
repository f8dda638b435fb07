"""Session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", app: str = "corpusmill", **conf: str) -> SparkSession:
    """A local session; on a cluster, use the session the cluster gives.

    Shuffle partitions start at 16, for one machine, and are coalesced by
    adaptive execution; a cluster's session sets its own number.
    """
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no look at the stack for each expression
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
