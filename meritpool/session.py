"""Session for tests, benches and notebooks; on a cluster pass your own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings the jobs are written for.

    The adaptive settings are Spark's defaults, spelled out because the joins
    count on them: plain joins carry no broadcast hint, so Spark's own size
    checks choose between broadcast and shuffle, and a hot key of a shuffled
    join is split at run time.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("meritpool")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .getOrCreate()
    )
