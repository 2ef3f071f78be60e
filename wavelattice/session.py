"""Session settings that suit the engine, for programs that have no session of their own."""

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int | None = None) -> SparkSession:
    cores = cores or os.cpu_count() or 8
    return (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName("wavelattice")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
