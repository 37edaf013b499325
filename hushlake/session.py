"""A local session for tests and benchmarks; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "hushlake", **conf: str) -> SparkSession:
    """Session on this machine in UTC with adaptive execution; ``conf`` overrides any setting."""
    memory = os.environ.get("HUSHLAKE_DRIVER_MEMORY", "8g")
    settings = {
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
