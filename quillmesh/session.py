"""Session builder with the settings the operators are tested under."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "quillmesh", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session: UTC, AQE with skew joins, Arrow, no UI. On a cluster the submitter's own session is used."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.driver.memory": os.environ.get("QUILLMESH_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    settings |= conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
