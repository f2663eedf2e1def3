"""Session helpers: defaults for tests, the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "veilscan") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "1m")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables, in the cluster's shared folder.

    The folder is the one named by ``spark.checkpoint.dir``; where that is unset, the
    session's warehouse, which a cluster's executors share too.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/veilscan-{uuid.uuid4().hex}"
