"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "zonewright", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and ANSI mode are part of the semantics; adaptive execution sizes joins and partitions at run time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        fixed |= {"spark.sql.shuffle.partitions": str(os.cpu_count() or 8), "spark.driver.memory": "8g"}
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one under a local master, an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors see")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="zonewright-"))
    return spark.sparkContext.getCheckpointDir()
