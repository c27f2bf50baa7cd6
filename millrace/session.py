"""Sessions: settings for tests and benches, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's ``spark.checkpoint.dir`` stands; where none is set a local session gets a temporary folder, any other an error."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts: two settings are lowered for the session, as the plans that need them run later."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        value = spark.conf.get(key, None)
        if value is None or not value.isdigit() or not 0 < int(value) <= most:
            spark.conf.set(key, str(most))


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches."""
    settings = {
        "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.sql.files.maxPartitionBytes": "8m",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
