"""Session defaults and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Rows of one Arrow batch. Texts may be long, so a batch stays far below a worker's memory.
BATCH_ROWS = 256


def get_spark(app: str = "newsloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` adds to them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Publish times are UTC throughout, so date text must be rendered in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """At most BATCH_ROWS rows go to a Python worker at once; rows may be whole pages or texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: `spark.checkpoint.dir`.

    Where a cluster names none there is no safe choice, since its warehouse may be a folder of one
    machine; a local session uses its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for `purpose` below the shared root."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
