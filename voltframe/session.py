"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; all of them may be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A union must not promise a partitioning that adaptive execution may later undo below it.
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(
    app: str = "voltframe", master: str | None = None, shuffle_partitions: int | None = None, **conf: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(app: str = "voltframe-local", cpus: int | None = None) -> SparkSession:
    """A single-machine session for tests and the bench script."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        app,
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("VOLTFRAME_DRIVER_MEMORY", "8g"),
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage into reliable storage.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session (tests) may leave it
    unset and gets a scratch folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="voltframe-ckpt-"))
    return df.checkpoint(eager=True)
