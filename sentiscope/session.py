"""Session settings and the shared scratch area.

On a cluster the scratch area is the shared folder named by
``spark.checkpoint.dir``; it is read from the session and only set here when
it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC clock (D20), runtime re-planning with
# skew-join splitting. Day-level rewrites ask for dynamic partition overwrite themselves.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts run up to ~20k words: keep Arrow batches for the scorer UDF bounded, by rows
    # and by bytes (a batch closes at whichever limit it reaches first).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # Streaming state (windowed counts, watermark dedup) lives in RocksDB on local disk
    # instead of the executor heap; changelog checkpointing uploads only the changes
    # of each micro-batch. A restarted query keeps the provider of its checkpoint.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "sentiscope", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``; only when it is unset in a local-mode
    session (local runs, tests) a fresh local folder is created and registered.
    A cluster session without it fails here: a machine-local folder would not be
    visible to other executors and would not survive the loss of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or "
                               "an object store); checkpoints and written tables go there")
        root = tempfile.mkdtemp(prefix="sentiscope-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused directory under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    if path.startswith("/"):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path
