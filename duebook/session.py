"""Session settings the reports are planned for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE sizes the reduce side at run time, splits skewed join partitions and turns a join
# into a broadcast only once the measured size of a side allows it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",  # sums that overflow raise
}


MB, GB = 1024**2, 1024**3
#: Share of the bytes read that a report's largest shuffle moves.
SHUFFLED = 0.02


def cluster_settings(input_bytes: int) -> dict[str, str]:
    """Settings for a cluster run over tables of that size.

    Reports read a few narrow columns and combine rows before most shuffles: a shuffle moves
    about SHUFFLED of the input. Partitions are sized by those bytes, half a gigabyte each;
    AQE merges those that turn out small, but splits none outside skewed joins. Scan splits
    grow with the input to about 50,000 tasks. Map tasks times partitions is the number of
    blocks, about two hundred million at 100 TB; from a million on, blocks are merged where
    the cluster's shuffle service can do so.
    """
    split = min(2 * GB, max(128 * MB, input_bytes // 50_000))
    partitions = max(200, int(input_bytes * SHUFFLED) // (512 * MB))
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
    }
    if input_bytes // split * partitions > 10**6:
        settings["spark.shuffle.push.enabled"] = "true"
    return settings


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a
    local master gets a folder of its own; on a cluster it would be another one on each machine, so
    there it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.split("[")[0] == "local":
        raise ValueError(f"spark.checkpoint.dir is unset: {master or 'the cluster'} needs a folder that all executors see")
    if master not in _LOCAL:
        _LOCAL[master] = "file://" + tempfile.mkdtemp(prefix="duebook-")
    return _LOCAL[master]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("duebook")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DUEBOOK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
