"""Session settings the library relies on, and the places where lineage is cut."""
from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Adaptive settings: statistics joined back onto pixels meet hot images, so the
# skew split must be taken even where it costs one more exchange.
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # tables hash-partitioned by image join on (image, y, x) without another shuffle
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # texts vary from a word to megabytes: batches for Python are bounded by bytes, not by rows alone
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


# Sizes before a run come from the compressed columns of a file and know nothing of exploded rows.
_ESTIMATED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_SCAN_TASKS = "spark.sql.files.minPartitionNum"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime (non-static) settings; cluster-wide ones stay as they are."""
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    given = spark.sparkContext.getConf()
    spark.conf.set(_ESTIMATED, given.get(_ESTIMATED, "10MB"))
    spark.conf.set(_MEASURED, given.get(_MEASURED, "10MB"))
    if (parts := given.get(_SCAN_TASKS, None)) is None:
        spark.conf.unset(_SCAN_TASKS)
    else:
        spark.conf.set(_SCAN_TASKS, parts)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python can import its functions."""
    sc = spark.sparkContext
    if getattr(sc, "_pixtables_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pixtables-"), "pixtables.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(top, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(archive)  # served by the driver; executors fetch a copy
    sc._pixtables_shipped = True


# The largest image of the tables in pixels. Images up to the limit are measured
# whole in one group; for larger or unknown ones statistics take the spread path.
IMAGE_PIXELS = "spark.pixtables.image.pixels"
_WHOLE_IMAGE_LIMIT = 4_000_000


def declare_image_size(spark: SparkSession, pixels: int) -> SparkSession:
    spark.conf.set(IMAGE_PIXELS, str(pixels))
    return spark


def broadcast_measured(spark: SparkSession) -> SparkSession:
    """Broadcast no table by its estimated size until the next ``configure``, only by the size that a run has measured.

    A point is exploded into the pixels around it, so a table that looks small in its file would pass the driver with
    millions of rows.
    """
    spark.conf.set(_ESTIMATED, "-1")
    return spark


def broadcast_nothing(spark: SparkSession) -> SparkSession:
    """Broadcast no table at all until the next ``configure``, for a job of many joins with one row an image: each of
    them would pass the driver."""
    spark.conf.set(_ESTIMATED, "-1")
    spark.conf.set(_MEASURED, "-1")
    return spark


# Rows of the source table for each task of the tables derived from it.
_TASK_ROWS = 150_000


def tasks_for(rows: DataFrame, each: int = _TASK_ROWS) -> int:
    """Number of partitions in proportion to the rows of a source table (counted from file footers), so that a task's
    memory does not grow with the table. Adaptive merging would size tasks by compressed bytes instead."""
    return -(-rows.count() // each) or 1


def scan_tasks(spark: SparkSession, tasks: int) -> SparkSession:
    """Read files in at least so many tasks until the next ``configure``; a task takes 4 MB of a file or more.

    By default a file makes as many tasks as there are cores up to 128 MB each, so the partial aggregates of a task
    would grow with the table.
    """
    spark.conf.set(_SCAN_TASKS, str(max(tasks, spark.sparkContext.defaultParallelism)))
    return spark


def images_fit(spark: SparkSession) -> bool:
    declared = spark.conf.get(IMAGE_PIXELS, None)
    return declared is not None and int(declared) <= _WHOLE_IMAGE_LIMIT


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine is taken only by a session that has no other machines;
    a cluster without a shared folder is refused before any work is done.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current and not named:
        return current
    if not named:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="run-checkpoint-")
    if not current:
        sc.setCheckpointDir(named)
    return named


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage, and lost executors do not matter."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, used between the rounds of an iterative operator."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of one plan read; spills, rebuilt on loss."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
