"""Session defaults and shared scratch space."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "opinara", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC time, ANSI casts and adaptive execution.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the submit
    command chooses them and adaptive execution coalesces small partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="opinara-")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder for intermediate tables.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a
    single-machine session (``local[...]``) may do without it: executors on
    other machines could not read a folder of this one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/opinara/{tag}-{uuid.uuid4().hex}"


#: Spark drops an execution's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, by: list[str] | None = None, done: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder, partitioned ``by`` columns if given, and read it back.

    Used where several outputs share one expensive input: the written table
    survives the loss of executors, which cached blocks do not. With ``done``
    what was shuffled for it goes off the disks at once.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    if done:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").partitionBy(*by or []).parquet(path)
    finally:
        if done:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
