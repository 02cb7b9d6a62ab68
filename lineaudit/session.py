"""Session settings the engine expects; a cluster's own values win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "lineaudit") -> SparkSession:
    """A session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> bool:
    """Is there a folder for checkpoints? The cluster's setting counts; only a local
    session gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return True
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.master.startswith("local"):
        named = tempfile.mkdtemp(prefix="lineaudit-")
    if named:
        sc.setCheckpointDir(named)
    return bool(named)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    if not ensure_checkpoint_dir(spark):
        raise ValueError("spark.checkpoint.dir names no folder")
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back from the shared folder.

    For results that several branches of a plan need and that are too costly to
    compute in each of them. Without a shared folder the plan stays as it is
    and the branches compute it anew; the result is the same.
    """
    return df.checkpoint() if ensure_checkpoint_dir(df.sparkSession) else df


#: Spark's switch (4.1) for deleting the shuffle files of a query when it has ended, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, folder: str) -> DataFrame:
    """Write an intermediate result as compressed files of ``folder`` and read it back.

    For results of many texts: they take half of a checkpoint's disk, columns are read one by one, the planner knows
    their size, and the shuffle files that led to them go at once.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(folder)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
