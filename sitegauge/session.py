"""Session settings the operators expect."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sitegauge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("FATAL")
    return spark


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a fresh one in local runs only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so later stages survive lost executors."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: ``spread`` leaves frames of fewer rows than the first number as they lie; its parts hold at most the second.
SPREAD_ROWS = 100_000, 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """``cut_lineage`` with the rows of a large frame dealt evenly over all cores.

    A model reads its rows hundreds of times, and a file of few row groups or a shuffle that was merged into few parts
    would keep few cores busy each time.
    """
    least, most = SPREAD_ROWS
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df if rows < least else df.repartition(cores * -(-rows // (cores * most))))


#: Lets shuffle files go when the execution that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back; what was shuffled for it goes once it is written."""
    spark = df.sparkSession
    path, before = f"{shared_scratch(spark)}/rows", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shared_scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, for artifacts passed between jobs."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/scratch-{uuid.uuid4().hex}"
