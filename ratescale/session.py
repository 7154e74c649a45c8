"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "ratescale", **conf: str) -> SparkSession:
    """A session with the settings the library counts on; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = sc.getConf().get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="ratescale-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs begun in here drop their shuffle files as they end; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CONF, None)
    spark.conf.set(SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CONF)
        else:
            spark.conf.set(SHUFFLE_CONF, before)


@contextmanager
def dealt_to_folders(rows: DataFrame, by: str, name: str) -> Iterator[DataFrame]:
    """The rows, written with a folder for each value of `by`, so that those of one value are read alone. The folders go in the end."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, name))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.write.partitionBy(by).parquet(path.toString())
        yield spark.read.schema(rows.schema).parquet(path.toString())
    finally:
        files.delete(path, True)
