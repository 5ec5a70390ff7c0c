"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every operator assumes. All can be set on a running session.
SESSION_CONF = {
    # Monday weeks of timestamps depend on the session zone.
    "spark.sql.session.timeZone": "UTC",
    # Writers replace only the days / weeks present in their input.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # With this on, Spark 4.1.2 lost rows of a plan that reused an exchange below a
    # union (see README); the operators do not depend on the setting.
    "spark.sql.unionOutputPartitioning": "false",
    # Split a hot join key even where that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A model reply that repeats a key counts with the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: What a task reads of a shuffle. A hash table or sort of narrow rows takes some twenty times as
#: much: Spark's 64 MB made over 1 GB in one task. A session that sets a size keeps its own.
PARTITION_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")

#: The folder of the run in progress. Every thread has its own: a stream's batch or a second
#: run in the same driver neither writes into another run's folder nor loses its files with it.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set ``SESSION_CONF`` on a running session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(PARTITION_BYTES[0], None) is None:
        spark.conf.set(*PARTITION_BYTES)
    return spark


def local_session(cpus: int | str = 8, app: str = "upswell", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master with the setting absent.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="upswell-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def stages(spark: SparkSession) -> Iterator[str]:
    """One folder for all steps of a run that stores its results; removed when it ends.

    Frames that a caller gets from the run must not read from it. The folder is that of the
    thread that opened it.
    """
    root = f"{shared_dir(spark)}/upswell-run-{uuid.uuid4().hex}"
    token = _RUN.set(root)
    try:
        yield root
    finally:
        _RUN.reset(token)
        fs, where = file_system(spark, root)
        fs.delete(where, True)


def steps_dir(spark: SparkSession) -> str:
    """Where a step is written: the folder of the run in progress, or the shared one."""
    return _RUN.get() or shared_dir(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    Cuts the lineage for steps that must not run twice: outside calls, positions that
    depend on one particular range partitioning, and results used several times. A
    written table survives lost executors, is pruned by column, and its size lets the
    optimizer choose joins. (An eager ``checkpoint()`` would run the step twice.)
    Inside ``stages`` the folder goes when the run ends, else with the retention of the
    shared folder.
    """
    path = f"{steps_dir(df.sparkSession)}/upswell-stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
