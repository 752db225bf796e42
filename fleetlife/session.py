"""Session helpers: settings the jobs rely on, and where intermediate tables are kept.

Staged tables stay in the checkpoint folder until ``drop_staged`` is called, as the command line does
at the end of a job. Frames that were built on them can't be used afterwards.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job assumes. A cluster may set others (executor sizes, shuffle partitions).
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


#: Bytes of rows that Spark sends to a Python task at once, where the session has no limit of its own. A batch is
#: held on both sides, so batches of 10,000 rows of text (Spark's limit) take more memory than the work on them.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20


#: Tables that this process has staged.
_STAGED: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetlife")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the call site of every expression makes long plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a local session without one gets a temporary folder; a cluster must name a folder that
    all executors see in ``spark.checkpoint.dir``.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fleetlife-checkpoint-"))
    return sc.getCheckpointDir()


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end after ``BATCH_BYTES``, if it has no limit of its own."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table below the shared checkpoint folder and read it back.

    Used where one intermediate result feeds several branches of a plan or several fits. The
    branches neither recompute it nor depend on executors that may be lost, they read only the
    columns they need, and the planner knows the size of the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables staged so far."""
    while _STAGED:
        place = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
