"""Session settings the results depend on, and lineage cutting for loops."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Settings results and speed depend on.

    Timestamps are read and written in UTC.  Projections that render many
    columns as text can outgrow the 8000 bytes of bytecode the JVM compiles;
    past that Spark is told to generate smaller methods instead.  Adaptive
    execution is what splits the rows of a hot key in a join.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.

    A session without that setting gets a folder below its warehouse, which
    executors share as well; a machine-local one would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work-{sc.applicationId}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from what was written.

    Loops need it so that their plans do not grow with the rounds, and two-pass
    jobs so that both passes see the same rows in the same places.  A written
    table is computed once (a checkpoint is computed for its count and again
    for its files), is read back by column, and has a known size, so Spark can
    choose to broadcast a small one.  The files are on shared storage: losing an
    executor loses nothing.

    They are removed at the end of the innermost ``working_files`` block around
    the call, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    scratch(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a table, dealt to a few tasks per core if it is read by fewer.

    A small file is one task, whatever is then done with its rows.
    """
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


_open: list[list[str]] = [[]]


def scratch(spark: SparkSession, path: str) -> str:
    """Have a folder of the caller's own removed like those of ``cut``."""
    if len(_open) == 1 and not _open[0]:
        # Runs before Spark's own, since it is registered after it.
        atexit.register(lambda: _remove(spark, _open[0]))
    _open[-1].append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    if not paths or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while paths:
        at = jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def working_files(spark: SparkSession):
    """Working files written inside are removed at the end; use up their DataFrames before."""
    _open.append([])
    try:
        yield
    finally:
        _remove(spark, _open.pop())
