"""Session defaults and the few runtime helpers every operator shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(app: str = "dhruva", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; explicit settings win."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode where none is configured (tests)."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if path is None:
        path = spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all machines share; {master} has none")
        path = f"file://{tempfile.mkdtemp(prefix='dhruva-checkpoints-')}"
        spark.conf.set(CHECKPOINT_KEY, path)
    return path


_written: list[str] = []


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executor loss.

    What is written goes when the driver ends, or before at the end of an ``intermediates`` block.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder, fs = _file_system(spark, path)
    fs.deleteOnExit(folder)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within the block sends at most ``rows`` rows at a time to Python: for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write within the block are removed at its end; results must have been used or written by then."""
    first = len(_written)
    try:
        yield
    finally:
        while len(_written) > first:
            folder, fs = _file_system(spark, _written.pop())
            fs.delete(folder, True)
            fs.cancelDeleteOnExit(folder)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer input partitions than the cluster has cores (asking a shuffled frame would run it)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
