"""Lineage cuts: intermediate tables written as parquet in the cluster's shared checkpoint folder.

Parquet rather than ``DataFrame.checkpoint`` so that later passes read only the columns they need and
can skip partitions; like a checkpoint it survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode when none is set."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="puspark-"))
    return context.getCheckpointDir().rstrip("/")


_OPEN: list[list[str]] = []


def table_path(spark: SparkSession) -> str:
    """A fresh folder for an intermediate table, noted in the innermost open workspace."""
    path = f"{shared_folder(spark)}/puspark-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialise(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and return a reader of the written table."""
    spark = df.sparkSession
    path = table_path(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, also after an error.

    Write what is wanted of the results before the end: DataFrames made inside read the tables that go.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
