"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir where the cluster names it.

    Only on a single machine (a local master, as in tests) may it be unset; a local folder is made
    and set then. On a cluster executors would each write to their own disk, which is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            folder = held.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="sievework-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


#: Spark's own settings that delete a query's shuffle files as soon as the query has ended, and that
#: bound what goes to a Python worker at once, which long texts would make large.
_FRUGAL = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def _frugal(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in _FRUGAL}
    for key, value in _FRUGAL.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, what: str) -> DataFrame:
    """df cut from its lineage: written as Parquet to the shared folder and read again. The shuffle
    files that led to it are deleted with the write's end, as nothing reads them any more."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with _frugal(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written() once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
