"""Tables written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the folder that spark.checkpoint.dir names, or, where that is unset, of the warehouse.

    That part goes with the application: Hadoop removes it when the driver ends. Until then a DataFrame
    whose lineage ends in a table there can be computed again.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    own = f"{top.rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


#: Hashes in hex take half their length.
COMPRESSION = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written meanwhile goes as soon as it is written, not when the driver happens to collect its garbage."""
    set_here = spark.conf.get(_CLEANUP, "false") != "true"
    if set_here:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if set_here:
            spark.conf.unset(_CLEANUP)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    with passing_shuffles(df.sparkSession):
        df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)
