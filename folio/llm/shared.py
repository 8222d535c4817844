"""Tables written to the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or, where that is unset, in the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of tables that operators have written, while kept_only() watches; each thread has its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    return written_to(df, shared_path(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table, or nothing if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept_only(df: Callable[[], DataFrame], spark: SparkSession, name: str) -> tuple[DataFrame, str]:
    """What ``df()`` gives, written, and its path; the tables that operators wrote for it are removed then."""
    made: list[str] = []
    before = _made.set(made)
    try:
        path = shared_path(spark, name)
        out = df()
        out.write.option("compression", "zstd").parquet(path)
    finally:
        _made.reset(before)
        for table in made:
            remove(spark, table)
    return spark.read.schema(out.schema).parquet(path), path
