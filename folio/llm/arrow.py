"""Small helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``each`` to every Arrow batch of ``df``; a batch may map to None (no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str | Column) -> DataFrame:
    """Only the named columns, as ``doc_id`` and ``text``; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def text_hash(text_col: str = "text") -> Column:
    """A hash that tells rows apart which share an id but not a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding each value."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
