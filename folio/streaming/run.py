"""Running per-session processors over tables and over streams.

On a table, rows are dealt by session and sorted, and pass through once: memory holds one processor
at a time, however long a session is. A session's steps depend on each other, so one session is one
task's work. On a stream, the same processor's state lives in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string


def run_batch(df: DataFrame, make: Callable[[], object]) -> DataFrame:
    """Feed each session's rows (session_id, seq, and the processor's columns) in order of seq."""
    sample = make()
    names = ["session_id", "seq", *sample.columns]
    schema = sample.schema
    columns = [f.name for f in _parse_datatype_string(schema)]
    kinds = _arrow(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current = None, None

        def rows_out(found: list[tuple]) -> list[tuple]:
            return [(key, *x) for x in found]

        def packed(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=columns)

        for batch in batches:
            out: list[tuple] = []
            for session, seq, *rest in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if current is None or session != key:
                    if current is not None:
                        out += rows_out(current.end())
                    key, current = session, make()
                out += rows_out(current.feed((*rest, seq)))
            if out:
                yield packed(out)
        if current is not None and (out := rows_out(current.end())):
            yield packed(out)

    ordered = df.select(names).where("session_id IS NOT NULL").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInArrow(each, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _parse_datatype_string(schema)]


def run_stream(df: DataFrame, make: Callable[[], object], idle_ms: int | None = None, lateness: str = "1 minute") -> DataFrame:
    """The same on a stream; rows of a micro-batch are put in order of seq.

    With ``idle_ms`` the stream has event times (ts): a session from which nothing came for that
    long, by the watermark, has ended; end() gives its last rows, and its state goes. Without it
    sessions never end, and each keeps a tail of bytes.
    """
    sample = make()
    names = ["seq", *sample.columns]
    columns = [f.name for f in _parse_datatype_string(sample.schema)]

    def each(key, frames, state):
        current = make()
        if state.exists:
            current.load(state.get[0])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *x) for x in current.end()], columns=columns)
            return
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = [(key[0], *x) for seq, *rest in rows[names].itertuples(index=False, name=None) for x in current.feed((*rest, seq))]
        state.update((current.dump(),))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(int(rows["at_ms"].max()) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    if idle_ms is None:
        return df.select("session_id", *names).groupBy("session_id").applyInPandasWithState(each, sample.schema, "dump string", "append", "NoTimeout")
    timed = df.withWatermark("ts", lateness).select("session_id", *names, "ts", F.unix_millis("ts").alias("at_ms"))
    return timed.groupBy("session_id").applyInPandasWithState(each, sample.schema, "dump string", "append", "EventTimeTimeout")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream gives of all that has come so far, appended to the table below ``path``; a call after more has come goes on where the last one ended."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def liveness_alarms(beats: DataFrame, limit_ms: int, lateness: str = "1 minute") -> DataFrame:
    """(session_id, silent_since): sessions of a stream (session_id, ts) from which nothing came for ``limit_ms`` of event time."""
    late = beats.withWatermark("ts", lateness)
    gaps = late.groupBy("session_id", F.session_window("ts", f"{limit_ms} milliseconds")).agg(F.max("ts").alias("silent_since"))
    return gaps.select("session_id", "silent_since")


def replay_dedup(commits: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Commits of a stream (hash, ts, ...) without those repeated within ``lateness``."""
    return commits.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["hash"])


def capture(dirty: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of dirty pages to ``apply`` with its number; a repeated number must change nothing."""
    return dirty.writeStream.foreachBatch(lambda df, n: apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
