"""Per-session processors on streams with event-time timers: deadlines that fire when nothing comes, and sessions that end.

Rows wait until the watermark has passed them, so they are fed in order of time and seq however
micro-batches are cut. Sessions are dealt to buckets, and a bucket is a key of Spark's state: what waits
is a batch of rows a micro-batch, the sessions' own states are one value, and one timer, for the earliest
of all that is due, stands for all of the bucket's. So a micro-batch costs a few calls a bucket, not a few a
row. A session that has been silent for ``idle_ms`` of event time ends, and all its state goes. A batch
has the same rows from run_batch(), or from the window forms of folio/operators/sessions.py.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: The state store that keeps several variables a key.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that sessions are dealt to. A bucket's rows that wait, and its sessions' states, must fit a task's memory.
BUCKETS = 1024


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


class _Timed(StatefulProcessor):
    def __init__(self, make: Callable[[], object], row: StructType, idle_ms: int):
        self.make, self.idle_ms = make, idle_ms
        self.schema = to_arrow_schema(row)
        self.columns = [f.name for f in _parse_datatype_string(make().schema).fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        # JSON: session -> [dump, last_ms, told_ms, next_ms]; the time before which nothing of the bucket is due
        self.facts = handle.getValueState("facts", "sessions string, next_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [pa.Table.from_pandas(part[self.schema.names], schema=self.schema, preserve_index=False) for part in rows if len(part)]
        if fresh:
            table = pa.concat_tables(fresh)
            self.waiting.appendValue((_packed(table),))
            self._due_at(pc.min(table["at"]).as_py())
        yield pd.DataFrame([], columns=self.columns)

    def _due_at(self, at: int) -> None:
        sessions, due = self.facts.get() if self.facts.exists() else ("{}", None)
        if due is None or at < due:
            self.facts.update((sessions, at))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Everything up to the watermark in order: a session's rows, and its processor's times, after the rows of the same moment."""
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        sessions, due_at = self.facts.get() if self.facts.exists() else ("{}", None)
        if due_at is None or due_at > now:
            return  # an earlier timer has done it
        known = {int(k): v for k, v in json.loads(sessions).items()}
        blobs = [bytes(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        held = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in blobs]) if blobs else self.schema.empty_table()
        ready = pc.less_equal(held["at"], now)
        left = held.filter(pc.invert(ready))
        open_ = set(left["session_id"].unique().to_pylist())
        # at is the first column and seq the third
        due = held.filter(ready).sort_by([("session_id", "ascending"), ("at", "ascending"), ("seq", "ascending")])
        rows = zip(*(c.to_pylist() for c in due.columns), strict=True)
        fed = {s: list(mine) for s, mine in groupby(rows, key=lambda r: r[1])}
        out: list[tuple] = []
        for session in {**fed, **{s: None for s, x in known.items() if x[3] is not None and x[3] <= now}}:
            state = self._pass(session, known.get(session), fed.get(session, []), session in open_, now, out)
            if state:
                known[session] = state
            else:
                known.pop(session, None)
        if len(left) < len(held):
            if len(left):
                self.waiting.put([(_packed(left),)])
            else:
                self.waiting.clear()
        times = [x[3] for x in known.values() if x[3] is not None]
        if len(left):
            times.append(pc.min(left["at"]).as_py())
        if times or known:
            self.facts.update((json.dumps(known), min(times, default=None)))
        else:
            self.facts.clear()
        if times:
            self.handle.registerTimer(min(times))
        yield pd.DataFrame(out, columns=self.columns)

    def _pass(self, session: int, state: list | None, due: list[tuple], more: bool, now: int, out: list[tuple]) -> list | None:
        """A session's next state, none if it has ended; its rows go to ``out``."""
        current, last, told = self.make(), None, None
        if state:
            dump, last, told, _ = state
            current.load(dump)
        times = current.timers if hasattr(current, "timers") else list

        def tell(upto: int) -> None:
            nonlocal told
            for t in times():
                if (told is None or t > told) and t <= upto:
                    out.extend((session, *x) for x in current.on_time(t))
            told = upto if told is None else max(told, upto)

        for at, _, seq, *rest in due:
            tell(at - 1)
            out.extend((session, *x) for x in current.feed((*rest, seq)))
            last = at
        tell(now)
        if not more and now >= last + self.idle_ms:
            out.extend((session, *x) for x in current.end())
            return None
        return [current.dump(), last, told, min((t for t in (last + self.idle_ms, *times()) if t > now), default=None)]

    def close(self) -> None:
        pass


def run_timed(df: DataFrame, make: Callable[[], object], idle_ms: int, lateness: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """``make()``'s rows for a stream (session_id, seq, ts, and the processor's columns; at_ms is made of ts).

    Rows of a session are fed in order of ts, then seq; one later than ``lateness`` is lost, as Spark
    drops it. Timers fire as the watermark passes them, so the last rows of a stream wait for more.
    ``idle_ms`` must be longer than any deadline of the processor; a query's ``buckets`` stay as they were at its start.
    """
    sample = make()
    own = [c for c in sample.columns if c != "at_ms"]
    assert set(own) <= set(df.columns)
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket")
    timed = df.where("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness).select(bucket, "ts", F.unix_millis("ts").alias("at"), F.col("session_id").cast("long").alias("session_id"), "seq", *sample_columns(df, sample))
    kinds = {f.name: f.dataType for f in timed.schema.fields}
    row = StructType([StructField(n, kinds[n]) for n in ("at", "session_id", "seq", *sample.columns)])
    return timed.groupBy("bucket").transformWithStateInPandas(_Timed(make, row, idle_ms), sample.schema, "Append", "EventTime")


def sample_columns(df: DataFrame, sample) -> list:
    return [F.unix_millis("ts").alias("at_ms") if c == "at_ms" else F.col(c) for c in sample.columns]


def drained_timed(make_stream: Callable[[], DataFrame], spark: SparkSession, path: str) -> DataFrame:
    """drained() of a stream with timers, whose state store must be RocksDB; the session's own setting is put back."""
    from folio.streaming.run import drained

    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        return drained(make_stream(), path)
    finally:
        spark.conf.set(key, was)
