"""Spans of which only one may be open at a time: which are accepted, without walking a session from its start.

A span is accepted if the last accepted one has ended when it starts, so each decision needs the one
before. No accepted span starts before any span ahead of it: those were accepted and have ended, or were
refused because they start before the open one ends. So only spans that start no earlier than all ahead
of them are candidates, a running maximum finds them, and their starts never fall. After a candidate
comes the first that starts once it has ended, wherever that is: a functional graph. Candidates are cut
into ranges of SIZE; a range works out where a walk from each of its places leaves it, sorted arrays
of the ranges' last starts say which range that leads to, and pointer doubling finds the
places that the walk from the first candidate really enters. Then all ranges are walked at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.frames import running_before
from folio.operators.prefixed import passed
from folio.operators.scans import before
from folio.sources.shared import written
from folio.streaming.processors import NEVER

#: Candidates of a range.
SIZE = 4096
#: Parts that the ranges of a session are dealt to when they look up where their walks lead.
_SALTS = 16


def _ranges(candidates: DataFrame, size: int) -> DataFrame:
    """(session_id, k, seqs, starts, ends): candidates k * size .. (k + 1) * size of each session, in order."""
    placed = running_before(candidates.withColumn("one", F.lit(1)), "session_id", "seq", "one", "place")
    packed = placed.groupBy("session_id", F.floor(F.col("place") / size).alias("k")).agg(F.array_sort(F.collect_list(F.struct("place", "seq", "start_ms", "end_ms"))).alias("s"))
    return packed.select("session_id", "k", F.col("s.seq").alias("seqs"), F.col("s.start_ms").alias("starts"), F.col("s.end_ms").alias("ends"))


def _follow(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each candidate of a range the place of the next one accepted after it; beyond the range where none is in it."""
    return np.maximum(np.searchsorted(starts, ends, "left"), np.arange(len(starts)) + 1)


def exits(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each candidate of a range, when the last span ends that a walk from it accepts in the range."""
    follow = _follow(starts, ends)
    last = np.where(follow < len(starts), follow, np.arange(len(starts)))
    while True:  # doubling
        further = last[last]
        if (further == last).all():
            return ends[last]
        last = further


def _arrays(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a batch, lists as arrays of numbers."""
    columns = [[x.values.to_numpy() for x in batch.column(n)] if pa.types.is_list(batch.column(n).type) else batch.column(n).to_pylist() for n in names]
    return zip(*columns, strict=True)


def _exits(ranges: DataFrame, size: int) -> DataFrame:
    """(session_id, k, a, u): the end u with which a walk from place a leaves range k; a row for each of ``entries``, or, where that is null, for each u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = batch.column("entries").to_pylist()
            for (session, k, starts, ends), some in zip(_arrays(batch, ("session_id", "k", "starts", "ends")), entries, strict=True):
                u = exits(starts, ends)
                place = np.unique(u, return_index=True)[1] if some is None else np.array(some) - k * size
                kinds = (np.full(len(place), session), np.full(len(place), k), place + k * size, u[place])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in kinds], names=["session_id", "k", "a", "u"])

    return ranges.select("session_id", "k", "starts", "ends", "entries").mapInArrow(run, "session_id long, k long, a long, u long")


def _below(values: Column | str, x: str) -> Column:
    """How many of an ascending array's values are less than ``x``: a binary search."""
    values = F.col(values) if isinstance(values, str) else values
    steps = F.array(*[F.lit(1 << b) for b in range(24, -1, -1)])
    further = lambda lo, step: (lo + step <= F.size(values)) & (F.get(values, lo + step - 1) < F.col(x))
    return F.aggregate(steps, F.lit(0), lambda lo, step: F.when(further(lo, step), lo + step).otherwise(lo))


def _sorted_by(column: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(column, "last")))["last"]


def _targets(leaving: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """(session_id, k, u, b): the place of the first candidate beyond range k that starts at ``u`` or later; none: no row.

    Last starts of ranges, and of groups of ``size`` ranges, are sorted arrays; a search descends them.
    """
    lasts = ranges.select("session_id", "k", F.element_at("starts", -1).alias("last"))
    groups = lasts.withColumn("g", F.floor(F.col("k") / size)).groupBy("session_id", "g").agg(_sorted_by("k").alias("lasts"), F.max("last").alias("last"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    tops = groups.groupBy("session_id").agg(_sorted_by("g").alias("tops")).select("*", salts)
    groups = groups.select("session_id", "g", "lasts", salts)
    salted = leaving.select("session_id", "k", "u", F.pmod("k", F.lit(_SALTS)).cast("int").alias("salt"))
    grouped = salted.join(tops, ["session_id", "salt"]).withColumn("g", _below("tops", "u").cast("long")).drop("tops")
    ranged = grouped.join(groups, ["session_id", "g", "salt"])
    own, first = F.col("k") + 1, F.col("g") * size + _below("lasts", "u")
    to = ranged.select("session_id", "k", "u", F.greatest(own, first).alias("to"), (first < own).alias("early"))
    into = to.join(ranges.select("session_id", F.col("k").alias("to"), "starts"), ["session_id", "to"])
    return into.select("session_id", "k", "u", (F.col("to") * size + F.when(F.col("early"), 0).otherwise(_below("starts", "u"))).alias("b"))


def _entries(ranges: DataFrame, size: int) -> DataFrame:
    """(session_id, at): the place by which the walk from the first candidate enters each range that it enters."""
    leaving = _exits(ranges.withColumn("entries", F.lit(None).cast("array<long>")), size)
    targets = written(_targets(leaving, ranges, size), "targets")
    some = targets.select("session_id", F.col("b").alias("at")).unionByName(ranges.select("session_id", F.lit(0).cast("long").alias("at"))).distinct()
    by_range = some.groupBy("session_id", F.floor(F.col("at") / size).alias("k")).agg(F.collect_list("at").alias("entries"))
    jumps = _exits(ranges.join(by_range, ["session_id", "k"]), size).join(targets, ["session_id", "k", "u"])
    return passed(written(jumps.select("session_id", "a", "b"), "jumps"), ranges.select("session_id").distinct())


def _walked(ranges: DataFrame, size: int) -> DataFrame:
    """(session_id, seq, accepted) of all candidates; those of a range that the walk doesn't enter are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for session, k, at, seqs, starts, ends in _arrays(batch, ("session_id", "k", "at", "seqs", "starts", "ends")):
                follow, ok = _follow(starts, ends), np.zeros(len(starts), bool)
                i = len(starts) if at is None else at - k * size
                while i < len(starts):
                    ok[i] = True
                    i = follow[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seqs), session)), pa.array(seqs), pa.array(ok)], names=["session_id", "seq", "accepted"])

    return ranges.select("session_id", "k", "at", "seqs", "starts", "ends").mapInArrow(run, "session_id long, seq long, accepted boolean")


def accepted(spans: DataFrame, size: int = SIZE) -> DataFrame:
    """(session_id, seq, accepted) of spans (session_id, seq, start_ms, end_ms), the rows that the processor Exclusive gives.

    ``seq``, whole numbers, orders the spans of a session, each once. A span without start is refused, one without
    end stays open, so nothing after it is accepted; one that ends before it starts lasts no time.
    Rows without session are passed over.
    """
    end = F.greatest("start_ms", F.coalesce("end_ms", F.lit(NEVER)))
    rows = spans.where("session_id IS NOT NULL").select(*[F.col(c).cast("long").alias(c) for c in ("session_id", "seq", "start_ms")], end.cast("long").alias("end_ms"))
    scanned = before(rows, ["session_id"], "seq", F.col("start_ms"), "ahead", "max")
    is_one = F.col("start_ms").isNotNull() & (F.col("ahead").isNull() | (F.col("ahead") <= F.col("start_ms")))
    scanned = written(scanned.select("session_id", "seq", "start_ms", "end_ms", is_one.alias("candidate")), "spans")
    ranges = written(_ranges(scanned.where("candidate"), size), "ranges")
    # a session of one range is entered by its first candidate; only longer ones are looked up
    long_ = ranges.join(ranges.where("k = 1").select("session_id"), "session_id", "left_semi")
    entries = ranges.where("k = 0").select("session_id", F.lit(0).cast("long").alias("at"))
    if ranges.where("k = 1").take(1):
        entries = entries.unionByName(_entries(long_, size).where("at > 0"))
    entered = ranges.join(entries.select("session_id", "at", F.floor(F.col("at") / size).alias("k")), ["session_id", "k"], "left")
    refused = scanned.where("NOT candidate").select("session_id", "seq", F.lit(False).alias("accepted"))
    return _walked(entered, size).unionByName(refused)
