"""Length-prefixed frames of byte streams, found without walking a session from its start.

A frame is a kind (one byte), a length (four, big-endian) and that many bytes; where the next one starts
follows from where one starts. A session is cut into ranges of SIZE bytes. Each range works out, for
every place that could start a frame, where a walk from there leaves the range; these jumps are a
functional graph over the whole session, and the places that the walk from byte 0 really passes are found
by pointer doubling: a round joins the places known so far with jumps, and jumps with themselves, so
a session of n ranges takes log n rounds. Then all ranges are read at once, each from its own first frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators.frames import running_before
from folio.sources.shared import written
from folio.streaming.processors import LONGEST

#: Bytes of a range.
SIZE = 1 << 16
_HEAD = 5


def _ranges(chunks: DataFrame, size: int) -> DataFrame:
    """(session_id, k, bytes): bytes k * size .. (k + 1) * size of each session, and of the next range as many as a head may need."""
    n = F.octet_length("bytes").cast("long")
    some = chunks.where("session_id IS NOT NULL AND bytes IS NOT NULL").select("session_id", "seq", "bytes", n.alias("n"))
    at = running_before(some, "session_id", "seq", "n", "start").where("n > 0")
    first = F.floor(F.greatest(F.col("start") - (_HEAD - 1), F.lit(0)) / size)
    cut = at.withColumn("k", F.explode(F.sequence(first, F.floor((F.col("start") + F.col("n") - 1) / size))))
    cut = cut.withColumn("a", F.greatest(F.lit(0).cast("long"), F.col("k") * size - F.col("start"))).withColumn("b", F.least("n", (F.col("k") + 1) * size + (_HEAD - 1) - F.col("start")))
    piece = cut.where("a < b").withColumn("piece", F.expr("substring(bytes, CAST(a + 1 AS INT), CAST(b - a AS INT))"))
    return piece.groupBy("session_id", "k").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY start)").alias("bytes"))


def _heads(data: bytes) -> np.ndarray:
    """For each place that has a whole head, the length it would name."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    return (raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]) if len(raw) >= _HEAD else raw[:0]


def exits(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, exit) for the places of a range from which a walk leaves it: the first start of a frame at ``size`` or beyond."""
    length = _heads(data)[:size]
    place = np.arange(len(length))
    to = np.where(length <= LONGEST, place + _HEAD + length, -1)
    while True:  # doubling: each round, a walk that is still in the range takes the walk from where it is
        inside = (to >= 0) & (to < size)
        if not inside.any():
            break
        step = np.full(len(to), -1)
        known = inside & (to < len(to))  # beyond that, no head is whole: the stream ends there
        step[known] = to[to[known]]
        to = np.where(inside, step, to)
    out = to >= 0
    return place[out], to[out]


def _jumps(ranges: DataFrame, size: int) -> DataFrame:
    """(session_id, a, b): from a place that could start a frame to where its walk leaves the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for session, k, data in zip(*(batch.column(c).to_pylist() for c in ("session_id", "k", "bytes")), strict=True):
                place, to = exits(data, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), session)), pa.array(place + k * size), pa.array(to + k * size)], names=["session_id", "a", "b"])

    return ranges.mapInArrow(run, "session_id long, a long, b long")


def passed(jumps: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, at): byte 0 of each session, and every place that jumps lead to from there."""
    known = written(sessions.select("session_id", F.lit(0).cast("long").alias("at")), "passed")
    n = known.count()
    while True:
        ahead = known.join(jumps, (known.session_id == jumps.session_id) & (known["at"] == jumps.a)).select(known.session_id, F.col("b").alias("at"))
        known = written(known.unionByName(ahead).distinct(), "passed")
        more = known.count()
        if more == n:
            return known
        n = more
        one, two = jumps, jumps.select(F.col("session_id").alias("s"), F.col("a").alias("c"), F.col("b").alias("d"))
        jumps = written(one.join(two, (one.session_id == two.s) & (one.b == two.c)).select("session_id", "a", F.col("d").alias("b")), "jumps")


_FOUND = "session_id long, at long, kind string, length long, data binary"


def _walked(ranges: DataFrame, size: int) -> DataFrame:
    """Frames that start in each range, walked from its ``entry``; data is null where a frame ends in a later range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for session, k, entry, data in zip(*(batch.column(c).to_pylist() for c in ("session_id", "k", "entry", "bytes")), strict=True):
                i = entry - k * size
                while i < size and i + _HEAD <= len(data):
                    kind, n = data[i], int.from_bytes(data[i + 1 : i + _HEAD], "big")
                    if n > LONGEST:
                        out.append((session, k * size + i, "error", 0, b"frame too long"))
                        break
                    stop = i + _HEAD + n
                    if kind == 0 or kind == 1 and n >= 4:
                        out.append((session, k * size + i, "input" if kind == 0 else "resize", n, data[i + _HEAD : stop] if not n or stop <= min(len(data), size) else None))
                    i = stop
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["session_id", "at", "kind", "length", "data"])

    return ranges.mapInArrow(run, _FOUND)


def length_frames(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """(session_id, n, kind, name, data) of streams of length-prefixed frames, the rows that the processor Frames("length") gives.

    Kind 0 is 'input' with its bytes, kind 1 of four bytes or more is 'resize' with 'rows,cols'; others
    are passed over. A length beyond LONGEST is an 'error', and the stream ends there; a frame that is cut
    off at the end is nothing. ``seq`` orders the chunks of a session (session_id, seq, bytes), each once.
    """
    ranges = written(_ranges(chunks, size), "ranges")
    entered = passed(written(_jumps(ranges, size), "jumps"), ranges.select("session_id").distinct())
    entries = entered.select("session_id", F.floor(F.col("at") / size).alias("k"), F.col("at").alias("entry"))
    found = written(_walked(ranges.join(entries, ["session_id", "k"]), size), "found")
    # frames that end in a later range: their pieces are taken from each range that they lie in
    open_ = found.where("data IS NULL").withColumn("first", F.col("at") + _HEAD).withColumn("last", F.col("first") + F.col("length") - 1)
    lies = open_.select("session_id", "at", "first", "length", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor(F.col("last") / size))).alias("k"))
    own = ranges.select("session_id", "k", F.expr(f"substring(bytes, 1, {size})").alias("bytes"))
    start = F.greatest(F.lit(0).cast("long"), F.col("first") - F.col("k") * size)
    piece = lies.join(own, ["session_id", "k"]).withColumn("a", start).withColumn("b", F.least(F.lit(size).cast("long"), F.col("first") + F.col("length") - F.col("k") * size))
    piece = piece.withColumn("piece", F.expr("substring(bytes, CAST(a + 1 AS INT), CAST(b - a AS INT))"))
    put = piece.groupBy("session_id", "at").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY k)").alias("whole"))
    joined = found.join(put, ["session_id", "at"], "left").withColumn("data", F.coalesce("data", "whole"))
    joined = joined.where("kind = 'error' OR octet_length(data) = length")
    two = lambda i: F.conv(F.hex(F.expr(f"substring(data, {i}, 2)")), 16, 10)
    resize = F.col("kind") == "resize"
    shown = joined.select("session_id", "at", "kind", F.when(resize, F.concat(two(1), F.lit(","), two(3))).alias("name"), F.when(resize, F.lit(b"")).otherwise(F.col("data")).alias("data"), F.lit(1).alias("one"))
    return running_before(shown, "session_id", "at", "one", "n").select("session_id", "n", "kind", "name", "data")
