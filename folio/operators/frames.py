"""Frames in byte streams: chunks (session_id, seq, bytes) cut where a delimiter stands, wherever chunks were cut.

A chunk is split by itself, and a frame's number is the count of delimiters before it, so a frame
that runs over several chunks is put together by grouping on its number. Running counts are summed
over ranges first, so no session is one value or one task, however long it is; a frame is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.scans import RANGE, before


def running_before(rows: DataFrame, key: str, place: str, value: str, out: str, size: int = RANGE) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows of ``key`` with a lesser ``place`` (a whole number; no two rows of a key share it)."""
    return before(rows, [key], place, F.col(value), out, size=size).withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def chunks_of(frames: DataFrame, size: int, key: str = "session_id", place: str = "seq") -> DataFrame:
    """(session_id, seq, bytes): a session's ``frames`` (bytes) end to end, cut every ``size`` bytes. The inverse of framing; no session becomes one value."""
    n = F.octet_length("bytes").cast("long")
    at = running_before(frames.where("bytes IS NOT NULL").select(F.col(key).alias("session_id"), F.col(place).alias("seq"), "bytes", n.alias("n")), "session_id", "seq", "n", "start").where("n > 0")
    cut = at.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))))
    first = F.greatest(F.lit(0).cast("long"), F.col("k") * size - F.col("start"))
    piece = cut.withColumn("first", first).withColumn("piece", F.expr(f"substring(bytes, CAST(first + 1 AS INT), CAST(least(n, (k + 1) * {size} - start) - first AS INT))"))
    return piece.groupBy("session_id", F.col("k").alias("seq")).agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY start)").alias("bytes"))


def _split(data: Column, delimiter: bytes) -> Column:
    """Pieces of bytes between delimiters of one byte. In this charset a character is a byte."""
    return F.transform(F.split(F.decode(data, "ISO-8859-1"), rf"\x{delimiter.hex()}", -1), lambda x: F.encode(x, "ISO-8859-1"))


def delimited(chunks: DataFrame, delimiter: bytes) -> DataFrame:
    """(session_id, n, data, closed): the frames before, between and after delimiters of one byte; the last is not ``closed``, and is no row if it is empty.

    Null chunks and sessions are passed over; ``seq`` orders the chunks of a session, each once.
    """
    parts = chunks.where("session_id IS NOT NULL AND bytes IS NOT NULL").select("session_id", "seq", _split(F.col("bytes"), delimiter).alias("parts"))
    counted = running_before(parts.withColumn("ends", F.size("parts") - 1), "session_id", "seq", "ends", "before")
    pieces = counted.select("session_id", "seq", "before", F.posexplode("parts").alias("k", "part"), "ends")
    frames = pieces.groupBy("session_id", (F.col("before") + F.col("k")).alias("n")).agg(
        F.expr("listagg(part) WITHIN GROUP (ORDER BY seq)").alias("data"), F.max(F.col("k") < F.col("ends")).alias("closed")
    )
    return frames.where("closed OR octet_length(data) > 0")


def lines(chunks: DataFrame) -> DataFrame:
    """(session_id, n, line): text lines, without line ends; bad UTF-8 becomes U+FFFD; a last line without an end counts."""
    text = F.rtrim(F.expr("make_valid_utf8(data)"), F.lit("\r"))  # a pattern's $ would also stand before other line ends
    return delimited(chunks, b"\n").select("session_id", "n", text.alias("line"))


def _with_neighbours(rows: DataFrame, column: str, size: int | None = None) -> DataFrame:
    """``rows`` (session_id, n, ...) with ``above`` and ``below``: ``column`` of the rows of the session numbered one less and one more.

    Windows of a range of n; what ends or starts a range is dealt to the range beside it too.
    """
    size = size or running_before.__defaults__[0]
    at = F.floor(F.col("n") / size)
    ranges = F.array_compact(F.array(at, F.when(F.col("n") % size == 0, at - 1), F.when(F.col("n") % size == size - 1, at + 1)))
    w = Window.partitionBy("session_id", "_range").orderBy("n")
    dealt = rows.withColumn("_at", at).withColumn("_range", F.explode(F.array_distinct(ranges)))
    return dealt.withColumns({"above": F.lag(column).over(w), "below": F.lead(column).over(w)}).where("_range = _at").drop("_at", "_range")


def server_events(chunks: DataFrame) -> DataFrame:
    """(session_id, n, kind, name, data) of an event stream: blocks of ``event:`` and ``data:`` lines.

    A block ends at an empty line: LF LF, or CR LF CR LF. One space after the colon goes; several
    data lines are joined by LF, but for empty ones before the first that isn't; a block of neither
    field is nothing, and so are further empty lines; data without an event is an 'error', and so
    is an unfinished block at the end. n numbers the rows of a session from 0.
    """
    raw = delimited(chunks, b"\n")
    rows = _with_neighbours(raw.select("session_id", "n", "closed", F.expr("make_valid_utf8(data)").alias("line")), "line")
    ends = F.col("closed") & (((F.col("line") == "") & F.col("above").isNotNull()) | ((F.col("line") == "\r") & F.col("above").endswith("\r")))
    placed = running_before(rows.withColumn("ends", F.coalesce(ends, F.lit(False)).cast("int")), "session_id", "n", "ends", "block")
    # CR LF ends a line; the CR of a block's last line belongs to it if LF LF follows
    cr = F.col("line").endswith("\r") & ~F.coalesce(F.col("below") == "", F.lit(False))
    line = F.when(cr, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    key, value = F.substring_index("line", ":", 1), F.regexp_replace(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1), "^ ", "")
    fielded = placed.withColumn("line", line).withColumn("key", F.when(F.col("line").contains(":"), key)).withColumn("value", value)
    blocks = fielded.groupBy("session_id", "block").agg(
        F.min("n").alias("first"), F.max("ends").alias("done"), F.max(F.when(F.col("key") == "event", F.struct("n", "value"))).alias("event"), F.count(F.when(F.col("key") == "data", 1)).alias("n_data"),
        F.expr("listagg(CASE WHEN key = 'data' THEN value END, '\\n') WITHIN GROUP (ORDER BY n)").alias("data"), F.max(F.octet_length("line")).alias("longest"),
    )
    known = F.coalesce(F.col("event.value") != "", F.lit(False))
    kind = F.when(F.col("done") == 0, "error").when(known, "event").otherwise("error")
    data = F.when(F.col("done") == 0, "unfinished").when(known, F.regexp_replace(F.coalesce("data", F.lit("")), "^\\n+", "")).otherwise("data without event")
    some = blocks.where("done = 0 AND longest > 0 OR done = 1 AND (event IS NOT NULL OR n_data > 0)")
    shown = some.select("session_id", "block", kind.alias("kind"), F.when((F.col("done") == 1) & known, F.col("event.value")).alias("name"), data.alias("data"), F.lit(1).alias("one"))
    return running_before(shown, "session_id", "block", "one", "n").select("session_id", "n", "kind", "name", "data")
