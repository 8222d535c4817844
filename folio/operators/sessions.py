"""Sessions: events (session_id, seq, ts, ...) to phases, results, outcomes and transcripts.

Every operator works on a batch table; those that need no order work on a stream as well. seq orders
the events of a session; ts never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import frames

#: Schema of a control message; one key of it is set.
CONTROL = "phase string, stderr string, error string, result struct<ok: boolean, frame_id: string, outcome: struct<exited: struct<code: bigint, signal: bigint>, spawn_failed: string, wait_failed: string>, error: string>"


def _by_session():
    return Window.partitionBy("session_id").orderBy("seq")


def phase_durations(phases: DataFrame, ends: DataFrame) -> DataFrame:
    """(session_id, seq, name, ms): each phase lasts to the next one's start, the last to the session's end; never below 0."""
    rows = phases.join(ends.select("session_id", "end_ms"), "session_id", "left")
    until = F.coalesce(F.lead("ms").over(_by_session()), "end_ms")
    return rows.withColumn("until", until).select("session_id", "seq", "name", F.greatest(F.lit(0), F.col("until") - F.col("ms")).cast("long").alias("ms"))


def with_start(phases: DataFrame, submitted: DataFrame, name: str = "starting") -> DataFrame:
    """``phases`` (session_id, seq, name, ms) with the phase that every session of ``submitted`` (session_id, ms) begins in, before all others."""
    seed = submitted.select("session_id", F.lit(-1).cast("long").alias("seq"), F.lit(name).alias("name"), "ms")
    return seed.unionByName(phases.select("session_id", "seq", "name", "ms"))


def current_phase(phases: DataFrame, finished: DataFrame) -> DataFrame:
    """(session_id, name, since_ms) of sessions that haven't finished."""
    return phases.join(finished.select("session_id"), "session_id", "left_anti").groupBy("session_id").agg(F.max_by("name", "seq").alias("name"), F.max_by("ms", "seq").alias("since_ms"))


def command_parents(results: DataFrame) -> DataFrame:
    """(session_id, seq, parent): the version that the last good result before made, else the session's image."""
    before = F.last(F.when(F.col("ok"), F.col("frame_id")), ignorenulls=True).over(_by_session().rowsBetween(Window.unboundedPreceding, -1))
    return results.withColumn("parent", F.coalesce(before, "image")).select("session_id", "seq", "parent")


def overlaps(spans: DataFrame) -> DataFrame:
    """(session_id, seq, overlaps): whether a span starts before some earlier one has ended."""
    ended = F.max("end_ms").over(_by_session().rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("overlaps", F.coalesce(ended > F.col("start_ms"), F.lit(False))).select("session_id", "seq", "overlaps")


def quota(chunks: DataFrame, cap: int) -> DataFrame:
    """(session_id, seq, total): the first chunk whose running total exceeds ``cap``; exactly the cap is allowed."""
    run = chunks.withColumn("total", F.sum("n_bytes").over(_by_session()))
    over = run.where(F.col("total") > cap)
    return over.groupBy("session_id").agg(F.min("seq").alias("seq"), F.min_by("total", "seq").alias("total"))


def outcome(kind: Column, code: Column, signal: Column, text: Column) -> Column:
    """'ok', 'exit N', 'signal N' or 'error: ...' of a step's outcome."""
    return (
        F.when(kind == "spawn_failed", F.concat(F.lit("error: spawn failed: "), F.coalesce(text, F.lit("unknown"))))
        .when(kind == "wait_failed", F.concat(F.lit("error: wait failed: "), F.coalesce(text, F.lit("unknown"))))
        .when(signal.isNotNull(), F.concat(F.lit("signal "), signal.cast("string")))
        .when(F.coalesce(code, F.lit(-1)) == 0, "ok")
        .otherwise(F.concat(F.lit("exit "), F.coalesce(code, F.lit(-1)).cast("string")))
    )


def exit_status(code: Column, signal: Column) -> Column:
    """The signal if there was one, else the code, else -1."""
    return F.coalesce(signal, code, F.lit(-1)).cast("long")


def results(messages: DataFrame, column: str = "data") -> DataFrame:
    """Rows of ``messages`` that end a step, with ok, frame_id and error; unknown or broken JSON is no result."""
    r = messages.withColumn("c", F.from_json(column, CONTROL)).where("c.result IS NOT NULL OR c.error IS NOT NULL")
    good = F.expr("coalesce(c.result.ok, false) AND c.result.frame_id IS NOT NULL")
    error = F.expr("CASE WHEN c.error IS NOT NULL THEN c.error WHEN coalesce(c.result.ok, false) AND c.result.frame_id IS NULL THEN 'ok result has no frame_id' WHEN NOT coalesce(c.result.ok, false) THEN coalesce(c.result.error, 'unknown error') END")
    return r.select(*messages.columns, (good & F.col("c.error").isNull()).alias("ok"), F.when(good, F.col("c.result.frame_id")).alias("frame_id"), error.alias("error"))


def event_decode(events: DataFrame) -> DataFrame:
    """(session_id, seq, kind, text): phase, log, ready and result events; bad JSON drops the first two and is an error for a result; other names are dropped."""
    parsed = F.from_json("data", "name string, line string, ok boolean")
    broken = F.get_json_object("data", "$").isNull()
    kind = F.when(F.col("name").isin("phase", "log") & ~broken, F.col("name")).when(F.col("name") == "ready", "ready").when((F.col("name") == "result") & ~broken, "result").when(F.col("name") == "result", "error")
    text = F.when(F.col("kind") == "phase", F.col("d.name")).when(F.col("kind") == "log", F.col("d.line")).when(F.col("kind") == "result", F.col("d.ok").cast("string")).when(F.col("kind") == "error", "bad result")
    return events.withColumn("d", parsed).withColumn("kind", kind).where("kind IS NOT NULL").select("session_id", "seq", "kind", text.alias("text"))


def base64_text(data: Column) -> Column:
    """Base64 on one line, however long; Spark's own function breaks it after 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def event_encode(session: Column, name: Column, body: Column) -> Column:
    """JSON of an event: one key, the event's name."""
    return F.to_json(F.map_from_arrays(F.array(name), F.array(body)))


def result_ok(frame_id: Column, code: Column, signal: Column) -> Column:
    """JSON of a step's good result."""
    exited = F.when(signal.isNotNull(), F.struct(F.lit(None).cast("bigint").alias("code"), signal.cast("bigint").alias("signal"))).otherwise(F.struct(code.cast("bigint").alias("code"), F.lit(None).cast("bigint").alias("signal")))
    return F.to_json(F.struct(F.struct(F.lit(True).alias("ok"), frame_id.alias("frame_id"), F.struct(exited.alias("exited")).alias("outcome")).alias("result")))


def result_err(error: Column) -> Column:
    """JSON of a step's failure; an error must say something."""
    return F.to_json(F.struct(F.struct(F.lit(False).alias("ok"), F.coalesce(error, F.lit("unknown error")).alias("error")).alias("result")))


def deadlines(sessions: DataFrame, reached: DataFrame, limits: dict[str, int], now_ms: int | Column) -> DataFrame:
    """(session_id, milestone, late_ms): milestones (``limits``: milliseconds after the start) that a session reached late, or hasn't reached though its time is over.

    ``sessions`` (session_id, start_ms); ``reached`` (session_id, milestone, ms), of which the first counts.
    """
    due = sessions.select("session_id", F.explode(F.create_map(*[F.lit(x) for p in limits.items() for x in p])).alias("milestone", "limit"), "start_ms")
    first = reached.groupBy("session_id", "milestone").agg(F.min("ms").alias("at_ms"))
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    late = F.coalesce("at_ms", now) - F.col("start_ms") - F.col("limit")
    return due.join(first, ["session_id", "milestone"], "left").withColumn("late_ms", late.cast("long")).where("late_ms > 0").select("session_id", "milestone", "late_ms")


def transcript(entries: DataFrame) -> DataFrame:
    """(session_id, entry, part, text, seq): header, body, footer, breakdown (if there is one) and a separator between entries, numbered from 1.

    ``entries`` are (session_id, entry, header, body, footer, breakdown); body lines are one text.
    """
    last = F.col("entry") == F.max("entry").over(Window.partitionBy("session_id"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("part"), x.alias("text")) for k, (p, x) in enumerate([*((p, F.col(p)) for p in ("header", "body", "footer", "breakdown")), ("separator", F.when(~F.col("last"), ""))])])
    rows = entries.withColumn("last", last).select("session_id", "entry", F.explode(parts).alias("p")).select("session_id", "entry", "p.*").where("text IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("entry", "k"))
    return rows.withColumn("seq", place.cast("long")).drop("k")


def finalize(sessions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(session_id, state, at_ms, note): the first result ends a session; one that closed without a result is an error, one that was aborted is aborted, others run."""
    first = outcomes.groupBy("session_id").agg(F.min_by(F.struct("ok", "ms", "error"), "seq").alias("r"))
    rows = sessions.join(first, "session_id", "left")
    state = F.when(F.col("r.ok"), "ok").when(F.col("r").isNotNull(), "error").when(F.col("aborted"), "aborted").when(F.col("closed_ms").isNotNull(), "error").otherwise("running")
    note = F.when(F.col("r").isNotNull(), F.col("r.error")).when(F.col("aborted"), F.lit(None)).when(F.col("closed_ms").isNotNull(), "session closed without result")
    return rows.select("session_id", state.alias("state"), F.coalesce("r.ms", "closed_ms").alias("at_ms"), note.alias("note"))


def conformance(messages: DataFrame) -> DataFrame:
    """(session_id, seq, violation): hello first and once, nothing but heartbeats after the terminal, exactly one terminal.

    A session that ends without a terminal is reported at its last message.
    """
    m = messages.where("kind <> 'heartbeat'")
    terminal = F.col("kind").isin("exit", "error")
    before = _by_session().rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(terminal.cast("int")).over(before), F.lit(0))
    hellos = F.coalesce(F.sum((F.col("kind") == "hello").cast("int")).over(before), F.lit(0))
    why = (
        F.when((F.col("n") == 1) & (F.col("kind") != "hello"), "no hello").when((F.col("kind") == "hello") & (F.col("hellos") > 0), "second hello")
        .when(terminal & (F.col("done") > 0), "second terminal").when(F.col("done") > 0, "after terminal").when(F.col("next").isNull() & ~terminal, "ended early")
    )
    rows = m.withColumns({"n": F.row_number().over(_by_session()), "done": done, "hellos": hellos, "next": F.lead("seq").over(_by_session())})
    return rows.select("session_id", "seq", why.alias("violation")).where("violation IS NOT NULL")


def liveness_gaps(beats: DataFrame, limit_ms: int) -> DataFrame:
    """(session_id, seq, gap_ms) where more than ``limit_ms`` passed since the message before."""
    gap = F.col("ms") - F.lag("ms").over(_by_session())
    return beats.withColumn("gap_ms", gap).where(F.col("gap_ms") > limit_ms).select("session_id", "seq", "gap_ms")


def ready_gate(states: DataFrame, closed: DataFrame) -> DataFrame:
    """(key, status): the latest of pending, ready and failed; pending of a closed producer counts as failed."""
    last = states.groupBy("key").agg(F.max_by("status", "seq").alias("status")).join(closed.select("key", F.lit(True).alias("closed")), "key", "left")
    return last.select("key", F.when((F.col("status") == "pending") & F.coalesce("closed", F.lit(False)), "failed").otherwise(F.col("status")).alias("status"))


def stream_concat(chunks: DataFrame) -> DataFrame:
    """(session_id, stream, bytes): each stream's chunks in order of seq."""
    return chunks.groupBy("session_id", "stream").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY seq)").alias("bytes"))


def stderr_lines(chunks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(session_id, line_no, line): lines of stderr chunks that say something, prefixed; only of sessions that didn't end well."""
    bad = outcomes.where("NOT ok").select("session_id")
    said = frames.lines(chunks.join(bad, "session_id", "left_semi")).where("trim(line) <> ''")
    return said.select("session_id", F.col("n").alias("line_no"), F.concat(F.lit("stderr: "), "line").alias("line"))


def commands(lines: DataFrame) -> DataFrame:
    """(session_id, seq, command): trimmed, blank ones dropped, up to the first :q or :quit."""
    c = lines.withColumn("command", F.trim("text"))
    quits = c.where(F.col("command").isin(":q", ":quit")).groupBy("session_id").agg(F.min("seq").alias("quit"))
    return c.join(quits, "session_id", "left").where("command <> '' AND (quit IS NULL OR seq < quit)").select("session_id", "seq", "command")


def section_headers(rows: DataFrame) -> DataFrame:
    """``rows`` with header_seq: the header at or above each; separators have none."""
    head = F.last(F.when(F.col("part") == "header", F.col("seq")), ignorenulls=True).over(_by_session())
    return rows.withColumn("header_seq", F.when(F.col("part") != "separator", head))


def tail(rows: DataFrame, n: int, by: str = "session_id") -> DataFrame:
    """The newest ``n`` rows of each stream."""
    w = Window.partitionBy(by).orderBy(F.col("seq").desc())
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def tail_page(rows: DataFrame, visible: int, scroll: int, by: str = "session_id") -> DataFrame:
    """The ``visible`` rows that a window shows when it is scrolled up by ``scroll`` from the end; never beyond the start."""
    w = Window.partitionBy(by)
    most = F.greatest(F.col("total") - visible, F.lit(0))
    skip = most - F.least(F.lit(scroll), most)
    placed = rows.withColumns({"r": F.row_number().over(w.orderBy("seq")), "total": F.count("*").over(w)})
    return placed.where((F.col("r") > skip) & (F.col("r") <= skip + visible)).drop("r", "total")


def summary_text(state: Column, ms: Column, phases: Column) -> Column:
    """One line on a session: its state, seconds, and phases as 'name Nms · ...'."""
    parts = F.array_join(F.transform(phases, lambda p: F.concat(p["name"], F.lit(" "), p["ms"].cast("string"), F.lit("ms"))), " · ")
    return F.concat(state, F.lit(" "), F.format_string("%.2f", ms / F.lit(1000.0)), F.lit("s · "), parts)
