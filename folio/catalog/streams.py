"""Queries on sessions, frames and logs: A16-A19, B3-B4, B12-B23, B27, W1-W9, O5, S1-S15, D11.

Events of a user are a session; turns of a conversation are its chunks or lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog.fixtures import table
from folio.operators import exclusive, frames, logs, prefixed, sessions, spans
from folio.sources.shared import shared_path, written
from folio.streaming.processors import Deadlines, Finalizer, Frames, Gate, Protocol
from folio.streaming import run
from folio.streaming.run import drained, run_batch, run_stream
from folio.streaming.timers import drained_timed, run_timed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def events(spark: SparkSession, d: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), ms.alias("ms"), F.col("event_type").alias("name"), "value")
    return e


_E = "WITH e AS (SELECT user_id AS session_id, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type AS name, value FROM events) "


_SEEDED = "p AS (SELECT session_id, seq, ms, name FROM e UNION ALL SELECT session_id, -1, min(ms) - 500, 'starting' FROM e GROUP BY 1)"


@query("phase_durations", _E + f", {_SEEDED} SELECT session_id, seq, name, greatest(0, coalesce(lead(ms) OVER (PARTITION BY session_id ORDER BY seq), max(ms) OVER (PARTITION BY session_id)) - ms)::BIGINT AS ms FROM p")
def phase_durations(spark: SparkSession, d: str) -> DataFrame:
    """Sessions are submitted half a second before their first event."""
    e = events(spark, d)
    ends = e.groupBy("session_id").agg(F.max("ms").alias("end_ms"), (F.min("ms") - 500).alias("ms"))
    return sessions.phase_durations(sessions.with_start(e, ends), ends)


@query("current_phase", _E + "SELECT session_id, arg_max(name, seq) AS name, arg_max(ms, seq) AS since_ms FROM e WHERE session_id NOT IN (SELECT session_id FROM e GROUP BY 1 HAVING arg_max(name, seq) = 'purchase') GROUP BY session_id")
def current_phase(spark: SparkSession, d: str) -> DataFrame:
    """A session whose last event is a purchase has finished."""
    e = events(spark, d)
    return sessions.current_phase(e, e.groupBy("session_id").agg(F.max_by("name", "seq").alias("last")).where("last = 'purchase'"))


@query("command_parent", _E + "SELECT session_id, seq, coalesce(last_value(CASE WHEN name <> 'error' THEN 'frm_' || seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'img_' || session_id) AS parent FROM e")
def command_parent(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return sessions.command_parents(e.select("session_id", "seq", (F.col("name") != "error").alias("ok"), F.concat(F.lit("frm_"), "seq").alias("frame_id"), F.concat(F.lit("img_"), "session_id").alias("image")))


_SPAN = "s AS (SELECT session_id, seq, ms AS start_ms, ms + 1000 * (seq % 4000) AS end_ms FROM e)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("session_id", "seq", F.col("ms").alias("start_ms"), (F.col("ms") + 1000 * (F.col("seq") % 4000)).alias("end_ms"))


@query("w5_overlap_pairs", _E + f", {_SPAN} SELECT session_id, seq, coalesce(max(end_ms) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start_ms, false) AS overlaps FROM s")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sessions.overlaps(_spans(spark, d))


@query("overlap_reject", "WITH RECURSIVE " + _E[5:] + f", {_SPAN}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM s), w AS (SELECT session_id, seq, r, true AS accepted, end_ms AS until FROM n WHERE r = 1 UNION ALL SELECT n.session_id, n.seq, n.r, n.start_ms >= w.until, CASE WHEN n.start_ms >= w.until THEN n.end_ms ELSE w.until END FROM w JOIN n ON n.session_id = w.session_id AND n.r = w.r + 1) SELECT session_id, seq, accepted FROM w")
def overlap_reject(spark: SparkSession, d: str) -> DataFrame:
    """Only accepted spans count, so each decision needs the one before."""
    return exclusive.accepted(_spans(spark, d))


@query("log_tail", _E + "SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM e) WHERE r <= 20")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tail(events(spark, d), 20).select("session_id", "seq")


@query("tail_page", _E + "SELECT session_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r, count(*) OVER (PARTITION BY session_id) AS t FROM e) WHERE r > greatest(t - 10, 0) - least(5, greatest(t - 10, 0)) AND r <= greatest(t - 10, 0) - least(5, greatest(t - 10, 0)) + 10")
def tail_page(spark: SparkSession, d: str) -> DataFrame:
    return sessions.tail_page(events(spark, d), 10, 5).select("session_id", "seq")


@query("quota_guard", _E + ", r AS (SELECT session_id, seq, (sum(seq % 5000) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM e) SELECT session_id, min(seq) AS seq, arg_min(total, seq) AS total FROM r WHERE total > 20000 GROUP BY session_id")
def quota_guard(spark: SparkSession, d: str) -> DataFrame:
    return sessions.quota(events(spark, d).withColumn("n_bytes", F.col("seq") % 5000), 20_000)


@query("liveness_gaps", _E + "SELECT * FROM (SELECT session_id, seq, (ms - lag(ms) OVER (PARTITION BY session_id ORDER BY seq))::BIGINT AS gap_ms FROM e) WHERE gap_ms > 3600000")
def liveness_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sessions.liveness_gaps(events(spark, d), 3_600_000)


_LIMITS = {"click": 3_600_000, "purchase": 7_200_000, "signup": 36_000_000}


@query("s12_deadlines", _E + ", s AS (SELECT session_id, min(ms) AS start_ms FROM e GROUP BY 1), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS milestone, {v} AS most" for k, v in _LIMITS.items()) + "), f AS (SELECT session_id, name AS milestone, min(ms) AS at_ms FROM e GROUP BY 1, 2) SELECT session_id, milestone, (coalesce(at_ms, (SELECT max(ms) FROM e)) - start_ms - most)::BIGINT AS late_ms FROM s CROSS JOIN l LEFT JOIN f USING (session_id, milestone) WHERE coalesce(at_ms, (SELECT max(ms) FROM e)) - start_ms - most > 0")
def deadlines(spark: SparkSession, d: str) -> DataFrame:
    """First events of three kinds as milestones; now is the last event of all."""
    e = events(spark, d)
    now = e.agg(F.max("ms")).first()[0]
    return sessions.deadlines(e.groupBy("session_id").agg(F.min("ms").alias("start_ms")), e.select("session_id", F.col("name").alias("milestone"), "ms"), _LIMITS, now)


@query("b20_result_text", _E + """SELECT session_id, seq, CASE WHEN name = 'error' THEN '{"result":{"ok":false,"error":"no room"}}' WHEN seq % 5 = 0 THEN '{"result":{"ok":true,"frame_id":"frm_' || seq || '","outcome":{"exited":{"signal":9}}}}' ELSE '{"result":{"ok":true,"frame_id":"frm_' || seq || '","outcome":{"exited":{"code":' || seq % 3 || '}}}}' END AS json, name <> 'error' AS ok, CASE WHEN name <> 'error' THEN 'frm_' || seq END AS frame_id FROM e""")
def result_text(spark: SparkSession, d: str) -> DataFrame:
    """Results written as JSON and read back."""
    frame = F.concat(F.lit("frm_"), "seq")
    signal = F.when(F.col("seq") % 5 == 0, F.lit(9))
    text = F.when(F.col("name") == "error", sessions.result_err(F.lit("no room"))).otherwise(sessions.result_ok(frame, F.col("seq") % 3, signal))
    return sessions.results(events(spark, d).select("session_id", "seq", text.alias("json")), "json").select("session_id", "seq", "json", "ok", "frame_id")


@query("a16_event_source", "SELECT conv_id AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS n, role AS name, coalesce(text, '') AS data FROM conversations")
def event_source(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as event streams whose chunks come in two parts; frames that lie across both come out whole."""
    block = F.encode(F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.replace(F.col("text"), F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n")), "utf-8")
    path, chunks = shared_path(spark, "source"), written(_chunks(spark, d, block, 61), "chunks")
    for part in ("seq < 3", "seq >= 3"):
        chunks.where(part).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(chunks.schema).parquet(f"{path}/in")
        out = drained(run_stream(source, lambda: Frames("sse")), path)
    return out.select("session_id", "n", "name", F.decode("data", "utf-8").alias("data"))


@query("ready_gate", _E + ", s AS (SELECT session_id AS key, CASE WHEN arg_max(name, seq) IN ('purchase', 'signup') THEN 'ready' WHEN arg_max(name, seq) = 'error' THEN 'failed' ELSE 'pending' END AS status FROM e GROUP BY 1) SELECT key, CASE WHEN status = 'pending' AND key % 2 = 0 THEN 'failed' ELSE status END AS status FROM s")
def ready_gate(spark: SparkSession, d: str) -> DataFrame:
    """Producers with even numbers have closed."""
    e = events(spark, d)
    status = F.when(F.col("name").isin("purchase", "signup"), "ready").when(F.col("name") == "error", "failed").otherwise("pending")
    s = e.select(F.col("session_id").alias("key"), "seq", status.alias("status"))
    return sessions.ready_gate(s, s.where("key % 2 = 0").select("key").distinct())


@query("protocol_check", _E + """, m AS (SELECT session_id, seq, CASE name WHEN 'view' THEN 'hello' WHEN 'click' THEN 'chunk' WHEN 'signup' THEN 'heartbeat' WHEN 'purchase' THEN 'chunk' ELSE 'exit' END AS kind FROM e),
 r AS (SELECT *, row_number() OVER w AS n, coalesce(sum((kind = 'exit')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, coalesce(sum((kind = 'hello')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hellos, lead(seq) OVER w AS nxt FROM m WHERE kind <> 'heartbeat' WINDOW w AS (PARTITION BY session_id ORDER BY seq))
 SELECT session_id, seq, violation FROM (SELECT *, CASE WHEN n = 1 AND kind <> 'hello' THEN 'no hello' WHEN kind = 'hello' AND hellos > 0 THEN 'second hello' WHEN kind = 'exit' AND done > 0 THEN 'second terminal' WHEN done > 0 THEN 'after terminal' WHEN nxt IS NULL AND kind <> 'exit' THEN 'ended early' END AS violation FROM r) WHERE violation IS NOT NULL""")
def protocol_check(spark: SparkSession, d: str) -> DataFrame:
    return sessions.conformance(_messages(spark, d).select("session_id", "seq", "kind"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"view": "hello", "click": "chunk", "signup": "heartbeat", "purchase": "chunk"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("name")), F.lit("exit"))
    return events(spark, d).withColumn("kind", kind)


_CONTROL = """c AS (SELECT session_id, seq, ms, CASE WHEN name = 'error' AND seq % 2 = 0 THEN '{"error":"agent closed"}' WHEN name = 'error' THEN 'not json' WHEN name = 'purchase' AND seq % 3 = 0 THEN '{"result":{"ok":true}}' WHEN name = 'purchase' THEN '{"result":{"ok":true,"frame_id":"frm_' || seq || '"}}' WHEN name = 'signup' AND seq % 2 = 0 THEN '{"result":{"ok":false}}' WHEN name = 'signup' THEN '{"result":{"ok":false,"error":"no room"}}' ELSE '{"phase":"' || name || '"}' END AS data FROM e),
 r AS (SELECT session_id, seq, ms, data LIKE '%frame_id%' AS ok, CASE WHEN data LIKE '%frame_id%' THEN 'frm_' || seq END AS frame_id, CASE WHEN data LIKE '{"error%' THEN 'agent closed' WHEN data LIKE '%frame_id%' THEN NULL WHEN data LIKE '%true%' THEN 'ok result has no frame_id' WHEN data LIKE '%no room%' THEN 'no room' ELSE 'unknown error' END AS error FROM c WHERE data LIKE '{"result%' OR data LIKE '{"error%')"""


def _control(spark: SparkSession, d: str) -> DataFrame:
    """Control messages: good and bad results, errors, phases, and lines that aren't JSON."""
    n, odd = F.col("name"), F.col("seq") % 2 != 0
    data = (
        F.when((n == "error") & ~odd, '{"error":"agent closed"}').when(n == "error", "not json").when((n == "purchase") & (F.col("seq") % 3 == 0), '{"result":{"ok":true}}')
        .when(n == "purchase", F.concat(F.lit('{"result":{"ok":true,"frame_id":"frm_'), "seq", F.lit('"}}'))).when((n == "signup") & ~odd, '{"result":{"ok":false}}').when(n == "signup", '{"result":{"ok":false,"error":"no room"}}')
        .otherwise(F.concat(F.lit('{"phase":"'), "name", F.lit('"}')))
    )
    return events(spark, d).select("session_id", "seq", "ms", data.alias("data"))


@query("result_normalize", _E + f", {_CONTROL} SELECT session_id, seq, ok, frame_id, error FROM r")
def result_normalize(spark: SparkSession, d: str) -> DataFrame:
    return sessions.results(_control(spark, d)).select("session_id", "seq", "ok", "frame_id", "error")


@query("session_finalize", _E + f""", {_CONTROL}, f AS (SELECT session_id, arg_min(ok, seq) AS ok, arg_min(ms, seq) AS ms, arg_min(coalesce(error, ''), seq) AS error FROM r GROUP BY 1), s AS (SELECT session_id, session_id % 7 = 0 AS aborted, CASE WHEN session_id % 3 = 0 THEN max(ms) END AS closed_ms FROM e GROUP BY 1)
 SELECT session_id, CASE WHEN ok THEN 'ok' WHEN ok IS NOT NULL THEN 'error' WHEN aborted THEN 'aborted' WHEN closed_ms IS NOT NULL THEN 'error' ELSE 'running' END AS state, coalesce(f.ms, closed_ms) AS at_ms, CASE WHEN ok IS NOT NULL THEN nullif(error, '') WHEN aborted THEN NULL WHEN closed_ms IS NOT NULL THEN 'session closed without result' END AS note FROM s LEFT JOIN f USING (session_id)""")
def session_finalize(spark: SparkSession, d: str) -> DataFrame:
    ended = events(spark, d).groupBy("session_id").agg(F.max("ms").alias("end"))
    s = ended.select("session_id", (F.col("session_id") % 7 == 0).alias("aborted"), F.when(F.col("session_id") % 3 == 0, F.col("end")).alias("closed_ms"))
    return sessions.finalize(s, sessions.results(_control(spark, d)))


def _streamed(spark: SparkSession, df: DataFrame, make, name: str) -> DataFrame:
    """What a processor with timers gives of ``df`` (session_id, seq, ms, ...) when it comes as a stream in three parts; a session far in the future moves the clock on."""
    path = shared_path(spark, name)
    rows = written(df.withColumn("ts", F.timestamp_millis("ms")).drop("ms"), name)
    low, high = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    later = rows.limit(1).withColumns({"session_id": F.lit(-1).cast("long"), "ts": F.timestamp_millis(F.lit(high) + 10 * 365 * 86_400_000)})
    cuts = [low - 1, low + (high - low) // 3, low + 2 * (high - low) // 3, high]
    stream = lambda: run_timed(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), make, 400 * 86_400_000)
    for part in (*(rows.where((F.unix_millis("ts") > a) & (F.unix_millis("ts") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)), later):
        part.write.mode("append").parquet(f"{path}/in")
        out = drained_timed(stream, spark, path)
    return out.where("session_id <> -1")


@query("s8_stream", _E + f""", {_CONTROL}, f AS (SELECT session_id, arg_min(ok, seq) AS ok, arg_min(ms, seq) AS ms, arg_min(coalesce(error, ''), seq) AS error FROM r GROUP BY 1), s AS (SELECT session_id, session_id % 7 = 0 AS aborted, CASE WHEN session_id % 3 = 0 THEN max(ms) END AS closed_ms FROM e GROUP BY 1)
 SELECT session_id, CASE WHEN ok THEN 'ok' WHEN ok IS NOT NULL THEN 'error' WHEN aborted THEN 'aborted' WHEN closed_ms IS NOT NULL THEN 'error' ELSE 'running' END AS state, CASE WHEN ok IS NOT NULL THEN f.ms ELSE closed_ms END AS at_ms, CASE WHEN ok IS NOT NULL THEN nullif(error, '') WHEN aborted THEN NULL WHEN closed_ms IS NOT NULL THEN 'session closed without result' END AS note FROM s LEFT JOIN f USING (session_id)""")
def finalize_stream(spark: SparkSession, d: str) -> DataFrame:
    """session_finalize on a stream: results as they come, the rest when a session has been silent."""
    said = sessions.results(_control(spark, d)).select("session_id", "seq", "ms", F.lit("result").alias("kind"), "ok", "error")
    ended = events(spark, d).groupBy("session_id").agg(F.max("seq").alias("seq"), F.max("ms").alias("ms"))
    none = [F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("error")]
    kinds = F.filter(F.array(F.lit("open"), F.when(F.col("session_id") % 7 == 0, "abort"), F.when(F.col("session_id") % 3 == 0, "close")), lambda k: k.isNotNull())
    marks = ended.select("session_id", (F.col("seq") + 1).alias("seq"), "ms", F.explode(kinds).alias("kind"), *none)
    return _streamed(spark, said.unionByName(marks), Finalizer, "finalize")


@query("s9_stream", ORACLES["protocol_check"])
def protocol_stream(spark: SparkSession, d: str) -> DataFrame:
    """protocol_check on a stream."""
    return _streamed(spark, _messages(spark, d).select("session_id", "seq", "ms", "kind"), Protocol, "protocol")


@query("s12_stream", ORACLES["s12_deadlines"].replace("SELECT session_id, milestone, (coalesce(at_ms, (SELECT max(ms) FROM e)) - start_ms - most)::BIGINT AS late_ms FROM", "SELECT session_id, milestone, (start_ms + most)::BIGINT AS due_ms FROM").replace("coalesce(at_ms, (SELECT max(ms) FROM e)) - start_ms - most > 0", "coalesce(at_ms, 1 << 60) > start_ms + most"))
def deadline_stream(spark: SparkSession, d: str) -> DataFrame:
    """s12_deadlines on a stream: timers fire where a milestone isn't reached in time."""
    return _streamed(spark, events(spark, d).select("session_id", "seq", "ms", F.col("name").alias("kind")), lambda: Deadlines(_LIMITS), "deadlines")


@query("s13_stream", ORACLES["ready_gate"].replace("SELECT key,", "SELECT key AS session_id,"))
def gate_stream(spark: SparkSession, d: str) -> DataFrame:
    """ready_gate on a stream; producers with even numbers close after their last event."""
    e = events(spark, d)
    status = F.when(F.col("name").isin("purchase", "signup"), "ready").when(F.col("name") == "error", "failed").otherwise("pending")
    closed = e.where("session_id % 2 = 0").groupBy("session_id").agg((F.max("seq") + 1).alias("seq"), F.max("ms").alias("ms")).withColumn("kind", F.lit("close"))
    return _streamed(spark, e.select("session_id", "seq", "ms", status.alias("kind")).unionByName(closed), Gate, "gate")


@query("s15_stream", "SELECT hash, count(*) AS n FROM (SELECT DISTINCT sha256(event_type || ':' || (event_id % 100)) AS hash FROM events) GROUP BY hash")
def replay_stream(spark: SparkSession, d: str) -> DataFrame:
    """Commits that come again and again as a stream: each hash once."""
    path = shared_path(spark, "replays")
    e = table(spark, d, "events").select(F.sha2(F.concat("event_type", F.lit(":"), F.col("event_id") % 100), 256).alias("hash"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{path}/in")
    once = drained(run.replay_dedup(spark.readStream.schema(e.schema).parquet(f"{path}/in"), "3650 days"), path)
    return once.groupBy("hash").agg(F.count("*").alias("n"))


@query("outcome_class", _E + "SELECT session_id, seq, CASE WHEN seq % 11 = 0 THEN 'error: spawn failed: ENOENT' WHEN seq % 13 = 0 THEN 'error: wait failed: unknown' WHEN seq % 5 = 0 THEN 'signal 9' WHEN seq % 3 = 0 THEN 'ok' ELSE 'exit ' || (seq % 3) END AS outcome, CASE WHEN seq % 5 = 0 THEN 9 ELSE seq % 3 END AS status FROM e")
def outcome_class(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    kind = F.when(s % 11 == 0, "spawn_failed").when(s % 13 == 0, "wait_failed").otherwise("exited")
    signal, code = F.when(s % 5 == 0, 9), s % 3
    return events(spark, d).select("session_id", "seq", sessions.outcome(kind, code, signal, F.when(s % 11 == 0, "ENOENT")).alias("outcome"), sessions.exit_status(code, signal).alias("status"))


@query("event_encode", _E + "SELECT session_id, seq, '{\"' || name || '\":\"' || to_base64(encode(name || ':' || seq)) || '\"}' AS json FROM e")
def event_encode(spark: SparkSession, d: str) -> DataFrame:
    body = sessions.base64_text(F.encode(F.concat("name", F.lit(":"), "seq"), "utf-8"))
    return events(spark, d).select("session_id", "seq", sessions.event_encode(F.col("session_id"), F.col("name"), body).alias("json"))


@query("event_decode", _E + """SELECT session_id, seq, CASE name WHEN 'view' THEN 'phase' WHEN 'click' THEN 'log' WHEN 'signup' THEN 'ready' WHEN 'purchase' THEN CASE WHEN seq % 4 = 0 THEN 'error' ELSE 'result' END END AS kind, CASE name WHEN 'view' THEN 'p' || seq WHEN 'click' THEN 'l' || seq WHEN 'purchase' THEN CASE WHEN seq % 4 = 0 THEN 'bad result' ELSE 'true' END END AS text FROM e WHERE name <> 'error' AND NOT (name IN ('view', 'click') AND seq % 4 = 0)""")
def event_decode(spark: SparkSession, d: str) -> DataFrame:
    """One payload in four is broken."""
    n = F.col("name")
    name = F.when(n == "view", "phase").when(n == "click", "log").when(n == "signup", "ready").when(n == "purchase", "result").otherwise("other")
    data = F.when(F.col("seq") % 4 == 0, '{"cut').otherwise(F.concat(F.lit('{"name":"p'), "seq", F.lit('","line":"l'), "seq", F.lit('","ok":true}')))
    return sessions.event_decode(events(spark, d).select("session_id", "seq", name.alias("name"), data.alias("data")))


_LINES = "WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) "


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _chunks(spark: SparkSession, d: str, encoded, size: int) -> DataFrame:
    """A conversation's encoded turns as one byte stream, cut into chunks of ``size`` bytes that ignore all boundaries."""
    t = _turns(spark, d)
    return frames.chunks_of(t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), encoded.alias("bytes")), size)


_FRAMED = "(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS n"


@query("sse_reframe", _LINES + f"SELECT conv_id AS session_id, {_FRAMED}, 'event' AS kind, role AS name, text AS data FROM t")
def sse_reframe(spark: SparkSession, d: str) -> DataFrame:
    """Events come out as they went in, wherever chunks were cut."""
    block = F.encode(F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.replace(F.col("text"), F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n")), "utf-8")
    return frames.server_events(_chunks(spark, d, block, 61))


@query("delim_reframe", _LINES + f"SELECT conv_id AS session_id, {_FRAMED}, text AS data FROM t")
def delim_reframe(spark: SparkSession, d: str) -> DataFrame:
    return frames.delimited(_chunks(spark, d, F.encode(F.concat("text", F.lit("\0")), "utf-8"), 47), b"\0").select("session_id", "n", F.decode("data", "utf-8").alias("data"))


@query("length_reframe", _LINES + f"SELECT conv_id AS session_id, {_FRAMED}, 'input' AS kind, NULL::VARCHAR AS name, text AS data FROM t")
def length_reframe(spark: SparkSession, d: str) -> DataFrame:
    raw = F.encode("text", "utf-8")
    head = F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(F.octet_length(raw)), 8, "0")))
    return prefixed.length_frames(_chunks(spark, d, F.concat(head, raw), 53), 512).withColumn("data", F.decode("data", "utf-8"))


@query("line_reframe", _LINES + ", l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t) SELECT conv_id AS session_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::BIGINT AS n, line FROM l")
def line_reframe(spark: SparkSession, d: str) -> DataFrame:
    return frames.lines(_chunks(spark, d, F.encode(F.concat("text", F.lit("\n")), "utf-8"), 40))


@query("b13_trim", "WITH t AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) || chr(13) || chr(133) || chr(10) || 'x' || chr(13) || chr(8232) || chr(10) || 'end' || chr(13) || chr(13), chr(10)) AS p FROM documents) SELECT doc_id AS session_id, (k - 1)::BIGINT AS n, rtrim(line, chr(13)) AS line FROM (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS k FROM t)")
def trimmed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end in CR LF, and carriage returns before other line ends, which stay."""
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\n")), F.lit("\r\u0085\nx\r\u2028\nend\r\r"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.lit(0).cast("long").alias("seq"), F.encode(text, "utf-8").alias("bytes"))
    return frames.lines(chunks)


@query("stream_concat", _LINES + "SELECT conv_id AS session_id, CASE WHEN role = 'assistant' THEN 'stdout' ELSE 'stderr' END AS stream, sha256(string_agg(text, '' ORDER BY turn)) AS hash FROM t GROUP BY 1, 2")
def stream_concat(spark: SparkSession, d: str) -> DataFrame:
    c = _turns(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "stdout").otherwise("stderr").alias("stream"), F.encode("text", "utf-8").alias("bytes"))
    return sessions.stream_concat(c).select("session_id", "stream", F.sha2("bytes", 256).alias("hash"))


@query("stderr_lines", _LINES + ", s AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS b FROM t WHERE role <> 'assistant' AND conv_id % 3 <> 0 GROUP BY 1), l AS (SELECT conv_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) - 1 AS k FROM s) SELECT conv_id AS session_id, k::BIGINT AS line_no, 'stderr: ' || rtrim(line, chr(13)) AS line FROM l WHERE trim(line) <> ''")
def stderr_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns that the assistant didn't write are chunks of stderr; two sessions in three ended badly."""
    t = _turns(spark, d).where("role <> 'assistant'")
    chunks = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.encode(F.concat("text", F.lit("\n")), "utf-8").alias("bytes"))
    return sessions.stderr_lines(chunks, t.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 3 == 0).alias("ok")).distinct())


@query("command_filter", _LINES + ", c AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN ':q' ELSE trim(text, ' ') END AS command FROM t), q AS (SELECT session_id, min(seq) AS quit FROM c WHERE command = ':q' GROUP BY 1) SELECT session_id, seq, command FROM c LEFT JOIN q USING (session_id) WHERE command <> '' AND (quit IS NULL OR seq < quit)")
def command_filter(spark: SparkSession, d: str) -> DataFrame:
    """Turns as commands; even conversations quit at their fourth turn."""
    text = F.when((F.col("turn") == 3) & (F.col("conv_id") % 2 == 0), ":q").otherwise(F.col("text"))
    return sessions.commands(_turns(spark, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), text.alias("text")))


_PARTS = _LINES + ", p AS (SELECT conv_id AS session_id, turn, 0 AS k, 'header' AS part, role AS text FROM t UNION ALL SELECT conv_id, turn, 1, 'body', text FROM t UNION ALL SELECT conv_id, turn, 2, 'footer', length(text) || ' characters' FROM t UNION ALL SELECT conv_id, turn, 3, 'breakdown', 'turn ' || turn FROM t WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 4, 'separator', '' FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS most FROM t) WHERE turn < most), r AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY turn, k))::BIGINT AS seq FROM p)"


def _transcript(spark: SparkSession, d: str) -> DataFrame:
    """Turns as entries; the assistant's have a breakdown."""
    t = _turns(spark, d)
    entry = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("entry"), F.col("role").alias("header"), F.col("text").alias("body"), F.concat(F.length("text").cast("string"), F.lit(" characters")).alias("footer"), F.when(F.col("role") == "assistant", F.concat(F.lit("turn "), "turn")).alias("breakdown"))
    return sessions.transcript(entry)


@query("transcript", _PARTS + " SELECT session_id, seq, part, text FROM r")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return _transcript(spark, d).select("session_id", "seq", "part", "text")


@query("section_header", _PARTS + " SELECT session_id, seq, part, CASE WHEN part <> 'separator' THEN last_value(CASE WHEN part = 'header' THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq) END AS header_seq FROM r")
def section_header(spark: SparkSession, d: str) -> DataFrame:
    return sessions.section_headers(_transcript(spark, d)).select("session_id", "seq", "part", "header_seq")


@query("log_format", _E + "SELECT session_id, (ms * 1000) || 'us [' || name || '] value ' || seq AS line FROM e")
def log_format(spark: SparkSession, d: str) -> DataFrame:
    """Log lines of sessions appended to their logs by two writers, and read back."""
    path = shared_path(spark, "log")
    line = logs.log_format(F.col("ms") * 1000, F.col("name"), F.concat(F.lit("value "), "seq"))
    e = events(spark, d).select("session_id", "seq", line.alias("line"))
    for k in range(2):
        logs.append_log(e.where(f"seq % 2 = {k}"), path)
    return logs.read_log(spark, path).select("session_id", "line")


@query("log_parse", _E + "SELECT session_id, seq, ms * 1000 AS ts_us, name AS prefix, 'value ' || seq AS line FROM e WHERE seq % 10 <> 0")
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    """Formatted lines read back; one in ten is no log line."""
    line = F.when(F.col("seq") % 10 == 0, "noise [x] y").otherwise(logs.log_format(F.col("ms") * 1000, F.col("name"), F.concat(F.lit("value "), "seq")))
    return logs.log_parse(events(spark, d).select("session_id", "seq", line.alias("value")))


@query("log_union", "SELECT 'guest' AS source, user_id AS session_id, event_id AS seq FROM events UNION ALL SELECT 'boot', conv_id, turn FROM conversations")
def log_union(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("session_id", "seq")
    return logs.log_union({"guest": e, "boot": table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"))})


@query("log_progress", _E + "SELECT session_id, seq, CASE WHEN seq % 4 = 0 THEN 'plain ' || name WHEN seq % 4 = 1 THEN 'building ' || seq WHEN seq % 4 = 2 THEN 'said ' || seq END AS text FROM e WHERE seq % 4 <> 3")
def log_progress(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq") % 4
    say = lambda a, key, text: F.concat(F.lit('@nix {"action":"' + a + '","' + key + '":"' + text), "seq", F.lit('"}'))
    line = F.when(k == 0, F.concat(F.lit("plain "), "name")).when(k == 1, say("start", "text", "building ")).when(k == 2, say("msg", "msg", "said ")).otherwise(F.lit("@nix {broken"))
    return events(spark, d).select("session_id", "seq", logs.progress(line).alias("text")).where("text IS NOT NULL")


@query("json_outputs", _E + "SELECT session_id, seq, CASE WHEN seq % 3 = 0 THEN '/nix/store/' || seq END AS path, CASE WHEN seq % 3 = 1 THEN 'no output at 0' WHEN seq % 3 = 2 THEN 'wrong number: 2' END AS error FROM e")
def json_outputs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq") % 3
    data = F.when(k == 0, F.concat(F.lit('[{"outputs":{"out":"/nix/store/'), "seq", F.lit('"}}]'))).when(k == 1, '[{"outputs":{}}]').otherwise('[{"outputs":{}},{"outputs":{}}]')
    return events(spark, d).select("session_id", "seq", F.explode(logs.json_outputs(data, 1)).alias("o")).select("session_id", "seq", "o.path", "o.error")


@query("path_guard", "SELECT page_id, regexp_full_match(p, '/nix/store/[A-Za-z0-9/_.+=-]*') AS allowed FROM (SELECT page_id, '/nix/store/' || regexp_replace(url, '^https?:/', '') AS p FROM pages)")
def path_guard(spark: SparkSession, d: str) -> DataFrame:
    """URLs as paths below the store."""
    p = F.concat(F.lit("/nix/store/"), F.regexp_replace("url", "^https?:/", ""))
    return table(spark, d, "pages").select("page_id", logs.path_allowed(p).alias("allowed"))


@query("b22_level_tag", _E + "SELECT session_id, seq, CASE name WHEN 'view' THEN 'INF' WHEN 'click' THEN 'DBG' WHEN 'signup' THEN 'WRN' WHEN 'error' THEN 'ERR' ELSE '???' END AS tag FROM e")
def level_tag(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    level = F.when(n == "view", "info").when(n == "click", "Debug").when(n == "signup", "WARN").otherwise(n)
    return events(spark, d).select("session_id", "seq", logs.level_tag(level).alias("tag"))


@query("error_kind_lookup", "SELECT event_id, event_id % 25 AS code, CASE WHEN event_id % 25 BETWEEN 1 AND 19 THEN event_id % 25 ELSE 0 END AS back FROM events")
def error_kind_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Codes to kinds and back: what has no kind becomes 0."""
    c = F.col("event_id") % 25
    return table(spark, d, "events").select("event_id", c.alias("code"), logs.error_code(logs.error_kind(c)).alias("back"))


_HEX = "CASE WHEN event_id % 5 = 0 THEN substr(sha256(event_type), 2) WHEN event_id % 5 = 1 THEN upper(sha256(event_type)) WHEN event_id % 5 = 2 THEN 'x' || substr(sha256(event_type), 2) ELSE sha256(event_type) END"


@query("hex_validate", f"SELECT event_id, CASE WHEN event_id % 5 NOT IN (0, 2) THEN sha256(event_type) END AS hash, CASE WHEN event_id % 5 = 0 THEN 'length 63' WHEN event_id % 5 = 2 THEN 'digit at 0' END AS reason FROM (SELECT *, {_HEX} AS h FROM events)")
def hex_validate(spark: SparkSession, d: str) -> DataFrame:
    k, h = F.col("event_id") % 5, F.sha2("event_type", 256)
    text = F.when(k == 0, F.substring(h, 2, 63)).when(k == 1, F.upper(h)).when(k == 2, F.concat(F.lit("x"), F.substring(h, 2, 63))).otherwise(h)
    return table(spark, d, "events").select("event_id", logs.hex_decode(text).alias("x")).select("event_id", F.lower(F.hex("x.raw")).alias("hash"), "x.reason")


@query("b4_base64", "SELECT page_id, sha256(html) AS hash, to_base64(encode(url)) AS head FROM pages WHERE html IS NOT NULL AND page_id % 3 <> 0")
def base64(spark: SparkSession, d: str) -> DataFrame:
    """Pages through base64 and back; every third payload is broken, and what doesn't decode is dropped."""
    sent = sessions.base64_text(F.encode("html", "utf-8"))
    sent = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("*"), sent)).otherwise(sent)
    p = table(spark, d, "pages").withColumn("raw", F.try_to_binary(sent, F.lit("base64"))).where("raw IS NOT NULL")
    return p.select("page_id", F.sha2("raw", 256).alias("hash"), sessions.base64_text(F.encode("url", "utf-8")).alias("head"))


@query("b12_lossy_text", "SELECT doc_id, sha256(chr(65533) || coalesce(text, '') || chr(65533) || '!') AS hash, length(coalesce(text, '')) + 3 AS n_chars FROM documents")
def lossy_text(spark: SparkSession, d: str) -> DataFrame:
    """Text from bytes with a bad one before and after it: what is whole comes through unchanged, a bad byte as U+FFFD."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.coalesce("text", F.lit("")), "utf-8"), F.unhex(F.lit("C3")), F.encode(F.lit("!"), "utf-8"))
    text = F.call_function("make_valid_utf8", raw.cast("string"))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("hash"), F.length(text).cast("long").alias("n_chars"))


@query("span_summary", "SELECT o_orderpriority AS component, count(*) AS n, round(avg(o_totalprice), 4) AS mean_ms, max(o_totalprice) AS most_ms, sum((o_totalprice > 200000)::INT)::BIGINT AS beyond FROM orders GROUP BY 1")
def span_summary(spark: SparkSession, d: str) -> DataFrame:
    """Orders as spans: priority as component, price as its milliseconds."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("component")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_ms"), F.max("o_totalprice").alias("most_ms"), F.sum((F.col("o_totalprice") > 200000).cast("int")).cast("long").alias("beyond"))


@query("d11_version_spans", _E + """, s AS (SELECT session_id AS version, name AS component, seq % 97 AS ms FROM e), r AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY version, component) AS n FROM s WINDOW w AS (PARTITION BY version, component ORDER BY ms)),
 c AS (SELECT version, component, count(*) AS n, sum(ms)::BIGINT AS total_ms, max(ms) AS most_ms, min(CASE WHEN r >= 0.5 * n THEN ms END)::DOUBLE AS p50, min(CASE WHEN r >= 0.95 * n THEN ms END)::DOUBLE AS p95 FROM r GROUP BY 1, 2)
 SELECT *, total_ms / nullif(sum(total_ms) OVER (PARTITION BY version), 0) AS share, sum(total_ms) OVER (PARTITION BY version) > 500 AS over FROM c""")
def version_spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans of their user's version: time by component, its percentiles, and whether the version takes longer than half a second."""
    e = events(spark, d)
    return spans.version_report(e.select(F.col("session_id").alias("version"), F.col("name").alias("component"), (F.col("seq") % 97).alias("ms")))


@query("session_summary_text", _E + ", p AS (SELECT session_id, name, count(*) * 10 AS ms FROM e GROUP BY 1, 2) SELECT session_id, 'ok ' || printf('%.2f', sum(ms) / 1000.0) || 's · ' || string_agg(name || ' ' || ms || 'ms', ' · ' ORDER BY name) AS line FROM p GROUP BY 1")
def session_summary_text(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).groupBy("session_id", "name").agg((F.count("*") * 10).alias("ms"))
    s = p.groupBy("session_id").agg(F.sum("ms").alias("ms"), F.array_sort(F.collect_list(F.struct("name", "ms"))).alias("phases"))
    return s.select("session_id", sessions.summary_text(F.lit("ok"), F.col("ms"), F.col("phases")).alias("line"))


@query("replay_dedup", "SELECT hash, min(event_id) AS event_id FROM (SELECT sha256(event_type || ':' || (event_id % 100)) AS hash, event_id FROM events) GROUP BY hash")
def replay_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Commits delivered again and again: the first of each counts."""
    e = table(spark, d, "events").select(F.sha2(F.concat("event_type", F.lit(":"), F.col("event_id") % 100), 256).alias("hash"), "event_id")
    return e.groupBy("hash").agg(F.min("event_id").alias("event_id"))
