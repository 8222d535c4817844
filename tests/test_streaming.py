"""Processors: any cut of the bytes gives the same frames, and a stream gives what a table gives."""

import random

from pyspark.sql.functions import lit

from folio.operators import frames as framing
from folio.operators import prefixed, tree
from folio.streaming.processors import Frames
from folio.streaming.run import capture, drained, liveness_alarms, replay_dedup, run_batch, run_stream

SSE = b": hi\n\nevent: phase\ndata: one\ndata:two\n\nevent:log\r\ndata: x\r\n\r\ndata: lost\n\nevent: ready\n\nevent: tail\ndata: y"
LENGTH = b"\x00\x00\x00\x00\x03abc\x01\x00\x00\x00\x04\x00\x18\x00\x50\x07\x00\x00\x00\x01z\x00\x00\x00\x00\x00\x00\x00\x00\x00\x09short"


def frames(mode, data, cuts):
    f, out = Frames(mode), []
    for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
        g = Frames(mode)
        g.load(f.dump())
        f = g
        out += f.feed((data[a:b], a))
    return out + f.end()


def test_any_cut_gives_the_same_frames():
    rng = random.Random(3)
    for mode, data in (("sse", SSE), ("length", LENGTH), (b"\0", b"a\0\0bc\0d"), (b"\n", b"x\r\ny\n\nlast")):
        whole = frames(mode, data, [])
        for _ in range(30):
            assert frames(mode, data, sorted(rng.choices(range(len(data)), k=rng.randrange(1, 20)))) == whole
        assert frames(mode, data, range(1, len(data))) == whole
    assert [(k, n, d) for _, k, n, d in frames("sse", SSE, [])] == [("event", "phase", b"one\ntwo"), ("event", "log", b"x"), ("error", None, b"data without event"), ("event", "ready", b""), ("error", None, b"unfinished")]
    assert [(k, n, d) for _, k, n, d in frames("length", LENGTH, [])] == [("input", None, b"abc"), ("resize", "24,80", b""), ("input", None, b"")]
    assert [d for *_, d in frames(b"\n", b"x\r\ny\n\nlast", [])] == [b"x", b"y", b"", b"last"]
    assert frames("length", b"\x00\x7f\x00\x00\x00zz\x00\x00\x00\x00\x00", [])[0][3] == b"frame too long"


def test_frames_by_columns_equal_the_processor(spark):
    """Frames by counting delimiters are those of the processor, for any cut of the bytes and any size of a range."""
    rng = random.Random(9)
    odd = [SSE, b"\n\nevent: a\r\ndata: 1\r\ndata: 2\r\n\r\nevent: b\ndata\n\n\n\ndata:  two\n\nid: 7\n\n", b"", b"\n", b"event: only\n\n", b"event:\ndata: x\n\nevent: k\ndata:\ndata: y\ndata:\ndata: z\n\n", b"x\xff\xfe\ny\xc3\n\nlast\r"]
    rows = []
    for s, data in enumerate([*odd, b"event: e\ndata: v\n\n" * 300]):
        cuts = sorted(rng.choices(range(len(data) + 1), k=len(data) // 4))
        rows += [(s, k, data[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True))]
    rows += [(None, 0, b"q\n"), (3, 10_000, None)]
    df = spark.createDataFrame(rows, "session_id long, seq long, bytes binary").withColumn("n", lit(5)).withColumn("data", lit("clash"))
    for size in (4096, 3):
        framing.running_before.__defaults__ = (size,)
        for mode, got in (("sse", framing.server_events(df)), (b"\n", framing.lines(df).selectExpr("session_id", "n", "'frame' AS kind", "NULL AS name", "line AS data")), (b"\0", framing.delimited(df, b"\0"))):
            if mode == b"\0":
                assert sorted((r.session_id, bytes(r.data)) for r in got.collect()) == [(s, x) for s, x in enumerate([*odd, b"event: e\ndata: v\n\n" * 300]) if x]
                continue
            want = [(s, n, kind, name, data.decode(errors="replace")) for s, n, kind, name, data in map(tuple, run_batch(df, lambda m=mode: Frames(m)).collect())]
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), (mode, size)
    framing.running_before.__defaults__ = (framing.RANGE,)
    assert framing.server_events(df.where("false")).count() == 0


def test_random_streams_by_columns_and_by_the_processor(spark):
    """Line ends of all kinds in random places: both forms of framing give the same rows."""
    rng = random.Random(12)
    parts = [b"\n", b"\n\n", b"\r\n", b"\r\n\r\n", b"\r", b"event:", b"event: a", b"data:", b"data: x", b":", b" ", "\u0085".encode(), "\u2028".encode(), b"\xff", b"y\r"]
    rows = []
    for s in range(400):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        cut = rng.randrange(len(data) + 1)
        rows += [(s, 0, data[:cut]), (s, 1, data[cut:])]
    df = spark.createDataFrame(rows, "session_id long, seq long, bytes binary")
    for size in (4096, 2):
        framing.running_before.__defaults__ = (size,)
        for mode, got in (("sse", framing.server_events(df)), (b"\n", framing.lines(df).selectExpr("session_id", "n", "'frame' AS kind", "NULL AS name", "line AS data"))):
            want = [(s, n, kind, name, data.decode(errors="replace")) for s, n, kind, name, data in map(tuple, run_batch(df, lambda m=mode: Frames(m)).collect())]
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), (mode, size)
    framing.running_before.__defaults__ = (framing.RANGE,)


def test_length_frames_by_ranges_and_by_the_processor(spark):
    """Streams of frames, broken and cut off ones too, in ranges of any size: the rows that one walk from the start gives."""
    rng = random.Random(21)
    frame = lambda kind, body: bytes([kind]) + len(body).to_bytes(4, "big") + body
    streams = [LENGTH, b"", b"\x00", b"\x00\x7f\x00\x00\x00zz", b"\0" * 700, frame(0, b"x" * 3000), frame(0, b"") * 90]
    for k in range(40):
        data = b"".join(frame(rng.choice([0, 0, 1, 1, 9]), rng.randbytes(rng.choice([0, 1, 3, 4, 9, 200, 900]))) for _ in range(rng.randrange(30)))
        streams.append(data + (b"", b"\x00\xff\xff\xff\xff" + b"tail", b"\x00\x00\x00\x01\x00short", b"\x00\x00")[k % 4])
    rows = []
    for s, data in enumerate(streams):
        cuts = sorted(rng.choices(range(len(data) + 1), k=len(data) // 40))
        rows += [(s, 3 * k, data[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True))]
    df = spark.createDataFrame([*rows, (None, 0, b"q"), (2, 10_000, None)], "session_id long, seq long, bytes binary").withColumn("k", lit(5))
    want = sorted(map(str, run_batch(df, lambda: Frames("length")).collect()))
    assert sum("error" in w for w in want) > 5 and sum("resize" in w for w in want) > 50
    for size in (7, 300, 1 << 16):
        assert sorted(map(str, prefixed.length_frames(df, size).collect())) == want, size
    assert prefixed.length_frames(df.where("false")).count() == 0


def test_chunks_of_frames_are_cut_by_offset(spark):
    rows = [(1, 0, b"abc"), (1, 1, b""), (1, 2, None), (1, 3, b"defghijklmno"), (1, 7, b"p"), (2, 0, b"")]
    got = framing.chunks_of(spark.createDataFrame(rows, "session_id long, seq long, bytes binary"), 5)
    assert sorted((r.session_id, r.seq, bytes(r.bytes)) for r in got.collect()) == [(1, 0, b"abcde"), (1, 1, b"fghij"), (1, 2, b"klmno"), (1, 3, b"p")]


def test_idle_sessions_end(spark, tmp_path):
    """A session that falls silent gives its last, unfinished frame, and its state goes."""
    rows = [(1, 0, b"one\ntw", 0), (2, 0, b"a\nb", 500), (1, 1, b"o\nthree", 10)]
    later = [(3, 0, b"z\n", 5000)]
    schema = "session_id long, seq long, bytes binary, s long"
    for part in (rows, later, [(3, 1, b"end", 5001)]):
        spark.createDataFrame(part, schema).selectExpr("session_id", "seq", "bytes", "timestamp_seconds(s + 1000) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, seq long, bytes binary, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(run_stream(stream, lambda: Frames(b"\n"), idle_ms=60_000), str(tmp_path))
    assert sorted((r.session_id, r.n, bytes(r.data)) for r in got.collect()) == [(1, 0, b"one"), (1, 1, b"two"), (1, 2, b"three"), (2, 0, b"a"), (2, 1, b"b"), (3, 0, b"z")]


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for s in range(5):
        data = b"".join(b"event: e%d\ndata: %s\n\n" % (k, rng.randbytes(5).hex().encode()) for k in range(40))
        at = 0
        while at < len(data):
            n = rng.randrange(1, 60)
            rows.append((s, at, data[at : at + n]))
            at += n
    df = spark.createDataFrame(rows, "session_id long, seq long, bytes binary")
    want = sorted(tuple(map(str, r)) for r in run_batch(df, lambda: Frames("sse")).collect())
    for part in range(3):  # three files, in order of seq
        lo, hi = part * 500, (part + 1) * 500 if part < 2 else 1 << 40
        df.where(f"seq >= {lo} AND seq < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_stream(stream, lambda: Frames("sse")).writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(map(str, r)) for r in spark.table("framed").collect()) == want


def test_timers_and_replays(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 5), (1, "b", 600), (2, "a", 0), (2, "c", 5000)], "session_id long, hash string, s long").selectExpr("session_id", "hash", "timestamp_seconds(s) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("alarms", liveness_alarms(stream, 60_000), "append"), ("first", replay_dedup(stream), "append")):
        out.writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {r.session_id for r in spark.table("alarms").collect()} == {1, 2}
    assert sorted(r.hash for r in spark.table("first").collect()) == ["a", "b", "c"]


def test_capture_applies_batches_in_order(spark, tmp_path):
    """Each batch of dirty pages makes the next version; the last equals a build from the final bytes."""
    page, fan = 8, 4
    data = bytearray(b"0" * 60)
    images = lambda: spark.createDataFrame([(0, bytes(data))], "image_id long, bytes binary")
    shape = tree.sizes(images(), page, fan)
    versions = [tree.index_blobs(tree.leaf_rows(tree.paginate(images(), page)), shape, fan).cache()]
    for k in range(3):
        new = bytes([65 + k]) * 8
        data[k * 16 : k * 16 + 8] = new
        spark.createDataFrame([(0, k, k * 2, __import__("hashlib").sha256(new).hexdigest())], "image_id long, seq long, page_no long, hash string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def apply(dirty, n):
        versions.append(tree.updated(versions[-1], tree.last_write_wins(dirty), shape, fan).cache())

    stream = spark.readStream.schema("image_id long, seq long, page_no long, hash string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    capture(stream, apply, str(tmp_path / "c")).awaitTermination()
    assert len(versions) == 4
    built = tree.roots(tree.leaf_rows(tree.paginate(images(), page)), shape, fan).first().root
    assert tree.root_rows(versions[-1], shape).first().root == built
