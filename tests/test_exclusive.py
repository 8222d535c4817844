"""Exclusive spans: ranges and pointer doubling against the processor that takes one span after the other."""

import random

import numpy as np
import pytest

from folio.operators import exclusive
from folio.streaming.processors import NEVER, Exclusive
from folio.streaming.run import run_batch, run_stream

_SCHEMA = "session_id long, seq long, start_ms long, end_ms long"


def _same(df, size):
    want = {(r.session_id, r.seq): r.accepted for r in run_batch(df, Exclusive).collect()}
    rows = exclusive.accepted(df, size).collect()
    got = {(r.session_id, r.seq): r.accepted for r in rows}
    assert len(rows) == len(got) and got == want
    return want


def _spans(rng, session, n, longest, back):
    out, now = [], 0
    for i in range(n):
        now += rng.choice((0, 0, 1, 2, 9))
        start = now - rng.choice((0, 0, 0, back))
        end = start + rng.choice((0, 1, longest, rng.randrange(longest + 1), -3))
        out.append((session, i, start, end))
    return out


@pytest.mark.parametrize("size", [3, 4096])
def test_equal_to_the_processor(spark, size):
    rng = random.Random(size)
    rows = [x for s, (n, longest, back) in enumerate([(300, 6, 4), (300, 200, 30), (300, 0, 0), (1, 5, 0), (40, 3, 50), (150, 40, 0)]) for x in _spans(rng, s, n, longest, back)]
    want = _same(spark.createDataFrame(rows, _SCHEMA).repartition(5), size)
    assert len(set(want.values())) == 2


def test_nulls_ties_open_spans_and_no_rows(spark):
    rows = [
        (1, 0, None, 9), (1, 1, 5, 5), (1, 2, 5, 5), (1, 3, 5, 2), (1, 4, 4, 9), (1, 5, 5, None), (1, 6, 99, 100), (1, 7, None, None),
        (2, 0, None, None), (3, 0, 7, 1), (3, 1, 6, 8), (3, 2, 7, 9), (3, 3, 8, 9), (3, 4, 9, 9), (None, 0, 1, 2),
        (4, 0, -(1 << 62), 1 << 62), (4, 1, 1 << 62, NEVER), (4, 2, NEVER, NEVER),
    ]
    df = spark.createDataFrame(rows, _SCHEMA)
    for size in (1, 4096):
        want = _same(df, size)
    assert [want[1, k] for k in range(8)] == [False, True, True, True, False, True, False, False] and (None, 0) not in want
    assert exclusive.accepted(df.limit(0)).collect() == []


def test_one_long_session_is_many_ranges(spark):
    """Spans that all wait for one another's end: the walk enters every range, and some it leaps over."""
    df = spark.range(20_000).selectExpr("7L AS session_id", "id AS seq", "id AS start_ms", "CASE WHEN id % 5000 = 0 THEN id + 1234 ELSE id + 1 + id % 3 END AS end_ms")
    _same(df, 64)


def test_exits_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        starts = np.sort(rng.integers(0, 40, n))
        ends = starts + rng.integers(0, 12, n)
        want = []
        for i in range(n):
            while True:
                later = [j for j in range(i + 1, n) if starts[j] >= ends[i]]
                if not later:
                    break
                i = later[0]
            want.append(ends[i])
        assert exclusive.exits(starts, ends).tolist() == want


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    rows = [(s, 1000 * s + i, t, e) for s in range(3) for i, (t, e) in enumerate([(1, 4), (3, 5), (4, 4), (None, 9), (4, 12), (11, 13), (12, None), (50, 60)])]
    df = spark.createDataFrame(rows, _SCHEMA)
    for part in ("seq % 1000 < 3", "seq % 1000 IN (3, 4)", "seq % 1000 > 4"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = run_stream(stream, Exclusive).writeStream.format("memory").queryName("exclusive").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("exclusive").collect()) == sorted(tuple(r) for r in exclusive.accepted(df).collect())
