"""Streams with timers: sessions that share a bucket get what each would get by itself, for a few calls a bucket."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folio.streaming.processors import Deadlines, Protocol
from folio.streaming.timers import _Timed

KINDS = {"at": LongType(), "session_id": LongType(), "seq": LongType(), "kind": StringType(), "at_ms": LongType()}


class Handle:
    """State of one key, and how often it was asked."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getListState(self, name, schema):
        return self._state([])

    getValueState = getListState

    def _state(self, values):
        def called(f):
            def g(*x):
                self.calls += 1
                return f(*x)

            return g

        def put(x):
            values[:] = list(x)

        return SimpleNamespace(exists=called(lambda: bool(values)), get=called(lambda: values[0] if isinstance(values[0], tuple) and len(values[0]) > 1 else list(values)), appendValue=called(values.append), appendList=called(values.extend), put=called(put), update=called(lambda x: put([x])), clear=called(values.clear))


def run(make, rows, cuts, idle):
    """Rows (at, session_id, seq, kind) in micro-batches that end at ``cuts``; what comes out, and the handle."""
    names = ["at", "session_id", "seq", *make().columns]
    p, h = _Timed(make, StructType([StructField(n, KINDS[n]) for n in names]), idle), Handle()
    p.init(h)
    out, mark, clock = [], 0, SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    for a, b in zip([0, *cuts], [*cuts, 1 << 50], strict=True):
        part = pd.DataFrame([r for r in rows if a <= r[0] < b], columns=["at", "session_id", "seq", "kind"])
        if len(part):
            part = part.assign(at_ms=part["at"])
            list(p.handleInputRows((0,), iter([part]), clock))
        mark = b
        while due := sorted(t for t in h.timers if t <= mark):
            h.timers.discard(due[0])
            for got in p.handleExpiredTimer((0,), clock, SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t)):
                out += list(got.itertuples(index=False, name=None))
    return out, h


def test_sessions_of_a_bucket_are_told_apart(spark):
    rng = random.Random(5)
    for make, kinds in ((Protocol, ["hello", "chunk", "exit", "heartbeat"]), (lambda: Deadlines({"a": 50, "b": 400}), ["a", "b", "c"])):
        for _ in range(40):
            rows = [(rng.randrange(2000), rng.randrange(6), k, rng.choice(kinds)) for k in range(60)]
            rng.shuffle(rows)
            cuts = sorted(rng.choices(range(1, 2000), k=rng.randrange(5)))
            got, h = run(make, rows, cuts, 700)
            alone = [x for s in range(6) for x in run(make, [r for r in rows if r[1] == s], [], 700)[0]]
            one = [x for s in range(6) for x in run(make, [r for r in rows if r[1] == s], cuts, 700)[0]]
            assert sorted(got) == sorted(one)
            if not cuts:
                assert sorted(got) == sorted(alone)
            assert not h.timers


def test_calls_follow_batches_and_not_rows(spark):
    rows = [(10 * k, k % 50, k, "chunk") for k in range(3000)]
    out, h = run(Protocol, rows, [10_000, 20_000], 10**6)
    assert len(out) == 100 and h.calls < 100  # no hello, ended early
