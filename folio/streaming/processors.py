"""Per-session processors whose next step depends on what they did before; plain Python, one row at a time.

Each has feed(row) -> output rows, end() -> output rows when the session is over, and a state of a few
numbers and a tail of bytes, which dump() and load() carry between micro-batches.
"""

from __future__ import annotations

import json
import struct

#: Longest payload of a length-prefixed frame; beyond it the stream is out of step.
LONGEST = 1 << 20


class Frames:
    """Cut a session's chunks into frames. mode: 'sse', 'length', or the delimiter's bytes."""

    columns = ("bytes",)
    schema = "session_id long, n long, kind string, name string, data binary"

    def __init__(self, mode: str | bytes):
        self.mode, self.tail, self.n, self.dead = mode, b"", 0, False

    def dump(self) -> str:
        return json.dumps([self.tail.hex(), self.n, self.dead])

    def load(self, text: str) -> None:
        tail, self.n, self.dead = json.loads(text)
        self.tail = bytes.fromhex(tail)

    def _out(self, kind: str, name: str | None, data: bytes) -> tuple:
        self.n += 1
        return self.n - 1, kind, name, data

    def feed(self, row: tuple) -> list[tuple]:
        if self.dead or row[0] is None:
            return []
        data = self.tail + bytes(row[0])
        out: list[tuple] = []
        at = 0
        if self.mode == "length":
            while len(data) - at >= 5:
                kind, size = struct.unpack_from(">BI", data, at)
                if size > LONGEST:
                    self.dead = True
                    out.append(self._out("error", None, b"frame too long"))
                    break
                if len(data) - at - 5 < size:
                    break
                body = data[at + 5 : at + 5 + size]
                at += 5 + size
                if kind == 0:
                    out.append(self._out("input", None, body))
                elif kind == 1 and size >= 4:
                    out.append(self._out("resize", "{},{}".format(*struct.unpack_from(">HH", body)), b""))
        elif self.mode == "sse":
            while True:
                ends = [(k, len(x)) for x in (b"\n\n", b"\r\n\r\n") if (k := data.find(x, at)) >= 0]
                if not ends:
                    break
                stop, width = min(ends)
                out += self._block(data[at:stop])
                at = stop + width
        else:
            *whole, last = data.split(self.mode)
            out += [self._out("frame", None, self._trim(x)) for x in whole]
            at = len(data) - len(last)
        self.tail = b"" if self.dead else data[at:]
        return out

    def _trim(self, frame: bytes) -> bytes:
        return frame.rstrip(b"\r") if self.mode == b"\n" else frame

    def _block(self, block: bytes) -> list[tuple]:
        name, data = None, []
        for line in block.replace(b"\r\n", b"\n").split(b"\n"):
            key, sep, value = line.partition(b":")
            value = value[1:] if value.startswith(b" ") else value
            if sep and key == b"event":
                name = value.decode(errors="replace")
            elif sep and key == b"data":
                data.append(value)
        if name is None and not data:
            return []
        if not name:
            return [self._out("error", None, b"data without event")]
        while data and not data[0]:
            data.pop(0)
        return [self._out("event", name, b"\n".join(data))]

    def end(self) -> list[tuple]:
        if not self.tail or self.dead:
            return []
        if self.mode == b"\n":
            return [self._out("frame", None, self._trim(self.tail))]
        return [self._out("error", None, b"unfinished")] if self.mode == "sse" and self.tail.strip(b"\r\n") else []


#: The end of a span that hasn't ended.
NEVER = (1 << 63) - 1


def _none(x: object) -> bool:
    """Null, which a micro-batch's numbers show as NaN."""
    return x is None or x != x


class Exclusive:
    """Accept a span if the last accepted one has ended when it starts.

    A span without start is refused, one without end stays open; one that ends before it starts lasts no time.
    """

    columns = ("start_ms", "end_ms")
    schema = "session_id long, seq long, accepted boolean"

    def __init__(self):
        self.until: int | None = None

    def dump(self) -> str:
        return json.dumps(self.until)

    def load(self, text: str) -> None:
        self.until = json.loads(text)

    def feed(self, row: tuple) -> list[tuple]:
        start, end, seq = row
        ok = not _none(start) and (self.until is None or start >= self.until)
        if ok:
            self.until = NEVER if _none(end) else max(int(start), int(end))
        return [(seq, ok)]

    def end(self) -> list[tuple]:
        return []


class Finalizer:
    """How a session ends: by its first result; else aborted, closed without a result, or still running. kind: 'result', 'close', 'abort' or anything else."""

    columns = ("kind", "at_ms", "ok", "error")
    schema = "session_id long, state string, at_ms long, note string"

    def __init__(self):
        self.decided, self.aborted, self.closed = False, False, None

    def dump(self) -> str:
        return json.dumps([self.decided, self.aborted, self.closed])

    def load(self, text: str) -> None:
        self.decided, self.aborted, self.closed = json.loads(text)

    def feed(self, row: tuple) -> list[tuple]:
        kind, at, ok, error = row[:4]
        if kind == "result" and not self.decided:
            self.decided = True
            return [("ok" if ok else "error", int(at), error)]
        if kind == "abort":
            self.aborted = True
        elif kind == "close":
            self.closed = int(at)
        return []

    def end(self) -> list[tuple]:
        if self.decided:
            return []
        if self.aborted:
            return [("aborted", self.closed, None)]
        return [("running", None, None) if self.closed is None else ("error", self.closed, "session closed without result")]


class Protocol:
    """Violations of the order of messages: hello first and once, one terminal (exit or error), and only heartbeats after it."""

    columns = ("kind",)
    schema = "session_id long, seq long, violation string"

    def __init__(self):
        self.n, self.hellos, self.done, self.last = 0, 0, 0, None

    def dump(self) -> str:
        return json.dumps([self.n, self.hellos, self.done, self.last])

    def load(self, text: str) -> None:
        self.n, self.hellos, self.done, self.last = json.loads(text)

    def feed(self, row: tuple) -> list[tuple]:
        kind, seq = row[0], int(row[-1])
        if kind == "heartbeat":
            return []
        terminal, why = kind in ("exit", "error"), None
        if not self.n and kind != "hello":
            why = "no hello"
        elif kind == "hello" and self.hellos:
            why = "second hello"
        elif self.done:
            why = "second terminal" if terminal else "after terminal"
        self.n, self.hellos, self.done = 1, self.hellos + (kind == "hello"), self.done + terminal
        # a last message that breaks no other rule and ends nothing is known as such when the session is over
        self.last = None if why or terminal else seq
        return [(seq, why)] if why else []

    def end(self) -> list[tuple]:
        return [] if self.last is None else [(self.last, "ended early")]


class Deadlines:
    """Milestones that a session hasn't reached in time. ``limits``: milliseconds after its first message."""

    columns = ("kind", "at_ms")
    schema = "session_id long, milestone string, due_ms long"

    def __init__(self, limits: dict[str, int]):
        self.limits, self.start, self.reached = limits, None, {}

    def dump(self) -> str:
        return json.dumps([self.start, self.reached])

    def load(self, text: str) -> None:
        self.start, self.reached = json.loads(text)

    def feed(self, row: tuple) -> list[tuple]:
        kind, at = row[0], int(row[1])
        self.start = at if self.start is None else self.start
        if kind in self.limits:
            self.reached.setdefault(kind, at)
        return []

    def timers(self) -> list[int]:
        """Times at which on_time() must be called."""
        return [] if self.start is None else sorted({self.start + x for x in self.limits.values()})

    def on_time(self, now: int) -> list[tuple]:
        due = [(k, self.start + x) for k, x in sorted(self.limits.items()) if self.start + x == now]
        return [(k, at) for k, at in due if self.reached.get(k, at + 1) > at]

    def end(self) -> list[tuple]:
        return []


class Gate:
    """The last of a producer's states pending, ready and failed; one that has closed and is still pending has failed."""

    columns = ("kind",)
    schema = "session_id long, status string"

    def __init__(self):
        self.status, self.closed = None, False

    def dump(self) -> str:
        return json.dumps([self.status, self.closed])

    def load(self, text: str) -> None:
        self.status, self.closed = json.loads(text)

    def feed(self, row: tuple) -> list[tuple]:
        if row[0] == "close":
            self.closed = True
        elif row[0] in ("pending", "ready", "failed"):
            self.status = row[0]
        return []

    def end(self) -> list[tuple]:
        return [] if self.status is None else [("failed" if self.closed and self.status == "pending" else self.status,)]
