"""Substring deduplication by recompression.

A text is a string of words. Rounds shorten it: a run of one symbol, or a pair of a left and a
right symbol, becomes a new symbol. Which symbols are left or right, and how a new one is named,
follows from hashes of symbols alone, so names are global: equal substrings have equal symbols,
all but near their ends, in whatever text, partition or executor they lie.

Spark then counts symbols, not windows:

1. symbols of round SMALL_ROUNDS that occur once disprove every window around them; symbols of
   later rounds that are long and occur again prove every window within them;
2. windows that neither reaches are counted by 128-bit hashes of their words.

Keys cross a shuffle packed by hash range, each at most once a chunk, whatever its count, so a
passage that a third of all documents hold is no hot key. What comes back is one bit a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow import encoded, texts
from folio.llm.shared import shared_path, written
from folio.llm.words import U64, Words, mix, prefix_sums, span_hashes, words_of

#: Words of a window.
WINDOW = 35
#: Pair rounds whose symbols disprove windows: they are about six words long.
SMALL_ROUNDS = 6
#: Shorter symbols occur again by chance and aren't counted.
SMALL_WORDS = 3
#: Words of a symbol, in windows, from which it is worth counting to prove windows.
LARGE_WINDOWS = 2
#: Rounds after which a text is left as it is.
MOST_ROUNDS = 60
#: Bytes of text of a chunk; a longer text is a chunk by itself.
CHUNK_BYTES = 3_000_000
#: Keys of a bucket, on average.
BUCKET_KEYS = 600_000

_C1, _C2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_I1, _I2 = pow(_C1, -1, 1 << 64), pow(_C2, -1, 1 << 64)
_KEY = np.dtype([("a", U64), ("b", U64)])


@dataclass
class Parsed:
    """What the rounds say of one chunk. Positions count its words."""

    small: np.ndarray  # symbols of the small round that are long enough to count
    small_at: np.ndarray  # their indexes among all symbols of that round
    n_symbols: int
    first: np.ndarray  # for every word, the first symbol that a window starting there surely holds ...
    last: np.ndarray  # ... and the end of those; first >= last: none
    large: np.ndarray  # first words and ends of long symbols: (start, stop) rows in order of start


def _blocks(sym: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Indexes at which runs of equal symbols start; a text's first symbol always starts one."""
    return np.flatnonzero(head | (np.diff(sym, prepend=~sym[:1]) != 0))


def parse(words: Words, window: int = WINDOW) -> Parsed:
    n = len(words.hashes)
    sym, start = words.hashes, np.arange(n + 1, dtype=np.int32)  # start has the end of all words last
    is_head = np.zeros(n + 1, bool)
    is_head[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
    low = np.minimum(np.arange(n, dtype=np.int32), max(n - window, 0))
    high = low + min(window, n)
    index = np.zeros(n + 1, np.int32)
    large: list[np.ndarray] = []
    small = small_at = first = last = None
    n_small = 0

    for turn in range(MOST_ROUNDS):
        if turn == 0 or turn > SMALL_ROUNDS:
            # runs; a run at a window's edge may reach beyond it, so windows lose their first and last run
            at = _blocks(sym, is_head[start[:-1]])
            count = np.diff(np.append(at, len(sym)))
            if turn == 0:
                of = np.repeat(np.arange(len(at), dtype=np.int32), count)
                edges = np.append(at, n).astype(np.int32)
                low, high = edges[of[low] + 1] if n else low, edges[of[high - 1]] if n else high
            grown = count > 1
            sym = np.where(grown, mix(sym[at] * U64(0x2545F4914F6CDD1D) + count.astype(U64)), sym[at])
            start = np.append(start[at], np.int32(n))
            if turn:
                large.append(np.flatnonzero(grown))
                large[-1] = np.stack([start[large[-1]], start[large[-1] + 1]], 1)
        # pairs of a left and a right symbol
        right = (mix(sym + U64(turn * 0x9E3779B9 + 1)) >> U64(63)).astype(bool)
        if turn < SMALL_ROUNDS and n:
            index[start] = np.arange(len(start), dtype=np.int32)
            i = np.minimum(index[np.minimum(low, n - 1)], len(sym) - 1)  # of windows that hold nothing more, any index
            low = np.where((low < high) & right[i], start[i + 1], low)
            j = np.clip(index[high] - 1, 0, len(sym) - 1)
            high = np.where((low < high) & ~right[j], start[j], high)
        pair = np.flatnonzero(~right[:-1] & right[1:] & ~is_head[start[1:-1]]) if len(sym) > 1 else np.zeros(0, int)
        keep = np.ones(len(sym), bool)
        keep[pair + 1] = False
        sym = sym.copy()
        sym[pair] = mix(sym[pair] * U64(0x9FB21C651E98DF25) + mix(sym[pair + 1] + U64(0x632BE59BD9B4E019)))
        fresh = np.zeros(len(sym), bool)
        fresh[pair] = True
        start = np.append(start[:-1][keep], np.int32(n))
        sym, fresh = sym[keep], np.flatnonzero(fresh[keep])
        if turn >= SMALL_ROUNDS - 1:
            large.append(np.stack([start[fresh], start[fresh + 1]], 1))
        if turn == SMALL_ROUNDS - 1:
            index[start] = np.arange(len(start), dtype=np.int32)
            some = low < high
            first, last = np.where(some, index[low], 0), np.where(some, index[high], 0)
            small_at = np.flatnonzero(np.diff(start) >= SMALL_WORDS)
            small, n_small = sym[small_at], len(sym)
        if turn >= SMALL_ROUNDS and len(sym) <= int(is_head.sum()):
            break
    spans = np.concatenate(large) if large else np.zeros((0, 2), np.int32)
    spans = spans[spans[:, 1] - spans[:, 0] >= LARGE_WINDOWS * window]
    return Parsed(small, small_at, n_small, first, last, spans[np.argsort(spans[:, 0], kind="stable")])


def content_keys(words: Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit hashes of the words start:stop."""
    out = np.zeros(len(start), _KEY)
    for name, base, inverse, values in (("a", _C1, _I1, words.hashes), ("b", _C2, _I2, mix(words.hashes ^ U64(0x5851F42D4C957F2D)))):
        out[name] = mix(span_hashes(prefix_sums(values, base), inverse, start, stop) + (stop - start).astype(U64))
    return out


def _window_starts(words: Words, window: int) -> np.ndarray:
    """Whether a whole window of one text starts at each word."""
    n = len(words.hashes)
    left = np.repeat(words.offsets[1:], np.diff(words.offsets)) - np.arange(n)
    return left >= window


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, for each key its place among them, and whether one occurs again."""
    if keys.dtype == _KEY:
        order = np.lexsort((keys["b"], keys["a"]))
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    else:
        order = np.argsort(keys)
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return s[heads], place, np.diff(np.append(heads, len(s))) > 1


def _high(keys: np.ndarray) -> np.ndarray:
    return keys["a"] if keys.dtype == _KEY else keys


def _cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys lie in, in order, and where each starts among them, with the end of all last.

    A bucket holds an equal share of the range of hashes; the cost follows the keys, not the buckets.
    """
    of = ((_high(keys) >> U64(32)) * U64(buckets)) >> U64(32)
    starts = np.flatnonzero(np.diff(of, prepend=~of[:1]) != 0)
    return of[starts].astype(np.int64), np.append(starts, len(keys))


class Chunk:
    """A chunk's texts and what is computed from them."""

    def __init__(self, payload: bytes, sizes: list[int], window: int):
        raw = zstandard.ZstdDecompressor().decompress(payload)
        stops = np.cumsum(sizes).tolist()
        self.texts = [raw[b - a : b] for a, b in zip(sizes, stops, strict=True)]
        self.window = window
        self.words = words_of(self.texts)
        self.parsed = parse(self.words, window)

    def round_keys(self) -> list[np.ndarray]:
        spans = self.parsed.large.astype(np.int64)
        return [self.parsed.small, content_keys(self.words, spans[:, 0], spans[:, 1])]

    def settle(self, again: list[np.ndarray], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that are proven to occur again, those that are neither proven nor disproven, and those to be counted.

        Proven windows count too, since an open window may equal one; but only where their long
        symbol leads, which is one place for all places of it. Of all places of a window the least,
        by chunk and position, is never passed over: a symbol that leads elsewhere holds a lesser one.
        """
        p, n = self.parsed, len(self.words.hashes)
        once = np.zeros(p.n_symbols + 1, np.int32)
        once[p.small_at[~again[0]] + 1] = 1
        once = np.cumsum(once)
        proven, passed = self._inside(p.large[again[1]]), self._inside(p.large[again[1] & ~leads])
        disproven = (p.first < p.last) & (once[p.last] > once[p.first])
        whole = _window_starts(self.words, self.window)
        open_windows = ~proven & ~disproven & whole
        return proven, open_windows, open_windows | (proven & ~passed)

    def _inside(self, spans: np.ndarray) -> np.ndarray:
        n = len(self.words.hashes)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, spans[:, 0], 1)
        np.add.at(cover, spans[:, 1] - self.window + 1, -1)
        return np.cumsum(cover)[:n] > 0

    def window_keys(self, windows: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(windows)
        return content_keys(self.words, at, at + self.window)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of whole texts, about ``chunk_bytes`` each, written once: later rounds see the same chunks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=3)
        ids: list = []
        held: list[bytes] = []

        def row() -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            out = [[(task << 32) + seq], [ids[:]], [[len(t) for t in held]], [squeeze.compress(b"".join(held))], [sum(len(t) for t in held)]]
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()), strict=True)], names=["chunk", "ids", "sizes", "payload", "n_bytes"])

        size = 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), encoded(batch.column("text")), strict=True):
                if held and size + len(text) > chunk_bytes:
                    yield row()
                    size = 0
                ids.append(i)
                held.append(text)
                size += len(text)
        if ids:
            yield row()

    packed = docs.mapInArrow(pack, "chunk long, ids array<long>, sizes array<long>, payload binary, n_bytes long")
    path = shared_path(docs.sparkSession, "chunks")
    packed.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)


def _told(flags: list[dict] | None, plane: str, turn: int, kind: int, distinct: np.ndarray, n_buckets: int) -> np.ndarray:
    """For every distinct key, the bit that came back for it."""
    out = np.zeros(len(distinct), bool)
    buckets, ends = _cuts(distinct, n_buckets)
    place = {b: k for k, b in enumerate(buckets.tolist())}
    for f in flags or ():
        if f["turn"] == turn and f["kind"] == kind:
            a, b = ends[place[f["bucket"]]], ends[place[f["bucket"]] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(f[plane], np.uint8), count=b - a)
    return out


_SENT = "chunk long, turn int, kind int, bucket int, keys binary, many binary"
_FLAGS = "chunk long, turn int, kind int, bucket int, bits binary, leads binary"


def _send(chunk: int, turn: int, kind: int, keys: np.ndarray, n_buckets: int, sure: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of distinct keys by bucket; those of which ``sure`` holds, or that the chunk has twice, are marked."""
    distinct, place, many = _distinct(keys)
    if sure is not None:
        many[place[sure]] = True
    buckets, ends = _cuts(distinct, n_buckets)
    if not len(buckets):
        return
    spans = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    rows = [[chunk] * len(spans), [turn] * len(spans), [kind] * len(spans), buckets.tolist(), [distinct[x].tobytes() for x in spans], [np.packbits(many[x]).tobytes() for x in spans]]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["chunk", "turn", "kind", "bucket", "keys", "many"])


def _count(sent: DataFrame) -> DataFrame:
    """Per chunk and bucket, two bits for each key sent: whether it occurs again anywhere, and whether this chunk is the first of those that have it. Written."""

    def each(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        table = table.sort_by("chunk")
        blobs = [np.frombuffer(x, U64 if kind == 0 else _KEY) for x in table.column("keys").to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for k, m in zip(blobs, table.column("many").to_pylist(), strict=True)]).astype(bool)
        distinct, place, again = _distinct(np.concatenate(blobs))
        again = again | (np.bincount(place[many], minlength=len(distinct)) > 0)
        lead = np.zeros(len(place), bool)
        lead[np.unique(place, return_index=True)[1]] = True
        ends = np.cumsum([len(k) for k in blobs])[:-1]
        planes = [pa.array([np.packbits(f).tobytes() for f in np.split(x, ends)], pa.binary()) for x in (again[place], lead)]
        return pa.table([*(table.column(c) for c in ("chunk", "turn", "kind", "bucket")), *planes], names=["chunk", "turn", "kind", "bucket", "bits", "leads"])

    return written(sent.groupBy("kind", "bucket").applyInArrow(each, _FLAGS), "repeats")


def repeated_words(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the text that stays, words joined by a blank).

    A word is removed if a window of ``window`` words of its text covers it whose word sequence also
    starts elsewhere, in the same text or another. Words are maximal runs without ASCII white space.
    Null, empty and short texts lose nothing. Rows that repeat a text lose all windows of it; ids
    don't matter and may be null. An empty table gives no rows; other columns aren't read.
    """
    rows = texts(docs, id_col, text_col)
    chunks = _chunks(rows, chunk_bytes)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = 1 + int(total / 6 / 5 / bucket_keys)  # a word has about six bytes, a small symbol about five words

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for kind, keys in enumerate(Chunk(r["payload"], r["sizes"], window).round_keys()):
                    yield from _send(r["chunk"], 1, kind, keys, n_buckets)

    def settled(r: dict) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]:
        chunk = Chunk(r["payload"], r["sizes"], window)
        small, large = (_distinct(k) for k in chunk.round_keys())
        again = [_told(r["flags"], "bits", 1, kind, d, n_buckets)[place] for kind, (d, place, _) in enumerate((small, large))]
        leads = np.zeros(len(large[1]), bool)
        leads[np.unique(large[1], return_index=True)[1]] = _told(r["flags"], "leads", 1, 1, large[0], n_buckets)
        return chunk, *chunk.settle(again, leads)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk, proven, _, counted = settled(r)
                yield from _send(r["chunk"], 2, 1, chunk.window_keys(counted), n_buckets, proven[counted])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chunk, hit, _, counted = settled(r)
                distinct, place, _ = _distinct(chunk.window_keys(counted))
                told = _told(r["flags"], "bits", 2, 1, distinct, n_buckets)[place]
                hit[np.flatnonzero(counted)] |= told
                n, bounds = len(hit), chunk.words.offsets.tolist()
                cover = np.zeros(n + 1, np.int32)
                at = np.flatnonzero(hit)
                cover[at] += 1
                cover[at + window] -= 1
                keep = np.cumsum(cover)[:n] <= 0
                gone = np.concatenate([[0], np.cumsum(~keep)])
                removed = [int(gone[b] - gone[a]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                kept = [b" ".join(t.split() if not g else compress(t.split(), keep[a:b].tolist())) for t, g, a, b in zip(chunk.texts, removed, bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(np.diff(chunk.words.offsets).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    def with_flags(*flags: DataFrame) -> DataFrame:
        every = flags[0]
        for f in flags[1:]:
            every = every.unionByName(f)
        by_chunk = every.groupBy("chunk").agg(F.collect_list(F.struct("turn", "kind", "bucket", "bits", "leads")).alias("flags"))
        return chunks.join(by_chunk, "chunk", "left").select("chunk", "ids", "sizes", "payload", "flags")

    first = _count(chunks.select("chunk", "sizes", "payload").mapInArrow(reveal, _SENT))
    second = _count(with_flags(first).mapInArrow(verify, _SENT))
    return with_flags(first, second).mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op2(spark, sf_dir: str) -> DataFrame:
    found = repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


