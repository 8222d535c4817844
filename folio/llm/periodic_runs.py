"""Periodic runs of words: maximal stretches whose words repeat at a smallest period, at least twice.

Periods are taken by octaves Q .. 2Q - 1. In each a document is cut into overlapping tiles, and a run
crosses a boundary, a multiple of a quarter of Q, with a long match ahead of it. Where texts are read,
hashes of windows say which tiles can hold such a match; only these are dealt out, each a row of its
own. A tile is solved alone: the Z-values of a boundary, how far the words from it agree with those a
period later, forwards and backwards, come from names of all stretches of 1, 2, 4, ... words, for all
periods at once. What comes out are fragments, cut off at the tile's ends; they are shuffled by
document and period, and fragments that overlap by a period are one run. Of periods that share an
interval the smallest counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from folio.llm.arrow import encoded, texts
from folio.llm.shared import written
from folio.llm.words import _BASE, _INVERSE, U64, mix, prefix_sums, span_hashes, words_of

#: Least words of a run.
LEAST = 12
#: Least words of a tile without its overlap.
CORE = 4096
#: Pairs of a boundary and a period that are looked at together.
STEP = 1 << 19


def _octave(q: int) -> tuple[int, int, int]:
    """Distance of boundaries, words that a run's first boundary matches for certain, and words of a tile's core."""
    step = max(1, q // 4)
    return step, min(max(LEAST - p, p) for p in range(q, min(2 * q, q + LEAST))) - step + 1, max(16 * q, CORE)


def _overlap(q: int) -> tuple[int, int]:
    """Words that a tile has before and after its core."""
    return max(2 * q, 32), max(4 * q, 32)


def _hits(names: np.ndarray, step: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(boundary, period) with equal names, for boundaries at multiples of ``step`` and periods q .. 2q - 1; names end in 2q unique ones."""
    ahead = np.lib.stride_tricks.sliding_window_view(names[q:], q)[::step]
    here = names[: len(names) - 2 * q + 1 : step]
    rows = max(1, STEP // q)
    for a in range(0, len(here), rows):
        b, p = np.nonzero(ahead[a : a + rows] == here[a : a + rows, None])
        if len(b):
            yield (a + b) * step, p + q


def marked_tiles(docs: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(document, octave, core) of the tiles that can hold part of a run; documents are word hashes."""
    size = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([*(docs[k] for k in order), np.zeros(0, U64)])
    q = 1
    while (n_docs := int((size >= max(LEAST, 2 * q)).sum())) > 0:
        step, window, core = _octave(q)
        n = size[:n_docs]
        room = (n // step + 1) * step  # at least one word that occurs nowhere else lies between documents
        start = np.cumsum(room) - room
        total = int(room.sum())
        line = mix(np.arange(total + window, dtype=U64) + U64(0x9E3779B97F4A7C15 * q & (1 << 64) - 1))
        line[np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)] = flat[: int(n.sum())]
        sums, at = prefix_sums(line, _BASE), np.arange(total)
        names = np.append(span_hashes(sums, _INVERSE, at, at + window), mix(np.arange(2 * q, dtype=U64) + U64(1 << 60)))
        found = set()
        for b, p in _hits(names, step, q):
            doc = np.searchsorted(start, b, "right") - 1
            own = b + p + window <= start[doc] + n[doc]
            doc, b = doc[own], b[own]
            found.update(np.unique(doc * (1 << 40) + (b - start[doc]) // core).tolist())
        for x in sorted(found):
            yield int(order[x >> 40]), q, x & ((1 << 40) - 1)
        q *= 2


def _named(words: np.ndarray) -> list[np.ndarray]:
    """By level j, names of the stretches of 2^j words: equal names for equal stretches."""
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    while (wide := 1 << len(levels)) <= len(words):
        last = levels[-1]
        pair = last[: len(words) - wide + 1] * (len(words) + 1) + last[wide // 2 : wide // 2 + len(words) - wide + 1]
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    return levels


def boundary_z(levels: list[np.ndarray], b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from b on, and how many before b, equal those p words later."""
    n = len(levels[0])
    x = b.copy()
    for j in range(len(levels) - 1, -1, -1):
        fits = x + p + (1 << j) <= n
        last = len(levels[j]) - 1
        x += (fits & (levels[j][np.minimum(x, last)] == levels[j][np.minimum(x + p, last)])) << j
    y = b.copy()
    for j in range(len(levels) - 1, -1, -1):
        last, z = len(levels[j]) - 1, y - (1 << j)
        y -= ((z >= 0) & (levels[j][np.clip(z, 0, last)] == levels[j][np.clip(z + p, 0, last)])) << j
    return x - b, b - y


def fragments(words: np.ndarray, q: int, first: int, last: int) -> np.ndarray:
    """Rows (period, start, stop) of a tile's stretches of two periods or more that cross its boundaries in first .. last - 1."""
    step, window, _ = _octave(q)
    if len(words) < max(2 * q, window + q):
        return np.zeros((0, 3), np.int64)
    levels = _named(words)
    j = window.bit_length() - 1
    names = np.append(levels[j][first:], -1 - np.arange(2 * q))
    out = [np.zeros((0, 3), np.int64)]
    for b, p in _hits(names, step, q):
        b = b + first
        own = (b < last) & (b + p + window <= len(words))
        b, p = b[own], p[own]
        tail = b + window - (1 << j)
        own = levels[j][tail] == levels[j][tail + p]
        b, p = b[own], p[own]
        ahead, back = boundary_z(levels, b, p)
        own = ahead + back >= p
        out.append(np.unique(np.stack([p, b - back, b + p + ahead], 1)[own], axis=0))
    rows = np.unique(np.concatenate(out), axis=0)
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2], rows[:, 1]))]
    # a stretch that holds a lesser period too, in both lengths, has their common divisor as period: no run's smallest
    new = np.append(True, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1))[: len(rows)]
    least = rows[np.flatnonzero(new)[np.cumsum(new) - 1], 0] if len(rows) else rows[:, 0]
    return rows[new | (rows[:, 2] - rows[:, 1] < rows[:, 0] + least)]


_SCAN = "kind int, doc_id long, key binary, text string, collapsed string, octave long, low long, first long, last long, words binary"
_FIELDS = [x.split()[0] for x in _SCAN.split(", ")]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scanned(docs: DataFrame, digests: bool) -> DataFrame:
    """Kind 0: documents without a marked tile, done; kind 1: the others, with their text; kind 2: their marked tiles."""
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FIELDS)

    def each(ids: list[int | None], raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        words = words_of(raw)
        held = [words.hashes[a:b] for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
        key: dict[int, bytes] = {}
        out, size = [], 0
        for k, q, c in marked_tiles(held):
            if k not in key:
                key[k] = xxh3_128_digest(f"{ids[k]}:".encode() + raw[k])
            core = _octave(q)[2]
            before, after = _overlap(q)
            low, stop = max(0, c * core - before), min(len(held[k]), (c + 1) * core + after)
            dense = np.unique(held[k][low:stop], return_inverse=True)[1].astype(np.int32)
            out.append((2, None, key[k], None, None, q, low, c * core - low, min((c + 1) * core, stop) - low, dense.tobytes()))
            size += dense.nbytes
            if size > 1 << 23:
                yield batch_of(out)
                out, size = [], 0
        for k, (i, t) in enumerate(zip(ids, raw, strict=True)):
            if k in key:
                out.append((1, i, key[k], t.decode(), None, *[None] * 5))
            else:
                parts = t.split()
                out.append((0, i, None, None, _digest(parts) if digests else b" ".join(parts).decode(), *[None] * 5))
        yield batch_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield from each(part.column("doc_id").to_pylist(), encoded(part.column("text")))

    return docs.mapInArrow(run, _SCAN)


def _solved(tiles: DataFrame) -> DataFrame:
    """(key, period, start, stop) of the fragments of all tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, q, low, first, last, words in zip(*(batch.column(c).to_pylist() for c in ("key", "octave", "low", "first", "last", "words")), strict=True):
                rows = fragments(np.frombuffer(words, np.int32), q, first, last)
                keys += [key] * len(rows)
                out.append(rows + np.array([0, low, low]))
            rows = np.concatenate([*out, np.zeros((0, 3), np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(rows[:, k]) for k in range(3))], names=["key", "period", "start", "stop"])

    spread = tiles.repartition("key", "octave", "low")  # a document's tiles are solved in many tasks
    return spread.mapInArrow(run, "key binary, period long, start long, stop long")


def _stitched(found: DataFrame) -> DataFrame:
    """(key, runs): fragments of one period that overlap by it are one run."""
    before = Window.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.withColumn("new", F.when(F.col("start") + F.col("period") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = cut.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    least = whole.groupBy("key", "start", "stop").agg(F.min("period").alias("period")).withColumn("length", F.col("stop") - F.col("start")).where(f"length >= {LEAST} AND length >= 2 * period")
    return least.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))  # at most as many as the document has words


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _collapsed(docs: DataFrame, digests: bool) -> DataFrame:
    """(doc_id, runs, collapsed): a word goes if a run holds it after the run's first period."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(encoded(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                words = text.split()
                deep = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    deep[r["start"] + r["period"]] += 1
                    deep[r["start"] + r["length"]] -= 1
                kept = [words[k] for k in np.flatnonzero(np.cumsum(deep[:-1]) == 0).tolist()]
                out.append(_digest(kept) if digests else b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("runs"), pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text", "runs").mapInArrow(each, f"doc_id long, runs {_RUNS}, collapsed string")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, runs (start, length and period, in words, by start and period), collapsed.

    ``collapsed`` is the text without the words that a run holds after its first period, joined by
    one space, or with ``digests`` its SHA-256. Words are cut at ASCII white space. Null and empty
    texts have no words and no runs. Rows are told apart by id and text, so rows that share a null or
    repeated id have their own results. An empty table gives no rows; other columns aren't read.
    """
    scanned = written(_scanned(texts(docs, id_col, text_col), digests), "scanned")
    found = _solved(scanned.where("kind = 2").select("key", "octave", "low", "first", "last", "words"))
    runs = written(_stitched(found), "runs")
    open_ = scanned.where("kind = 1").select("doc_id", "key", "text").join(runs, "key", "left").withColumn("runs", F.coalesce("runs", F.array().cast(_RUNS)))
    done = scanned.where("kind = 0").select("doc_id", F.array().cast(_RUNS).alias("runs"), "collapsed")
    return done.unionByName(_collapsed(open_, digests))


def _damaged(doc_id: Column, text: Column) -> Column:
    """The contract's damage: from word a on, words of one document in ten are those of the first p from there, again and again."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def spoilt(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")).otherwise("")

    return F.when(h % 10 == 0, F.transform(F.array(words), spoilt)[0]).otherwise(text)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = periodic_runs(docs.select("doc_id", _damaged(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")), digests=True)
    top = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    length = -top.getField("length")
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top.getField("start").alias("start"), length.alias("length"), top.getField("period").alias("period"),
        F.floor(1000 * length / top.getField("period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
