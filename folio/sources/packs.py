"""Pack files: many blobs in one file, with an index at its end, as a Spark data source.

A pack is its blobs end to end, then the index (a line of JSON: hashes, offsets and lengths), then the
index's length as eight bytes and MARK. spark.dataSource.register(PackSource) gives

    blobs.write.format("folio-packs").mode("append").save(path)   # (hash, bytes)
    spark.read.format("folio-packs").load(path)                   # (hash, pack, offset, len, bytes)
    spark.readStream.format("folio-packs").load(path)             # the same, of packs as they come

A pack is read by stretches of about SPAN bytes, each a partition that reads the index and its own
stretch. range_read() reads only the ranges it is asked for. Paths are those of pyarrow.fs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

MARK = b"FOLIOPK1"
#: Bytes of a pack, unless one blob has more, and of a stretch that a partition reads.
PACK, SPAN = 1 << 27, 1 << 26
#: Ranges of a pack that lie at most so many bytes apart are read as one.
GAP = 1 << 16
ROW = "hash string, pack string, offset bigint, len bigint, bytes binary"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def names(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the packs in a folder, in order of name; files still being written have another ending."""
    disk, top = _at(path)
    found = disk.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name.endswith(".pack"))


def index_of(file: pa.NativeFile) -> list[tuple[str, int, int]]:
    """(hash, offset, len) of a pack's blobs, from its end alone."""
    size = file.size()
    tail = file.read_at(16, size - 16) if size >= 16 else b""
    if tail[8:] != MARK:
        raise ValueError("not a pack file")
    n = int.from_bytes(tail[:8], "big")
    x = json.loads(file.read_at(n, size - 16 - n))
    return list(zip(x["hash"], x["offset"], x["len"], strict=True))


@dataclass
class Stretch(InputPartition):
    pack: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    packs: list[str]


def _stretches(packs: list[tuple[str, int]]) -> list[Stretch]:
    return [Stretch(name, a, a + SPAN) for name, size in packs for a in range(0, max(size, 1), SPAN)]


def _read(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    """Blobs that start in a stretch, in batches of bounded size."""
    disk, top = _at(path)
    with disk.open_input_file(f"{top}/{part.pack}") as file:
        mine = [x for x in index_of(file) if part.start <= x[1] < part.stop]
        held, size = [], 0
        for h, offset, n in mine:
            held.append((h, part.pack, offset, n, file.read_at(n, offset)))
            size += n
            if size > 1 << 24:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hash", "pack", "offset", "len", "bytes"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Stretch]:
        return _stretches(names(self.path)) or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.pack:
            yield from _read(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are names: a batch has the packs whose names come after the last one's."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        found = names(self.path)
        return {"after": found[-1][0] if found else ""}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return _stretches([x for x in names(self.path) if start["after"] < x[0] <= end["after"]])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from _read(self.path, partition)


class _Writer(DataSourceArrowWriter):
    """A task fills packs of about PACK bytes; they get their names when all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        if overwrite:
            raise ValueError("packs are only ever added: use mode('append')")
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        disk, top = _at(self.path)
        disk.create_dir(top, recursive=True)
        made, out, index, at = [], None, [], 0

        def close() -> None:
            nonlocal out, index, at
            text = json.dumps(dict(zip(("hash", "offset", "len"), map(list, zip(*index, strict=True)), strict=True))).encode()
            out.write(text + len(text).to_bytes(8, "big") + MARK)
            out.close()
            out, index, at = None, [], 0

        for batch in iterator:
            for name, data in zip(batch.column("hash").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if data is None or name is None:
                    continue
                if out is None:
                    made.append(f"{self.job}-{uuid.uuid4().hex}")
                    out = disk.open_output_stream(f"{top}/{made[-1]}.part", buffer_size=1 << 20)
                out.write(data)
                index.append((name, at, len(data)))
                at += len(data)
                if at >= PACK:
                    close()
        if out is not None:
            close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        """Packs of later commits have later names, so a stream meets them in order."""
        disk, top = _at(self.path)
        before = names(self.path)
        number = int(before[-1][0].split("-")[0]) + 1 if before else 0
        for name in sorted(x for m in messages if m for x in m.packs):
            disk.move(f"{top}/{name}.part", f"{top}/{number:012d}-{name}.pack")

    def abort(self, messages: list[Written | None]) -> None:
        disk, top = _at(self.path)
        for x in (x for m in messages if m for x in m.packs):
            disk.delete_file(f"{top}/{x}.part")


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio-packs"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def index(spark, path: str) -> DataFrame:
    """(hash, pack, offset, len) of all packs of a folder; only their ends are read."""
    packs = spark.createDataFrame([(n,) for n, _ in names(path)], "pack string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = _at(path)
        for batch in batches:
            for name in batch.column("pack").to_pylist():
                with disk.open_input_file(f"{top}/{name}") as file:
                    rows = index_of(file)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([name] * len(rows)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["hash", "pack", "offset", "len"])

    return packs.repartition(max(1, min(packs.count(), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "hash string, pack string, offset bigint, len bigint")


def range_read(wanted: DataFrame, path: str, gap: int = GAP) -> DataFrame:
    """(hash, pack, offset, len, bytes) of ranges (hash, pack, offset, len) of the packs in ``path``.

    Ranges are dealt by pack and stretch, so a pack is many tasks' work; a task opens a pack once a
    stretch and reads neighbouring ranges together, and nothing that lies more than ``gap`` bytes from
    any. A range beyond the end of its pack fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = _at(path)
        name, file = None, None

        def flush(held: list[tuple]) -> pa.RecordBatch:
            start, stop = held[0][2], max(r[2] + r[3] for r in held)
            data = file.read_at(stop - start, start)
            rows = [(h, p, at, n, data[at - start : at - start + n]) for h, p, at, n in held]
            if any(len(r[4]) < r[3] for r in rows):
                raise ValueError(f"range beyond the end of {name}")
            return _batch(rows)

        held: list[tuple] = []
        stop = 0  # where the farthest range held ends
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "pack", "offset", "len")), strict=True):
                if held and (row[1] != name or row[2] - stop > gap or stop - held[0][2] > 1 << 24):
                    yield flush(held)
                    held, stop = [], 0
                if row[1] != name:
                    if file:
                        file.close()
                    name, file = row[1], disk.open_input_file(f"{top}/{row[1]}")
                held.append(row)
                stop = max(stop, row[2] + row[3])
        if held:
            yield flush(held)
        if file:
            file.close()

    rows = wanted.select("hash", "pack", F.col("offset").cast("long").alias("offset"), F.col("len").cast("long").alias("len"))
    return rows.repartition("pack", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("pack", "offset").mapInArrow(run, ROW)


def write_files(files: DataFrame, path: str) -> int:
    """Write each row (name, bytes) as a file of the folder ``path``; returns how many. A task that is tried again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = _at(path)
        disk.create_dir(top, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                with disk.open_output_stream(f"{top}/{name}") as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return files.select("name", "bytes").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
