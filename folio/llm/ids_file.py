"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

The files of a folder hold the documents in ascending order of id: each holds a range, sorted. A
row is (shard, doc_id, shard_start, n_tokens, ids); shard_start counts the ids before it in its
file. Readers split files at stripes, and skip stripes and row groups by the statistics and Bloom
filters of doc_id. Reading counts or offsets never touches the ids.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.arrow import map_batches, texts
from folio.llm.pieces import Pieces
from folio.llm.shared import shared_path

#: Fixed values of the writer: stripes that one task reads, row groups that an index can skip.
ORC = {"orc.stripe.size": str(32 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
#: The id that ends a document.
END = 2


#: Parts that a worker remembers with their ids: about 200 bytes each.
ROOM = 600_000
#: Bytes of parts that the library encodes as one text.
JOINED = 100_000


class Encoder:
    """The library's encoding of whole texts, without the tokens that its post-processor adds.

    Parts that no text's end touches are encoded side by side, many in one call of the library; as
    an id spells a known number of bytes, running lengths tell which ids are whose. A text that
    holds an added token, or any text if the vocabulary normalizes or has an added token with a
    blank, is handed to the library as it is.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        if self.library.normalizer or any(" " in x for x in added):
            added = [""]
        self.whole = re.compile("|".join(map(re.escape, added)) if added else r"(?!)").search
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        for spelt, i in self.library.get_vocab().items():
            self.lengths[i] = len(spelt)  # byte-level: one character a byte
        self.pieces = Pieces(self.each, self.joined, ROOM)

    def each(self, several: list[str]) -> list[bytes]:
        return [_packed(x.ids) for x in self.library.encode_batch_fast(several, add_special_tokens=False)]

    def joined(self, parts: list[str]) -> list[bytes]:
        sizes = np.array([len(x.encode()) for x in parts])
        stops = np.cumsum(sizes)
        edges = [0, *np.flatnonzero(np.diff(stops // JOINED)) + 1, len(parts)]
        texts = ["".join(parts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        ids = np.concatenate([np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.concatenate([[0], np.searchsorted(np.cumsum(self.lengths[ids]), stops) + 1]) * 4
        packed, at = ids.tobytes(), ends.tolist()
        return [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        held = {k for k, x in enumerate(texts) if self.whole(x)}
        if not held:
            return self.pieces.packed_all(texts)
        rest = iter(self.pieces.packed_all([x for k, x in enumerate(texts) if k not in held]))
        return [self.each([x])[0] if k in held else next(rest) for k, x in enumerate(texts)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    """One for each vocabulary in a worker."""
    return Encoder(path)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text as the library does, added tokens included, and write the ids with ``end_id`` after each document.

    Texts, not ids, cross the one shuffle: they are smaller. A null text counts as empty (only the
    end id). Rows with a null id come first; rows that repeat an id stand side by side in any order.
    An empty table writes a folder without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, encoder, end = TaskContext.get().partitionId(), 0, _encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                packed = [x + end for x in encoder.packed_all(part.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in packed], np.int64)
                stops = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), part.column("doc_id"), pa.array(start + stops - n), pa.array(n), ids], names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])
                start += int(stops[-1])

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>").write.options(**ORC).orc(path)


_ROWS = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


def _placed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with start, the ids of all documents before, instead of shard and shard_start."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row a file
    bases = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base", "shard", "shard_start")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents that write_ids() wrote: doc_id, n_tokens, ids and start, the ids of all documents before, in order of id."""
    rows = spark.read.schema(_ROWS).orc(path)
    return _placed(rows, rows)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, and what the ids themselves say: their number, and their unsigned crc32 as little-endian integers.

    The ids are reduced where they are read; only numbers are joined.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids")
        offsets, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "doc_id", "shard_start")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(_ROWS).orc(path)
    reduced = map_batches(rows.select("shard", "doc_id", "shard_start", "ids"), each, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    return _placed(reduced, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def byte_50k() -> str:
    """Path of the installed vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, byte_50k())
    return read_checksums(spark, path)
