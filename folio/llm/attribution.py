"""Token counts of sections by offset mapping: a document is encoded once, as a whole.

Byte lengths of the ids give each token's span, first in bytes, then in characters. Spans join the
sections' intervals; a token that crosses a boundary goes to one section by a stated rule. Counts
of sections so add up to the document's count, which separate encodings of sections don't.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow import map_batches, texts

#: How a token that crosses a boundary is allocated: to the section of its first character, of its
#: last one, or to the one that holds most of its characters (the earlier of equals).
RULES = ("first", "last", "most")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    from folio.llm.bpe import read_ranks

    ranks = read_ranks(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("attribution", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes at which lines start; a line holds the newline that ends it."""
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    return starts[starts < len(raw)] if len(raw) else starts[:0]


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character and end (exclusive) of every token, and for each byte the number of its character.

    A character that several tokens share belongs to each of their spans.
    """
    encoding, lengths = _encoding(path, pattern)
    raw = np.frombuffer(text.encode(), np.uint8)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    stops = np.cumsum(lengths[ids])
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    if not len(ids):
        return stops, stops, char
    return char[stops - lengths[ids]], char[stops - 1] + 1, char


def allocate(first: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token: an interval join of [first, end) with [bounds[k], bounds[k + 1])."""
    a = np.searchsorted(bounds, first, "right") - 1
    b = np.searchsorted(bounds, end - 1, "right") - 1
    if rule == "first":
        return a
    if rule == "last":
        return b
    out = a.copy()
    for i in np.flatnonzero(a != b):
        k = np.arange(a[i], b[i] + 1)
        held = np.minimum(end[i], np.append(bounds, end[i])[k + 1]) - np.maximum(first[i], bounds[k])
        out[i] = k[np.argmax(held)]
    return out


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "first", starts: Callable[[np.ndarray], np.ndarray] = line_starts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing.

    ``starts`` finds the sections of a text's UTF-8 bytes; by default they are lines. n_crossing
    counts the section's tokens that reach beyond it. A section may have no token. A null or empty
    text has no section; a null id stays null; repeated rows give their sections again.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, parts = [], []
        for at, text in enumerate(batch.column("text").to_pylist()):
            if not text:
                continue
            first, end, char = token_spans(text, path, pattern)
            bounds = char[starts(np.frombuffer(text.encode(), np.uint8))]
            of = allocate(first, end, bounds, rule)
            stops = np.append(bounds[1:], char[-1] + 1)
            crossing = (first < bounds[of]) | (end > stops[of])
            rows.append(np.full(len(bounds), at))
            parts.append(np.stack([np.arange(len(bounds)), bounds, stops, np.bincount(of, minlength=len(bounds)), np.bincount(of[crossing], minlength=len(bounds))]))
        if not rows:
            return None
        flat = np.concatenate(parts, axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(rows))), *map(pa.array, flat)], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return map_batches(texts(docs, id_col, text_col), each, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long")


def field_tokens(docs: DataFrame, path: str, pattern: str, fields: list[str], rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """Sections are the named columns, joined by a newline that belongs to the field before it; null fields are empty.

    The row of a document is doc_id, n_tokens and a map from field to tokens. A field that is named
    again counts once; without fields there are no tokens and the map is empty. A null id stays null;
    repeated rows come out again; other columns aren't read.
    """
    names = list(dict.fromkeys(fields))
    joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).cast("array<string>").alias("parts"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, total = [], []
        for parts in batch.column("parts").to_pylist():
            parts = [p + "\n" for p in parts[:-1]] + parts[-1:]
            first, end, _ = token_spans("".join(parts), path, pattern)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            of = allocate(first, end, bounds, rule) if len(first) else np.zeros(0, int)
            out.append(list(zip(names, np.bincount(of, minlength=len(names)).tolist(), strict=True)))
            total.append(len(first))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(out, pa.map_(pa.string(), pa.int64()))], names=["doc_id", "n_tokens", "fields"])

    return map_batches(joined, each, "doc_id long, n_tokens long, fields map<string, bigint>")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return section_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
