"""Byte-level BPE by a rank queue: a bitmap of ranks over buckets of positions.

The pieces of a pre-token form a linked list. Every adjacent pair that the vocabulary can merge
lies in the bucket of its rank. A two-level bitmap marks the ranks whose bucket isn't empty, so
find-first-set on two integers gives the next merge; entries that a merge has made stale are skipped
when their bucket is read. A bucket is a heap of positions, since of equal pairs the leftmost merges
first: a pre-token of n bytes takes O(n log n) steps, whatever its ranks.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folio.llm.arrow import map_batches, texts
from folio.llm.pieces import Pieces

#: Pre-tokens from which one queue for all is faster than one for each.
TOGETHER = 5000
#: Bytes from which a pre-token has a queue of its own: in the common one it would merge once a rank and turn.
LONG = 64
#: Distinct pre-tokens that a worker remembers with their ids.
PRE_TOKENS = 200_000
#: Texts that are encoded together; more take fewer queues and more memory.
ROWS = 1000
#: Ranks that share a word of the bitmap.
SPAN = 256


class Bpe:
    """An encoder over ranks {bytes: id}; lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.vocab: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.vocab[rank] = piece
        self.groups = len(self.vocab) // SPAN + 1
        self._pre_tokens: dict[str, bytes] = {}
        self._pieces = Pieces(self._cut)
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the pair of least rank, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # the rank of (part, next part), as it is now
        buckets: dict[int, list[int]] = {}
        words = [0] * self.groups
        marked = 0

        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r // SPAN] |= 1 << r % SPAN
                    marked |= 1 << r // SPAN
        while marked:
            group = (marked & -marked).bit_length() - 1
            word = words[group]
            rank = group * SPAN + (word & -word).bit_length() - 1
            todo = buckets[rank]
            lower = False
            while todo and not lower:  # until a better pair comes up; the rest of this bucket waits as it is
                i = heappop(todo)
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                parts[i] += parts[j]
                pair[j] = None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                for left, right in ((before[i], i), (i, k)):
                    if left < 0 or right >= n:
                        if left == i:
                            pair[i] = None
                        continue
                    r = ranks.get(parts[left] + parts[right])
                    pair[left] = r
                    if r is not None:
                        lower |= r < rank
                        if r in buckets:
                            heappush(buckets[r], left)
                        else:
                            buckets[r] = [left]
                            words[r // SPAN] |= 1 << r % SPAN
                            marked |= 1 << r // SPAN
            if not todo:
                del buckets[rank]
                words[group] &= ~(1 << rank % SPAN)
                if not words[group]:
                    marked &= ~(1 << group)
        out, i = [], 0
        while i < n:
            out.append(ranks[parts[i]])
            i = after[i]
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs of ids (left x number of ids + right) that merge, their ranks, and the id of each byte."""
        if self._table is None:
            ranks, n = self.ranks, len(self.vocab)
            found = [(a * n + b, rank) for piece, rank in ranks.items() for k in range(1, len(piece)) if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None]
            table = np.array(sorted(found), np.int64).reshape(-1, 2)
            self._table = table[:, 0].copy(), table[:, 1].copy(), np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        return self._table

    def _cut(self, several: list[str]) -> list[bytes]:
        """Ids of texts, packed: each match of the pattern is looked up, and what is new is merged together."""
        known, cut = self._pre_tokens, [self.split.findall(x) for x in several]
        new = list({x for found in cut for x in found if x not in known})
        if len(known) + len(new) > PRE_TOKENS:
            known.clear()
            new = list({x for found in cut for x in found})
        if new:
            known.update(zip(new, self.merge_many([x.encode() for x in new]), strict=True))
        return [b"".join([known[x] for x in found]) for found in cut]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many pre-tokens, packed.

        Short ones share a queue: a rank's bucket is then an array of positions. Of a pre-token only
        the leftmost position of a rank merges at a time, and the next rank is sought anew, so each
        goes the way that merge() goes; a turn a position is bounded by LONG. Longer ones, and few
        ones, have a queue each.
        """
        long = {k for k, x in enumerate(pieces) if len(x) >= LONG}
        if len(pieces) - len(long) < TOGETHER:
            return [np.array(self.merge(x), "<u4").tobytes() for x in pieces]
        if long:
            short = iter(self._merge_together([x for k, x in enumerate(pieces) if k not in long]))
            return [np.array(self.merge(x), "<u4").tobytes() if k in long else next(short) for k, x in enumerate(pieces)]
        return self._merge_together(pieces)

    def _merge_together(self, pieces: list[bytes]) -> list[bytes]:
        keys, values, of_byte = self._pairs()
        n_ids, ranks = len(self.vocab), self.ranks
        out = [b"" if (r := ranks.get(x)) is None else r.to_bytes(4, "little") for x in pieces]
        open_at = [k for k, x in enumerate(out) if not x and pieces[k]]
        sizes = np.array([len(pieces[k]) for k in open_at], np.int64)
        n = int(sizes.sum())
        tok = np.append(of_byte[np.frombuffer(b"".join([pieces[k] for k in open_at]), np.uint8)], 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        stops = np.cumsum(sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[stops - 1], before[stops - sizes] = n, -1
        pair = np.full(n + 1, -1, np.int64)
        alive = np.ones(n, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        words, marked = [0] * self.groups, 0

        def rank_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = tok[left] * n_ids + tok[right]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, values[at], -1)

        def push(at: np.ndarray, found: np.ndarray) -> None:
            nonlocal marked
            some = found >= 0
            if not some.any():
                return
            at, found = at[some], found[some]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            heads = np.flatnonzero(np.diff(found, prepend=-1)).tolist()
            for a, b, r in zip(heads, [*heads[1:], len(at)], found[heads].tolist(), strict=True):
                if r in buckets:
                    buckets[r].append(at[a:b])
                else:
                    buckets[r] = [at[a:b]]
                    words[r // SPAN] |= 1 << r % SPAN
                    marked |= 1 << r // SPAN

        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = rank_of(inner, after[inner])
        push(inner, pair[inner])
        while marked:
            group = (marked & -marked).bit_length() - 1
            word = words[group]
            rank = group * SPAN + (word & -word).bit_length() - 1
            words[group] = word = word & (word - 1)
            if not word:
                marked &= marked - 1
            held = buckets.pop(rank)
            todo = np.concatenate(held) if len(held) > 1 else held[0]
            todo = np.unique(todo[pair[todo] == rank])  # the rest is stale
            if not len(todo):
                continue
            first = np.ones(len(todo), bool)
            first[1:] = np.diff(owner[todo]) != 0
            if not first.all():
                push(todo[~first], np.full(int((~first).sum()), rank))
            i = todo[first]
            j = after[i]
            k = after[j]
            tok[i], pair[j], alive[j], after[i] = rank, -1, False, k
            before[k[k < n]] = i[k < n]
            h = before[i]
            right = np.where(k < n, rank_of(i, np.minimum(k, n - 1)), -1)
            left = np.where(h >= 0, rank_of(np.maximum(h, 0), i), -1)
            pair[i], pair[h[h >= 0]] = right, left[h >= 0]
            push(np.concatenate([i, h[h >= 0]]), np.concatenate([right, left[h >= 0]]))
        packed = tok[:n][alive].astype("<u4").tobytes()
        count = np.concatenate([[0], np.cumsum(np.bincount(owner[alive], minlength=len(sizes)))]) * 4
        for k, a, b in zip(open_at, count[:-1].tolist(), count[1:].tolist(), strict=True):
            out[k] = packed[a:b]
        return out

    def ids(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern by itself; no special tokens."""
        return [x for m in self.split.finditer(text) for x in self.merge(m[0].encode())]

    def packed(self, text: str) -> bytes:
        """ids() as little-endian unsigned 32-bit integers."""
        return self._pieces.packed(text)

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """packed() of many texts; what is new to this worker is encoded together."""
        return self._pieces.packed_all(texts)

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Bpe:
    """One encoder for each vocabulary in a worker."""
    return Bpe(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    ``path`` names a vocabulary file that every executor has (it belongs to the installation). A
    null text counts as empty: no ids, the digests of nothing. Rows are independent: repeated rows
    are encoded again, a null id stays null, other columns aren't read. Texts are never cut.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path, pattern)
        n, ids, back, raw = [], [], [], []
        for at in range(0, batch.num_rows, ROWS):
            for packed in bpe.packed_all(batch.column("text").slice(at, ROWS).to_pylist()):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
                if keep_ids:
                    raw.append(packed)
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(back)}
        if keep_ids:
            columns["ids"] = pa.array(raw, pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_batches(texts(docs, id_col, text_col), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def multi_50k() -> tuple[str, str]:
    """Path and pattern of the installed vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), *multi_50k())

