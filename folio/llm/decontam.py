"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage with block-max WAND.

A term's inverted list names the blocks of items that hold it, in order, each with the largest weight
in that block; above it lie lists of ranges of blocks, and ranges of those. Weights are divided by the
item's own threshold, a share of the score that the item's full text gets, so every threshold is 1.

A passage has a cursor in the list of each of its terms. Cursors are kept in order of where they
stand; the pivot is the first place up to which the largest weights reach 1, and cursors before it skip
to it. Where the weights at the pivot reach 1, the range is searched in the same way one level below,
its weights now being the bounds; what lies in other ranges is never read. Items of blocks that are
left are scored in full, and those at 1 or more are verified: the passage must repeat the question's
and the answer's word sequences. Many passages take each step together, in slices of bounded size.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.arrow import encoded, map_batches, text_hash, texts
from folio.llm.shared import shared_path

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
SHARE = 0.6
#: Share of the word triples of question and of answer that the passage must repeat.
OVERLAP = 0.6
#: Words of a sequence that is compared.
GRAM = 3
#: Items of a block, and blocks or ranges of a range.
BLOCK, RANGE = 4, 8
#: Cursors that move together, unless one passage has more.
CURSORS = 1 << 18
#: What rounding may take off a sum of weights.
SLACK = 1e-9
#: Most items of an index that is sent to all executors, and most of their words, unless one item has more;
#: more items make more indexes, each searched by all passages.
INDEX_ITEMS, INDEX_WORDS = 20_000, 1_000_000
#: Texts that are searched together.
TEXTS = 256
#: Raw words whose term a worker remembers.
CACHE = 500_000
#: Characters taken off a word's ends.
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»‹›“”„‘’‚–—…·"


def term(word: bytes) -> str:
    """A word as it is compared: lower case, without marks at its ends."""
    return word.decode(errors="replace").lower().strip(_EDGES)


def terms_of(text: str) -> list[str]:
    return [t for t in map(term, text.encode().split()) if t]


@dataclass
class Level:
    """Inverted lists over blocks, or over ranges of them. Postings are ascending in term x width + place."""

    width: int
    held: np.ndarray
    most: np.ndarray  # largest weight of the term there
    below: np.ndarray | None = None  # where each posting's range starts in the level below, and its end

    def find(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after a place (next_geq); one beyond the list if there is none."""
        return np.searchsorted(self.held, term * self.width + np.minimum(place, self.width))


@dataclass
class Index:
    """Items in blocks, all in flat arrays. Item k has words[word_start[k]:word_start[k + 1]], of which the first ``question[k]`` are its question."""

    ids: np.ndarray
    number: dict[str, int]
    levels: list[Level]  # of blocks, of ranges of blocks, ..., and of all blocks: one posting a term
    word_start: np.ndarray
    words: np.ndarray
    question: np.ndarray
    own_start: np.ndarray  # distinct terms and their weights, by item
    own_terms: np.ndarray
    own_weights: np.ndarray

    def weights(self, item: int) -> dict[int, float]:
        at = slice(self.own_start[item], self.own_start[item + 1])
        return dict(zip(self.own_terms[at].tolist(), self.own_weights[at].tolist(), strict=True))

    def grams(self, item: int) -> tuple[set[tuple[int, ...]], set[tuple[int, ...]]]:
        """Word sequences of question and answer."""
        ids = self.words[self.word_start[item] : self.word_start[item + 1]].tolist()
        return grams(ids[: self.question[item]]), grams(ids[self.question[item] :])


def grams(ids: list[int], n: int = GRAM) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + n]) for i in range(max(1, len(ids) - n + 1))} if ids else set()


def _level(term: np.ndarray, place: np.ndarray, weight: np.ndarray, width: int) -> Level:
    held, at = np.unique(term * width + place, return_inverse=True)
    most = np.zeros(len(held))
    np.maximum.at(most, at, weight)
    return Level(width, held, most)


def build(items: list[tuple[int, list[str], list[str]]], df: dict[str, int], n_items: int, mean_words: float, share: float = SHARE, block: int = BLOCK) -> Index:
    """Index items (id, question terms, answer terms). Items of like length share blocks; items without terms are passed over."""
    items = sorted((x for x in items if x[1] or x[2]), key=lambda x: (len(x[1]) + len(x[2]), x[0]))
    number: dict[str, int] = {}
    words, terms, weights = [], [], []
    for _, question, answer in items:
        mine = [number.setdefault(t, len(number)) for t in question + answer]
        own = {}
        for t, tf in Counter(question + answer).items():
            idf = np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5))
            own[number[t]] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(mine) / mean_words))
        full = sum(own.values()) * share
        words.append(np.array(mine, np.int32))
        terms.append(np.array(list(own), np.int32))
        weights.append(np.array(list(own.values())) / full)
    flat = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
    starts = lambda x: np.cumsum([0, *map(len, x)])
    term, weight = flat(terms, np.int64), flat(weights, np.float64)
    place = np.repeat(np.arange(len(items)), [len(x) for x in terms]) // block
    levels = [_level(term, place, weight, max(1, -(-len(items) // block)))]
    while levels[-1].width > 1 or len(levels) < 2:
        low = levels[-1]
        above = _level(low.held // low.width, low.held % low.width // RANGE, low.most, -(-low.width // RANGE))
        key = low.held // low.width * above.width + low.held % low.width // RANGE
        above.below = np.append(np.searchsorted(key, above.held), len(key))
        levels.append(above)
    return Index(np.array([x[0] for x in items], np.int64), number, levels, starts(words), flat(words, np.int32), np.array([len(x[1]) for x in items], np.int64), starts(terms), flat(terms, np.int32), weight)


def wand(level: Level, group: np.ndarray, term: np.ndarray, bound: np.ndarray, at: np.ndarray, stop: np.ndarray, read: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, place, cursors there) whose weights reach 1, by WAND with a cursor in level.held[at:stop] for each (group, term).

    ``bound`` is the largest weight of the cursor's stretch. Groups are searched side by side. The
    postings that are read are appended to ``read``, if given.
    """
    need, width = 1 - SLACK, level.width
    at, out = at.copy(), []
    cursor = np.flatnonzero(at < stop)
    place = level.held[at[cursor]] - term[cursor] * width
    if read is not None:
        read.append(at[cursor])

    def moved(k: np.ndarray) -> None:
        """Cursors numbered ``cursor[k]`` stand elsewhere now."""
        c = cursor[k]
        there = at[c] < stop[c]
        place[k[there]] = level.held[at[c[there]]] - term[c[there]] * width
        place[k[~there]] = width
        if read is not None:
            read.append(at[c[there]])

    while len(cursor):
        order = np.argsort(group[cursor] * (width + 1) + place, kind="stable")
        cursor, place = cursor[order], place[order]
        own = group[cursor]
        head = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(np.append(head, len(own)))
        reach = np.cumsum(bound[cursor])
        reach -= np.repeat(reach[head] - bound[cursor[head]], size)
        pivot = np.minimum.reduceat(np.where(reach >= need, np.arange(len(own)), len(own)), head)
        live = pivot < len(own)
        goal = np.where(live, place[np.minimum(pivot, len(own) - 1)], width)
        each = np.repeat(goal, size)
        behind = np.flatnonzero((place < each) & np.repeat(live, size))
        at[cursor[behind]] = level.find(term[cursor[behind]], each[behind])
        moved(behind)
        here = (place == each) & np.repeat(live, size)
        k = np.flatnonzero(here)
        weight = np.zeros(len(own))
        weight[k] = level.most[at[cursor[k]]]
        good = live & (np.add.reduceat(weight, head) >= need)
        take = np.flatnonzero(here & np.repeat(good, size))
        out.append((own[take], place[take], cursor[take]))
        at[cursor[k]] += 1
        moved(k)
        stay = np.repeat(live, size) & (place < width)
        cursor, place = cursor[stay], place[stay]
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))


def _slices(group: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts of ascending ``group`` into stretches of about ``most`` rows at most; no group is cut."""
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    out, a = [], 0
    while a < len(group):
        b = edges[max(np.searchsorted(edges, a + most, "right") - 1, np.searchsorted(edges, a, "right"))]
        out.append((a, int(b)))
        a = int(b)
    return out


def candidates(index: Index, passage: np.ndarray, term: np.ndarray, read: list | None = None, cursors: int = CURSORS) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block) that can hold an item at its threshold; the passages' distinct terms come in order of passage and term."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def search(depth: int, passage: np.ndarray, term: np.ndarray, above: np.ndarray) -> None:
        """Rows of a passage, a term and its posting one level above; those of a passage and range lie together."""
        high, low = index.levels[depth + 1], index.levels[depth]
        node = high.held[above] - term * high.width
        group = np.cumsum((np.diff(passage, prepend=-1) != 0) | (np.diff(node, prepend=-1) != 0)) - 1
        for a, b in _slices(group, cursors):
            up, t = above[a:b], term[a:b]
            got, place, c = wand(low, group[a:b], t, high.most[up], high.below[up], high.below[up + 1], None if depth else read)
            if depth:
                order = np.argsort(got * low.width + place, kind="stable")
                c, place = c[order], place[order]
                search(depth - 1, passage[a:b][c], t[c], low.find(t[c], place))
            else:
                where, one = np.unique(got * low.width + place, return_index=True)
                found.append((passage[a:b][c[one]], where % low.width))

    if len(term) and len(index.ids):
        search(len(index.levels) - 2, passage, term, term)  # the top has a posting a term
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*found, strict=True) if found else ((), ())))


def search(index: Index, rows: list[np.ndarray], longest: int, overlap: float = OVERLAP, block: int = BLOCK) -> list[set[int]]:
    """Item numbers that each row's text repeats. Rows are term numbers, -1 for terms that no item has.

    A passage is two stretches of ``longest`` words in a row, so each run of that many words lies in one.
    """
    found: list[set[int]] = [set() for _ in rows]
    size = max(8, longest)
    words = np.array([len(r) for r in rows], np.int64)
    passages = np.maximum(-(-words // size) - 1, 1)
    base = np.cumsum(passages) - passages
    ids = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return found
    row = np.repeat(np.arange(len(rows)), words)[known]
    stretch = (np.arange(len(ids)) - np.repeat(np.cumsum(words) - words, words))[known] // size
    n_terms = len(index.number)
    pairs = [(base[row] + np.clip(stretch - k, 0, passages[row] - 1)) * n_terms + ids[known] for k in (0, 1)]
    pairs = np.sort(np.concatenate(pairs))
    passage, term = np.divmod(pairs[np.diff(pairs, prepend=-1) != 0], n_terms)
    now, have, text, held = -1, set(), [], {}
    for p, k in zip(*(x.tolist() for x in candidates(index, passage, term)), strict=True):
        r = int(np.searchsorted(base, p, "right") - 1)
        if p != now:
            at = (p - int(base[r])) * size
            text = rows[r][at : at + 2 * size].tolist()
            now, have, held = p, set(text), {}
        for item in range(k * block, min(len(index.ids), (k + 1) * block)):
            if item in found[r] or sum(w for x, w in index.weights(item).items() if x in have) < 1 - SLACK:
                continue
            held = held or {n: {tuple(text[i : i + n]) for i in range(len(text) - n + 1)} for n in range(1, GRAM + 1)}
            if all(len(part) == 0 or sum(x in held[len(x)] for x in part) >= overlap * len(part) for part in index.grams(item)):
                found[r].add(item)
    return found


def _halves(words: list[str]) -> tuple[list[str], list[str]]:
    return words[: len(words) // 2], words[len(words) // 2 :]


class Items:
    """Test items cut into terms, with statistics of all of them; index(part) builds the index of one part."""

    def __init__(self, items: DataFrame, id_col: str, question_col: str, answer_col: str | None, index_items: int, share: float):
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            q = [terms_of(x.decode()) for x in encoded(batch.column("q"))]
            a = [terms_of(x.decode()) for x in encoded(batch.column("a"))]
            if answer_col is None:
                q, a = map(list, zip(*map(_halves, q), strict=True))
            kind = pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(q, kind), pa.array(a, kind)], names=["item_id", "q", "a"])

        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        named = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), text(question_col).alias("q"), (text(answer_col) if answer_col else F.lit("")).alias("a"))
        self.cut = map_batches(named, cut, "item_id long, q array<string>, a array<string>")
        words = F.concat("q", "a")
        self.n, mean, longest, total = self.cut.where(F.size(words) > 0).agg(F.count("*"), F.avg(F.size(words)), F.max(F.size(words)), F.sum(F.size(words))).first()
        self.mean, self.longest, self.share = mean or 1.0, longest or 1, share
        self.df = self.cut.select(F.explode(F.array_distinct(words)).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
        self.parts = max(1, -(-self.n // index_items), -(-(total or 0) // INDEX_WORDS))

    def index(self, part: int) -> Index:
        """About ``index_items`` items or INDEX_WORDS words come to the driver, with their terms."""
        own = self.cut.where(F.pmod(F.xxhash64("item_id"), F.lit(self.parts)) == part)
        has = own.select(F.explode(F.concat("q", "a")).alias("t")).distinct()
        counts = {r.t: r.n for r in self.df.join(has, "t", "left_semi").collect()}
        return build([(r.item_id, r.q, r.a) for r in own.collect()], counts, self.n, self.mean, self.share)


def _searched(docs: DataFrame, index: Index, longest: int, overlap: float) -> DataFrame:
    """``docs`` with item_ids instead of text. The index is sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rest = [c for c in docs.columns if c != "text"]
    cache: dict[bytes, int] = {}

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, out = sent.value, []
        number = held.number
        for a in range(0, batch.num_rows, TEXTS):
            numbered = []
            for text in encoded(batch.column("text").slice(a, TEXTS)):
                words = text.split()
                try:
                    ids = [cache[w] for w in words]
                except KeyError:
                    new = {w: number.get(x, -1) if (x := term(w)) else -2 for w in set(words) if w not in cache}
                    if len(cache) + len(new) <= CACHE:
                        cache.update(new)
                    ids = [new[w] if w in new else cache[w] for w in words]
                row = np.array(ids, np.int64)
                numbered.append(row[row != -2])  # marks that stand alone are no words
            out += [sorted({int(held.ids[k]) for k in x}) for x in search(held, numbered, longest, overlap)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, pa.list_(pa.int64()))], names=[*rest, "item_ids"])

    return map_batches(docs, each, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest) + ", item_ids array<long>")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, share: float = SHARE, overlap: float = OVERLAP, index_items: int = INDEX_ITEMS) -> DataFrame:
    """One row per input row: doc_id, contaminated, n_items, item_ids, the items (ascending) that its text repeats, and text_hash.

    With no ``answer_col`` the first half of an item's words is its question and the second half its
    answer. A null or empty text repeats nothing; an item without words, or with a null id, is found
    nowhere; repeated items are found under each id. Passages are twice as long as the longest of
    all items. Items beyond ``index_items`` make several indexes, one after the other: each is
    searched by all passages and its hits are written before the next one is built, so the driver
    holds one. ``index_items`` changes jobs, not results.
    """
    rows = texts(docs, id_col, text_col, text_hash(text_col).alias("text_hash"))  # rows of one id and text get the same items
    known = Items(items, item_id_col, question_col, answer_col, index_items, share)
    if known.parts == 1:
        found = _searched(rows, known.index(0), known.longest, overlap)
    else:
        path = shared_path(docs.sparkSession, "leaks")
        for part in range(known.parts):
            hits = _searched(rows, known.index(part), known.longest, overlap)
            hits.where(F.size("item_ids") > 0).select("doc_id", "text_hash", F.explode("item_ids").alias("i")).write.mode("append").parquet(path)
        hits = docs.sparkSession.read.schema("doc_id long, text_hash long, i long").parquet(path).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.array_sort(F.collect_set("i")).alias("item_ids"))
        found = rows.join(hits, rows.doc_id.eqNullSafe(hits.d) & (rows.text_hash == hits.h), "left").select("doc_id", "text_hash", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "text_hash")


def op8(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items)
