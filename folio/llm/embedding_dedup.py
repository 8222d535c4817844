"""Near-duplicate embeddings by an inverted multi-index, verified by cosine in double precision.

Vectors are cut in halves, each with a codebook of its own; a cell of the product grid is a pair of
codewords. Every vector is listed in its nearest cell, and searches the cells nearest to it by the
multi-sequence order, the sum of its distances to both codewords. How many cells it visits comes
from the target recall: vectors of the sample are turned towards others by just the angle of the
threshold, and the visits suffice for that share of them to find their twin's cell, or be found from
it. A pair is found when either side visits the other's cell, and counted once.

Copies of one vector are one class. Groups of near copies that the sample shows get a pivot; what lies
within half the threshold's angle of one pivot is linked by the triangle inequality, so a group that
holds a third of all rows is counted without pairing it with itself. All other pairs of a cell are
compared block by block on whole vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from folio.llm.arrow import map_batches
from folio.llm.components import connected_components
from folio.llm.shared import written

#: Least cosine of a link, and the share of links at just that cosine which visits must find.
COSINE, RECALL = 0.9, 0.99
#: Most vectors, those with the least hash, that codebooks, visits and pivots are fitted on; the driver holds them.
SAMPLE = 20_000
#: Vectors of the sample near a pivot; so there are at most SAMPLE / HEAVY pivots.
HEAVY = 8
#: Vectors of an average cell, and most codewords of a half; larger tables have larger cells.
PER_CELL, CODEWORDS = 512, 512
#: Most vectors of either side that a task compares.
BLOCK = 2000


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(packed: list[bytes], width: int, dim: int) -> np.ndarray:
    """Unit vectors of packed ones (``width`` bytes a number), filled up with zeros to ``dim``."""
    kind = np.float32 if width == 4 else np.float64
    out = np.zeros((len(packed), dim))
    sizes = np.array([len(x) for x in packed]) // width
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[at, :n] = np.frombuffer(b"".join([packed[k] for k in at]), kind).reshape(len(at), n)
    return _unit(out)


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = _distances(x, words).argmin(axis=1)
        sums, n = np.zeros_like(words), np.bincount(nearest, minlength=len(words))
        np.add.at(sums, nearest, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return np.unique(words, axis=0)


@dataclass
class MultiIndex:
    """Codebooks of both halves, the number of cells that a search visits, and pivots of groups."""

    dim: int
    books: tuple[np.ndarray, np.ndarray]
    visits: int
    pivots: np.ndarray
    lengths: np.ndarray  # numbers of each pivot before it was filled up
    near: float  # cosine with a pivot from which on two vectors are linked for certain

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = (self.dim + 1) // 2
        return _distances(x[:, :h], self.books[0]), _distances(x[:, h:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The ``visits`` nearest cells of each row, the nearest first.

        A cell at places (i, j) of the two sorted codebooks has (i + 1)(j + 1) cells that are no
        farther, so the traversal never leaves the places where that product is within ``visits``.
        """
        left, right = self._halves(x)
        orders = np.argsort(left, axis=1, kind="stable"), np.argsort(right, axis=1, kind="stable")
        i, j = np.nonzero(np.multiply.outer(np.arange(1, left.shape[1] + 1), np.arange(1, right.shape[1] + 1)) <= self.visits)
        a, b = orders[0][:, i], orders[1][:, j]
        sums = np.take_along_axis(left, a, 1) + np.take_along_axis(right, b, 1)
        sums[:, 0] = -np.inf  # places (0, 0)
        best = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        return (np.take_along_axis(a, best, 1) * right.shape[1] + np.take_along_axis(b, best, 1)).astype(np.int64)

    def group(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The pivot whose group each row is in, or -1."""
        if not len(self.pivots):
            return np.full(len(x), -1)
        cosine = np.where(lengths[:, None] == self.lengths, x @ self.pivots.T, -1.0)
        return np.where(cosine.max(axis=1) >= self.near, cosine.argmax(axis=1), -1)


def _needed(index: MultiIndex, sample: np.ndarray, cosine: float, recall: float, rng: np.random.Generator, trials: int = 4000) -> int:
    """Visits with which a ``recall`` of vectors and their twins at ``cosine`` find one another, from either side."""
    x, z = sample[rng.integers(0, len(sample), trials)], sample[rng.integers(0, len(sample), trials)].copy()
    z[::2] = rng.standard_normal(z[::2].shape) * (np.abs(z[::2]) > 0)  # half of the twins lie in the direction of another vector, half in any
    z -= (z * x).sum(axis=1)[:, None] * x
    size = np.sqrt((z * z).sum(axis=1))
    x, z, size = x[size > 1e-6], z[size > 1e-6], size[size > 1e-6]
    if not len(x):
        return 1
    y, most = cosine * x + np.sqrt(1 - cosine * cosine) * z / size[:, None], np.zeros(len(x), np.int64)
    step = max(1, 4_000_000 // (len(index.books[0]) * len(index.books[1])))
    for a in range(0, len(x), step):
        least = None
        for one, two in ((x[a : a + step], y[a : a + step]), (y[a : a + step], x[a : a + step])):
            (l1, r1), (l2, r2) = index._halves(one), index._halves(two)
            at = np.arange(len(one))
            own = l1[at, l2.argmin(axis=1)] + r1[at, r2.argmin(axis=1)]
            before = ((l1[:, :, None] + r1[:, None, :]).reshape(len(one), -1) <= own[:, None]).sum(axis=1)
            least = before if least is None else np.minimum(least, before)
        most[a : a + step] = least
    return int(np.quantile(most, recall, method="higher"))


def _pivots(sample: np.ndarray, lengths: np.ndarray, near: float, heavy: int = HEAVY) -> np.ndarray:
    """Rows of the sample with at least ``heavy`` of it within their reach, the fullest first, none within reach of another."""
    size = np.zeros(len(sample), np.int64)
    for a in range(0, len(sample), 1000):
        size[a : a + 1000] = ((sample[a : a + 1000] @ sample.T >= near) & (lengths[a : a + 1000, None] == lengths)).sum(axis=1)
    free, out = size >= heavy, []
    for k in np.argsort(-size, kind="stable"):
        if free[k]:
            out.append(k)
            free &= (sample @ sample[k] < near) | (lengths != lengths[k])
    return np.array(out, np.int64)


def fit(sample: np.ndarray, lengths: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL, per_cell: int = PER_CELL, seed: int = 7) -> MultiIndex:
    """An index for ``n`` vectors, of which ``sample`` (unit rows, once of ``lengths`` numbers) are some."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    k, h = int(min(CODEWORDS, max(2, np.ceil(np.sqrt(n / per_cell))))), (dim + 1) // 2
    near = float(np.sqrt((1 + cosine) / 2)) + 1e-9
    pivots = _pivots(sample, lengths, near)
    index = MultiIndex(dim, (_codebook(sample[:, :h], k, rng), _codebook(sample[:, h:], k, rng)), 1, sample[pivots], lengths[pivots], near)
    index.visits = min(_needed(index, sample, cosine, recall, rng), len(index.books[0]) * len(index.books[1]))
    return index


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, digest, v): digest and packed numbers are null where a vector links with nothing; and the bytes of a number."""
    width = 4 if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else 8
    kind = np.float32 if width == 4 else np.float64

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("v")
        sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = column.flatten()
        numbers = flat.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # nulls become NaN, -0.0 becomes 0.0
        ends = np.cumsum(sizes)
        bad, some = (np.append(0, np.cumsum(x)) for x in (~np.isfinite(numbers), numbers != 0))
        good = (sizes > 0) & (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
        raw = numbers.tobytes()
        packed = [raw[a * width : b * width] if g else None for a, b, g in zip((ends - sizes).tolist(), ends.tolist(), good.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([p and xxh3_128_digest(p) for p in packed], pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "v"])

    cut = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if width == 4 else 'double'}>").alias("v"))
    return map_batches(cut, each, "vec_id long, digest binary, v binary"), width


def _placed(classes: DataFrame, index: MultiIndex, width: int) -> DataFrame:
    """``classes`` with ``pivot`` and ``cells``, the visited ones, the own one first."""
    sent = classes.sparkSession.sparkContext.broadcast(index)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = batch.column("v").to_pylist()
        x, lengths = matrix(packed, width, sent.value.dim), np.array([len(p) // width for p in packed])
        cells = np.concatenate([sent.value.cells(x[a : a + 1000]) for a in range(0, len(x), 1000)])
        offsets = pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.group(x, lengths)), pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1)))], names=[*batch.schema.names, "pivot", "cells"])

    return map_batches(classes, each, "digest binary, node long, n long, v binary, pivot long, cells array<long>")


def _pairs_of_task(table: pa.Table, width: int, dim: int, cosine: float) -> pa.Table:
    """Rows (digest, found, node, least): with how many rows a class is linked here, and the least node that these links reach."""
    side, cell = table.column("listed").to_numpy(), table.column("cell")[0].as_py()
    packed, digest, node = (table.column(c).to_pylist() for c in ("v", "digest", "node"))
    n, pivot, cells = table.column("n").to_numpy(), table.column("pivot").to_numpy(), table.column("cells").to_pylist()
    listed, searching = np.flatnonzero(side), np.flatnonzero(~side)
    x, sizes = matrix(packed, width, dim), np.array([len(p) for p in packed])
    good = x[listed] @ x[searching].T >= cosine
    good &= (sizes[listed][:, None] == sizes[searching][None, :]) & ((pivot[listed][:, None] != pivot[searching][None, :]) | (pivot[listed] < 0)[:, None])
    left, right = np.nonzero(good)
    a, b = listed[left], searching[right]
    own = np.array([c[0] for c in cells])
    keep = own[b] != cell
    at = np.flatnonzero(~keep)
    keep[at] = [digest[p] < digest[q] for p, q in zip(a[at].tolist(), b[at].tolist(), strict=True)]
    # a pair of two cells that each side finds from the other counts in the lesser cell
    later = np.flatnonzero((own[b] != cell) & (own[b] < cell))
    if len(later):
        visited = {p: set(cells[p]) for p in np.unique(a[later]).tolist()}
        keep[later] = [int(own[q]) not in visited[p] for p, q in zip(a[later].tolist(), b[later].tolist(), strict=True)]
    a, b = a[keep], b[keep]
    found = np.zeros(len(packed), np.int64)
    np.add.at(found, a, n[b])
    np.add.at(found, b, n[a])
    node = np.array(node, np.int64)
    least = node.copy()
    while len(a):
        was = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        if (was == least).all():
            break
    rows = np.flatnonzero(found)
    return pa.table({"digest": pa.array([digest[k] for k in rows], pa.binary()), "found": pa.array(found[rows]), "node": pa.array(node[rows]), "least": pa.array(least[rows])})


def _found(placed: DataFrame, index: MultiIndex, width: int, cosine: float, block: int) -> DataFrame:
    """What the tasks of all cells find; a task has a block of vectors that a cell lists and a block of those that search it.

    In a cell that many of one group visit they have blocks of their own, which aren't paired with one another.
    """
    entries = placed.withColumn("own", F.col("cells")[0]).withColumn("cell", F.explode("cells"))
    lists = F.sum((F.col("cell") == F.col("own")).cast("long"))
    counted = entries.groupBy("cell", "pivot").agg(lists.alias("lists"), F.count("*").alias("visits"))
    unit = F.when((F.col("pivot") >= 0) & (F.col("visits") > block), F.col("pivot")).otherwise(F.lit(-1).cast("long"))
    parts = lambda c: F.ceil(F.sum(c) / block).cast("long")
    units = counted.groupBy("cell", unit.alias("unit")).agg(parts("lists").alias("lists"), parts("visits").alias("visits"))
    cells = units.groupBy("cell").agg(F.collect_list(F.struct("unit", "lists", "visits")).alias("units"))  # at most visits / block + 1 of them
    here = entries.join(cells, "cell").withColumn("unit", F.when(F.expr("exists(units, u -> u.unit = pivot)"), F.col("pivot")).otherwise(F.lit(-1).cast("long")))
    mine = F.expr("filter(units, u -> u.unit = unit)[0]")
    place = lambda k: F.pmod(F.xxhash64("digest"), k)
    partners = lambda k: F.expr(f"explode(flatten(transform(filter(units, u -> u.{k} > 0 AND (u.unit <> unit OR unit = -1)), u -> transform(sequence(0L, u.{k} - 1), b -> struct(u.unit AS unit, b AS block)))))")
    held = ["cell", "digest", "node", "n", "v", "pivot", "cells"]
    listed = here.where("cell = own").select(*held, F.lit(True).alias("listed"), F.struct("unit", place(mine.lists).alias("block")).alias("to"), partners("visits").alias("by"))
    searching = here.select(*held, F.lit(False).alias("listed"), partners("lists").alias("to"), F.struct("unit", place(mine.visits).alias("block")).alias("by"))
    dim = index.dim
    return listed.unionByName(searching.select(*listed.columns)).groupBy("cell", "to", "by").applyInArrow(lambda t: _pairs_of_task(t, width, dim, cosine), "digest binary, found long, node long, least long")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, per_cell: int = PER_CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are linked at a cosine of ``cosine`` or more; only vectors of one length are compared.
    Null, empty and zero vectors and those with a null or non-finite component link with nothing,
    nor do rows with a null id, whose component is null and which are kept. Equal vectors are linked
    and compared once. Rows that share an id are one node of components, and each is a vector of its
    own in ``n_links``. An empty table gives no rows; other columns aren't read.
    """
    rows, width = _rows(vectors, id_col, vector_col)
    rows = written(rows.withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest"))), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes, "classes")
    n, longest = classes.agg(F.count("*"), F.max(F.length("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = [bytes(r.v) for r in classes.orderBy(F.xxhash64("digest"), "digest").limit(sample).select("v").collect()]
    index = fit(matrix(drawn, width, longest // width), np.array([len(x) // width for x in drawn]), n, cosine, recall, per_cell)
    placed = written(_placed(classes, index, width), "placed")
    found = written(_found(placed, index, width, cosine, block), "found")

    groups = placed.where("pivot >= 0").groupBy("pivot").agg(F.sum("n").alias("in_group"), F.min("node").alias("head"))
    linked = found.groupBy("digest").agg(F.sum("found").alias("found"))
    # a group's classes are linked with one another: at most SAMPLE / HEAVY groups
    ends = placed.where("pivot >= 0").join(F.broadcast(groups), "pivot")
    links = found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(ends.select(F.col("node").alias("a"), F.col("head").alias("b")))
    parts = connected_components(links).withColumnRenamed("node", "of")
    known = placed.select("digest", "node", "n", "pivot").join(F.broadcast(groups), "pivot", "left").join(linked, "digest", "left")
    known = known.join(parts, F.col("node") == F.col("of"), "left").select("digest", (F.coalesce("in_group", "n") - 1 + F.coalesce("found", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.select("vec_id", "digest").join(known, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
