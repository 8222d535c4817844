"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of half keys, A and B, of ROWS minhashes each, are computed for every set. A
table key is a pair (A_i, B_j): TABLES + TABLES half keys stand for TABLES x TABLES tables of
2 x ROWS minhashes each. A half key that one set alone has can't be in a shared table key, so only
shared half keys are combined; most sets have none and cost nothing more.

Sets of one table key are not all paired. In each round a key names a pivot; a set is compared with
the pivot that it shares most keys with, and links merge sets into components. Keys whose sets lie
in one component are done, so a group of n copies takes about n comparisons. In the last round, keys
of at most FEW sets, which chance makes, have their few pairs compared one by one. Sets of different
components that share a larger key, or are joined by a chain of such keys, form a cluster: texts
with much in common, which share keys pair by pair. A cluster is cut into blocks of bounded size by
set size and hash; pairs of blocks whose sizes allow the similarity are compared on full sets inside
one task, and one link of two components comes out. So no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from folio.llm.arrow import encoded, map_batches, text_hash, texts
from folio.llm.components import connected_components
from folio.llm.shared import written
from folio.llm.words import U64, mix, words_of

#: Words of a shingle, and hundredths of similarity, of the library; op3 sets its own words.
SHINGLE, SIMILARITY = 5, 80
#: Half keys of either side, and minhashes of a half key. A pair of similarity 0.8 shares a table
#: key unless all 12 of a side differ: 2 x (1 - 0.8^2)^12 = 1e-5.
TABLES, ROWS = 12, 2
#: Rounds of comparison with pivots before the rest is compared pair by pair.
PIVOT_ROUNDS = 3
#: Most sets of a key whose pairs, at most 28, are compared singly and don't chain clusters.
FEW = 8
#: Sets of a block, and shingles that are counted at a time when two blocks are compared.
BLOCK, COLUMNS = 400, 8192

_N = 2 * TABLES * ROWS
_FACTORS = np.random.Generator(np.random.PCG64(8191)).integers(1, 1 << 63, _N, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(batch: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, ASCII white space; fewer than k words make one shingle."""
    words = words_of([t.lower() for t in batch])
    h, out = words.hashes, []
    if len(h) >= k:
        rolled = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            rolled = mix(rolled * U64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            one = np.array([b - a], U64)
            for x in h[a:b]:
                one = mix(one * U64(0x9E3779B97F4A7C15) + x)
            out.append(one)
        else:
            out.append(h[:0])
    return out


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, set_id (a digest of the set), n and halves (2 x TABLES half keys)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for a in range(0, batch.num_rows, 1000) for s in shingle_sets(encoded(batch.column("text").slice(a, 1000)), k)]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        least = np.zeros((len(sets), _N), U64)
        step = 400
        for a in range(0, len(full), step):
            rows = full[a : a + step]
            flat, heads = np.concatenate([sets[r] for r in rows]), np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            for j, f in enumerate(_FACTORS):
                least[rows, j] = np.minimum.reduceat(flat * f, heads)
        mixed = mix(least)
        halves = mix(mixed[:, 0::2] * U64(0x2545F4914F6CDD1D) + mixed[:, 1::2] + np.arange(2 * TABLES, dtype=U64))
        offsets = pa.array(np.arange(0, 2 * TABLES * len(sets) + 1, 2 * TABLES, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(halves.view(np.int64).reshape(-1)))],
            names=["doc_id", "text_hash", "set_id", "n", "halves"],
        )

    return map_batches(docs, each, "doc_id long, text_hash long, set_id binary, n long, halves array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, node_set) of the texts: their set ids and sets as bytes."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s for a in range(0, batch.num_rows, 1000) for s in shingle_sets(encoded(batch.column("text").slice(a, 1000)), k)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set_id", "held"])

    return map_batches(docs, each, "doc_id long, set_id binary, held binary")


def _similar(left: list[np.ndarray], right: list[np.ndarray], similarity: int) -> np.ndarray:
    """Which sets of two blocks are similar enough, as a matrix: intersections are products of 0/1 matrices over the shingles that both sides have."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*flat)
    at = [np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0)) for f in flat]
    some = [both[k] == f if len(both) else np.zeros(len(f), bool) for k, f in zip(at, flat, strict=True)]
    at, rows = [k[m] for k, m in zip(at, some, strict=True)], [r[m] for r, m in zip(rows, some, strict=True)]
    shared = np.zeros((len(left), len(right)), np.float32)  # counts below 2^24 are exact
    for a in range(0, len(both), COLUMNS):
        part = []
        for side, k, r in zip((left, right), at, rows, strict=True):
            m = np.zeros((len(side), COLUMNS), np.float32)
            here = (k >= a) & (k < a + COLUMNS)
            m[r[here], k[here] - a] = 1
            part.append(m)
        shared += part[0] @ part[1].T
    shared = shared.astype(np.int64)
    return 100 * shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared)


def _links_within(nodes: DataFrame, similarity: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components of clusters, of two components one a task; nodes are (node, cluster, component, n, held).

    Sets are classed by size so that similar ones lie at most two classes apart; a class is cut into
    blocks by hash. A task has two blocks, whatever the size of the cluster.
    """
    step = float(np.log(np.sqrt(100 / similarity)))
    classed = nodes.withColumn("size", F.floor(F.log("n") / step))
    counts = classed.groupBy("cluster", "size").agg(F.ceil(F.count("*") / block).cast("long").alias("k"))
    placed = classed.join(counts, ["cluster", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k"))).drop("k")
    blocks = counts.select("cluster", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("block"))
    one, two = blocks.alias("one"), blocks.alias("two")
    near = (F.col("one.cluster") == F.col("two.cluster")) & F.expr("two.size - one.size BETWEEN 0 AND 2") & F.expr("one.size < two.size OR one.block <= two.block")
    tasks = one.join(two, near).select("one.cluster", F.col("one.size").alias("s1"), F.col("one.block").alias("b1"), F.col("two.size").alias("s2"), F.col("two.block").alias("b2"))
    key = ["cluster", "s1", "b1", "s2", "b2"]
    sides = [placed.withColumnsRenamed({"size": f"s{k}", "block": f"b{k}"}).join(tasks, ["cluster", f"s{k}", f"b{k}"]).select(*key, F.lit(k).alias("side"), "node", "component", "held") for k in (1, 2)]

    def each(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        node, part = table.column("node").to_numpy(), table.column("component").to_numpy()
        held = [np.frombuffer(x, U64) for x in table.column("held").to_pylist()]
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(left) or not len(right) or len(np.unique(part)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        good = _similar([held[k] for k in left], [held[k] for k in right], similarity) & (part[left][:, None] != part[right][None, :])
        x, y = np.nonzero(good)
        ends = np.sort(np.stack([part[left][x], part[right][y]], 1), 1)
        one = np.unique(ends, axis=0, return_index=True)[1]
        x, y = x[one], y[one]
        return pa.table({"a": pa.array(node[left][x]), "b": pa.array(node[right][y])})

    return sides[0].unionByName(sides[1]).groupBy(*key).applyInArrow(each, "a long, b long")


def _few_pairs(placed: DataFrame, facts: DataFrame, similarity: int, few: int = FEW) -> DataFrame:
    """Pairs (a, b) of different components in keys of at most ``few`` sets, where sizes allow the similarity."""
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where(f"low < high AND c <= {few}").select("key")
    held = placed.join(keys, "key").join(facts.select("node", "n"), "node").groupBy("key").agg(F.collect_list(F.struct("node", "component", "n")).alias("m"))  # at most ``few``
    near = f"x.node < y.node AND x.component <> y.component AND 100 * least(x.n, y.n) >= {similarity} * greatest(x.n, y.n)"
    pairs = held.select(F.expr(f"explode(flatten(transform(m, x -> transform(filter(m, y -> {near}), y -> struct(x.node AS a, y.node AS b)))))").alias("p"))
    return pairs.select("p.*").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough. Each pair carries two sets, never a group's."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("held_a").to_pylist(), batch.column("held_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            good.append(100 * both >= similarity * (len(x) + len(y) - both))
        keep = pa.array(good)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return map_batches(two.select("a", "b", "held_a", "held_b"), each, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", pivot_rounds: int = PIVOT_ROUNDS, with_hash: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept and, if asked, text_hash, which tells apart rows that share an id.

    Sets are linked when 100 x intersection >= similarity x union; component_id is the least id
    reachable by links, kept whether it is the row's own. Null and empty texts have an empty set,
    which links with nothing; neither does a row with a null id, whose component is null and which
    is kept. Rows that share an id are one node; if their texts differ, only the least of their sets
    is compared with others. Equal sets are one class and compared once. An empty table gives no
    rows; other columns aren't read.
    """
    rows = texts(docs, id_col, text_col, text_hash(text_col).alias("text_hash"))
    signed = written(_signatures(rows, shingle), "signatures")
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("set_id").agg(F.min("doc_id").alias("node")), "classes")

    # the row that stands for a class: one of those with its least id
    stands = named.join(classes, (named.set_id == classes.set_id) & (named.doc_id == classes.node)).select(classes.node, classes.set_id, "n", "halves").dropDuplicates(["node", "set_id"])
    halves = stands.select("node", "set_id", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("times")).where("times > 1").select("half")
    of_node = halves.join(shared, "half").groupBy("node", "set_id").agg(F.collect_list(F.when(F.col("at") < TABLES, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("at") >= TABLES, F.col("half"))).alias("b")).where("size(a) > 0 AND size(b) > 0")  # at most TABLES each
    keyed = of_node.select("node", "set_id", F.expr("explode(flatten(transform(a, x -> transform(b, y -> xxhash64(x, y)))))").alias("key"))
    keyed = written(keyed, "table-keys")
    many = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = written(keyed.join(many, "key").select("key", "node").distinct(), "members")
    nodes = members.select("node").distinct()
    facts = written(stands.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("n", "set_id")).alias("f")).select("node", "f.*"), "facts")
    texts_of = rows.join(nodes, rows.doc_id == nodes.node, "left_semi")
    sets = written(_sets(texts_of, shingle).join(facts.select("node", "set_id"), "set_id").where("doc_id = node").select("node", "held").dropDuplicates(["node"]), "sets")

    found = written(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links")
    parts = facts.select("node", F.col("node").alias("component"))
    for turn in range(max(pivot_rounds, 1)):
        placed = members.join(parts, "node")
        pivots = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "component")).alias("pivot")).where("low < high")
        pivots = pivots.select("key", F.col("pivot.node").alias("b"), F.col("pivot.component").alias("to"))
        asked = placed.join(pivots, "key").where("component <> to").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("times"))
        best = asked.groupBy("a").agg(F.max(F.struct("times", "b")).alias("p")).select("a", "p.b")
        pairs = best if pivot_rounds else best.limit(0)
        if turn >= pivot_rounds - 1:
            pairs = pairs.unionByName(_few_pairs(placed, facts, similarity)).distinct()
        found, parts = _merged(found, _confirmed(pairs, sets, similarity), facts)
    placed = members.join(parts, "node")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where(f"low < high AND c > {FEW}").select("key")
    # components that share an open key, by way of the key's least one
    still = written(placed.join(open_keys, "key").select("key", F.col("component").alias("a")).distinct(), "open")
    chains = still.join(still.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b").distinct()
    clusters = connected_components(chains).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    rest = parts.join(clusters, "component").join(facts.select("node", "n"), "node").join(sets, "node")
    found, parts = _merged(found, _links_within(rest, similarity), facts)

    placed = classes.join(parts, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    least = placed.groupBy("set_id").agg(F.min("component_id").alias("component_id"))
    out = signed.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "text_hash", "set_id", "n").join(written(least, "placed"), "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash")
    both = out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return both if with_hash else both.drop("text_hash")


def _merged(found: DataFrame, new: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far, and the component of every node."""
    found = written(found.unionByName(new), "links")
    parts = facts.select("node").join(connected_components(found), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return found, written(parts, "parts")


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
