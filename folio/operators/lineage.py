"""Versions and their ancestors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.shared import written


def ancestors(versions: DataFrame) -> DataFrame:
    """(id, ancestor, depth) for every version (id, parent) and each ancestor, itself at depth 0.

    Pointer doubling: each round joins paths of up to d steps with each other, so a chain of n
    versions takes log2(n) rounds; it has n^2 / 2 rows, so lineage() and nearest_ancestor() don't use it. A parent that isn't a version ends the chain. Raises ValueError if
    parents form a circle.
    """
    step = versions.select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).join(versions.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    known = written(step.select("id", "ancestor", "depth"), "lineage")
    reach = 1
    while True:
        far = known.where(F.col("depth") == reach)
        more = far.select("id", F.col("ancestor").alias("via"), F.col("depth").alias("d")).join(known.select(F.col("id").alias("via"), "ancestor", F.col("depth").alias("e")), "via").select("id", "ancestor", (F.col("d") + F.col("e")).alias("depth"))
        more = written(more, "lineage-more")
        if more.where("id = ancestor").take(1) or known.where("id = ancestor").take(1):
            raise ValueError("lineage: parents form a circle")
        if not more.take(1):
            break
        known = written(known.unionByName(more), "lineage")
        reach *= 2
    return versions.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth")).unionByName(known)


def _jumped(pointers: DataFrame) -> DataFrame:
    """Follow pointers (id, via, depth, done) to their ends by pointer jumping: a row an id, and each round doubles its reach.

    ``via`` names another id, or the id itself where ``done``. Only unfinished rows are joined, so
    the ends that many share are looked up once a round at most. A round finishes some row of every
    chain that has an end, so one that finishes none has come to a circle: ValueError.
    """
    now, before = written(pointers, "jump"), None
    while left := now.where("NOT done").count():
        if left == before:
            raise ValueError("lineage: parents form a circle")
        before = left
        ends = now.select(F.col("id").alias("via"), F.col("via").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        moved = now.where("NOT done").join(ends, "via").select("id", F.col("next").alias("via"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done"))
        now = written(now.where("done").unionByName(moved), "jump")
    return now.select("id", "via", "depth")


def _pointers(versions: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Each version (id, parent) points to its parent, or to itself if it has none or is in ``ends`` (id)."""
    known = versions.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = versions.select("id", "parent").join(known, "parent", "left")
    stop = F.col("known").isNull()
    if ends is not None:
        rows = rows.join(ends.select("id", F.lit(True).alias("end")).distinct(), "id", "left")
        stop = stop | F.col("end").isNotNull()
    return rows.select("id", F.when(stop, F.col("id")).otherwise(F.col("parent")).alias("via"), F.when(stop, 0).otherwise(1).cast("long").alias("depth"), stop.alias("done"))


def lineage(versions: DataFrame) -> DataFrame:
    """(id, root, depth) of every version (id, parent): the seed that it comes from, and its distance."""
    return _jumped(_pointers(versions)).withColumnRenamed("via", "root")


def nearest_ancestor(versions: DataFrame, local: DataFrame) -> DataFrame:
    """(id, ancestor, depth): the nearest ancestor that is held here, possibly the version itself; none: no row."""
    return _jumped(_pointers(versions, local)).withColumnRenamed("via", "ancestor").join(local.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select("id", "ancestor", "depth")


def inherit(children: DataFrame, parents: DataFrame, names: list[str]) -> DataFrame:
    """``children`` with each artifact in ``names`` that they lack taken from their parent."""
    p = parents.select(F.col("id").alias("parent"), *[F.col(n).alias(f"p_{n}") for n in names])
    rest = [c for c in children.columns if c not in names]
    return children.join(p, "parent", "left").select(*rest, *[F.coalesce(n, f"p_{n}").alias(n) for n in names])


def _ranked(counts: DataFrame, score: str, top: int | None) -> DataFrame:
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy("version").orderBy(F.col(score).desc(), "holder")).cast("long"))
    return placed if top is None else placed.where(F.col("place") <= top)


#: Holders of a blob that travel as one value, and blobs of versions that a task counts, about.
TOGETHER, ROWS = 4096, 1 << 20


def _packing():
    """packed() and unpacked(), which travel to tasks whole."""

    def packed(lists: pa.Array) -> pa.Array:
        """Sorted lists of whole numbers, each once, as bytes: whether null is there, and the steps from one to the next, 7 bits a byte."""
        n, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        null = pc.is_null(flat).to_numpy(zero_copy_only=False)
        row, v = np.repeat(np.arange(len(n)), n), pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        nulls, row, v = np.bincount(row[null], minlength=len(n)), row[~null], v[~null]
        step = v - np.append(np.uint64(0), v)[:-1]  # modulo 2 ** 64
        starts = np.searchsorted(row, np.arange(len(n)))
        first = starts[starts < np.searchsorted(row, np.arange(len(n)), "right")]
        step[first] = v[first]
        step = np.insert(step, starts, nulls.astype(np.uint64))
        size = 1 + sum(((step >> np.uint64(7 * k)) > 0).astype(np.int64) for k in range(1, 10))
        at = np.append(0, np.cumsum(size))
        out = np.empty(at[-1], np.uint8)
        for k in range(10):
            more = size > k
            out[at[:-1][more] + k] = ((step[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[more] > k + 1) << 7).astype(np.uint8)
        ends = np.append(starts + np.arange(len(n)), len(step))  # of rows, in steps
        return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at[ends].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())

    def unpacked(data: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """What packed() was given: all numbers, and how many each row has."""
        data = data.cast(pa.large_binary())
        rows = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        b = np.frombuffer(data.buffers()[2], np.uint8)[rows[0] : rows[-1]]
        at = np.append(0, np.flatnonzero(b < 128) + 1)
        size, v = np.diff(at), np.zeros(len(at) - 1, np.uint64)
        for k in range(size.max(initial=0)):
            more = size > k
            v[more] |= (b[at[:-1][more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        heads = np.searchsorted(at, rows[:-1] - rows[0])
        row = np.repeat(np.arange(len(data)), np.diff(np.append(heads, len(v))))
        total = np.cumsum(v, dtype=np.uint64)
        head = np.zeros(len(v), bool)
        head[heads] = True
        kept = ~head | (v > 0)
        return pa.array((total - total[heads][row])[kept].view(np.int64), mask=head[kept]), np.bincount(row[kept], minlength=len(data))

    return packed, unpacked


def _lists(held: DataFrame) -> DataFrame:
    """(hash, holders): holders of each blob in arrays of about TOGETHER at most; those that are numbers packed."""
    many = held.groupBy("hash").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("parts")).where(F.col("parts") > 1)  # one in TOGETHER rows at most
    part = F.coalesce(F.pmod(F.xxhash64("holder"), F.col("parts")), F.lit(0))
    lists = held.join(F.broadcast(many), "hash", "left").groupBy("hash", part.alias("part")).agg(F.collect_list(F.struct("holder")).alias("holders")).select("hash", F.sort_array("holders.holder").alias("holders"))
    if held.schema["holder"].dataType.simpleString() not in ("bigint", "int"):
        return lists
    packed, _ = _packing()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([b.column("hash"), packed(b.column("holders"))], names=["hash", "holders"])

    return lists.mapInArrow(pack, f"hash {held.schema['hash'].dataType.simpleString()}, holders binary")


def affinity(wanted: DataFrame, held: DataFrame, top: int | None = None) -> DataFrame:
    """(version, holder, overlap, place): holders in order of how many of a version's blobs they have, the first ``top`` of each.

    Exact: counts every pair that shares a blob. wanted (version, hash) and held (holder, hash) have a
    pair once. A blob's holders travel to its versions as one value, and a version's pairs are made, counted and
    ranked in one place, some at a time, so pairs themselves are neither moved nor sorted on disk.
    affinity_sketched() looks at sketches first.
    """
    types = {c: df.schema[c].dataType.simpleString() for c, df in (("version", wanted), ("holder", held))}
    wanted, lists = written(wanted.select("version", "hash"), "wanted"), written(_lists(held.select("holder", "hash")), "holders")
    n = max(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // ROWS))
    rows = wanted.join(lists, "hash").select("version", "holders").repartition(n, "version").sortWithinPartitions("version")
    return rows.mapInArrow(_placed(top, types["holder"] == "int"), f"version {types['version']}, holder {types['holder']}, overlap long, place long")


def _placed(top: int | None, narrow: bool):
    """From rows (version, holders), sorted by version, to affinity()'s."""
    rank, (_, unpacked) = _likeliest(top), _packing()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            lists = batch.column("holders")
            if pa.types.is_list(lists.type) or pa.types.is_large_list(lists.type):
                holder, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            else:
                holder, n = unpacked(lists)
            version = batch.column("version").take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([version, holder.cast(pa.int32()) if narrow else holder, pa.array(np.ones(len(holder)))], names=["version", "holder", "bound"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in rank(pairs(batches)):
            run = found.column("version").dictionary_encode("encode").indices.to_numpy()  # versions are together, in order
            place = np.arange(len(run)) - np.searchsorted(run, run) + 1
            yield pa.RecordBatch.from_arrays([*map(found.column, ("version", "holder", "overlap")), pa.array(place.astype(np.int64))], names=["version", "holder", "overlap", "place"])

    return each


#: Hashes of a sketch; ranges in which a large set's are sought first.
SKETCH, SALTS = 256, 64
#: A blob that more holders have than this tells them apart too little to be searched by; it counts in the overlap all the same.
COMMON = 1000


def bottom_hashes(sets: DataFrame, by: str, k: int = SKETCH) -> DataFrame:
    """(by, hash, v, tau): the k least hash values v of each set, as numbers from 0 to 1, and the value below which all are there.

    A set of at most k is its own sketch, with a tau of 1; that of a larger one is less. Of larger sets the least are sought first
    within salted parts, then in what is left, so no set is one task. ``sets`` is read three times.
    """
    v = (F.xxhash64("hash").cast("double") + float(1 << 63)) / float(1 << 64)
    large = written(sets.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col(by).alias("large")), "large")  # one in k rows at most
    of_large = F.col(by).eqNullSafe(F.col("large"))
    rows = sets.join(large, of_large, "left_semi").select(by, "hash", v.alias("v"), F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(SALTS)).alias("salt"))
    for key in ([by, "salt"], [by]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("v", "hash"))).where(F.col("r") <= k)
    tau = rows.groupBy(F.col(by).alias("large")).agg(F.least(F.max("v"), F.lit(1 - 2.0**-53)).alias("tau"))
    return sets.join(large, of_large, "left_anti").select(by, "hash", v.alias("v"), F.lit(1.0).alias("tau")).unionByName(rows.join(tau, of_large).select(by, "hash", "v", "tau"))


#: Pairs that are counted together, at least.
STEP = 1 << 18


def _likeliest(most: int | None):
    """From pairs (version, holder, bound), sorted by version, to each version's ``most`` likeliest holders, or all, the likeliest first: version, holder, overlap, about, whole.

    A pair's bound is the same at each blob; a null bound is a blob that was left out. Versions are counted
    as they come, about STEP pairs at a time; the pairs of the one that breaks off wait for the next.
    """

    def counted(rows: pa.Table) -> pa.RecordBatch:
        version, holder = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("version", "holder"))
        run, order = version.indices.to_numpy().astype(np.int64), pc.array_sort_indices(holder.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        bound = rows.column("bound").to_numpy()  # null: NaN
        there = ~np.isnan(bound)
        left_out = np.zeros(len(version.dictionary), bool)
        left_out[run[~there]] = True
        keys = (run * len(order) + place[holder.indices.to_numpy()])[there]
        if (bound[there] == 1).all():
            keys, n = np.unique(keys, return_counts=True)
            bound = np.ones(len(keys))
        else:
            keys, at, n = np.unique(keys, return_index=True, return_counts=True)
            bound = bound[there][at]
        v, h = np.divmod(keys, len(order))
        best = np.lexsort((-(n / bound), v))  # stable: equal ones stay in order of holder
        if most is not None:
            best = best[np.arange(len(v)) - np.searchsorted(v, v) < most]
        v, h, n, bound = v[best], h[best], n[best], bound[best]
        columns = [version.dictionary.take(pa.array(v)), holder.dictionary.take(pa.array(order[h])), pa.array(n.astype(np.int64)), pa.array(n / bound), pa.array((bound == 1) & ~left_out[v])]
        return pa.RecordBatch.from_arrays(columns, names=["version", "holder", "overlap", "about", "whole"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, enough = [], 0, STEP
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= enough:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                code = rows.column("version").combine_chunks().dictionary_encode("encode").indices.to_numpy()
                last = int(np.searchsorted(code, code[-1]))  # this version may go on
                if last:
                    yield counted(rows.slice(0, last))
                waiting, n = rows.slice(last).to_batches(), rows.num_rows - last
                enough = max(STEP, 2 * n)
        if n:
            yield counted(pa.Table.from_batches(waiting))

    return each


def affinity_sketched(wanted: DataFrame, held: DataFrame, top: int, k: int = SKETCH, candidates: int | None = None, common: int = COMMON) -> DataFrame:
    """As affinity(), but exact overlaps are counted for the most promising ``candidates`` of a version alone (4 x top, unless given).

    Sketches keep the k least hash values of a set, so those of two sets overlap as the sets do below
    the lesser of their bounds. Overlaps are exact; a holder that the sketches rank too low may be
    missing. With k above the size of every set nothing is. Holders of a blob travel to its versions as one
    array, and a version's pairs, k x ``common`` at most, are counted where they are made. Where
    both sketches are whole sets that count is exact, and isn't made again.
    """
    wanted, held = written(wanted.select("version", "hash"), "wanted"), written(held.select("holder", "hash"), "held")
    w, h = bottom_hashes(wanted, "version", k).select("version", "hash", "tau"), bottom_hashes(held, "holder", k)
    frequent = written(h.groupBy("hash").agg(F.count("*").alias("holders")).where(F.col("holders") > common).select("hash"), "common")  # one in ``common`` rows at most
    lists = h.join(frequent, "hash", "left_anti").groupBy("hash").agg(F.collect_list(F.struct("holder", "tau")).alias("l"))
    lists = lists.select("hash", F.col("l.holder").alias("holders"), F.when(F.exists("l.tau", lambda t: t < 1), F.col("l.tau")).alias("others"))
    none = frequent.select("hash", F.array().cast(lists.schema["holders"].dataType).alias("holders"), F.lit(None).cast("array<double>").alias("others"))
    rows = w.join(lists.unionByName(none), "hash").select("version", "tau", "holders", "others").repartition("version").sortWithinPartitions("version")
    pairs = rows.select("version", "tau", "others", F.posexplode_outer("holders").alias("pos", "holder"))
    pairs = pairs.select("version", "holder", F.when(F.col("pos").isNotNull(), F.least("tau", F.coalesce(F.get("others", "pos"), F.lit(1.0)))).alias("bound"))
    types = {c: df.schema[c].dataType.simpleString() for c, df in (("version", wanted), ("holder", held))}
    likely = pairs.mapInArrow(_likeliest(candidates or 4 * top), f"version {types['version']}, holder {types['holder']}, overlap long, about double, whole boolean")
    likely = written(likely.select("version", "holder", "overlap", "whole"), "likely")
    exact, few = likely.where("whole").select("version", "holder", "overlap"), likely.where("NOT whole").select("version", "holder")
    if not few.isEmpty():
        both = wanted.join(few.withColumnRenamed("version", "of"), F.expr("version <=> of")).select("version", F.col("holder").alias("by"), "hash")
        there = both.join(held.withColumnRenamed("hash", "has"), F.expr("holder <=> by AND hash = has"), "left_semi")
        exact = exact.unionByName(there.groupBy("version", F.col("by").alias("holder")).agg(F.count("*").alias("overlap")))
    return _ranked(exact, "overlap", top)


def evict(lineages: DataFrame, budget: int) -> DataFrame:
    """Rows (lineage, last_used, n_bytes) to evict, least recently used first, until what stays fits ``budget`` bytes.

    Running sums by day first, then within the day that the limit falls on, so no task gets all rows.
    """
    days = lineages.groupBy(F.to_date("last_used").alias("day")).agg(F.sum("n_bytes").alias("n"))
    later = days.withColumn("after", F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dated = lineages.withColumn("day", F.to_date("last_used")).join(later.select("day", "after"), "day")
    w = Window.partitionBy("day").orderBy(F.col("last_used").desc(), F.col("lineage").desc())
    return dated.withColumn("kept_bytes", (F.col("after") + F.sum("n_bytes").over(w)).cast("long")).where(F.col("kept_bytes") > budget).select("lineage", "last_used", "n_bytes", "kept_bytes")
