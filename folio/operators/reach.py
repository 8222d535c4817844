"""What version records reach, by walking stored nodes level by level.

A stored node's bytes are the number and the hashes of its children (tree.node_text). A walk keeps a
frontier, the nodes that the last round met for the first time; each round reads only these, checks
that their bytes hash to their names, and goes on with their children. A round is a level, whatever
the number of trees. On the way nodes go by ``name``, their hash as tree.packed() has it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import FANOUT, PAGE, height, page_count
from folio.operators.tree import content_hash, packed, unpacked
from folio.sources.shared import written


class Broken(ValueError):
    """A walk has met a node that is nowhere, or whose bytes don't hash to its name."""


def tree_roots(records: DataFrame, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(hash, level) of the trees that records (mem_tree<root, len>) name; a record without a tree names none."""
    some = records.where("mem_tree.root IS NOT NULL")
    return some.select(F.col("mem_tree.root").alias("hash"), height(page_count(F.coalesce("mem_tree.len", F.lit(0)), page), fanout).alias("level")).distinct()


def children(data: Column) -> Column:
    """Hashes that a node's bytes name."""
    text = F.decode(data, "utf-8")
    n = F.length(text) - F.instr(text, ":")
    body = F.expr("substring_index(decode(bytes, 'utf-8'), ':', -1)")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int") - 1), lambda i: F.substring(body, i * 64 + 1, F.lit(64)))).otherwise(F.array().cast("array<string>"))


def _next(frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """Children of a frontier's nodes, one level below, that no round has met."""
    below = frontier.where("level > 0").select(F.explode(children(F.col("bytes"))).alias("hash"), (F.col("level") - 1).alias("level")).select(packed("hash").alias("name"), "level").distinct()
    return below.join(seen.select("name", "level"), ["name", "level"], "left_anti")


def _good() -> Column:
    return content_hash(F.col("bytes")).eqNullSafe(unpacked("name"))


def _inner(blobs: DataFrame) -> DataFrame:
    """Blobs (hash, bytes) whose bytes may be a node's: what rounds of a walk look at, instead of all pages each time.

    They are dealt out by hash once and kept on disk, sorted, so a round moves its frontier to them and
    not them to its frontier. Bytes are kept as (n, body), half as long; _held() has them whole. Whoever asks for them gives them back by unpersist().
    """
    text, n = F.decode("bytes", "ISO-8859-1"), int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = blobs.where(text.rlike("^[0-9]{1,18}:([0-9a-f]{2})*$")).select(packed("hash").alias("name"), F.substring_index(text, ":", 1).alias("n"), F.unhex(F.substring_index(text, ":", -1)).alias("body"))
    return some.repartition(n, "name").sortWithinPartitions("name").persist(StorageLevel.DISK_ONLY)


def _held(inner: DataFrame) -> DataFrame:
    """(name, bytes, there) of what _inner() keeps."""
    return inner.select("name", F.encode(F.concat("n", F.lit(":"), F.lower(F.hex("body"))), "utf-8").alias("bytes"), F.lit(True).alias("there"))


def _found(new: DataFrame, inner: DataFrame, blobs: DataFrame) -> DataFrame:
    """``new`` (name, ...) with bytes and ``there``, written: from ``inner``, and only where these lack a node from all ``blobs``."""
    found = written(new.join(_held(inner), "name", "left"), "found")
    lost = found.where("there IS NULL").select(new.columns)
    if not lost.take(1):
        return found
    return found.where("there").unionByName(written(lost.join(blobs.select(packed("hash").alias("name"), "bytes", F.lit(True).alias("there")), "name", "left"), "found"))


def reached(roots: DataFrame, blobs: DataFrame) -> DataFrame:
    """(hash, level, status) of every blob below roots (hash, level): 'ok', or, for inner nodes, 'missing' or 'corrupt'; below these nothing is known.

    ``blobs`` are (hash, bytes), each hash once. Pages are level 0 and aren't read. A node that many
    trees share is met once.
    """
    return _walked(roots, blobs).select(unpacked("name").alias("hash"), "level", "status")


def _walked(roots: DataFrame, blobs: DataFrame) -> DataFrame:
    """reached(), but (name, level, status)."""
    seen, inner = None, _inner(blobs)
    new = written(roots.where("hash IS NOT NULL").select(packed("hash").alias("name"), F.col("level").cast("int").alias("level")).distinct(), "frontier")
    whole = new.where("level = 0").select("name", "level", F.lit("ok").alias("status"))
    status = F.when(F.col("there").isNull(), "missing").when(~_good(), "corrupt").otherwise("ok")
    while new.where("level > 0").take(1):
        now = _found(new.where("level > 0"), inner, blobs).select("name", "level", status.alias("status"), "bytes")
        seen = new if seen is None else seen.unionByName(new)
        new = written(_next(now.where("status = 'ok'"), seen), "frontier")
        whole = whole.unionByName(now.select("name", "level", "status")).unionByName(new.where("level = 0").select("name", "level", F.lit("ok").alias("status")))
    inner.unpersist()
    return whole


def orphans(blobs: DataFrame, records: DataFrame, extra: list[str], page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(hash) of blobs that no record reaches, by its tree or by an artifact (columns ``extra``).

    Raises Broken if a record's tree can't be walked to its end: what lies below a broken node would
    look like an orphan.
    """
    found = _walked(tree_roots(records, page, fanout), blobs)
    bad = found.where("status <> 'ok'").select(unpacked("name").alias("hash"), "status").head()
    if bad:
        raise Broken(f"reach: node {bad.hash} is {bad.status}")
    kept = found.select("name")
    for name in extra:
        kept = kept.unionByName(records.where(F.col(name).isNotNull()).select(packed(name).alias("name")))
    return blobs.select(packed("hash").alias("name")).join(kept, "name", "left_anti").select(unpacked("name").alias("hash"))


def level_fetch(roots: DataFrame, local: DataFrame, central: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((hash, level, bytes) of nodes to add to ``local``, (level, asked, fetched) counts).

    Level by level, the distinct inner nodes below roots (hash, level) that ``local`` (hash, bytes)
    lacks come from ``central`` (hash, bytes); the walk goes on below held nodes too, and pages are never
    fetched. Raises Broken at a node that is nowhere or whose bytes don't hash to its name.
    """
    new = written(roots.where("hash IS NOT NULL AND level > 0").select(packed("hash").alias("name"), F.col("level").cast("int").alias("level")).distinct(), "frontier")
    seen, fetched, counts, mine, theirs = new, [], [], _inner(local), _inner(central)
    while new.take(1):
        here = new.join(_held(mine), "name", "left")
        lacking = here.where("there IS NULL").select("name", "level")
        rows = here.where("there").select("name", "level", F.lit(True).alias("held"), "bytes").unionByName(_found(lacking, theirs, central).select("name", "level", F.lit(False).alias("held"), "bytes"))
        rows = written(rows.withColumn("good", _good()), "fetch")
        bad = rows.where("NOT good").select(unpacked("name").alias("hash"), "bytes").head()
        if bad:
            raise Broken(f"fetch: node {bad.hash} is {'missing' if bad.bytes is None else 'corrupt'}")
        fetched.append(rows.where("NOT held").select(unpacked("name").alias("hash"), "level", "bytes"))
        counts.append(rows.groupBy("level").agg(F.count("*").alias("asked"), F.count(F.when(~F.col("held"), 1)).alias("fetched")))
        new = written(_next(rows, seen).where("level > 0"), "frontier")
        seen = seen.unionByName(new)
    mine.unpersist()
    theirs.unpersist()
    if not fetched:
        none = new.select(unpacked("name").alias("hash"), "level", F.lit(None).cast("binary").alias("bytes"))
        return none, none.groupBy("level").agg(F.count("*").alias("asked"), F.count("*").alias("fetched"))
    rows, sums = fetched[0], counts[0]
    for x, y in zip(fetched[1:], counts[1:], strict=True):
        rows, sums = rows.unionByName(x), sums.unionByName(y)
    # what local holds under a node's name, though no node, was passed over by the walk
    spoilt = rows.select("hash").join(local.select("hash"), "hash", "left_semi").head()
    if spoilt:
        raise Broken(f"fetch: node {spoilt.hash} is corrupt")
    return rows, sums.groupBy("level").agg(F.sum("asked").alias("asked"), F.sum("fetched").alias("fetched"))
