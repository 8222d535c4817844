"""What a holder of blobs lacks of a tree, and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import div, subtree_pages
from folio.operators.scans import before
from folio.operators.tree import NODE, node_text, packed, unpacked


def with_marked_above(nodes: DataFrame, marked: Column, fanout: int) -> DataFrame:
    """``nodes`` with ``marked`` and ``above``: whether a marked position lies properly above.

    A position stands for an interval of pages, and intervals of a tree are nested or apart. In
    pre-order, by first page and from the root down, a marked position lies above one that comes
    later if and only if it ends after the other begins: one running maximum of ends, scanned by
    ranges of pages. No row is multiplied by the height of its tree.
    """
    end = (F.col("node_idx") + 1) * subtree_pages(F.col("level"), fanout)
    flagged = nodes.withColumn("marked", F.coalesce(marked, F.lit(False)))
    reached = before(flagged, ["image_id"], "page_base", F.when(F.col("marked"), end), "reach", "max", [F.col("level").desc()])
    return reached.withColumn("above", F.coalesce(F.col("reach") > F.col("page_base"), F.lit(False))).drop("reach")


def tree_diff(nodes: DataFrame, holder: DataFrame, fanout: int, top: int | None = None) -> DataFrame:
    """Rows of ``nodes`` that the holder (hash) lacks: neither the position nor one above it is held.

    A held node ends the walk, even if the holder lacks what lies below; so a plain anti join would
    say too much. Each position of an image is one row. ``top`` isn't needed.
    """
    held = holder.where("hash IS NOT NULL").select("hash", F.lit(True).alias("held")).distinct()
    return with_marked_above(nodes.select(NODE).join(held, "hash", "left"), F.col("held"), fanout).where("NOT marked AND NOT above").select(NODE)


def preorder(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``place``, from 1, in a walk of their image that meets parents before children; counted by ranges of pages."""
    placed = before(nodes, ["image_id"], "page_base", F.lit(1), "place", "sum", [F.col("level").desc()])
    return placed.withColumn("place", (F.coalesce("place", F.lit(0)) + 1).cast("long"))


def blob_difference(nodes: DataFrame, holder: DataFrame) -> DataFrame:
    """Distinct hashes of ``nodes`` that the holder lacks."""
    return nodes.select("hash").distinct().join(holder.select("hash").distinct(), "hash", "left_anti")


def want(request: DataFrame, store: DataFrame) -> DataFrame:
    """(pos, hash) of requested hashes that the store lacks, each at its first place."""
    first = request.groupBy("hash").agg(F.min("pos").alias("pos"))
    return first.join(store.select("hash").distinct(), "hash", "left_anti").select("pos", "hash")


def first_occurrence(request: DataFrame) -> DataFrame:
    """Distinct hashes, each at its first place."""
    return request.groupBy("hash").agg(F.min("pos").alias("pos")).select("pos", "hash")


def fetch_nodes(nodes: DataFrame, local: DataFrame, central: DataFrame) -> DataFrame:
    """(hash) of inner nodes to fetch: those of the trees that are not local but central. Goes on below held nodes; never pages."""
    inner = nodes.where("level > 0").select("hash").distinct()
    return inner.join(local.select("hash").distinct(), "hash", "left_anti").join(central.select("hash").distinct(), "hash", "left_semi")


def commit_blobs(missing: DataFrame, pages: DataFrame, nodes: DataFrame, artifacts: DataFrame, store: DataFrame, fanout: int) -> DataFrame:
    """(hash, kind, bytes) to upload for ``missing``, the rows of tree_diff(): 'page', 'node' or 'artifact', each once.

    Pages bring their bytes (image_id, page_no, bytes, hash); a node's bytes are written from its
    children in ``nodes``; of ``artifacts`` (hash, bytes) go those that ``store`` (hash) lacks.
    Reading fails at a blob without bytes, or with bytes that don't hash to its name.
    """
    at = missing.groupBy(packed("hash").alias("hash"), (F.col("level") > 0).alias("inner")).agg(F.min(F.struct("level", "image_id", "node_idx")).alias("at")).select("hash", "at.*")
    leaf = at.where("level = 0").select("hash", "image_id", F.col("node_idx").alias("page_no")).join(pages.select("image_id", "page_no", "bytes"), ["image_id", "page_no"], "left")
    below = nodes.select("image_id", (F.col("level") + 1).alias("level"), div(F.col("node_idx"), fanout).alias("up"), F.struct("node_idx", packed("hash").alias("hash")).alias("c"))
    inner = at.where("level > 0").withColumnRenamed("node_idx", "up").join(below, ["image_id", "level", "up"], "left").groupBy("image_id", "level", "up", "hash").agg(F.array_sort(F.collect_list("c")).alias("c"))
    parts = [
        leaf.select(unpacked("hash").alias("hash"), F.lit("page").alias("kind"), "bytes"),
        inner.select(unpacked("hash").alias("hash"), F.lit("node").alias("kind"), F.encode(node_text(F.transform("c.hash", unpacked)), "utf-8").alias("bytes")),
        artifacts.groupBy("hash").agg(F.any_value("bytes").alias("bytes")).join(store.select("hash"), "hash", "left_anti").select("hash", F.lit("artifact").alias("kind"), "bytes"),
    ]
    rows = reduce(DataFrame.unionByName, parts)
    good = F.sha2("bytes", 256).eqNullSafe(F.col("hash"))
    return rows.select("hash", "kind", F.when(good, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("commit: no good bytes of "), "kind", F.lit(" "), "hash"))).alias("bytes"))
