"""Versions from a stream of dirty pages: each batch updates trees, uploads what is new and commits a version of each image it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import diff, tree
from folio.sources import blobs
from folio.sources.commits import CommitLog
from folio.sources.shared import written
from folio.sources.versions import BUCKETS, Versions, bucket_of
from folio.streaming.run import capture

DIRTY = "image_id long, seq long, page_no long, bytes binary"


def capture_batch(table: Versions, store: CommitLog, shape: DataFrame, dirty: DataFrame, batch: str, number: int, page: int, fanout: int, top: int | None = None) -> bool:
    """Apply one batch of dirty pages (DIRTY); False if it has been applied.

    Only buckets of the batch's images are read. Blobs and version records are committed to
    ``store`` before the table's entry makes the versions visible; a batch that is repeated, after
    whatever part of it was done, leaves each blob, record and version once. Raises tree.Refused as
    update_paths() does, before anything is written to table or store.
    """
    spark = dirty.sparkSession
    if table.has(batch):
        return False
    dirty = written(dirty.select("image_id", "seq", "page_no", "bytes"), "dirty")
    buckets = sorted(r.b for r in dirty.where("image_id IS NOT NULL").select(bucket_of("image_id", table.buckets).alias("b")).distinct().collect())  # at most table.buckets
    seen = table.log.entries()
    before = table.rows(buckets, seen)
    fresh, siblings = tree.update_parts(before, dirty, shape, page, fanout, top)
    fresh = written(fresh, "fresh")
    touched = dirty.groupBy("image_id").agg(F.countDistinct("page_no").alias("dirty_pages"))
    now = tree.root_rows(fresh, shape).join(touched, "image_id")
    old = table.heads(buckets, seen).select("image_id", F.col("id").alias("parent"))
    # 128 bits: of ten digits, two in some million images of a batch are the same
    tail = F.substring(F.sha2(F.concat_ws(":", F.coalesce("parent", F.lit("")), "root", F.col("image_id").cast("string"), F.lit(batch)), 256), 1, 32)
    heads = now.join(old, "image_id", "left").select("image_id", F.concat(F.lit("frm_"), F.lpad(F.hex(F.lit(number)), 12, "0"), tail).alias("id"), "parent", "root", "dirty_pages", F.lit(number).cast("long").alias("version"))
    heads = written(heads, "heads")

    last = tree.last_write_wins(dirty).select("image_id", "page_no", "bytes")
    held = blobs.stored(spark, store.path, store).select("hash")
    none = spark.createDataFrame([], "hash string, bytes binary")
    children = siblings.unionByName(fresh.drop("page_base"))  # versions before are merged once
    up = diff.commit_blobs(fresh.join(held, "hash", "left_anti"), last, children, none, held, fanout)
    record = heads.join(shape.select("image_id", "len"), "image_id").select("id", "parent", F.struct("root", "len").alias("mem_tree"), F.lit(number).cast("long").alias("created_unix_ms"), F.sha2(F.concat(F.lit("snapshot:"), "id"), 256).alias("snapshot"))
    # a version has its parent's artifacts but for its own snapshot
    parents = blobs.records(spark, store.path, store).select(F.col("id").alias("parent"), *[a for a in blobs.ARTIFACTS if a != "snapshot"])
    record = record.join(parents, "parent", "left").select("id", "parent", "mem_tree", "created_unix_ms", *blobs.ARTIFACTS)
    blobs.commit(up.select("hash", "bytes"), record, store.path, batch, store, fresh=True)
    return table.append(fresh, heads, batch)


def versioned(spark: SparkSession, nodes: DataFrame, shape: DataFrame, source: str, path: str, page: int, fanout: int, name: str = "capture", buckets: int = BUCKETS) -> Versions:
    """The table of the versions after all dirty pages (DIRTY) in the folder ``source``, one batch a file.

    Called again it goes on with the files that have come since; with none the table stays as it is.
    ``nodes`` are the rows of the first versions; they count at the first call alone.
    """
    table = Versions(spark, f"{path}/versions", buckets)
    table.start(nodes)
    shape, store = written(shape, "shape"), CommitLog(spark, f"{path}/store")
    top = tree.tallest(shape)
    stream = spark.readStream.schema(DIRTY).option("maxFilesPerTrigger", 1).parquet(source)
    capture(stream, lambda dirty, n: capture_batch(table, store, shape, dirty, f"{name}-{n}", n, page, fanout, top), f"{path}/checkpoint").awaitTermination()
    return table
