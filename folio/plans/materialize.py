"""Rebuilding images from what is at hand: location index, plan of clones and gaps, and carrying it out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import run_pages
from folio.operators.diff import with_marked_above


def location_index(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """(hash, source, src_page_base, level): where each hash lies. Of several images the last in ``order`` (image_id, image_seq) wins, within one the lowest page.

    An aggregate, so the zero page of a million images is one row a task before the shuffle.
    """
    rows = nodes.join(order, "image_id")
    best = rows.groupBy("hash", "level").agg(F.min(F.struct((-F.col("image_seq")).alias("k"), "page_base", "image_id")).alias("b"))
    return best.select("hash", F.col("b.image_id").alias("source"), F.col("b.page_base").alias("src_page_base"), "level")


def plan(nodes: DataFrame, shape: DataFrame, index: DataFrame, fanout: int, top: int | None = None) -> DataFrame:
    """(image_id, op, dest_page_base, pages, hash, source, src_page_base).

    The largest located subtrees become clones, from any source and offset; pages that no clone
    covers become gaps of one page. Neighbouring clones aren't merged. An empty image has no step.
    One join locates positions, one scan finds those below none; ``top`` isn't needed.
    """
    full = nodes.join(shape.where("page_count > 0").select("image_id", "page_count"), "image_id")
    located = full.join(index.select("hash", "level", "source", "src_page_base"), ["hash", "level"], "left")
    walked = with_marked_above(located, F.col("source").isNotNull(), fanout).where("NOT above AND (marked OR level = 0)")
    pages = F.when(F.col("marked"), run_pages(F.col("level"), F.col("page_base"), F.col("page_count"), fanout)).otherwise(1).cast("long")
    return walked.select("image_id", F.when(F.col("marked"), "clone").otherwise("gap").alias("op"), F.col("page_base").alias("dest_page_base"), pages.alias("pages"), "hash", "source", "src_page_base")


def page_status(steps: DataFrame, sources: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(image_id, page_no, op, status, bytes, hash): every page of the plan, with what came of it.

    A clone takes the page of ``sources`` (image_id, page_no, bytes, hash) at its place and is
    'ok' or 'missing'; a gap takes its blob from ``blobs`` (hash, bytes) and is 'ok', 'missing', or
    'corrupt' where the bytes don't hash to their name; without ``blobs`` each gap is 'unfetched'.
    bytes are null unless 'ok'. Sources and blobs have a place or name once; requests for one that
    many images share are split by adaptive skew joins, as the plan is the streamed side.
    """
    runs = steps.where("op = 'clone'").select("image_id", "source", F.col("dest_page_base").alias("d"), F.col("src_page_base").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).alias("k"))
    want = runs.select("image_id", (F.col("d") + F.col("k")).alias("page_no"), "source", (F.col("s") + F.col("k")).alias("src_page"))
    src = sources.select(F.col("image_id").alias("source"), F.col("page_no").alias("src_page"), "bytes", "hash")
    cloned = want.join(src, ["source", "src_page"], "left").select("image_id", "page_no", F.lit("clone").alias("op"), F.when(F.col("hash").isNull(), "missing").otherwise("ok").alias("status"), "bytes", "hash")
    gaps = steps.where("op = 'gap'").select("image_id", F.col("dest_page_base").alias("page_no"), F.lit("gap").alias("op"), "hash")
    if blobs is None:
        return cloned.unionByName(gaps.select("*", F.lit("unfetched").alias("status"), F.lit(None).cast("binary").alias("bytes")))
    found = gaps.join(blobs.select("hash", F.col("bytes").alias("b"), F.lit(True).alias("there")), "hash", "left")
    status = F.when(F.col("there").isNull(), "missing").when(~F.sha2("b", 256).eqNullSafe(F.col("hash")), "corrupt").otherwise("ok")
    return cloned.unionByName(found.withColumn("status", status).select("image_id", "page_no", "op", "status", F.when(F.col("status") == "ok", F.col("b")).alias("bytes"), "hash"))


def materialize(steps: DataFrame, sources: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(image_id, page_no, bytes, hash) of all pages of the plan; reading it fails at the first page that isn't 'ok'.

    Without ``blobs`` the plan must have no gap.
    """
    rows = page_status(steps, sources, blobs)
    why = F.raise_error(F.format_string("materialize: page %d of image %d: %s is %s", "page_no", "image_id", "op", "status"))
    return rows.select("image_id", "page_no", F.when(F.col("status") == "ok", F.col("bytes")).otherwise(why).alias("bytes"), "hash")


def page_counts(status: DataFrame) -> DataFrame:
    """(image_id, cloned_pages, fetched_pages, failed_pages) from page_status()."""
    n = lambda test: F.count(F.when(test, 1)).cast("long")
    ok = F.col("status") == "ok"
    return status.groupBy("image_id").agg(n(ok & (F.col("op") == "clone")).alias("cloned_pages"), n(ok & (F.col("op") == "gap")).alias("fetched_pages"), n(~ok).alias("failed_pages"))


def recon_stats(steps: DataFrame) -> DataFrame:
    """(image_id, cloned_pages, gap_pages, clones)."""
    of = lambda op, x: F.sum(F.when(F.col("op") == op, x).otherwise(0)).cast("long")
    return steps.groupBy("image_id").agg(of("clone", F.col("pages")).alias("cloned_pages"), of("gap", F.col("pages")).alias("gap_pages"), of("clone", F.lit(1)).alias("clones"))
