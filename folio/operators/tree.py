"""Images as pages and hash trees: cut, fold, update, patch, compare and put together.

An image is a row (image_id, bytes). Its pages are rows (image_id, page_no, bytes, hash); the nodes
of its tree are rows (image_id, level, node_idx, page_base, hash), pages being level 0. A node's
hash covers the number and the hashes of its children in order. The root is never a page: an empty
image has the empty node as its root. Trees are folded, compared and updated on hashes alone; only operators that return bytes move them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.geometry import FANOUT, PAGE, div, height, last_page_length, page_count
from folio.operators.scans import before
from folio.sources.shared import written

NODE = ["image_id", "level", "node_idx", "page_base", "hash"]


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def packed(name: Column | str) -> Column:
    """A hash in hex as its 32 bytes, to be moved; any other name as itself, after as many bytes that are none."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.rlike("^[0-9a-f]{64}$"), F.unhex(name)).otherwise(F.concat(F.lit(bytes(33)), F.encode(name, "utf-8")))


def unpacked(name: Column | str) -> Column:
    """What packed() was given."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.octet_length(name) == 32, F.lower(F.hex(name))).otherwise(F.decode(F.substring(name, 34, F.octet_length(name)), "utf-8"))


def node_text(children: Column) -> Column:
    """What a node's hash covers: the number of its children, and their hashes in order."""
    return F.concat(F.size(children).cast("string"), F.lit(":"), F.array_join(children, ""))


def node_hash(children: Column) -> Column:
    """Hash of an ordered array of child hashes."""
    return F.sha2(node_text(children), 256)


def sizes(images: DataFrame, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(image_id, len, page_count, height); null bytes count as empty."""
    n = F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")
    return images.select("image_id", n.alias("len")).withColumn("page_count", page_count(F.col("len"), page)).withColumn("height", height(F.col("page_count"), fanout))


def paginate(images: DataFrame, page: int = PAGE) -> DataFrame:
    """(image_id, page_no, bytes, hash): runs of ``page`` bytes, the last one as short as it is. An empty image has no page."""
    whole = images.where(F.octet_length("bytes") > 0)
    cut = whole.select("image_id", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), page_count(F.octet_length("bytes").cast("long"), page) - 1)).alias("page_no"))
    piece = F.expr(f"substring(bytes, CAST(page_no * {page} + 1 AS INT), {page})")
    return cut.select("image_id", "page_no", piece.alias("bytes")).withColumn("hash", content_hash(F.col("bytes")))


def leaf_rows(pages: DataFrame) -> DataFrame:
    return pages.select("image_id", F.lit(0).alias("level"), F.col("page_no").alias("node_idx"), F.col("page_no").alias("page_base"), "hash")


#: Most nodes of a level whose subtree is folded in one step.
CHUNK = 4096


def steps(fanout: int) -> int:
    """Levels of a subtree that are folded in one step: as many as keep it within CHUNK nodes below."""
    s = 1
    while fanout ** (s + 1) <= CHUNK:
        s += 1
    return s


def tallest(shape: DataFrame) -> int:
    """The height of the tallest tree: one number."""
    return shape.agg(F.max("height")).first()[0] or 0


def _folded(rows: DataFrame, base: int, s: int, fanout: int) -> DataFrame:
    """(image_id, height, level, node_idx, hash): the nodes of levels base + 1 .. base + s above rows (image_id, height, node_idx, hash) of level ``base``.

    A group is a subtree of fanout ** s rows at most; its levels are arrays, each made of slices of
    the one below, so all of them come from one aggregate. They end at the height of the tree.
    """
    cut = rows.groupBy("image_id", "height", div(F.col("node_idx"), fanout**s).alias("part")).agg(F.array_sort(F.collect_list(F.struct("node_idx", "hash"))).alias("c")).withColumn("l0", F.col("c.hash")).drop("c")

    def above(k: int) -> Column:
        below = F.col(f"l{k - 1}")
        up = F.transform(F.sequence(F.lit(0), F.size(below) - 1, F.lit(fanout)), lambda i: node_hash(F.slice(below, i + 1, fanout)))
        return F.when(F.col("height") >= base + k, up).otherwise(F.array().cast("array<string>"))

    def placed(k: int) -> Column:
        return F.transform(f"l{k}", lambda h, i: F.struct(F.lit(base + k).alias("level"), (F.col("part") * fanout ** (s - k) + i).cast("long").alias("node_idx"), h.alias("hash")))

    for k in range(1, s + 1):
        cut = cut.withColumn(f"l{k}", above(k))
    return cut.select("image_id", "height", F.explode(F.concat(*map(placed, range(1, s + 1)))).alias("n")).select("image_id", "height", "n.level", "n.node_idx", "n.hash")


def fold(leaves: DataFrame, shape: DataFrame, fanout: int = FANOUT, top: int | None = None) -> list[DataFrame]:
    """Nodes of levels 1, 2, ... of all images at once, several levels a step; a step holds only trees that high."""
    top = tallest(shape) if top is None else top
    s = steps(fanout)
    rows, out = leaves.join(shape.select("image_id", "height"), "image_id").select("image_id", "height", "node_idx", "hash"), []
    for base in range(0, top, s):
        found = _folded(rows.where(F.col("height") > base), base, s, fanout)
        if base + s < top:
            found = written(found, "fold")  # a step smaller by fanout ** s, and read by the next one
        power = F.element_at(F.array(*[F.lit(fanout**k).cast("long") for k in range(base + 1, base + s + 1)]), F.col("level") - base)
        out.append(found.select("image_id", "level", "node_idx", (F.col("node_idx") * power).alias("page_base"), "hash"))
        rows = found.where(F.col("level") == base + s).select("image_id", "height", "node_idx", "hash")
    return out


def empty_roots(shape: DataFrame) -> DataFrame:
    return shape.where("page_count = 0").select("image_id", F.lit(1).alias("level"), F.lit(0).cast("long").alias("node_idx"), F.lit(0).cast("long").alias("page_base"), node_hash(F.array().cast("array<string>")).alias("hash"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def index_blobs(leaves: DataFrame, shape: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every page and node of every image. ``leaves`` is read once a level: pass a written or cached table of hashes."""
    return union([leaves.select(NODE), *fold(leaves, shape, fanout), empty_roots(shape)])


def roots(leaves: DataFrame, shape: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(image_id, root, len, page_count, height)."""
    top = [x.join(shape.select("image_id", F.col("height").alias("level")), ["image_id", "level"]).select("image_id", F.col("hash").alias("root")) for x in (*fold(leaves, shape, fanout), empty_roots(shape))]
    return shape.join(union(top), "image_id").select("image_id", "root", "len", "page_count", "height")


def last_write_wins(dirty: DataFrame) -> DataFrame:
    """Of the rows for one page the one with the largest seq; an aggregate, so repeated writes of a hot page combine early.

    A null seq is the least. Rows that share a seq are told apart by a hash of their values, so a
    repeated run keeps the same one.
    """
    rest = [c for c in dirty.columns if c not in ("image_id", "page_no", "seq")]
    best = dirty.groupBy("image_id", "page_no").agg(F.max_by(F.struct("seq", *rest), F.struct("seq", F.xxhash64(F.lit(0), *rest))).alias("r"))
    return best.select("image_id", "page_no", "r.*")


def dirty_pages(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(image_id, page_no, hash) of pages of ``child`` that differ from ``parent`` or are new; a page that is gone has a null hash."""
    p, c = (x.select("image_id", "page_no", F.col("hash").alias(n)) for x, n in ((parent, "was"), (child, "hash")))
    return p.join(c, ["image_id", "page_no"], "full").where("NOT (was <=> hash)").select("image_id", "page_no", "hash")


def dirty_extents(extents: DataFrame, page: int = PAGE) -> DataFrame:
    """(image_id, page_no, n_bytes): each page that some extent [data_off, hole_off) touches, once, clipped to the file.

    Extents become ranges of pages, of which each gives only the pages beyond the farthest one before
    it; so pages are made once, however many extents cover them. An image's file has one size, the
    largest that its rows name.
    """
    stop = F.least("hole_off", "file_size")
    some = extents.where(F.col("data_off") < stop).select("image_id", "file_size", div(F.col("data_off"), page).alias("first"), (div(stop + (page - 1), page) - 1).alias("last"))
    ranges = some.groupBy("image_id", "first").agg(F.max("last").alias("last"), F.max("file_size").alias("size"))
    sizes = ranges.groupBy("image_id").agg(F.max("size").alias("file_size"))
    reached = before(ranges, ["image_id"], "first", F.col("last"), "reach", "max").withColumn("first", F.greatest("first", F.col("reach") + 1)).where("first <= last")
    run = reached.join(sizes, "image_id").select("image_id", "file_size", F.explode(F.sequence("first", "last")).alias("page_no"))
    return run.select("image_id", "page_no", F.least(F.lit(page), F.col("file_size") - F.col("page_no") * page).cast("long").alias("n_bytes"))


def dirty_errors(dirty: DataFrame, shape: DataFrame, page: int | None = PAGE) -> DataFrame:
    """Rows of ``dirty`` (image_id, seq, page_no, n_bytes) that an update must refuse, with the reason; with no ``page``, lengths aren't looked at.

    A row without an image, a page, an order or bytes is refused as such: a null seq would leave open
    which of several writes is the last.
    """
    d = (dirty if page else dirty.withColumn("n_bytes", F.lit(None).cast("long"))).join(shape, "image_id", "left")
    last = F.col("page_no") == F.col("page_count") - 1
    why = F.when(F.col("image_id").isNull(), "no image").when(F.col("page_no").isNull(), "no page").when(F.col("seq").isNull(), "no seq")
    why = why.when(F.col("len").isNull(), "unknown image").when(F.col("len") == 0, "empty image").when((F.col("page_no") < 0) | (F.col("page_no") >= F.col("page_count")), "page out of range")
    if page:
        n = F.col("n_bytes")
        why = why.when(n.isNull(), "no bytes").when(last & (n != last_page_length(F.col("len"), page)), "wrong length of last page").when(~last & (n != page), "wrong length of page")
    elif "hash" in dirty.columns:
        why = why.when(F.col("hash").isNull(), "no hash")
    return d.select("image_id", "seq", "page_no", "n_bytes", why.alias("reason")).where("reason IS NOT NULL")


class Refused(ValueError):
    """An update names a page that its image doesn't have, or has the wrong length."""


def _refuse(dirty: DataFrame, shape: DataFrame, page: int | None) -> None:
    bad = dirty_errors(dirty, shape, page).head()
    if bad:
        raise Refused(f"update refused: page {bad.page_no} of image {bad.image_id}: {bad.reason}")


def update_paths(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, page: int = PAGE, fanout: int = FANOUT, top: int | None = None) -> DataFrame:
    """Rows that dirty pages (image_id, seq, page_no, bytes) change. Of several writes of a page the last by seq counts.

    Raises Refused before any tree is folded if a write names an unknown or empty image, a page out
    of range, or has not the length of its page.
    """
    return update_parts(nodes, dirty, shape, page, fanout, top)[0]


def update_parts(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, page: int = PAGE, fanout: int = FANOUT, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """update_paths(), and the untouched children (image_id, level, node_idx, hash) of the nodes that it changes: all that their bytes need."""
    sized = written(dirty.select("image_id", "seq", "page_no", F.octet_length("bytes").cast("long").alias("n_bytes"), content_hash(F.col("bytes")).alias("hash")), "dirty")
    _refuse(sized, shape, page)
    return _rebuilt(nodes, last_write_wins(sized.drop("n_bytes")), shape, fanout, top, True)


def update(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """All rows of the next versions: those of update_paths(), and the untouched ones. Without writes the versions stay as they are."""
    return _over(nodes, update_paths(nodes, dirty, shape, page, fanout))


def update_hashes(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """update() from hashes (image_id, seq, page_no, hash) whose bytes are elsewhere: only ranges can be checked."""
    kept = written(dirty.select("image_id", "seq", "page_no", "hash"), "dirty")
    _refuse(kept, shape, None)
    return updated(nodes, last_write_wins(kept), shape, fanout)


def _refold(base: int, s: int, fanout: int):
    """From rows (image_id, height, part, level, node_idx, hash, fresh), sorted by image and part, to the fresh nodes of levels base + 1 .. base + s above them.

    A part of an image is a subtree, a bounded number of rows; those of a task are folded one after the other.
    """

    def folded(image: int, height: int, rows: list, out: list) -> None:
        held: dict[int, dict[int, str]] = {k: {} for k in range(base, base + s + 1)}
        fresh: dict[int, set[int]] = {k: set() for k in range(base, base + s + 1)}
        for level, node, h, new in rows:
            held[level][node] = h
            if new:
                fresh[level].add(node)
        for level in range(base + 1, min(base + s, height) + 1):
            below = held[level - 1]
            for up in sorted({k // fanout for k in fresh[level - 1]}):
                kids = [below[k] for k in range(up * fanout, (up + 1) * fanout) if k in below]
                h = hashlib.sha256(f"{len(kids)}:{''.join(kids)}".encode()).hexdigest()
                held[level][up] = h
                fresh[level].add(up)
                out.append((image, height, level, up, up * fanout**level, h))

    def batch_of(out: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["image_id", "height", "level", "node_idx", "page_base", "hash"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for batch in batches:
            for image, height, part, *row in zip(*(batch.column(c).to_pylist() for c in ("image_id", "height", "part", "level", "node_idx", "hash", "fresh")), strict=True):
                if at != (image, part, height):
                    if rows:
                        folded(at[0], at[2], rows, out)
                    at, rows = (image, part, height), []
                rows.append(row)
            if out:
                yield batch_of(out)
                out = []
        if rows:
            folded(at[0], at[2], rows, out)
        if out:
            yield batch_of(out)

    return each


def rebuilt_nodes(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, fanout: int = FANOUT, top: int | None = None) -> DataFrame:
    """Rows of all levels that dirty pages (image_id, page_no, hash) change: the pages, and the nodes above them.

    Work follows the dirty pages, not the image: one join takes the siblings of all touched nodes, and
    a step folds several levels of each touched subtree, a group of bounded size. ``top`` is the height
    of the tallest tree, if it is known.
    """
    return _rebuilt(nodes, dirty, shape, fanout, top, False)[0]


def _rebuilt(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, fanout: int, top: int | None, both: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of rebuilt_nodes(), and the siblings they are made with, written if ``both`` are read."""
    top, s = tallest(shape) if top is None else top, steps(fanout)
    high = shape.select("image_id", "height")
    touched = dirty.join(high, "image_id").select("image_id", "height", "page_no", "hash")
    levels = F.explode(F.sequence(F.lit(1), F.col("height")))
    power = F.element_at(F.array(*[F.lit(fanout**k).cast("long") for k in range(1, max(top, 1) + 1)]), F.col("up_level"))
    paths = touched.withColumn("up_level", levels).select("image_id", "height", "up_level", div(F.col("page_no"), power).alias("up")).distinct()
    # children of touched nodes that aren't touched themselves
    kids = nodes.select("image_id", "level", "node_idx", packed("hash").alias("hash")).withColumns({"up_level": F.col("level") + 1, "up": div(F.col("node_idx"), fanout)})
    inner = paths.select("image_id", F.col("up_level").alias("level"), F.col("up").alias("node_idx"))
    changed = inner.unionByName(touched.select("image_id", F.lit(0).alias("level"), F.col("page_no").alias("node_idx")))
    old = kids.join(paths, ["image_id", "up_level", "up"]).join(changed, ["image_id", "level", "node_idx"], "left_anti").select("image_id", "height", "level", "node_idx", unpacked("hash").alias("hash"), F.lit(False).alias("fresh"))
    now = touched.select("image_id", "height", F.lit(0).alias("level"), F.col("page_no").alias("node_idx"), "hash", F.lit(True).alias("fresh"))
    out = [dirty.select("image_id", F.lit(0).alias("level"), F.col("page_no").alias("node_idx"), F.col("page_no").alias("page_base"), "hash")]
    if top > s or both:
        old = written(old, "siblings")  # each step reads its own levels
    for base in range(0, top, s):
        mine = now.unionByName(old.where((F.col("level") >= base) & (F.col("level") < base + s)) if top > s else old).where(F.col("height") > base)
        size = F.element_at(F.array(*[F.lit(fanout ** (s - k)).cast("long") for k in range(s)]), F.col("level") - base + 1)
        parts = mine.withColumn("part", div(F.col("node_idx"), size)).repartition("image_id", "part").sortWithinPartitions("image_id", "part")
        made = parts.mapInArrow(_refold(base, s, fanout), "image_id long, height int, level int, node_idx long, page_base long, hash string")
        if base + s < top:
            made = written(made, "refold")
        out.append(made)
        now = made.where(F.col("level") == base + s).select("image_id", "height", "level", "node_idx", "hash", F.lit(True).alias("fresh"))
    return union([x.select(NODE) for x in out]), old.select("image_id", "level", "node_idx", "hash")


def _over(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``nodes`` with ``fresh`` in place of the rows at their positions. ``fresh`` is read twice, so it is written once."""
    fresh = written(fresh, "fresh")
    return nodes.select(NODE).join(fresh.select("image_id", "level", "node_idx"), ["image_id", "level", "node_idx"], "left_anti").select(NODE).unionByName(fresh)


def updated(nodes: DataFrame, dirty: DataFrame, shape: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """All rows of the new versions: the rebuilt ones, and those of ``nodes`` that nothing touched."""
    return _over(nodes, rebuilt_nodes(nodes, dirty, shape, fanout))


def root_rows(nodes: DataFrame, shape: DataFrame) -> DataFrame:
    """(image_id, root) from the rows of all levels."""
    return nodes.join(shape.select("image_id", F.col("height").alias("level")), ["image_id", "level"]).select("image_id", F.col("hash").alias("root"))


def patch_apply(pages: DataFrame, dirty: DataFrame) -> DataFrame:
    """Pages of the child: those of the parent, with dirty pages (image_id, page_no, bytes, hash) in their place."""
    d = dirty.select("image_id", "page_no", F.col("bytes").alias("new_bytes"), F.col("hash").alias("new_hash"))
    return pages.join(d, ["image_id", "page_no"], "left").select("image_id", "page_no", F.coalesce("new_bytes", "bytes").alias("bytes"), F.coalesce("new_hash", "hash").alias("hash"))


def image_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """(image_id, mismatches, equal) of two page tables, by hash."""
    a, b = (x.select("image_id", "page_no", F.col("hash").alias(n)) for x, n in ((left, "l"), (right, "r")))
    odd = F.sum(F.when(F.expr("l <=> r"), 0).otherwise(1))
    return a.join(b, ["image_id", "page_no"], "full").groupBy("image_id").agg(odd.cast("long").alias("mismatches")).withColumn("equal", F.col("mismatches") == 0)


def assemble(pages: DataFrame) -> DataFrame:
    """(image_id, bytes): pages in order. For images that fit a row; larger ones stay pages."""
    return pages.groupBy("image_id").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY page_no)").alias("bytes"))
