"""Queries on pages and trees: A1-A4, B5-B11, C8, C12, C17, D1-D9, D13, W3, and on diffs and plans: C1-C5, C9-C11, C15-C16, D10, D12, O4, O6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog.fixtures import CTE, FANOUT, P, edits, holder, images, leaves, nodes, pages, shape
from folio.functions import geometry as g
from folio.operators import diff, tree
from folio.plans import materialize as m
from folio.sources.shared import written

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("paginate", CTE + "SELECT image_id, node_idx AS page_no, n::BIGINT AS n_bytes, hash FROM l0")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("image_id", "page_no", F.octet_length("bytes").cast("long").alias("n_bytes"), "hash")


@query("tree_geometry", CTE + f"""SELECT image_id, len, page_count, height::BIGINT AS height, len - (page_count - 1) * {P} AS last_page_length,
  ({FANOUT} ** (height - 1))::BIGINT AS root_span, ({FANOUT} ** height)::BIGINT AS root_pages FROM shape""")
def tree_geometry(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("height")
    return shape(spark, d).select("image_id", "len", "page_count", level.cast("long").alias("height"), g.last_page_length(F.col("len"), P).alias("last_page_length"), g.span(level, FANOUT).alias("root_span"), g.subtree_pages(level, FANOUT).alias("root_pages"))


@query("b8_node_path", CTE + f"SELECT image_id, page_no, array_to_string(list_transform(range(height - 1, -1, -1), lambda k: page_no // ({FANOUT} ** k)::BIGINT % {FANOUT}), '/') AS path FROM pages JOIN shape USING (image_id)")
def node_path(spark: SparkSession, d: str) -> DataFrame:
    """Place of a page at each level: its number's digits to the base of the fanout, as many as the image's tree is high."""
    levels = F.sequence(F.col("height") - 1, F.lit(0), F.lit(-1))
    digits = F.transform(levels, lambda k: (g.div(F.col("page_no"), g.subtree_pages(k, FANOUT)) % FANOUT).cast("string"))
    return pages(spark, d).join(shape(spark, d).select("image_id", "height"), "image_id").select("image_id", "page_no", F.concat_ws("/", digits).alias("path"))


@query("merkle_root", CTE + "SELECT image_id, hash AS root, len, page_count, height::BIGINT AS height FROM nodes JOIN shape USING (image_id) WHERE level = height")
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return tree.roots(tree.leaf_rows(pages(spark, d)), shape(spark, d), FANOUT).withColumn("height", F.col("height").cast("long"))


@query("index_blobs", CTE + "SELECT image_id, level::BIGINT AS level, node_idx, page_base, hash FROM nodes")
def index_blobs(spark: SparkSession, d: str) -> DataFrame:
    return tree.index_blobs(leaves(spark, d), shape(spark, d), FANOUT).withColumn("level", F.col("level").cast("long"))


@query("tree_build", CTE + "SELECT hash, count(*) AS uses, min(level)::BIGINT AS level FROM nodes GROUP BY hash")
def tree_build(spark: SparkSession, d: str) -> DataFrame:
    """The blobs that a build stores: each page and node once."""
    return nodes(spark, d).groupBy("hash").agg(F.count("*").alias("uses"), F.min("level").cast("long").alias("level"))


@query("tree_build_nodes", CTE + "SELECT DISTINCT hash, level::BIGINT AS level FROM nodes WHERE level > 0")
def tree_build_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes only: the same roots, and no page is stored."""
    return nodes(spark, d).where("level > 0").select("hash", F.col("level").cast("long").alias("level")).distinct()


@query("dedup_stats", CTE + """SELECT level::BIGINT AS level, count(*) AS puts, count(DISTINCT hash) AS writes FROM nodes GROUP BY level""")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy(F.col("level").cast("long").alias("level")).agg(F.count("*").alias("puts"), F.countDistinct("hash").alias("writes"))


@query("assemble", CTE + "SELECT image_id, sha256(bytes) AS hash, octet_length(bytes)::BIGINT AS len FROM images WHERE octet_length(bytes) > 0")
def assemble(spark: SparkSession, d: str) -> DataFrame:
    return tree.assemble(pages(spark, d)).select("image_id", F.sha2("bytes", 256).alias("hash"), F.octet_length("bytes").cast("long").alias("len"))


_WRITES = "SELECT user_id AS image_id, event_id AS seq, event_id % 7 AS page_no, sha256(event_type || ':' || event_id) AS hash FROM events"


@query("last_write_wins", f"SELECT image_id, page_no, seq, hash FROM (SELECT *, row_number() OVER (PARTITION BY image_id, page_no ORDER BY seq DESC) AS r FROM ({_WRITES})) WHERE r = 1")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    dirty = events.select(F.col("user_id").alias("image_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("page_no"), F.sha2(F.concat("event_type", F.lit(":"), "event_id"), 256).alias("hash"))
    return tree.last_write_wins(dirty)


@query("dirty_extents", f"""WITH e AS (SELECT user_id AS image_id, (event_id % 40) * 500 AS data_off, (event_id % 40) * 500 + 100 + event_id % 900 AS hole_off, 15000::BIGINT AS file_size FROM events),
 p AS (SELECT DISTINCT image_id, file_size, unnest(range(data_off // {P}, (least(hole_off, file_size) + {P - 1}) // {P})) AS page_no FROM e WHERE data_off < least(hole_off, file_size))
 SELECT image_id, page_no, least({P}, file_size - page_no * {P})::BIGINT AS n_bytes FROM p""")
def dirty_extents(spark: SparkSession, d: str) -> DataFrame:
    """Writes of each user as extents of a file of 15 000 bytes."""
    off = (F.col("event_id") % 40) * 500
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("image_id"), off.alias("data_off"), (off + 100 + F.col("event_id") % 900).alias("hole_off"), F.lit(15000).cast("long").alias("file_size"))
    return tree.dirty_extents(e, P)


@query("dirty_pages", CTE + "SELECT image_id, page_no, hash FROM edits")
def dirty_pages(spark: SparkSession, d: str) -> DataFrame:
    parent = pages(spark, d)
    return tree.dirty_pages(parent, tree.patch_apply(parent, edits(parent)))


@query("d13_dirty_fraction", CTE + "SELECT image_id, count(e.page_no) AS dirty, page_count, count(e.page_no) / page_count AS fraction FROM shape LEFT JOIN edits e USING (image_id) WHERE page_count > 0 GROUP BY image_id, page_count")
def dirty_fraction(spark: SparkSession, d: str) -> DataFrame:
    dirty = edits(pages(spark, d)).groupBy("image_id").agg(F.count("*").alias("dirty"))
    all_of = shape(spark, d).where("page_count > 0").join(dirty, "image_id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(0)))
    return all_of.select("image_id", "dirty", "page_count", (F.col("dirty") / F.col("page_count")).alias("fraction"))


@query("patch_apply", CTE + "SELECT image_id, node_idx AS page_no, hash FROM c0")
def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    parent = pages(spark, d)
    return tree.patch_apply(parent, edits(parent)).select("image_id", "page_no", F.sha2("bytes", 256).alias("hash"))


@query("overlay_get", CTE + "SELECT l0.image_id, l0.node_idx AS page_no, coalesce(e.hash, l0.hash) AS hash, CASE WHEN e.hash IS NULL THEN 'base' ELSE 'dirty' END AS layer FROM l0 LEFT JOIN edits e ON e.image_id = l0.image_id AND e.page_no = l0.node_idx")
def overlay_get(spark: SparkSession, d: str) -> DataFrame:
    """Every page looked up in the dirty set first, then in the base."""
    base = pages(spark, d)
    dirty = edits(base).select("image_id", "page_no", F.col("hash").alias("new"))
    return base.select("image_id", "page_no", "hash").join(dirty, ["image_id", "page_no"], "left").select("image_id", "page_no", F.coalesce("new", "hash").alias("hash"), F.when(F.col("new").isNull(), "base").otherwise("dirty").alias("layer"))


@query("image_equal", CTE + "SELECT l0.image_id, sum((l0.hash <> c0.hash)::INT)::BIGINT AS mismatches, sum((l0.hash <> c0.hash)::INT) = 0 AS equal FROM l0 JOIN c0 USING (image_id, node_idx) GROUP BY l0.image_id")
def image_equal(spark: SparkSession, d: str) -> DataFrame:
    parent = pages(spark, d)
    return tree.image_equal(parent, tree.patch_apply(parent, edits(parent)))


@query("tree_update", CTE + "SELECT image_id, hash AS root FROM child JOIN shape USING (image_id) WHERE level = height")
def tree_update(spark: SparkSession, d: str) -> DataFrame:
    """Roots of the next versions by update; the SQL builds them anew."""
    s = shape(spark, d)
    return tree.root_rows(tree.update(nodes(spark, d), edits(pages(spark, d)), s, P, FANOUT), s)


@query("tree_update_hashes", CTE + "SELECT image_id, level::BIGINT AS level, node_idx, hash FROM child")
def tree_update_hashes(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the next versions, given hashes of dirty pages only; the SQL builds them anew."""
    new = tree.update_hashes(nodes(spark, d), edits(pages(spark, d)), shape(spark, d), FANOUT)
    return new.select("image_id", F.col("level").cast("long").alias("level"), "node_idx", "hash")


@query("rebuilt_nodes", CTE + "SELECT c.image_id, c.level::BIGINT AS level, c.node_idx, c.hash FROM child c SEMI JOIN (SELECT DISTINCT e.image_id, u.level, e.page_no >> (2 * u.level) AS node_idx FROM edits e, range(0, 10) u(level)) t USING (image_id, level, node_idx)")
def rebuilt_nodes(spark: SparkSession, d: str) -> DataFrame:
    dirty = edits(pages(spark, d)).select("image_id", "page_no", "hash")
    return tree.rebuilt_nodes(nodes(spark, d), written(dirty, "dirty"), shape(spark, d), FANOUT).select("image_id", F.col("level").cast("long").alias("level"), "node_idx", "hash")


@query("d4_dirty_errors", f"""WITH d AS (SELECT e.user_id AS image_id, CASE WHEN event_id % 11 <> 0 THEN event_id END AS seq, CASE WHEN event_id % 13 <> 0 THEN event_id % 9 END AS page_no, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN {P} ELSE event_id % {P + 1} END AS n_bytes FROM events e),
 s AS (SELECT doc_id AS image_id, octet_length(encode(coalesce(text, '')))::BIGINT AS len FROM documents)
 SELECT * FROM (SELECT image_id, seq, page_no, n_bytes, CASE WHEN page_no IS NULL THEN 'no page' WHEN seq IS NULL THEN 'no seq' WHEN len IS NULL THEN 'unknown image' WHEN len = 0 THEN 'empty image' WHEN page_no >= (len + {P - 1}) // {P} THEN 'page out of range' WHEN n_bytes IS NULL THEN 'no bytes'
  WHEN page_no = (len + {P - 1}) // {P} - 1 AND n_bytes <> len - page_no * {P} THEN 'wrong length of last page' WHEN page_no <> (len + {P - 1}) // {P} - 1 AND n_bytes <> {P} THEN 'wrong length of page' END AS reason
 FROM d LEFT JOIN s USING (image_id)) WHERE reason IS NOT NULL""")
def dirty_errors(spark: SparkSession, d: str) -> DataFrame:
    """Events as writes to the document with the user's number; some lack their order, page or bytes."""
    i = F.col("event_id")
    n = F.when(i % 17 == 0, None).when(i % 3 == 0, P).otherwise(i % (P + 1)).cast("long")
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("image_id"), F.when(i % 11 != 0, i).alias("seq"), F.when(i % 13 != 0, i % 9).alias("page_no"), n.alias("n_bytes"))
    return tree.dirty_errors(e, shape(spark, d), P)


@query("tree_diff", CTE + "SELECT image_id, level::BIGINT AS level, page_base, hash FROM missing")
def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return diff.tree_diff(n, holder(n), FANOUT).select("image_id", F.col("level").cast("long").alias("level"), "page_base", "hash")


@query("c2_self_diff", CTE + "SELECT 'nobody' AS holder, image_id, level::BIGINT AS level, page_base, hash FROM nodes")
def self_diff(spark: SparkSession, d: str) -> DataFrame:
    """Against a holder of everything nothing is missing; against one of nothing every row is, and of an empty image its root."""
    n = nodes(spark, d)
    both = [diff.tree_diff(n, h, FANOUT).withColumn("holder", F.lit(name)) for name, h in (("itself", n.select("hash")), ("nobody", n.select("hash").where("false")))]
    return tree.union(both).select("holder", "image_id", F.col("level").cast("long").alias("level"), "page_base", "hash")


@query("d12_missing_hashes", CTE + "SELECT hash, count(*) AS places FROM missing GROUP BY hash")
def missing_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return diff.tree_diff(n, holder(n), FANOUT).groupBy("hash").agg(F.count("*").alias("places"))


@query("o1_preorder", CTE + "SELECT image_id, level::BIGINT AS level, page_base, hash, row_number() OVER (PARTITION BY image_id ORDER BY page_base, level DESC) AS place FROM missing")
def preorder(spark: SparkSession, d: str) -> DataFrame:
    """Missing positions with their place in a walk that meets parents before children."""
    n = nodes(spark, d)
    return diff.preorder(diff.tree_diff(n, holder(n), FANOUT)).select("image_id", F.col("level").cast("long").alias("level"), "page_base", "hash", "place")


@query("blob_difference", CTE + "SELECT DISTINCT hash FROM nodes WHERE hash NOT IN (SELECT hash FROM holder)")
def blob_difference(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return diff.blob_difference(n, holder(n))


@query("version_delta", CTE + "SELECT c.image_id, count(*) AS positions, count(DISTINCT c.hash) AS blobs FROM child c SEMI JOIN (SELECT DISTINCT e.image_id, u.level, e.page_no >> (2 * u.level) AS node_idx FROM edits e, range(0, 10) u(level)) t USING (image_id, level, node_idx) ANTI JOIN nodes p ON p.hash = c.hash GROUP BY c.image_id")
def version_delta(spark: SparkSession, d: str) -> DataFrame:
    """Positions and blobs of each next version that no first version has."""
    n = nodes(spark, d)
    fresh = tree.rebuilt_nodes(n, written(edits(pages(spark, d)).select("image_id", "page_no", "hash"), "dirty"), shape(spark, d), FANOUT)
    return diff.tree_diff(fresh, n.select("hash"), FANOUT).groupBy("image_id").agg(F.count("*").alias("positions"), F.countDistinct("hash").alias("blobs"))


_FIRST = "min({'image_id': image_id, 'page_no': node_idx})"


@query("want_hashes", CTE + f" SELECT first.image_id, first.page_no, hash FROM (SELECT hash, {_FIRST} AS first FROM l0 WHERE hash NOT IN (SELECT hash FROM holder) GROUP BY hash)")
def want_hashes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    asked = n.where("level = 0").select("hash", F.struct("image_id", F.col("node_idx").alias("page_no")).alias("pos"))
    return diff.want(asked, holder(n)).select("pos.*", "hash")


@query("o6_first_occurrence", CTE + f" SELECT first.image_id, first.page_no, hash FROM (SELECT hash, {_FIRST} AS first FROM l0 GROUP BY hash)")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("hash", F.struct("image_id", "page_no").alias("pos"))
    return diff.first_occurrence(rows).select("pos.*", "hash")


@query("fetch_nodes", CTE + "SELECT DISTINCT hash FROM nodes WHERE level > 0 AND image_id % 2 = 1 AND hash NOT IN (SELECT hash FROM holder)")
def fetch_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes of odd images that the holder must fetch from the store of all."""
    n = nodes(spark, d)
    return diff.fetch_nodes(n.where("image_id % 2 = 1"), holder(n), n.select("hash"))


@query("c7_membership", CTE + "SELECT image_id, count(*) AS held FROM nodes WHERE hash IN (SELECT hash FROM holder) GROUP BY image_id")
def membership(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.join(holder(n), "hash", "left_semi").groupBy("image_id").agg(F.count("*").alias("held"))


def _index(n: DataFrame) -> DataFrame:
    even = n.where("image_id % 2 = 0")
    return m.location_index(even, even.select("image_id").distinct().withColumn("image_seq", F.col("image_id")))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Odd images from even ones."""
    n = nodes(spark, d)
    return written(m.plan(n.where("image_id % 2 = 1"), shape(spark, d), _index(n), FANOUT), "plan")


@query("location_index", CTE + "SELECT hash, level::BIGINT AS level, source, src_page_base FROM loc")
def location_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(nodes(spark, d)).withColumn("level", F.col("level").cast("long"))


@query("c16_locate", CTE + "SELECT n.image_id, n.node_idx AS page_no, source, src_page_base FROM nodes n JOIN loc USING (hash, level) WHERE n.level = 0 AND n.image_id % 2 = 1")
def locate(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return n.where("level = 0 AND image_id % 2 = 1").join(_index(n), ["hash", "level"]).select("image_id", F.col("node_idx").alias("page_no"), "source", "src_page_base")


@query("coarse_index", CTE + "SELECT count(*) AS entries, sum((n.hash IS NOT NULL)::INT)::BIGINT AS hits FROM (SELECT DISTINCT hash FROM loc WHERE level = 1) l LEFT JOIN (SELECT DISTINCT hash FROM nodes WHERE level = 1 AND image_id % 2 = 1) n USING (hash)")
def coarse_index(spark: SparkSession, d: str) -> DataFrame:
    """Only lowest nodes indexed, and how many of the entries another image has."""
    n = nodes(spark, d)
    others = n.where("level = 1 AND image_id % 2 = 1").select("hash", F.lit(1).alias("hit")).distinct()
    return _index(n).where("level = 1").select("hash").distinct().join(others, "hash", "left").agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"))


@query("materialize_plan", CTE + "SELECT image_id, op, dest_page_base, pages, hash, source, src_page_base FROM steps")
def materialize_plan(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d)


@query("o2_step_order", CTE + "SELECT image_id, dest_page_base, op, row_number() OVER (PARTITION BY image_id ORDER BY dest_page_base) AS place FROM steps")
def step_order(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a plan in order of their destination."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy("dest_page_base")
    return _steps(spark, d).select("image_id", "dest_page_base", "op", F.row_number().over(w).cast("long").alias("place"))


_COPIED = "SELECT image_id FROM steps GROUP BY 1 HAVING bool_and(op = 'clone')"


@query("materialize_local", CTE + f"SELECT image_id, node_idx AS page_no, hash FROM l0 WHERE image_id IN ({_COPIED})")
def materialize_local(spark: SparkSession, d: str) -> DataFrame:
    """Images that clones alone rebuild; the SQL takes their pages from the images themselves."""
    steps = _steps(spark, d)
    local = steps.join(steps.where("op = 'gap'").select("image_id").distinct(), "image_id", "left_anti")
    return m.materialize(local, pages(spark, d).where("image_id % 2 = 0")).select("image_id", "page_no", F.sha2("bytes", 256).alias("hash"))


def _central(all_pages: DataFrame) -> DataFrame:
    """Blobs of the odd images, once each."""
    return all_pages.where("image_id % 2 = 1").groupBy("hash").agg(F.any_value("bytes").alias("bytes"))


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    all_pages = pages(spark, d)
    return m.materialize(_steps(spark, d), all_pages.where("image_id % 2 = 0"), _central(all_pages))


@query("materialize_fetch", CTE + "SELECT image_id, node_idx AS page_no, hash FROM l0 WHERE image_id % 2 = 1")
def materialize_fetch(spark: SparkSession, d: str) -> DataFrame:
    return _rebuilt(spark, d).select("image_id", "page_no", F.sha2("bytes", 256).alias("hash"))


@query("materialize_status", CTE + "SELECT s.image_id, (sum(CASE WHEN op = 'clone' THEN pages ELSE 0 END))::BIGINT AS cloned_pages, (sum((op = 'gap' AND hash >= '4')::INT))::BIGINT AS fetched_pages, (sum((op = 'gap' AND hash < '4')::INT))::BIGINT AS failed_pages FROM steps s GROUP BY s.image_id")
def materialize_status(spark: SparkSession, d: str) -> DataFrame:
    """What comes of each page when the blobs named 0.. and 1.. are gone and those named 2.. and 3.. are spoilt."""
    all_pages = pages(spark, d)
    blobs = _central(all_pages).where("hash >= '2'").withColumn("bytes", F.when(F.col("hash") < "4", F.encode(F.lit("spoilt"), "utf-8")).otherwise(F.col("bytes")))
    return m.page_counts(m.page_status(_steps(spark, d), all_pages.where("image_id % 2 = 0"), blobs))


@query("reconstruct", CTE + "SELECT image_id, sha256(bytes) AS hash, octet_length(bytes)::BIGINT AS len, cloned_pages, gap_pages FROM images JOIN (SELECT image_id, sum(CASE WHEN op = 'clone' THEN pages ELSE 0 END)::BIGINT AS cloned_pages, sum(CASE WHEN op = 'gap' THEN pages ELSE 0 END)::BIGINT AS gap_pages FROM steps GROUP BY image_id) USING (image_id)")
def reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Odd images put together again, with the counts of their plans."""
    s = _steps(spark, d)
    all_pages = pages(spark, d)
    whole = tree.assemble(m.materialize(s, all_pages.where("image_id % 2 = 0"), _central(all_pages)))
    return whole.join(m.recon_stats(s), "image_id").select("image_id", F.sha2("bytes", 256).alias("hash"), F.octet_length("bytes").cast("long").alias("len"), "cloned_pages", "gap_pages")


@query("recon_stats", CTE + "SELECT image_id, sum(CASE WHEN op = 'clone' THEN pages ELSE 0 END)::BIGINT AS cloned_pages, sum(CASE WHEN op = 'gap' THEN pages ELSE 0 END)::BIGINT AS gap_pages, sum((op = 'clone')::INT)::BIGINT AS clones FROM steps GROUP BY image_id")
def recon_stats(spark: SparkSession, d: str) -> DataFrame:
    return m.recon_stats(_steps(spark, d))


@query("wire_cost", CTE + f"SELECT image_id, gap_pages * {P} AS gap_bytes, gap_pages * {P} * 8 / 1e9 AS wire_seconds, gap_pages / page_count AS miss FROM (SELECT image_id, sum((op = 'gap')::INT)::BIGINT AS gap_pages FROM steps GROUP BY image_id) JOIN shape USING (image_id)")
def wire_cost(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that gaps cost, at 1 Gbit/s."""
    s = m.recon_stats(_steps(spark, d)).join(shape(spark, d), "image_id")
    return s.select("image_id", (F.col("gap_pages") * P).alias("gap_bytes"), (F.col("gap_pages") * P * 8 / F.lit(1e9)).alias("wire_seconds"), (F.col("gap_pages") / F.col("page_count")).alias("miss"))
