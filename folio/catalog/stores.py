"""Queries on blob stores, records and lineage: A5-A15, B24-B26, C6, C13-C14, O3-O4, L1-L4, H1-H9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog.fixtures import CTE, FANOUT, P, edits, holder, images, nodes, pages, shape, table
from folio.operators import bloom, diff, lineage, reach, tree
from folio.sources import blobs, packs
from folio.sources.shared import shared_path, written
from folio.streaming.capture import versioned

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_EVEN = "even AS (SELECT DISTINCT hash FROM l0 WHERE image_id % 2 = 0)"


def _places(p: DataFrame) -> DataFrame:
    """A request (pos, hash) for every page."""
    return p.select(F.struct("image_id", "page_no").alias("pos"), "hash")


def _even(p: DataFrame) -> DataFrame:
    return p.where("image_id % 2 = 0").groupBy("hash").agg(F.any_value("bytes").alias("bytes"))


@query("blob_put", CTE + f", {_EVEN} SELECT DISTINCT hash, n::BIGINT AS n_bytes FROM l0 WHERE hash NOT IN (SELECT hash FROM even)")
def blob_put(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return blobs.put(p.select("bytes"), _even(p)).select("hash", "n_bytes")


@query("blob_verify", CTE + f", {_EVEN} SELECT image_id, node_idx AS page_no, hash, CASE WHEN hash NOT IN (SELECT hash FROM even) THEN 'missing' WHEN hash < '2' THEN 'corrupt' ELSE 'ok' END AS status FROM l0")
def blob_verify(spark: SparkSession, d: str) -> DataFrame:
    """All pages looked up in a store of even images, of which those named 0.. and 1.. are spoilt."""
    p = pages(spark, d)
    spoilt = _even(p).withColumn("bytes", F.when(F.col("hash") < "2", F.encode(F.lit("spoilt"), "utf-8")).otherwise(F.col("bytes")))
    return blobs.verify(_places(p), spoilt).select("pos.*", "hash", "status")


@query("blob_batch_get", CTE + "SELECT image_id, node_idx AS page_no, hash, n::BIGINT AS n_bytes FROM l0")
def blob_batch_get(spark: SparkSession, d: str) -> DataFrame:
    """Every place of every page asked of a store of all."""
    p = pages(spark, d)
    return blobs.batch_get(_places(p), blobs.put(p.select("bytes"), spark.createDataFrame([], "hash string"))).select("pos.*", "hash", F.octet_length("bytes").cast("long").alias("n_bytes"))


@query("commit_blobs", CTE + "SELECT hash, min(n)::BIGINT AS n_bytes FROM l0 GROUP BY hash")
def commit_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Even images committed, then all of them, then all again: each blob is stored once."""
    p, path = pages(spark, d).select("image_id", "hash", "bytes"), shared_path(spark, "store")
    record = frames(spark, d)
    blobs.commit(p.where("image_id % 2 = 0"), record.where("created_unix_ms % 2 = 0"), path)
    blobs.commit(p, record, path)
    assert blobs.commit(p, record, path) == 0
    return blobs.stored(spark, path).select("hash", "n_bytes")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Version records: orders of a customer in order of date are a chain of versions."""
    o = versions(spark, d)
    h = lambda k: F.sha2(F.concat(F.lit(k), F.lit(":"), "id"), 256)
    return o.select("id", "parent", F.struct(h("root").alias("root"), F.col("created_unix_ms").alias("len")).alias("mem_tree"), "created_unix_ms", *[h(a).alias(a) for a in blobs.ARTIFACTS])


def versions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    name = lambda k: F.concat(F.lit("frm_"), F.lpad(F.col(k).cast("string"), 12, "0"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("before", F.lag("o_orderkey").over(w)).select(name("o_orderkey").alias("id"), name("before").alias("parent"), F.col("o_orderkey").alias("created_unix_ms"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))


_V = """WITH RECURSIVE v AS (SELECT 'frm_' || lpad(o_orderkey::VARCHAR, 12, '0') AS id, 'frm_' || lpad((lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::VARCHAR, 12, '0') AS parent,
 o_orderkey AS created_unix_ms, o_custkey AS customer, o_orderdate AS at, o_totalprice AS price FROM orders),
 up AS (SELECT id, id AS ancestor, parent, 0::BIGINT AS depth FROM v UNION ALL SELECT up.id, v.id, v.parent, depth + 1 FROM up JOIN v ON v.id = up.parent) """


@query("frame_get", _V + "SELECT id, parent, sha256('root:' || id) AS root, sha256('kernel:' || id) AS kernel FROM v")
def frame_get(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON, and each read back by its id."""
    path = shared_path(spark, "store")
    blobs.commit(pages(spark, d).limit(0).select("hash", "bytes"), frames(spark, d), path)
    asked = versions(spark, d).select("id")
    return blobs.records(spark, path).join(asked, "id", "left_semi").select("id", "parent", "mem_tree.root", "kernel")


@query("frame_list", _V + "SELECT id FROM v")
def frame_list(spark: SparkSession, d: str) -> DataFrame:
    """Names of the versions that a store's folder holds, after two commits."""
    path, f, none = shared_path(spark, "store"), frames(spark, d), pages(spark, d).where("false").select("hash", "bytes")
    blobs.commit(none, f.where("created_unix_ms % 2 = 0"), path)
    blobs.commit(none, f, path)
    return blobs.records(spark, path).select("id")


@query("b25_version_id", _V + "SELECT id, 'frm_' || lpad(upper(to_hex(created_unix_ms)), 12, '0') || substr(sha256(coalesce(parent, '') || ':' || sha256('root:' || id)), 1, 10) AS name FROM v")
def version_id(spark: SparkSession, d: str) -> DataFrame:
    """Ids that sort by time and are the same when a commit is tried again."""
    f = frames(spark, d)
    tail = F.substring(F.sha2(F.concat(F.coalesce("parent", F.lit("")), F.lit(":"), "mem_tree.root"), 256), 1, 10)
    return f.select("id", F.concat(F.lit("frm_"), F.lpad(F.hex("created_unix_ms"), 12, "0"), tail).alias("name"))


@query("frame_ids", _V + "SELECT id FROM v WHERE created_unix_ms % 3 = 0 OR created_unix_ms % 2 = 0")
def frame_ids(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    return blobs.frame_ids(v.where("created_unix_ms % 3 = 0"), v.where("created_unix_ms % 2 = 0"))


@query("tiered_lookup", _V + "SELECT id, CASE WHEN created_unix_ms % 3 = 0 OR created_unix_ms % 2 = 0 THEN created_unix_ms END AS value, CASE WHEN created_unix_ms % 3 = 0 THEN 'local' WHEN created_unix_ms % 2 = 0 THEN 'central' ELSE 'none' END AS tier FROM v")
def tiered_lookup(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d).select("id", F.col("created_unix_ms").alias("value"))
    return blobs.tiered(v, v.where("value % 3 = 0"), v.where("value % 2 = 0"))


@query("artifact_inherit", _V + "SELECT v.id, v.parent, CASE WHEN v.parent IS NULL THEN sha256('kernel:' || v.id) ELSE sha256('kernel:' || v.parent) END AS kernel, sha256('snapshot:' || v.id) AS snapshot FROM v")
def artifact_inherit(spark: SparkSession, d: str) -> DataFrame:
    """A child has its parent's kernel and its own snapshot; a seed has both of its own."""
    f = frames(spark, d)
    children = f.select("id", "parent", F.when(F.col("parent").isNull(), F.col("kernel")).alias("kernel"), "snapshot")
    return lineage.inherit(children, f, ["kernel", "snapshot"])


@query("lineage", _V + "SELECT id, arg_max(ancestor, depth) AS root, max(depth) AS depth FROM up GROUP BY id")
def lineage_of(spark: SparkSession, d: str) -> DataFrame:
    return lineage.lineage(versions(spark, d))


@query("ancestors", _V + "SELECT id, ancestor, depth FROM up")
def ancestors_of(spark: SparkSession, d: str) -> DataFrame:
    """Each version with all its ancestors."""
    return lineage.ancestors(versions(spark, d))


@query("nearest_ancestor", _V + "SELECT id, arg_min(ancestor, depth) AS ancestor, min(depth) AS depth FROM up WHERE substr(ancestor, -1) IN ('0', '4', '7') GROUP BY id")
def nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    return lineage.nearest_ancestor(v, v.where("right(id, 1) IN ('0', '4', '7')"))


@query("chain_depth", _V + "SELECT customer, max(depth) AS depth, count(DISTINCT id) AS versions FROM up JOIN v USING (id) GROUP BY customer")
def chain_depth(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d)
    return lineage.lineage(v).join(v.select("id", "customer"), "id").groupBy("customer").agg(F.max("depth").alias("depth"), F.count("*").alias("versions"))


@query("evict_candidates", "WITH c AS (SELECT o_custkey AS lineage, max(o_orderdate) AS last_used, count(*) * 1000 AS n_bytes FROM orders GROUP BY 1), r AS (SELECT *, (sum(n_bytes) OVER (ORDER BY last_used DESC, lineage DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS kept_bytes FROM c) SELECT lineage, last_used, n_bytes, kept_bytes FROM r WHERE kept_bytes > 500000")
def evict_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Customers as lineages of a thousand bytes an order; half a megabyte stays."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("lineage")).agg(F.max("o_orderdate").alias("last_used"), (F.count("*") * 1000).alias("n_bytes"))
    return lineage.evict(c, 500_000)


@query("pack_index", CTE + f", e AS (SELECT hash, 'pack' || lpad((image_id % 7)::VARCHAR, 3, '0') AS pack, image_id * 10000000000 + node_idx * {P} AS off, n FROM l0), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY pack DESC, off DESC) AS k FROM e WHERE pack <> 'pack003') SELECT hash, pack, off AS \"offset\", n::BIGINT AS len FROM r WHERE k = 1")
def pack_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages in seven packs, one of which is lost."""
    pack = F.concat(F.lit("pack"), F.lpad((F.col("image_id") % 7).cast("string"), 3, "0"))
    e = pages(spark, d).select("hash", pack.alias("pack"), (F.col("image_id") * 10_000_000_000 + F.col("page_no") * P).alias("offset"), F.octet_length("bytes").cast("long").alias("len"))
    return blobs.pack_index(e, e.where("pack <> 'pack003'").select("pack").distinct())


@query("a10_locate", CTE + f", e AS (SELECT hash, image_id AS pack, node_idx * {P} AS off, n FROM l0 WHERE image_id % 2 = 0), r AS (SELECT hash, arg_max({{'p': pack, 'o': off, 'n': n}}, {{'p': pack, 'o': off}}) AS b FROM e GROUP BY hash) SELECT l0.image_id, l0.node_idx AS page_no, r.b.p AS pack, r.b.o AS \"offset\", r.b.n::BIGINT AS len FROM l0 LEFT JOIN r USING (hash)")
def a10_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where each page lies in packs that even images make; null where it is in none."""
    p = pages(spark, d)
    even = p.where("image_id % 2 = 0").select("hash", F.col("image_id").alias("pack"), (F.col("page_no") * P).alias("offset"), F.octet_length("bytes").cast("long").alias("len"))
    return blobs.locate(p.select("hash", "image_id", "page_no"), blobs.pack_index(even, even)).select("image_id", "page_no", "pack", "offset", "len")


@query("range_read", CTE + f"SELECT node_idx AS page_no, image_id AS pack, hash FROM l0")
def range_read(spark: SparkSession, d: str) -> DataFrame:
    """Every page read as a range of its image."""
    whole = images(spark, d).select(F.col("image_id").alias("pack"), "bytes")
    asked = pages(spark, d).select(F.col("image_id").alias("pack"), F.struct("image_id", "page_no").alias("hash"), (F.col("page_no") * P).alias("offset"), F.octet_length("bytes").cast("long").alias("len"))
    return blobs.range_read(asked, whole).select("hash.page_no", F.col("hash.image_id").alias("pack"), F.sha2("bytes", 256).alias("hash"))


@query("pack_ranges", CTE + "SELECT hash, hash AS found, min(n)::BIGINT AS len FROM l0 GROUP BY hash")
def pack_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Blobs written to pack files, found by the packs' own indexes, and read range by range."""
    spark.dataSource.register(packs.PackSource)
    path = shared_path(spark, "packs")
    blobs.put(pages(spark, d).select("bytes"), spark.createDataFrame([], "hash string")).select("hash", "bytes").write.format("folio-packs").mode("append").save(path)
    return packs.range_read(packs.index(spark, path), path).select("hash", F.sha2("bytes", 256).alias("found"), "len")


@query("a15_file_hash", "SELECT page_id, sha256(coalesce(html, '')) AS hash, octet_length(encode(coalesce(html, '')))::BIGINT AS len FROM pages")
def file_hash(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the web as files of a folder, hashed whole, empty ones too."""
    path = shared_path(spark, "files")
    packs.write_files(table(spark, d, "pages").select(F.concat(F.lit("page-"), "page_id").alias("name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("bytes")), path)
    return blobs.file_hashes(spark, path).select(F.regexp_extract("path", "page-(-?[0-9]+)$", 1).cast("long").alias("page_id"), "hash", "len")


@query("a12_export", CTE + "SELECT hash, substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS path, min(n)::BIGINT AS len FROM l0 GROUP BY hash")
def blob_export(spark: SparkSession, d: str) -> DataFrame:
    chosen = pages(spark, d).groupBy("hash").agg(F.any_value("bytes").alias("bytes"))
    return blobs.export(chosen, shared_path(spark, "export"))


@query("artifact_hash", "SELECT page_id, sha256(html) AS hash, octet_length(encode(html))::BIGINT AS len FROM pages WHERE html IS NOT NULL")
def artifact_hash(spark: SparkSession, d: str) -> DataFrame:
    """Whole artifacts hashed: pages of the web as files."""
    raw = F.encode("html", "utf-8")
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", tree.content_hash(raw).alias("hash"), F.octet_length(raw).cast("long").alias("len"))


@query("commit_assemble", CTE + f""", kids AS (SELECT n.hash, count(c.hash) AS k FROM nodes n LEFT JOIN nodes c ON c.image_id = n.image_id AND c.level = n.level - 1 AND c.node_idx // {FANOUT} = n.node_idx WHERE n.level > 0 GROUP BY n.image_id, n.level, n.node_idx, n.hash),
 a AS (SELECT 'snapshot:' || image_id AS t FROM shape UNION SELECT 'kernel')
 SELECT hash, 'page' AS kind, any_value(n)::BIGINT AS n_bytes FROM l0 WHERE hash IN (SELECT hash FROM missing) GROUP BY hash
 UNION ALL SELECT hash, 'node', any_value(length(k::VARCHAR) + 1 + 64 * k)::BIGINT FROM kids WHERE hash IN (SELECT hash FROM missing) GROUP BY hash
 UNION ALL SELECT sha256(t), 'artifact', length(t)::BIGINT FROM a""")
def commit_assemble(spark: SparkSession, d: str) -> DataFrame:
    """Blobs that a commit of all images to the holder uploads: pages, nodes and artifacts, each checked against its name."""
    n, text = nodes(spark, d), F.encode("t", "utf-8")
    made = shape(spark, d).select(F.explode(F.array(F.concat(F.lit("snapshot:"), "image_id"), F.lit("kernel"))).alias("t")).distinct()
    artifacts = made.select(tree.content_hash(text).alias("hash"), text.alias("bytes"))
    up = diff.commit_blobs(diff.tree_diff(n, holder(n), FANOUT), pages(spark, d), n, artifacts, holder(n), FANOUT)
    return up.select("hash", "kind", F.octet_length("bytes").cast("long").alias("n_bytes"))


def _captured(spark: SparkSession, d: str):
    """Dirty pages of the next versions as a stream of three batches, each a version of its own; the second call finds nothing new."""
    path, s = shared_path(spark, "capture"), shape(spark, d)
    e = written(edits(pages(spark, d)).select("image_id", "seq", "page_no", "bytes"), "edits")
    for k in range(3):
        e.where(f"(image_id + page_no) % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    n = nodes(spark, d)
    for _ in range(2):
        table = versioned(spark, n, s, f"{path}/in", path, P, FANOUT, buckets=8)
    return table, s, f"{path}/store"


@query("capture_stream", CTE + """, e AS (SELECT image_id, count(DISTINCT (image_id + page_no) % 3) AS versions, count(*) AS dirty_pages FROM edits GROUP BY 1)
 SELECT image_id, hash AS root, versions, dirty_pages, (versions - 1)::BIGINT AS depth FROM child JOIN shape USING (image_id) JOIN e USING (image_id) WHERE level = height""")
def capture_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each image's root after all batches, from the version records: how many versions it has, and how deep its chain of parents is."""
    table, _, store = _captured(spark, d)
    records = blobs.records(spark, store).select("id", "parent", F.col("mem_tree.root").alias("root"))
    depth = lineage.lineage(records)
    heads = table.heads().select("image_id", "id", "root").join(depth.select("id", F.col("root").alias("seed"), "depth"), "id").join(records.select("id", F.col("root").alias("recorded")), "id").where("root = recorded")
    sizes = depth.join(records, "id").groupBy(depth.root.alias("seed")).agg(F.count("*").alias("versions"))
    dirty = edits(pages(spark, d)).groupBy("image_id").agg(F.count("*").alias("dirty_pages"))
    return heads.join(sizes, "seed").join(dirty, "image_id").select("image_id", "root", "versions", "dirty_pages", "depth")


@query("capture_blobs", CTE + f""", t AS (SELECT DISTINCT e.image_id, u.level, e.page_no >> (2 * u.level) AS node_idx FROM edits e, range(0, 10) u(level)),
 kids AS (SELECT n.image_id, n.level, n.node_idx, n.hash, count(c.hash) AS k FROM child n LEFT JOIN child c ON c.image_id = n.image_id AND c.level = n.level - 1 AND c.node_idx // {FANOUT} = n.node_idx WHERE n.level > 0 GROUP BY ALL)
 SELECT hash, any_value(n)::BIGINT AS n_bytes FROM edits GROUP BY hash UNION ALL SELECT hash, any_value(length(k::VARCHAR) + 1 + 64 * k)::BIGINT FROM kids SEMI JOIN t USING (image_id, level, node_idx) GROUP BY hash""")
def capture_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Blobs that the batches uploaded and the last versions have: changed pages, and the nodes above them."""
    table, _, store = _captured(spark, d)
    return blobs.stored(spark, store).join(table.rows().select("hash").distinct(), "hash", "left_semi").select("hash", "n_bytes")


def _tree_blobs(spark: SparkSession, d: str, n: DataFrame, p: DataFrame) -> DataFrame:
    """(hash, bytes) of all pages and nodes of ``n``, each once."""
    none = spark.createDataFrame([], "hash string, bytes binary")
    return diff.commit_blobs(n, p, n, none, none.select("hash"), FANOUT).select("hash", "bytes")


@query("orphan_blobs", CTE + "SELECT DISTINCT hash FROM nodes WHERE hash NOT IN (SELECT hash FROM child)")
def orphan_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Pages and nodes that no record reaches, when only the next versions have records: found by walking stored nodes from the records' roots."""
    p, s = pages(spark, d), written(shape(spark, d), "shape")
    n, path = nodes(spark, d), shared_path(spark, "store")
    e = written(edits(p), "edits")
    fresh, siblings = tree.update_parts(n, e, s, P, FANOUT)
    fresh = written(fresh, "fresh")
    new = tree.root_rows(fresh, s).withColumnRenamed("root", "new")
    root = tree.root_rows(n, s).join(new, "image_id", "left").select("image_id", F.coalesce("new", "root").alias("root")).join(s, "image_id")
    record = root.select(F.concat(F.lit("img_"), "image_id").alias("id"), F.lit(None).cast("string").alias("parent"), F.struct("root", "len").alias("mem_tree"), F.col("image_id").alias("created_unix_ms"), *[F.lit(None).cast("string").alias(a) for a in blobs.ARTIFACTS])
    blobs.commit(_tree_blobs(spark, d, n, p), record.where("false"), path, fresh=True)
    none = spark.createDataFrame([], "hash string, bytes binary")
    up = diff.commit_blobs(fresh, e, siblings.unionByName(fresh.drop("page_base")), none, none.select("hash"), FANOUT)  # the next versions' other blobs are held
    blobs.commit(up.select("hash", "bytes"), record, path)
    return reach.orphans(blobs.stored(spark, path), blobs.records(spark, path), list(blobs.ARTIFACTS), P, FANOUT)


@query("c4_level_fetch", CTE + "SELECT level::BIGINT AS level, count(DISTINCT hash) AS asked, count(DISTINCT CASE WHEN hash NOT IN (SELECT hash FROM holder) THEN hash END) AS fetched FROM nodes WHERE level > 0 AND image_id % 2 = 1 GROUP BY level")
def level_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Inner nodes of odd images fetched by the holder level by level, each checked; how many each level asked for, and how many came."""
    n = nodes(spark, d)
    central = written(_tree_blobs(spark, d, n, pages(spark, d)), "central")
    roots = tree.root_rows(n, shape(spark, d)).where("image_id % 2 = 1").join(shape(spark, d).select("image_id", "height"), "image_id").select(F.col("root").alias("hash"), F.col("height").alias("level"))
    local = central.join(holder(n), "hash", "left_semi")
    return reach.level_fetch(roots, local, central)[1].select(F.col("level").cast("long").alias("level"), "asked", "fetched")


_P = ", patch AS (SELECT c.image_id, c.level, c.node_idx, c.hash FROM child c SEMI JOIN (SELECT DISTINCT e.image_id, u.level, e.page_no >> (2 * u.level) AS node_idx FROM edits e, range(0, 10) u(level)) t USING (image_id, level, node_idx))"


def _patch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, d)
    return n, tree.rebuilt_nodes(n, written(edits(pages(spark, d)).select("image_id", "page_no", "hash"), "dirty"), shape(spark, d), FANOUT)


@query("patch_exact", CTE + _P + "SELECT DISTINCT hash FROM patch WHERE hash NOT IN (SELECT hash FROM holder)")
def patch_exact(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds: exactly the blobs of the changes that the holder lacks."""
    n, fresh = _patch(spark, d)
    return diff.blob_difference(fresh, holder(n))


@query("patch_ancestor", CTE + _P + "SELECT image_id, count(DISTINCT hash) AS sent, count(DISTINCT CASE WHEN hash IN (SELECT hash FROM holder) THEN hash END) AS redundant FROM patch GROUP BY image_id")
def patch_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """One round against the parent only, and what the holder had already."""
    n, fresh = _patch(spark, d)
    had = fresh.join(holder(n).withColumn("had", F.col("hash")), "hash", "left")
    return had.groupBy("image_id").agg(F.countDistinct("hash").alias("sent"), F.countDistinct("had").alias("redundant"))


_BLOOM = """, owned AS (SELECT DISTINCT hash FROM holder), size AS (SELECT bits, greatest(1, round(bits / n * ln(2)))::BIGINT AS k FROM (SELECT greatest(8, ceil(-n * ln(0.05) / (ln(2) * ln(2))))::BIGINT AS bits, n FROM (SELECT count(*) AS n FROM owned))),
 spots AS (SELECT hash, (('0x' || substr(hash, 1, 14))::BIGINT + i * ('0x' || substr(hash, 15, 14))::BIGINT) % bits AS spot FROM (SELECT hash, bits, unnest(range(k)) AS i FROM (SELECT hash FROM owned UNION SELECT hash FROM patch) CROSS JOIN size)),
 filled AS (SELECT DISTINCT spot FROM spots SEMI JOIN owned USING (hash)), said AS (SELECT hash, bool_and(f.spot IS NOT NULL) AS present FROM spots s LEFT JOIN filled f ON f.spot = s.spot WHERE hash IN (SELECT hash FROM patch) GROUP BY hash) """


@query("patch_bloom", CTE + _P + _BLOOM + "SELECT hash, CASE WHEN present THEN 'repair' ELSE 'sent' END AS round FROM said WHERE NOT present OR hash NOT IN (SELECT hash FROM owned)")
def patch_bloom(spark: SparkSession, d: str) -> DataFrame:
    """One round against a Bloom filter of the holder that errs once in twenty, and a repair of what it withheld wrongly."""
    n, fresh = _patch(spark, d)
    return bloom.patch(fresh, holder(n), 0.05)[0]


_AFFINITY = "WITH w AS (SELECT DISTINCT o_custkey AS version, l_partkey AS hash FROM orders JOIN lineitem ON l_orderkey = o_orderkey), h AS (SELECT DISTINCT l_suppkey AS holder, l_partkey AS hash FROM lineitem), n AS (SELECT version, holder, count(*) AS overlap FROM w JOIN h USING (hash) GROUP BY 1, 2) SELECT version, holder, overlap, row_number() OVER (PARTITION BY version ORDER BY overlap DESC, holder) AS place FROM n"


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as machines that hold parts, customers as versions that need them."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    wanted = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("version"), F.col("l_partkey").alias("hash")).distinct()
    return wanted, li.select(F.col("l_suppkey").alias("holder"), F.col("l_partkey").alias("hash")).distinct()


@query("affinity_rank", _AFFINITY)
def affinity_rank(spark: SparkSession, d: str) -> DataFrame:
    """All machines that hold some of each version, those that hold most of it first, from exact counts."""
    return lineage.affinity(*_parts(spark, d))


@query("affinity_sketch", _AFFINITY + " QUALIFY place <= 5")
def affinity_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The five first of each version by sketches as large as the largest set, which miss nothing; exact counts of the five best alone."""
    return lineage.affinity_sketched(*_parts(spark, d), top=5, k=4096, candidates=5)
