"""How the given tables become images, versions and holders; once as DataFrames and once as SQL.

An image is the text of a document. Its next version has some pages replaced, in place and at the
same length: page p of image i where (7 i + 13 p) mod 11 = 0 becomes the hex digits of its old hash.
A holder has the nodes of even images, but for one position in five, so it may have a node and lack
what lies below. Small pages give trees of several levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import tree
from folio.sources.shared import written

P, FANOUT, TOP = 256, 4, 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("bytes"))


def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.sizes(images(spark, sf_dir), P, FANOUT)


def top(spark: SparkSession, sf_dir: str) -> int:
    """The highest level of all trees."""
    return tree.tallest(shape(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paginate(images(spark, sf_dir), P)


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of all pages, written once: bytes are hashed in one pass."""
    return written(tree.leaf_rows(pages(spark, sf_dir)), "leaves")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(tree.index_blobs(leaves(spark, sf_dir), shape(spark, sf_dir), FANOUT), "nodes")


def edits(pages: DataFrame) -> DataFrame:
    """(image_id, seq, page_no, bytes, hash) of the next version."""
    hit = pages.where("(image_id * 7 + page_no * 13) % 11 = 0")
    new = F.encode(F.expr("substring(repeat(hash, 4), 1, octet_length(bytes))"), "utf-8")
    return hit.select("image_id", F.col("page_no").alias("seq"), "page_no", new.alias("bytes")).withColumn("hash", tree.content_hash(F.col("bytes")))


def holder(nodes: DataFrame) -> DataFrame:
    return nodes.where("image_id % 2 = 0 AND (image_id + level + node_idx) % 5 <> 0").select("hash").distinct()


#: The same in SQL; l1 .. l9 are the levels, c0 .. c9 those of the next version.
_H = "CASE " + " ".join(f"WHEN page_count <= {FANOUT**h} THEN {h}" for h in range(1, TOP)) + f" ELSE {TOP} END"


def _level(k: int, below: str) -> str:
    return f"""(SELECT image_id, {k} AS level, node_idx // {FANOUT} AS node_idx, (node_idx // {FANOUT}) * {FANOUT**k} AS page_base,
      sha256(count(*) || ':' || string_agg(hash, '' ORDER BY node_idx)) AS hash
      FROM {below} JOIN shape USING (image_id) WHERE height >= {k} GROUP BY image_id, node_idx // {FANOUT})"""


CTE = f"""WITH images AS (SELECT doc_id AS image_id, encode(coalesce(text, '')) AS bytes FROM documents),
shape0 AS (SELECT image_id, octet_length(bytes)::BIGINT AS len, ((octet_length(bytes) + {P - 1}) // {P})::BIGINT AS page_count FROM images),
shape AS (SELECT *, {_H} AS height FROM shape0),
pages AS (SELECT image_id, page_no, bytes[page_no * {P} + 1 : (page_no + 1) * {P}] AS bytes FROM (SELECT image_id, bytes, unnest(range(page_count)) AS page_no FROM images JOIN shape USING (image_id))),
l0 AS (SELECT image_id, 0 AS level, page_no AS node_idx, page_no AS page_base, sha256(bytes) AS hash, octet_length(bytes) AS n FROM pages),
{", ".join(f"l{k} AS {_level(k, f'l{k - 1}')}" for k in range(1, TOP + 1))},
empties AS (SELECT image_id, 1 AS level, 0::BIGINT AS node_idx, 0::BIGINT AS page_base, sha256('0:') AS hash FROM shape WHERE page_count = 0),
nodes AS (SELECT image_id, level, node_idx, page_base, hash FROM l0 {" ".join(f"UNION ALL SELECT * FROM l{k}" for k in range(1, TOP + 1))} UNION ALL SELECT * FROM empties),
edits AS (SELECT image_id, node_idx AS page_no, n, sha256(encode(substr(repeat(hash, 4), 1, n))) AS hash FROM l0 WHERE (image_id * 7 + node_idx * 13) % 11 = 0),
c0 AS (SELECT l0.image_id, 0 AS level, node_idx, page_base, coalesce(e.hash, l0.hash) AS hash FROM l0 LEFT JOIN edits e ON e.image_id = l0.image_id AND e.page_no = l0.node_idx),
{", ".join(f"c{k} AS {_level(k, f'c{k - 1}')}" for k in range(1, TOP + 1))},
child AS (SELECT * FROM c0 {" ".join(f"UNION ALL SELECT * FROM c{k}" for k in range(1, TOP + 1))} UNION ALL SELECT * FROM empties),
holder AS (SELECT DISTINCT hash FROM nodes WHERE image_id % 2 = 0 AND (image_id + level + node_idx) % 5 <> 0),
ups AS (SELECT image_id, level, node_idx, up AS up_level, node_idx >> (2 * (up - level)) AS up_idx FROM (SELECT image_id, level, node_idx, unnest(range(level, {TOP} + 1)) AS up FROM nodes)),
held AS (SELECT image_id, level, node_idx FROM nodes WHERE hash IN (SELECT hash FROM holder)),
covered AS (SELECT DISTINCT u.image_id, u.level, u.node_idx FROM ups u JOIN held h ON h.image_id = u.image_id AND h.level = u.up_level AND h.node_idx = u.up_idx),
missing AS (SELECT n.* FROM nodes n ANTI JOIN covered USING (image_id, level, node_idx)),
loc AS (SELECT hash, level, source, src_page_base FROM (SELECT hash, level, image_id AS source, page_base AS src_page_base, row_number() OVER (PARTITION BY hash, level ORDER BY image_id DESC, page_base) AS r FROM nodes WHERE image_id % 2 = 0) WHERE r = 1),
odd AS (SELECT n.*, page_count, loc.source, loc.src_page_base FROM nodes n JOIN shape USING (image_id) LEFT JOIN loc USING (hash, level) WHERE n.image_id % 2 = 1 AND page_count > 0),
above AS (SELECT u.image_id, u.level, u.node_idx, bool_or(u.up_level > u.level) AS proper FROM ups u JOIN odd h ON h.source IS NOT NULL AND h.image_id = u.image_id AND h.level = u.up_level AND h.node_idx = u.up_idx GROUP BY u.image_id, u.level, u.node_idx),
steps AS (SELECT o.image_id, 'clone' AS op, page_base AS dest_page_base, least({FANOUT} ** level, page_count - page_base)::BIGINT AS pages, hash, source, src_page_base FROM odd o JOIN above a USING (image_id, level, node_idx) WHERE source IS NOT NULL AND NOT proper
  UNION ALL SELECT o.image_id, 'gap', page_base, 1, hash, NULL, NULL FROM odd o ANTI JOIN above a USING (image_id, level, node_idx) WHERE level = 0)
"""
