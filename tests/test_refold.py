"""Subtrees of a task are folded one after the other, wherever batches of rows end."""

import hashlib
import random

from folio.operators import tree


def test_a_task_folds_many_subtrees(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(tree, "CHUNK", 16)  # two levels a step: some trees take several
    images = spark.createDataFrame([(i, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 8, 9, 70, 700])))) for i in range(40)], "image_id long, bytes binary")
    pages, shape = tree.paginate(images, 4).cache(), tree.sizes(images, 4, 4).cache()
    nodes = tree.index_blobs(tree.leaf_rows(pages), shape, 4).cache()
    edits = pages.where("(image_id + page_no) % 5 = 0").selectExpr("image_id", "page_no", "sha2(concat(bytes, encode('x', 'utf-8')), 256) AS hash").cache()
    changed = pages.select("image_id", "page_no", "hash").join(edits.withColumnRenamed("hash", "new"), ["image_id", "page_no"], "left").selectExpr("image_id", "page_no", "coalesce(new, hash) AS hash")
    want = sorted(map(tuple, tree.index_blobs(tree.leaf_rows(changed), shape, 4).collect()))
    for batch in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert sorted(map(tuple, tree.updated(nodes, edits, shape, 4).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = tree.rebuilt_nodes(nodes, edits, shape.where("height < 3"), 4)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan  # no call of Python a subtree


def test_siblings_and_fresh_rows_are_all_that_new_nodes_cover(spark):
    """What a captured batch uploads needs no second look at the versions before."""
    images = spark.createDataFrame([(i, bytes(range(n))) for i, n in enumerate((0, 3, 9, 70, 200))], "image_id long, bytes binary")
    pages, shape = tree.paginate(images, 4), tree.sizes(images, 4, 4)
    nodes = tree.index_blobs(tree.leaf_rows(pages), shape, 4).cache()
    dirty = pages.where("(image_id + page_no) % 5 = 0").selectExpr("image_id", "page_no AS seq", "page_no", "substring(encode('wxyz', 'utf-8'), 1, octet_length(bytes)) AS bytes")
    fresh, siblings = tree.update_parts(nodes, dirty, shape, 4, 4)
    fresh = fresh.drop("page_base").collect()
    below = {(r.image_id, r.level, r.node_idx): r.hash for r in siblings.collect() + fresh}
    assert len(below) == siblings.count() + len(fresh)
    for r in fresh:
        if r.level:
            kids = [h for (i, level, k), h in sorted(below.items()) if (i, level, k // 4) == (r.image_id, r.level - 1, r.node_idx)]
            assert r.hash == hashlib.sha256(f"{len(kids)}:{''.join(kids)}".encode()).hexdigest()
