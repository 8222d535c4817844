"""What must fail, fails before anything is lost or invented."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folio.operators import diff, lineage, tree
from folio.plans import materialize
from folio.sources import blobs

P, FAN = 16, 4


@pytest.fixture(scope="module")
def image(spark):
    df = spark.createDataFrame([(0, bytes(range(72))), (1, b"")], "image_id long, bytes binary")
    pages, shape = tree.paginate(df, P), tree.sizes(df, P, FAN)
    return pages, shape, tree.index_blobs(tree.leaf_rows(pages), shape, FAN).cache()


@pytest.mark.parametrize(("row", "why"), [((1, 0, 0, b"x"), "empty image"), ((0, 0, 99, b"y" * P), "out of range"), ((0, 0, -1, b"y" * P), "out of range"), ((0, 0, 1, b"short"), "wrong length of page"), ((0, 0, 4, b"y" * P), "wrong length of last"), ((0, 0, 1, None), "no bytes"), ((7, 0, 0, b"y" * P), "unknown image"), ((None, 0, 0, b"y" * P), "no image"), ((0, None, 1, b"y" * P), "no seq"), ((0, 0, None, b"y" * P), "no page")])
def test_bad_writes_are_refused(spark, image, row, why):
    _, shape, nodes = image
    good = (0, 5, 2, b"g" * P)
    d = spark.createDataFrame([good, row], "image_id long, seq long, page_no long, bytes binary")
    with pytest.raises(tree.Refused, match=why):
        tree.update(nodes, d, shape, P, FAN)
    if row[2] in (99, -1, None) or None in row[:2]:
        with pytest.raises(tree.Refused, match=why):
            tree.update_hashes(nodes, d.withColumn("hash", F.sha2("bytes", 256)), shape, FAN)


def test_last_write_of_rows_without_order(spark):
    rows = [(0, None, 1, "a"), (0, None, 1, "b"), (0, 3, 2, "c"), (0, None, 2, "d"), (0, 3, 2, "c")]
    got = {(r.page_no, r.seq): r.hash for r in tree.last_write_wins(spark.createDataFrame(rows, "image_id long, seq long, page_no long, hash string")).collect()}
    assert got[2, 3] == "c" and got[1, None] in "ab" and len(got) == 2


def test_lineage_of_a_circle_is_refused(spark):
    v = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 9), (9, 7)], "id long, parent long")
    for f in (lineage.lineage, lineage.ancestors):
        with pytest.raises(ValueError, match="circle"):
            f(v).collect()


def test_no_writes_change_nothing(spark, image):
    _, shape, nodes = image
    none = spark.createDataFrame([], "image_id long, seq long, page_no long, bytes binary")
    same = tree.update(nodes, none, shape, P, FAN)
    assert same.exceptAll(nodes.select(same.columns)).count() == 0 == nodes.select(same.columns).exceptAll(same).count()


def test_gaps_and_bad_blobs_are_never_passed_over(spark, image):
    pages, shape, nodes = image
    index = materialize.location_index(nodes.where("level = 0 AND node_idx = 1"), nodes.select("image_id", F.col("image_id").alias("image_seq")).distinct())
    steps = materialize.plan(nodes, shape, index, FAN, tree.tallest(shape)).cache()
    assert sorted(r.op for r in steps.collect()) == ["clone", *["gap"] * 4]
    whole = pages.select("hash", "bytes")
    count = lambda b: tuple(materialize.page_counts(materialize.page_status(steps, pages, b)).first())
    assert count(whole) == (0, 1, 4, 0)
    assert bytes(tree.assemble(materialize.materialize(steps, pages, whole)).first().bytes) == bytes(range(72))
    for blobs_, sources in ((None, pages), (whole.where("hash < '8'"), pages), (whole.withColumn("bytes", F.lit(b"x")), pages), (whole, pages.where("page_no <> 1"))):
        with pytest.raises(PySparkException, match="materialize"):
            materialize.materialize(steps, sources, blobs_).collect()
    assert count(whole.withColumn("bytes", F.lit(b"x"))) == (0, 1, 0, 4) == count(None)


def test_commit_needs_the_bytes_of_what_it_uploads(spark, image):
    pages, shape, nodes = image
    store = nodes.where("false").select("hash")
    artifacts = spark.createDataFrame([(hashlib.sha256(b"k").hexdigest(), b"k")] * 2, "hash string, bytes binary")
    missing = diff.tree_diff(nodes, store, FAN, tree.tallest(shape))
    up = diff.commit_blobs(missing, pages, nodes, artifacts, store, FAN).collect()
    assert sorted(r.kind for r in up) == ["artifact", *["node"] * 4, *["page"] * 5]
    assert all(hashlib.sha256(r.bytes).hexdigest() == r.hash for r in up)
    with pytest.raises(PySparkException, match="no good bytes of page"):
        diff.commit_blobs(missing, pages.where("page_no <> 2"), nodes, artifacts, store, FAN).collect()


def test_a_held_root_hides_all_levels(spark):
    top = 11
    nodes = spark.createDataFrame([(0, k, 0, 0, f"h{k}") for k in range(top + 1)] + [(0, 0, 2**top - 1, 2**top - 1, "last")], "image_id long, level int, node_idx long, page_base long, hash string").coalesce(1)
    assert diff.tree_diff(nodes, nodes.where(F.col("level") == top).select("hash"), 2, top).count() == 0


def test_commit_checks_every_copy_of_a_name(spark, tmp_path):
    name = hashlib.sha256(b"one").hexdigest()
    record = spark.createDataFrame([], blobs.RECORD)
    path = str(tmp_path / "store")
    with pytest.raises(ValueError, match="refused"):
        blobs.commit(spark.createDataFrame([(name, b"one"), (name, b"other")], "hash string, bytes binary"), record, path)
    assert blobs.stored(spark, path).count() == 0 and not os.listdir(f"{path}/parts")
    assert blobs.commit(spark.createDataFrame([(name, b"one")] * 3, "hash string, bytes binary"), record, path) == 1
    assert blobs.commit(spark.createDataFrame([(name, b"held already, so not looked at")], "hash string, bytes binary"), record, path) == 0


def test_records_that_are_known_do_not_move(spark, tmp_path):
    """A commit of records that are all held looks at their ids alone, and stages none."""
    record = spark.createDataFrame([(f"r{k}", None, ("r", 1), k, *"abcde") for k in range(9)], blobs.RECORD)
    known = record.select("id")
    assert "Join" not in blobs._new_records(record, known)._jdf.queryExecution().optimizedPlan().toString()
    assert blobs._new_records(record, known).count() == 0
    fresh = blobs._new_records(record, known.where("id < 'r4'"))
    assert sorted(r.id for r in fresh.collect()) == [f"r{k}" for k in range(4, 9)]
    assert blobs._new_records(record.unionByName(record), known.where("false")).count() == 9


def test_files_are_scanned_and_hashed(spark, tmp_path):
    for name, data in (("a", b""), ("b", b"xyz" * 1000)):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.len, r.hash) for r in blobs.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"a": (0, hashlib.sha256(b"").hexdigest()), "b": (3000, hashlib.sha256(b"xyz" * 1000).hexdigest())}


def test_nearest_ancestor_of_chains_and_stars(spark):
    rows = [(k, k - 1 if k % 40 else None) for k in range(120)] + [(k, 500 if k > 500 else None) for k in range(500, 560)]
    v = spark.createDataFrame(rows, "id long, parent long")
    held = {k for k in range(120) if k % 7 == 3} | {500}
    parent = dict(rows)

    def near(k):
        d = 0
        while k is not None and k not in held:
            k, d = parent[k], d + 1
        return None if k is None else (k, d)

    got = {r.id: (r.ancestor, r.depth) for r in lineage.nearest_ancestor(v, spark.createDataFrame([(k,) for k in held], "id long")).collect()}
    assert got == {k: n for k in parent if (n := near(k))}
    assert lineage.lineage(v.where("false")).count() == 0
