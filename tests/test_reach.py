"""Walks from records through stored nodes, and commits that meet."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import diff, reach, tree
from folio.sources import blobs
from folio.sources.commits import CommitLog, Entry
from folio.sources.versions import Versions
from folio.streaming.capture import DIRTY, capture_batch, versioned

P, FAN = 8, 2


@pytest.fixture(scope="module")
def trees(spark):
    data = {0: bytes(range(70)), 1: bytes(range(35)) + b"x" * 20, 2: b"", 3: bytes(range(70))}
    df = spark.createDataFrame(list(data.items()), "image_id long, bytes binary")
    pages, shape = tree.paginate(df, P).cache(), tree.sizes(df, P, FAN).cache()
    nodes = tree.index_blobs(tree.leaf_rows(pages), shape, FAN).cache()
    none = spark.createDataFrame([], "hash string, bytes binary")
    stored = diff.commit_blobs(nodes, pages, nodes, none, none.select("hash"), FAN).select("hash", "bytes").cache()
    return data, pages, shape, nodes, stored


def record_of(nodes, shape, where="true"):
    root = tree.root_rows(nodes, shape).join(shape, "image_id").where(where)
    return root.select(F.col("image_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"), F.struct("root", "len").alias("mem_tree"), F.col("image_id").alias("created_unix_ms"), *[F.lit(None).cast("string").alias(a) for a in blobs.ARTIFACTS])


def test_reach_is_what_the_trees_hold(spark, trees):
    _, _, shape, nodes, stored = trees
    for where in ("image_id = 0", "image_id IN (1, 2)", "true", "false"):
        want = {(r.hash, r.level) for r in nodes.join(shape.where(where).select("image_id"), "image_id").collect()}
        got = reach.reached(reach.tree_roots(record_of(nodes, shape, where), P, FAN), stored).collect()
        assert {(r.hash, r.level) for r in got} == want and len(got) == len(want) and all(r.status == "ok" for r in got)
    left = reach.orphans(stored, record_of(nodes, shape, "image_id = 1"), ["kernel"], P, FAN).collect()
    held = {r.hash for r in nodes.where("image_id = 1").collect()}
    assert {r.hash for r in left} == {r.hash for r in stored.collect()} - held


def test_broken_nodes_end_a_walk(spark, trees):
    _, _, shape, nodes, stored = trees
    records = record_of(nodes, shape, "image_id = 0")
    inner = nodes.where("image_id = 0 AND level = 2").orderBy("node_idx").first().hash
    lost = stored.where(F.col("hash") != inner)
    spoilt = stored.withColumn("bytes", F.when(F.col("hash") == inner, F.encode(F.lit("1:" + "0" * 64), "utf-8")).otherwise(F.col("bytes")))
    for bad, why in ((lost, "missing"), (spoilt, "corrupt")):
        found = {r.hash: r.status for r in reach.reached(reach.tree_roots(records, P, FAN), bad).collect()}
        assert found[inner] == why and sum(s != "ok" for s in found.values()) == 1
        with pytest.raises(reach.Broken, match=why):
            reach.orphans(bad, records, [], P, FAN)
        with pytest.raises(reach.Broken, match=why):
            reach.level_fetch(reach.tree_roots(records, P, FAN), stored.where("false"), bad)


def test_level_fetch_goes_on_below_held_nodes(spark, trees):
    _, _, shape, nodes, stored = trees
    roots = reach.tree_roots(record_of(nodes, shape), P, FAN)
    inner = {(r.hash, r.level) for r in nodes.where("level > 0").collect()}
    top = nodes.where("image_id = 0 AND level = 4").first().hash
    for local in (set(), {top}, {h for h, _ in inner}):
        mine = stored.where(F.col("hash").isin(*local)) if local else stored.where("false")
        got, counts = reach.level_fetch(roots, mine, stored)
        assert {(r.hash, r.level) for r in got.collect()} == {x for x in inner if x[0] not in local}
        assert all(hashlib.sha256(r.bytes).hexdigest() == r.hash for r in got.collect())
        assert sum(r.asked for r in counts.collect()) == len(inner)


def test_of_two_writers_at_once_each_blob_and_record_stays_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    blob = lambda *xs: spark.createDataFrame([(hashlib.sha256(x).hexdigest(), x) for x in xs], "hash string, bytes binary")
    record = lambda *ids: spark.createDataFrame([(i, None, ("r", 1), 0, None, None, None, None, None) for i in ids], blobs.RECORD)
    plain, done = CommitLog.publish, []

    def meanwhile(log, entry):
        if not done:  # another writer commits between staging and publishing
            done.append(1)
            assert blobs.commit(blob(b"a", b"b"), record("x", "y"), path, "other") == 2
        return plain(log, entry)

    monkeypatch.setattr(CommitLog, "publish", meanwhile)
    assert blobs.commit(blob(b"b", b"c"), record("y", "z"), path, "mine") == 1
    monkeypatch.undo()
    assert sorted(bytes(r.bytes) for r in blobs.stored(spark, path).collect()) == [b"a", b"b", b"c"]
    assert sorted(r.id for r in blobs.records(spark, path).collect()) == ["x", "y", "z"]
    assert blobs.commit(blob(b"d"), record("w"), path, "mine") == 0  # the batch is there
    assert blobs.compact(spark, path) == 2 and blobs.compact(spark, path) == 0
    assert blobs.stored(spark, path).count() == 3 == blobs.records(spark, path).count()
    assert blobs.commit(blob(b"a", b"e"), record("x", "x", "v"), path) == 1
    assert sorted(r.id for r in blobs.records(spark, path).collect()) == ["v", "x", "y", "z"]
    assert not CommitLog(spark, path).publish(Entry(0))
    with pytest.raises(Exception, match="two records of q"):
        blobs.commit(blob(b"f"), record("q").unionByName(record("q").withColumn("kernel", F.lit("k"))), path)
    assert blobs.stored(spark, path).count() == 4


def test_captured_versions_survive_restarts_and_repeats(spark, tmp_path, trees):
    data, _, shape, nodes, _ = trees
    path, now = str(tmp_path), {k: bytearray(v) for k, v in data.items()}

    def write(rows):
        for image, _, page, new in rows:
            now[image][page * P : page * P + len(new)] = new
        spark.createDataFrame(rows, DIRTY).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def check(table, n_records):
        built = spark.createDataFrame([(k, bytes(v)) for k, v in now.items()], "image_id long, bytes binary")
        want = tree.index_blobs(tree.leaf_rows(tree.paginate(built, P)), shape, FAN)
        got = table.rows()
        assert got.exceptAll(want.select(got.columns)).count() == 0 == want.select(got.columns).exceptAll(got).count()
        records = blobs.records(spark, f"{path}/store").collect()
        assert len(records) == n_records == len({r.id for r in records})
        ids = {r.id for r in records}
        assert all(r.parent is None or r.parent in ids for r in records)
        named = [r.hash for r in blobs.stored(spark, f"{path}/store").collect()]
        assert len(named) == len(set(named))

    call = lambda: versioned(spark, nodes, shape, f"{path}/in", path, P, FAN, buckets=4)
    write([(0, 0, 1, b"a" * P), (0, 1, 1, b"b" * P), (1, 0, 6, b"c" * 7)])
    check(call(), 2)
    check(call(), 2)  # nothing new
    write([(0, 0, 0, b"d" * P)])
    table = call()
    check(table, 3)
    last = spark.createDataFrame([(0, 0, 0, b"d" * P)], DIRTY)
    assert not capture_batch(table, CommitLog(spark, f"{path}/store"), shape, last, "capture-1", 1, P, FAN)  # a repeated batch
    with pytest.raises(tree.Refused):
        capture_batch(table, CommitLog(spark, f"{path}/store"), shape, spark.createDataFrame([(2, 0, 0, b"x")], DIRTY), "bad", 9, P, FAN)
    check(table, 3)
    assert table.compact()
    check(Versions(spark, f"{path}/versions", 4), 3)
    write([(3, 0, 8, b"e" * 6)])
    check(call(), 4)


def test_walks_read_all_blobs_a_few_times_only(spark, monkeypatch):
    """Rounds look at the blobs that may be nodes; all blobs, pages among them, are read once, whatever the height."""
    rng, page, fan = random.Random(2), 8, 2
    images = spark.createDataFrame([(0, rng.randbytes(page * 40))], "image_id long, bytes binary")
    shape, p = tree.sizes(images, page, fan), tree.paginate(images, page)
    n = tree.index_blobs(tree.leaf_rows(p), shape, fan)
    none = spark.createDataFrame([], "hash string, bytes binary")
    store = diff.commit_blobs(n, p, n, none, none.select("hash"), fan).select("hash", "bytes").cache()
    assert reach._inner(store).count() == n.where("level > 0").select("hash").distinct().count()
    asked = []
    monkeypatch.setattr(reach, "_inner", lambda blobs, plain=reach._inner: asked.append(1) or plain(blobs))
    root = tree.root_rows(n, shape).join(shape, "image_id").select(F.col("root").alias("hash"), F.col("height").alias("level"))
    got = reach.reached(root, store).collect()
    assert {r.hash for r in got} == {r.hash for r in n.collect()} and {r.status for r in got} == {"ok"} and len(asked) == 1
    spoilt = store.where("false").unionByName(n.where("level = 2").limit(1).select("hash", F.encode(F.lit("no node"), "utf-8").alias("bytes")))
    with pytest.raises(reach.Broken, match="corrupt"):
        reach.level_fetch(root, spoilt, store)


def test_versions_of_a_large_batch_have_ids_of_their_own(spark, tmp_path):
    """The hashes that these two versions' ids are cut from begin with the same ten digits."""
    twins = [280147, 312054]
    images = spark.createDataFrame([(i, b"." * P) for i in twins], "image_id long, bytes binary")
    shape, table, store = tree.sizes(images, P, FAN), Versions(spark, f"{tmp_path}/versions", 4), CommitLog(spark, f"{tmp_path}/store")
    table.start(tree.index_blobs(tree.leaf_rows(tree.paginate(images, P)), shape, FAN))
    dirty = spark.createDataFrame([(i, 0, 0, b"%08d" % i) for i in twins], DIRTY)
    assert capture_batch(table, store, shape, dirty, "capture-0", 0, P, FAN)
    heads = table.heads().collect()
    assert len({r.root for r in heads}) == 2 == len({r.id for r in heads})
    assert sorted(r.id for r in blobs.records(spark, store.path, store).collect()) == sorted(r.id for r in heads)


def test_rounds_of_a_walk_move_their_frontier_alone(spark, trees):
    """Nodes are dealt out once; no round shuffles them to its frontier."""
    stored = trees[-1]
    frontier = reach.written(stored.select(tree.packed("hash").alias("name")), "frontier")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    inner = reach._inner(stored)
    try:
        for _ in range(2):
            found = frontier.join(reach._held(inner), "name", "left")
            assert sum(bool(r.there) for r in found.collect()) == inner.count() > 0
            plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning(") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        inner.unpersist()


def test_fresh_blobs_stay_where_they_are_unless_they_are_not(spark, tmp_path):
    """Blobs said to be new and each once are dropped all the same where they aren't, and refused where they don't hash to their names."""
    path, none = str(tmp_path / "store"), spark.createDataFrame([], blobs.RECORD)
    blob = lambda *xs: spark.createDataFrame([(hashlib.sha256(x).hexdigest(), x) for x in xs], "hash string, bytes binary")
    for given, added in (((b"a", b"b"), 2), ((b"c", b"c"), 1), ((b"a", b"d"), 1), ((b"a", b"c"), 0), ((), 0)):
        assert blobs.commit(blob(*given), none, path, fresh=True) == added
    assert sorted(bytes(r.bytes) for r in blobs.stored(spark, path).collect()) == [b"a", b"b", b"c", b"d"]
    for name in ("0" * 64, "no hash", None):
        with pytest.raises(ValueError, match="doesn't hash"):
            blobs.commit(spark.createDataFrame([(name, b"e")], "hash string, bytes binary"), none, path, fresh=True)
    assert blobs.stored(spark, path).count() == 4


def test_packed_names_come_back(spark):
    names = ["", "no hash", "0" * 64, "AB" * 32, "ab" * 32, "x" * 32, "0" * 31, "é" * 16, None]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", tree.packed("name").alias("p"))
    got = df.select("name", tree.unpacked("p").alias("back"), "p").collect()
    assert [r.name for r in got] == [r.back for r in got] and len({bytes(r.p) for r in got if r.p is not None}) == len(names) - 1
    assert [len(r.p) for r in got if r.name in ("0" * 64, "ab" * 32)] == [32, 32]
