"""Cases that the tables don't hold, and invariants that need no SQL."""

import base64
import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folio.functions import geometry
from folio.operators import diff, lineage, logs, sessions, tree
from folio.plans import materialize
from folio.sources import blobs

P, FAN = 16, 4


def node_hash(children):
    return hashlib.sha256(f"{len(children)}:{''.join(children)}".encode()).hexdigest()


def root_of(data):
    rows = [hashlib.sha256(data[k : k + P]).hexdigest() for k in range(0, len(data), P)]
    level = 0
    while level == 0 or len(rows) > 1:
        rows = [node_hash(rows[k : k + FAN]) for k in range(0, len(rows), FAN)] or [node_hash([])]
        level += 1
    return rows[0], level


def parts(df):
    return tree.paginate(df, P), tree.sizes(df, P, FAN)


def test_known_hashes(spark):
    r = spark.range(1).select(tree.content_hash(F.lit("").cast("binary")).alias("a"), tree.content_hash(F.lit("abc").cast("binary")).alias("b")).first()
    assert r.a == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and r.b == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_sizes_round_trip(spark):
    rng = random.Random(1)
    lengths = [0, 1, P - 1, P, P + 1, 3 * P, FAN * P, FAN * P + 1, FAN**2 * P, FAN**2 * P + 1, 100 * P + 5]
    images = [(k, bytearray(rng.randbytes(n))) for k, n in enumerate(lengths)] + [(99, None)]
    df = spark.createDataFrame(images, "image_id long, bytes binary")
    pages, shape = parts(df)
    got = {r.image_id: r for r in tree.roots(tree.leaf_rows(pages), shape, FAN).collect()}
    for i, data in images:
        assert (got[i].root, got[i].height) == root_of(bytes(data or b""))
    back = {r.image_id: bytes(r.bytes) for r in tree.assemble(pages).collect()}
    assert all(back.get(i, b"") == bytes(data or b"") for i, data in images)
    assert {r.image_id: r.page_count for r in shape.collect()} == {i: -(-len(d or b"") // P) for i, d in images}


def test_height_of_huge_images(spark):
    cases = [0, 1, 64, 65, 4096, 4097, 64**3, 64**3 + 1, 2**50]
    got = [r.h for r in spark.createDataFrame([(c,) for c in cases], "p long").select(geometry.height(F.col("p")).alias("h")).collect()]
    assert got == [next(h for h in range(1, 99) if 64**h >= c) for c in cases]


def test_update_equals_build_at_random(spark):
    rng = random.Random(7)
    images, after, dirty = [], {}, []
    for i in range(40):
        data = bytearray(rng.randbytes(rng.randrange(1, 90 * P)))
        images.append((i, bytes(data)))
        seq = 0
        for p in rng.sample(range(-(-len(data) // P)), rng.randrange(0, -(-len(data) // P) + 1) // 2):
            for _ in range(rng.choice([1, 1, 2])):
                new = rng.randbytes(len(data[p * P : (p + 1) * P]))
                data[p * P : (p + 1) * P] = new
                dirty.append((i, seq, p, hashlib.sha256(new).hexdigest(), len(new)))
                seq += 1
        after[i] = bytes(data)
    rng.shuffle(dirty)
    df = spark.createDataFrame(images, "image_id long, bytes binary")
    pages, shape = parts(df)
    d = spark.createDataFrame(dirty, "image_id long, seq long, page_no long, hash string, n_bytes long")
    assert tree.dirty_errors(d, shape, P).count() == 0
    nodes = tree.index_blobs(tree.leaf_rows(pages), shape, FAN).cache()
    new = tree.updated(nodes, tree.last_write_wins(d.drop("n_bytes")), shape, FAN).cache()
    assert {r.image_id: r.root for r in tree.root_rows(new, shape).collect()} == {i: root_of(x)[0] for i, x in after.items()}
    built = tree.index_blobs(tree.leaf_rows(tree.paginate(spark.createDataFrame(list(after.items()), "image_id long, bytes binary"), P)), shape, FAN)
    assert new.exceptAll(built.select(new.columns)).count() == 0 == built.select(new.columns).exceptAll(new).count()


def test_two_dirty_pages_make_five_new_blobs(spark):
    data = random.Random(2).randbytes(16 * P)
    pages, shape = parts(spark.createDataFrame([(0, data)], "image_id long, bytes binary"))
    nodes = tree.index_blobs(tree.leaf_rows(pages), shape, FAN)
    d = spark.createDataFrame([(0, 1, "a" * 64), (0, 9, "b" * 64)], "image_id long, page_no long, hash string")
    assert tree.rebuilt_nodes(nodes, d, shape, FAN).count() == 5


def test_bad_dirty_pages_are_refused(spark):
    _, shape = parts(spark.createDataFrame([(0, b"x" * 40), (1, b"")], "image_id long, bytes binary"))
    d = spark.createDataFrame([(0, 0, 3, P), (0, 1, 0, 5), (0, 2, 2, P), (0, 3, 2, 8), (1, 4, 0, P), (7, 5, 0, P), (0, 6, -1, P)], "image_id long, seq long, page_no long, n_bytes long")
    got = {r.seq: r.reason for r in tree.dirty_errors(d, shape, P).collect()}
    assert got == {0: "page out of range", 1: "wrong length of page", 2: "wrong length of last page", 4: "empty image", 5: "unknown image", 6: "page out of range"}


def test_extents_share_a_boundary_page_once(spark):
    e = spark.createDataFrame([(0, 0, 20, 100), (0, 20, 40, 100), (0, 90, 200, 100), (0, 5, 5, 100)], "image_id long, data_off long, hole_off long, file_size long")
    assert sorted((r.page_no, r.n_bytes) for r in tree.dirty_extents(e, P).collect()) == [(0, 16), (1, 16), (2, 16), (5, 16), (6, 4)]


def walk(nodes, held, image, level, idx):
    h = nodes[image, level, idx]
    if h in held:
        return []
    out = [(image, level, idx)]
    if level:
        for k in range(FAN):
            if (image, level - 1, idx * FAN + k) in nodes:
                out += walk(nodes, held, image, level - 1, idx * FAN + k)
    return out


def test_diff_equals_a_walk_with_an_open_holder(spark):
    rng = random.Random(4)
    block = rng.randbytes(8 * P)
    images = [(i, rng.choice([b"", block, rng.randbytes(rng.randrange(0, 30 * P)) + block])) for i in range(20)]
    pages, shape = parts(spark.createDataFrame(images, "image_id long, bytes binary"))
    rows = tree.index_blobs(tree.leaf_rows(pages), shape, FAN).cache()
    nodes = {(r.image_id, r.level, r.node_idx): r.hash for r in rows.collect()}
    held = set(rng.sample(sorted(set(nodes.values())), len(set(nodes.values())) // 3))
    top = {r.image_id: r.height for r in shape.collect()}
    want = sorted(x for i in top for x in walk(nodes, held, i, top[i], 0))
    highest = max(top.values())
    got = diff.tree_diff(rows, spark.createDataFrame([(h,) for h in held], "hash string"), FAN, highest)
    assert sorted((r.image_id, r.level, r.node_idx) for r in got.collect()) == want
    everything = diff.tree_diff(rows, rows.select("hash"), FAN, highest)
    assert everything.count() == 0
    nothing = diff.tree_diff(rows, rows.select("hash").limit(0), FAN, highest)
    assert nothing.count() == len(nodes)


def test_materialise_from_two_sources_at_another_offset(spark):
    rng = random.Random(5)
    a, b = rng.randbytes(16 * P), rng.randbytes(16 * P)
    target = b + a + rng.randbytes(3 * P + 5)
    pages, shape = parts(spark.createDataFrame([(0, a), (1, b), (2, target), (3, b"")], "image_id long, bytes binary"))
    nodes = tree.index_blobs(tree.leaf_rows(pages), shape, FAN).cache()
    src = nodes.where("image_id < 2")
    index = materialize.location_index(src, src.select("image_id").distinct().withColumn("image_seq", F.col("image_id")))
    steps = materialize.plan(nodes.where("image_id >= 2"), shape, index, FAN, tree.tallest(shape)).cache()
    assert sorted((r.op, r.dest_page_base, r.pages, r.source) for r in steps.collect()) == [("clone", 0, 16, 1), ("clone", 16, 16, 0), *[("gap", k, 1, None) for k in range(32, 36)]]
    blob = pages.where("image_id = 2").select("hash", "bytes")
    rebuilt = materialize.materialize(steps, pages.where("image_id < 2"), blob)
    assert bytes(tree.assemble(rebuilt).first().bytes) == target


def test_commit_is_verified_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "store")
    ok = spark.createDataFrame([(hashlib.sha256(x).hexdigest(), x) for x in (b"one", b"two", b"two")], "hash string, bytes binary")
    record = spark.createDataFrame([("frm_1", None, ("r", 3), 5, "k", "i", "s", "c", "n")], blobs.RECORD)
    bad = ok.unionByName(spark.createDataFrame([("0" * 64, b"three")], "hash string, bytes binary"))
    with pytest.raises(ValueError, match="refused"):
        blobs.commit(bad, record, path)
    assert blobs.records(spark, path).count() == 0 == blobs.stored(spark, path).count()
    assert blobs.commit(ok, record, path) == 2 and blobs.commit(ok, record, path) == 0
    assert blobs.records(spark, path).collect() == record.collect()
    asked = spark.createDataFrame([(0, hashlib.sha256(b"two").hexdigest()), (1, hashlib.sha256(b"one").hexdigest()), (2, hashlib.sha256(b"two").hexdigest())], "pos long, hash string")
    assert [bytes(r.bytes) for r in blobs.batch_get(asked, blobs.stored(spark, path)).orderBy("pos").collect()] == [b"two", b"one", b"two"]
    with pytest.raises(PySparkException):
        blobs.batch_get(asked.union(spark.createDataFrame([(3, "f" * 64)])), blobs.stored(spark, path)).collect()


def test_lineage_of_long_chains(spark):
    v = spark.createDataFrame([(k, k - 1 if k % 50 else None) for k in range(150)] + [(1000, 999)], "id long, parent long")
    got = {r.id: (r.root, r.depth) for r in lineage.lineage(v).collect()}
    assert got == {k: (k // 50 * 50, k % 50) for k in range(150)} | {1000: (1000, 0)}
    assert lineage.ancestors(v).count() == 3 * 50 * 51 // 2 + 1


def test_columns_of_odd_values(spark):
    rows = spark.createDataFrame([("@nix {broken",), ("plain",), ('@nix {"action":"start","text":""}',), (None,), ("/nix/store/a b",)], "x string")
    assert [r.p for r in rows.select(logs.progress(F.col("x")).alias("p")).collect()] == [None, "plain", None, None, "/nix/store/a b"]
    assert [r.p for r in rows.select(logs.path_allowed(F.col("x")).alias("p")).collect()] == [False] * 5
    kinds = spark.createDataFrame([(k,) for k in range(21)], "c long").select(logs.error_kind(F.col("c")).alias("k"), "c").select(logs.error_code(F.col("k")).alias("back"), "c").collect()
    assert [r.back for r in kinds] == [k if 1 <= k <= 19 else 0 for k in range(21)]


def test_finalise_every_state(spark):
    s = spark.createDataFrame([(1, False, None), (2, False, 9), (3, True, 9), (4, False, 9), (5, False, 9)], "session_id long, aborted boolean, closed_ms long")
    m = spark.createDataFrame([(4, 2, 7, '{"result":{"ok":true,"frame_id":"f"}}'), (4, 3, 8, '{"error":"late"}'), (5, 1, 3, '{"result":{"ok":false,"error":"no"}}'), (1, 1, 1, "junk"), (2, 1, 1, '{"phase":"x"}')], "session_id long, seq long, ms long, data string")
    got = {r.session_id: tuple(r)[1:] for r in sessions.finalize(s, sessions.results(m)).collect()}
    assert got == {1: ("running", None, None), 2: ("error", 9, "session closed without result"), 3: ("aborted", 9, None), 4: ("ok", 7, None), 5: ("error", 3, "no")}


def test_long_base64_is_one_line(spark):
    rows = spark.createDataFrame([(b"x" * n,) for n in (0, 57, 58, 5000)], "b binary")
    got = {bytes(r.b): r.t for r in rows.select("b", sessions.base64_text(F.col("b")).alias("t")).collect()}
    assert got == {b: base64.b64encode(b).decode() for b in got} and len(got) == 4


def test_a_log_of_many_sessions_is_few_files(spark, tmp_path):
    path = str(tmp_path / "log")
    lines = spark.range(2000).selectExpr("CASE WHEN id > 5 THEN id END AS session_id", "concat('l', id, '\n') AS line")
    for k in range(2):
        logs.append_log(lines.where(f"pmod(hash(line), 2) = {k}"), path, 8)
    assert len(list(tmp_path.rglob("*.parquet"))) <= 16
    assert sorted(map(str, logs.read_log(spark, path).select("session_id", "line").collect())) == sorted(map(str, lines.collect()))
