"""Filters, sketches and interval scans against what they stand for."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.catalog import stores
from folio.operators import bloom, diff, lineage, scans, spans, tree


def names(spark, keys):
    return spark.createDataFrame([(hashlib.sha256(str(k).encode()).hexdigest(),) for k in keys], "hash string")


def test_bloom_filter_errs_as_often_as_it_should(spark):
    n, asked = 30_000, 40_000
    held = names(spark, range(n))
    bits, places = bloom.sized(n, 0.02)
    filter_ = bloom.build(held, bits, places).cache()
    assert filter_.count() == -(-bits // bloom.BUCKET) and places == 6
    assert bloom.ask(held, filter_, bits, places).where("NOT present").count() == 0
    wrong = bloom.ask(names(spark, range(n, n + asked)), filter_, bits, places).where("present").count()
    want = asked * bloom.expected_rate(n, bits, places)
    assert 0.8 * want < wrong < 1.2 * want and 0.015 < want / asked < 0.025


def test_bloom_patch_sends_what_is_lacking(spark):
    for n in (0, 1, 500):
        held, wanted = names(spark, range(n)), names(spark, range(n // 2, n + 400)).unionByName(names(spark, [n + 1]))
        rows, _, _ = bloom.patch(wanted, held, 0.2)
        got = rows.collect()
        assert {r.hash for r in got} == {r.hash for r in names(spark, range(n, n + 400)).collect()} and len(got) == 400
        assert n < 500 or 30 < sum(r.round == "repair" for r in got) < 140


def test_sketched_affinity_finds_the_best_holders(spark):
    rng = random.Random(4)
    held = [(h, b) for h in range(60) for b in rng.sample(range(20_000), 3000)]
    wanted = []
    for v in range(30):
        near, other = rng.sample(range(60), 2)
        mine = {b for h, b in held if h == near}
        wanted += [(v, b) for b in {*rng.sample(sorted(mine), 900), *rng.sample([b for h, b in held if h == other], 300)}]
    w, h = spark.createDataFrame(wanted, "version long, hash long"), spark.createDataFrame(held, "holder long, hash long")
    exact = {(r.version, r.place): (r.holder, r.overlap) for r in lineage.affinity(w, h, 3).collect()}
    found = {(r.version, r.place): (r.holder, r.overlap) for r in lineage.affinity_sketched(w, h, 3, k=256).collect()}
    overlap = {(r.version, r.holder): r.overlap for r in lineage.affinity(w, h).collect()}
    assert all(overlap[v, holder] == n for (v, _), (holder, n) in found.items())
    first = [x for x in exact if x[1] <= 2]  # the third is one of many alike
    assert sum(found.get(x) == exact[x] for x in first) >= 0.95 * len(first)
    whole = {(r.version, r.place): (r.holder, r.overlap) for r in lineage.affinity_sketched(w, h, 3, k=5000, candidates=3, common=60).collect()}
    assert whole == exact


def test_merged_sketches_know_percentiles(spark):
    rng = random.Random(5)
    rows = [(v, c, rng.gammavariate(2, 30) * (1 + c)) for v in range(20) for c in range(2) for _ in range(700)] + [(0, 0, None)]
    parts = spans.sketches(spark.createDataFrame(rows, "version long, component long, ms double"), "version", "component")
    got = {r.component: r for r in spans.percentiles(spans.merged(parts, "component"), p50=0.5, p95=0.95).collect()}
    for c in range(2):
        mine = sorted(ms for _, k, ms in rows if k == c and ms is not None)
        assert got[c].n == len(mine) and abs(got[c].total_ms - sum(mine)) < 1e-3 and got[c].most_ms == mine[-1]
        for p, x in ((0.5, got[c].p50), (0.95, got[c].p95)):
            assert abs(sum(m <= x for m in mine) / len(mine) - p) < 0.015


def test_scans_of_any_range(spark):
    rng = random.Random(6)
    rows = [(k % 3, rng.randrange(-20, 40), k, rng.choice([None, 1, 5, 9])) for k in range(200)]
    df = spark.createDataFrame(rows, "key long, place long, id long, value long").withColumn("out", F.lit(1))
    for how in ("sum", "max"):
        want = {}
        for key, place, i, _ in rows:
            before = [v for k, p, j, v in rows if k == key and (p, j) < (place, i) and v is not None]
            want[i] = (sum(before) if how == "sum" else max(before)) if before else None
        for size in (1, 7, 4096):
            got = scans.before(df.drop("out"), ["key"], "place", F.col("value"), "out", how, ["id"], size).collect()
            assert {r.id: r.out or (None if how == "max" else r.out) for r in got} == want, (how, size)


def test_equal_extents_make_pages_once(spark):
    rows = [(1, 0, 4_000_000, 4_000_000)] * 1000 + [(1, k * 8192, k * 8192 + 100, 4_000_000) for k in range(400)] + [(2, 5, 5, 10), (2, 9000, 20_000, 10_000), (2, 4095, 4097, 10_000), (3, 0, 1, 0)]
    df = spark.createDataFrame(rows, "image_id long, data_off long, hole_off long, file_size long")
    got = tree.dirty_extents(df, 4096)
    found = {(r.image_id, r.page_no): r.n_bytes for r in got.collect()}
    want = {(1, k): min(4096, 4_000_000 - k * 4096) for k in range(977)} | {(2, 0): 4096, (2, 1): 4096, (2, 2): 10_000 - 8192}
    assert found == want and got.count() == len(want)


def test_a_diff_multiplies_no_row(spark):
    """Neither the diff nor its pre-order has a row an ancestor."""
    nodes = spark.createDataFrame([], "image_id long, level int, node_idx long, page_base long, hash string")
    plan = diff.preorder(diff.tree_diff(nodes, nodes.select("hash"), 4))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_affinity_rank_keeps_every_machine(spark):
    """The ranking is whole: a place for each pair that shares a blob, beyond the fifth too."""
    got = stores.affinity_rank(spark, "/root/testdata/sf0.001")
    wanted, held = stores._parts(spark, "/root/testdata/sf0.001")
    assert got.count() == wanted.join(held, "hash").select("version", "holder").distinct().count()
    assert got.where("place > 5").count() > 0


def test_pairs_of_a_blob_with_many_holders_travel_in_parts(spark, monkeypatch):
    """However holders are put together, each pair is counted; pairs themselves aren't shuffled."""
    wanted = spark.range(30).selectExpr("id % 3 AS version", "id % 5 AS hash").distinct()
    held = spark.range(200).selectExpr("id AS holder", "id % 7 AS hash")
    want = sorted(map(tuple, wanted.join(held, "hash").groupBy("version", "holder").count().collect()))
    for size in (1, 3, 4096):
        monkeypatch.setattr(lineage, "TOGETHER", size)
        got = lineage.affinity(wanted, held)
        assert sorted((r.version, r.holder, r.overlap) for r in got.collect()) == want
    keys = [x.split(")")[0] for x in got._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
    assert any("version#" in k for k in keys) and not any("version#" in k and "holder#" in k for k in keys)


def test_sketched_pairs_are_counted_where_they_are_made(spark, monkeypatch):
    """Whole sets give what affinity() does, without a version or holder too, however pairs come in batches; pairs aren't shuffled."""
    rng = random.Random(8)
    w = {(rng.choice([None, *range(9)]), rng.randrange(50)) for _ in range(300)}
    h = {(rng.choice([None, "a", "é", *map(str, range(12))]), rng.randrange(50)) for _ in range(250)}
    wanted, held = spark.createDataFrame(sorted(w, key=str), "version long, hash long"), spark.createDataFrame(sorted(h, key=str), "holder string, hash long")
    want = sorted(map(str, lineage.affinity(wanted, held, 4).collect()))
    for step, batch in ((1, 3), (1 << 18, 10_000)):
        monkeypatch.setattr(lineage, "STEP", step)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = lineage.affinity_sketched(wanted, held, 4, k=100, candidates=4)
            assert sorted(map(str, got.collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exact = {(r.version, r.holder): r.overlap for r in lineage.affinity(wanted, held).collect()}
    assert all(exact[r.version, r.holder] == r.overlap for r in lineage.affinity_sketched(wanted, held, 4, k=5).collect())
    made = []
    monkeypatch.setattr(lineage, "written", lambda df, name: made.append((name, df)) or df)
    lineage.affinity_sketched(wanted, held, 4, k=100)
    plan = dict(made)["likely"]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any("version#" in x.split(")")[0] and "holder#" in x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_lists_of_numbers_are_packed_and_come_back():
    rng, most = random.Random(4), 2**63 - 1
    packed, unpacked = lineage._packing()
    for _ in range(100):
        lists = [[None] * rng.randrange(2) + sorted({rng.choice([rng.randrange(9), rng.randrange(-300, 300), rng.randrange(-most - 1, most), most, -most - 1]) for _ in range(rng.randrange(9))}) for _ in range(rng.randrange(1, 12))]
        found, n = unpacked(packed(pa.array(lists, pa.list_(pa.int64()))))
        found = iter(found.to_pylist())
        assert [[next(found) for _ in range(k)] for k in n] == lists
    assert len(packed(pa.array([list(range(1000, 2000, 33))], pa.list_(pa.int64())))[0].as_py()) < 40


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_affinity_ranks_where_pairs_are_made(spark, kind, monkeypatch):
    """Every place as by hand, without a version or holder too; no aggregate and no window that could spill what pairs make."""
    rng = random.Random(kind)
    w = {(rng.choice([None, *range(9)]), rng.randrange(50)) for _ in range(200)}
    h = {(rng.choice([None, -7, *range(12)]), rng.choice([None, *range(50)])) for _ in range(250)}
    wanted = spark.createDataFrame(sorted(w, key=str), "version long, hash long")
    held = spark.createDataFrame(sorted(h, key=str), "holder long, hash long").select(F.col("holder").cast(kind).alias("holder"), "hash")
    n = Counter((v, x) for v, a in w for x, b in h if a == b)
    of = str if kind == "string" else int
    order = lambda x: (x is not None, x if x is None else of(x))
    want = []
    for version in {v for v, _ in n}:
        best = sorted((-k, order(x), x) for (v, x), k in n.items() if v == version)
        want += [(version, x if x is None else of(x), -k, place) for place, (k, _, x) in enumerate(best, 1)]
    monkeypatch.setattr(lineage, "ROWS", 20)
    monkeypatch.setattr(lineage, "TOGETHER", 3)
    got = lineage.affinity(wanted, held)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.dtypes == [("version", "bigint"), ("holder", held.dtypes[0][1]), ("overlap", "bigint"), ("place", "bigint")]
    assert sorted(map(tuple, lineage.affinity(wanted, held, 2).collect()), key=str) == sorted((r for r in want if r[3] <= 2), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and "Window" not in plan
