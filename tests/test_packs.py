"""Pack files as a source, a sink and a stream; only what is asked for is read."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from folio.sources import packs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(packs.PackSource)
    path = str(tmp_path_factory.mktemp("packs"))
    rng = random.Random(1)
    data = [rng.randbytes(rng.choice([0, 10, 3000, 70_000])) for _ in range(60)]
    rows = [(hashlib.sha256(x).hexdigest(), x) for x in data]
    df = spark.createDataFrame(rows, "hash string, bytes binary").dropDuplicates(["hash"])
    df.where("hash < '9'").repartition(2).write.format("folio-packs").mode("append").save(path)
    df.where("hash >= '9'").repartition(1).write.format("folio-packs").mode("append").save(path)
    return path, dict(rows)


def test_what_is_written_is_read(spark, folder):
    path, want = folder
    got = spark.read.format("folio-packs").load(path).collect()
    assert {r.hash: bytes(r.bytes) for r in got} == want and len(got) == len(want)
    assert [n[:12] for n, _ in packs.names(path)] == ["0" * 12] * 2 + ["0" * 11 + "1"]
    index = {(r.hash, r.pack, r.offset, r.len) for r in packs.index(spark, path).collect()}
    assert index == {(r.hash, r.pack, r.offset, r.len) for r in got}
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", b"b")], "hash string, bytes binary").write.format("folio-packs").mode("overwrite").save(path)


def test_stretches_of_a_pack_are_partitions(spark, folder, monkeypatch):
    path, want = folder
    monkeypatch.setattr(packs, "SPAN", 50_000)
    parts = packs._Reader(path).partitions()
    assert len(parts) > 12
    rows = [r for p in parts for batch in packs._Reader(path).read(p) for r in batch.to_pylist()]
    assert {r["hash"]: r["bytes"] for r in rows} == want and len(rows) == len(want)


def test_ranges_read_only_what_they_need(spark, folder, monkeypatch):
    path, want = folder
    asked = packs.index(spark, path).where("len > 0 AND substring(hash, 1, 1) IN ('0', '5', 'c')")
    got = {r.hash: bytes(r.bytes) for r in packs.range_read(asked, path, gap=0).collect()}
    assert got == {h: x for h, x in want.items() if x and h[0] in "05c"}
    with pytest.raises(Exception, match="beyond the end"):
        packs.range_read(asked.limit(1).withColumn("offset", F.lit(1 << 40)), path).collect()

    class Counted:
        """Counts the bytes that a file is asked for."""

        def __init__(self, file):
            self.file, self.read = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.read += n
            return self.file.read_at(n, at)

    disk, top = packs._at(path)
    name, size = max(packs.names(path), key=lambda x: x[1])
    with disk.open_input_file(f"{top}/{name}") as file:
        counted = Counted(file)
        found = packs.index_of(counted)
        assert counted.read < 16 + 200 * len(found) < size / 10


def test_many_small_ranges_of_a_pack_take_a_step_each(spark, tmp_path):
    """Ranges that are read as one aren't gone through again for each further one."""
    spark.dataSource.register(packs.PackSource)
    path, n = str(tmp_path / "packs"), 40_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.encode(F.col("id").cast("string"), "utf-8").alias("bytes"))
    rows.coalesce(1).write.format("folio-packs").mode("append").save(path)
    start = time.monotonic()
    assert packs.range_read(packs.index(spark, path), path).where(F.sha2("bytes", 256) == F.col("hash")).count() == n
    assert time.monotonic() - start < 15


def test_a_stream_meets_packs_as_they_come(spark, tmp_path):
    spark.dataSource.register(packs.PackSource)
    path = str(tmp_path / "packs")
    seen = []
    for k in range(3):
        spark.createDataFrame([(f"h{k}{j}", b"x" * j) for j in range(4)], "hash string, bytes binary").write.format("folio-packs").mode("append").save(path)
        q = spark.readStream.format("folio-packs").load(path).writeStream.foreachBatch(lambda df, n: seen.append({r.hash for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        q.awaitTermination()
    assert [s for s in seen if s] == [{f"h{k}{j}" for j in range(4)} for k in range(3)]
