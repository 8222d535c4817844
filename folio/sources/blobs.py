"""A store of blobs named by their hash, with version records. Tables in, tables out; folders for what is kept.

Data is staged before the entry of the log that names it, so readers never meet half a commit, and a
commit that is repeated, or made twice at the same time, adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.operators.tree import content_hash, packed, unpacked
from folio.sources.commits import CommitLog, Entry
from folio.sources.shared import COMPRESSION, passing_shuffles, written

#: The hashes of a version record besides its tree.
ARTIFACTS = ("kernel", "initrd", "store_disk", "cmdline", "snapshot")
RECORD = "id string, parent string, mem_tree struct<root: string, len: bigint>, created_unix_ms bigint, " + ", ".join(f"{a} string" for a in ARTIFACTS)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, len, bytes) of binary files, those without bytes included, which Spark's readers pass over."""
    found = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("len"), F.col("content").alias("bytes"))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    tops = list(fs.globStatus(p) or [])
    files = [x for t in tops for x in (fs.listStatus(t.getPath()) if t.isDirectory() else [t])]
    none = [(x.getPath().toString(), 0, b"") for x in files if x.isFile() and not x.getLen() and x.getPath().getName()[0] not in "._"]
    return found.unionByName(spark.createDataFrame(none, found.schema)) if none else found


def put(data: DataFrame, store: DataFrame) -> DataFrame:
    """(hash, bytes, n_bytes) to append: the distinct contents of ``data`` (bytes) that ``store`` (hash) lacks."""
    named = data.where("bytes IS NOT NULL").withColumn("hash", content_hash(F.col("bytes"))).groupBy("hash").agg(F.any_value("bytes").alias("bytes"))
    return named.join(store.select("hash"), "hash", "left_anti").select("hash", "bytes", F.octet_length("bytes").cast("long").alias("n_bytes"))


def verify(request: DataFrame, store: DataFrame) -> DataFrame:
    """(pos, hash, status, bytes): 'ok', 'missing' or 'corrupt'; bytes only if they hash to their name."""
    held = store.select("hash", F.col("bytes").alias("b"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(~content_hash(F.col("b")).eqNullSafe(F.col("hash")), "corrupt").otherwise("ok")
    return request.select("pos", "hash").join(held, "hash", "left").withColumn("status", status).select("pos", "hash", "status", F.when(F.col("status") == "ok", F.col("b")).alias("bytes"))


def batch_get(request: DataFrame, store: DataFrame) -> DataFrame:
    """(pos, hash, bytes) for every requested place, repeats kept; one absent or corrupt hash fails the batch when it is read."""
    found = verify(request, store)
    return found.select("pos", "hash", F.when(F.col("status") == "ok", F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("batch get: "), "status", F.lit(" "), "hash"))).alias("bytes"))


STORED = "hash string, bytes binary, n_bytes bigint"


def _new_records(record: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose id isn't ``known``, each id once; ids that two different records share fail.

    Ids and short hashes go first, so records themselves move only if some are known or come again.
    ``record`` is read twice.
    """
    rest = [c for c in record.columns if c != "id"]
    mark = F.unhex(F.sha2(F.to_json(F.struct(*rest)), 256)).alias("mark")
    one = record.select("id", mark).groupBy("id").agg(F.count("*").alias("n"), F.min("mark").alias("least"), F.max("mark").alias("most"))
    same = F.when(F.col("least") == F.col("most"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("commit refused: two records of "), "id")))
    ids = one.join(known.select("id", F.lit(True).alias("there")), "id", "left").select(same.alias("id"), "n", F.col("there").isNotNull().alias("there"))
    ids = written(ids, "ids")
    n_known, n_new, most = ids.agg(F.count_if("there"), F.count_if(~F.col("there")), F.max("n")).first()
    if not n_new:
        return record.where("false")
    if n_known:
        record = record.join(ids.where("NOT there").select(F.col("id").alias("fresh")), F.expr("id <=> fresh"), "left_semi")
    return record if most == 1 else record.groupBy("id").agg(F.any_value(F.struct(*rest)).alias("r")).select("id", "r.*")


def _lacking(blobs: DataFrame, held: DataFrame) -> DataFrame:
    """(hash, bytes, n_bytes, good): blobs whose names ``held`` (hash) lacks, each once."""
    lacking = blobs.select(packed("hash").alias("name"), "bytes").join(held.select(packed("hash").alias("name")), "name", "left_anti")
    once = lacking.withColumn("good", _good(unpacked("name"))).groupBy("name").agg(F.any_value("bytes").alias("bytes"), F.bool_and("good").alias("good"))
    return once.select(unpacked("name").alias("hash"), "bytes", _size(), "good")


def _fresh(staged: DataFrame, held: DataFrame | None) -> bool:
    """Whether blobs have each name once, and ``held`` none of them."""
    names = staged.select(packed("hash").alias("name"))
    if names.groupBy("name").count().where("count > 1").take(1):
        return False
    return held is None or not names.join(held.select(packed("hash").alias("name")), "name", "left_semi").take(1)


def _good(name: Column) -> Column:
    return content_hash(F.col("bytes")).eqNullSafe(name)


def _size() -> Column:
    return F.octet_length("bytes").cast("long").alias("n_bytes")


def commit(blobs: DataFrame, record: DataFrame, path: str, batch: str | None = None, log: CommitLog | None = None, fresh: bool = False) -> int:
    """Commit (hash, bytes) and records (RECORD) to the folder ``path``; returns the number of blobs written.

    What is held already is passed over by name. The rest is checked and staged, a blob in one pass and a
    record after its id, each once; any blob that doesn't hash to its name fails the commit, nothing of it is
    visible, and what was staged goes. Else an entry of the log makes blobs and records visible together.
    A commit that is repeated changes nothing; one whose ``batch`` has been committed isn't even read.
    Of writers at the same time the later one drops what the earlier ones brought.
    Where blobs are ``fresh``, each once and none held, they are staged where they are and only their names
    are compared; those that aren't fresh are dropped as ever, but bytes move once more.
    """
    spark, log = blobs.sparkSession, log or CommitLog(blobs.sparkSession, path)
    seen = log.entries()
    if batch is not None and any(e.batch == batch for e in seen):
        return 0
    part, at = log.new_part()
    try:
        held = _blobs(spark, log, seen).select("hash")
        with passing_shuffles(spark):
            staged = blobs.select("hash", "bytes", _size(), _good(F.col("hash")).alias("good")) if fresh else _lacking(blobs, held)
            staged.write.parquet(f"{at}/blobs", compression=COMPRESSION)
            n, bad = spark.read.parquet(f"{at}/blobs").agg(F.count("*"), F.min(F.when(~F.col("good"), F.coalesce("hash", F.lit("null"))))).first()
            if bad:
                raise ValueError(f"commit refused: blob {bad} doesn't hash to its name")
            if fresh and not _fresh(spark.read.parquet(f"{at}/blobs"), held if any(e.rows for e in log.live(seen)) else None):
                staged, old = _lacking(spark.read.parquet(f"{at}/blobs"), held), part
                part, at = log.new_part()
                staged.write.parquet(f"{at}/blobs", compression=COMPRESSION)
                log.drop(old)
                n = spark.read.parquet(f"{at}/blobs").count()
        _new_records(record, _records(spark, log, seen)).write.json(f"{at}/records", ignoreNullFields=True, compression="gzip")
    except Exception:
        log.drop(part)
        raise
    while True:
        number = seen[-1].number + 1 if seen else 0
        if log.publish(Entry(number, batch, part, "data", n)):
            return n
        before, seen = part, log.entries()
        later = [e for e in seen if e.number >= number]
        if batch is not None and any(e.batch == batch for e in later):
            log.drop(before)
            return 0
        part, to = log.new_part()
        spark.read.parquet(f"{at}/blobs").join(_blobs(spark, log, later).select("hash"), "hash", "left_anti").write.parquet(f"{to}/blobs")
        spark.read.schema(RECORD).json(f"{at}/records").join(_records(spark, log, later).select("id"), "id", "left_anti").write.json(f"{to}/records", ignoreNullFields=True, compression="gzip")
        log.drop(before)
        n, at = spark.read.parquet(f"{to}/blobs").count(), to


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite a store of many small commits as one part; returns how many parts it takes the place of. Readers see the same before and after."""
    log = CommitLog(spark, path)
    seen = log.entries()
    live = [e for e in log.live(seen) if e.kind in ("data", "compact")]
    if len(live) < 2:
        return 0
    part, at = log.new_part()
    _blobs(spark, log, seen).withColumn("good", F.lit(True)).write.parquet(f"{at}/blobs")
    _records(spark, log, seen).write.json(f"{at}/records", ignoreNullFields=True, compression="gzip")
    number = seen[-1].number + 1
    while not log.publish(Entry(number, None, part, "compact", sum(e.rows for e in live), [e.part for e in live])):
        later = [e for e in log.entries() if e.number >= number]
        if any(e.replaces for e in later):  # another one has compacted meanwhile
            log.drop(part)
            return 0
        number = later[-1].number + 1  # what has come since stays beside the new part
    return len(live)


def _blobs(spark: SparkSession, log: CommitLog, entries: list[Entry]) -> DataFrame:
    paths = [f"{log.folder(e.part)}/blobs" for e in log.live(entries) if e.rows]
    return spark.read.schema(STORED).parquet(*paths) if paths else spark.createDataFrame([], STORED)


def _records(spark: SparkSession, log: CommitLog, entries: list[Entry]) -> DataFrame:
    paths = [f"{log.folder(e.part)}/records" for e in log.live(entries)]
    return spark.read.schema(RECORD).json(paths) if paths else spark.createDataFrame([], RECORD)


def stored(spark: SparkSession, path: str, log: CommitLog | None = None) -> DataFrame:
    """Blobs of all commits."""
    log = log or CommitLog(spark, path)
    return _blobs(spark, log, log.entries())


def records(spark: SparkSession, path: str, log: CommitLog | None = None) -> DataFrame:
    """Version records; an unknown id is no row."""
    log = log or CommitLog(spark, path)
    return _records(spark, log, log.entries())


def pack_index(entries: DataFrame, packs: DataFrame) -> DataFrame:
    """(hash, pack, offset, len): entries whose pack is there; of several packs with a hash the last by name counts."""
    live = entries.join(packs.select("pack").distinct(), "pack", "left_semi")
    best = live.groupBy("hash").agg(F.max_by(F.struct("pack", "offset", "len"), F.struct("pack", "offset")).alias("b"))
    return best.select("hash", "b.*")


def range_read(wanted: DataFrame, packs: DataFrame) -> DataFrame:
    """(hash, bytes) at (pack, offset, len); each pack is read once for all its ranges."""
    at = wanted.join(packs.select("pack", F.col("bytes").alias("whole")), "pack")
    return at.select("hash", F.expr("substring(whole, CAST(offset + 1 AS INT), CAST(len AS INT))").alias("bytes"))


def locate(request: DataFrame, index: DataFrame) -> DataFrame:
    """``request`` (hash, ...) with where each blob lies: pack, offset and len; null where the index has it not."""
    return request.join(index.select("hash", "pack", "offset", "len"), "hash", "left")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, len, hash) of whole binary files."""
    return scan_files(spark, path).select("path", "len", content_hash(F.col("bytes")).alias("hash"))


def export(blobs: DataFrame, folder: str) -> DataFrame:
    """Write each blob (hash, bytes) as a row of the Parquet files of its shard, ``folder``/a=aa; returns (hash, path, len).

    A row's path names shard, second shard and blob, as shard_path() does. Shards are dealt to tasks
    whole, so a shard has one file. Parquet holds the bytes, since a file a blob suits no cluster.
    """
    rows = blobs.select("hash", "bytes", F.substring("hash", 1, 2).alias("a"), F.substring("hash", 3, 2).alias("b"))
    rows.repartition("a").sortWithinPartitions("a").write.partitionBy("a").parquet(folder)
    return blobs.sparkSession.read.schema("hash string, bytes binary, b string, a string").parquet(folder).select("hash", F.concat_ws("/", "a", "b", "hash").alias("path"), F.octet_length("bytes").cast("long").alias("len"))


def shard_path(h):
    """aa/bb/hash."""
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def frame_ids(local: DataFrame, central: DataFrame) -> DataFrame:
    """Distinct ids of both."""
    return local.select("id").union(central.select("id")).distinct()


def tiered(request: DataFrame, local: DataFrame, central: DataFrame) -> DataFrame:
    """(id, value, tier): local before central; neither: null value, tier 'none'."""
    two = request.select("id").join(local.select("id", F.col("value").alias("l")), "id", "left").join(central.select("id", F.col("value").alias("c")), "id", "left")
    return two.select("id", F.coalesce("l", "c").alias("value"), F.when(F.col("l").isNotNull(), "local").when(F.col("c").isNotNull(), "central").otherwise("none").alias("tier"))


def running_offsets(blobs: DataFrame) -> DataFrame:
    """(pack, hash, offset, len): blobs (pack, hash, n_bytes) laid end to end in each pack, in order of hash. Packs are of bounded size."""
    w = Window.partitionBy("pack").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    return blobs.select("pack", "hash", F.coalesce(F.sum("n_bytes").over(w), F.lit(0)).cast("long").alias("offset"), F.col("n_bytes").alias("len"))
