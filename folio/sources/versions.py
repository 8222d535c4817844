"""Tree rows of the latest versions as a log-structured table: a base and deltas, merged when they are read.

Rows are bucketed by image. A commit adds a delta with the rows that a batch has changed, and the
heads of the images it touched; reading a bucket merges its base and deltas, and the row of the
latest commit counts at each position. So a batch costs what it touches: it reads and writes only
buckets of its images. When deltas are many they are rewritten as a new base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.tree import NODE
from folio.sources.commits import CommitLog, Entry

#: Buckets of a table, and deltas that make a compaction worth while.
BUCKETS, DELTAS = 64, 8
#: A head: the latest version of an image.
HEAD = "image_id bigint, id string, parent string, root string, dirty_pages bigint, version bigint"
_ROWS = "image_id bigint, level int, node_idx bigint, page_base bigint, hash string, bucket int"


def bucket_of(image_id: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(image_id), F.lit(buckets)).cast("int")


class Versions:
    """The table below ``path``. Every image has rows of one bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.log, self.buckets, self.deltas = spark, CommitLog(spark, path), buckets, deltas

    def has(self, batch: str) -> bool:
        return any(e.batch == batch for e in self.log.entries())

    def _merged(self, what: str, schema: str, key: list[str], entries: list[Entry], buckets: list[int] | None) -> DataFrame:
        parts = []
        for e in self.log.live(entries):
            rows = self.spark.read.schema(f"{schema}, bucket int" if what == "heads" else schema).parquet(f"{self.log.folder(e.part)}/{what}")
            parts.append((rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows).withColumn("commit", F.lit(e.number)))
        if not parts:
            return self.spark.createDataFrame([], schema).drop("bucket")
        if len(parts) == 1:
            return parts[0].drop("commit", "bucket")
        rows = parts[0]
        for x in parts[1:]:
            rows = rows.unionByName(x)
        rest = [c for c in rows.columns if c not in (*key, "commit", "bucket")]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "commit").alias("r")).select(*key, "r.*")

    def rows(self, buckets: list[int] | None = None, entries: list[Entry] | None = None) -> DataFrame:
        """NODE rows of the latest versions; only those of some buckets, if given."""
        return self._merged("rows", _ROWS, ["image_id", "level", "node_idx"], self.log.entries() if entries is None else entries, buckets).select(NODE)

    def heads(self, buckets: list[int] | None = None, entries: list[Entry] | None = None) -> DataFrame:
        """HEAD rows: the latest version of each image that has one."""
        return self._merged("heads", HEAD, ["image_id"], self.log.entries() if entries is None else entries, buckets)

    def _write(self, rows: DataFrame, heads: DataFrame) -> str:
        part, at = self.log.new_part()
        for name, df in (("rows", rows.select(NODE)), ("heads", heads)):
            placed = df.withColumn("bucket", bucket_of("image_id", self.buckets))
            placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{at}/{name}")
        return part

    def start(self, rows: DataFrame) -> None:
        """Make ``rows`` the base, unless the table has one."""
        if not self.log.entries():
            self.log.publish(Entry(0, None, self._write(rows, self.spark.createDataFrame([], HEAD)), "base"))

    def append(self, rows: DataFrame, heads: DataFrame, batch: str) -> bool:
        """Add a delta; False if its batch is there already."""
        part = self._write(rows, heads)
        while True:
            seen = self.log.entries()
            if any(e.batch == batch for e in seen):
                self.log.drop(part)
                return False
            if self.log.publish(Entry(seen[-1].number + 1 if seen else 0, batch, part, "delta")):
                break
        if len([e for e in self.log.live() if e.kind == "delta"]) >= self.deltas:
            self.compact()
        return True

    def compact(self) -> bool:
        """Rewrite base and deltas as one base; False if another commit came first, which the next one makes good."""
        seen = self.log.entries()
        live = self.log.live(seen)
        part = self._write(self.rows(entries=seen), self.heads(entries=seen))
        if self.log.publish(Entry(seen[-1].number + 1, None, part, "base", 0, [e.part for e in live])):
            return True
        self.log.drop(part)
        return False
