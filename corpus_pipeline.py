"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of documents: the rows that the stage keeps, whole, extra columns included. A stage decides by id
and text in a narrow table, and the documents' rows are then filtered by a join on both: of rows
that share an id, only those whose text was rejected go. Rows without an id can't be named by a
decision; the deciding operators keep them, and so do the stages. A null text counts as empty, and
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, decontam, exact_dedup, near_dedup, quality, shared
from folio.llm.arrow import text_hash


def _without(docs: DataFrame, rejected: DataFrame, digest: Column) -> DataFrame:
    """``docs`` without the rows named in ``rejected`` (id, what ``digest`` makes of the text)."""
    named = rejected.toDF("id", "digest").where("id IS NOT NULL").distinct()
    return docs.join(named, (docs.doc_id == named.id) & (digest == named.digest), "left_anti")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose score is below 0.5 go. Equal texts have equal scores; an empty one has that of zero features."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~quality.held_out())
    return _without(docs, quality.score(docs, model).where("score < 0.5").select("doc_id", "text_hash"), text_hash())


def dedup_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the one with the largest id stays, with all rows that repeat it; null and empty texts are equal."""
    whole = F.sha2(F.coalesce(docs.text, F.lit("")), 256)
    return _without(docs, exact_dedup.exact_dedup(docs).where("NOT kept").select("doc_id", "text_sha256"), whole)


def dedup_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five words and a similarity of 0.8: the least id of each group stays; empty texts are in no group."""
    return _without(docs, near_dedup.near_duplicates(docs, with_hash=True).where("NOT kept").select("doc_id", "text_hash"), text_hash())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that repeat a test item go; empty texts repeat none."""
    found = decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated").select("doc_id", "text_hash"), text_hash())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: what is left, encoded, and decoded again as a check."""
    return bpe.encode_decode(docs, *bpe.multi_50k())


STAGES = [("quality classifier", classify), ("exact dedup", dedup_exactly), ("minhash near-dedup", dedup_nearly), ("benchmark decontamination", decontaminate), ("bpe encoding", encode)]

#: The classifier, MinHash and block-max retrieval have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written and read again as the next one's, and what came before is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = shared.kept_only(lambda s=stage, d=docs: s(spark, d, sf_dir), spark, name.replace(" ", "-"))
        if before:
            shared.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
