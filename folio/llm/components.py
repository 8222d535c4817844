"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import remove, shared_path, written, written_to


def _labels(df: DataFrame) -> tuple[DataFrame, str]:
    path = shared_path(df.sparkSession, "labels")
    return written_to(df, path), path


#: Links of a forest that one task puts together; larger ones take rounds of shuffles.
SMALL = 250_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of links a - b: the least node that each reaches, by hooking roots to lesser ones and halving paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[left], up[right]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[up]
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(up, x, least)
        np.minimum.at(up, y, least)
        while (up != (higher := up[up])).any():
            up = higher


def _forest(links: DataFrame, all_nodes: bool) -> DataFrame:
    """(node, root) by task: each task's links, however many, become one link a node. With ``all_nodes`` roots come out too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, roots, new, n_new = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            new.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n_new += batch.num_rows
            if n_new > max(100_000, len(nodes)):  # what is known so far is a forest, and new links join it when they are as many
                nodes, roots = least_labels(*(np.concatenate(x) for x in zip((nodes, roots), *new, strict=True)))
                new, n_new = [], 0
        nodes, roots = least_labels(*(np.concatenate(x) for x in zip((nodes, roots), *new, strict=True)))
        keep = slice(None) if all_nodes else nodes != roots
        for k in range(0, len(nodes[keep]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep][k : k + 100_000]), pa.array(roots[keep][k : k + 100_000])], names=["node", "root"])

    return links.mapInArrow(run, "node long, root long")


def connected_components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the least node reachable.

    First each task makes its links a forest. At most ``small`` links of all forests are put together in
    one task. More take rounds: each takes the least label among a node and its neighbours, then the
    label of that label, so long chains shorten by doubling; labels are written after each round, and
    rounds end when none changes. Nulls on either side are passed over. ``small`` changes tasks, not results.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    forest = written(_forest(links, False), "forest")
    if forest.count() <= small:
        return _forest(forest.coalesce(1), True).withColumnRenamed("root", "component")
    links = forest.select(F.col("node").alias("a"), F.col("root").alias("b"))
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"), F.lit(True).alias("changed"))
    labels, path = _labels(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        labels, new = _labels(least.join(jump, "via").select("node", F.least("via", "next").alias("component"), (F.least("via", "next") < F.col("was")).alias("changed")))
        remove(labels.sparkSession, path)
        path = new
        if not labels.where("changed").take(1):
            return labels.select("node", "component")
