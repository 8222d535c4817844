"""How long the parts of a capture take, by version and component, with percentiles from sketches that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch. A quantile's rank is off by about 1.65 / K of all rows; of up to K rows it is exact.
K = 400
#: Fixed value: milliseconds that a capture should stay below.
TARGET_MS = 500


def sketches(spans: DataFrame, *by: str, k: int = K) -> DataFrame:
    """(*by, n, total_ms, most_ms, sketch) of spans (*by, ms); null times are passed over."""
    return spans.where("ms IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("most_ms"), F.kll_sketch_agg_double(F.col("ms").cast("double"), k).alias("sketch"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of finer groups put together; no span is read again."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total_ms").alias("total_ms"), F.max("most_ms").alias("most_ms"), F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(parts: DataFrame, **points: float) -> DataFrame:
    """``parts`` with a column for each of ``points``, the value at that share of the rows, instead of the sketch."""
    return parts.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in points.items()}).drop("sketch")


def version_report(spans: DataFrame, target_ms: float = TARGET_MS) -> DataFrame:
    """(version, component, n, total_ms, most_ms, p50, p95, share, over) of spans (version, component, ms).

    ``share`` is the component's part of the version's time, ``over`` whether the whole version takes
    longer than ``target_ms``.
    """
    rows = percentiles(sketches(spans, "version", "component"), p50=0.5, p95=0.95)
    whole = rows.groupBy("version").agg(F.sum("total_ms").alias("whole_ms"))
    share = F.when(F.col("whole_ms") > 0, F.col("total_ms") / F.col("whole_ms"))
    return rows.join(whole, "version").select("version", "component", "n", "total_ms", "most_ms", "p50", "p95", share.alias("share"), (F.col("whole_ms") > target_ms).alias("over"))
