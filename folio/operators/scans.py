"""Running sums and maxima over long groups, by ranges: no group is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a group whose rows are one window's work.
RANGE = 4096

_HOW = {"sum": F.sum, "max": F.max}


def before(rows: DataFrame, key: list[str], place: Column | str, value: Column, out: str, how: str = "sum", then: list[Column | str] | None = None, size: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the sum or maximum of ``value`` over the rows of their group that come before; null where none does.

    Rows of a group (``key``) are ordered by ``place``, a whole number, and by ``then`` where it is
    equal. Ranges of ``size`` places are scanned singly; before them their totals are, a row a range.
    """
    size, f = size or RANGE, _HOW[how]
    place = F.col(place) if isinstance(place, str) else place
    ranged = rows.withColumns({"_place": place, "_value": value, "_range": F.floor(place / size)})
    totals = ranged.groupBy(*key, "_range").agg(f("_value").alias("_total"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", f("_total").over(earlier)).drop("_total")
    within = Window.partitionBy(*key, "_range").orderBy("_place", *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    scanned = ranged.withColumn("_inner", f("_value").over(within)).join(bases, [*key, "_range"])
    if how == "sum":
        both = F.when(F.col("_base").isNull(), F.col("_inner")).otherwise(F.col("_base") + F.coalesce("_inner", F.lit(0)))
    else:
        both = F.greatest("_base", "_inner")
    return scanned.withColumn(out, both).drop("_place", "_value", "_range", "_base", "_inner")
