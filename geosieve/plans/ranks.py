"""Places and percentiles over whole tables: sorted by ranges, so that no task holds more than one range."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.plans.storage import stored

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = 33


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with each one's place (from 0) by the columns `order`, which should tell all rows apart.

    Ranges are sorted and written once, with each row's place in its range; where a range begins is the sum of those before
    it, a window over one row a range.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", _WITHIN)), "ranks")
    sizes = at.groupBy(F.col("_range").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    begins = sizes.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    place = F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << _WITHIN) - 1))
    return at.join(F.broadcast(begins), F.col("_range") == F.col("_of")).select(*rows.columns, place.alias(name))


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact interpolated percentiles of a column, nulls left out; None for each if nothing is left.

    Two rows a percentile reach the driver. Rows of one value are told apart by a hash of the others, so a frequent
    value is cut into ranges too.
    """
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"), F.xxhash64(*rows.columns).alias("_tie"))
    at = stored(ranked(known, ["_v", "_tie"], "_place").select("_v", "_place"), "percentiles")
    n = at.count()
    if n == 0:
        return [None] * len(shares)
    spots = [p * (n - 1) for p in shares]
    wanted = sorted({f(s) for s in spots for f in (floor, ceil)})
    value = {r["_place"]: r["_v"] for r in at.where(F.col("_place").isin(wanted)).collect()}
    return [value[floor(s)] if floor(s) == ceil(s) else (ceil(s) - s) * value[floor(s)] + (s - floor(s)) * value[ceil(s)] for s in spots]
