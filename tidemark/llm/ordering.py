"""Ranges of a key and places within them, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Quantiles that ranges follow; ranges between two of them, and how many rows a range should have.
KNOTS, LEAST_PER, MOST_PER, RANGE_ROWS = 64, 4, 8192, 500


def ranges(rows: DataFrame, key: str) -> Column:
    """A number of the range that ``key`` (an integer) lies in, ascending with it; null keys have the lowest.

    Between two of ``KNOTS`` quantiles of all rows lie equally wide ranges, as
    many as make about ``RANGE_ROWS`` rows each, so ids may be dense, sparse or
    clustered.  At most ``KNOTS * (MOST_PER + 1) + 2`` numbers occur.  Equal keys share a range.
    """
    of = F.col(key)
    row = rows.agg(F.percentile_approx(of, [i / KNOTS for i in range(KNOTS + 1)], 10_000), F.count("*")).first()
    edges = sorted(set(row[0] or []))
    if not edges:
        return F.lit(0).cast("long")
    per = min(MOST_PER, max(LEAST_PER, -(-row[1] // (KNOTS * RANGE_ROWS))))
    at = F.array(*[F.lit(x).cast("long") for x in edges])
    k = F.greatest(F.size(F.filter(at, lambda e: e <= of)), F.lit(1))
    low = F.element_at(at, k)
    width = F.coalesce(F.get(at, k), low).cast("double") - low + 1
    step = F.least(F.floor((of.cast("double") - low) / width * per), F.lit(per))
    return F.when(of.isNull(), F.lit(-2)).when(of < edges[0], F.lit(-1)).otherwise(k * (per + 1) + step).cast("long")


def numbered(rows: DataFrame, by: str, order: list[str], within: Column) -> DataFrame:
    """``rows`` with ``nth`` (from 1), the place of a row among those with the same ``by``, in order of ``within`` and then ``order``.

    Rows are numbered within each range, and the sizes of the ranges before are added.
    """
    split = rows.withColumn("_range", within)
    sizes = split.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = split.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)))
    same = (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by"))
    return own.join(starts, same).withColumn("nth", F.col("_k") + F.col("_start")).drop("_range", "_r", "_k", "_start", "_by")
