"""Joins and alignment of series: as-of joins, calendars, resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import bday_add


def outer_fold(frames: list[DataFrame], on: str = "date") -> DataFrame:
    """Full outer join of frames on a key; their other columns must differ."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def pivot_series(long: DataFrame, names: list[str], date: str = "obs_date") -> DataFrame:
    """One column per series; the names are given, so no pass over the data finds them."""
    return long.groupBy(F.col(date).alias("date")).pivot("series_id", names).agg(F.first("value", ignorenulls=True))


def per_day(rows: DataFrame, days: int | None, until: Column | None = None) -> DataFrame:
    """``rows(_d, _r)``, the series of one economy -> (_day, _r): each day with the row in force, at most ``days`` old, to the day ``until``.

    One row per day of the calendar, whatever the number of bars: some ten thousand a century.
    The dates of a series are in one window: one row each.
    """
    one = rows.where(F.col("_d").isNotNull()).groupBy("_d").agg(F.max("_r").alias("_r"))
    end = F.date_sub(F.lead("_d").over(Window.orderBy("_d")), 1)
    if days is None:
        end = F.coalesce(end, until)
    else:
        end = F.least(end, F.date_add("_d", days))  # skips NULLs
    return one.withColumn("_end", end).where("_end >= _d").select(F.explode(F.sequence("_d", "_end")).alias("_day"), "_r")


def asof(left: DataFrame, right: DataFrame, columns: list[str], days: int | None = None, by: str | None = None, left_on: str = "date", right_on: str = "date") -> DataFrame:
    """Each left row with the latest right row on or before its date, at most ``days`` earlier (inclusive).

    The whole right row is taken, so a NULL cell stays NULL; of right rows with
    equal dates the largest.  Without a key the right side becomes a table of
    days, which is broadcast: the left side is joined on its date without a
    shuffle.  With a key both sides are united and sorted by key and date, right rows
    before left ones of a date, and the last right row seen is carried along: one
    shuffle, and no range join.  Left rows without a date get no right row.
    """
    if not by:
        held = F.struct(F.col(right_on).cast("date").alias("asof_date"), *columns)
        until = None if days is not None else F.lit(left.agg(F.max(F.col(left_on).cast("date"))).first()[0]).cast("date")
        table = per_day(right.select(F.col(right_on).cast("date").alias("_d"), held.alias("_r")), days, until)
        kept = [c for c in left.columns if c not in columns and c != "asof_date"]
        return left.select(*kept).join(F.broadcast(table), F.col(left_on).cast("date") == F.col("_day"), "left").select(*kept, "_r.*")
    held = F.struct(F.col(right_on).cast("date").alias("asof_date"), *columns)
    kept = [c for c in left.columns if c not in columns and c != "asof_date"]
    a = left.select(F.struct(*kept).alias("_l"), F.col(left_on).cast("date").alias("_d"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("_r"), F.col(by).alias("_k"))
    b = right.where(F.col(right_on).isNotNull()).select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(right_on).cast("date").alias("_d"), F.lit(0).alias("_side"), held.alias("_r"), F.col(by).alias("_k"))
    w = Window.partitionBy("_k").orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if days is not None:
        both = both.withColumn("_m", F.when(F.datediff("_d", "_m.asof_date") <= days, F.col("_m")))
    both = both.withColumn("_m", F.when(F.col("_d").isNotNull(), F.col("_m")))
    return both.select("_l.*", "_m.*")


def asof_lagged(left: DataFrame, macro: DataFrame, lags: dict[str, int], days: int | None = None) -> DataFrame:
    """As-of join of each series of a wide macro table at its date plus its publication lag in business days."""
    until = None if days is not None else F.lit(left.agg(F.max(F.col("date").cast("date"))).first()[0]).cast("date")
    # all series in one pass: (series, day it is out, value); of values that are out on the same day the later observation
    each = F.array(*[F.struct(F.lit(c).alias("_s"), bday_add("date", n).alias("_d"), F.col(c).cast("double").alias("_v")) for c, n in lags.items()])
    long = macro.select("date", F.explode(each).alias("x")).select("date", "x.*").where("_v is not null and _d is not null")
    out = long.groupBy("_s", "_d").agg(F.max_by("_v", "date").alias("_v"))
    w = Window.partitionBy("_s").orderBy("_d")
    end = F.date_sub(F.lead("_d").over(w), 1)
    end = F.coalesce(end, until) if days is None else F.least(end, F.date_add("_d", days))
    daily = out.withColumn("_end", end).where("_end >= _d").select("_s", "_v", F.explode(F.sequence("_d", "_end")).alias("_day"))
    # one row per day of the calendar: the left side is read once, and not shuffled
    table = daily.groupBy("_day").pivot("_s", list(lags)).agg(F.first("_v"))
    kept = [c for c in left.columns if c not in lags]
    return left.select(*kept).join(F.broadcast(table), F.col("date").cast("date") == F.col("_day"), "left").select(*kept, *lags)


def fill_left(keys: DataFrame, values: DataFrame, on: list[str], defaults: dict[str, float]) -> DataFrame:
    """Left join with defaults for what is missing."""
    j = keys.join(values, on, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def overlapping(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events (t, t1) that overlap a span (lo, hi): the spans are fold bounds, a few rows."""
    return events.join(F.broadcast(spans), (F.col("t") <= F.col("hi")) & (F.col("t1") >= F.col("lo")))


def month_end(df: DataFrame, columns: list[str], date: str = "date", by: list[str] | None = None) -> DataFrame:
    """The last value that is not NULL of each month, dated at its end; months between without rows are there, with NULLs."""
    by = by or []
    m = df.groupBy(*by, F.last_day(date).alias("month_end")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns])
    span = m.groupBy(*by).agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
    spine = span.select(*by, F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("m")).select(*by, F.last_day("m").alias("month_end"))
    return spine.join(m, [*by, "month_end"], "left")


def business_days(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """A row per business day from the first date's (or the one before) to the last, carrying the latest row."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    low = F.date_sub("lo", F.greatest(F.weekday("lo") - 4, F.lit(0)))
    spine = span.select(F.explode(F.sequence(low, F.col("hi"))).alias("date")).where(F.weekday("date") < 5)
    return asof(spine, df.select(F.col(date).alias("date"), *columns), columns).drop("asof_date")


def window_bars(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """Bars of events (ts, event_type, value, event_id) by tumbling windows; with ``late`` also over a stream."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("ticker")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("n"), F.sum("value").alias("total")).select("ticker", F.col("w.start").alias("start"), "high", "low", "n", "total")
