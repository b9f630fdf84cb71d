"""Queries of sources, cleaning, joins, aggregates, macro series and look-back transforms (S, K, P, J, A, O, M, R)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.exprs import pct as spark_pct, prev
from ..operators import align, macro, price, quality, transforms
from ..sources.views import LAGS, available, bars, common_grid, macro_long, macro_monthly, round_trip_csv, round_trip_observations, round_trip_parquet, round_trip_results, round_trip_trends, sector_and_ticker, table
from .catalog import MW, W, add, lag, on_bars, past, pct, roll

ALL = ["open", "high", "low", "close", "volume"]
ALLS = "ticker, date, open, high, low, close, volume"

# sources and sinks
on_bars("s1_common_grid", common_grid, [], ALL, f"\n====\nSELECT {ALLS} FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars))")
on_bars("s2_relabel", lambda b: b.select(F.concat(F.lit("T_"), "ticker").alias("ticker"), "date", F.col("close").alias("price")), [], ["price"], "\n====\nSELECT 'T_' || ticker AS ticker, date, close AS price FROM bars")
add("s3_observations_json", lambda s, d: round_trip_observations(macro_long(macro_monthly(s, d), list(LAGS))), ["series_id", "obs_date"], ["value"], "\n====\nSELECT series_id, date AS obs_date, value FROM (UNPIVOT macro ON discount, tax, price INTO NAME series_id VALUE value)")
add("s4_trends", lambda s, d: round_trip_trends(macro_monthly(s, d), ["discount", "tax"]), ["date"], ["trend_discount", "trend_tax"], "\n====\nSELECT date, discount AS trend_discount, tax AS trend_tax FROM macro")
on_bars("s5_k1_csv_round_trip", round_trip_csv, [], ALL, f"\n====\nSELECT {ALLS} FROM bars")
on_bars("s7_k2_parquet_round_trip", lambda b: round_trip_parquet(b, "ticker"), [], ALL, f"\n====\nSELECT {ALLS} FROM bars")
NAMES = "SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN n_name || '__' || n_nationkey ELSE replace(n_name, ' ', '_') || '_X_' || n_nationkey END AS name FROM nation"


def _names(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation")
    key = F.col("n_nationkey").cast("string")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("__"), key)).otherwise(F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit("_X_"), key))
    return n.select(name.alias("name")).distinct().select("name", *sector_and_ticker("name"))


add("s9_file_names", _names, ["name", "sector", "ticker"], [], f"n AS ({NAMES})\n====\nSELECT name, CASE WHEN contains(name, '__') THEN split_part(name, '__', 1) ELSE split_part(name, '_', 1) END AS sector, CASE WHEN contains(name, '__') THEN split_part(name, '__', 2) ELSE string_split(name, '_')[-1] END AS ticker FROM n")

# cleaning
add("p1_normalize_date", lambda s, d: transforms.normalize_date(table(s, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("x")).otherwise(F.lit(" 10:00:00"))).alias("Date"))), ["o_orderkey", "date"], [], "\n====\nSELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
on_bars("p2_validate", lambda b: transforms.validate(b.unionByName(b).withColumn("none", F.lit(None).cast("double")).withColumn("volume", F.when(F.col("volume") == 1, F.lit(float("inf"))).otherwise(F.col("volume"))), ["ticker", "date"], ["close"]), [], ["close", "volume"], "\n====\nSELECT ticker, date, close, CASE WHEN volume <> 1 THEN volume END AS volume FROM bars")
add("p3_dedupe_last", lambda s, d: transforms.dedupe(table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "last"), ["o_custkey", "o_orderkey"], [], "\n====\nSELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
HOLES = "h AS (SELECT ticker, date, CASE WHEN day(date) % 3 <> 0 THEN close END AS a, CASE WHEN day(date) % 2 <> 0 THEN open END AS b, CASE WHEN day(date) % 5 <> 0 THEN high END AS c FROM bars)"


def holes(b: DataFrame) -> DataFrame:
    day = F.dayofmonth("date")
    return b.select("ticker", "date", *[F.when(day % n != 0, F.col(c)).alias(o) for n, c, o in ((3, "close", "a"), (2, "open", "b"), (5, "high", "c"))])


on_bars("p4_drop_all_null", lambda b: holes(b).na.drop("all", subset=["a", "b", "c"]), [], ["a", "b", "c"], f"{HOLES}\n====\nSELECT * FROM h WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL")
on_bars("p5_drop_any_null", lambda b: holes(b).na.drop("any"), [], ["a", "b", "c"], f"{HOLES}\n====\nSELECT * FROM h WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
on_bars("p6_drop_rows_by_share", lambda b: transforms.drop_rows(holes(b), 0.7, ["a", "b", "c"]), [], ["a", "b", "c"], f"{HOLES}\n====\nSELECT * FROM h WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT >= 2")
on_bars("p7_drop_sparse_columns", lambda b: transforms.drop_sparse(holes(b).withColumn("d", F.lit(None).cast("double")), 0.4), [], ["a", "b", "c"], f"{HOLES}\n====\nSELECT * FROM h")
on_bars("p8_warm_up", lambda b: transforms.after_warm_up(b, 60), [], ["close"], f"k AS (SELECT *, row_number() OVER ({W}) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM bars)\n====\nSELECT * FROM k WHERE n <= 60 OR k > 60")
on_bars("p9_tail", lambda b: transforms.tail(b, 750), [], ["close"], "k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars)\n====\nSELECT * FROM k WHERE k <= 750")
on_bars("p10_without_strings", lambda b: transforms.without_strings(b), [], ["close"], "\n====\nSELECT date, close FROM bars", keys=("date",))
on_bars("p11_split_and_recombine", lambda b: transforms.recombine(b.select("ticker", "date", *[(F.col(c) * 2).alias(c) for c in transforms.split_numeric(b)[0]]), b.columns), [], ALL, f"\n====\nSELECT ticker, date, {', '.join(f'{c} * 2 AS {c}' for c in ALL)} FROM bars")
on_bars("p12_date_range", lambda b: b.where(F.col("date").between("1997-01-01", "1998-12-31")), [], ["close"], "\n====\nSELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
on_bars("p13_shift", lambda b: transforms.shift(b, ["close", "nothing"], 2), [], ["close"], f"\n====\nSELECT ticker, date, {lag('close', 2)} AS close FROM bars")
on_bars("p14_safe_division", lambda b: b.withColumn("q", F.try_divide(F.col("close"), F.col("volume") - 1)), [], ["q"], "\n====\nSELECT ticker, date, close / nullif(volume - 1, 0) AS q FROM bars")
on_bars("p16_one_hot", lambda b: transforms.one_hot(b.withColumn("v", F.col("volume").cast("int")), "v", [1, 2], "is"), ["is_1", "is_2"], [], "\n====\nSELECT ticker, date, volume = 1 AS is_1, volume = 2 AS is_2 FROM bars")
on_bars("p17_value_map", lambda b: b.withColumn("code", F.coalesce(F.create_map(F.lit("1-URGENT"), F.lit(1), F.lit("2-HIGH"), F.lit(2))[F.col("ticker")], F.lit(0))), ["code"], [], "\n====\nSELECT ticker, date, CASE ticker WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS code FROM bars")
on_bars("p18_p19_drop_and_rename", lambda b: b.drop("open", "high").withColumnsRenamed({"close": "Close", "volume": "Volume"}), [], ["Close", "Volume"], '\n====\nSELECT ticker, date, close AS "Close", volume AS "Volume" FROM bars')
add("p20_coerce_numbers", lambda s, d: table(s, d, "events").select("event_id", F.expr("try_cast(CASE WHEN event_id % 3 = 0 THEN '.' ELSE cast(value AS string) END AS double)").alias("value")), ["event_id"], ["value"], "\n====\nSELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events")
on_bars("p21_prefilter", lambda b: holes(b).withColumn("flat", F.lit(1.0)).select("ticker", "date", *transforms.prefilter(holes(b).withColumn("flat", F.lit(1.0)), ["a", "b", "c", "flat"], 0.4)), [], ["a", "c"], f"{HOLES}\n====\nSELECT * FROM h")

# joins
PIV = ", ".join(f"max(CASE WHEN ticker = '{t}' THEN close END) AS {c}" for t, c in (("1-URGENT", "urgent"), ("2-HIGH", "high_"), ("5-LOW", "low_")))


def _tickers(b: DataFrame) -> list[DataFrame]:
    return [b.where(F.col("ticker") == t).select("date", F.col("close").alias(c)) for t, c in (("1-URGENT", "urgent"), ("2-HIGH", "high_"), ("5-LOW", "low_"))]


on_bars("j1_outer_fold", lambda b: align.outer_fold(_tickers(b)), [], ["urgent", "high_", "low_"], f"\n====\nSELECT date, {PIV} FROM bars WHERE ticker IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY date", keys=("date",))
add("j2_pivot_series", lambda s, d: align.pivot_series(macro_long(macro_monthly(s, d), list(LAGS)), list(LAGS)), ["date"], list(LAGS), "\n====\nSELECT * FROM macro")
MROW = "mm AS (SELECT date, CASE WHEN month(date) % 4 = 0 THEN NULL ELSE discount END AS discount, tax FROM macro WHERE month(date) % 5 <> 0)"


def _macro_holes(s: SparkSession, d: str) -> DataFrame:
    m = macro_monthly(s, d).where(F.month("date") % 5 != 0)
    return m.select("date", F.when(F.month("date") % 4 != 0, F.col("discount")).alias("discount"), "tax")


ASOF = f"{MROW}\n====\nSELECT b.ticker, b.date, CASE WHEN b.date - m.date <= {{days}} THEN m.date END AS asof_date, CASE WHEN b.date - m.date <= {{days}} THEN m.discount END AS discount, CASE WHEN b.date - m.date <= {{days}} THEN m.tax END AS tax FROM bars b ASOF LEFT JOIN mm m ON b.date >= m.date"
add("j3_asof_tolerance", lambda s, d: align.asof(bars(s, d), _macro_holes(s, d), ["discount", "tax"], 31), ["ticker", "date", "asof_date"], ["discount", "tax"], ASOF.format(days=31))
add("j6_j10_asof", lambda s, d: align.asof(bars(s, d), _macro_holes(s, d), ["discount", "tax"]), ["ticker", "date", "asof_date"], ["discount", "tax"], ASOF.format(days=99999))
KEYED = f"a AS (SELECT ticker, date + 10 AS date, close AS old_close FROM bars WHERE day(date) % 6 = 0)\n====\nSELECT b.ticker, b.date, CASE WHEN b.date - a.date <= 15 THEN a.old_close END AS old_close FROM bars b ASOF LEFT JOIN a ON b.ticker = a.ticker AND b.date >= a.date"
on_bars("j3_asof_by_key", lambda b: align.asof(b, b.where(F.dayofmonth("date") % 6 == 0).select("ticker", F.date_add("date", 10).alias("date"), F.col("close").alias("old_close")), ["old_close"], 15, by="ticker"), [], ["old_close"], KEYED)
BD = lambda d, n: f"(CAST({d} AS DATE) + CAST({n} + 2 * ((least(isodow({d}) - 1, 4) + {n}) // 5) - greatest(isodow({d}) - 5, 0) AS INTEGER))"
LAGGED = ", ".join(f"l{i} AS (SELECT {BD('date', n)} AS date, arg_max({c}, date) AS {c} FROM macro GROUP BY 1)" for i, (c, n) in enumerate(LAGS.items()))
add("j4_asof_lagged", lambda s, d: align.asof_lagged(bars(s, d).select("ticker", "date"), macro_monthly(s, d), LAGS, 31), ["ticker", "date"], list(LAGS), f"{LAGGED}\n====\nSELECT b.ticker, b.date, {', '.join(f'CASE WHEN b.date - l{i}.date <= 31 THEN l{i}.{c} END AS {c}' for i, c in enumerate(LAGS))} FROM bars b {' '.join(f'ASOF LEFT JOIN l{i} ON b.date >= l{i}.date' for i in range(len(LAGS)))}")
on_bars("j8_j9_left_with_default", lambda b: align.fill_left(b.select("ticker", "date"), b.where("volume > 1").select("ticker", "date", "close"), ["ticker", "date"], {"close": 0.0}), [], ["close"], "\n====\nSELECT ticker, date, CASE WHEN volume > 1 THEN close ELSE 0 END AS close FROM bars")
on_bars("j11_key_intersection", lambda b: b.join(b.where("volume > 1").select("ticker", "date"), ["ticker", "date"], "left_semi"), [], ["close"], "\n====\nSELECT * FROM bars WHERE volume > 1")
SPANS = [("1996-01-01", "1996-02-01"), ("1998-06-01", "1998-06-10")]
on_bars("j12_overlaps", lambda b: align.overlapping(b.select("ticker", F.col("date").alias("t"), F.date_add("date", 7).alias("t1")), b.sparkSession.createDataFrame(SPANS, "lo string, hi string").select(F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))), ["ticker", "t", "lo"], [], f"s AS (SELECT CAST(column0 AS DATE) AS lo, CAST(column1 AS DATE) AS hi FROM (VALUES {', '.join(map(str, SPANS))}) AS v(column0, column1))\n====\nSELECT ticker, date AS t, lo FROM bars JOIN s ON date <= hi AND date + 7 >= lo", keys=())
on_bars("j13_forward_path", lambda b: b.withColumn("path_max", F.max("close").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(1, 10))), [], ["path_max"], f"\n====\nSELECT ticker, date, max(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS path_max FROM bars")

# aggregates
on_bars("a1_month_end", lambda b: align.month_end(b, ["close", "volume"], by=["ticker"]), ["month_end"], ["close", "volume"], "m AS (SELECT ticker, last_day(date) AS month_end, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY 1, 2), s AS (SELECT ticker, last_day(CAST(unnest(generate_series(date_trunc('month', min(month_end)), date_trunc('month', max(month_end)), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM m GROUP BY ticker)\n====\nSELECT s.ticker, s.month_end, close, volume FROM s LEFT JOIN m USING (ticker, month_end)", keys=("ticker",))
add("a2_business_days", lambda s, d: align.business_days(macro_monthly(s, d), ["discount", "tax"]), ["date"], ["discount", "tax"], "s AS (SELECT CAST(unnest(generate_series(min(date) - CAST(greatest(isodow(min(date)) - 5, 0) AS INTEGER), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM macro)\n====\nSELECT s.date, m.discount, m.tax FROM s ASOF LEFT JOIN macro m ON s.date >= m.date WHERE isodow(s.date) < 6")
on_bars("a3_scalars", lambda b: b.groupBy("ticker").agg(F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"), F.percentile("close", 0.5).alias("median"), F.percentile("close", 0.9).alias("q90"), F.min("close").alias("lo"), F.max("close").alias("hi"), F.count("*").alias("n")), ["n"], ["mean", "sd", "median", "q90", "lo", "hi"], "\n====\nSELECT ticker, count(*) AS n, avg(close) AS mean, stddev_samp(close) AS sd, quantile_cont(close, 0.5) AS median, quantile_cont(close, 0.9) AS q90, min(close) AS lo, max(close) AS hi FROM bars GROUP BY 1", keys=("ticker",))
on_bars("a4_mean_by_year", lambda b: b.groupBy("ticker", F.year("date").alias("year")).agg(F.avg(F.when(F.col("close") > F.col("open"), 1.0).otherwise(0.0)).alias("rate")), ["year"], ["rate"], "\n====\nSELECT ticker, CAST(year(date) AS INTEGER) AS year, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS rate FROM bars GROUP BY 1, 2", 3, ("ticker",))
on_bars("a5_class_counts", lambda b: b.groupBy("ticker", F.col("volume").cast("int").alias("v")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ticker"))), ["v", "n"], ["share"], "\n====\nSELECT ticker, CAST(volume AS INTEGER) AS v, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY ticker) AS share FROM bars GROUP BY 1, 2", keys=("ticker",))
STALE = ", ".join(f"row_number() OVER (PARTITION BY ticker, g{c} ORDER BY date) - 1 AS s{c}" for c in "abc")
PROFILE = f"""{HOLES}, n AS (SELECT *, {', '.join(f'CASE WHEN {c} = {lag(c)} THEN 0 ELSE 1 END AS n{c}' for c in 'abc')}, date - {lag('date')} AS gap FROM h), g AS (SELECT *, {', '.join(f'sum(n{c}) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g{c}' for c in 'abc')} FROM n), s AS (SELECT *, {STALE} FROM g)
====
SELECT ticker AS dataset, count(*) AS rows, count(*) - count(DISTINCT date) AS dup_index_rows, floor(quantile_cont(gap, 0.5)) AS median_gap_days, (avg((a IS NULL)::INT) + avg((b IS NULL)::INT) + avg((c IS NULL)::INT)) / 3 AS nan_overall,
  CAST((avg((a IS NULL)::INT) > 0.8)::INT + (avg((b IS NULL)::INT) > 0.8)::INT + (avg((c IS NULL)::INT) > 0.8)::INT AS INTEGER) AS n_sparse_cols,
  CAST(coalesce((var_pop(a) < 1e-10)::INT, 0) + coalesce((var_pop(b) < 1e-10)::INT, 0) + coalesce((var_pop(c) < 1e-10)::INT, 0) AS INTEGER) AS n_near_constant, CAST(greatest(max(sa), max(sb), max(sc)) AS INTEGER) AS worst_staleness FROM s GROUP BY 1"""
on_bars("a6_a12_profile", lambda b: quality.profile(holes(b), ["a", "b", "c"]), ["dataset", "rows", "dup_index_rows", "n_sparse_cols", "n_near_constant", "worst_staleness"], ["median_gap_days", "nan_overall"], PROFILE, keys=())
RESULTS = ["dataset", "rows", "dup_index_rows", "n_sparse_cols", "n_near_constant", "worst_staleness"]
on_bars("k3_results_files", lambda b: round_trip_results(quality.profile(holes(b), ["a", "b", "c"])), RESULTS, ["median_gap_days", "nan_overall"], PROFILE, keys=())
on_bars("a10_identical_columns", lambda b: quality.identical_columns(b.withColumn("copy", F.col("close")), [*ALL, "copy"], ["ticker", "date"]), ["a", "b"], [], "\n====\nSELECT 'close' AS a, 'copy' AS b UNION ALL SELECT a, b FROM (SELECT 'open' AS a, 'close' AS b, bool_and(open IS NOT DISTINCT FROM close) AS same FROM bars) WHERE same", keys=())
on_bars("a13_index_stats", quality.index_stats, ["rows", "dups", "first", "last"], ["median_gap"], f"g AS (SELECT *, date - {lag('date')} AS g FROM bars)\n====\nSELECT ticker, count(*) AS rows, count(*) - count(DISTINCT date) AS dups, min(date) AS first, max(date) AS last, quantile_cont(g, 0.5) AS median_gap FROM g GROUP BY 1", keys=("ticker",))
FWD = "f AS (SELECT ticker, date, lead(close, {w}) OVER (" + W + ") / nullif(close, 0) - 1 AS fwd FROM bars)"
HEALTH = f"""f AS (SELECT ticker, date, w AS horizon, lead(close, w) OVER (PARTITION BY ticker, w ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM bars, (VALUES (5), (10)) v(w)),
  y AS (SELECT f.*, t AS threshold, CASE WHEN fwd > t THEN 1 ELSE 0 END AS y FROM f, (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.05 AS DOUBLE))) v(t) WHERE fwd IS NOT NULL),
  n AS (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY ticker, horizon, threshold ORDER BY date) THEN 0 ELSE 1 END AS n FROM y),
  d AS (SELECT ticker, horizon, threshold, max(r) - min(r) AS drift FROM (SELECT ticker, horizon, threshold, year(date), avg(y) AS r FROM y GROUP BY ALL) GROUP BY ALL)
====
SELECT ticker, CAST(horizon AS INTEGER) AS horizon, threshold, count(*) AS eff_samples, CAST(sum(y) AS BIGINT) AS pos_count, avg(y) AS pos_rate, quantile_cont(fwd, 0.5) AS median_ret, quantile_cont(fwd, 0.1) AS q10, quantile_cont(fwd, 0.9) AS q90,
  sum(y) / nullif(sum(CASE WHEN y = 1 THEN n END), 0) AS mean_run_up, sum(1 - y) / nullif(sum(CASE WHEN y = 0 THEN n END), 0) AS mean_run_down, any_value(drift) AS drift,
  concat_ws(';', CASE WHEN avg(y) < 0.05 OR avg(y) > 0.95 THEN 'extreme_imbalance' END, CASE WHEN any_value(drift) > 0.25 THEN 'base_rate_drift' END, CASE WHEN count(*) < 100 THEN 'insufficient_samples' END) AS issues
FROM n JOIN d USING (ticker, horizon, threshold) GROUP BY ticker, horizon, threshold"""
on_bars("a14_target_health", lambda b: quality.target_health(b, [5, 10], [0.0, 0.05]), ["horizon", "eff_samples", "pos_count", "issues"], ["threshold", "pos_rate", "median_ret", "q10", "q90", "mean_run_up", "mean_run_down", "drift"], HEALTH, keys=("ticker",))
on_bars("a15_suggested_thresholds", lambda b: quality.suggested_thresholds(b, 5, 0.3), [], ["threshold"], f"{FWD.format(w=5)}\n====\nSELECT ticker, quantile_cont(fwd, 0.7) AS threshold FROM f GROUP BY 1", keys=("ticker",))
SCORE = f"f AS (SELECT ticker, date, {pct('close')} AS r1, {pct('close', 5)} AS r5, {pct('volume')} AS v1, coalesce((lead(close, 5) OVER ({W}) / nullif(close, 0) - 1 > 0)::INT, 0) AS y FROM bars), u AS (UNPIVOT f ON r1, r5, v1 INTO NAME feature VALUE x), s AS (SELECT ticker, feature, abs(corr(x, CAST(y AS DOUBLE))) AS score FROM u GROUP BY 1, 2 HAVING count(x) >= 150), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, feature) AS k FROM s)\n====\nSELECT ticker, string_agg(feature, ',' ORDER BY k) AS top_features, avg(score) AS score FROM k WHERE k <= 2 GROUP BY 1"
on_bars("a17_a18_scores", lambda b: quality.scores(b.withColumns({"r1": spark_pct("close"), "r5": spark_pct("close", 5), "v1": spark_pct("volume"), "y": F.coalesce((F.lead("close", 5).over(Window.partitionBy("ticker").orderBy("date")) / F.col("close") - 1 > 0).cast("int"), F.lit(0))}), ["r1", "r5", "v1"], "y", 150, 2), ["top_features"], ["score"], SCORE, keys=("ticker",))


def _hashes(s: SparkSession, d: str) -> DataFrame:
    """Of bars against themselves in another order, with one cell changed, without some rows, and with some rows twice."""
    b = bars(s, d)
    first = (F.col("ticker") == "1-URGENT") & (F.col("date") == F.lit(b.where("ticker = '1-URGENT'").agg(F.min("date")).first()[0]))
    others = {"reordered": b.orderBy(F.desc("date"), "ticker"), "cell": b.withColumn("close", F.when(first, F.col("close") + 1).otherwise(F.col("close"))), "less": b.where("ticker <> '5-LOW' or volume > 1"), "twice": b.unionByName(b.where("ticker = '1-URGENT'"))}
    found = [quality.same_content(b, x).select(F.lit(n).alias("kind"), "same") for n, x in others.items()]
    return reduce(DataFrame.unionByName, found).join(F.broadcast(quality.content_hash(b).select("rows")))


NO_URGENT, NO_LOW = (f"NOT EXISTS (SELECT 1 FROM bars WHERE {x})" for x in ("ticker = '1-URGENT'", "ticker = '5-LOW' AND volume <= 1"))
HASHED = f"u AS (SELECT 'reordered' AS kind, true AS same UNION ALL SELECT 'cell', {NO_URGENT} UNION ALL SELECT 'less', {NO_LOW} UNION ALL SELECT 'twice', {NO_URGENT})"
add("a25_content_hash", _hashes, ["kind", "same", "rows"], [], f"{HASHED}\n====\nSELECT kind, same, (SELECT count(*) FROM bars) AS rows FROM u")

# sorts, limits, sets
on_bars("o1_o2_top_rows", lambda b: b.orderBy(F.desc_nulls_last("close"), "ticker", "date").limit(30), [], ["close"], "\n====\nSELECT * FROM bars ORDER BY close DESC NULLS LAST, ticker, date LIMIT 30")
on_bars("o3_top_per_group", lambda b: b.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("close"), "date"))).where("k <= 5"), ["k"], ["close"], "k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY close DESC, date) AS INTEGER) AS k FROM bars)\n====\nSELECT * FROM k WHERE k <= 5")
on_bars("o5_head_and_tail", lambda b: transforms.head_and_tail(b, 3), [], ["close"], f"k AS (SELECT *, row_number() OVER ({W}) AS a, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS z FROM bars)\n====\nSELECT * FROM k WHERE a <= 3 OR z <= 3")


def _samples(b: DataFrame) -> DataFrame:
    """Of a seeded sample: its size, how many of its rows are no bars, how many come twice, and how many another draw lacks with the same seed and (whether any) with another."""
    key = ["ticker", "date"]
    one, again, other = (quality.seeded_sample(x, key, 500, seed).select(*key) for x, seed in ((b, 42), (b.repartition(7), 42), (b, 43)))
    n = lambda x, c: x.agg(F.count("*").alias(c))
    parts = [n(one, "n"), n(one.join(b, key, "left_anti"), "strange"), n(one.groupBy(*key).count().where("count > 1"), "twice"), n(one.join(again, key, "left_anti"), "lost"), n(one.join(other, key, "left_anti"), "_o").select((F.col("_o") > 0).alias("differs"))]
    return reduce(lambda a, x: a.join(F.broadcast(x)), parts)


on_bars("o6_seeded_sample", _samples, ["n", "strange", "twice", "lost", "differs"], [], "\n====\nSELECT least(count(*), 500) AS n, 0::BIGINT AS strange, 0::BIGINT AS twice, 0::BIGINT AS lost, count(*) > 500 AS differs FROM bars", keys=())
on_bars("o7_union_all", lambda b: b.where("volume > 1").unionByName(b.where("volume > 2")), [], ["close"], "\n====\nSELECT * FROM bars WHERE volume > 1 UNION ALL SELECT * FROM bars WHERE volume > 2")
on_bars("o8_intersect_and_except", lambda b: b.where("volume > 1").select("ticker", "date").intersect(b.where("close > open").select("ticker", "date")).exceptAll(b.where("ticker = '5-LOW'").select("ticker", "date")), [], [], "\n====\nSELECT ticker, date FROM bars WHERE volume > 1 AND close > open AND ticker <> '5-LOW'")

# macro features; the lags of M1 are dates
add("m1_available_dates", lambda s, d: available(macro_long(macro_monthly(s, d), list(LAGS)), LAGS), ["series_id", "obs_date", "available_date"], ["value"], f"u AS (SELECT series_id, date, value FROM (UNPIVOT macro ON discount, tax, price INTO NAME series_id VALUE value))\n====\nSELECT series_id, date AS obs_date, CASE series_id {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {BD('date', n)}' for c, n in LAGS.items())} END AS available_date, value FROM u")


def economy(s: SparkSession, d: str) -> DataFrame:
    return macro_monthly(s, d).withColumn("region", F.lit("all"))


def on_macro(name: str, f, doubles: list[str], sql: str, columns: tuple[str, ...] = (), digits: int = 6) -> None:
    add(name, lambda s, d: f(economy(s, d)), ["date", *columns], doubles, sql, digits)


def zsql(c: str, n: int, least: int) -> str:
    return f"(({c}) - {roll('avg', c, n, least, MW)}) / ({roll('stddev_samp', c, n, least, MW)} + 1e-12)"


CURVE = "c AS (SELECT *, (discount + tax + price) / 3 AS level, price - discount AS slope, price - 2 * tax + discount AS curvature FROM macro)"

# prices are some ten thousand times the other series: compared in units of a thousand
MOMENTS = ["level", "slope", "curvature"]
on_macro("m3_curve_moments", lambda m: macro.curve_moments(m.withColumn("price", F.col("price") / 1000), "discount", "tax", "price"), [*MOMENTS, "level_z", "slope_z", "curvature_z"], f"{CURVE.replace('price', '(price / 1000)').replace('SELECT *', 'SELECT date')}\n====\nSELECT date, level, slope, curvature, {zsql('level', 252, 60)} AS level_z, {zsql('slope', 252, 60)} AS slope_z, {zsql('curvature', 252, 60)} AS curvature_z FROM c", digits=4)
on_macro("m4_risk_appetite", lambda m: macro.risk_appetite(m, ["discount", "tax"]), ["discount_z21", "tax_z252", "risk_appetite"], f"z AS (SELECT date, {zsql('discount', 21, 21)} AS discount_z21, {zsql('discount', 252, 60)} AS d, {zsql('tax', 252, 60)} AS tax_z252 FROM macro)\n====\nSELECT date, discount_z21, tax_z252, -list_avg(list_filter([d, tax_z252], lambda x: x IS NOT NULL)) AS risk_appetite FROM z")
PCT = "(SELECT count(*) FILTER (WHERE b.{c} <= a.{c}) / nullif(count(b.{c}), 0) FROM {t} b WHERE b.date < a.date)"
REG = f"g AS (SELECT *, discount / lag(discount) OVER ({MW}) - 1 AS g, tax / lag(tax) OVER ({MW}) - 1 AS i FROM macro), p AS (SELECT a.date, coalesce((g > 0)::INT, 0) AS g, coalesce((i > 0)::INT, 0) AS i, coalesce(({PCT.format(c='price', t='macro')} < 0.8)::INT, 0) AS r FROM g a)\n====\nSELECT date, CAST(2 * g + i + 3 * r AS INTEGER) AS regime_code, CAST(4 * r + 2 * g + i AS INTEGER) AS regime_bits FROM p"
on_macro("m5_regimes", lambda m: macro.regimes(m.withColumns({"g": F.col("discount") / prev("discount", 1, macro.w()) - 1, "i": F.col("tax") / prev("tax", 1, macro.w()) - 1}), "g", "i", "price"), [], REG, ("regime_code", "regime_bits"))
on_macro("m6_m7_expanding", lambda m: macro.expanding(m, "price", 6), ["price_mean", "price_std", "price_z", "price_pctile"], f"e AS (SELECT *, {past('avg', 'price', 6, MW)} AS m, nullif({past('stddev_samp', 'price', 6, MW)}, 0) AS s FROM macro)\n====\nSELECT date, m AS price_mean, s AS price_std, (price - m) / s AS price_z, {PCT.format(c='price', t='macro')} AS price_pctile FROM e a", digits=4)
SIMPLE = f"e AS (SELECT *, price / nullif(lag(price, 12) OVER ({MW}), 0) * 100 - 100 AS yoy, tax - discount AS carry FROM macro)\n====\nSELECT date, yoy, carry, (yoy - {past('avg', 'yoy', 12, MW)}) / nullif({past('stddev_samp', 'yoy', 12, MW)}, 0) AS yoy_z, (carry - {past('avg', 'carry', 12, MW)}) / nullif({past('stddev_samp', 'carry', 12, MW)}, 0) AS carry_z FROM e"
on_macro("m8_simple_features", lambda m: macro.simple_features(m, "price", "tax", "discount"), ["yoy", "carry", "yoy_z", "carry_z"], SIMPLE)


def late_sql(made: dict[str, str]) -> str:
    """Expressions and their changes over five rows, one row late."""
    inner = ", ".join(f"{x} AS _{c}" for c, x in made.items())
    outer = ", ".join(f"lag(_{c}) OVER ({MW}) AS {c}, lag(_{c}) OVER ({MW}) - lag(_{c}, 6) OVER ({MW}) AS {c}_chg_5" for c in made)
    return f"s AS (SELECT date, {inner} FROM macro)\n====\nSELECT date, {outer} FROM s"


def with_changes(*names: str) -> list[str]:
    return [x for n in names for x in (n, f"{n}_chg_5")]


on_macro("m9_late_curve", lambda m: macro.late_curve(m, "price", "tax", "discount", "bill"), with_changes("yc_level", "yc_slope_two", "yc_curvature"), late_sql({"yc_level": "price", "yc_slope_two": "price - discount", "yc_curvature": "price - 2 * tax + discount"}), digits=7)
on_macro("m9_late_curve_with_bill", lambda m: macro.late_curve(m, "tax", "five", "two", "discount"), with_changes("yc_level", "yc_slope_bill"), late_sql({"yc_level": "tax", "yc_slope_bill": "tax - discount"}))
LIQUID = {"proxy_ted_like": "tax - discount", "term_slope": "price - tax", "carry_ff": "price - discount"}
on_macro("m10_liquidity_proxies", lambda m: macro.liquidity_proxies(m, "discount", "tax", "price"), with_changes(*LIQUID), late_sql(LIQUID), digits=7)
SUR = f"s AS (SELECT date, discount - tax AS s, discount / nullif(lag(discount) OVER ({MW}), 0) - 1 AS c FROM macro), p AS (SELECT *, {zsql('c', 24, 12)} AS p FROM s)\n====\nSELECT date, lag(s) OVER ({MW}) AS discount_surprise, lag(p) OVER ({MW}) AS discount_surprise_proxy_z FROM p"
on_macro("m13_surprises", lambda m: macro.surprises(m, "discount", "tax"), ["discount_surprise", "discount_surprise_proxy_z"], SUR, digits=5)
SHOWN = ["discount_surprise", "discount_surprise_proxy_z"]


def _with_surprises(m: DataFrame) -> DataFrame:
    """The latest surprises, known ten days after their month, beside the month's own series."""
    s = macro.surprises(m, "discount", "tax").select(F.date_add("date", 10).alias("date"), *SHOWN)
    return align.asof(m, s, SHOWN, 31)


on_macro("j5_asof_surprises", _with_surprises, ["discount", *SHOWN], f"{SUR.replace(chr(10) + '====' + chr(10), ', q AS (').replace('SELECT date, lag(s)', 'SELECT date + 10 AS date, lag(s)')})\n====\nSELECT m.date, m.discount, {', '.join(f'CASE WHEN m.date - q.date <= 31 THEN q.{c} END AS {c}' for c in SHOWN)} FROM macro m ASOF LEFT JOIN q ON m.date >= q.date", digits=5)
add("m11_m12_pca_regimes", lambda s, d: macro.pca_regimes(economy(s, d), ["discount", "tax", "price"]), ["date", "regime_km"], ["pc1", "pc2"], None, 5)
STATE = {"yc_level": "price", "yc_slope_bill": "price - tax", **LIQUID, "discount_surprise": "discount - tax"}
on_macro("m14_state_features", lambda m: macro.state_features(m, "price", "five", "two", "tax", "discount", "discount", "tax"), [*with_changes(*list(STATE)[:-1]), "discount_surprise"], late_sql(STATE), digits=7)


def _daily_macro(s: SparkSession, d: str) -> DataFrame:
    """Month-end series with their features, each published by its lag, on business days: the last of equal dates, latest value carried."""
    monthly = align.month_end(macro_monthly(s, d), list(LAGS)).withColumnRenamed("month_end", "date").withColumn("region", F.lit("all"))
    monthly = monthly.select("date", "region", *LAGS)
    span = bars(s, d).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)
    shown = align.asof_lagged(days, monthly, LAGS).withColumn("region", F.lit("all"))
    return macro.risk_appetite(macro.liquidity_proxies(shown, "discount", "tax", "price"), ["discount", "tax"])


LAG_DAYS = ", ".join(f"l{i} AS (SELECT {BD('last_day(date)', n)} AS d, arg_max({c}, date) AS {c} FROM macro WHERE {c} IS NOT NULL GROUP BY 1)" for i, (c, n) in enumerate(LAGS.items()))
DAILY = f"{LAG_DAYS}, days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars)::TIMESTAMP, (SELECT max(date) FROM bars)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date), shown AS (SELECT days.date, {', '.join(LAGS)} FROM days {' '.join(f'ASOF LEFT JOIN l{i} ON days.date >= l{i}.d' for i in range(len(LAGS)))} WHERE isodow(days.date) < 6), z AS (SELECT *, {zsql('discount', 252, 60)} AS dz, {zsql('tax', 252, 60)} AS tz FROM shown)"
add("m2_m15_macro_pipeline", _daily_macro, ["date"], [*LAGS, *LIQUID, "discount_z21", "risk_appetite"], f"{DAILY}\n====\nSELECT date, discount, tax, price, lag(tax - discount) OVER ({MW}) AS proxy_ted_like, lag(price - tax) OVER ({MW}) AS term_slope, lag(price - discount) OVER ({MW}) AS carry_ff, {zsql('discount', 21, 21)} AS discount_z21, -list_avg(list_filter([dz, tz], lambda x: x IS NOT NULL)) AS risk_appetite FROM z", 3)

# transforms that look back only
on_bars("r1_imputer", lambda b: transforms.impute(holes(b).withColumns({"a": F.ln("a"), "b": F.ln("b")}), ["a", "b"], 1), [], ["a", "b"], f"{HOLES}, l AS (SELECT ticker, date, ln(a) AS a, ln(b) AS b FROM h)\n====\nSELECT ticker, date, coalesce(a, {past('avg', 'a')}) AS a, coalesce(b, {past('avg', 'b')}) AS b FROM l")


def std_sql(c: str, least: int, sigmas: float) -> str:
    z = f"({c} - {past('avg', c, least)}) / (nullif({past('stddev_samp', c, least)}, 0) + 1e-12)"
    return f"CASE WHEN {z} IS NOT NULL THEN least(greatest({z}, -{sigmas}), {sigmas}) END"


on_bars("r2_standardizer", lambda b: transforms.standardize(holes(b), ["a", "b"], 60, 4.0), [], ["a", "b"], f"{HOLES}\n====\nSELECT ticker, date, {std_sql('a', 60, 4.0)} AS a, {std_sql('b', 60, 4.0)} AS b FROM h")
PASTW = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def win_sql(c: str, lo: float, hi: float, least: int) -> str:
    q = lambda p: f"CASE WHEN count({c}) OVER {PASTW} >= {least} THEN quantile_cont({c}, {p}) OVER {PASTW} END"
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {q(lo)}), {q(hi)}) END"


on_bars("r3_winsorizer", lambda b: transforms.winsorize(b, ["close"], 0.05, 0.95, 20), [], ["close"], f"\n====\nSELECT ticker, date, {win_sql('close', 0.05, 0.95, 20)} AS close FROM bars", 4)
CHAIN = f"{HOLES}, w AS (SELECT ticker, date, {win_sql('a', 0.01, 0.99, 200)} AS a FROM h), i AS (SELECT ticker, date, coalesce(a, {past('avg', 'a', 20)}) AS a FROM w)\n====\nSELECT ticker, date, {std_sql('a', 60, 4.0)} AS a FROM i"
on_bars("r4_transform_chain", lambda b: transforms.chain(holes(b), ["a"]), [], ["a"], CHAIN, 5)
WZ = "q AS (SELECT ticker, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi, count(close) AS n FROM bars GROUP BY 1), x AS (SELECT b.ticker, date, n, least(greatest(close, lo), hi) AS x FROM bars b JOIN q ON b.ticker = q.ticker)\n====\nSELECT ticker, date, CASE WHEN n >= 5 THEN (x - avg(x) OVER (PARTITION BY ticker)) / nullif(stddev_pop(x) OVER (PARTITION BY ticker), 0) END AS close_z FROM x"
on_bars("r5_whole_sample_z", lambda b: transforms.whole_sample_z(b, "close"), [], ["close_z"], WZ)
REGIME = f"r AS (SELECT *, {pct('close')} AS r FROM bars), v AS (SELECT *, {roll('stddev_samp', 'r', 60)} AS v FROM r), m AS (SELECT ticker, quantile_cont(v, 0.5) AS m FROM v GROUP BY 1)\n====\nSELECT v.ticker, v.date, CASE WHEN v < 0.8 * m THEN 0 WHEN v > 1.2 * m THEN 2 ELSE 1 END AS regime FROM v JOIN m ON v.ticker = m.ticker"
on_bars("r6_volatility_regimes", lambda b: transforms.volatility_regimes(price.returns(b), "ret_1", 60), ["regime"], [], REGIME)
