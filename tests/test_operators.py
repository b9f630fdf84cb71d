"""Operators on tiny frames with known results."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import bday_add
from tidemark.functions.recursive import Ewm, EwmStd, LocalLevel
from tidemark.operators import align, labels, learning, macro, price, quality, simulation, transforms
from tidemark.plans import pipelines
from tidemark.sources import views

D = dt.date


def bars(spark, closes, ticker="A", volumes=None, start=D(2020, 1, 1)):
    rows = [(ticker, start + dt.timedelta(days=i), c, c, c, c, (volumes or [1.0] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, views.BARS_SCHEMA)


def column(df, c, order="date"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_asof_with_publication_lag(spark):
    stock = spark.createDataFrame([(D(2020, 1, 2), 10), (D(2020, 1, 3), 11), (D(2020, 1, 6), 12)], "date date, close long")
    cpi = spark.createDataFrame([(D(2020, 1, 3), 100)], "date date, cpi long")
    out = align.asof_lagged(stock, cpi, {"cpi": 1}, 10)
    assert column(out, "cpi") == [None, None, 100]


def test_asof_tolerance_and_null_cells(spark):
    left = spark.createDataFrame([(D(2020, 2, 1),), (D(2020, 2, 2),), (None,)], "date date")
    right = spark.createDataFrame([(D(2020, 1, 1), 1.0, None), (D(2019, 1, 1), 5.0, 7.0)], "date date, a double, b double")
    got = {r["date"]: (r["a"], r["b"]) for r in align.asof(left, right, ["a", "b"], 31).collect()}
    assert got == {D(2020, 2, 1): (1.0, None), D(2020, 2, 2): (None, None), None: (None, None)}


def test_asof_equals_pandas(spark):
    rng = np.random.default_rng(0)
    day = lambda n: pd.to_datetime("2020-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 900, n)), "D")
    a, b = pd.DataFrame({"date": day(400), "i": range(400)}), pd.DataFrame({"date": day(60)}).drop_duplicates()
    b["v"] = rng.normal(size=len(b))
    want = pd.merge_asof(a, b.assign(at=b.date), on="date", tolerance=pd.Timedelta(days=20)).v.tolist()
    s = lambda x: spark.createDataFrame(x.assign(date=x.date.dt.date))
    got = column(align.asof(s(a), s(b), ["v"], 20), "v", "i")
    assert [x if x is not None else None for x in got] == [None if v != v else v for v in want]


def test_business_days(spark):
    days = [D(2020, 2, 24) + dt.timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    for n in (1, 2, 5, 11):
        got = [r[0] for r in df.select(bday_add("d", n)).collect()]
        assert got == [(pd.Timestamp(x) + pd.offsets.BDay(n)).date() for x in days]


def test_business_day_spine_shows_weekend_values_on_monday(spark):
    m = spark.createDataFrame([(D(2020, 2, 29), 1.0), (D(2020, 3, 4), 2.0)], "date date, x double")
    got = {r["date"]: r["x"] for r in align.business_days(m, ["x"]).collect()}
    assert got == {D(2020, 2, 28): None, D(2020, 3, 2): 1.0, D(2020, 3, 3): 1.0, D(2020, 3, 4): 2.0}


def test_imputer_looks_back_only(spark):
    df = bars(spark, [1.0, None, 3.0, None, 5.0])
    assert column(transforms.impute(df, ["close"]), "close") == [1.0, 1.0, 3.0, 2.0, 5.0]


def test_winsorizer(spark):
    out = column(transforms.winsorize(bars(spark, [float(i) for i in range(100)]), ["close"], 0.05, 0.95, 20), "close")
    assert out[50] == pytest.approx(46.55) and out[:20] == [float(i) for i in range(20)]


def test_monotonic(spark):
    rows = [("A", 0, D(2020, 1, 1)), ("A", 1, D(2020, 1, 2))]
    transforms.assert_monotonic(spark.createDataFrame(rows, "ticker string, seq int, date date"))
    with pytest.raises(ValueError):
        transforms.assert_monotonic(spark.createDataFrame([(t, -s, d) for t, s, d in rows], "ticker string, seq int, date date"))


def test_no_future(spark):
    s = spark.createDataFrame([(D(2020, 3, 1),)], "date date")
    transforms.assert_no_future(s, spark.createDataFrame([(D(2020, 2, 1),)], "date date"))
    with pytest.raises(ValueError):
        transforms.assert_no_future(s, spark.createDataFrame([(D(2020, 1, 1),)], "date date"))


@pytest.mark.parametrize("span", [3, 12])
def test_ewm_equals_pandas(span):
    x = [None, None, 1.0, 4.0, None, None, 2.0, 8.0, 3.0]
    e = Ewm(span, 2)
    want = pd.Series(x, dtype=float).ewm(span=span, adjust=False, min_periods=2).mean()
    assert [e(v) for v in x] == [None if v != v else pytest.approx(v) for v in want]


def test_ewm_std_equals_pandas():
    x = list(np.random.default_rng(1).normal(size=60))
    e = EwmStd(20, 20)
    want = pd.Series(x).ewm(span=20, min_periods=20).std()
    assert [e(v) for v in x] == [None if v != v else pytest.approx(v) for v in want]


def test_local_level():
    f = LocalLevel()
    assert [f(x) for x in (3.0, 4.0, 5.0)] == [3.0, pytest.approx(3.3377483444), pytest.approx(3.7666453737)]


def test_corrected_moments(spark):
    closes = [100.0]
    for r in [1, 2, 4, 8, 3] * 4:
        closes.append(closes[-1] * (1 + r / 100))
    s = pd.Series(closes).pct_change()
    row = price.event_time(bars(spark, closes)).orderBy(F.desc("date")).first()
    assert row["skew_20"] == pytest.approx(s.rolling(20).skew().iloc[-1]) and row["kurt_20"] == pytest.approx(s.rolling(20).kurt().iloc[-1])


def test_flat_prices_and_no_volume(spark):
    df = price.recursions(bars(spark, [5.0] * 40, volumes=[0.0] * 40))
    last = df.orderBy(F.desc("date")).first()
    assert last["rsi_14"] is None and last["adx_14"] == 0
    assert set(column(price.stochastic(df), "stoch_k")) == {None}
    assert set(column(price.illiquidity(df), "amihud")) == {None} and set(column(price.chaikin(df), "cmf")) == {None}


def test_short_history_is_null(spark):
    assert set(column(price.bollinger(bars(spark, [1.0, 2.0, 3.0])), "bb_mid")) == {None}


@pytest.mark.parametrize("path,kind", [([100, 101, 130], "pt"), ([100, 99, 70], "sl"), ([100, 100.1, 100.2], "tl")])
def test_triple_barrier(spark, path, kind):
    e = bars(spark, [float(x) for x in path]).withColumns({"trgt": F.when(F.col("date") == F.lit("2020-01-01"), 0.1), "side": F.lit(None).cast("double")})
    r = labels.triple_barrier(e, 5, 1.0, 1.0).collect()
    assert [x["type"] for x in r] == [kind]


def test_triple_barrier_zero_target_and_last_bar(spark):
    e = bars(spark, [100.0, 100.0]).withColumns({"trgt": F.lit(0.0), "side": F.lit(None).cast("double")})
    r = labels.triple_barrier(e, 5, 1.0, 1.0).collect()
    assert [(x["type"], x["bin"]) for x in r] == [("sl", 0)]


@pytest.mark.parametrize("f", [lambda b: transforms.impute(b, ["close"]), lambda b: transforms.standardize(b, ["close"], 3), lambda b: transforms.winsorize(b, ["close"], 0.1, 0.9, 3), price.bollinger, price.recursions, price.streaks])
def test_no_look_ahead(spark, f):
    a = [10.0, 11.0, 9.0, 12.0, 8.0, 13.0, 7.0] * 5
    b = a[:25] + [1000.0] * 10
    day = D(2020, 1, 1) + dt.timedelta(days=24)
    x, y = (f(bars(spark, c)).where(F.col("date") <= F.lit(day)).orderBy("date").collect() for c in (a, b))
    assert x == y


def test_splits_do_not_overlap(spark):
    b = labels.vertical_barriers(bars(spark, [float(i) for i in range(100)]), 5)
    j = labels.purged_splits(b, 2, 20).join(b.select("date", "t1"), "date").collect()
    for fold in (0, 1):
        test = [r["date"] for r in j if r["fold"] == fold and r["role"] == "test"]
        assert len(test) == 20 and all(r["t1"] < min(test) for r in j if r["fold"] == fold and r["role"] == "train")


def test_permuted_keeps_values(spark):
    b = bars(spark, [float(i) for i in range(30)])
    p = learning.permuted(b, ["close"], 3)
    assert sorted(column(p, "close")) == [float(i) for i in range(30)] and column(p, "close") != column(b, "close")


def test_identical_columns(spark):
    b = bars(spark, [1.0, None, 3.0])
    assert {tuple(r) for r in quality.identical_columns(b.withColumn("other", F.lit(1.0)), ["open", "close", "other"], ["ticker", "date"]).collect()} == {("open", "close")}


def test_simulation_keeps_accounts_apart(spark):
    b = bars(spark, [10.0, 20.0]).unionByName(bars(spark, [10.0, 5.0], "B")).withColumn("signal", F.lit(1.0))
    end = {r["ticker"]: r["balance"] for r in simulation.simulate(b, cash=100.0, commission=0.0).where(F.col("date") == F.lit("2020-01-02")).collect()}
    assert end == {"A": 200.0, "B": 50.0}


def test_macro_percentile(spark):
    m = spark.createDataFrame([("x", D(2020, 1, i + 1), v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0])], "region string, date date, v double")
    assert column(macro.percentile(m, "v"), "v_pctile") == [None, 0.0, 1.0, None, pytest.approx(1 / 3)]


def test_csv_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,date,open,high,low,close,volume\nA,2020-01-01,1,1,1,1,1\nA,2020-01-02,x,1,1,1,1\n")
    got = views.read_bars_csv(spark, str(tmp_path / "b.csv")).orderBy("date").collect()
    assert [r["_corrupt_record"] is None for r in got] == [True, False]


def test_write_by_suffix_and_directory(spark, tmp_path):
    b = bars(spark, [1.0, 2.0])
    views.write_by_suffix(b, str(tmp_path / "x.parquet"))
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 2
    b.toPandas().to_csv(tmp_path / "tech__AAA.csv", index=False)
    d = views.read_directory(spark, str(tmp_path / "*.csv")).select(*views.sector_and_ticker("dataset")).distinct().collect()
    assert [tuple(r) for r in d] == [("tech", "AAA")]
    with pytest.raises(ValueError):
        views.write_by_suffix(b, "x.xls")
    assert '"rows": 2' in views.manifest(b, ["x"], {"a": 1})


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,date,open,high,low,close,volume\nA,2020-01-01,1,1,1,1,1\nA,2020-01-02,x,1,1,1,1\n")
    got = [tuple(r) for r in views.read_each(spark, [str(tmp_path / "b.csv"), str(tmp_path / "none.csv")]).collect()]
    assert got[0][1:] == (2, 1, None) and got[1][1:3] == (None, None) and "none.csv" in got[1][3]


def test_backtest_chains_its_folds(spark):
    b = bars(spark, [float(100 + 10 * np.sin(i / 5)) for i in range(160)]).withColumns({"x": F.sin(F.dayofyear("date") / 5), "y": (F.dayofyear("date") % 31 < 15).cast("int")})
    r = pipelines.walk_forward_backtest(b, ["x"], 2, {"share": [0.5, 1.0], "stop": [0.05]}, cash=1000.0).orderBy("date").collect()
    folds = {k: [x for x in r if x["fold"] == k] for k in (0, 1)}
    assert all(len({x["share"] for x in f}) == 1 for f in folds.values()) and len({x["date"] for x in r}) == len(r)
    assert all(x["equity"] == x["balance"] for x in folds[0])
    assert all(x["equity"] == pytest.approx(x["balance"] * folds[0][-1]["balance"] / 1000.0) for x in folds[1])


def test_coarse_grid_and_search(spark):
    b = bars(spark, [float(i % 7) for i in range(140)]).withColumns({"y": (F.col("close") > 3).cast("int"), "three": (F.col("close") / 3).cast("int"), "n": 2 * F.col("close"), "open": F.col("close") % 3})
    g = {(r["target"], r["features"], r["model"]): r["score"] for r in learning.coarse_grid(b, ["open", "high", "close"], {"three": 3}, ["n"], 1).collect()}
    assert len(g) == 9 + 6 and g["n", "all", "linear"] == pytest.approx(1.0) and g["three", "all", "boosted"] == 1.0
    s = learning.random_search(b, ["open", "close"], 1, 1).collect()
    assert len(s) == 1 and len(json.loads(s[0]["parameters"])) == 9


def test_model_with_metadata(spark, tmp_path):
    b = bars(spark, [float(i % 7) for i in range(40)]).withColumn("y", (F.col("close") > 3).cast("int"))
    learning.save_model(learning.fit(b, ["close"], "logistic"), str(tmp_path / "m"), {"features": ["close"]})
    model, about = learning.load_model(str(tmp_path / "m"))
    assert about == {"features": ["close"]} and learning.predict(model, b).count() == 40


def test_model_saves_and_loads(spark, tmp_path):
    from pyspark.ml import PipelineModel

    b = bars(spark, [float(i % 7) for i in range(80)]).withColumn("y", (F.col("close") > 3).cast("int"))
    m = learning.fit(b, ["close", "volume"], "logistic")
    m.write().save(str(tmp_path / "m"))
    assert learning.predict(PipelineModel.load(str(tmp_path / "m")), b).where("proba is null").count() == 0
    assert learning.importances(learning.fit(b, ["close", "volume"]), ["close", "volume"])[0][0] == "close"
