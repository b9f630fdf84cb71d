"""Model training, time-ordered evaluation, calibration and importance, on Spark ML."""

from __future__ import annotations

import json
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .labels import expanding_splits
from .quality import auc, sharpe

MODELS = {
    "forest": lambda: RandomForestClassifier(numTrees=200, maxDepth=6, seed=42, labelCol="y", featuresCol="_v"),
    "boosted": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=42, labelCol="y", featuresCol="_v"),
    "logistic": lambda: LogisticRegression(labelCol="y", featuresCol="_v", regParam=0.01),
}
REGRESSORS = {
    "linear": lambda: LinearRegression(labelCol="y", featuresCol="_v", solver="normal"),
    "forest": lambda: RandomForestRegressor(numTrees=50, maxDepth=6, seed=42, labelCol="y", featuresCol="_v"),
}
#: Sets of features: arguments of ``fit``.
SETS = {"all": {}, "best": {"select": 10}, "pca": {"components": 3}}


def fit(train: DataFrame, features: list[str], model: str | Estimator = "forest", select: int | None = None, components: int | None = None, numeric: bool = False) -> PipelineModel:
    """Imputer (medians), optionally the ``select`` best features or the first ``components`` of the standardised ones, and a model of the column ``y``.

    A model is a name of ``MODELS`` or an estimator of ``y`` by ``_v``; ``numeric`` says that ``y`` is a number and no class.
    """
    filled = [f"_i_{c}" for c in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_all" if select or components else "_v")]
    if select:
        stages.append(UnivariateFeatureSelector(featuresCol="_all", outputCol="_v", labelCol="y", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("continuous" if numeric else "categorical").setSelectionThreshold(min(select, len(features))))
    elif components:
        stages += [StandardScaler(inputCol="_all", outputCol="_s", withMean=True), PCA(k=min(components, len(features)), inputCol="_s", outputCol="_v")]
    return Pipeline(stages=[*stages, MODELS[model]() if isinstance(model, str) else model]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``proba``, the probability of class 1."""
    return model.transform(df).withColumn("proba", vector_to_array("probability")[1]).select(*df.columns, "proba")


def walk_forward(df: DataFrame, features: list[str], folds: int = 3, model: str | Estimator = "logistic", gap: int = 0, **args) -> DataFrame:
    """Out-of-sample ``proba`` of every test row, a model per expanding fold: (ticker, date, y, fold, proba)."""
    splits = expanding_splits(df, folds, gap)
    j = df.join(splits, ["ticker", "date"]).persist()
    models = [fit(j.where(f"fold = {k} and role = 'train'"), features, model, **args) for k in range(folds)]
    j.unpersist()  # what is left is one pass over the test rows
    parts = [predict(m, j.where(f"fold = {k} and role = 'test'")) for k, m in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("ticker", "date", "y", "fold", "proba")


def fold_summary(scored: DataFrame) -> DataFrame:
    """Accuracy per fold and its mean and deviation over the folds."""
    a = scored.groupBy("fold").agg(F.avg(((F.col("proba") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    s = a.agg(F.avg("accuracy").alias("mean"), F.stddev_samp("accuracy").alias("std"))
    return a.join(F.broadcast(s))


def calibrate(train: DataFrame, test: DataFrame, least: int = 50) -> DataFrame:
    """``test`` with ``calibrated``: by isotonic regression on ``train`` if it has enough positive rows, else by a logistic curve."""
    pos = train.agg(F.sum("y")).first()[0] or 0
    if pos >= least:
        m = IsotonicRegression(labelCol="y", featuresCol="proba", predictionCol="calibrated").fit(train.select(F.col("y").cast("double").alias("y"), "proba"))
        return m.transform(test)
    v = VectorAssembler(inputCols=["proba"], outputCol="_p")
    m = LogisticRegression(labelCol="y", featuresCol="_p", probabilityCol="_c", rawPredictionCol="_w", predictionCol="_k").fit(v.transform(train))
    return m.transform(v.transform(test)).withColumn("calibrated", vector_to_array("_c")[1]).drop("_p", "_c", "_w", "_k")


def permuted(df: DataFrame, columns: list[str], seed: int, key: str = "ticker") -> DataFrame:
    """The columns' rows dealt anew among the rows of a key, by a seeded hash order."""
    w = Window.partitionBy(key)
    a = df.withColumn("_n", F.row_number().over(w.orderBy("date")))
    b = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_p_{c}") for c in columns], F.row_number().over(w.orderBy(F.xxhash64("date", F.lit(seed)))).alias("_m"))
    j = a.join(b, (a[key] == b._key) & (a._n == b._m)).drop(*columns, "_key", "_n", "_m")
    return j.withColumnsRenamed({f"_p_{c}": c for c in columns}).select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """(feature, importance): how much accuracy is lost when a feature's values are dealt anew."""
    acc = F.avg(((F.col("proba") >= 0.5).cast("int") == F.col("y")).cast("double"))
    base = predict(model, df).agg(acc).first()[0]
    rows = [(f, base - predict(model, permuted(df, [f], seed)).agg(acc).first()[0]) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_target_test(df: DataFrame, features: list[str], shuffles: int = 50) -> DataFrame:
    """(seed, auc): areas under the curve with the labels dealt anew (seed >= 0), and as they are (seed -1)."""
    rows = []
    for seed in range(-1, shuffles):
        x = df if seed < 0 else permuted(df, ["y"], seed)
        a = auc(walk_forward(x, features, 2), "proba", "y").agg(F.avg("auc")).first()[0]
        rows.append((seed, a))
    return df.sparkSession.createDataFrame(rows, "seed int, auc double")


def importances(model: PipelineModel, features: list[str], top: int = 10) -> list[tuple[str, float]]:
    """The features with the largest importances of a tree model."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))[:top]


def feature_stability(df: DataFrame, features: list[str], periods: int = 3) -> DataFrame:
    """(feature, mean, cv, stable): importances of boosted trees over periods; stable with a coefficient of variation under a half."""
    splits = expanding_splits(df, periods)
    j = df.join(splits.where("role = 'test'").select("ticker", "date", "fold"), ["ticker", "date"])
    rows = [(f, v) for k in range(periods) for f, v in importances(fit(j.where(f"fold = {k}"), features, "boosted"), features, len(features))]
    r = df.sparkSession.createDataFrame(rows, "feature string, v double").groupBy("feature").agg(F.avg("v").alias("mean"), F.try_divide(F.stddev_samp("v"), F.avg("v")).alias("cv"))
    return r.withColumn("stable", F.coalesce(F.col("cv") < 0.5, F.lit(False)))


def regime_validation(scored: DataFrame, regimes: DataFrame, returns: DataFrame) -> DataFrame:
    """(regime, n, sharpe): of following the prediction, per regime."""
    j = scored.join(regimes, ["ticker", "date"]).join(returns, ["ticker", "date"])
    j = j.withColumn("_s", F.when(F.col("proba") >= 0.5, 1.0).otherwise(-1.0) * F.col("next_ret"))
    return j.groupBy("regime").agg(F.count("*").alias("n"), sharpe(j, "_s").alias("sharpe"))


#: What a search draws of boosted trees: (parameter, draw by a random generator).
DRAWS = {
    "maxIter": lambda r: r.randint(5, 20),
    "maxDepth": lambda r: r.randint(2, 5),
    "stepSize": lambda r: 10 ** r.uniform(-2, -0.5),
    "subsamplingRate": lambda r: r.uniform(0.5, 1.0),
    "minInstancesPerNode": lambda r: r.randint(1, 20),
    "minInfoGain": lambda r: 10 ** r.uniform(-6, -2),
    "maxBins": lambda r: r.choice([16, 32, 64]),
    "featureSubsetStrategy": lambda r: r.choice(["all", "sqrt", "onethird"]),
    "minWeightFractionPerNode": lambda r: r.uniform(0.0, 0.05),
}


def random_search(df: DataFrame, features: list[str], trials: int = 20, folds: int = 2, seed: int = 5) -> DataFrame:
    """(trial, parameters, features, score): seeded random parameters of boosted trees, and how many of the best features they see, by mean fold accuracy."""
    rng, rows = random.Random(seed), []
    for t in range(trials):
        drawn = {k: f(rng) for k, f in DRAWS.items()}
        n = rng.randint(min(2, len(features)), len(features))
        scored = walk_forward(df, features, folds, GBTClassifier(seed=42, labelCol="y", featuresCol="_v", **drawn), select=n)
        rows.append((t, json.dumps(drawn, sort_keys=True), n, fold_summary(scored).first()["mean"]))
    return df.sparkSession.createDataFrame(rows, "trial int, parameters string, features int, score double")


def coarse_grid(df: DataFrame, features: list[str], classes: dict[str, int], numbers: list[str], folds: int = 2) -> DataFrame:
    """(target, features, model, score) of every target, set of features and model, on expanding folds.

    ``classes`` maps columns of classes 0, 1, ... to their number, ``numbers`` are columns to regress on;
    rows without a target are left out of it. Scores are mean accuracy and mean coefficient of determination over the folds.
    """
    j = df.join(expanding_splits(df, folds), ["ticker", "date"]).persist()
    right = F.avg((F.col("prediction") == F.col("y")).cast("double"))
    explained = 1 - F.try_divide(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)), F.var_pop("y"))
    rows = []
    for target in [*classes, *numbers]:
        known = j.where(F.col(target).isNotNull()).withColumn("y", F.col(target).cast("double"))
        for name, make in (MODELS if target in classes else REGRESSORS).items():
            for kind, args in SETS.items():
                scores = []
                for k in range(folds):
                    model = make()
                    if classes.get(target, 0) > 2 and isinstance(model, GBTClassifier):  # knows two classes only
                        model = OneVsRest(classifier=model, labelCol="y", featuresCol="_v")
                    m = fit(known.where(f"fold = {k} and role = 'train'"), features, model, numeric=target in numbers, **args)
                    scores.append(m.transform(known.where(f"fold = {k} and role = 'test'")).agg(right if target in classes else explained).first()[0])
                found = [x for x in scores if x is not None]
                rows.append((target, kind, name, sum(found) / len(found) if found else None))
    j.unpersist()
    return df.sparkSession.createDataFrame(rows, "target string, features string, model string, score double")


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """The model and a JSON document about it, in a folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])


def linear(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    """``test`` with a linear model's ``prediction`` of a number."""
    v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
    m = LinearRegression(labelCol=target, featuresCol="_v", solver="normal").fit(v.transform(train.where(F.col(target).isNotNull())))
    return m.transform(v.transform(test)).drop("_v")
