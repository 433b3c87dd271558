"""Estimators from ``pyspark.ml`` on the design rows of ``gram.py``.

The feature vector is built on the JVM (``array_to_vector`` of a slice of
the design array), so fitting and scoring never leave Spark.  Out-of-fold
predictions fit one model per fold on the other folds, several at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = 1 << 21       # columns of all fits that run at a time


def assemble(rows: DataFrame, design, outcome: str | None, xi=None) -> DataFrame:
    """``(group_id, fold, features vector, label)`` from design rows."""
    xi = list(range(1, design.p + 1)) if xi is None else list(xi)
    if xi == list(range(xi[0], xi[0] + len(xi))):
        arr = F.slice("z", xi[0] + 1, len(xi))
    else:
        arr = F.array(*[F.col("z")[i] for i in xi])
    cols = ["group_id", "fold", array_to_vector(arr).alias("features")]
    if outcome is not None:
        cols.append(F.col("z")[design.index(outcome)].alias("label"))
    # iterative estimators scan their input many times: write it once
    from glossa.operators.ranks import materialize
    return materialize(rows.select(*cols))


def regressor(name: str, alpha: float = 0.01, seed: int = 42):
    """Named estimator specs (the reference's model names mapped to pyspark.ml)."""
    if name == "lasso":
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=True, maxIter=200)
    if name == "elastic_net":
        return LinearRegression(regParam=alpha, elasticNetParam=0.5, standardization=True, maxIter=200)
    if name == "gbt":
        return GBTRegressor(maxIter=30, subsamplingRate=0.7, maxDepth=5, featureSubsetStrategy="0.8",
                            minInfoGain=0.0, stepSize=0.1, seed=seed)
    if name == "forest":
        return RandomForestRegressor(numTrees=50, maxDepth=8, featureSubsetStrategy="auto", seed=seed)
    if name == "ridge_ml":
        return LinearRegression(regParam=alpha, elasticNetParam=0.0, standardization=True)
    raise ValueError(name)


def classifier(name: str = "lr", reg: float = 0.01, seed: int = 42):
    if name == "lr":
        return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=True, maxIter=50)
    if name == "svc":
        return LinearSVC(regParam=reg, maxIter=100)
    if name == "forest":
        return RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed)
    raise ValueError(name)


def fit_together(estimator, parts: list) -> list:
    """A model for each of the tables, in threads: an iterative fit waits for the driver between its short
    jobs.  The driver keeps some thirty vectors a fit, so wide fits run fewer at a time (COLUMNS).  Every step
    shuffles a gradient of all columns for each part of the table, so there are no more parts than cores; while the
    fits run, the gradients of finished steps are let go."""
    from concurrent.futures import ThreadPoolExecutor, wait

    from pyspark import inheritable_thread_target

    from glossa.session import tidy
    first = parts[0].select("features").first() if len(parts) > 1 else None
    wide = first["features"].size if first is not None else 1
    with ThreadPoolExecutor(max(1, min(len(parts), COLUMNS // max(1, wide)))) as pool:
        spark = parts[0].sparkSession
        cores = spark.sparkContext.defaultParallelism
        fit = inheritable_thread_target(spark)(lambda part: estimator.copy().fit(part.coalesce(cores)))
        running = [pool.submit(fit, part) for part in parts]
        while wait(running, timeout=5).not_done:
            tidy(spark)
        return [r.result() for r in running]


def cv_fit_predict(data: DataFrame, estimator, folds) -> DataFrame:
    """Out-of-fold predictions ``(group_id, fold, label, prediction[, probability])``."""
    out = None
    for k, model in zip(folds, fit_together(estimator, [data.where(F.col("fold") != k) for k in folds])):
        pred = model.transform(data.where(F.col("fold") == k))
        keep = ["group_id", "fold", "label", "prediction"]
        if "probability" in pred.columns:
            pred = pred.withColumn("prob1", vector_to_array("probability")[1])
            keep.append("prob1")
        pred = pred.select(*keep)
        out = pred if out is None else out.unionByName(pred)
    return out


def grid_search(data: DataFrame, reg_params=(0.001, 0.01, 0.1, 1.0), l1=(0.0, 0.5, 1.0), folds: int = 3,
                seed: int = 42):
    """3-fold grid search over (regParam, elasticNetParam); returns the best model."""
    lr = LinearRegression(standardization=True, maxIter=100)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).addGrid(lr.elasticNetParam, list(l1)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mse"),
                        numFolds=folds, seed=seed)
    return cv.fit(data)


def centered_pca(data: DataFrame, k: int):
    """PCA on centred features (``ml.PCA`` does not centre by itself)."""
    pipe = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_c", withMean=True, withStd=False),
                            PCA(k=k, inputCol="_c", outputCol="pcs")])
    return pipe.fit(data)


def pca_variance_k(explained, share: float, cap_ratio: float = 0.25, p: int | None = None) -> int:
    """First component count whose cumulative explained variance reaches ``share``,
    capped at ``cap_ratio * p``."""
    cum = np.cumsum(np.asarray(explained))
    k = int(np.searchsorted(cum, share - 1e-12) + 1)
    if p:
        k = min(k, max(1, int(cap_ratio * p)))
    return k
