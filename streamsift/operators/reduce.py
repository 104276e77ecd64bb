"""Feature reduction and classical classifiers on Spark ML.

Standardisation uses population statistics computed with built-in
aggregates (mean, stddev_pop per feature), like the reference; PCA,
linear SVM, MLP and cross-validated search are Spark ML estimators.
Differences that Spark ML imposes are kept explicit: the MLP has sigmoid
hidden layers and a softmax output, and the SVM regularisation is given as
regParam = 1 / (C * n).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize_fit(df: DataFrame, x: str = "x") -> DataFrame:
    """M4 fit: per feature (j) mean and population std."""
    return (df.select(F.posexplode(x).alias("j", "v")).groupBy("j")
            .agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))


def standardize_transform(df: DataFrame, stats: DataFrame, x: str = "x") -> DataFrame:
    """M4 transform: (x - mean) / std (std 0 -> 0, like scaling a constant)."""
    rows = stats.orderBy("j").collect()  # one row per feature
    mean = F.array(*[F.lit(float(r["mean"])) for r in rows])
    std = F.array(*[F.lit(float(r["std"] or 0.0)) for r in rows])
    return df.withColumn(x, F.transform(x, lambda v, i: F.when(std[i] != 0, (v - mean[i]) / std[i])
                                        .otherwise(F.lit(0.0))))


def pca_fit(df: DataFrame, k: int, x: str = "x"):
    """M5: PCA with k components; returns (model, explained variance list)."""
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(x).alias("_v")))
    return model, [float(v) for v in model.explainedVariance]


def pca_transform(model, df: DataFrame, x: str = "x", out: str = "pc") -> DataFrame:
    d = model.transform(df.withColumn("_v", array_to_vector(x)))
    return d.withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def components_for(explained: list[float], share: float) -> int:
    """Smallest number of components whose cumulative share reaches ``share``."""
    acc = 0.0
    for i, v in enumerate(explained):
        acc += v
        if acc >= share:
            return i + 1
    return len(explained)


def pca_to_share(df: DataFrame, share: float, x: str = "x"):
    """M5 with the cut at a share of the variance: (model of all components,
    number of components that reach the share)."""
    n = df.select(F.size(x).alias("n")).first()["n"]
    model, explained = pca_fit(df, n, x)
    return model, components_for(explained, share)


def covariance(df: DataFrame, x: str = "x") -> np.ndarray:
    """Covariance (n - 1) of the positions of ``x``: tasks add up centred
    products in numpy, what meets is one matrix. Less than two rows: NaN."""
    mean = np.array([r["mean"] for r in standardize_fit(df, x).orderBy("j").collect()], dtype=float)   # one row a feature
    d = len(mean)

    def run(batches):
        total, n = np.zeros((d, d)), 0
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf[x].to_numpy()).astype(np.float64) - mean
                total, n = total + m.T @ m, n + len(m)
        if n:
            yield pd.DataFrame({"i": np.arange(d * d + 1), "v": np.append(total.ravel(), n)})

    got = df.select(x).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    if not len(got) or got[-1] < 2:
        return np.full((d, d), np.nan)
    return got[:-1].reshape(d, d) / (got[-1] - 1)


def linear_svm(train: DataFrame, c: float = 1.0, x: str = "x", label: str = "label", max_iter: int = 100):
    """Hinge-loss linear classifier; regParam = 1/(C*n)."""
    n = train.count()
    svc = LinearSVC(featuresCol="_v", labelCol=label, regParam=1.0 / (c * max(n, 1)), maxIter=max_iter)
    return svc.fit(train.withColumn("_v", array_to_vector(x)))


def mlp(train: DataFrame, n_in: int, hidden: int = 8, layers: int = 1, x: str = "x", label: str = "label",
        max_iter: int = 100, seed: int = 1):
    """M9: n_in -> hidden x layers -> 2 classes."""
    est = MultilayerPerceptronClassifier(featuresCol="_v", labelCol=label, layers=[n_in] + [hidden] * layers + [2],
                                         maxIter=max_iter, seed=seed)
    return est.fit(train.withColumn("_v", array_to_vector(x)))


def predict(model, df: DataFrame, x: str = "x") -> DataFrame:
    """Apply a fitted classifier; pred as int."""
    return (model.transform(df.withColumn("_v", array_to_vector(x)))
            .withColumn("pred", F.col("prediction").cast("int"))
            .drop("_v", "rawPrediction", "probability", "prediction"))


def grid_search_svm(train: DataFrame, cs: list[float], folds: int = 2, x: str = "x", label: str = "label",
                    parallelism: int = 2, seed: int = 1):
    """K-fold search over C by accuracy, refit on all rows.  With
    folds <= 1 the single candidate is trained and scored on all rows."""
    n = max(train.count(), 1)
    d = train.withColumn("_v", array_to_vector(x))
    svc = LinearSVC(featuresCol="_v", labelCol=label)
    grid = ParamGridBuilder().addGrid(svc.regParam, [1.0 / (c * n) for c in cs]).build()
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    if folds <= 1:
        model = svc.copy(grid[0]).fit(d)
        return model, [ev.evaluate(model.transform(d))]
    cv = CrossValidator(estimator=Pipeline(stages=[svc]), estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        parallelism=parallelism, seed=seed)
    model = cv.fit(d)
    return model.bestModel.stages[0], list(model.avgMetrics)
