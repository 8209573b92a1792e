"""Regression: least squares from one pass, forests and boosted trees from MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.core.gram import complete_rows
from tabulant.core.shuffle import row_hash
from tabulant.functions.special import f_tail, t_two_sided
from tabulant.operators.stats import linear_fit


def linear_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row per term with its p-value, and the fit as a whole beside it."""
    fit = linear_fit(df, list(features), target)

    def row(term, coef, err):
        t = float(coef / err) if err and err > 0 else None
        p = t_two_sided(t, fit.df2) if t is not None and fit.df2 > 0 else None
        return (term, float(coef), float(err), t, p)

    f = fit.f
    whole = (
        float(fit.r2),
        float(fit.adjusted),
        float(f),
        f_tail(f, fit.rank, fit.df2) if f == f else None,
        fit.rank,
        fit.n,
    )
    rows = [(*row("intercept", fit.intercept, fit.intercept_err), *whole)]
    rows += [(*row(c, b, e), *whole) for c, b, e in zip(fit.names, fit.coef, fit.std_err)]
    return df.sparkSession.createDataFrame(
        rows,
        "term string, coefficient double, std_error double, t_statistic double, "
        "p_value double, r_squared double, adj_r_squared double, f_statistic double, "
        "f_p_value double, rank int, n long",
    )


def _split_rows(df: DataFrame, features, target, row_key, folds, seed):
    keep = [row_key] if row_key and row_key not in (*features, target) else []
    data = complete_rows(df, [*features, target], keep)
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    h = row_hash(data, row_key if keep else None, seed)
    return vectors.select(
        "features",
        F.col(f"`{target}`").alias("label"),
        (F.pmod(h, F.lit(100)) < 20).alias("is_test"),
        F.pmod(F.shiftright(h, 20), F.lit(folds)).alias("fold"),
    )


def _tree_regression(df, features, target, estimator, folds, row_key, seed, kind):
    data = _split_rows(df, features, target, row_key, folds, seed).persist()
    train, test = data.where(~F.col("is_test")), data.where("is_test")

    def scores(model, rows):
        out = model.transform(rows)
        return [
            RegressionEvaluator(metricName=m).evaluate(out) for m in ("mse", "r2")
        ]

    rows = []
    per_fold = []
    for k in range(folds):
        model = estimator.fit(train.where(F.col("fold") != k))
        mse, r2 = scores(model, train.where(F.col("fold") == k))
        per_fold.append((mse, r2))
        rows += [(kind, "cv_mse", str(k), mse), (kind, "cv_r2", str(k), r2)]
    model = estimator.fit(train)
    mse, r2 = scores(model, test)
    rows += [
        (kind, "cv_mse", "mean", sum(m for m, _ in per_fold) / folds),
        (kind, "cv_r2", "mean", sum(r for _, r in per_fold) / folds),
        (kind, "test_mse", None, mse),
        (kind, "test_r2", None, r2),
    ]
    importances = model.featureImportances.toArray()
    rows += [(kind, "importance", c, float(v)) for c, v in zip(features, importances)]
    data.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "model string, measure string, item string, value double"
    )


def forest_regression(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    trees: int = 100,
    folds: int = 5,
    row_key: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Random forest: 80/20 split, CV scores on the training part, test scores, importances."""
    est = RandomForestRegressor(numTrees=trees, seed=seed, maxDepth=8)
    return _tree_regression(df, list(features), target, est, folds, row_key, seed, "forest")


def boosted_regression(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    rounds: int = 100,
    rate: float = 0.1,
    folds: int = 5,
    row_key: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """Gradient boosting with the same outputs."""
    est = GBTRegressor(maxIter=rounds, stepSize=rate, seed=seed, maxDepth=3)
    return _tree_regression(df, list(features), target, est, folds, row_key, seed, "boosted")


def regress(df: DataFrame, features: Sequence[str], target: str, kind: str = "linear", **kw):
    """Dispatch by name: linear, forest or boosted."""
    kinds = {
        "linear": linear_regression,
        "forest": forest_regression,
        "boosted": boosted_regression,
    }
    if kind not in kinds:
        raise ValueError(f"unknown regression: {kind}")
    return kinds[kind](df, features, target, **kw)
