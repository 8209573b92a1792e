"""Bayesian estimates in closed form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tabulant.core.columns import number, present
from tabulant.core.gram import moments
from tabulant.functions.special import norm_quantile, normal_cdf
from tabulant.operators.stats import _two_classes, class_moments

INTERVAL = 0.94


class BayesianRegression:
    """Ridge regression whose two precisions maximise the evidence."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, rounds: int = 300):
        m = moments(df, [*features, target])
        self.features, self.target, self.n = list(features), target, m.n
        p = len(self.features)
        sxx, sxy, syy = m.cross[:p, :p], m.cross[:p, p], float(m.cross[p, p])
        values, vectors = np.linalg.eigh(sxx)
        values = np.maximum(values, 0)
        rotated = vectors.T @ sxy
        noise, prior = m.n / syy if syy > 0 else 1.0, 1.0
        tiny = 1e-6
        coef = np.zeros(p)
        for _ in range(rounds):
            before = coef
            coef = vectors @ (rotated / (values + prior / noise))
            miss = max(float(syy - 2 * coef @ sxy + coef @ sxx @ coef), 0.0)
            used = float((noise * values / (prior + noise * values)).sum())
            prior = (used + 2 * tiny) / (float(coef @ coef) + 2 * tiny)
            noise = (m.n - used + 2 * tiny) / (miss + 2 * tiny)
            if np.abs(before - coef).sum() < 1e-3 * 1e-3:
                break
        self.coef, self.noise, self.prior = coef, noise, prior
        self.mean, self.intercept = m.means[:p], float(m.means[p] - coef @ m.means[:p])
        self.cov = (vectors / (prior + noise * values)) @ vectors.T

    def table(self, spark) -> DataFrame:
        """(term, mean, std) of the coefficients."""
        std = np.sqrt(np.diag(self.cov))
        rows = [("intercept", self.intercept, None)]
        rows += [(f, float(c), float(s)) for f, c, s in zip(self.features, self.coef, std)]
        return spark.createDataFrame(rows, "term string, mean double, std double")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the prediction mean, std and mean +- 2 std."""
        parts = [number(df, f) * float(c) for f, c in zip(self.features, self.coef)]
        mean = sum(parts, F.lit(self.intercept))
        cov, centre, noise = self.cov, self.mean, self.noise

        @F.pandas_udf(DoubleType())
        def spread(x: pd.DataFrame) -> pd.Series:
            v = x.to_numpy(dtype="float64") - centre
            return pd.Series(np.sqrt((v @ cov * v).sum(axis=1) + 1 / noise))

        cols = F.struct(*[number(df, f).alias(f"x{i}") for i, f in enumerate(self.features)])
        out = df.select("*", mean.alias("mean"), spread(cols).alias("std"))
        return out.select(
            "*",
            (F.col("mean") - 2 * F.col("std")).alias("low"),
            (F.col("mean") + 2 * F.col("std")).alias("high"),
        )


def bayesian_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The rows with prediction mean, std and mean +- 2 std."""
    return BayesianRegression(df, features, target).predict(df)


def bayes_mean_difference(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Posterior of the standardised mean difference of two classes, prior N(0, 1).

    d = (m1 - m2) / pooled deviation has variance 1/n1 + 1/n2. The Bayes factor is
    prior over posterior density at 0.
    """
    two = _two_classes(class_moments(df, features, group), "n", "mean", "var")
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = F.try_divide((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2"), n1 + n2 - 2)
    d = F.coalesce(F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(pooled)), F.lit(0.0))
    s2 = 1 / n1 + 1 / n2
    z = norm_quantile(0.5 + INTERVAL / 2)
    base = two.select("feature", d.alias("effect"), s2.alias("s2"), (n1 + n2).cast("long").alias("n"))
    post = base.withColumn("v", 1 / (1 + 1 / F.col("s2"))).withColumn(
        "posterior_mean", F.col("effect") * F.col("v") / F.col("s2")
    ).withColumn("posterior_std", F.sqrt("v"))
    # log of prior over posterior density at 0
    log_bf = F.ln("posterior_std") + F.col("posterior_mean") * F.col("posterior_mean") / (2 * F.col("v"))
    return post.select(
        "feature",
        "effect",
        "posterior_mean",
        "posterior_std",
        (F.col("posterior_mean") - z * F.col("posterior_std")).alias("low"),
        (F.col("posterior_mean") + z * F.col("posterior_std")).alias("high"),
        normal_cdf("posterior_mean", 0.0, F.col("posterior_std")).alias("prob_positive"),
        log_bf.alias("log_bayes_factor"),
        F.exp(F.least(log_bf, F.lit(700.0))).alias("bayes_factor"),
        "n",
    )


def bayes_proportion_difference(df: DataFrame, group: str, success: str) -> DataFrame:
    """Posterior of p1 - p2 of a 0/1 column over two classes, Beta(1, 1) priors."""
    y = number(df, success)
    cells = (
        df.select(present(df, group).cast("string").alias("class"), y.alias("y"))
        .dropna()
        .groupBy("class")
        .agg(F.sum((F.col("y") > 0).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
        .withColumn("feature", F.lit(success))
    )
    two = _two_classes(cells, "s", "n")

    def beta(i):
        a = F.col(f"s{i}") + 1
        b = F.col(f"n{i}") - F.col(f"s{i}") + 1
        return a / (a + b), a * b / ((a + b) * (a + b) * (a + b + 1))

    (m1, v1), (m2, v2) = beta(1), beta(2)
    z = norm_quantile(0.5 + INTERVAL / 2)
    post = two.select(
        F.col("feature").alias("success"),
        (m1 - m2).alias("posterior_mean"),
        F.sqrt(v1 + v2).alias("posterior_std"),
        (F.col("n1") + F.col("n2")).cast("long").alias("n"),
    )
    return post.select(
        "success",
        "posterior_mean",
        "posterior_std",
        (F.col("posterior_mean") - z * F.col("posterior_std")).alias("low"),
        (F.col("posterior_mean") + z * F.col("posterior_std")).alias("high"),
        normal_cdf("posterior_mean", 0.0, F.col("posterior_std")).alias("prob_positive"),
        "n",
    )


