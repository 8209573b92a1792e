"""Metrics, fold assignment and model comparison."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.core.columns import number, present, quoted, rows_of
from tabulant.core.lookup import attach
from tabulant.core.ordered import block_window, own_rows, positions, series_blocks, value_ranks
from tabulant.core.shuffle import row_hash
from tabulant.functions.special import t_p


def classification_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (0 for 0/0)."""
    keys = [quoted(k) for k in by]
    cells = (
        df.select(
            *keys,
            present(df, label).cast("string").alias("__y"),
            present(df, prediction).cast("string").alias("__p"),
        )
        .groupBy(*keys, "__y", "__p")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    hit = F.when(F.col("__y") == F.col("__p"), F.col("n")).otherwise(0.0)
    sides = rows_of(
        [
            F.struct(F.col("__y").alias("c"), F.col("n").alias("support"), F.lit(0.0).alias("said"), hit.alias("tp")),
            F.struct(F.col("__p").alias("c"), F.lit(0.0).alias("support"), F.col("n").alias("said"), F.lit(0.0).alias("tp")),
        ]
    )
    classes = (
        cells.select(*keys, sides)
        .groupBy(*keys, "c")
        .agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    scored = classes.select(
        *keys,
        "support",
        "tp",
        ratio(F.col("tp"), F.col("said")).alias("p"),
        ratio(F.col("tp"), F.col("support")).alias("r"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f"),
    )
    total = F.sum("support")
    return scored.groupBy(*keys).agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("p") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("r") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / total).alias("f1"),
        total.cast("long").alias("n"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of a 0/1 label; tied scores count half."""
    y = number(df, label)
    data = df.select(
        number(df, score).alias("score"), F.when(y > 0, "1").when(y.isNotNull(), "0").alias("y")
    )
    ranks = value_ranks(data, ["score"], "y")
    sides = ranks.agg(
        F.max(F.when(F.col("class") == "1", F.col("n"))).alias("n1"),
        F.max(F.when(F.col("class") == "0", F.col("n"))).alias("n0"),
        F.max(F.when(F.col("class") == "1", F.col("rank_sum"))).alias("r"),
    )
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    return sides.select(F.try_divide(u, F.col("n1") * F.col("n0")).alias("roc_auc"))


def _regression_aggregates(y, p):
    e = y - p
    return {
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": 1 - F.try_divide(F.avg(e * e), F.var_pop(F.when(p.isNotNull(), y))),
        # a zero in the data counts against the smallest positive step, as is usual
        "mape": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))),
        "n": F.count(e),
    }


def regression_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """MSE, RMSE, MAE, R squared and MAPE in one aggregate."""
    cells = _regression_aggregates(number(df, label), number(df, prediction))
    return df.groupBy(*[quoted(k) for k in by]).agg(*[c.alias(n) for n, c in cells.items()])


def series_metrics(
    df: DataFrame, series: str, order: str, label: str, prediction: str
) -> DataFrame:
    """Regression metrics per series, and MASE against the one-step naive forecast."""
    rows = df.select(
        quoted(series),
        quoted(order),
        number(df, label).alias("y"),
        number(df, prediction).alias("p"),
    ).dropna()
    placed = positions(rows, order, by=[series])
    w = block_window([series], "position")
    steps = own_rows(
        series_blocks(placed, "position", before=1).withColumn(
            "step", F.abs(F.col("y") - F.lag("y", 1).over(w))
        )
    )
    cells = _regression_aggregates(F.col("y"), F.col("p"))
    out = steps.groupBy(quoted(series)).agg(
        *[c.alias(n) for n, c in cells.items()], F.avg("step").alias("naive")
    )
    return out.withColumn("mase", F.try_divide("mae", "naive")).drop("naive")


# --- clustering -----------------------------------------------------------------------


def clustering_metrics(
    df: DataFrame, features: Sequence[str], labels: str, silhouette: bool = True
) -> DataFrame:
    """Silhouette (squared Euclidean), Calinski-Harabasz, Davies-Bouldin, cluster count.

    Fewer than two clusters give nulls. Only the cluster centres reach the driver.
    """
    p = len(features)
    x = [number(df, c).alias(f"x{i}") for i, c in enumerate(features)]
    data = df.select(present(df, labels).alias("c"), *x)
    # a condition per column: one over all columns takes the optimizer exponential time
    for c in data.columns:
        data = data.where(F.col(c).isNotNull())
    cells = [F.count(F.lit(1)).alias("n")]
    cells += [F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]
    within = sum((F.var_pop(f"x{i}") for i in range(1, p)), F.var_pop("x0"))
    stats = data.groupBy("c").agg(*cells, (within * F.count(F.lit(1))).alias("within"))
    rows = stats.collect()  # one row per cluster
    schema = (
        "silhouette double, calinski_harabasz double, davies_bouldin double, "
        "n_clusters long, n long"
    )
    k, n = len(rows), sum(r["n"] for r in rows)
    spark = df.sparkSession
    if k < 2:
        return spark.createDataFrame([(None, None, None, k, n)], schema)
    size = np.array([r["n"] for r in rows], dtype=float)
    centre = np.array([[r[f"m{i}"] for i in range(p)] for r in rows])
    inner = sum(r["within"] for r in rows)
    outer = float((size[:, None] * (centre - size @ centre / n) ** 2).sum())
    ch = (outer / (k - 1)) / (inner / (n - k)) if inner > 0 and n > k else None
    table = spark.createDataFrame(
        [(r["c"], *[float(v) for v in m]) for r, m in zip(rows, centre)],
        f"c {data.schema['c'].dataType.simpleString()}, "
        + ", ".join(f"m{i} double" for i in range(p)),
    )
    gap = sum(
        ((F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{i}") - F.col(f"m{i}")) for i in range(1, p)),
        (F.col("x0") - F.col("m0")) * (F.col("x0") - F.col("m0")),
    )
    spread = {
        r["c"]: r["s"]
        for r in attach(data, table, ["c"]).groupBy("c").agg(F.avg(F.sqrt(gap)).alias("s")).collect()
    }
    s = np.array([spread[r["c"]] for r in rows])
    worst = np.empty(k)
    for i in range(k):
        apart = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        apart[i] = np.inf
        worst[i] = ((s + s[i]) / np.where(apart > 0, apart, np.nan)).max()
    db = float(worst.mean())
    score = None
    if silhouette:
        vec = VectorAssembler(inputCols=[f"x{i}" for i in range(p)], outputCol="features")
        codes = spark.createDataFrame(
            [(r["c"], float(i)) for i, r in enumerate(rows)],
            f"c {data.schema['c'].dataType.simpleString()}, prediction double",
        )
        coded = vec.transform(attach(data, codes, ["c"]))
        score = float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(coded))
    return spark.createDataFrame(
        [(score, ch and float(ch), None if math.isnan(db) else db, k, n)], schema
    )


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.select(
            present(df, a).cast("string").alias("a"), present(df, b).cast("string").alias("b")
        )
        .dropna()
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from pair counts of their overlap."""

    def pairs(c):
        return c * (c - 1) / 2

    cells = _contingency(df, a, b)
    left = cells.groupBy("a").agg(F.sum("n").alias("s"))
    right = cells.groupBy("b").agg(F.sum("n").alias("s"))
    parts = (
        cells.agg(F.sum(pairs(F.col("n"))).alias("v"), F.sum("n").alias("n"))
        .withColumn("kind", F.lit("both"))
        .unionByName(left.agg(F.sum(pairs(F.col("s"))).alias("v"), F.sum("s").alias("n")).withColumn("kind", F.lit("a")))
        .unionByName(right.agg(F.sum(pairs(F.col("s"))).alias("v"), F.sum("s").alias("n")).withColumn("kind", F.lit("b")))
    )
    row = parts.agg(
        *[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(k) for k in ("both", "a", "b")],
        F.max("n").alias("n"),
    )
    expected = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("n")))
    top = (F.col("a") + F.col("b")) / 2
    return row.select(
        F.coalesce(
            F.try_divide(F.col("both") - expected, top - expected), F.lit(1.0)
        ).alias("adjusted_rand")
    )


def _expected_mutual_information(other: list, n: float):
    """Column expression parts: E[MI] summed over margin sizes, per row of `a` sizes."""
    b_size = np.array([s for s, _ in other])
    b_many = np.array([m for _, m in other], dtype=float)

    def run(batches):
        lg = np.vectorize(math.lgamma)
        for pdf in batches:
            total = 0.0
            for a, many in zip(pdf["s"], pdf["m"]):
                for b, times in zip(b_size, b_many):
                    low, high = max(1.0, a + b - n), min(a, b)
                    if high < low:
                        continue
                    # the hypergeometric weight is negligible far from its mean
                    mean = a * b / n
                    reach = 40 * math.sqrt(max(mean * (1 - a / n) * (1 - b / n), 1.0)) + 100
                    low, high = max(low, math.floor(mean - reach)), min(high, math.ceil(mean + reach))
                    k = np.arange(low, high + 1)
                    logp = (
                        math.lgamma(a + 1) + math.lgamma(b + 1)
                        + math.lgamma(n - a + 1) + math.lgamma(n - b + 1) - math.lgamma(n + 1)
                        - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1)
                    )
                    total += many * times * float((k / n * np.log(n * k / (a * b)) * np.exp(logp)).sum())
            yield pd.DataFrame({"e": [total]})

    return run


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted mutual information (arithmetic mean of entropies) of two labelings.

    The chance term depends only on cluster sizes, so equal sizes are merged: n rows have
    at most sqrt(2 n) different ones, and those of the labeling with fewer go to the tasks.
    """
    cells = _contingency(df, a, b)
    n = F.col("n")
    # mutual information is the entropy of both labelings less that of the pairs
    total, joint = cells.agg(F.sum(n), F.sum(n * F.ln(n))).first()

    def margin(name):
        sizes = cells.groupBy(name).agg(F.sum("n").alias("s"))
        return sizes.groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("m"))

    left, right = margin("a"), margin("b")

    def entropy(sizes):
        share = F.col("s") / F.lit(total)
        row = sizes.agg(F.sum(-F.col("m") * share * F.ln(share)), F.count(F.lit(1))).first()
        return row[0] or 0.0, row[1]

    (mine, n_left), (theirs, n_right) = entropy(left), entropy(right)
    if n_left < n_right:
        left, right = right, left
    other = [(r["s"], r["m"]) for r in right.collect()]
    pairs = math.log(total) - joint / total
    mi = mine + theirs - pairs
    emi = left.mapInPandas(_expected_mutual_information(other, total), "e double")
    chance = emi.agg(F.sum("e")).first()[0]
    mean = (mine + theirs) / 2
    gap = mean - chance
    value = 1.0 if abs(gap) < 1e-15 else (mi - chance) / gap
    return df.sparkSession.createDataFrame(
        [(float(mi), float(chance), float(value))],
        "mutual_information double, expected double, adjusted_mutual_information double",
    )


# --- folds ----------------------------------------------------------------------------


def kfold(df: DataFrame, k: int = 5, row_key: str | None = None, seed: int | None = None) -> DataFrame:
    """Add `fold` 0..k-1: the row key modulo k, or a seeded hash of it."""
    if row_key and seed is None:
        key = F.col(quoted(row_key))
    else:
        key = row_hash(df, row_key, seed or 0)
    return df.withColumn("fold", F.pmod(key, F.lit(k)).cast("int"))


def stratified_kfold(df: DataFrame, label: str, row_key: str, k: int = 5) -> DataFrame:
    """Add `fold` so that every class is spread evenly over the folds."""
    if label not in df.columns:
        raise ValueError("stratified folds need the target column")
    placed = positions(df, row_key, by=[label], name="__place")
    return placed.withColumn("fold", F.pmod("__place", F.lit(k)).cast("int")).drop("__place")


def holdout(
    df: DataFrame,
    label: str | None = None,
    row_key: str | None = None,
    share: float = 0.2,
    folds: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Add `test` (boolean): round(share x n) rows of every class, drawn by a hash of the row.

    Without `label` all rows are one class. Rows are numbered within their class in the
    order of the hash, so the count is exact however few rows a class has; with `folds`
    the other rows get `fold` 0..folds-1 in turn (null for test rows).
    """
    by = [label] if label else []
    placed = positions(df.withColumn("__draw", row_hash(df, row_key, seed)), "__draw", by=by, name="__place")
    if label:
        sizes = df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("__n"))
        placed = attach(placed, sizes.withColumn("__w", F.col("__n")), by, weight="__w")
    else:
        placed = placed.withColumn("__n", F.lit(df.count()))
    drawn = F.round(F.col("__n") * F.lit(share)).cast("long")
    out = placed.withColumn("test", F.col("__place") < drawn)
    if folds:
        turn = F.pmod(F.col("__place") - drawn, F.lit(folds)).cast("int")
        out = out.withColumn("fold", F.when(~F.col("test"), turn))
    return out.drop("__draw", "__place", "__n")


def time_series_folds(
    df: DataFrame, series: str, order: str, k: int = 5, gap: int = 0, test_size: int | None = None
) -> DataFrame:
    """(row, fold, role): the last k blocks are tests, all earlier rows train.

    A block is n // (k + 1) rows unless `test_size` is given; `gap` rows before each
    block are left out.
    """
    placed = positions(df, order, by=[series])
    sizes = df.groupBy(quoted(series)).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__w", F.col("__n"))
    size = F.lit(test_size) if test_size else F.floor(F.col("__n") / (k + 1))
    rows = attach(placed, sizes, [series], weight="__w").withColumn("__size", size)
    fold = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("__n") - (k - F.col("fold")) * F.col("__size")
    role = F.when(
        (F.col("position") >= start) & (F.col("position") < start + F.col("__size")), "test"
    ).when(F.col("position") < start - gap, "train")
    return fold.withColumn("role", role).where("role is not null").drop("__n", "__size")


# --- models across folds ------------------------------------------------------------------


def fold_metrics(
    predictions: DataFrame, label: str, prediction: str, classes: bool
) -> DataFrame:
    """Metrics per (model, fold) of a stacked prediction table."""
    fn = classification_metrics if classes else regression_metrics
    return fn(predictions, label, prediction, by=["model", "fold"])


def summarise_folds(metrics: DataFrame) -> DataFrame:
    """Mean, deviation, minimum and maximum of every metric per model."""
    names = [c for c in metrics.columns if c not in ("model", "fold", "n")]
    long = metrics.select(
        "model",
        rows_of([F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names]),
    )
    return long.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def cross_validate(
    data: DataFrame,
    estimators: Mapping[str, Estimator],
    classes: bool,
    fold: str = "fold",
    parallelism: int = 4,
    fitted_on: Mapping[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit every model on every fold; (metrics per fold, fit and predict seconds).

    `data` holds features, label and the fold column. Fits run side by side; all
    predictions are stacked and scored by one aggregate. `fitted_on` has the rows of models
    that are fitted on others than those of `data` (merged ones, with weights).
    """
    fitted_on = fitted_on or {}
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())

    def one(task):
        name, k = task
        start = time.perf_counter()
        model = estimators[name].fit(fitted_on.get(name, data).where(F.col(fold) != k))
        fitted = time.perf_counter() - start
        out = model.transform(data.where(F.col(fold) == k)).select(
            F.lit(name).alias("model"), F.lit(k).alias("fold"), "label", "prediction"
        )
        return out, (name, int(k), fitted)

    tasks = [(name, k) for name in estimators for k in folds]
    with ThreadPoolExecutor(parallelism) as pool:
        done = list(pool.map(one, tasks))
    stacked = done[0][0]
    for out, _ in done[1:]:
        stacked = stacked.unionByName(out)
    times = data.sparkSession.createDataFrame(
        [t for _, t in done], "model string, fold int, fit_seconds double"
    )
    return fold_metrics(stacked, "label", "prediction", classes), times


def compare_paired(metrics: DataFrame, first: str, second: str, metric: str) -> DataFrame:
    """Paired t on the fold scores of two models, with difference and effect size."""
    both = metrics.where(F.col("model").isin(first, second)).groupBy("fold").agg(
        F.max(F.when(F.col("model") == first, F.col(metric))).alias("a"),
        F.max(F.when(F.col("model") == second, F.col(metric))).alias("b"),
    )
    gap = F.col("a") - F.col("b")
    row = both.dropna().agg(
        F.avg("a").alias("first_mean"),
        F.avg("b").alias("second_mean"),
        F.avg(gap).alias("mean_difference"),
        F.stddev_samp(gap).alias("__s"),
        F.sqrt((F.var_pop("a") + F.var_pop("b")) / 2).alias("__pooled"),
        F.count(F.lit(1)).alias("n"),
    )
    t = F.try_divide(F.col("mean_difference") * F.sqrt(F.col("n").cast("double")), F.col("__s"))
    return row.withColumn("t_statistic", t).select(
        F.lit(metric).alias("metric"),
        F.lit(first).alias("first"),
        F.lit(second).alias("second"),
        "first_mean",
        "second_mean",
        "mean_difference",
        "t_statistic",
        t_p("t_statistic", F.col("n") - 1).alias("p_value"),
        F.coalesce(F.try_divide("mean_difference", "__pooled"), F.lit(0.0)).alias("effect_size"),
        "n",
    )
