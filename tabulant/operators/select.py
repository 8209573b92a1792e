"""Feature scores, selection and importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.core.columns import few_values, number, numeric_columns, present, quoted, rows_of
from tabulant.core.gram import complete_rows, least_squares, merged, moments_by
from tabulant.core.shuffle import row_hash, with_block
from tabulant.functions.special import f_p
from tabulant.operators.features import quantile_edges_of, with_quantile_codes
from tabulant.operators.profile import correlation_matrix, target_correlations
from tabulant.operators.stats import anova

MI_BINS = 10


def is_class_target(df: DataFrame, target: str) -> bool:
    """Classes: text or boolean, two values, or at most ten values that are all integers."""
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return True
    y = number(df, target)
    values = few_values(df, y, 10)
    if values is None:
        return False
    return len(values) == 2 or (len(values) <= 10 and all(v == int(v) for v in values))


def select_by_correlation(
    df: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    threshold: float = 0.8,
    target_floor: float = 0.1,
) -> DataFrame:
    """Every feature with its target correlation and whether it survives.

    A column with |target r| above the floor forms a group with the earlier columns it
    is correlated with above the threshold; only the group member most correlated
    with the target stays.
    """
    columns = list(columns or numeric_columns(df, exclude=[target]))
    spark = df.sparkSession
    order = spark.createDataFrame(list(enumerate(columns)), "place int, feature string")
    strength = target_correlations(df, target, columns).select(
        "feature", F.coalesce(F.abs("r"), F.lit(0.0)).alias("strength"), "r"
    )
    named = order.join(strength, "feature")
    head = named.where(F.col("strength") > target_floor).select(
        F.col("feature").alias("a"), F.col("place").alias("a_place")
    )
    other = named.select(
        F.col("feature").alias("b"), F.col("place").alias("b_place"), F.col("strength").alias("s")
    )
    close = (
        correlation_matrix(df, columns)
        .where(F.abs("r") > threshold)
        .join(head, "a")
        .join(other, "b")
    )
    groups = close.where(F.col("b_place") < F.col("a_place")).select("a", "b", "b_place", "s")
    members = groups.unionByName(
        close.where(F.col("b_place") == F.col("a_place"))
        .select("a", "b", "b_place", "s")
        .join(groups.select("a").distinct(), "a", "left_semi")
    )
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b_place")
    dropped = (
        members.withColumn("k", F.row_number().over(best))
        .where(F.col("k") > 1)
        .select(F.col("b").alias("feature"))
        .distinct()
        .withColumn("out", F.lit(True))
    )
    return named.join(dropped, "feature", "left").select(
        "feature", "r", F.col("out").isNull().alias("selected")
    )


def mutual_information(
    df: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    bins: int = MI_BINS,
    classes: bool | None = None,
) -> DataFrame:
    """Plug-in mutual information (nats) of quantile-binned features with the target.

    A continuous target is binned the same way. All features share one shuffle of
    bin counts.
    """
    columns = list(columns or numeric_columns(df, exclude=[target]))
    classes = is_class_target(df, target) if classes is None else classes
    cut = columns if classes else [*columns, target]
    edges = quantile_edges_of(df, cut, bins)
    names = {c: f"x{i}" for i, c in enumerate(cut)}
    own = [present(df, target).cast("string").alias("y")] if classes else []
    data = df.select(*own, *[number(df, c).alias(names[c]) for c in cut])
    data = with_quantile_codes(data, {names[c]: edges[c] for c in cut})
    cells = [F.struct(F.lit(c).alias("feature"), F.col(names[c]).alias("x")) for c in columns]
    counts = (
        data.select((F.col("y") if classes else F.col(names[target])).alias("y"), rows_of(cells))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("feature", "x", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("feature"))
    nx = F.sum("n").over(Window.partitionBy("feature", "x"))
    ny = F.sum("n").over(Window.partitionBy("feature", "y"))
    return (
        counts.select("feature", "n", total.alias("t"), nx.alias("nx"), ny.alias("ny"))
        .groupBy("feature")
        .agg(
            F.sum(
                F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
            ).alias("score")
        )
    )


def f_regression(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """F = r^2 / (1 - r^2) (n - 2) and its p-value per feature."""
    columns = list(columns or numeric_columns(df, exclude=[target]))
    y = number(df, target)
    cells = []
    for i, c in enumerate(columns):
        x = number(df, c)
        cells += [F.corr(x, y).alias(f"r{i}"), F.count(F.when(y.isNotNull(), x)).alias(f"n{i}")]
    long = df.agg(*cells).select(
        rows_of(
            [
                F.struct(
                    F.lit(c).alias("feature"),
                    F.nanvl(F.col(f"r{i}"), F.lit(None)).alias("r"),
                    (F.col(f"n{i}") - 2).cast("double").alias("df2"),
                )
                for i, c in enumerate(columns)
            ]
        )
    )
    r2 = F.col("r") * F.col("r")
    return long.withColumn("score", F.try_divide(r2, 1 - r2) * F.col("df2")).select(
        "feature", "score", "df2", f_p("score", F.lit(1.0), "df2").alias("p_value")
    )


def f_classif(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One-way F of each feature over the target classes."""
    columns = list(columns or numeric_columns(df, exclude=[target]))
    return anova(df, columns, target).select(
        "feature", F.col("statistic").alias("score"), "df1", "df2", "p_value"
    )


def univariate_scores(df: DataFrame, target: str, columns: Sequence[str] | None = None):
    """f_classif or f_regression, whichever fits the target."""
    if is_class_target(df, target):
        return f_classif(df, target, columns).select("feature", "score", "p_value")
    return f_regression(df, target, columns).select("feature", "score", "p_value")


def _elimination_order(m, features, target):
    """Features from weakest to strongest by standardised coefficient, refitted each step."""
    left, order = list(features), []
    while left:
        fit = least_squares(m, left, target)
        at = m.at(left)
        size = np.abs(fit.coef) * np.sqrt(np.diag(m.cross)[at])
        worst = left[int(np.argmin(size))]
        order.append(worst)
        left.remove(worst)
    return order


def recursive_elimination(
    df: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    k: int | None = None,
    folds: int = 5,
    estimator: str = "linear",
    row_key: str | None = None,
    seed: int = 42,
    trees: int = 20,
) -> DataFrame:
    """Ranking by repeated removal of the weakest feature; 1 means kept.

    Without `k` the number kept is the one with the best cross-validated R squared.
    The linear case reads the rows once (one moment table per fold).
    """
    columns = list(columns or numeric_columns(df, exclude=[target]))
    if estimator == "forest":
        kept_order = _forest_elimination(df, target, columns, k or max(1, len(columns) // 2), trees, seed)
        k = k or max(1, len(columns) // 2)
    else:
        fold = F.pmod(row_hash(df, row_key, seed), F.lit(folds))
        data = df.select(
            *[number(df, c).alias(c) for c in [*columns, target]], fold.alias("__fold")
        )
        per_fold = moments_by(data, [*columns, target], "__fold")
        whole = merged(list(per_fold.values()))
        order = _elimination_order(whole, columns, target)
        if k is None:
            k = _best_size(per_fold, columns, target)
        kept_order = order
    removed = kept_order[: len(columns) - k]
    rank = {c: len(removed) - i + 1 for i, c in enumerate(removed)}
    rows = [(c, rank.get(c, 1), rank.get(c, 1) == 1) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")


def _best_size(per_fold, columns, target) -> int:
    """Feature count with the least held-out squared error, from fold moments alone."""
    errors = np.zeros(len(columns) + 1)
    for f, held in per_fold.items():
        rest = merged([m for g, m in per_fold.items() if g != f])
        order = _elimination_order(rest, columns, target)
        for size in range(1, len(columns) + 1):
            left = order[len(columns) - size :]
            fit = least_squares(rest, left, target)
            at, t = held.at(left), held.names.index(target)
            bias = held.means[t] - fit.intercept - fit.coef @ held.means[at]
            errors[size] += (
                held.cross[t, t]
                - 2 * fit.coef @ held.cross[at, t]
                + fit.coef @ held.cross[np.ix_(at, at)] @ fit.coef
                + held.n * bias**2
            )
    return int(np.argmin(errors[1:])) + 1


def _labelled_vectors(df: DataFrame, columns: Sequence[str], target: str, classes: bool):
    """(features vector, label) rows; classes are numbered in sorted order."""
    if classes:
        from tabulant.operators.stats import labelled_rows

        data, _ = labelled_rows(df, columns, target)
        data = data.withColumn("label", F.col("__label").cast("double"))
    else:
        data = complete_rows(df, [*columns, target]).withColumn("label", F.col(quoted(target)))
    out = VectorAssembler(inputCols=list(columns), outputCol="features").transform(data)
    return out.select("features", "label")


def _forest(classes: bool, trees: int, seed: int):
    kind = RandomForestClassifier if classes else RandomForestRegressor
    return kind(numTrees=trees, seed=seed, maxDepth=8)


def _forest_elimination(df, target, columns, k, trees, seed):
    classes = is_class_target(df, target)
    data = _labelled_vectors(df, columns, target, classes).persist()
    left, order = list(range(len(columns))), []
    wide = data.withColumn("values", vector_to_array("features"))
    while len(left) > k:
        some = wide.select("label", *[F.col("values")[i].alias(f"x{i}") for i in left])
        vec = VectorAssembler(inputCols=[f"x{i}" for i in left], outputCol="features")
        model = _forest(classes, trees, seed).fit(vec.transform(some))
        worst = left[int(np.argmin(model.featureImportances.toArray()))]
        order.append(columns[worst])
        left.remove(worst)
    data.unpersist()
    return order + [columns[i] for i in left]


def tree_importance(
    df: DataFrame,
    target: str,
    columns: Sequence[str] | None = None,
    k: int | None = 10,
    trees: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Random-forest importance per feature and whether it is among the top k."""
    columns = list(columns or numeric_columns(df, exclude=[target]))
    classes = is_class_target(df, target)
    data = _labelled_vectors(df, columns, target, classes).persist()
    values = _forest(classes, trees, seed).fit(data).featureImportances.toArray()
    data.unpersist()
    scores = df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, values)], "feature string, score double"
    )
    return scores if k is None else top_scores(scores, k=k)


def top_scores(
    scores: DataFrame,
    k: int | None = None,
    percentile: float | None = None,
    fraction: float | None = None,
) -> DataFrame:
    """Rank a (feature, score) table and mark the top k, percentile or fraction.

    The default is k = min(10, features). Ties go by name; at least one is selected
    by a fraction.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("score"), "feature")
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    if percentile is not None:
        limit = F.greatest(F.floor(total * (percentile / 100)), F.lit(1))
    elif fraction is not None:
        limit = F.greatest(F.floor(total * fraction), F.lit(1))
    else:
        limit = F.lit(10 if k is None else k)
    return scores.withColumn("rank", F.row_number().over(order)).withColumn(
        "selected", F.col("rank") <= limit
    )


def select_features(
    df: DataFrame,
    target: str,
    method: str = "mutual_info",
    columns: Sequence[str] | None = None,
    k: int | None = None,
    percentile: float | None = None,
    fraction: float | None = None,
    **options,
) -> DataFrame:
    """One entry to every selector, with one set of keywords: (feature, score, selected)."""
    columns = list(columns or numeric_columns(df, exclude=[target]))
    if method == "correlation":
        out = select_by_correlation(df, target, columns, **options)
        return out.select("feature", F.abs("r").alias("score"), "selected")
    if method == "rfe":
        out = recursive_elimination(df, target, columns, k, **options)
        return out.select("feature", (F.lit(1.0) / F.col("ranking")).alias("score"), "selected")
    scorers = {
        "mutual_info": mutual_information,
        "univariate": univariate_scores,
        "importance": lambda d, t, c, **o: tree_importance(d, t, c, k=None, **o),
    }
    if method not in scorers:
        raise ValueError(f"unknown selection method: {method}")
    scores = scorers[method](df, target, columns, **options).select("feature", "score")
    return top_scores(scores, k, percentile, fraction).select("feature", "score", "selected")


def permutation_importance(
    model,
    df: DataFrame,
    features: Sequence[str],
    target: str,
    row_key: str | None = None,
    repeats: int = 5,
    classes: bool | None = None,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the score drop when one feature is shuffled.

    `model` is fitted on a vector column of `features` in their order. Shuffled copies
    of every feature and repeat are made in one pass and scored by one transform; the
    score is accuracy for classes and R squared otherwise.
    """
    features = list(features)
    classes = is_class_target(df, target) if classes is None else classes
    if classes:
        from tabulant.operators.stats import labelled_rows

        keep = df.select(*features, target)
        data, _ = labelled_rows(keep, features, target)
        data = data.withColumnRenamed("__label", "label")
        key = None
    else:
        data = complete_rows(df, [*features, target], [row_key] if row_key else [])
        data = data.withColumnRenamed(target, "label")
        key = row_key
    blocked = with_block(data, key, seed)

    def copies(pos: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__hash", kind="stable").reset_index(drop=True)
        x = pdf[features].to_numpy(dtype="float64")
        y = pdf["label"].to_numpy(dtype="float64")
        parts = [pd.DataFrame(x, columns=features).assign(label=y, item=-1, turn=0)]
        rng = np.random.default_rng([seed, int(pos[0])])
        for i in range(len(features)):
            for r in range(repeats):
                moved = x.copy()
                moved[:, i] = x[rng.permutation(len(x)), i]
                parts.append(pd.DataFrame(moved, columns=features).assign(label=y, item=i, turn=r))
        return pd.concat(parts, ignore_index=True)

    schema = ", ".join(f"`{c}` double" for c in features) + ", label double, item int, turn int"
    many = blocked.groupBy("__block").applyInPandas(copies, schema)
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(many)
    scored = model.transform(vectors).select("item", "turn", "label", "prediction")
    if classes:
        score = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    else:
        gap = F.col("label") - F.col("prediction")
        score = 1 - F.try_divide(F.sum(gap * gap), F.var_pop("label") * F.count(F.lit(1)))
    scores = scored.groupBy("item", "turn").agg(score.alias("score"))
    base = F.max(F.when(F.col("item") == -1, F.col("score"))).over(Window.partitionBy(F.lit(0)))
    names = F.array(*[F.lit(c) for c in features])
    return (
        scores.withColumn("drop", base - F.col("score"))
        .where(F.col("item") >= 0)
        .groupBy("item")
        .agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std"))
        .select(F.element_at(names, F.col("item") + 1).alias("feature"), "importance", "importance_std")
    )


def coefficient_importance(spark, model, features: Sequence[str]) -> DataFrame:
    """|coefficient| per feature of a linear model, averaged over classes."""
    if hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        raise ValueError("the model has no coefficients")
    return spark.createDataFrame(
        [(c, float(v)) for c, v in zip(features, values)], "feature string, score double"
    )


def linear_shap(df: DataFrame, coefficients: Mapping[str, float]) -> DataFrame:
    """Mean |coef (x - mean x)| per feature: the exact SHAP value of a linear model."""
    names = list(coefficients)
    means = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    row = df.agg(
        *[
            F.avg(F.abs((number(df, c) - F.lit(means[f"m{i}"])) * float(coefficients[c]))).alias(f"s{i}")
            for i, c in enumerate(names)
        ]
    )
    return row.select(
        rows_of(
            [
                F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("score"))
                for i, c in enumerate(names)
            ]
        )
    )


def consensus_ranking(rankings: Mapping[str, DataFrame]) -> DataFrame:
    """Sum over methods of (list length - position), best first.

    Each method gives a (feature, score) table.
    """
    tables = [
        t.select(F.lit(m).alias("method"), "feature", "score") for m, t in rankings.items()
    ]
    stacked = reduce(DataFrame.unionByName, tables)
    order = Window.partitionBy("method").orderBy(F.desc_nulls_last("score"), "feature")
    size = F.count(F.lit(1)).over(Window.partitionBy("method"))
    return (
        stacked.withColumn("points", size - F.row_number().over(order) + 1)
        .groupBy("feature")
        .agg(F.sum("points").alias("consensus_score"), F.count(F.lit(1)).alias("methods"))
    )
