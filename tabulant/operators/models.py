"""Models of a class or number target, and the automatic choice among them."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    Bucketizer,
    Imputer,
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.core.columns import few_values, number, numeric_columns, present, quoted, text_columns
from tabulant.core.lineage import cut_lineage
from tabulant.core.lookup import attach, sorted_codes
from tabulant.core.shuffle import dealt
from tabulant.operators import cluster
from tabulant.operators.density import dbscan
from tabulant.operators.evaluate import (
    classification_metrics,
    clustering_metrics,
    cross_validate,
    holdout,
    regression_metrics,
    series_metrics,
    summarise_folds,
)
from tabulant.operators.series import ar_forecast, forecast, seasonal_regression_forecast

CLASS_VALUES = 20

#: Above this many rows, tree models are fitted on weighted rows, equal ones brought together.
TREE_ROWS = 250_000
TREE_BINS = 32  # as many as MLlib's trees tell apart
TREES = ("forest", "boosted")

# fixed values: per task the leading metric and whether more is better
LEADING_METRIC = {
    "classification": ("accuracy", True),
    "regression": ("r2", True),
    "clustering": ("silhouette", True),
    "time_series": ("mae", False),
}


def infer_task(
    df: DataFrame, target: str | None = None, time_column: str | None = None
) -> DataFrame:
    """clustering, time_series, classification or regression, from the target.

    No target is clustering, a time column makes it a series, and text, booleans or
    fewer than 20 values make classes.
    """
    if target is None:
        return df.sparkSession.createDataFrame([("clustering",)], "task string")
    if time_column is not None:
        return df.sparkSession.createDataFrame([("time_series",)], "task string")
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return df.sparkSession.createDataFrame([("classification",)], "task string")
    y = present(df, target)
    some = few_values(df, y, CLASS_VALUES - 1)
    task = "regression" if some is None else "classification"
    return df.sparkSession.createDataFrame([(task,)], "task string")


@dataclass
class FittedModel:
    """A fitted MLlib pipeline with the names it was fitted on."""

    name: str
    pipeline: PipelineModel
    features: list[str]
    target: str
    classes: list | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `prediction` (a class value or a number) and, for classes, `probabilities`."""
        ready = _typed(df, self.features)
        out = self.pipeline.transform(ready)
        if self.classes is not None:
            labels = F.array(*[F.lit(c) for c in self.classes])
            out = out.withColumn(
                "prediction", F.element_at(labels, F.col("prediction").cast("int") + 1)
            )
        cols = [*[quoted(c) for c in df.columns], "prediction"]
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability"))
            cols.append("probabilities")
        return out.select(*cols)

    def importance(self, spark) -> DataFrame:
        """Importance per feature: tree gains, or mean |coefficient| over classes."""
        model = self.pipeline.stages[-1]
        if hasattr(model, "featureImportances"):
            values = model.featureImportances.toArray()
        elif hasattr(model, "coefficientMatrix"):
            values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(model, "coefficients"):
            values = np.abs(model.coefficients.toArray())
        elif hasattr(model, "models"):
            parts = [
                m.featureImportances.toArray()
                if hasattr(m, "featureImportances")
                else np.abs(m.coefficients.toArray())
                for m in model.models
            ]
            values = np.mean(parts, axis=0)
        else:
            raise ValueError(f"the {self.name} model has no importances")
        names = self._slots(len(values))
        return spark.createDataFrame(
            [(c, float(v)) for c, v in zip(names, values)], "feature string, score double"
        )

    def _slots(self, size: int) -> list[str]:
        if size == len(self.features):
            return self.features
        return [f"slot_{i}" for i in range(size)]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(os.path.join(path, "stages"))
        spark = self.pipeline.stages[-1]._java_obj and _session()
        meta = json.dumps(
            {"name": self.name, "features": self.features, "target": self.target, "classes": self.classes}
        )
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "names")
        )


def load_model(spark, path: str) -> FittedModel:
    meta = json.loads(spark.read.text(os.path.join(path, "names")).first()[0])
    return FittedModel(pipeline=PipelineModel.load(os.path.join(path, "stages")), **meta)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _typed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Numeric features as doubles with NaN as null, so imputing sees every hole."""
    cols = []
    for f in df.schema.fields:
        if f.name in features and isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            cols.append(number(df, f.name).alias(f.name))
        else:
            cols.append(F.col(quoted(f.name)))
    return df.select(*cols)


def feature_stages(df: DataFrame, features: Sequence[str], scale: bool = True) -> list:
    """Mean-fill, index and one-hot text, assemble and standardise, fitted with the model."""
    nums = [c for c in features if c not in text_columns(df)]
    texts = [c for c in features if c not in nums]
    stages: list = []
    vector = []
    if nums:
        stages.append(
            Imputer(strategy="mean", inputCols=nums, outputCols=[f"__f_{c}" for c in nums])
        )
        vector += [f"__f_{c}" for c in nums]
    if texts:
        stages.append(
            StringIndexer(
                inputCols=texts,
                outputCols=[f"__i_{c}" for c in texts],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(
            OneHotEncoder(
                inputCols=[f"__i_{c}" for c in texts], outputCols=[f"__h_{c}" for c in texts]
            )
        )
        vector += [f"__h_{c}" for c in texts]
    if scale:
        stages.append(VectorAssembler(inputCols=vector, outputCol="__vector"))
        stages.append(StandardScaler(inputCol="__vector", outputCol="features", withMean=True))
    else:
        stages.append(VectorAssembler(inputCols=vector, outputCol="features"))
    return stages


def with_label(df: DataFrame, target: str, classes: bool) -> tuple[DataFrame, list | None]:
    """Add `label`: the number itself, or the position of the class in sort order."""
    if not classes:
        return df.withColumn("label", number(df, target)).where("label is not null"), None
    known = df.where(present(df, target).isNotNull())
    codes = sorted_codes(known, target, "__code")
    values = [r[0] for r in codes.orderBy("__code").select(target).collect()]  # one per class
    out = attach(known, codes, [target], weight="__n", written=True)
    return out.withColumn("label", F.col("__code").cast("double")).drop("__code"), values


def _tree_inputs(wide: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """The filled numbers and the codes of text that `feature_stages` made."""
    nums = [f"__f_{c}" for c in features if f"__f_{c}" in wide.columns]
    return nums, [f"__i_{c}" for c in features if f"__i_{c}" in wide.columns]


def tree_stages(
    wide: DataFrame, features: Sequence[str], also: Sequence[str], output: str, most: int | None = None
) -> list | None:
    """Stages that give the vector of a tree model where equal rows are to be merged.

    None for tables of at most `most` rows. Numbers stay as they are if the rows then have few
    distinct combinations (with `also`); others become the positions of their 32 quantile
    bins, which are all that a tree of MLlib looks at.
    """
    most = most or TREE_ROWS
    nums, texts = _tree_inputs(wide, features)
    whole = F.xxhash64(*nums, *texts, *also)
    row = wide.agg(
        F.count(F.lit(1)), F.approx_count_distinct(whole), *[F.approx_count_distinct(c) for c in nums]
    ).first()
    if row[0] <= most:
        return None
    stages: list = []
    fine = [c for c, n in zip(nums, row[2:]) if row[1] > most // 8 and n > TREE_BINS]
    bins = {c: c.replace("__f_", "__b_", 1) for c in fine}
    if fine:
        shares = [i / TREE_BINS for i in range(1, TREE_BINS)]
        cuts = wide.approxQuantile(fine, shares, 1e-3)
        stages.append(
            Bucketizer(
                splitsArray=[[-float("inf"), *sorted(set(c)), float("inf")] for c in cuts],
                inputCols=fine,
                outputCols=list(bins.values()),
                handleInvalid="keep",
            )
        )
    cells = [bins.get(c, c) for c in nums] + [c.replace("__i_", "__h_", 1) for c in texts]
    return [*stages, VectorAssembler(inputCols=cells, outputCol=output)]


def merged_rows(
    wide: DataFrame,
    features: Sequence[str],
    also: Sequence[str],
    classes: bool,
    parts: bool,
    seed: int,
    most: int | None = None,
) -> DataFrame:
    """Equal rows as one row with a `weight`, a number as label being their mean.

    Squared error and log loss see no difference. With `parts`, for models that draw rows, a
    combination has as many rows as its share of `most` and its rows are dealt over them by
    chance, so that a draw moves no more than one `most`-th of the weight.
    """
    most = most or TREE_ROWS
    nums, texts = _tree_inputs(wide, features)
    binned = [c.replace("__f_", "__b_", 1) for c in nums]
    cells = [b if b in wide.columns else c for c, b in zip(nums, binned)]
    keys = [*cells, *texts, *also, *(["label"] if classes else [])]
    rows = wide.select(*dict.fromkeys([*keys, "label"]))
    if parts:
        counts = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
        total = counts.agg(F.sum("__n")).first()[0]
        shares = counts.select(
            *keys, "__n", F.ceil(F.col("__n") * F.lit(most) / F.lit(total)).alias("__k")
        )
        rows = attach(rows, shares, keys, weight="__n", written=True)
        rows = rows.withColumn("__k", F.floor(F.rand(seed) * F.col("__k")))
        keys = [*keys, "__k"]
    label = [] if classes else [F.avg("label").alias("label")]
    weight = F.count(F.lit(1)).cast("double").alias("weight")
    return cut_lineage(rows.groupBy(*keys).agg(*label, weight).drop("__k"))


def _fit(df, features, target, name, make, classes, scale=True, seed=0) -> FittedModel:
    features = list(features)
    labelled, values = with_label(_typed(df.select(*features, target), features), target, classes)
    labelled = labelled.persist()
    prep = Pipeline(stages=feature_stages(df, features, scale)).fit(labelled)
    wide = prep.transform(labelled)
    label = ["label"] if classes else []
    extra = tree_stages(wide, features, label, "features") if name in TREES else None
    estimator = None
    if extra:
        prep = PipelineModel([*[s for s in prep.stages if not isinstance(s, VectorAssembler)], *extra])
        merged = merged_rows(prep.transform(labelled), features, [], classes, name == "forest", seed)
        ready = dealt(extra[-1].transform(_hot(prep, merged))).select("features", "label", "weight").persist()
        estimator = _weighted(make(len(values) if values else 0, 0), "features")
    else:
        ready = wide.select("features", "label").persist()
        size = ready.first()["features"].size if name == "perceptron" else 0
        estimator = make(len(values) if values else 0, size)
    model = estimator.fit(ready)
    ready.unpersist()
    labelled.unpersist()
    return FittedModel(name, PipelineModel([*prep.stages, model]), features, target, values)


def _hot(prep: PipelineModel, merged: DataFrame) -> DataFrame:
    """Merged rows with the one-hot columns of their codes."""
    for stage in prep.stages:
        if isinstance(stage, OneHotEncoderModel):
            merged = stage.transform(merged)
    return merged


def _weighted(estimator: Estimator, column: str) -> Estimator:
    """The estimator on `column` and `weight`; a OneVsRest hands both on."""
    return estimator.copy(
        {estimator.getParam("featuresCol"): column, estimator.getParam("weightCol"): "weight"}
    )


def is_class_task(df: DataFrame, target: str) -> bool:
    return infer_task(df, target).first()["task"] == "classification"


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    trees: int = 100,
    depth: int = 8,
    seed: int = 42,
    classes: bool | None = None,
) -> FittedModel:
    """Random forest for classes or numbers."""
    classes = is_class_task(df, target) if classes is None else classes
    kind = RandomForestClassifier if classes else RandomForestRegressor
    make = lambda k, p: kind(numTrees=trees, maxDepth=depth, seed=seed)
    return _fit(df, features, target, "forest", make, classes, scale=False, seed=seed)


def fit_boosted(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    rounds: int = 100,
    depth: int = 6,
    rate: float = 0.1,
    seed: int = 42,
    classes: bool | None = None,
) -> FittedModel:
    """Gradient boosting; more than two classes are fitted one against the rest."""
    classes = is_class_task(df, target) if classes is None else classes

    def make(k, p):
        options = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
        if not classes:
            return GBTRegressor(**options)
        one = GBTClassifier(**options)
        return one if k <= 2 else OneVsRest(classifier=one)

    return _fit(df, features, target, "boosted", make, classes, scale=False, seed=seed)


def fit_linear(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    kind: str = "auto",
    iterations: int = 100,
    seed: int = 42,
    classes: bool | None = None,
) -> FittedModel:
    """logistic, linear, svm (linear kernel) or perceptron (layers 64 and 32)."""
    classes = is_class_task(df, target) if classes is None else classes
    if kind == "auto":
        kind = "logistic" if classes else "linear"

    def make(k, p):
        if kind == "logistic":
            return LogisticRegression(maxIter=iterations)
        if kind == "linear":
            return LinearRegression(maxIter=iterations)
        if kind == "svm":
            one = LinearSVC(maxIter=iterations)
            return one if k <= 2 else OneVsRest(classifier=one)
        if kind == "perceptron":
            return MultilayerPerceptronClassifier(
                layers=[p, 64, 32, k], maxIter=iterations, seed=seed
            )
        raise ValueError(f"unknown linear model: {kind}")

    return _fit(df, features, target, kind, make, classes)


@dataclass
class AutoResult:
    """Leaderboard (model, metric, train_value, test_value, cv_mean, cv_std, seconds) and models."""

    task: str
    leaderboard: DataFrame
    best_name: str
    models: dict = field(default_factory=dict)

    @property
    def best(self):
        return self.models[self.best_name]

    def predict(self, df: DataFrame) -> DataFrame:
        if self.task == "clustering":
            return self.best(df)
        return self.best.predict(df)


LEADERBOARD = (
    "model string, metric string, train_value double, test_value double, cv_mean double, "
    "cv_std double, seconds double, rank int"
)


def _ranked(spark, rows, more_is_better, tasks_metric):
    def key(r):
        v = r[3] if r[4] is None else r[4]
        return -float("inf") if v is None else (v if more_is_better else -v)

    rows = sorted(rows, key=key, reverse=True)
    out = [(*r, i + 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, LEADERBOARD), rows[0][0]


def automl(
    df: DataFrame,
    target: str | None = None,
    features: Sequence[str] | None = None,
    time_column: str | None = None,
    series: str | None = None,
    models: Sequence[str] | None = None,
    folds: int = 5,
    row_key: str | None = None,
    tuning: Mapping | None = None,
    settings: Mapping | None = None,
    seed: int = 42,
) -> AutoResult:
    """Infer the task, prepare, split 80/20, fit and compare candidates, keep the best.

    Of each class, a fifth of the rows (rounded) is held out and the others are dealt over
    the folds in turn, so rare classes are in all parts. `features` may be the feature list
    of a found hypothesis. `tuning` maps a model name to a parameter space that is searched
    on the training part first; `settings` maps a name to parameters that are set
    ({"forest": {"numTrees": 20}}, {"dbscan": {"eps": 1.0}}).
    """
    settings = {k: dict(v) for k, v in (settings or {}).items()}
    task = infer_task(df, target, time_column).first()["task"]
    features = list(
        features or [c for c in df.columns if c not in (target, time_column, series, row_key)]
    )
    if task == "clustering":
        return _auto_clusters(df, [c for c in features if c in numeric_columns(df)], models, settings, seed)
    if task == "time_series":
        return _auto_series(df, target, time_column, series, models)
    return _auto_supervised(
        df, target, features, task, models, folds, row_key, dict(tuning or {}), settings, seed
    )


def candidate_estimators(task: str, classes: int, size: int, seed: int) -> dict[str, Estimator]:
    """The models tried for a task."""
    if task == "regression":
        return {
            "linear": LinearRegression(),
            "forest": RandomForestRegressor(numTrees=100, maxDepth=8, seed=seed),
            "boosted": GBTRegressor(maxIter=100, maxDepth=6, stepSize=0.1, seed=seed),
        }
    boosted: Estimator = GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.1, seed=seed)
    svm: Estimator = LinearSVC(maxIter=100)
    if classes > 2:
        boosted, svm = OneVsRest(classifier=boosted), OneVsRest(classifier=svm)
    return {
        "logistic": LogisticRegression(),
        "forest": RandomForestClassifier(numTrees=100, maxDepth=8, seed=seed),
        "boosted": boosted,
        "svm": svm,
        "perceptron": MultilayerPerceptronClassifier(
            layers=[size, 64, 32, max(classes, 2)], maxIter=100, seed=seed
        ),
    }


def _with_settings(estimator: Estimator, params: Mapping) -> Estimator:
    """The estimator with parameters set; those of its base model where it is one per class."""
    if isinstance(estimator, OneVsRest):
        return estimator.copy({estimator.classifier: _with_settings(estimator.getClassifier(), params)})
    return estimator.copy({estimator.getParam(p): v for p, v in params.items()})


def _auto_supervised(df, target, features, task, models, folds, row_key, tuning, settings, seed):
    from tabulant.operators.tuning import tune

    classes = task == "classification"
    keep = [*features, target, *([row_key] if row_key else [])]
    labelled, values = with_label(_typed(df.select(*keep), features), target, classes)
    parts = cut_lineage(holdout(labelled, "label" if classes else None, row_key, 0.2, folds, seed))
    train, test = parts.where(~F.col("test")), parts.where("test")
    prep = Pipeline(stages=feature_stages(df, features)).fit(train)
    chosen = [k for k in candidate_estimators(task, len(values or []), 1, seed) if not models or k in models]
    label = ["label"] if classes else []
    trees = [k for k in chosen if k in TREES]
    extra = tree_stages(prep.transform(train), features, ["fold", *label], "tree_features") if trees else None
    prep = PipelineModel([*prep.stages, *(extra or [])])
    vectors = ["features", *(["tree_features"] if extra else [])]
    ready = dealt(prep.transform(train).select(*vectors, "label", "fold")).persist()
    held = prep.transform(test).select(*vectors, "label").persist()
    size = ready.first()["features"].size
    candidates = candidate_estimators(task, len(values or []), size, seed)
    candidates = {
        k: _with_settings(v, settings.get(k, {})) for k, v in candidates.items() if not models or k in models
    }
    metric, more = LEADING_METRIC[task]
    for name, space in tuning.items():
        if name in candidates:
            best = tune(ready, candidates[name], space, classes=classes, seed=seed).best_params
            candidates[name] = candidates[name].copy(
                {candidates[name].getParam(p): v for p, v in best.items()}
            )
    fitted_on = {}
    for name in trees if extra else []:
        merged = merged_rows(prep.transform(train), features, ["fold"], classes, name == "forest", seed)
        merged = extra[-1].transform(_hot(prep, merged))
        fitted_on[name] = dealt(merged.select("tree_features", "label", "fold", "weight")).persist()
        candidates[name] = _weighted(candidates[name], "tree_features")
    scores, _ = cross_validate(ready, candidates, classes, fitted_on=fitted_on)
    cv = {
        r["model"]: (r["mean"], r["std"])
        for r in summarise_folds(scores).where(F.col("metric") == metric).collect()
    }
    measure = classification_metrics if classes else regression_metrics
    rows, fitted = [], {}
    for name, est in candidates.items():
        start = time.perf_counter()
        model = est.fit(fitted_on.get(name, ready))
        train_value = measure(model.transform(ready), "label", "prediction").first()[metric]
        test_value = measure(model.transform(held), "label", "prediction").first()[metric]
        mean, std = cv.get(name, (None, None))
        rows.append((name, metric, train_value, test_value, mean, std, time.perf_counter() - start))
        fitted[name] = FittedModel(
            name, PipelineModel([*prep.stages, model]), features, target, values
        )
    for frame in (ready, held, *fitted_on.values()):
        frame.unpersist()
    board, best = _ranked(df.sparkSession, rows, more, metric)
    return AutoResult(task, board, best, fitted)


class DensityCandidate:
    """Density clusters of standardised columns; noise is a cluster of its own (-1)."""

    def __init__(self, df: DataFrame, features: Sequence[str], eps: float = 0.5, min_points: int = 5):
        self.features, self.eps, self.min_points = list(features), eps, min_points
        cells = [f(number(df, c)) for c in features for f in (F.avg, F.stddev_pop)]
        row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(cells)]).first()
        self.means = [row[2 * i] for i in range(len(features))]
        self.scales = [row[2 * i + 1] or 1.0 for i in range(len(features))]

    def label(self, df: DataFrame) -> DataFrame:
        """The rows without nulls in the features, with `cluster`."""
        names = [f"__z{i}" for i in range(len(self.features))]
        scaled = [
            ((number(df, c) - F.lit(m)) / F.lit(s)).alias(n)
            for c, n, m, s in zip(self.features, names, self.means, self.scales)
        ]
        found = dbscan(df.select("*", *scaled), names, self.eps, self.min_points)
        return found.where("cluster is not null").drop("core", *names)


def _auto_clusters(df, features, models, settings, seed):
    """K-means, a mixture and density clusters by silhouette, noise counted as one cluster."""
    data = df.select(*[quoted(c) for c in features])

    def mllib(fit, label):
        model = fit(data, features, seed=seed, **settings.get(name, {}))
        return lambda d: label(model, d, features)

    makers = {
        "kmeans": lambda: mllib(cluster.fit_kmeans, cluster.kmeans_labels),
        "mixture": lambda: mllib(cluster.fit_mixture, cluster.mixture_labels),
        "dbscan": lambda: DensityCandidate(data, features, **settings.get("dbscan", {})).label,
    }
    rows, found = [], {}
    for name, make in makers.items():
        if models and name not in models:
            continue
        start = time.perf_counter()
        found[name] = make()
        out = cut_lineage(found[name](data).select(*[quoted(c) for c in features], "cluster"))
        # one cluster for all rows has no silhouette and ranks last
        value = clustering_metrics(out, features, "cluster").first()["silhouette"]
        rows.append((name, "silhouette", value, None, value, None, time.perf_counter() - start))
    board, best = _ranked(df.sparkSession, rows, True, "silhouette")
    return AutoResult("clustering", board, best, found)


def _auto_series(df, target, time_column, series, models, hold: int = 5):
    """Hold out the last rows of every series and compare the forecasters on them."""
    from tabulant.operators.series import series_rows

    key = series or "__series"
    base = df if series else df.withColumn("__series", F.lit("all"))
    rows = series_rows(base, key, time_column, target)
    last = rows.groupBy(quoted(key)).agg(F.max("position").alias("__last"), F.count(F.lit(1)).alias("__n"))
    marked = attach(rows, last, [key], weight="__n")
    past = marked.where(F.col("position") <= F.col("__last") - hold).drop("__last", "position")
    future = marked.where(F.col("position") > F.col("__last") - hold).withColumn(
        "step", (F.col("position") - F.col("__last") + hold).cast("int")
    )
    makers = {
        "smoothing": lambda d: forecast(d, key, time_column, target, hold),
        "ar": lambda d: ar_forecast(d, key, time_column, target, hold),
        "seasonal": lambda d: seasonal_regression_forecast(d, key, time_column, target, 7, hold),
    }
    table, found = [], {}
    for name, make in makers.items():
        if models and name not in models:
            continue
        start = time.perf_counter()
        ahead = make(past).select(quoted(key), "step", "forecast")
        joined = future.join(ahead, [key, "step"])
        mae = (
            series_metrics(joined, key, time_column, target, "forecast")
            .agg(F.avg("mae").alias("mae"))
            .first()["mae"]
        )
        table.append((name, "mae", None, mae, None, None, time.perf_counter() - start))
        found[name] = make
    board, best = _ranked(df.sparkSession, table, False, "mae")
    return AutoResult("time_series", board, best, found)
