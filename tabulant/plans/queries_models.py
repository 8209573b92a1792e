"""Queries for models, evaluation, tuning and Bayesian estimates."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabulant.operators import bayes, cluster, density, evaluate, models, tuning
from tabulant.plans.registry import query, rounded, table

WIDTH = 64
DIMS = [f"e{i}" for i in range(WIDTH)]
FIRST = DIMS[:4]


def vectors(spark, sf, dims=WIDTH):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)],
    )


VEC = "v AS (SELECT vec_id, label, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(len(FIRST))
) + " FROM embeddings)"


def order_rows(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "o_totalprice",
        F.year("o_orderdate").cast("double").alias("year"),
        F.month("o_orderdate").cast("double").alias("month"),
    )


# --- models ---------------------------------------------------------------------------


@query("fit_forest")
def q_forest(spark, sf):
    df = order_rows(spark, sf)
    model = models.fit_forest(df, ["o_totalprice", "year", "month"], "o_orderstatus", trees=10, depth=5)
    return model.importance(spark)


@query("fit_boosted")
def q_boosted(spark, sf):
    df = order_rows(spark, sf)
    model = models.fit_boosted(df, ["year", "month"], "o_totalprice", rounds=5, depth=3)
    return model.predict(df).agg(F.avg("prediction").alias("mean_prediction"), F.count("*").alias("n"))


@query("fit_linear")
def q_linear(spark, sf):
    df = order_rows(spark, sf)
    model = models.fit_linear(df, ["o_totalprice", "year", "o_orderpriority"], "o_orderstatus")
    return evaluate.classification_metrics(model.predict(df), "o_orderstatus", "prediction")


@query("fit_svm")
def q_svm(spark, sf):
    df = table(spark, sf, "lineitem")
    model = models.fit_linear(df, ["l_quantity", "l_tax"], "l_linestatus", "svm", iterations=5)
    return evaluate.classification_metrics(model.predict(df), "l_linestatus", "prediction")


@query("fit_perceptron")
def q_perceptron(spark, sf):
    df = vectors(spark, sf)
    model = models.fit_linear(df, DIMS, "label", "perceptron", iterations=10, classes=True)
    return evaluate.classification_metrics(model.predict(df), "label", "prediction")


EPS = 1.2
NEAR = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON list_distance(a.e, b.e) <= %s),
  c AS (SELECT a FROM p GROUP BY 1 HAVING count(*) >= 5)""" % EPS


@query("dbscan_core", f"{NEAR} SELECT vec_id, vec_id IN (FROM c) AS core FROM v")
def q_dbscan_core(spark, sf):
    return density.dbscan_core(vectors(spark, sf), DIMS, EPS, 5).select("vec_id", "core")


@query(
    "dbscan",
    f"""{NEAR},
    k AS (SELECT a, b FROM p WHERE a IN (FROM c) AND b IN (FROM c)),
    w AS (SELECT a AS root, a AS node FROM c UNION SELECT w.root, k.b FROM w JOIN k ON k.a = w.node),
    l AS (SELECT node, min(root) AS label FROM w GROUP BY 1),
    t AS (SELECT label, count(*) AS core_points FROM l GROUP BY 1)
    SELECT core_points, count(*) AS clusters FROM t GROUP BY 1
    UNION ALL SELECT -1, count(*) FROM v WHERE vec_id NOT IN
      (SELECT b FROM p WHERE a IN (FROM c))""",
)
def q_dbscan(spark, sf):
    out = density.dbscan(vectors(spark, sf), DIMS, EPS, 5)
    sizes = out.where("core").groupBy("cluster").agg(F.count("*").alias("core_points"))
    noise = out.where("cluster = -1").agg(F.count("*").alias("clusters"))
    return (
        sizes.groupBy("core_points")
        .agg(F.count("*").alias("clusters"))
        .unionByName(noise.select(F.lit(-1).cast("long").alias("core_points"), "clusters"))
    )


@query("kmeans")
def q_kmeans(spark, sf):
    df = vectors(spark, sf)
    return cluster.kmeans_centres(spark, cluster.fit_kmeans(df, DIMS), DIMS)


@query("kmeans_labels")
def q_kmeans_labels(spark, sf):
    df = vectors(spark, sf)
    return cluster.kmeans_labels(cluster.fit_kmeans(df, DIMS), df, DIMS).select("vec_id", "cluster")


@query("gaussian_mixture")
def q_mixture(spark, sf):
    df = vectors(spark, sf)
    model = cluster.fit_mixture(df, DIMS)
    return cluster.mixture_labels(model, df, DIMS).groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg(F.array_max("probabilities")).alias("sureness")
    )


@query("pca")
def q_pca(spark, sf):
    return cluster.fit_pca(vectors(spark, sf), DIMS, k=2).table(spark).drop("weights")


@query(
    "pca_variance",
    f"""WITH {VEC} SELECT round(sum(x), 8) AS total_variance FROM (SELECT unnest([var_samp(e0),
      var_samp(e1), var_samp(e2), var_samp(e3)]) AS x FROM v)""",
)
def q_pca_variance(spark, sf):
    df = vectors(spark, sf)
    model = cluster.fit_pca(df, FIRST, scale=False)
    out = model.transform(df)
    return rounded(
        out.agg(*[F.var_samp(f"pc_{i}").alias(f"v{i}") for i in range(len(FIRST))]).select(
            (F.col("v0") + F.col("v1") + F.col("v2") + F.col("v3")).alias("total_variance")
        ),
        8,
    )


@query(
    "pca_inverse",
    f"WITH {VEC} SELECT vec_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FIRST) + " FROM v",
)
def q_pca_inverse(spark, sf):
    df = vectors(spark, sf)
    model = cluster.fit_pca(df, FIRST)
    return rounded(model.inverse(model.transform(df)).select("vec_id", *FIRST), 6)


@query(
    "infer_task",
    """SELECT 'none' AS target, 'clustering' AS task FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'o_totalprice', CASE WHEN count(DISTINCT o_totalprice) < 20
      THEN 'classification' ELSE 'regression' END FROM orders
    UNION ALL SELECT 'o_orderstatus', 'classification' FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'year', CASE WHEN count(DISTINCT year(o_orderdate)) < 20
      THEN 'classification' ELSE 'regression' END FROM orders""",
)
def q_infer(spark, sf):
    df = order_rows(spark, sf)
    out = models.infer_task(df).withColumn("target", F.lit("none"))
    for t in ["o_totalprice", "o_orderstatus", "year"]:
        out = out.unionByName(models.infer_task(df, t).withColumn("target", F.lit(t)))
    return out


@query("automl_classification")
def q_automl_classes(spark, sf):
    df = order_rows(spark, sf).drop("o_orderpriority")
    out = models.automl(
        df, "o_orderstatus", row_key="o_orderkey", models=["logistic", "forest", "perceptron"]
    )
    return out.leaderboard.drop("seconds")


@query("automl_regression")
def q_automl_numbers(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    out = models.automl(
        df, "p_retailprice", row_key="p_partkey", models=["linear", "forest"]
    )
    return out.leaderboard.drop("seconds")


@query("automl_clustering")
def q_automl_clusters(spark, sf):
    df = vectors(spark, sf).select(*DIMS)
    # standardised columns of 64 dimensions lie about 11 apart
    return models.automl(df, settings={"dbscan": {"eps": 8.5}}).leaderboard.drop("seconds")


@query("automl_series")
def q_automl_series(spark, sf):
    day = F.date_trunc("day", F.col("ts")).alias("day")
    df = table(spark, sf, "events").groupBy("event_type", day).agg(F.sum("value").alias("v"))
    return models.automl(df, "v", time_column="day", series="event_type").leaderboard.drop("seconds")


# --- evaluation -------------------------------------------------------------------------


def guesses(spark, sf):
    """A rule that predicts the line status, with a score, a fold and a second rule."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"),
        (F.col("l_linestatus") == "O").cast("int").alias("y"),
        (F.col("l_quantity") > 20).cast("int").alias("p"),
        (F.col("l_tax") > 0.03).cast("int").alias("p2"),
        "l_quantity",
        "l_returnflag",
    )


GUESS = """g AS (SELECT l_orderkey * 10 + l_linenumber AS row_key,
    CAST(l_linestatus = 'O' AS INT) AS y, CAST(l_quantity > 20 AS INT) AS p,
    CAST(l_tax > 0.03 AS INT) AS p2, l_quantity, l_returnflag FROM lineitem)"""


def _class_sql(pred="p", where="", prefix=""):
    return f"""SELECT {prefix} round(avg(CAST(y = {pred} AS DOUBLE)), 6) AS accuracy,
      round((sum(y) * p1 + (n - sum(y)) * p0) / n, 6) AS precision,
      round(avg(CAST(y = {pred} AS DOUBLE)), 6) AS recall,
      round((sum(y) * 2 * p1 * r1 / (p1 + r1) + (n - sum(y)) * 2 * p0 * r0 / (p0 + r0)) / n, 6) AS f1,
      n FROM g, (SELECT count(*) AS n,
        sum(CAST(y = 1 AND {pred} = 1 AS DOUBLE)) / sum({pred}) AS p1,
        sum(CAST(y = 0 AND {pred} = 0 AS DOUBLE)) / sum(1 - {pred}) AS p0,
        sum(CAST(y = 1 AND {pred} = 1 AS DOUBLE)) / sum(y) AS r1,
        sum(CAST(y = 0 AND {pred} = 0 AS DOUBLE)) / sum(1 - y) AS r0 FROM g {where}) {where}
      GROUP BY n, p1, p0, r1, r0"""


@query("classification_metrics", f"WITH {GUESS} {_class_sql()}")
def q_class_metrics(spark, sf):
    return rounded(evaluate.classification_metrics(guesses(spark, sf), "y", "p"), 6)


@query(
    "roc_auc",
    f"""WITH {GUESS}, r AS (SELECT y, count(*) OVER (ORDER BY l_quantity)
        - (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM g)
    SELECT round((sum(r) FILTER (y = 1) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS roc_auc FROM r,
      (SELECT sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM g) GROUP BY n1, n0""",
)
def q_auc(spark, sf):
    return rounded(evaluate.roc_auc(guesses(spark, sf), "y", "l_quantity"), 6)


REG = """round(avg((y - p) ** 2), 4) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
    round(avg(abs(y - p)), 4) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2,
    round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, count(*) AS n"""


def _reg_rounded(df):
    return rounded(df, 6).withColumns({c: F.round(c, 4) for c in ("mse", "rmse", "mae")})


@query(
    "regression_metrics",
    f"""SELECT {REG} FROM (SELECT p_retailprice AS y, 905 + 1.8 * p_size AS p FROM part)""",
)
def q_reg_metrics(spark, sf):
    df = table(spark, sf, "part").select(
        F.col("p_retailprice").alias("y"), (905 + 1.8 * F.col("p_size")).alias("p")
    )
    return _reg_rounded(evaluate.regression_metrics(df, "y", "p"))


@query(
    "series_metrics",
    f"""WITH e AS (SELECT event_type, date_trunc('day', ts) AS day, round(sum(value), 2) AS y
        FROM events GROUP BY 1, 2),
    p AS (SELECT *, 3000.0::DOUBLE AS p, abs(y - lag(y) OVER (PARTITION BY event_type ORDER BY day)) AS s FROM e)
    SELECT event_type, {REG}, round(avg(abs(y - p)) / avg(s), 6) AS mase FROM p GROUP BY 1""",
)
def q_series_metrics(spark, sf):
    day = F.date_trunc("day", F.col("ts")).alias("day")
    df = table(spark, sf, "events").groupBy("event_type", day).agg(
        F.round(F.sum("value"), 2).alias("y")
    )
    df = df.withColumn("p", F.lit(3000.0))
    return _reg_rounded(evaluate.series_metrics(df, "event_type", "day", "y", "p"))


@query(
    "clustering_metrics",
    f"""WITH {VEC}, c AS (SELECT label, count(*)::DOUBLE AS n, """
    + ", ".join(f"avg({d}) AS m{i}" for i, d in enumerate(FIRST))
    + " FROM v GROUP BY 1), g AS (SELECT "
    + ", ".join(f"avg({d}) AS g{i}" for i, d in enumerate(FIRST))
    + ", count(*)::DOUBLE AS n FROM v), w AS (SELECT label, avg(sqrt(d2)) AS s, sum(d2) AS ss FROM (SELECT label, "
    + " + ".join(f"({d} - m{i}) ** 2" for i, d in enumerate(FIRST))
    + " AS d2 FROM v JOIN c USING (label)) GROUP BY 1), b AS (SELECT sum(c.n * ("
    + " + ".join(f"(m{i} - g{i}) ** 2" for i in range(len(FIRST)))
    + ")) AS b, count(*) AS k, any_value(g.n) AS n FROM c, g), r AS (SELECT x.label, max((wx.s + wy.s) / sqrt("
    + " + ".join(f"(x.m{i} - y.m{i}) ** 2" for i in range(len(FIRST)))
    + """)) AS r FROM c x JOIN c y ON x.label <> y.label JOIN w wx ON wx.label = x.label
      JOIN w wy ON wy.label = y.label GROUP BY 1)
    SELECT round((b / (k - 1)) / ((SELECT sum(ss) FROM w) / (n - k)), 6) AS calinski_harabasz,
      round((SELECT avg(r) FROM r), 6) AS davies_bouldin, k AS n_clusters, CAST(n AS BIGINT) AS n FROM b""",
)
def q_cluster_metrics(spark, sf):
    out = evaluate.clustering_metrics(vectors(spark, sf), FIRST, "label", silhouette=False)
    return rounded(out.drop("silhouette"), 6)


@query(
    "silhouette",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    d AS (SELECT a.vec_id, a.label = b.label AS own, b.label, avg(list_distance(a.e, b.e) ** 2) AS m
      FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, min(m) FILTER (own) AS a, min(m) FILTER (NOT own) AS b FROM d GROUP BY 1)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette,
      (SELECT count(DISTINCT label) FROM v) AS n_clusters FROM s""",
)
def q_silhouette(spark, sf):
    out = evaluate.clustering_metrics(vectors(spark, sf), DIMS, "label")
    return rounded(out.select("silhouette", "n_clusters"), 6)


@query(
    "adjusted_rand",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
    x AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS n FROM c),
    a AS (SELECT sum(s * (s - 1) / 2) AS v FROM (SELECT sum(n) AS s FROM c GROUP BY a)),
    b AS (SELECT sum(s * (s - 1) / 2) AS v FROM (SELECT sum(n) AS s FROM c GROUP BY b))
    SELECT round((x.v - a.v * b.v / (n * (n - 1) / 2)) / ((a.v + b.v) / 2 - a.v * b.v / (n * (n - 1) / 2)), 6) + 0.0
      AS adjusted_rand FROM x, a, b""",
)
def q_rand(spark, sf):
    return rounded(
        evaluate.adjusted_rand(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), 6
    )


@query(
    "adjusted_mutual_information",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
    t AS (SELECT sum(n) AS n FROM c), x AS (SELECT a, sum(n) AS s FROM c GROUP BY 1),
    y AS (SELECT b, sum(n) AS s FROM c GROUP BY 1),
    mi AS (SELECT sum(c.n / t.n * ln(t.n * c.n / (x.s * y.s))) AS v FROM c, t, x, y WHERE c.a = x.a AND c.b = y.b),
    h AS (SELECT ((SELECT sum(-s / n * ln(s / n)) FROM x, t) + (SELECT sum(-s / n * ln(s / n)) FROM y, t)) / 2 AS v),
    k AS (SELECT x.s AS a, y.s AS b, t.n,
        unnest(range(greatest(1, x.s + y.s - t.n)::BIGINT, least(x.s, y.s)::BIGINT + 1))::DOUBLE AS k FROM x, y, t),
    e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1)
        + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1)
        - lgamma(n - a - b + k + 1))) AS v FROM k)
    SELECT round(mi.v, 10) AS mutual_information, round(e.v, 10) AS expected,
      round((mi.v - e.v) / (h.v - e.v), 8) + 0.0 AS adjusted_mutual_information FROM mi, h, e""",
)
def q_ami(spark, sf):
    out = evaluate.adjusted_mutual_information(
        table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"
    )
    return out.select(
        F.round("mutual_information", 10).alias("mutual_information"),
        F.round("expected", 10).alias("expected"),
        (F.round("adjusted_mutual_information", 8) + 0.0).alias("adjusted_mutual_information"),
    )


@query("kfold", "SELECT o_orderkey, o_orderkey % 5 AS fold FROM orders")
def q_kfold(spark, sf):
    return rounded(evaluate.kfold(table(spark, sf, "orders").select("o_orderkey"), 5, "o_orderkey"))


@query(
    "stratified_kfold",
    """SELECT o_orderkey, o_orderstatus,
      (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS fold FROM orders""",
)
def q_stratified(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rounded(evaluate.stratified_kfold(df, "o_orderstatus", "o_orderkey"))


@query(
    "time_series_folds",
    """WITH p AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type
        ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    f AS (SELECT *, unnest([0, 1, 2]) AS fold FROM p),
    s AS (SELECT *, n - (3 - fold) * (n // 4) AS start FROM f),
    r AS (SELECT *, CASE WHEN pos >= start AND pos < start + n // 4 THEN 'test'
          WHEN pos < start - 2 THEN 'train' END AS role FROM s)
    SELECT event_type, event_id, pos AS position, CAST(fold AS BIGINT) AS fold, role FROM r
    WHERE role IS NOT NULL""",
)
def q_time_folds(spark, sf):
    df = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return rounded(evaluate.time_series_folds(df, "event_type", "ts", 3, gap=2).drop("ts"))


FOLD_METRICS = " UNION ALL ".join(
    _class_sql(pred, f"WHERE row_key % 3 = {k}", f"'{pred}' AS model, CAST({k} AS BIGINT) AS fold,")
    for pred in ("p", "p2")
    for k in range(3)
)


def _stacked(spark, sf):
    df = evaluate.kfold(guesses(spark, sf), 3, "row_key")
    one = df.select(F.lit("p").alias("model"), "fold", "y", F.col("p").alias("said"))
    two = df.select(F.lit("p2").alias("model"), "fold", "y", F.col("p2").alias("said"))
    return one.unionByName(two)


@query("cross_validation_metrics", f"WITH {GUESS} {FOLD_METRICS}")
def q_fold_metrics(spark, sf):
    return rounded(evaluate.fold_metrics(_stacked(spark, sf), "y", "said", True), 6)


@query(
    "cross_validation_summary",
    f"""WITH {GUESS}, f AS (SELECT model, fold, avg(CAST(y = said AS DOUBLE)) AS a FROM
      (SELECT 'p' AS model, row_key % 3 AS fold, y, p AS said FROM g
       UNION ALL SELECT 'p2', row_key % 3, y, p2 FROM g) GROUP BY 1, 2)
    SELECT model, 'accuracy' AS metric, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std,
      round(min(a), 6) AS min, round(max(a), 6) AS max FROM f GROUP BY 1""",
)
def q_fold_summary(spark, sf):
    metrics = evaluate.fold_metrics(_stacked(spark, sf), "y", "said", True)
    return rounded(evaluate.summarise_folds(metrics).where("metric = 'accuracy'"), 6)


def _fold_vectors(spark, sf):
    df = order_rows(spark, sf).withColumn("label", F.col("o_totalprice"))
    vec = VectorAssembler(inputCols=["year", "month"], outputCol="features").transform(df)
    return evaluate.kfold(vec, 3, "o_orderkey").select("features", "label", "fold")


@query("cross_validate")
def q_cross_validate(spark, sf):
    data = _fold_vectors(spark, sf)
    metrics, _ = evaluate.cross_validate(
        data, {"plain": LinearRegression(), "ridge": LinearRegression(regParam=0.5)}, False
    )
    return metrics


@query(
    "compare_paired",
    f"""WITH {GUESS}, f AS (SELECT row_key % 5 AS fold, avg(CAST(y = p AS DOUBLE)) AS a,
        avg(CAST(y = p2 AS DOUBLE)) AS b FROM g GROUP BY 1)
    SELECT 'accuracy' AS metric, 'p' AS first, 'p2' AS second, round(avg(a), 6) AS first_mean,
      round(avg(b), 6) AS second_mean, round(avg(a - b), 6) + 0.0 AS mean_difference,
      round(avg(a - b) * sqrt(count(*)) / stddev_samp(a - b), 4) + 0.0 AS t_statistic,
      round(avg(a - b) / sqrt((var_pop(a) + var_pop(b)) / 2), 4) + 0.0 AS effect_size, count(*) AS n FROM f""",
)
def q_paired(spark, sf):
    df = evaluate.kfold(guesses(spark, sf), 5, "row_key")
    one = df.select(F.lit("p").alias("model"), "fold", "y", F.col("p").alias("said"))
    two = df.select(F.lit("p2").alias("model"), "fold", "y", F.col("p2").alias("said"))
    metrics = evaluate.fold_metrics(one.unionByName(two), "y", "said", True)
    out = rounded(evaluate.compare_paired(metrics, "p", "p2", "accuracy").drop("p_value"), 6)
    return out.withColumns({c: F.round(c, 4) for c in ("t_statistic", "effect_size")})


@query("tune")
def q_tune(spark, sf):
    data = _fold_vectors(spark, sf)
    result = tuning.tune(
        data,
        LinearRegression(maxIter=10),
        {"regParam": tuning.Span(0.01, 1.0), "fitIntercept": [True, False]},
        classes=False,
    )
    return result.trials.withColumn("params", F.to_json("params"))


@query("tune_classes")
def q_tune_classes(spark, sf):
    df = table(spark, sf, "lineitem")
    df = df.withColumn("label", (F.col("l_linestatus") == "O").cast("double")).withColumn(
        "row_key", F.col("l_orderkey") * 10 + F.col("l_linenumber")
    )
    vec = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(df)
    data = evaluate.kfold(vec, 2, "row_key").select("features", "label", "fold")
    result = tuning.tune(
        data,
        LogisticRegression(maxIter=5),
        {"regParam": tuning.Span(1e-3, 1.0, log=True), "elasticNetParam": tuning.Span(0, 1)},
        classes=True,
        method="random",
        n=3,
    )
    return result.trials.withColumn("params", F.to_json("params"))


@query(
    "parameter_importance",
    """WITH t AS (SELECT l_suppkey AS trial, avg(l_quantity) AS rate, avg(l_tax) AS depth,
      avg(l_extendedprice) AS score FROM lineitem GROUP BY 1)
    SELECT 'rate' AS parameter, round(abs(corr(rate, score)), 6) AS importance FROM t
    UNION ALL SELECT 'depth', round(abs(corr(depth, score)), 6) FROM t""",
)
def q_param_importance(spark, sf):
    trials = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg(
        F.avg("l_quantity").alias("rate"),
        F.avg("l_tax").alias("depth"),
        F.avg("l_extendedprice").alias("score"),
    )
    return rounded(tuning.parameter_importance(trials, ["rate", "depth"]), 6)


# --- Bayesian -----------------------------------------------------------------------------


@query("bayesian_regression")
def q_bayes_regression(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return bayes.bayesian_regression(df, ["p_size"], "p_retailprice")


@query(
    "bayes_mean_difference",
    """WITH m AS (SELECT l_linestatus AS c, count(*)::DOUBLE AS n, avg(l_quantity) AS mean,
        var_samp(l_quantity) AS var FROM lineitem GROUP BY 1),
    d AS (SELECT (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) AS d,
        1 / a.n + 1 / b.n AS s2, a.n + b.n AS n FROM m a, m b WHERE a.c = 'F' AND b.c = 'O'),
    p AS (SELECT *, 1 / (1 + 1 / s2) AS v, d / s2 / (1 + 1 / s2) AS pm FROM d)
    SELECT 'l_quantity' AS feature, round(d, 6) + 0.0 AS effect, round(pm, 6) + 0.0 AS posterior_mean,
      round(sqrt(v), 6) AS posterior_std, round(pm - 1.8807936081512509 * sqrt(v), 6) AS low,
      round(pm + 1.8807936081512509 * sqrt(v), 6) AS high,
      round(ln(sqrt(v)) + pm * pm / (2 * v), 4) AS log_bayes_factor, CAST(n AS BIGINT) AS n FROM p""",
)
def q_bayes_mean(spark, sf):
    out = bayes.bayes_mean_difference(table(spark, sf, "lineitem"), ["l_quantity"], "l_linestatus")
    out = rounded(out.drop("prob_positive", "bayes_factor"), 6)
    return out.withColumn("log_bayes_factor", F.round("log_bayes_factor", 4))


@query(
    "bayes_proportion_difference",
    """WITH c AS (SELECT l_linestatus AS c, sum(CAST(l_quantity > 20 AS INT)) + 1.0::DOUBLE AS a,
        sum(CAST(l_quantity <= 20 AS INT)) + 1.0::DOUBLE AS b, count(*) AS n FROM lineitem GROUP BY 1),
    m AS (SELECT c, a / (a + b) AS m, a * b / ((a + b) ** 2 * (a + b + 1)) AS v, n FROM c)
    SELECT 'big' AS success, round(x.m - y.m, 6) + 0.0 AS posterior_mean,
      round(sqrt(x.v + y.v), 6) AS posterior_std,
      round(x.m - y.m - 1.8807936081512509 * sqrt(x.v + y.v), 6) AS low,
      round(x.m - y.m + 1.8807936081512509 * sqrt(x.v + y.v), 6) AS high, x.n + y.n AS n
    FROM m x, m y WHERE x.c = 'F' AND y.c = 'O'""",
)
def q_bayes_share(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_linestatus", (F.col("l_quantity") > 20).cast("int").alias("big")
    )
    out = bayes.bayes_proportion_difference(df, "l_linestatus", "big")
    return rounded(out.drop("prob_positive"), 6)
