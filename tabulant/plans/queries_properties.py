"""What must hold of fitted models at their defaults, beside SQL that says so.

Each query fits a model on a whole table and reports numbers that have one right value:
sums that are 1, rows that break a rule (0), residual means that are 0, totals that SQL
counts in the table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulant.core.gram import moments
from tabulant.core.lineage import cut_lineage
from tabulant.core.shuffle import dealt
from tabulant.operators import cluster, models
from tabulant.plans.queries_models import DIMS, order_rows, vectors
from tabulant.plans.registry import query, table

SCHEMA = "property string, value double"


def _rows(spark, values: dict):
    return spark.createDataFrame([(k, round(float(v), 6) + 0.0) for k, v in values.items()], SCHEMA)


def _says(**values) -> str:
    """SQL with the right values; text is SQL of its own."""
    return " UNION ALL ".join(
        f"SELECT '{k}' AS property, round(CAST(({v}) AS DOUBLE), 6) + 0.0 AS value" for k, v in values.items()
    )


def _off(column, target=1.0):
    """Rows whose array does not sum to the target."""
    total = F.aggregate(column, F.lit(0.0), lambda t, v: t + v)
    return F.count_if(F.abs(total - target) > 1e-6)


def _column(name: str) -> str:
    """SQL of all components of the embeddings in one list per row."""
    return f"(SELECT sum(s) FROM (SELECT {name}(x) AS s FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, " \
        "generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))"


@query(
    "pca_properties",
    _says(total_variance=_column("var_samp"), components=64, not_orthonormal=0, not_decreasing=0, correlated=0, other_variance=0),
)
def q_pca(spark, sf):
    """Components are orthonormal, uncorrelated over the rows, and carry all variance in order."""
    df = vectors(spark, sf)
    model = cluster.fit_pca(df, DIMS, scale=False)
    names = [f"pc_{i}" for i in range(len(DIMS))]
    moved = cut_lineage(model.transform(df).select(*names))
    m = moments(moved, names)
    cov = m.cross / (m.n - 1)
    own = np.diag(cov)
    return _rows(
        spark,
        {
            "total_variance": model.values.sum(),
            "components": len(model.values),
            "not_orthonormal": (np.abs(model.vectors.T @ model.vectors - np.eye(len(DIMS))) > 1e-8).sum(),
            "not_decreasing": (np.diff(model.values) > 1e-12).sum(),
            "correlated": (np.abs(cov - np.diag(own)) > 1e-8).sum(),
            "other_variance": (np.abs(own - model.values) > 1e-8).sum(),
        },
    )


@query("kmeans_properties", _says(rows="SELECT count(*) FROM embeddings", clusters=3, off_nearest=0, sizes_off=0))
def q_kmeans(spark, sf):
    """Every row has the cluster of its nearest centre, in the scale of the fit."""
    df = vectors(spark, sf)
    model = cluster.fit_kmeans(df, DIMS, k=3)
    out = model.transform(cluster._vectors(df, DIMS)).select("cluster", "__scaled")
    centres = model.stages[2].clusterCenters()
    x = vector_to_array("__scaled")
    gaps = [
        F.aggregate(
            F.zip_with(x, F.lit(c.tolist()), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v
        )
        for c in centres
    ]
    least = F.array_min(F.array(*gaps))
    mine = reduce(lambda w, i: w.when(F.col("cluster") == i, gaps[i]), range(1, len(gaps)), F.when(F.col("cluster") == 0, gaps[0]))
    row = out.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"), F.count_if(mine > least + 1e-9).alias("off")).first()
    sizes = {r["cluster"]: r["count"] for r in out.groupBy("cluster").count().collect()}
    fitted = model.stages[2].summary.clusterSizes
    return _rows(
        spark,
        {
            "rows": row["n"],
            "clusters": row["k"],
            "off_nearest": row["off"],
            "sizes_off": sum(sizes.get(i, 0) != n for i, n in enumerate(fitted)),
        },
    )


@query("gaussian_mixture_properties", _says(rows="SELECT count(*) FROM embeddings", weights=1, off_one=0, off_likeliest=0))
def q_mixture(spark, sf):
    """Weights and probabilities sum to 1; the label is the likeliest component."""
    df = vectors(spark, sf)
    model = cluster.fit_mixture(df, DIMS, k=3)
    p = F.col("probabilities")
    row = cluster.mixture_labels(model, df, DIMS).agg(
        F.count("*").alias("n"),
        _off(p).alias("off"),
        F.count_if(F.element_at(p, F.col("cluster").cast("int") + 1) < F.array_max(p)).alias("other"),
    ).first()
    weights = sum(model.stages[2].weights)
    return _rows(spark, {"rows": row["n"], "weights": weights, "off_one": row["off"], "off_likeliest": row["other"]})


CLASSES = "SELECT count(DISTINCT o_orderstatus) FROM orders"


@query(
    "fit_forest_properties",
    _says(rows="SELECT count(*) FROM orders", importance=1, classes=CLASSES, off_one=0, off_likeliest=0, below_majority=0),
)
def q_forest(spark, sf):
    """A hundred trees: importances and probabilities sum to 1, accuracy is not below the majority's."""
    df = order_rows(spark, sf)
    model = models.fit_forest(df, ["o_totalprice", "year", "month"], "o_orderstatus")
    p = F.col("probabilities")
    labels = F.array(*[F.lit(c) for c in model.classes])
    # written: expressions over the probabilities would ask the trees again each
    found = cut_lineage(model.predict(dealt(df)).select("o_orderstatus", "prediction", "probabilities"))
    row = found.agg(
        F.count("*").alias("n"),
        _off(p).alias("off"),
        F.count_if(F.element_at(p, F.array_position(labels, F.col("prediction")).cast("int")) < F.array_max(p)).alias("other"),
        F.avg((F.col("prediction") == F.col("o_orderstatus")).cast("double")).alias("right"),
    ).first()
    most = df.groupBy("o_orderstatus").count().agg(F.max("count")).first()[0]
    importance = model.importance(spark).agg(F.sum("score")).first()[0]
    return _rows(
        spark,
        {
            "rows": row["n"],
            "importance": importance,
            "classes": len(model.classes),
            "off_one": row["off"],
            "off_likeliest": row["other"],
            "below_majority": row["right"] < most / row["n"] - 1e-9,
        },
    )


@query("fit_boosted_properties", _says(rows="SELECT count(*) FROM part", mean_residual=0, worse_than_mean=0))
def q_boosted(spark, sf):
    """A hundred rounds: residuals of the fitted rows have mean 0 and no more spread than the target."""
    df = table(spark, sf, "part").select("p_size", "p_retailprice")
    model = models.fit_boosted(df, ["p_size"], "p_retailprice", classes=False)
    gap = F.col("p_retailprice") - F.col("prediction")
    row = cut_lineage(model.predict(dealt(df))).agg(
        F.count("*").alias("n"), F.avg(gap).alias("mean"), F.var_pop(gap).alias("left"), F.var_pop("p_retailprice").alias("all")
    ).first()
    return _rows(spark, {"rows": row["n"], "mean_residual": round(row["mean"], 3), "worse_than_mean": row["left"] > row["all"]})


@query("fit_linear_properties", _says(rows="SELECT count(*) FROM orders", classes=CLASSES, off_one=0, share_gap=0))
def q_linear(spark, sf):
    """Logistic regression at its optimum: mean probabilities are the shares of the classes."""
    df = order_rows(spark, sf)
    model = models.fit_linear(df, ["o_totalprice", "year", "o_orderpriority"], "o_orderstatus")
    out = model.predict(df)
    p = F.col("probabilities")
    cells = [F.count("*").alias("n"), _off(p).alias("off")]
    for i, c in enumerate(model.classes):
        cells.append((F.avg(p[i]) - F.avg((F.col("o_orderstatus") == c).cast("double"))).alias(f"g{i}"))
    row = out.agg(*cells).first()
    gap = max(abs(row[f"g{i}"]) for i in range(len(model.classes)))
    return _rows(spark, {"rows": row["n"], "classes": len(model.classes), "off_one": row["off"], "share_gap": round(gap, 3)})
