"""Queries for tests, regression, effects, selection and importance."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabulant.core.gram import complete_rows, gram_matrix
from tabulant.functions.special import normal_cdf
from tabulant.operators import causal, regression, select, stats
from tabulant.plans.registry import query, rounded, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEST = ["test", "feature", "statistic", "df1", "df2", "n"]


def _tests(df, digits=6):
    return rounded(df.select(*TEST), digits)


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


def _moments_cte(group, features):
    return "m AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({group} AS VARCHAR) AS class, count(*)::DOUBLE AS n, "
        f"avg({f}) AS mean, var_samp({f}) AS var FROM lineitem GROUP BY {group}"
        for f in features
    ) + ")"


@query(
    "t_test",
    f"""WITH {_moments_cte("l_linestatus", FEATURES)}
    SELECT 't_test' AS test, a.feature,
      round((a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)
        * (1 / a.n + 1 / b.n)), 6) + 0.0 AS statistic,
      a.n + b.n - 2 AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(a.n + b.n AS BIGINT) AS n
    FROM m a JOIN m b ON a.feature = b.feature AND a.class = 'F' AND b.class = 'O'""",
)
def q_t_test(spark, sf):
    return _tests(stats.t_test(lineitem(spark, sf), FEATURES, "l_linestatus"))


def _anova_sql(group, features):
    return f"""WITH {_moments_cte(group, features)},
    g AS (SELECT feature, sum(n * mean) / sum(n) AS grand FROM m GROUP BY 1),
    s AS (SELECT feature, sum(n) AS n, count(*)::DOUBLE AS k, sum(n * (mean - grand) ** 2) AS b,
          sum((n - 1) * var) AS w FROM m JOIN g USING (feature) GROUP BY 1)
    SELECT 'anova' AS test, feature, round((b / (k - 1)) / (w / (n - k)), 6) AS statistic,
      k - 1 AS df1, n - k AS df2, CAST(n AS BIGINT) AS n FROM s"""


@query("anova", _anova_sql("l_returnflag", FEATURES))
def q_anova(spark, sf):
    return _tests(stats.anova(lineitem(spark, sf), FEATURES, "l_returnflag"))


def _ranks_cte(group, features):
    parts = [
        f"""SELECT '{f}' AS feature, {group} AS class,
        count(*) OVER (ORDER BY {f}) - (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY {f})::DOUBLE AS t FROM lineitem"""
        for f in features
    ]
    return f"""r AS ({" UNION ALL ".join(parts)}),
    c AS (SELECT feature, class, count(*)::DOUBLE AS n, sum(r) AS rs FROM r GROUP BY 1, 2),
    k AS (SELECT feature, count(*)::DOUBLE AS total, sum(t * t - 1) AS ties FROM r GROUP BY 1)"""


@query(
    "mann_whitney",
    f"""WITH {_ranks_cte("l_linestatus", ["l_quantity", "l_extendedprice"])}
    SELECT 'mann_whitney' AS test, feature, rs - n * (n + 1) / 2 AS statistic,
      CAST(NULL AS DOUBLE) AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(total AS BIGINT) AS n
    FROM c JOIN k USING (feature) WHERE class = 'F'""",
)
def q_mann_whitney(spark, sf):
    return _tests(
        stats.mann_whitney(lineitem(spark, sf), ["l_quantity", "l_extendedprice"], "l_linestatus")
    )


@query(
    "kruskal_wallis",
    f"""WITH {_ranks_cte("l_returnflag", ["l_quantity", "l_extendedprice"])},
    h AS (SELECT feature, count(*) - 1.0 AS d, sum(rs * rs / n) AS s FROM c GROUP BY 1)
    SELECT 'kruskal_wallis' AS test, feature,
      round((12 / (total * (total + 1)) * s - 3 * (total + 1)) / (1 - ties / (total ** 3 - total)), 4)
        AS statistic,
      d::DOUBLE AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(total AS BIGINT) AS n
    FROM h JOIN k USING (feature)""",
)
def q_kruskal(spark, sf):
    return _tests(
        stats.kruskal_wallis(
            lineitem(spark, sf), ["l_quantity", "l_extendedprice"], "l_returnflag"
        ),
        4,
    )


@query(
    "permutation_test",
    """WITH r AS (SELECT l_linestatus AS g, avg(pos) OVER (PARTITION BY l_quantity) AS mid,
        count(*) OVER (PARTITION BY l_quantity)::DOUBLE AS t
      FROM (SELECT l_linestatus, l_quantity, row_number() OVER (ORDER BY l_quantity) AS pos FROM lineitem)),
    s AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN g = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS n1,
        sum(CASE WHEN g = 'F' THEN mid ELSE 0 END) AS ranks, sum(t * t - 1) AS ties FROM r)
    SELECT 'permutation' AS test, 'l_quantity' AS feature, round(ranks - n1 * (n1 + 1) / 2, 3) AS statistic,
      n::BIGINT AS n, 1000::BIGINT AS n_permutations, round(n1 * (n - n1) / 2, 3) AS expected_mean,
      round(sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 3) AS expected_sd,
      true AS mean_fits, true AS sd_fits, true AS p_fits FROM s""",
)
def q_permutation(spark, sf):
    """Mean and spread of U over the relabelings fit the closed form, p the normal tail."""
    out = stats.permutation_test(lineitem(spark, sf), "l_quantity", "l_linestatus")
    z = (F.col("statistic") - F.col("expected_mean")) / F.col("expected_sd")
    return out.select(
        "test",
        "feature",
        F.round("statistic", 3).alias("statistic"),
        "n",
        "n_permutations",
        F.round("expected_mean", 3).alias("expected_mean"),
        F.round("expected_sd", 3).alias("expected_sd"),
        (F.abs(F.col("u_mean") - F.col("expected_mean")) < F.col("expected_sd") * 5 / F.sqrt("n_permutations")).alias("mean_fits"),
        (F.abs(F.col("u_sd") / F.col("expected_sd") - 1) < 0.12).alias("sd_fits"),
        (F.abs(F.col("p_greater") - (F.lit(1.0) - normal_cdf(z))) < 0.08).alias("p_fits"),
    )


@query(
    "pearson_test",
    " UNION ALL ".join(
        f"""SELECT 'pearson' AS test, '{c}' AS feature,
        round(corr({c}, l_extendedprice), 6) + 0.0 AS statistic, count(*) - 2.0::DOUBLE AS df1,
        CAST(NULL AS DOUBLE) AS df2, count(*) AS n FROM lineitem"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
)
def q_pearson(spark, sf):
    return _tests(
        stats.pearson_test(
            lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
        )
    )


ONE_FEATURE = """(SELECT regr_slope(l_extendedprice, l_quantity) AS b,
  regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2,
  count(*)::DOUBLE AS n FROM lineitem)"""


@query(
    "linear_regression",
    f"""SELECT term, round(coefficient, 4) AS coefficient, round(r2, 6) AS r_squared,
      round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r_squared,
      round(r2 / ((1 - r2) / (n - 2)), 2) AS f_statistic, CAST(n AS BIGINT) AS n
    FROM (SELECT 'intercept' AS term, a AS coefficient, r2, n FROM {ONE_FEATURE}
          UNION ALL SELECT 'l_quantity', b, r2, n FROM {ONE_FEATURE})""",
)
def q_linear(spark, sf):
    out = regression.linear_regression(lineitem(spark, sf), ["l_quantity"], "l_extendedprice")
    return out.select(
        "term",
        F.round("coefficient", 4).alias("coefficient"),
        F.round("r_squared", 6).alias("r_squared"),
        F.round("adj_r_squared", 6).alias("adj_r_squared"),
        F.round("f_statistic", 2).alias("f_statistic"),
        "n",
    )


def _cross(a, b):
    return f"covar_pop({a}, {b}) * count(*)"


@query(
    "linear_regression_multi",
    # inverse of the 3 x 3 cross products by cofactors
    f"""WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3,
        avg(l_extendedprice) AS my, {_cross("l_extendedprice", "l_extendedprice")} AS yy,
        {_cross("l_quantity", "l_quantity")} AS a, {_cross("l_quantity", "l_discount")} AS b,
        {_cross("l_quantity", "l_tax")} AS c, {_cross("l_discount", "l_discount")} AS d,
        {_cross("l_discount", "l_tax")} AS e, {_cross("l_tax", "l_tax")} AS f,
        {_cross("l_quantity", "l_extendedprice")} AS y1, {_cross("l_discount", "l_extendedprice")} AS y2,
        {_cross("l_tax", "l_extendedprice")} AS y3 FROM lineitem),
    i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
    g AS (SELECT *, (d * f - e * e) / det AS i11, (c * e - b * f) / det AS i12, (b * e - c * d) / det AS i13,
        (a * f - c * c) / det AS i22, (b * c - a * e) / det AS i23, (a * d - b * b) / det AS i33 FROM i),
    w AS (SELECT *, i11 * y1 + i12 * y2 + i13 * y3 AS b1, i12 * y1 + i22 * y2 + i23 * y3 AS b2,
        i13 * y1 + i23 * y2 + i33 * y3 AS b3 FROM g),
    s AS (SELECT *, (yy - b1 * y1 - b2 * y2 - b3 * y3) / (n - 4) AS s2,
        (b1 * y1 + b2 * y2 + b3 * y3) / yy AS r2 FROM w),
    t AS (SELECT 'intercept' AS term, my - b1 * m1 - b2 * m2 - b3 * m3 AS coefficient, sqrt(s2 * (1 / n + m1 * m1 * i11
          + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23))) AS std_error, s.* FROM s
      UNION ALL SELECT 'l_quantity', b1, sqrt(s2 * i11), s.* FROM s
      UNION ALL SELECT 'l_discount', b2, sqrt(s2 * i22), s.* FROM s
      UNION ALL SELECT 'l_tax', b3, sqrt(s2 * i33), s.* FROM s)
    SELECT term, round(coefficient, 4) + 0.0 AS coefficient, round(std_error, 4) AS std_error,
      round(coefficient / std_error, 4) + 0.0 AS t_statistic, round(r2, 8) AS r_squared,
      round(1 - (1 - r2) * (n - 1) / (n - 4), 8) + 0.0 AS adj_r_squared,
      round(r2 / 3 / ((1 - r2) / (n - 4)), 4) AS f_statistic, 3::BIGINT AS rank, n::BIGINT AS n FROM t""",
)
def q_linear_multi(spark, sf):
    out = regression.linear_regression(
        lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
    ).drop("p_value", "f_p_value")
    fine = ["r_squared", "adj_r_squared"]
    return rounded(out, 4).drop(*fine).join(rounded(out.select("term", *fine), 8), "term")


@query("forest_regression")
def q_forest(spark, sf):
    df = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return regression.regress(
        df, ["o_custkey", "year"], "o_totalprice", "forest", trees=10, folds=3, row_key="o_orderkey"
    )


@query("boosted_regression")
def q_boosted(spark, sf):
    df = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return regression.regress(
        df, ["o_custkey", "year"], "o_totalprice", "boosted", rounds=5, folds=2, row_key="o_orderkey"
    )


@query(
    "auto_test",
    f"""SELECT * FROM (WITH {_moments_cte("l_linestatus", ["l_quantity"])}
    SELECT 't_test' AS test, a.feature,
      round((a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)
        * (1 / a.n + 1 / b.n)), 6) + 0.0 AS statistic,
      a.n + b.n - 2 AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(a.n + b.n AS BIGINT) AS n
    FROM m a JOIN m b ON a.feature = b.feature AND a.class = 'F' AND b.class = 'O')
    UNION ALL SELECT * FROM ({_anova_sql("l_returnflag", ["l_tax"])})
    UNION ALL SELECT 'regression', 'l_quantity', round(1 - (1 - r2) * (n - 1) / (n - 2), 6),
      1.0::DOUBLE, n - 2, CAST(n AS BIGINT) FROM {ONE_FEATURE}""",
)
def q_auto_test(spark, sf):
    df = lineitem(spark, sf)
    out = stats.auto_test(df, ["l_quantity"], "l_linestatus")
    out = out.unionByName(stats.auto_test(df, ["l_tax"], "l_returnflag"))
    out = out.unionByName(stats.auto_test(df, ["l_quantity"], "l_extendedprice"))
    return _tests(out)


@query("auto_test_logistic")
def q_auto_logistic(spark, sf):
    return stats.auto_test(lineitem(spark, sf), ["l_quantity", "l_tax"], "l_returnflag")


@query("significance")
def q_significance(spark, sf):
    df = lineitem(spark, sf)
    out = stats.significance(df, ["l_quantity"], "l_linestatus")
    out = out.unionByName(stats.significance(df, ["l_quantity", "l_tax"], "l_extendedprice"))
    return out.unionByName(stats.significance(df, ["l_quantity", "l_tax"], "l_linestatus"))


@query(
    "effect_size",
    f"""WITH {_moments_cte("l_linestatus", ["l_quantity"])},
    d AS (SELECT abs(a.mean - b.mean) / sqrt((a.var + b.var) / 2) AS e FROM m a, m b
          WHERE a.class = 'F' AND b.class = 'O'),
    g AS (SELECT l_returnflag AS c, count(*) AS n, avg(l_tax) AS mean FROM lineitem GROUP BY 1),
    e AS (SELECT sum(n * (mean - t) ** 2) / any_value(s) AS e FROM g,
          (SELECT avg(l_tax) AS t, var_pop(l_tax) * count(*) AS s FROM lineitem))
    SELECT 'l_quantity' AS features, round(e, 6) AS effect_size FROM d
    UNION ALL SELECT 'l_tax', round(e, 6) FROM e
    UNION ALL SELECT 'l_quantity', round(abs(corr(l_quantity, l_extendedprice)), 6) FROM lineitem""",
)
def q_effect_size(spark, sf):
    df = lineitem(spark, sf)
    out = stats.effect_size(df, ["l_quantity"], "l_linestatus")
    out = out.unionByName(stats.effect_size(df, ["l_tax"], "l_returnflag"))
    out = out.unionByName(stats.effect_size(df, ["l_quantity"], "l_extendedprice"))
    return rounded(out, 6)


@query(
    "coverage",
    """SELECT 'l_quantity' AS features, round(regr_r2(l_extendedprice, l_quantity), 6) AS coverage
    FROM lineitem""",
)
def q_coverage(spark, sf):
    return rounded(stats.coverage(lineitem(spark, sf), ["l_quantity"], "l_extendedprice"), 6)


# --- causal -------------------------------------------------------------------------


@query(
    "causal_effect",
    """WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) AS ty,
      covar_pop(l_extendedprice, l_discount) AS cy, covar_pop(l_quantity, l_discount) AS tc,
      var_pop(l_quantity) AS tt, var_pop(l_discount) AS cc, count(*) AS n FROM lineitem)
    SELECT 'l_quantity' AS treatment, 'l_extendedprice' AS outcome, 'l_discount' AS confounder,
      round((ty * cc - cy * tc) / (tt * cc - tc * tc), 4) AS effect, n FROM s
    UNION ALL SELECT 'l_quantity', 'l_extendedprice', '', round(ty / tt, 4), n FROM s""",
)
def q_causal(spark, sf):
    df = lineitem(spark, sf)
    out = causal.causal_effect(df, "l_quantity", "l_extendedprice", ["l_discount"])
    out = out.unionByName(causal.causal_effect(df, "l_quantity", "l_extendedprice"))
    return rounded(
        out.select(
            "treatment",
            "outcome",
            F.array_join("confounders", ",").alias("confounder"),
            "effect",
            "n",
        )
    )


@query(
    "causal_priorities",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(abs(regr_slope(l_extendedprice, {c})), 4) AS causal_score
        FROM lineitem"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
)
def q_priorities(spark, sf):
    return rounded(
        causal.causal_priorities(
            lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
        )
    )


@query("placebo_check")
def q_placebo(spark, sf):
    return causal.placebo_check(lineitem(spark, sf), "l_quantity", "l_extendedprice", ["l_discount"])


# --- selection ------------------------------------------------------------------------


def correlated(spark, sf):
    return lineitem(spark, sf).select(
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("volume"),
        "l_quantity",
        (F.col("l_quantity") * F.col("l_quantity")).alias("q2"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net"),
        "l_tax",
    )


@query(
    "select_by_correlation",
    """WITH x AS (SELECT l_extendedprice * l_quantity AS y, l_quantity AS a, l_quantity * l_quantity AS b,
        l_quantity * (1 - l_discount) AS c, l_tax AS d FROM lineitem),
    r AS (SELECT corr(a, y) AS ya, corr(b, y) AS yb, corr(c, y) AS yc, corr(d, y) AS yd FROM x)
    SELECT 'l_quantity' AS feature, round(ya, 6) + 0.0 AS r, ya >= yb AND ya >= yc AS selected FROM r
    UNION ALL SELECT 'q2', round(yb, 6) + 0.0, yb > ya AND yb >= yc FROM r
    UNION ALL SELECT 'net', round(yc, 6) + 0.0, yc > ya AND yc > yb FROM r
    UNION ALL SELECT 'l_tax', round(yd, 6) + 0.0, true FROM r""",
)
def q_select_corr(spark, sf):
    return rounded(select.select_by_correlation(correlated(spark, sf), "volume"), 6)


def _mi_sql(features):
    def code(c):
        return (
            f"(SELECT count(DISTINCT q) FROM unnest(e_{c}) u(q) "
            f"WHERE q <= {c} AND q > lo_{c} AND q < hi_{c})"
        )

    points = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
    cols = [*features, "l_extendedprice"]
    edges = ", ".join(
        f"quantile_cont({c}, {points}) AS e_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols
    )
    parts = [
        f"SELECT '{f}' AS feature, {code(f)} AS x, {code('l_extendedprice')} AS y FROM lineitem, q"
        for f in features
    ]
    return f"""WITH q AS (SELECT {edges} FROM lineitem), b AS ({" UNION ALL ".join(parts)}),
    c AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x)
          AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
    SELECT feature, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS score FROM w GROUP BY 1"""


@query("mutual_information", _mi_sql(["l_quantity", "l_discount", "l_tax"]))
def q_mi(spark, sf):
    return rounded(
        select.mutual_information(
            lineitem(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]
        ),
        6,
    )


@query(
    "f_regression",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) AS score,
        CAST(n - 2 AS DOUBLE) AS df2
        FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)"""
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
)
def q_f_regression(spark, sf):
    out = select.f_regression(
        lineitem(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]
    )
    return rounded(out.drop("p_value"))


@query(
    "f_classif",
    f"""SELECT feature, statistic AS score, df1, df2
    FROM ({_anova_sql("l_returnflag", ["l_quantity", "l_tax"])})""",
)
def q_f_classif(spark, sf):
    out = select.f_classif(lineitem(spark, sf), "l_returnflag", ["l_quantity", "l_tax"])
    return rounded(out.drop("p_value"), 6)


@query("recursive_elimination")
def q_rfe(spark, sf):
    return select.recursive_elimination(correlated(spark, sf), "volume")


@query("tree_importance")
def q_tree_importance(spark, sf):
    return select.tree_importance(correlated(spark, sf), "volume", k=2, trees=10)


@query(
    "select_features",
    f"""WITH s AS ({_mi_sql(["l_quantity", "l_discount", "l_tax"])})
    SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) <= 2 AS selected
    FROM s""",
)
def q_select_features(spark, sf):
    return rounded(
        select.select_features(
            lineitem(spark, sf),
            "l_extendedprice",
            "mutual_info",
            ["l_quantity", "l_discount", "l_tax"],
            k=2,
        ),
        6,
    )


def _fitted_linear(df, features, target):
    data = VectorAssembler(inputCols=features, outputCol="features").transform(
        complete_rows(df, [*features, target])
    )
    return LinearRegression(labelCol=target, solver="normal").fit(data)


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    df = lineitem(spark, sf)
    cols = ["l_quantity", "l_discount", "l_tax"]
    model = _fitted_linear(df, cols, "l_extendedprice")
    return select.permutation_importance(model, df, cols, "l_extendedprice", repeats=3)


@query("coefficient_importance")
def q_coefficients(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    df = lineitem(spark, sf).withColumn("label", (F.col("l_linestatus") == "O").cast("double"))
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    model = LogisticRegression(maxIter=20).fit(data.select("features", "label"))
    return select.coefficient_importance(spark, model, cols)


@query(
    "linear_shap",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(abs(b * ({c} - m))), 4) AS score FROM lineitem,
        (SELECT regr_slope(l_extendedprice, {c}) AS b, avg({c}) AS m FROM lineitem)"""
        for c in ["l_quantity", "l_tax"]
    ),
)
def q_shap(spark, sf):
    df = lineitem(spark, sf)
    slopes = {
        c: stats.linear_fit(df, [c], "l_extendedprice").coef[0] for c in ["l_quantity", "l_tax"]
    }
    return rounded(select.linear_shap(df, slopes))


@query(
    "consensus_ranking",
    """WITH s AS (
      SELECT 'corr' AS method, 'l_quantity' AS feature, abs(corr(l_quantity, l_extendedprice)) AS score FROM lineitem
      UNION ALL SELECT 'corr', 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem
      UNION ALL SELECT 'corr', 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem
      UNION ALL SELECT 'slope', 'l_quantity', abs(regr_slope(l_extendedprice, l_quantity)) FROM lineitem
      UNION ALL SELECT 'slope', 'l_discount', abs(regr_slope(l_extendedprice, l_discount)) FROM lineitem
      UNION ALL SELECT 'slope', 'l_tax', abs(regr_slope(l_extendedprice, l_tax)) FROM lineitem),
    p AS (SELECT *, count(*) OVER (PARTITION BY method)
            - row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) + 1 AS k FROM s)
    SELECT feature, CAST(sum(k) AS BIGINT) AS consensus_score, count(*) AS methods FROM p GROUP BY 1""",
)
def q_consensus(spark, sf):
    df = lineitem(spark, sf)
    cols = ["l_quantity", "l_discount", "l_tax"]
    from tabulant.operators.profile import target_correlations

    corr = target_correlations(df, "l_extendedprice", cols).select(
        "feature", F.abs("r").alias("score")
    )
    slope = causal.causal_priorities(df, cols, "l_extendedprice").select(
        "feature", F.col("causal_score").alias("score")
    )
    return select.consensus_ranking({"corr": corr, "slope": slope})


# --- sufficient statistics ---------------------------------------------------------------


@query(
    "gram_matrix",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a[0]}' AS i, '{b[0]}' AS j, round(sum({a[1]} * {b[1]}) / 1e6, 4) AS s FROM lineitem"
        for k, a in enumerate([("1", "1.0::DOUBLE"), *[(c, c) for c in FEATURES]])
        for b in [("1", "1.0::DOUBLE"), *[(c, c) for c in FEATURES]][k:]
    ) + ")",
)
def q_gram(spark, sf):
    out = gram_matrix(lineitem(spark, sf), FEATURES)
    return rounded(out.withColumn("s", F.col("s") / 1e6))
