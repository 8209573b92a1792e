"""Tests, regression and effects against literals and numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulant.core.gram import gram_matrix, moments, moments_by
from tabulant.functions import special
from tabulant.operators import bayes, causal, regression, select, stats


def groups(spark, *values):
    rows = [(str(i), float(v)) for i, g in enumerate(values) for v in g]
    return spark.createDataFrame(rows, "g string, x double")


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477, abs=1e-10)
    assert special.f_tail(4.0, 2, 10) == pytest.approx((10 / 18) ** 5, abs=1e-12)
    assert special.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.norm_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.2281388520, abs=1e-8)
    assert special.beta_inc(2e5, 3e5, 0.4) == pytest.approx(0.5, abs=1e-3)


def test_t_test_literals(spark):
    same = stats.t_test(groups(spark, [1, 2, 3], [1, 2, 3]), ["x"], "g").first()
    assert same["statistic"] == 0 and same["p_value"] == 1
    apart = stats.t_test(groups(spark, [1, 2, 3], [10, 11, 12]), ["x"], "g").first()
    assert apart["p_value"] < 0.05
    with pytest.raises(Exception, match="two non-empty groups"):
        stats.t_test(groups(spark, [1, 2]), ["x"], "g").collect()


def test_anova_literals(spark):
    r = stats.anova(groups(spark, [1, 2, 3], [4, 5, 6], [7, 8, 9]), ["x"], "g").first()
    assert r["statistic"] == pytest.approx(27) and (r["df1"], r["df2"]) == (2, 6)
    flat = stats.anova(groups(spark, [5] * 3, [5] * 3, [5] * 3), ["x"], "g").first()
    assert flat["statistic"] == 0 and flat["p_value"] == 1


def test_rank_tests_literals(spark):
    r = stats.mann_whitney(groups(spark, range(1, 6), range(10, 15)), ["x"], "g").first()
    assert r["statistic"] == 0 and r["p_value"] < 0.05
    same = stats.mann_whitney(groups(spark, [1, 2, 3], [1, 2, 3]), ["x"], "g").first()
    assert same["p_value"] == 1
    flat = stats.kruskal_wallis(groups(spark, [5] * 3, [5] * 3, [5] * 3), ["x"], "g").first()
    assert flat["statistic"] == 0 and flat["p_value"] == 1


def test_permutation_test_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 8, 25).astype(float), rng.integers(1, 9, 30).astype(float)
    df = groups(spark, a, b)
    got = stats.permutation_test(df, "x", "g", 2000).first()
    both = np.concatenate([a, b])

    def u(first, second):
        return sum((x > second).sum() + 0.5 * (x == second).sum() for x in first)

    assert got["statistic"] == pytest.approx(u(a, b))
    draws = []
    for _ in range(2000):
        p = rng.permutation(both)
        draws.append(u(p[:25], p[25:]))
    assert got["p_greater"] == pytest.approx(np.mean(np.array(draws) >= u(a, b)), abs=0.04)
    again = stats.permutation_test(df, "x", "g", 2000).first()
    assert again == got
    split = stats.permutation_test(df, "x", "g", 2000, parts=6).first()
    assert split["p_greater"] == pytest.approx(got["p_greater"], abs=0.04)


def test_relabelings_have_the_moments_of_u(spark):
    """Many slices, a value in a third of the rows; a draw per node is the same in all tasks."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("x"), (F.col("id") % 5 == 0).alias("g")
    )
    for parts in (2, 13):
        r = stats.permutation_test(df, "x", "g", 1000, parts=parts).first()
        assert r["n"] == 30_000 and r["n_permutations"] == 1000
        assert abs(r["u_mean"] - r["expected_mean"]) < 5 * r["expected_sd"] / 1000**0.5
        assert r["u_sd"] == pytest.approx(r["expected_sd"], rel=0.12)


def test_labels_of_slices_add_up():
    sizes = np.array([5, 0, 40, 1, 300, 7, 20])
    wanted, depth, quota = 111, 3, []
    for s in range(len(sizes)):
        rows = []
        for level in range(1, depth + 1):
            width = 1 << (depth - level)
            node = s // width
            total = lambda n: int(sizes[n * width : (n + 1) * width].sum())  # noqa: B023, E731
            rows.append((s, level, node, total(node), total(node ^ 1)))
        path = pd.DataFrame(rows, columns=["slice", "level", "node", "own", "other"])
        quota.append(stats._slice_quota(path, wanted, 500, 9))
    quota = np.array(quota)
    assert (quota.sum(axis=0) == wanted).all() and (quota <= sizes[:, None]).all() and (quota >= 0).all()
    assert quota.mean(axis=1) == pytest.approx(sizes * wanted / sizes.sum(), abs=1.5)


def planted(spark, n=400):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(n, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=n) + 5
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double"), x, y


def test_least_squares_matches_numpy(spark):
    df, x, y = planted(spark)
    got = {r["term"]: r for r in regression.linear_regression(df, list("abcd"), "y").collect()}
    full = np.column_stack([np.ones(len(x)), x])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    rss = ((y - full @ beta) ** 2).sum()
    err = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * rss / (len(y) - 5))
    for i, name in enumerate(["intercept", *"abcd"]):
        assert got[name]["coefficient"] == pytest.approx(beta[i], abs=1e-9)
        assert got[name]["std_error"] == pytest.approx(err[i], rel=1e-8)
    assert got["a"]["p_value"] < 1e-10 and got["c"]["p_value"] > 0.001


def test_singular_columns(spark):
    df, _, _ = planted(spark)
    df = df.withColumn("a2", F.col("a") * 2)
    r = regression.linear_regression(df, ["a", "a2", "b"], "y").first()
    assert r["rank"] == 2 and r["r_squared"] > 0.99


def test_wide_moments_equal_narrow(spark, monkeypatch):
    from tabulant.core import gram

    df, x, y = planted(spark)
    narrow = moments(df, list("abcdy"))
    by = moments_by(df.withColumn("f", (F.rand(1) > 0.5).cast("int")), list("abcdy"), "f")
    long = {(r["i"], r["j"]): r["s"] for r in gram_matrix(df, list("ab")).collect()}
    monkeypatch.setattr(gram, "NARROW", 2)
    wide = moments(df, list("abcdy"))
    assert np.allclose(narrow.cross, wide.cross) and np.allclose(narrow.means, wide.means)
    merged = gram.merged(list(by.values()))
    assert np.allclose(merged.cross, wide.cross) and merged.n == wide.n
    monkeypatch.setattr(gram, "NARROW", 1)
    assert long == pytest.approx({(r["i"], r["j"]): r["s"] for r in gram_matrix(df, list("ab")).collect()})


def test_logistic_accuracy_finds_the_rule(spark):
    df, x, y = planted(spark)
    df = df.withColumn("k", F.when(F.col("a") + F.col("b") > 0, "up").otherwise("down"))
    both, n = stats.logistic_accuracy(df, ["a", "b"], "k")
    noise, _ = stats.logistic_accuracy(df, ["c"], "k")
    assert n == 400 and both > 0.95 and noise < 0.65


def test_causal_adjustment_and_placebo(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=2000)
    t = z + rng.normal(size=2000)
    y = 2 * t + 3 * z + rng.normal(size=2000)
    df = spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(zip(z, t, y))], "id long, z double, t double, y double"
    )
    plain = causal.causal_effect(df, "t", "y").first()
    adjusted = causal.causal_effect(df, "t", "y", ["z"]).first()
    assert plain["effect"] > 3 and adjusted["effect"] == pytest.approx(2, abs=0.1)
    assert adjusted["ci_low"] < 2 < adjusted["ci_high"]
    check = causal.placebo_check(df, "t", "y", ["z"], "id").first()
    assert abs(check["placebo_effect"]) < 0.3 and check["passed"]


def test_selectors_find_the_signal(spark):
    df, _, _ = planted(spark)
    df = df.withColumn("a_copy", F.col("a") + F.col("d") * 0.01)
    drop = {r["feature"]: r["selected"] for r in select.select_by_correlation(df, "y").collect()}
    assert drop["a"] != drop["a_copy"]
    rfe = {r["feature"]: r["ranking"] for r in select.recursive_elimination(df.drop("a_copy"), "y", k=2).collect()}
    assert rfe["a"] == rfe["b"] == 1 and max(rfe.values()) == 3
    best = select.recursive_elimination(df.drop("a_copy"), "y")
    assert {"a", "b"} <= {r["feature"] for r in best.where("selected").collect()}
    forest = select.recursive_elimination(df.drop("a_copy"), "y", k=2, estimator="forest", trees=5)
    assert {r["feature"] for r in forest.where("selected").collect()} == {"a", "b"}
    for method in ("mutual_info", "univariate"):
        out = select.select_features(df.drop("a_copy"), "y", method, k=2)
        assert {r["feature"] for r in out.where("selected").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        select.select_features(df, "y", "magic")


def test_bayes_regression_recovers_weights(spark):
    df, _, _ = planted(spark)
    model = bayes.BayesianRegression(df, list("abcd"), "y")
    assert model.coef == pytest.approx([3, -2, 0, 0], abs=0.03)
    out = model.predict(df).agg(F.avg(((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high"))).cast("double"))).first()[0]
    assert 0.9 < out <= 1
    assert all(r["std"] > 0 for r in model.predict(df).limit(5).collect())


def test_permutation_importance_order(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, _, _ = planted(spark)
    data = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    model = LinearRegression(labelCol="y").fit(data)
    out = {r["feature"]: r["importance"] for r in select.permutation_importance(model, df, list("abcd"), "y").collect()}
    assert out["a"] > out["b"] > 0.1 > abs(out["c"])
    assert math.isfinite(out["d"])


def test_many_tests_share_passes(spark):
    df, _, _ = planted(spark)
    lists = [["a"], ["a", "b"], ["c"]]
    got = stats.auto_tests(df, lists, "y").orderBy("place").collect()
    for r, s in zip(got, lists):
        assert r["statistic"] == pytest.approx(stats.auto_test(df, s, "y").first()["statistic"])
    df = df.withColumn("k", F.when(F.col("a") > 0, "up").otherwise("down"))
    got = stats.auto_tests(df, lists, "k").orderBy("place").collect()
    for r, s in zip(got, lists):
        one = stats.auto_test(df, s, "k").first()
        assert r["test"] == one["test"] and r["statistic"] == pytest.approx(one["statistic"])
