"""Profiling, cleaning, encoding and feature generation on literal tables."""

import pytest
from pyspark.sql import functions as F

from tabulant.operators import clean, encode, features, profile


def test_median_and_mode_fill(messy):
    rows = clean.handle_missing(messy, "median").collect()
    assert rows[2]["numeric_with_nulls"] == 3.0
    rows = clean.handle_missing(messy, "mode").collect()
    assert rows[2]["categorical_with_nulls"] == "X"


def test_drop_rows_and_sparse_columns(messy):
    assert clean.handle_missing(messy, "drop").count() == 4
    sparse = messy.withColumn("mostly_null", F.when(F.col("numeric_clean") == 1, F.lit(1.0)))
    assert "mostly_null" not in clean.drop_sparse_columns(sparse).columns
    with pytest.raises(ValueError):
        clean.handle_missing(messy, "guess")


def test_outliers(messy):
    flagged = clean.outliers_iqr(messy, ["numeric_with_outliers"])
    hit = [r["numeric_with_outliers"] for r in flagged.where("numeric_with_outliers_outlier").collect()]
    assert hit == [1000]
    kept = clean.remove_outliers(flagged)
    assert kept.count() == 4 and kept.columns == messy.columns
    constant = messy.withColumn("c", F.lit(1.0))
    assert clean.outliers_zscore(constant, ["c"]).where("c_outlier").count() == 0


def test_types(spark):
    df = spark.createDataFrame(
        [("1", "a", "1"), ("2", "b", "text"), ("3", "c", "3")],
        "numeric_str string, text_str string, mixed string",
    )
    out = clean.normalize_types(df)
    assert dict(out.dtypes) == {"numeric_str": "double", "text_str": "string", "mixed": "string"}
    low = spark.range(100).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("v"))
    assert clean.normalize_types(low).schema["v"].metadata == {"kind": "category"}


def test_validation_messages(spark, messy):
    df = messy.withColumn("none", F.lit(None).cast("double"))
    text = {r["column"]: r["message"] for r in profile.validate_data(df).collect()}
    assert "1 null values" in text["numeric_with_nulls"] and "only null" in text["none"]
    empty = profile.validate_data(messy.limit(0)).collect()
    assert [r["level"] for r in empty] == ["error"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = profile.profile_numeric(df).first()
    assert r["null_count"] == 1 and r["mean"] == 2.0 and r["median"] == 2.0


def test_target_type(spark):
    three = spark.createDataFrame([(i % 3,) for i in range(9)], "y long")
    four = spark.createDataFrame([(i % 4,) for i in range(9)], "y long")
    assert profile.target_type(three, "y").first()["kind"] == "categorical"
    assert profile.target_type(four, "y").first()["kind"] == "continuous"


def test_interactions_and_powers(spark):
    df = spark.createDataFrame([(1, 4, "x"), (2, 5, "y"), (3, 6, "z")], "A long, B long, C string")
    out = features.interaction_features(df, ["A", "B"])
    assert [r["A_B_interaction"] for r in out.orderBy("A").collect()] == [4, 10, 18]
    out = features.polynomial_features(df, ["A"], 3)
    assert [r["A_pow_3"] for r in out.orderBy("A").collect()] == [1, 8, 27]


def test_encoders(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None), (3, "b")], "k long, c string")
    label = {r["k"]: r["c_encoded"] for r in encode.encode_label(df, ["c"]).collect()}
    assert label == {0: 1, 1: 0, 2: None, 3: 1}
    hot = encode.encode_one_hot(df, ["c"])
    assert hot.columns == ["k", "c_a", "c_b"]
    assert [tuple(r) for r in hot.where("k = 2").collect()] == [(2, 0, 0)]
    freq = {r["k"]: r["c_freq_encoded"] for r in encode.encode_frequency(df, ["c"]).collect()}
    assert freq[0] == pytest.approx(2 / 3) and freq[2] is None
    with pytest.raises(ValueError):
        encode.encode_ordinal(df, ["c"], {"c": ["a"]})
    with pytest.warns(UserWarning):
        assert "c_a" in encode.encode_categoricals(df, method="magic").columns


def test_target_mean_leaves_out_own_fold(spark):
    df = spark.createDataFrame(
        [(i, "a" if i < 6 else "b", float(i)) for i in range(10)], "k long, c string, y double"
    )
    rows = df.collect()
    out = encode.encode_target_mean(df, ["c"], "y", "k").collect()
    overall = sum(r["y"] for r in rows) / 10
    for r in out:
        rest = [x["y"] for x in rows if x["c"] == r["c"] and x["k"] % 5 != r["k"] % 5]
        want = sum(rest) / len(rest) if rest else overall
        assert r["c_target_encoded"] == pytest.approx(want)


def test_scaling_constant_column(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, c double")
    assert {r["c"] for r in features.scale_standard(df).collect()} == {0.0}
    assert sorted(r["x"] for r in features.scale_minmax(df).collect()) == [0.0, 1.0]


def test_prepare_rejects_bad_arguments(messy):
    with pytest.raises(ValueError):
        features.prepare_features(messy, encoding_method="magic")
    with pytest.raises(ValueError):
        features.prepare_features(messy, numeric_transforms=["magic"])
    with pytest.raises(ValueError):
        features.prepare_features(messy.limit(0))


def test_auto_features_planted(spark):
    df = spark.range(200).select(
        (F.col("id") % 17 + 1.0).alias("a"), (F.col("id") % 5 - 2.0).alias("b")
    ).withColumn("y", F.col("a") * 2)
    out = features.auto_features(df, "y")
    assert {"a_log", "a_sqrt", "a_pow_2", "a_binned", "b_pow_2", "a_b_interaction", "a_div_b"} <= set(out.columns)
    assert "b_log" not in out.columns
