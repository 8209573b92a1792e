"""The paths meant for big tables, forced on small ones, give the same answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulant.core.lookup import attach, sorted_codes, value_counts
from tabulant.core.ordered import exact_quantiles, positions, value_ranks
from tabulant.operators import front, search, series


def skewed(spark, n=3000):
    """One value and one series hold a third of all rows."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("x"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("s"),
        (F.col("id") % 2).cast("string").alias("g"),
    )


def test_exact_quantiles_by_selection(spark):
    df = skewed(spark)
    points = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    wanted = F.array(*[F.lit(p) for p in points])
    small = {c: df.agg(F.percentile(c, wanted)).first()[0] for c in ("x", "id")}
    big = exact_quantiles(df, ["x", "id"], points)
    for c in ("x", "id"):
        assert big[c] == pytest.approx(small[c])


def test_positions_with_a_hot_series(spark):
    df = skewed(spark)
    got = positions(df, "id", by=["s"]).toPandas().sort_values("id")
    want = got.groupby("s").cumcount()
    assert (got["position"] == want).all()
    whole = positions(df, "id").toPandas().sort_values("id")
    assert (whole["position"].to_numpy() == np.arange(len(whole))).all()


def test_value_ranks_with_a_hot_value(spark):
    df = skewed(spark)
    pdf = df.toPandas()
    pdf["r"] = pdf["x"].rank()
    want = pdf.groupby("g")["r"].sum()
    ties = sum(t**3 - t for t in pdf["x"].value_counts())
    for r in value_ranks(df, ["x"], "g").collect():
        assert r["rank_sum"] == pytest.approx(want[r["class"]])
        assert r["ties"] == pytest.approx(ties) and r["total"] == len(pdf)


def test_attach_beyond_the_broadcast_size(spark):
    df = skewed(spark)
    table = value_counts(df, "s", "__n").withColumn("m", F.col("__n") * 2)
    small = attach(df, table, ["s"], weight="__n")
    big = attach(df, table, ["s"], weight="__n", broadcast_rows=0)
    assert sorted(map(tuple, small.select("id", "m").collect())) == sorted(
        map(tuple, big.select("id", "m").collect())
    )
    assert big.count() == df.count()


def test_codes_beyond_one_window(spark):
    df = skewed(spark).withColumn("t", F.concat(F.lit("v"), F.col("x").cast("string")))
    small = {r["t"]: r["c"] for r in sorted_codes(df, "t", "c").collect()}
    big = {r["t"]: r["c"] for r in sorted_codes(df, "t", "c", small_rows=0).collect()}
    assert small == big and sorted(small.values()) == list(range(len(small)))


def series_table(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [
        (s, t, float(10 + 0.5 * t + 3 * np.sin(2 * np.pi * t / 7) + rng.normal()))
        for s in ("a", "b")
        for t in range(n if s == "a" else n // 3)
    ]
    return spark.createDataFrame(rows, "s string, t long, v double")


def test_series_blocks_do_not_change_results(spark):
    df = series_table(spark)

    def rows(frame):
        return sorted(
            tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in frame.collect()
        )

    for period in (6, 7):
        one = series.seasonal_decompose(df, "s", "t", "v", period)
        many = series.seasonal_decompose(df, "s", "t", "v", period, block_rows=9)
        assert rows(one.na.fill(-1)) == rows(many.na.fill(-1))
    for fn, kw in (
        (series.ar_forecast, {"season": 7}),
        (series.forecast, {}),
    ):
        one = fn(df, "s", "t", "v", **kw)
        many = fn(df, "s", "t", "v", block_rows=8, **kw)
        a, b = rows(one), rows(many)
        assert [r[:2] for r in a] == [r[:2] for r in b]
        assert [x for r in a for x in r[2:]] == pytest.approx([x for r in b for x in r[2:]])
    one = series.make_sequences(df, "s", "t", "v", 5).select("s", "position", "label")
    many = series.make_sequences(df, "s", "t", "v", 5, block_rows=7).select("s", "position", "label")
    assert rows(one) == rows(many) and len(rows(one)) == 55 + 15


def test_smoothing_forecast_against_a_plain_loop(spark):
    df = series_table(spark, 30)
    got = {(r["s"], r["step"]): r for r in series.forecast(df, "s", "t", "v").collect()}
    for s in ("a", "b"):
        y = [r["v"] for r in df.where(F.col("s") == s).orderBy("t").collect()]
        best = None
        for a in np.linspace(0.05, 0.95, 7):
            for b in np.linspace(0.05, 0.95, 7):
                level, trend, sse = y[0], y[1] - y[0], 0.0
                for v in y[1:]:
                    e = v - level - trend
                    sse += e * e
                    level, trend = level + trend + a * e, trend + a * b * e
                if best is None or sse < best[0] - 1e-9:
                    best = (sse, level, trend)
        assert got[(s, 3)]["forecast"] == pytest.approx(best[1] + 3 * best[2], rel=1e-6)


@pytest.mark.parametrize("cell", [5, 2_048])
def test_front_of_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(front, "CELL_POINTS", cell)
    rng = np.random.default_rng(5)
    p = np.round(rng.random((400, 3)), 2)
    p[:40] = [0.9, 0.9, 0.2]  # equal rows
    p[40:140, 0] = 0.5
    p[140:200] = np.round(np.linspace(0, 0.8, 60), 2)[:, None]
    p[300:] /= p[300:].sum(axis=1, keepdims=True) / 1.6  # a slope that is nearly all front
    rows = [(i, *map(float, r)) for i, r in enumerate(p)]
    rows += [(900, None, 0.99, 1.0), (901, float("nan"), 0.999, 1.0), (902, None, None, None)]
    q = np.array([[-np.inf if v is None or v != v else v for v in r[1:]] for r in rows])
    ge = (q[:, None, :] >= q[None, :, :]).all(axis=2)
    gt = (q[:, None, :] > q[None, :, :]).any(axis=2)
    want = sorted(rows[i][0] for i in np.where(~(ge & gt).any(axis=0))[0])
    df = spark.createDataFrame(rows, "i long, a double, b double, c double")
    got = front.pareto_front(df, ["a", "b", "c"], [])
    assert sorted(r["i"] for r in got.collect()) == want and got.columns == ["i", "a", "b", "c"]
    down = df.select("i", *[(-F.col(c)).alias(c) for c in "abc"])
    assert sorted(r["i"] for r in front.pareto_front(down, ["b"], ["a", "c"]).collect()) == sorted(
        r["i"] for r in front.pareto_front(df.withColumn("b", -F.col("b")), ["a", "b", "c"], []).collect()
    )
    assert front.pareto_front(df.limit(0), ["a"], []).isEmpty()
    assert [r["i"] for r in front.pareto_front(df, ["a"], []).orderBy("i").collect()] == [
        r[0] for r, v in zip(rows, q) if v[0] == q[:, 0].max()
    ]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_task_exchange_over_rows(spark, lines):
    """Rows are never gathered into one partition, apart from final aggregates."""
    plans = [
        positions(lines, "l_extendedprice", by=["l_suppkey"]),
        series.detect_trend(lines, "l_returnflag", "l_shipdate", "l_tax"),
    ]
    for df in plans:
        assert "SinglePartition" not in _exchanges(df)
        assert "CartesianProduct" not in _exchanges(df)


def test_wide_correlations_equal_narrow(spark, monkeypatch):
    from tabulant.operators import profile

    df = spark.range(300).select(
        F.when(F.col("id") % 7 != 0, F.rand(1)).alias("a"),
        (F.col("id") % 13).cast("double").alias("b"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("c"),
    )
    narrow = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    monkeypatch.setattr(profile, "NARROW", 1)
    wide = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    assert wide == pytest.approx(narrow) and len(wide) == 9


def test_positions_with_a_hot_order_value(spark):
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 != 0, F.lit(5.0)).otherwise(F.col("id") / 90).alias("v")
    )
    rows = positions(df, "v", parts=16).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(900))
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows)


def test_runs_of_blocks(spark, monkeypatch):
    df = series_table(spark, 40)
    one = series.forecast(df, "s", "t", "v", block_rows=3).orderBy("s", "step").collect()
    monkeypatch.setattr(series, "BLOCKS_PER_RUN", 2)
    many = series.forecast(df, "s", "t", "v", block_rows=3).orderBy("s", "step").collect()
    assert [r["forecast"] for r in one] == pytest.approx([r["forecast"] for r in many])


def test_shuffle_keeps_the_values(spark):
    from tabulant.core.shuffle import shuffle_column

    df = spark.range(500).select((F.col("id") * 0).alias("k"), (F.col("id") % 50).alias("v"))
    out = shuffle_column(df, "v")
    assert out.groupBy("v").count().where("count <> 10").count() == 0 and out.count() == 500


def test_quantile_codes_are_searched(spark):
    """Codes by binary search equal the comparisons, and score plans stay short enough to compile."""
    from tabulant.operators.features import quantile_code, with_quantile_codes
    from tabulant.operators.select import mutual_information

    inf = float("inf")
    values = [None, -inf, -2.0, -0.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, inf]
    df = spark.createDataFrame([(v, v, v, v, v, "k") for v in values], "a double, b double, c double, d double, e double, k string")
    edges = {
        "a": [-2.0, -0.0, 1.0, 2.0],
        "b": [0.0, 0.0, 0.0, 1.0, 1.0, 3.0],
        "c": [1.0],
        "d": [],
        "e": [-inf, 0.5, inf, inf, inf],
    }
    got = with_quantile_codes(df, edges).collect()
    want = df.select(*[quantile_code(F.col(c), es).alias(c) for c, es in edges.items()], "k").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    wide = spark.range(200).select(
        *[(F.hash("id", F.lit(i)) % 97).cast("double").alias(f"x{i}") for i in range(6)]
    )
    scores = mutual_information(wide, "x5", classes=False)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">=") < 10 and scores.count() == 5
