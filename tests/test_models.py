"""Clusters, models, evaluation and search: invariants and planted structure."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabulant.core.components import connected_components
from tabulant.operators import cluster, density, evaluate, models, search, tuning


def brute_dbscan(p, eps, m):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= m
    label = -np.ones(len(p), dtype=int)
    k = 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                j = stack.pop()
                for n in np.where(d[j] & core & (label < 0))[0]:
                    label[n] = k
                    stack.append(n)
            k += 1
    border = ~core & (d & core[None]).any(axis=1)
    return core, label, border


def same_clusters(got, core, label, border):
    got = got.sort_values("i")
    assert (got["core"].to_numpy() == core).all()
    mine = got["cluster"].to_numpy()
    pairs = {(a, b) for a, b, c in zip(label, mine, core) if c}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert ((mine == -1) == (~core & ~border)).all()
    return mine


@pytest.mark.parametrize("cell", [512, 6])
def test_dbscan_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(density, "CELL_POINTS", cell)
    rng = np.random.default_rng(2)
    blobs = [rng.normal(c, 0.35, size=(60, 2)) for c in ((0, 0), (3, 0), (0, 4))]
    line = np.column_stack([np.linspace(6, 9, 40), np.full(40, 2.0)])
    copies = np.tile([[20.0, 20.0]], (200, 1))
    p = np.concatenate([*blobs, line, copies, rng.uniform(-3, 10, size=(30, 2))])
    core, label, border = brute_dbscan(p, 0.5, 5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(p)]
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "i long, x double, y double")
    got = density.dbscan(df, ["x", "y"], 0.5, 5).toPandas()
    assert got[got["i"] == 999][["core", "cluster"]].isna().all(axis=None)
    same_clusters(got[got["i"] != 999], core, label, border)


def test_dbscan_of_wide_points_with_a_hot_region(spark, monkeypatch):
    monkeypatch.setattr(density, "CELL_POINTS", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64)) * 2
    hot = centres[0] + rng.normal(size=(500, 64)) * 0.03
    near = hot[:80] + rng.normal(size=(80, 64)) * 0.12
    rest = centres[rng.integers(1, 6, 300)] + rng.normal(size=(300, 64)) * 0.18
    p = np.concatenate([hot, near, rest, rng.normal(size=(60, 64)) * 2])
    core, label, border = brute_dbscan(p, 1.6, 8)
    assert 0 < core.sum() < len(p) and border.any()
    names = [f"v{i}" for i in range(64)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(p)], ["i", *names])
    got = density.dbscan(df, names, 1.6, 8).toPandas()
    mine = same_clusters(got, core, label, border)
    # a border point joins the smallest cluster in reach
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) <= 1.6
    for i in np.flatnonzero(border):
        assert mine[i] == min(mine[j] for j in np.flatnonzero(d[i] & core))


def test_long_chain_components(spark):
    nodes = spark.range(64).select(F.col("id").alias("node"))
    edges = spark.range(63).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a != 40")
    labels = connected_components(nodes, edges).collect()
    assert len(labels) == 64 and {r["label"] for r in labels} == {0, 41}


def test_agreement_of_labelings(spark):
    rows = [(i, i % 3, (i % 3) if i % 10 else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, a int, b int")
    same = evaluate.adjusted_mutual_information(df, "a", "a").first()["adjusted_mutual_information"]
    near = evaluate.adjusted_mutual_information(df, "a", "b").first()["adjusted_mutual_information"]
    noise = evaluate.adjusted_mutual_information(
        df.withColumn("r", F.pmod(F.xxhash64("i"), F.lit(3))), "a", "r"
    ).first()["adjusted_mutual_information"]
    assert same == pytest.approx(1) and 0.5 < near < 1 and abs(noise) < 0.05
    assert evaluate.adjusted_rand(df, "a", "a").first()[0] == pytest.approx(1)


def test_clusters_need_two(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(5)], "x double, c int")
    r = evaluate.clustering_metrics(df, ["x"], "c").first()
    assert r["n_clusters"] == 1 and r["silhouette"] is None


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    sizes = evaluate.stratified_kfold(df, "y", "id").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    with pytest.raises(ValueError):
        evaluate.stratified_kfold(df, "missing", "id")


def test_models_learn_and_survive_saving(spark, tmp_path):
    df = spark.range(300).select(
        (F.col("id") % 10).cast("double").alias("a"),
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("t"),
        (F.rand(3)).alias("noise"),
    ).withColumn("y", F.when(F.col("a") > 4, "big").otherwise("small"))
    m = models.fit_forest(df, ["a", "t", "noise"], "y", trees=5)
    out = evaluate.classification_metrics(m.predict(df), "y", "prediction").first()
    assert out["accuracy"] > 0.95
    m.save(str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    assert again.predict(df).where("prediction <> y").count() == m.predict(df).where("prediction <> y").count()
    three = df.withColumn("k", F.floor(F.col("a") / 4))
    b = models.fit_boosted(three, ["a"], "k", rounds=3, depth=2, classes=True)
    assert evaluate.classification_metrics(b.predict(three), "k", "prediction").first()["accuracy"] > 0.95
    for kind in ("logistic", "svm"):
        model = models.fit_linear(df, ["a", "noise"], "y", kind, iterations=20)
        assert model.predict(df).where("prediction = y").count() > 250


def test_pairs_of_cells_are_no_join_of_guessed_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(400, 6))
    names = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], ["i", *names])
    monkeypatch.setattr(density, "CELL_POINTS", 8)
    plans, cut = [], density.cut_lineage

    def seen(df):
        if "cell_a" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(density, "cut_lineage", seen)
    got = density.dbscan(df, names, 1.5, 4).toPandas()
    same_clusters(got, *brute_dbscan(p, 1.5, 4))
    # pairs are many times the file they come from: Spark took them for few and broadcast them
    assert plans and not any("explode" in x.lower() for x in plans)


def test_linked_cells_are_not_compared_again(monkeypatch):
    rng = np.random.default_rng(4)
    cells, points = range(12), {}
    for c in cells:
        x = rng.normal(scale=0.2, size=(6, 3))
        pid = np.arange(6) + 10 * c
        core = np.ones(6, np.int64)
        core[5] = 0
        points[c] = (pid, np.ones(6, np.int64), core, np.where(core == 1, pid[0], -1), x)
    pairs = [(a, b) for a in cells for b in cells if a <= b]
    sizes, near = [], density._near

    def counted(a, b, eps):
        sizes.append(len(a) * len(b))
        return near(a, b, eps)

    monkeypatch.setattr(density, "_near", counted)
    found = density._linker(1.0)(points, pairs).to_pandas()
    links = found[found["pid"].isna()]
    assert len(links) == 11 and len(set(links["a"]) | set(links["b"])) == 12
    assert len(found) == 11 + 12  # each point without core once
    assert sum(sizes) < 36 * len(pairs) / 2
    sizes.clear()
    counts = density._counter(1.0, 4)(points, pairs).to_pandas()
    assert (counts["near"] >= 4).all() and len(counts) == 72 and sum(sizes) < 36 * len(pairs) / 4


def test_near_points_at_the_edge():
    rng = np.random.default_rng(5)
    for shift, scale in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-12), (0.0, 1e20)):
        a = np.round(rng.integers(-4, 5, size=(200, 3)).astype(float)) * scale + shift
        b = np.round(rng.integers(-4, 5, size=(150, 3)).astype(float)) * scale + shift
        for eps in (1.0 * scale, 3.0 * scale, 1e9 * scale):
            gap = a[:, None, :] - b[None, :, :]
            assert (density._near(a, b, eps) == (np.einsum("ijk,ijk->ij", gap, gap) <= eps * eps)).all()


def test_automl_on_a_hypothesis(spark):
    df = spark.range(200).select(
        "id", (F.col("id") % 13).cast("double").alias("a"), F.rand(1).alias("noise")
    ).withColumn("y", F.col("a") * 3 + F.col("noise"))
    out = models.automl(
        df, "y", ["a"], row_key="id", folds=2, models=["linear", "forest"], settings={"forest": {"numTrees": 10}}
    )
    assert out.task == "regression" and out.best_name in ("linear", "forest")
    assert out.leaderboard.orderBy("rank").first()["cv_mean"] > 0.9
    assert "prediction" in out.predict(df).columns


def test_pca_round_trip(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 1)) @ np.array([[1.0, 2.0, -1.0]]) + 0.01 * rng.normal(size=(200, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    model = cluster.fit_pca(df, ["a", "b", "c"], k=1, scale=False)
    assert model.share[0] > 0.99
    back = model.inverse(model.transform(df)).toPandas().to_numpy()
    assert np.abs(np.sort(back[:, 0]) - np.sort(x[:, 0])).max() < 0.1


def test_tuning(spark):
    df = spark.range(120).select((F.col("id") % 11).cast("double").alias("a"), "id")
    df = df.withColumn("label", F.col("a") * 2)
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    data = evaluate.kfold(data, 2, "id")
    space = {"regParam": [0.0, 5.0, -1.0]}
    out = tuning.tune(data, LinearRegression(), space, classes=False)
    assert out.best_params == {"regParam": 0.0}
    assert out.trials.where("error is not null").count() == 1
    assert len(tuning.choose_settings({"x": tuning.Span(0, 1), "k": tuning.Span(1, 3, integer=True)})) == 15
    assert tuning.random_settings({"x": tuning.Span(0.1, 10, log=True)}, 3) == tuning.random_settings(
        {"x": tuning.Span(0.1, 10, log=True)}, 3
    )


def planted(spark):
    return spark.range(600).select(
        *[((F.xxhash64(F.col("id"), F.lit(i)) % 1000) / 1000).alias(c) for i, c in enumerate("abcde")]
    ).withColumn("y", F.col("a") * 2 - F.col("c"))


def test_search_finds_the_planted_subset(spark):
    df = planted(spark)
    found = search.search_hypotheses(df, "y", population=16, rounds=8)
    rows = found.collect()
    full = [r for r in rows if r["coverage"] > 0.999]
    assert min(len(r["features"]) for r in full) == 2
    assert {"a", "c"} <= set(min(full, key=lambda r: len(r["features"]))["features"])
    again = search.search_hypotheses(df, "y", population=16, rounds=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_search_for_classes(spark):
    df = planted(spark).withColumn("k", F.when(F.col("a") > 0, "up").otherwise("down")).drop("y")
    found = search.search_hypotheses(df, "k", population=8, rounds=3)
    best = found.orderBy(F.desc("fitness")).first()
    assert "a" in best["features"] and best["coverage"] > 0.95


def test_empty_subset_and_local_search(spark):
    df = planted(spark)
    cands = spark.createDataFrame([(0, []), (1, ["a"])], "subset_id long, features array<string>")
    scored = search.score_subsets(df, cands, "y")
    empty = scored.where("subset_id = 0").first()
    assert [empty[c] for c in search.SCORES] == [0, 0, 0, 1]
    better = search.local_search(df, scored, "y", elite_fraction=1.0)
    one = better.where("subset_id = 1").first()
    assert one["improved"] and sorted(one["features"]) == ["a", "c"]


def test_stability(spark):
    out = {r["feature"]: r["stability"] for r in search.stability_selection(planted(spark), "y", samples=3, population=12, rounds=6).collect()}
    assert out["a"] == 1.0 and set(out) == set("abcde")


def test_vote_without_agreement(spark):
    lists = spark.createDataFrame(
        [("x", 2.0, ["a"]), ("y", 1.0, ["b"])], "selector string, fitness double, features array<string>"
    )
    picked = {r["feature"]: r["selected"] for r in search.ensemble_vote(lists).collect()}
    assert picked == {"a": True, "b": False}


def test_holdout_keeps_rare_classes(spark):
    df = spark.range(1010).select("id", F.when(F.col("id") < 10, "rare").otherwise("common").alias("y"))
    out = evaluate.holdout(df, "y", "id", folds=5).cache()
    count = {(r.y, r.test): r["count"] for r in out.groupBy("y", "test").count().collect()}
    assert count == {("rare", True): 2, ("rare", False): 8, ("common", True): 200, ("common", False): 800}
    folds = out.where("not test").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r.y == "common"} == {160}
    assert {r["count"] for r in folds if r.y == "rare"} == {1, 2} and len(folds) == 10
    assert out.where("test and fold is not null").isEmpty()
    assert evaluate.holdout(df, share=0.3).where("test").count() == 303


def test_automl_of_a_rare_class(spark):
    df = spark.range(400).select(
        "id",
        F.when(F.col("id") < 10, 9.0).otherwise(F.col("id") % 7).alias("a"),
        F.when(F.col("id") < 10, "rare").otherwise("common").alias("y"),
    )
    out = models.automl(df, "y", ["a"], row_key="id", folds=2, models=["logistic", "forest"], settings={"forest": {"numTrees": 5}})
    best = out.leaderboard.orderBy("rank").first()
    assert out.task == "classification" and best["cv_mean"] == best["test_value"] == 1.0


def test_automl_compares_three_clusterers(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(0, 2 * np.pi, 300)
    rows = [(float(np.cos(a) * r), float(np.sin(a) * r)) for a, r in zip(t, np.repeat([1.0, 1.02, 0.0], 100))]
    df = spark.createDataFrame([*rows, (None, 1.0)], "x double, y double")
    out = models.automl(df, settings={"dbscan": {"eps": 0.3}})
    board = {r["model"]: r["cv_mean"] for r in out.leaderboard.collect()}
    assert set(board) == {"kmeans", "mixture", "dbscan"}
    found = out.models["dbscan"](df)
    assert found.count() == 300 and found.select("cluster").distinct().count() == 2


def test_a_density_cell_is_sent_once_per_block(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCKS", 3)
    x = np.random.default_rng(2).normal(size=(60, 3))
    rows = [(i // 2, i, 1, 0, 0, r) for i, r in enumerate(x.tolist())]
    points = spark.createDataFrame(rows, "cell long, pid long, w long, core long, comp long, x array<double>")
    pairs = [(a, b) for a in range(30) for b in range(a, 30)]

    def tell(cells, own):
        return pa.table({"sent": [len(cells)], "compared": [len(own)]})

    frame = spark.createDataFrame(pairs, "cell_a long, cell_b long")
    out = density._met(frame, density._blobs(points), tell, "sent long, compared long").collect()
    assert sum(r.compared for r in out) == len(pairs)
    assert sum(r.sent for r in out) == 3 * 30  # two per pair of cells would be 930


def test_near_rows_by_products_are_those_by_differences():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 8)) + 1e4
    b = np.concatenate([a[:50], a[:50] + 0.5 / np.sqrt(8), rng.normal(size=(50, 8)) + 1e4])
    assert (density._near(a, b, 0.5) == (density._distances(a, b) <= 0.25)).all()


def test_trees_on_merged_rows(spark, monkeypatch):
    """Equal rows are one row with a weight: boosting gives the same model, a forest keeps its sums."""
    rows = [(i, i % 7, "uvw"[i % 3], float((i % 7) ** 2 + (i % 11)), i / 7.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a int, t string, y double, x double")
    options = {"rounds": 3, "depth": 3, "classes": False}
    plain = models.fit_boosted(df, ["a", "t"], "y", **options).predict(df)
    before = {r["id"]: r["prediction"] for r in plain.collect()}
    monkeypatch.setattr(models, "TREE_ROWS", 500)
    sizes = []
    merged = models.merged_rows
    monkeypatch.setattr(models, "merged_rows", lambda *a: sizes.append(merged(*a)) or sizes[-1])
    after = models.fit_boosted(df, ["a", "t"], "y", **options).predict(df).collect()
    assert sizes[0].count() == 21
    assert max(abs(before[r["id"]] - r["prediction"]) for r in after) < 1e-9
    # a column of distinct numbers is cut into bins, and every row is in the weights
    forest = models.fit_forest(df, ["a", "x"], "t", trees=3, depth=4)
    assert sizes[1].count() <= 500 + 7 * 32 * 3 and sizes[1].agg({"weight": "sum"}).first()[0] == 3000
    assert abs(forest.importance(spark).agg({"score": "sum"}).first()[0] - 1) < 1e-9
    assert forest.predict(df).where("prediction in ('u', 'v', 'w')").count() == 3000
    out = models.automl(
        df, "y", ["a", "t"], row_key="id", folds=2, models=["linear", "forest"], settings={"forest": {"numTrees": 3}}
    )
    assert {r["model"] for r in out.leaderboard.collect()} == {"linear", "forest"}
    assert sizes[2].agg({"weight": "sum"}).first()[0] == 2400
    assert out.models["forest"].predict(df).where("prediction is not null").count() == 3000
