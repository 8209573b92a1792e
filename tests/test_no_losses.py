"""Nothing is dropped, cut or reordered by size."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulant.core.lookup import attach
from tabulant.core.ordered import positions
from tabulant.operators.encode import encode_one_hot
from tabulant.operators.evaluate import adjusted_mutual_information, stratified_kfold
from tabulant.operators.profile import target_type
from tabulant.sources.files import read_csv
from tabulant.sources.paged import read_pages
from tabulant.sources.sql import variant_type_to_ddl
from tabulant.streaming.chunks import open_stream, stream_chunks


def test_mutual_information_of_many_sizes(spark):
    rows = [(f"a{i}", f"b{(i * 7 + j) % 5}") for i in range(12) for j in range(i + 1)]
    got = adjusted_mutual_information(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    n, both = len(rows), Counter(rows)
    a, b = Counter(x for x, _ in rows), Counter(y for _, y in rows)
    mi = sum(c / n * math.log(n * c / (a[x] * b[y])) for (x, y), c in both.items())
    assert abs(got.mutual_information - mi) < 1e-9


@pytest.mark.parametrize("paging", ["offset", "page"])
def test_service_that_caps_its_pages(spark, paging):
    def fetch(request):
        p = request["params"]
        if "start" in p:
            at = p["start"]
        else:
            at = (p["nr"] - 1) * 100
        return {"data": [{"id": i} for i in range(at, min(at + 100, 1000))]}

    got = read_pages(
        spark, f"capped_{paging}", fetch, "id long", paging=paging, page_size=250, partitions=3,
        names={"offset": "start", "page": "nr"},
    )
    assert sorted(r.id for r in got.collect()) == list(range(1000))


def test_service_with_a_short_page_in_the_middle(spark):
    def fetch(request):
        at = request["params"]["offset"]
        many = 60 if at == 300 else 100
        return [{"id": i} for i in range(at, min(at + many, 1000))]

    got = read_pages(spark, "uneven", fetch, "id long", page_size=100, partitions=3)
    assert sorted(r.id for r in got.collect()) == list(range(1000))


def test_replacement_character_is_utf8(spark, tmp_path):
    path = f"{tmp_path}/a.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("name\ncafé\nbad �\n")
    assert [r.name for r in read_csv(spark, path).collect()] == ["café", "bad �"]
    with open(path, "w", encoding="latin-1") as f:
        f.write("name\ncafé\n")
    assert read_csv(spark, path).first().name == "café"


def test_all_chunks_are_counted(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    for i in range(120):
        with open(f"{tmp_path}/in/{i:03d}.json", "w") as f:
            f.write(f'{{"v": {i}}}\n')
    seen = []
    stream = open_stream(spark, f"{tmp_path}/in", "v long", fmt="json")
    n = stream_chunks(stream, lambda df, k: seen.append(k), f"{tmp_path}/done")
    assert n == len(seen) == 120


def test_one_hot_of_many_values(spark):
    df = spark.range(1100).select(F.col("id").cast("string").alias("t"))
    assert len(encode_one_hot(df, ["t"]).columns) == 1100
    with pytest.raises(ValueError):
        encode_one_hot(df, ["t"], max_values=1000)
    assert target_type(df, "t").first().kind == "continuous"


def test_order_of_large_integers(spark):
    base = 2**60
    df = spark.range(64).select((F.lit(base) + (F.col("id") * 37) % 64).alias("k"), F.lit("x").alias("y"))
    got = {r.k: r.position for r in positions(df, "k", parts=8).collect()}
    assert got == {base + i: i for i in range(64)}
    folds = {r.k: r.fold for r in stratified_kfold(df, "y", "k", 4).collect()}
    assert [folds[base + i] for i in range(8)] == [0, 1, 2, 3, 0, 1, 2, 3]


def test_lookups_read_the_rows_once(spark, tmp_path):
    spark.range(400).selectExpr("id", "id % 7 AS a", "id % 3 AS b", "id % 2 AS c").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = df
    for c in "abc":
        table = df.groupBy(c).agg(F.count("*").alias("n"), F.max("id").alias(f"top_{c}"))
        out = attach(out, table, [c], weight="n", broadcast_rows=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("a#") and sum("id#" in x and "Relation" in x for x in plan.splitlines()) == 1
    want = {(i, max(j for j in range(400) if j % 7 == i % 7)) for i in range(400)}
    assert {(r.id, r.top_a) for r in out.collect()} == want and out.count() == 400


def test_types_of_documents():
    text = "OBJECT<VOIDED: BIGINT, a: VOID, `x: VOID`: ARRAY<OBJECT<DECIMAL: DECIMAL(3,1), v: VARIANT>>, big: DECIMAL(30,2)>"
    assert variant_type_to_ddl(text) == (
        "STRUCT<VOIDED: BIGINT, a: STRING, `x: VOID`: ARRAY<STRUCT<DECIMAL: DOUBLE, v: STRING>>, big: DECIMAL(30,2)>"
    )


def test_groups_of_equal_values_have_one_mean_in_any_order(spark):
    from tabulant.plans.queries_search import exact_mean

    values = [0.1, 0.2, 0.3]
    rows = [(g, v) for g, turn in enumerate((1, -1)) for v in values[::turn]]
    out = spark.createDataFrame(rows, "g long, v double").coalesce(1).groupBy("g").agg(exact_mean("v").alias("m"))
    assert (0.1 + 0.2) + 0.3 != (0.3 + 0.2) + 0.1
    assert len({r.m for r in out.collect()}) == 1


def test_pca_moves_wide_rows_by_a_short_plan(spark):
    import numpy as np

    from tabulant.operators import cluster

    width = 40
    x = np.random.default_rng(3).normal(size=(60, width))
    names = [f"c{i}" for i in range(width)]
    rows = [(i, *r) for i, r in enumerate(x.tolist())] + [(60, None, *x[0, 1:].tolist())]
    df = spark.createDataFrame(rows, "row long, " + ", ".join(f"{c} double" for c in names))
    model = cluster.fit_pca(df, names)
    moved = model.transform(df)
    assert len(moved._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert moved.columns == df.columns + [f"pc_{i}" for i in range(width)]
    got = {r.row: r for r in moved.collect()}
    want = (x - model.mean) / model.scale @ model.vectors
    assert np.allclose([[got[i][f"pc_{j}"] for j in range(width)] for i in range(60)], want, atol=1e-9)
    assert all(got[60][f"pc_{j}"] is None for j in range(width))
    back = {r.row: r for r in model.inverse(moved).collect()}
    assert np.allclose([[back[i][c] for c in names] for i in range(60)], x, atol=1e-9)
    assert all(back[60][c] is None for c in names)
