"""Sources, streams, words and the whole flow."""

import json

import pytest
from pyspark.sql import functions as F

from tabulant.operators import interpret
from tabulant.plans.analyze import analyze
from tabulant.sources import documents, files, paged, sql


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "head.csv"))
    (tmp_path / "latin.csv").write_bytes("a,b\n1,caf\xe9\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "latin.csv")).first()["b"] == "caf\xe9"


def test_formats():
    assert files.detect_format("s3a://b/k/x.parquet") == "parquet"
    assert files.detect_format("x.jsonl.gz") == "json"
    assert files.detect_format("x", "application/json") == "json"
    assert files.detect_format("x") == "csv"


def test_jdbc_options():
    with pytest.raises(ValueError):
        sql.jdbc_options("jdbc:x", "")
    plain = sql.jdbc_options("jdbc:x", "select 1")
    assert plain == {"url": "jdbc:x", "query": "select 1"}
    ranged = sql.jdbc_options("jdbc:x", "select * from t", "id", 0, 100, 4)
    assert ranged["dbtable"] == "(select * from t) q" and ranged["numPartitions"] == "4"
    with pytest.raises(ValueError):
        sql.jdbc_options("jdbc:x", "select 1", "id")


def test_answers(spark):
    bodies = ['[{"a": 1}]', '{"data": {"a": 2}}', '{"results": [{"a": 3}]}', '{"a": 4}', "[]"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert sorted(r["a"] for r in documents.normalize_responses(df).collect()) == [1, 2, 3, 4]
    bad = spark.createDataFrame([("7",)], "body string")
    with pytest.raises(Exception, match="no list or object"):
        documents.normalize_responses(bad, schema="a long").collect()


@pytest.mark.parametrize("kind", ["offset", "page", "cursor"])
def test_paging(spark, kind):
    def fetch(request):
        p = request["params"]
        assert request["headers"] == {"Authorization": "Bearer t"}
        if kind == "cursor":
            start = int(p.get("cursor", 0))
        else:
            start = p["offset"] if kind == "offset" else (p["page"] - 1) * p["per_page"]
        items = [{"v": i} for i in range(start, min(start + 7, 40))]
        out = {"data": items}
        if kind == "cursor" and start + 7 < 40:
            out["next_cursor"] = str(start + 7)
        return json.dumps(out)

    df = paged.read_pages(
        spark, f"pages_{kind}", fetch, "v long", paging=kind, page_size=7, partitions=3, auth="bearer", token="t"
    )
    assert sorted(r["v"] for r in df.collect()) == list(range(40))


def test_auth_kinds():
    assert paged.auth_headers("api_key", "k") == {"X-API-Key": "k"}
    assert paged.auth_headers(None, None) == {}
    with pytest.raises(ValueError):
        paged.auth_headers("magic", "k")


def hypotheses(spark):
    return spark.createDataFrame(
        [
            (0, ["age", "education"], 0.95, 0.8, 0.85, 0.1, 2.4),
            (1, ["income"], 0.85, 0.5, 0.6, 0.2, 1.75),
            (2, [], 0.5, 0.5, 0.5, 0.5, 0.0),
        ],
        "subset_id long, features array<string>, significance double, effect_size double, "
        "coverage double, parsimony double, fitness double",
    )


def test_words(spark):
    rows = {r["subset_id"]: r for r in interpret.label_hypotheses(hypotheses(spark)).collect()}
    assert rows[0]["confidence"] == "very high" and rows[0]["effect"] == "strong"
    assert "age and education" in rows[0]["sentence"] and "most" in rows[0]["coverage_text"]
    assert rows[1]["confidence"] == "moderate" and rows[1]["effect"] == "moderate"
    assert rows[2]["sentence"].startswith("No feature")
    summary = interpret.summarize_hypotheses(hypotheses(spark)).first()
    assert summary["hypotheses"] == 3 and summary["verdict"].startswith("early")
    none = interpret.summarize_hypotheses(hypotheses(spark).limit(0)).first()
    assert none["verdict"] == "no significant hypotheses"


def test_test_words(spark):
    df = spark.createDataFrame(
        [(0.01, 0.75, 0.6), (0.15, 0.3, 0.2), (0.08, 0.5, 0.4)],
        "p_value double, r_squared double, effect_size double",
    )
    text = [r["sentence"] for r in interpret.label_tests(df).orderBy("p_value").collect()]
    assert "75%" in text[0] and "practical importance" in text[0] and "large enough" in text[0]
    assert "marginally significant" in text[1]
    assert "not statistically significant" in text[2] and "30%" in text[2]


def test_analyze(spark):
    df = spark.range(400).select(
        (F.xxhash64("id") % 100 / 10).alias("a"),
        (F.xxhash64("id", F.lit(1)) % 100 / 10).alias("b"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("c"),
    ).withColumn("target", F.col("a") * 2 + F.when(F.col("c") == "x", 5).otherwise(0))
    out = analyze(df, search_options={"population": 10, "rounds": 4})
    best = out["hypotheses"].orderBy(F.desc("fitness")).first()
    assert "a" in best["features"] and out["summary"].count() == 1
    assert {"validation", "profile", "tests", "effects", "report_top", "report_weights"} <= set(out)


def test_the_analyze_query_runs_every_step(spark, monkeypatch):
    import tabulant.plans.analyze as plan
    from tabulant.operators.models import automl
    from tabulant.plans import queries_flow

    h = F.xxhash64("id")
    tables = {
        "customer": spark.range(40).select(
            F.col("id").alias("c_custkey"),
            F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.pmod(h, F.lit(3)) + 1).cast("int")).alias(
                "c_mktsegment"
            ),
            (F.pmod(h, F.lit(997)) / 10).alias("c_acctbal"),
        ),
        "orders": spark.range(300).select(
            F.col("id").alias("o_orderkey"),
            (F.col("id") % 40).alias("o_custkey"),
            F.when(F.pmod(h, F.lit(2)) == 0, "F").otherwise("O").alias("o_orderstatus"),
            F.when(F.pmod(h, F.lit(5)) < 2, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"),
            F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("o_orderdate"),
            (F.pmod(h, F.lit(9973)) + F.col("id")).cast("double").alias("o_totalprice"),
        ),
    }
    asked = {}

    def few(df, target, **options):
        asked.update(options)
        return automl(df, target, models=["linear"], folds=2, **options)

    monkeypatch.setattr(queries_flow, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(plan, "automl", few)
    rows = {r["stage"]: r["rows"] for r in queries_flow.q_analyze(spark, "").collect()}
    assert rows["selection"] > 1 and rows["leaderboard"] == 1
    assert rows["tests"] == rows["hypotheses"] and asked["features"]


def test_every_hypothesis_is_tested(spark, monkeypatch):
    import tabulant.plans.analyze as plan
    from tabulant.operators import search

    df = spark.range(200).select(
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) / 10).alias(c) for i, c in enumerate("abcd")]
    )
    df = df.withColumn("target", F.expr("a + 2 * b - c + d / 2"))
    names = [["a"], ["b"], ["c"], ["d"], ["a", "b"], ["a", "c"], ["a", "d"], ["b", "c"], ["b", "d"], ["c", "d"]]
    names += [["a", "b", "c"], ["a", "b", "c", "d"]]

    def given(df, target, features, **options):
        sets = df.sparkSession.createDataFrame(list(enumerate(names)), "subset_id long, features array<string>")
        return search.score_subsets(df, sets, target, features)

    monkeypatch.setattr(plan.search, "search_hypotheses", given)
    out = analyze(df, max_interactions=0)
    assert out["hypotheses"].count() == out["tests"].count() == len(names)


def test_every_query_has_a_callable():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
