"""Queries for the search of feature subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulant.operators import front, search
from tabulant.plans.registry import query, rounded, table

COLUMNS = ["l_quantity", "l_discount", "l_tax", "net", "line"]
TARGET = "volume"


def subject(spark, sf):
    """Lines with a price volume to explain and columns that do and do not explain it."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"),
        (F.col("l_extendedprice") * F.col("l_quantity")).alias(TARGET),
        "l_quantity",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.col("l_linenumber").cast("double").alias("line"),
    )


SUBJECT_SQL = """x AS (SELECT l_orderkey * 10 + l_linenumber AS row_key,
    l_extendedprice * l_quantity AS volume, l_quantity, l_discount, l_tax,
    l_extendedprice * (1 - l_discount) AS net, l_linenumber::DOUBLE AS line FROM lineitem)"""


def singles(spark):
    return spark.createDataFrame(
        [(i, [c]) for i, c in enumerate(COLUMNS)], "subset_id long, features array<string>"
    )


@query(
    "score_subsets",
    f"WITH {SUBJECT_SQL} "
    + " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS subset_id, '{c}' AS subset,
        round(abs(corr({c}, volume)), 6) AS effect_size, round(regr_r2(volume, {c}), 6) AS coverage,
        round(0.2::DOUBLE, 6) AS parsimony FROM x"""
        for i, c in enumerate(COLUMNS)
    ),
)
def q_score_subsets(spark, sf):
    out = search.score_subsets(subject(spark, sf), singles(spark), TARGET, COLUMNS)
    return rounded(
        out.select(
            "subset_id",
            F.array_join("features", ",").alias("subset"),
            "effect_size",
            "coverage",
            "parsimony",
        ),
        6,
    )


@query("score_subsets_classes")
def q_score_classes(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_discount", "l_tax"]
    cands = spark.createDataFrame(
        [(0, ["l_quantity"]), (1, ["l_quantity", "l_tax"]), (2, [])],
        "subset_id long, features array<string>",
    )
    return search.score_subsets(df, cands, "l_returnflag", cols).withColumn(
        "features", F.array_join("features", ",")
    )


def _flat(df):
    return df.withColumn("features", F.array_join("features", ","))


@query("search_hypotheses")
def q_search(spark, sf):
    return _flat(
        search.search_hypotheses(subject(spark, sf), TARGET, COLUMNS, population=20, rounds=8)
    )


@query("search_hypotheses_classes")
def q_search_classes(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    df = df.withColumn("fr", (F.col("lang") == "fr").cast("double"))
    return _flat(
        search.search_hypotheses(
            df, "quality", ["n_chars", "fr", "toxic"], population=8, rounds=3, adaptive=True
        )
    )


FRONT = """d AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t,
    count(*) AS n FROM lineitem GROUP BY 1)"""


def exact_mean(column: str):
    """The mean from a decimal sum: groups of equal values tie in whatever order they are added."""
    return F.sum(F.col(column).cast("decimal(38,18)")).cast("double") / F.count(column)


@query(
    "pareto_front",
    f"""WITH {FRONT}
    SELECT l_suppkey, round(q, 6) AS q, round(d, 6) AS d, round(t, 6) AS t, n FROM d a
    WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.q >= a.q AND b.d >= a.d AND b.t >= a.t
      AND b.n <= a.n AND (b.q > a.q OR b.d > a.d OR b.t > a.t OR b.n < a.n))""",
)
def q_front(spark, sf):
    groups = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            exact_mean("l_quantity").alias("q"),
            exact_mean("l_discount").alias("d"),
            exact_mean("l_tax").alias("t"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return rounded(front.pareto_front(groups, ["q", "d", "t"], ["n"]), 6)


@query("local_search")
def q_local(spark, sf):
    df = subject(spark, sf)
    scored = search.score_subsets(df, singles(spark), TARGET, COLUMNS)
    return _flat(search.local_search(df, scored, TARGET, COLUMNS, 0.4))


@query(
    "prefilter",
    f"WITH {SUBJECT_SQL}, s AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(regr_slope(volume, {c})) AS v FROM x" for c in COLUMNS
    )
    + """), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, feature) AS rank FROM s)
    SELECT feature, round(v, 2) AS score, rank, rank <= 2 AS selected FROM r""",
)
def q_prefilter(spark, sf):
    return rounded(search.prefilter(subject(spark, sf), TARGET, COLUMNS, 0.5, "causal"), 2)


@query("stability_selection")
def q_stability(spark, sf):
    return search.stability_selection(
        subject(spark, sf), TARGET, COLUMNS, samples=4, row_key="row_key", population=12, rounds=5
    )


@query(
    "ensemble_vote",
    """WITH v AS (SELECT l_returnflag AS selector, l_suppkey AS f, sum(l_quantity) AS q FROM lineitem
          GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY selector ORDER BY q DESC, f) AS r FROM v),
    w AS (SELECT selector, round(avg(l_quantity), 6) AS fit FROM
          (SELECT l_returnflag AS selector, l_quantity FROM lineitem) GROUP BY 1),
    n AS (SELECT 's' || f AS feature, count(DISTINCT selector) AS votes, sum(fit) AS weight
          FROM k JOIN w USING (selector) WHERE r <= 10 GROUP BY 1),
    p AS (SELECT *, max(votes) OVER () AS most, count(*) OVER () AS total,
          row_number() OVER (ORDER BY weight DESC, feature) AS place FROM n)
    SELECT feature, votes, round(weight, 4) AS weight,
      CASE WHEN most >= 2 THEN votes >= 2 ELSE place <= greatest(floor(total / 2), 1) END AS selected
    FROM p""",
)
def q_vote(spark, sf):
    from pyspark.sql import Window

    lines = table(spark, sf, "lineitem")
    sums = lines.groupBy(F.col("l_returnflag").alias("selector"), "l_suppkey").agg(
        F.sum("l_quantity").alias("q")
    )
    order = Window.partitionBy("selector").orderBy(F.desc("q"), "l_suppkey")
    tops = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 10)
    fit = lines.groupBy(F.col("l_returnflag").alias("selector")).agg(
        F.round(F.avg("l_quantity"), 6).alias("fitness")
    )
    lists = (
        tops.groupBy("selector")
        .agg(F.collect_list(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("features"))
        .join(fit, "selector")
    )
    return rounded(search.ensemble_vote(lists))


@query("ensemble_selection")
def q_ensemble(spark, sf):
    return search.ensemble_selection(
        subject(spark, sf), TARGET, COLUMNS, population=12, rounds=4
    )
