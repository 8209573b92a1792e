"""Queries for encoding and feature generation."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from tabulant.operators import encode, features
from tabulant.plans.registry import query, rounded, table

ROW = "l_orderkey * 10 + l_linenumber"


def lines(spark, sf, *columns):
    return table(spark, sf, "lineitem").select(F.expr(ROW).alias("row_key"), *columns)


# lineitem repeats (order, line) pairs, so the twins compare whole rows as a bag
FLAGS = ["A", "N", "R"]


@query(
    "encode_one_hot",
    f"SELECT {ROW} AS row_key, "
    + ", ".join(
        f"CASE WHEN l_returnflag = '{v}' THEN CAST(1 AS BIGINT) ELSE 0 END AS l_returnflag_{v}"
        for v in FLAGS
    )
    + " FROM (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'zz') AS l_returnflag FROM lineitem)",
)
def q_one_hot(spark, sf):
    return rounded(encode.encode_one_hot(lines(spark, sf, "l_returnflag"), ["l_returnflag"]))


@query(
    "encode_label",
    """SELECT p_partkey, p_brand, nullif(p_type, 'SMALL') AS p_type,
      CASE WHEN p_brand IS NOT NULL THEN b.c END AS p_brand_encoded, t.c AS p_type_encoded
    FROM part
    JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS c
          FROM (SELECT DISTINCT p_brand FROM part)) b USING (p_brand)
    LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM
          (SELECT DISTINCT nullif(p_type, 'SMALL') AS v FROM part) WHERE v IS NOT NULL) t
      ON t.v = p_type""",
)
def q_label(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.nullif(F.col("p_type"), F.lit("SMALL")).alias("p_type")
    )
    return rounded(encode.encode_label(df, ["p_brand", "p_type"]))


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "encode_ordinal",
    """SELECT o_orderkey, o_orderpriority, o_orderstatus,
      CAST(list_position(['5-LOW','4-NOT SPECIFIED','3-MEDIUM','2-HIGH','1-URGENT'],
           o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority_encoded,
      CAST(list_position(['F','O','P'], o_orderstatus) - 1 AS DOUBLE) AS o_orderstatus_encoded
    FROM orders""",
)
def q_ordinal(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return encode.encode_ordinal(
        df, ["o_orderpriority", "o_orderstatus"], {"o_orderpriority": PRIORITIES}
    )


@query(
    "encode_frequency",
    f"""SELECT {ROW} AS row_key, l_returnflag, l_linestatus,
      round(a.n * 1.0 / t, 6) AS l_returnflag_freq_encoded,
      round(b.n * 1.0 / t, 6) AS l_linestatus_freq_encoded
    FROM lineitem
    JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) a USING (l_returnflag)
    JOIN (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1) b USING (l_linestatus),
    (SELECT count(*) AS t FROM lineitem)""",
)
def q_frequency(spark, sf):
    df = lines(spark, sf, "l_returnflag", "l_linestatus")
    return rounded(encode.encode_frequency(df, ["l_returnflag", "l_linestatus"]), 6)


@query(
    "encode_target_mean",
    """WITH s AS (SELECT o_orderpriority AS v, o_orderkey % 5 AS f, sum(o_totalprice) AS s,
                 count(*) AS n FROM orders GROUP BY 1, 2),
    t AS (SELECT v, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1)
    SELECT o_orderkey, o_orderpriority, o_totalprice,
      round((t.s - s.s) / (t.n - s.n), 4) AS o_orderpriority_target_encoded
    FROM orders JOIN t ON t.v = o_orderpriority
    JOIN s ON s.v = o_orderpriority AND s.f = o_orderkey % 5""",
)
def q_target_mean(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(
        encode.encode_target_mean(df, ["o_orderpriority"], "o_totalprice", row_key="o_orderkey")
    )


@query(
    "encode_categoricals",
    "SELECT p_partkey, p_name, p_brand, "
    + ", ".join(
        f"CAST(p_type = '{v}' AS BIGINT) AS \"p_type_{v}\""
        for v in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    )
    + " FROM part",
)
def q_categoricals(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return rounded(encode.encode_categoricals(df, max_cardinality=10))


@query(
    "polynomial_features",
    f"""SELECT {ROW} AS row_key, l_quantity, l_discount,
      round(l_quantity ** 2, 4) AS l_quantity_pow_2, round(l_quantity ** 3, 4) AS l_quantity_pow_3,
      round(l_discount ** 2, 4) AS l_discount_pow_2, round(l_discount ** 3, 4) AS l_discount_pow_3
    FROM lineitem""",
)
def q_polynomial(spark, sf):
    df = lines(spark, sf, "l_quantity", "l_discount")
    return rounded(features.polynomial_features(df, ["l_quantity", "l_discount"], degree=3))


@query(
    "trig_features",
    f"""SELECT {ROW} AS row_key, l_quantity, round(sin(l_quantity), 6) AS l_quantity_sin,
      round(cos(l_quantity), 6) AS l_quantity_cos FROM lineitem""",
)
def q_trig(spark, sf):
    return rounded(features.trig_features(lines(spark, sf, "l_quantity"), ["l_quantity"]), 6)


def _log_sql(fn, name):
    return f"""SELECT c_custkey, c_acctbal, round({fn}, 6) AS c_acctbal_{name}
    FROM customer, (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1e-10
                    ELSE 0 END AS s FROM customer)"""


def _balances(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal")


@query("log_features", _log_sql("ln(c_acctbal + s)", "log"))
def q_log(spark, sf):
    df = _balances(spark, sf)
    return rounded(features.log_features(df, ["c_acctbal"]), 6)


@query("log10_features", _log_sql("log10(c_acctbal + s)", "log10"))
def q_log10(spark, sf):
    df = _balances(spark, sf)
    return rounded(features.log_features(df, ["c_acctbal"], base=10), 6)


@query("log_base_features", _log_sql("ln(c_acctbal + s) / ln(2.0::DOUBLE)", "log_2"))
def q_log2(spark, sf):
    df = _balances(spark, sf)
    return rounded(features.log_features(df, ["c_acctbal"], base=2), 6)


@query(
    "bin_uniform",
    f"""SELECT {ROW} AS row_key, l_quantity, l_extendedprice,
      CAST(least(floor((l_quantity - ql) / ((qh - ql) / 5)), 4) AS BIGINT) AS l_quantity_binned,
      CAST(least(floor((l_extendedprice - el) / ((eh - el) / 5)), 4) AS BIGINT)
        AS l_extendedprice_binned
    FROM lineitem, (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh,
      min(l_extendedprice) AS el, max(l_extendedprice) AS eh FROM lineitem)""",
)
def q_bin_uniform(spark, sf):
    df = lines(spark, sf, "l_quantity", "l_extendedprice")
    return rounded(features.bin_uniform(df, ["l_quantity", "l_extendedprice"], 5))


@query(
    "bin_quantile",
    f"""SELECT {ROW} AS row_key, l_extendedprice, l_tax,
      {" + ".join(f"CAST(l_extendedprice >= e[{i}] AS BIGINT)" for i in range(1, 5))}
        AS l_extendedprice_binned,
      (SELECT count(DISTINCT q) FROM unnest(t) u(q)
         WHERE q <= l_tax AND q > lo AND q < hi) AS l_tax_binned
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e,
      quantile_cont(l_tax, [0.2, 0.4, 0.6, 0.8]) AS t, min(l_tax) AS lo, max(l_tax) AS hi
      FROM lineitem)""",
)
def q_bin_quantile(spark, sf):
    df = lines(spark, sf, "l_extendedprice", "l_tax")
    return rounded(features.bin_quantile(df, ["l_extendedprice", "l_tax"], 5))


@query(
    "interaction_features",
    f"""SELECT {ROW} AS row_key, l_quantity, l_discount, l_tax,
      round(l_quantity * l_discount, 6) AS l_quantity_l_discount_interaction,
      round(l_quantity * l_tax, 6) AS l_quantity_l_tax_interaction,
      round(l_discount * l_tax, 6) AS l_discount_l_tax_interaction FROM lineitem""",
)
def q_interaction(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return rounded(features.interaction_features(lines(spark, sf, *cols), cols), 6)


def _group_sql():
    fs = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    stats = ", ".join(
        f"round({fs[f]}(l_quantity), 6) AS l_quantity_{f}_by_{{g}}" for f in fs
    )
    one = stats.format(g="l_returnflag")
    two = stats.format(g="l_suppkey")
    return f"""SELECT {ROW} AS row_key, l_returnflag, l_suppkey, l_quantity,
      a.* EXCLUDE (l_returnflag), b.* EXCLUDE (l_suppkey) FROM lineitem
      JOIN (SELECT l_returnflag, {one} FROM lineitem GROUP BY 1) a USING (l_returnflag)
      JOIN (SELECT l_suppkey, {two} FROM lineitem GROUP BY 1) b USING (l_suppkey)"""


@query("group_statistics", _group_sql())
def q_group_stats(spark, sf):
    df = lines(spark, sf, "l_returnflag", "l_suppkey", "l_quantity")
    return rounded(
        features.group_statistics(df, ["l_returnflag", "l_suppkey"], ["l_quantity"]), 6
    )


AUTO_NUMERIC = """round(l_quantity ** 2, 4) AS l_quantity_pow_2,
  round(ln(l_quantity + 1e-10), 6) AS l_quantity_log, round(sqrt(l_quantity), 6) AS l_quantity_sqrt,
  (SELECT count(DISTINCT q) FROM unnest(bq) u(q) WHERE q <= l_quantity AND q > lq AND q < hq)
    AS l_quantity_binned,
  round(l_tax ** 2, 6) AS l_tax_pow_2, round(sqrt(l_tax), 6) AS l_tax_sqrt,
  (SELECT count(DISTINCT q) FROM unnest(bt) u(q) WHERE q <= l_tax AND q > lt AND q < ht)
    AS l_tax_binned"""
AUTO_RANGES = """(SELECT quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8]) AS bq,
  quantile_cont(l_tax, [0.2, 0.4, 0.6, 0.8]) AS bt, min(l_quantity) AS lq, max(l_quantity) AS hq,
  min(l_tax) AS lt, max(l_tax) AS ht FROM lineitem)"""


@query(
    "auto_numeric_features",
    f"SELECT {ROW} AS row_key, l_quantity, l_tax, {AUTO_NUMERIC} FROM lineitem, {AUTO_RANGES}",
)
def q_auto_numeric(spark, sf):
    df = lines(spark, sf, "l_quantity", "l_tax")
    return rounded(features.auto_numeric_features(df, ["l_quantity", "l_tax"]), 6)


@query(
    "auto_interactions",
    """SELECT p_partkey, p_size, p_retailprice,
      round(CAST(p_retailprice AS DOUBLE) * p_size, 4) AS pair FROM part""",
)
def q_auto_interactions(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    out = features.auto_interactions(df, "p_partkey", ["p_size", "p_retailprice"])
    # the name depends on which column is the stronger one
    made = [c for c in out.columns if c.endswith("_interaction")][0]
    return rounded(out.withColumnRenamed(made, "pair"))


@query(
    "ratio_features",
    f"SELECT {ROW} AS row_key, l_quantity, l_discount, l_tax, "
    + ", ".join(
        f"round(CASE WHEN {b} <> 0 THEN {a} / ({b} + sign({b}) * 1e-10) END, 4) AS {a}_div_{b}"
        for a, b in permutations(["l_quantity", "l_discount", "l_tax"], 2)
    )
    + " FROM lineitem",
)
def q_ratio(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return rounded(features.ratio_features(lines(spark, sf, *cols), cols))


@query(
    "scale_standard",
    f"""SELECT {ROW} AS row_key, round((l_quantity - qm) / qs, 6) + 0.0 AS l_quantity,
      round((l_extendedprice - em) / es, 6) + 0.0 AS l_extendedprice
    FROM lineitem, (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs,
      avg(l_extendedprice) AS em, stddev_pop(l_extendedprice) AS es FROM lineitem)""",
)
def q_scale_standard(spark, sf):
    cols = ["l_quantity", "l_extendedprice"]
    return rounded(features.scale_standard(lines(spark, sf, *cols), cols), 6)


@query(
    "scale_minmax",
    """SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal
    FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
)
def q_scale_minmax(spark, sf):
    return rounded(features.scale_minmax(_balances(spark, sf), ["c_acctbal"]), 6)


BASIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _basic_sql(prefix, source, pairs):
    cells = [f"round({c} ** 2, 2) AS {c}_pow_2" for c in BASIC]
    cells += [
        f"round({fn}({c}), 4) + 0.0 AS {c}_{fn}" for c in BASIC[:3] for fn in ("sin", "cos")
    ]
    cells += [f"round(ln({c}), 4) AS {c}_log" for c in BASIC[:2]]
    cells += [
        f"CAST(least(floor(({c} - {c}_lo) / (({c}_hi - {c}_lo) / 5)), 4) AS BIGINT) AS {c}_binned"
        for c in BASIC[:3]
    ]
    cells += [
        f"round({a} * {b}, 4) AS {a}_{b}_interaction" for a, b in list(combinations(pairs, 2))[:5]
    ]
    ranges = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in BASIC)
    return (
        f"SELECT {prefix}, {', '.join(f'round({c}, 4) AS {c}' for c in BASIC)}, "
        f"{', '.join(cells)} FROM {source}, (SELECT {ranges} FROM lineitem)"
    )


def _basic_rounded(df):
    out = rounded(df, 4)
    return out.withColumns({f"{c}_pow_2": F.round(f"{c}_pow_2", 2) for c in BASIC})


@query("basic_features", _basic_sql(f"{ROW} AS row_key", "lineitem", BASIC))
def q_basic(spark, sf):
    df = lines(spark, sf, *BASIC)
    return _basic_rounded(features.basic_features(df, features.TRANSFORMS, 5, BASIC))


@query(
    "prepare_features",
    _basic_sql(
        f"{ROW} AS row_key, l_linestatus_F, l_linestatus_O, round(l_linestatus_F ** 2, 2) + 0.0 "
        "AS l_linestatus_F_pow_2",
        "(SELECT *, "
        + ", ".join(f"CAST(l_linestatus = '{v}' AS BIGINT) AS l_linestatus_{v}" for v in "FO")
        + " FROM lineitem)",
        [*BASIC, "l_linestatus_F"],
    ),
)
def q_prepare(spark, sf):
    df = lines(spark, sf, "l_linestatus", *BASIC)
    out = features.prepare_features(
        df,
        encoding_method="one_hot",
        numeric_transforms=features.TRANSFORMS,
        row_key="row_key",
    )
    return _basic_rounded(out)


@query(
    "auto_features",
    f"""SELECT {ROW} AS row_key, l_extendedprice, l_quantity, l_tax, {AUTO_NUMERIC},
      round(l_quantity * l_tax, 4) AS l_quantity_l_tax_interaction,
      round(CASE WHEN l_tax <> 0 THEN l_quantity / (l_tax + sign(l_tax) * 1e-10) END, 4)
        AS l_quantity_div_l_tax,
      round(CASE WHEN l_quantity <> 0 THEN l_tax / (l_quantity + sign(l_quantity) * 1e-10) END, 6)
        AS l_tax_div_l_quantity
    FROM lineitem, {AUTO_RANGES}""",
)
def q_auto_features(spark, sf):
    df = lines(spark, sf, "l_extendedprice", "l_quantity", "l_tax")
    made = features.auto_features(df, "l_extendedprice", columns=["l_quantity", "l_tax"])
    (pair,) = [c for c in made.columns if c.endswith("_interaction")]
    made = made.withColumnRenamed(pair, "l_quantity_l_tax_interaction")
    return rounded(made, 6).withColumns(
        {
            c: F.round(c, 4)
            for c in ["l_quantity_l_tax_interaction", "l_quantity_div_l_tax", "l_quantity_pow_2"]
        }
    )
