"""Queries for profiling and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulant.operators import clean, profile
from tabulant.plans.registry import query, rounded, table


def part_with_nulls(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.nullif(F.col("p_size"), F.lit(7)).cast("double").alias("size"),
        "p_retailprice",
        F.nullif(F.col("p_type"), F.lit("SMALL")).alias("type"),
        "p_brand",
    )


PART_NULLS = """part_n AS (
  SELECT p_partkey, CAST(nullif(p_size, 7) AS DOUBLE) AS size, p_retailprice,
         nullif(p_type, 'SMALL') AS type, p_brand FROM part)"""


def _schema_sql(columns, source, cte):
    parts = []
    for name, kind in columns:
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS type, count(*) AS row_count, "
            f"CAST({len(columns)} AS BIGINT) AS column_count, "
            f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count, "
            f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({name} AS VARCHAR) "
            f"AS v FROM {source} WHERE {name} IS NOT NULL ORDER BY v LIMIT 3)) AS samples "
            f"FROM {source}"
        )
    return f"WITH {cte} " + " UNION ALL ".join(parts)


@query(
    "detect_schema",
    _schema_sql(
        [
            ("p_partkey", "bigint"),
            ("size", "double"),
            ("p_retailprice", "double"),
            ("type", "string"),
            ("p_brand", "string"),
        ],
        "part_n",
        PART_NULLS,
    ),
)
def q_detect_schema(spark, sf):
    return rounded(profile.detect_schema(part_with_nulls(spark, sf)))


@query(
    "validate_data",
    f"""WITH {PART_NULLS}, s AS (
      SELECT count(*) AS r, count(*) - count(size) AS a, count(*) - count(type) AS b FROM part_n)
    SELECT 'warning' AS level, 'size' AS "column",
           'Column ''size'' has ' || a || ' null values' AS message FROM s WHERE a > 0
    UNION ALL
    SELECT 'warning', 'type', 'Column ''type'' has ' || b || ' null values' FROM s WHERE b > 0
    UNION ALL
    SELECT 'warning', 'empty', 'Column ''empty'' holds only null values' FROM s""",
)
def q_validate(spark, sf):
    df = part_with_nulls(spark, sf).withColumn("empty", F.lit(None).cast("string"))
    return profile.validate_data(df)


def _numeric_sql(columns, source, cte=""):
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct,
            count(DISTINCT {c}) AS distinct_count,
            round(count(DISTINCT {c}) * 100.0 / count(*), 4) AS distinct_pct,
            round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
            round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
            round(max({c}), 4) AS max, round(skewness({c}), 4) + 0.0 AS skewness,
            round(kurtosis({c}), 4) + 0.0 AS kurtosis FROM {source}"""
        )
    return cte + " UNION ALL ".join(parts)


@query(
    "profile_numeric",
    _numeric_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"),
)
def q_profile_numeric(spark, sf):
    df = table(spark, sf, "lineitem")
    return rounded(
        profile.profile_numeric(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    )


@query(
    "profile_numeric_nulls",
    _numeric_sql(["size", "p_retailprice"], "part_n", f"WITH {PART_NULLS} "),
)
def q_profile_numeric_nulls(spark, sf):
    return rounded(profile.profile_numeric(part_with_nulls(spark, sf), ["size", "p_retailprice"]))


@query(
    "profile_categorical",
    """WITH c AS (
      SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY 2
      UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
      UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n, value) AS k,
                 max(n) OVER (PARTITION BY "column") AS top FROM c)
    SELECT "column", 'mode' AS kind, value, n FROM r WHERE n = top
    UNION ALL SELECT "column", 'rare', value, n FROM r WHERE k <= 3""",
)
def q_profile_categorical(spark, sf):
    return rounded(
        profile.profile_categorical(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])
    )


def _orders_columns(sql):
    cols = {
        "o_orderkey": True,
        "o_custkey": True,
        "o_orderstatus": False,
        "o_totalprice": False,
        "o_orderdate": False,
        "o_orderpriority": False,
    }
    return " UNION ALL ".join(sql(c, named) for c, named in cols.items())


@query(
    "identify_identifiers",
    _orders_columns(
        lambda c, named: f"""SELECT '{c}' AS "column",
        round(count(DISTINCT {c}) * 1.0 / count(*), 4) AS distinct_share,
        {str(named).lower()} AS name_match,
        count(DISTINCT {c}) * 1.0 / count(*) > 0.9 AS uniqueness_match,
        {str(named).lower()} OR count(DISTINCT {c}) * 1.0 / count(*) > 0.9 AS is_identifier
        FROM orders"""
    ),
)
def q_identifiers(spark, sf):
    return rounded(profile.identify_identifiers(table(spark, sf, "orders")))


def _feature_type_sql():
    cols = {
        "l_quantity": "num",
        "l_extendedprice": "num",
        "l_discount": "num",
        "l_returnflag": "text",
        "l_shipdate": "other",
    }
    out = []
    for c, k in cols.items():
        u = f"count(DISTINCT {c})"
        kind = {
            "num": f"CASE WHEN {u} <= 20 AND {u} * 1.0 / count(*) < 0.05 THEN 'categorical' ELSE 'numeric' END",
            "text": f"CASE WHEN {u} <= 20 THEN 'categorical' ELSE 'text' END",
            "other": "'categorical'",
        }[k]
        out.append(
            f"""SELECT '{c}' AS "column", {u} AS distinct_count, {kind} AS kind FROM lineitem"""
        )
    return " UNION ALL ".join(out)


@query("detect_feature_types", _feature_type_sql())
def q_feature_types(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"
    )
    return rounded(profile.detect_feature_types(df))


@query(
    "detect_encoded_types",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, CASE
          WHEN count(DISTINCT {e}) = 2 AND min({e}) = 0 AND max({e}) = 1 THEN 'binary_encoded'
          WHEN count(DISTINCT {e}) <= 10 AND count(DISTINCT {e}) * 1.0 / count(*) < 0.1
          THEN 'categorical_encoded' ELSE 'numeric' END AS kind FROM lineitem"""
        for name, e in [
            ("is_open", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"),
            ("l_linenumber", "l_linenumber"),
            ("l_tax", "l_tax"),
            ("l_extendedprice", "l_extendedprice"),
        ]
    ),
)
def q_encoded_types(spark, sf):
    df = table(spark, sf, "lineitem").select(
        (F.col("l_linestatus") == "O").cast("int").alias("is_open"),
        "l_linenumber",
        "l_tax",
        "l_extendedprice",
    )
    return profile.detect_encoded_types(df)


@query(
    "target_type",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS target, CASE WHEN count(DISTINCT {c}) <= 3 THEN 'categorical'
        ELSE 'continuous' END AS kind FROM lineitem"""
        for c in ["l_returnflag", "l_quantity"]
    ),
)
def q_target_type(spark, sf):
    df = table(spark, sf, "lineitem")
    return profile.target_type(df, "l_returnflag").unionByName(
        profile.target_type(df, "l_quantity")
    )


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
        for a in LINE_NUMBERS
        for b in LINE_NUMBERS
    ),
)
def q_correlations(spark, sf):
    return rounded(profile.correlation_matrix(table(spark, sf, "lineitem"), LINE_NUMBERS), 6)


@query(
    "target_correlations",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) + 0.0 AS r FROM lineitem"
        for c in ["l_quantity", "l_discount", "l_tax"]
    ),
)
def q_target_correlations(spark, sf):
    return rounded(
        profile.target_correlations(
            table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]
        ),
        6,
    )


@query(
    "data_characteristics",
    f"WITH {PART_NULLS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, '{k}' AS kind,
        count(*) - count({c}) AS null_count, count(*) AS n_samples,
        CAST(5 AS BIGINT) AS n_features FROM part_n"""
        for c, t, k in [
            ("p_partkey", "bigint", "numeric"),
            ("size", "double", "numeric"),
            ("p_retailprice", "double", "numeric"),
            ("type", "string", "categorical"),
            ("p_brand", "string", "categorical"),
        ]
    ),
)
def q_characteristics(spark, sf):
    return rounded(profile.data_characteristics(part_with_nulls(spark, sf)))


# --- cleaning ---------------------------------------------------------------


@query(
    "drop_sparse_columns",
    f"WITH {PART_NULLS} SELECT p_partkey, size, p_retailprice, type, p_brand FROM part_n",
)
def q_drop_sparse(spark, sf):
    df = part_with_nulls(spark, sf).withColumn(
        "sparse", F.when(F.col("size") > 30, F.col("size"))
    )
    return clean.drop_sparse_columns(df)


def _impute_sql(fill):
    return f"""WITH {PART_NULLS},
    m AS (SELECT type AS mode_type FROM part_n WHERE type IS NOT NULL GROUP BY 1
          ORDER BY count(*) DESC, 1 LIMIT 1),
    s AS (SELECT {fill} AS fill_size FROM part_n)
    SELECT p_partkey, round(coalesce(size, fill_size), 4) AS size, p_retailprice,
           coalesce(type, mode_type) AS type, p_brand FROM part_n, m, s"""


@query("impute_mean", _impute_sql("avg(size)"))
def q_impute_mean(spark, sf):
    return rounded(clean.handle_missing(part_with_nulls(spark, sf), "mean"))


@query("impute_median", _impute_sql("quantile_cont(size, 0.5)"))
def q_impute_median(spark, sf):
    return rounded(clean.handle_missing(part_with_nulls(spark, sf), "median"))


@query(
    "impute_mode",
    _impute_sql(
        """(SELECT size FROM part_n WHERE size IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, 1 LIMIT 1)"""
    ).replace("FROM part_n)\n    SELECT", ")\n    SELECT"),
)
def q_impute_mode(spark, sf):
    return rounded(clean.handle_missing(part_with_nulls(spark, sf), "mode"))


@query(
    "drop_missing_rows",
    f"WITH {PART_NULLS} SELECT * FROM part_n WHERE size IS NOT NULL AND type IS NOT NULL",
)
def q_drop_missing(spark, sf):
    return clean.handle_missing(part_with_nulls(spark, sf), "drop")


@query(
    "normalize_types",
    """WITH s AS (SELECT count(*) AS r,
        count(DISTINCT p_size) AS du FROM part)
    SELECT p_partkey, CAST(p_size AS DOUBLE) + 10000.0 * p_partkey AS number_text, p_name, p_brand
    FROM part""",
)
def q_normalize_types(spark, sf):
    part = table(spark, sf, "part")
    df = part.select(
        "p_partkey",
        (F.col("p_size") + F.lit(10000) * F.col("p_partkey")).cast("string").alias("number_text"),
        "p_name",
        "p_brand",
    )
    return clean.normalize_types(df)


def _iqr_sql(columns, source, extra):
    flags = ", ".join(
        f"coalesce({c} < q.{c}_1 - 1.5 * (q.{c}_3 - q.{c}_1) OR "
        f"{c} > q.{c}_3 + 1.5 * (q.{c}_3 - q.{c}_1), false) AS {c}_outlier"
        for c in columns
    )
    qs = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3" for c in columns
    )
    return f"SELECT {extra}, {', '.join(columns)}, {flags} FROM {source}, (SELECT {qs} FROM {source}) q"


EVENT_VALUES = "SELECT event_id, value FROM events"


@query("outliers_iqr", _iqr_sql(["value"], "events", "event_id"))
def q_outliers_iqr(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return clean.outliers_iqr(df, ["value"])


@query(
    "outliers_zscore",
    """SELECT event_id, value, abs((value - m) / s) > 3 AS value_outlier
    FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""",
)
def q_outliers_z(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return clean.outliers_zscore(df, ["value"])


@query(
    "remove_outliers",
    f"""SELECT event_id, value FROM ({_iqr_sql(["value"], "events", "event_id")})
    WHERE NOT value_outlier""",
)
def q_remove_outliers(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return clean.remove_outliers(clean.outliers_iqr(df, ["value"]))


@query(
    "encode_target",
    """SELECT o_orderkey, CAST(c AS DOUBLE) AS o_orderpriority FROM orders
    JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS c
          FROM (SELECT DISTINCT o_orderpriority FROM orders)) USING (o_orderpriority)""",
)
def q_encode_target(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return clean.encode_target(df, "o_orderpriority")
