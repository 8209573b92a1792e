"""Profiling and validation of a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.core.columns import (
    distinct_counts,
    few_values,
    melt_text,
    number,
    numeric_columns,
    present,
    quoted,
    rows_of,
    text_columns,
)
from tabulant.core.gram import NARROW
from tabulant.core.ordered import exact_quantiles

# fixed values: words that mark an identifier column
IDENTIFIER_WORDS = ["id", "key", "index", "uuid", "guid"]


def _one_pass(df: DataFrame, per_column) -> DataFrame:
    """One row with `rows` plus the aggregates `per_column(name)` gives each column."""
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        cells += [expr.alias(f"{key}_{i}") for key, expr in per_column(c).items()]
    return df.agg(*cells)


def _nulls(df: DataFrame, c: str):
    return F.count(F.lit(1)) - F.count(present(df, c))


def detect_schema(df: DataFrame, samples: int = 3) -> DataFrame:
    """Per column: type, nulls, distinct values, up to three sample values, table size.

    The samples are the smallest values as text, so the answer does not depend on
    how rows are laid out.
    """
    counts = (
        melt_text(df, df.columns)
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias(
            "null_count"
        ),
        F.count("value").alias("distinct_count"),
    )
    smallest = Window.partitionBy("column").orderBy("value")
    picked = (
        counts.where(F.col("value").isNotNull())
        .withColumn("r", F.row_number().over(smallest))
        .where(F.col("r") <= samples)
        .groupBy("column")
        .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("samples"))
    )
    kinds = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)],
        "column string, type string, ordinal int",
    )
    return (
        kinds.join(totals, "column", "left")
        .join(picked, "column", "left")
        .select(
            "column",
            "type",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"),
            F.coalesce("null_count", F.lit(0)).alias("null_count"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            "samples",
        )
    )


def validate_data(df: DataFrame) -> DataFrame:
    """Messages (level, column, message) about an empty table and about nulls."""
    spark = df.sparkSession
    if not df.columns:
        return spark.createDataFrame(
            [("error", None, "The table has no columns")],
            "level string, column string, message string",
        )
    stats = _one_pass(df, lambda c: {"nulls": _nulls(df, c)})
    cells = [
        F.struct(
            F.lit("error").alias("level"),
            F.lit(None).cast("string").alias("column"),
            F.when(F.col("rows") == 0, F.lit("The table is empty")).alias("message"),
        )
    ]
    for i, c in enumerate(df.columns):
        n = F.col(f"nulls_{i}")
        cells.append(
            F.struct(
                F.lit("warning").alias("level"),
                F.lit(c).alias("column"),
                F.when(F.col("rows") == 0, None)
                .when(n == F.col("rows"), F.lit(f"Column '{c}' holds only null values"))
                .when(
                    n > 0,
                    F.concat(F.lit(f"Column '{c}' has "), n.cast("string"), F.lit(" null values")),
                )
                .alias("message"),
            )
        )
    return stats.select(rows_of(cells)).where(F.col("message").isNotNull())


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null and distinct shares, location, spread and bias-corrected shape per column."""
    columns = list(columns or numeric_columns(df))
    medians = exact_quantiles(df, columns, [0.5])
    # apart from the moments: beside a distinct count they would be kept per value
    distinct = df.agg(
        *[F.count_distinct(number(df, c)).alias(f"u{i}") for i, c in enumerate(columns)]
    ).first()
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = number(df, c)
        cells += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"a{i}"),
            F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.skewness(v).alias(f"g{i}"),
            F.kurtosis(v).alias(f"k{i}"),
        ]
    stats = df.agg(*cells)
    out = []
    for i, c in enumerate(columns):
        n, g, k = F.col(f"n{i}").cast("double"), F.col(f"g{i}"), F.col(f"k{i}")
        skew = F.when(n > 2, g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
        kurt = F.when(
            n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * k + F.lit(6.0))
        )
        out.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.try_divide((F.col("rows") - n) * 100.0, F.col("rows")).alias("null_pct"),
                F.lit(distinct[f"u{i}"]).cast("long").alias("distinct_count"),
                F.try_divide(F.lit(distinct[f"u{i}"] * 100.0), F.col("rows")).alias("distinct_pct"),
                F.col(f"a{i}").alias("mean"),
                F.lit(medians[c][0]).cast("double").alias("median"),
                F.col(f"s{i}").alias("std"),
                F.col(f"lo{i}").alias("min"),
                F.col(f"hi{i}").alias("max"),
                skew.alias("skewness"),
                kurt.alias("kurtosis"),
            )
        )
    return stats.select(rows_of(out))


def profile_categorical(
    df: DataFrame, columns: Sequence[str] | None = None, rarest: int = 3
) -> DataFrame:
    """All modes (kind 'mode') and the rarest values (kind 'rare'), one row per value."""
    counts = (
        melt_text(df, list(columns or text_columns(df)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = counts.groupBy("column").agg(F.max("n").alias("n"))
    modes = counts.join(F.broadcast(top), ["column", "n"]).select(
        "column", F.lit("mode").alias("kind"), "value", "n"
    )
    order = Window.partitionBy("column").orderBy("n", "value")
    rare = (
        counts.withColumn("r", F.row_number().over(order))
        .where(F.col("r") <= rarest)
        .select("column", F.lit("rare").alias("kind"), "value", "n")
    )
    return modes.unionByName(rare)


def identify_identifiers(df: DataFrame, uniqueness_threshold: float = 0.9) -> DataFrame:
    """Columns that look like keys, by name or by share of distinct values."""
    stats = _one_pass(df, lambda c: {"u": F.count_distinct(present(df, c))})
    cells = []
    for i, c in enumerate(df.columns):
        share = F.try_divide(F.col(f"u_{i}").cast("double"), F.col("rows"))
        named = any(word in c.lower() for word in IDENTIFIER_WORDS)
        unique = F.coalesce(share > uniqueness_threshold, F.lit(False))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                share.alias("distinct_share"),
                F.lit(named).alias("name_match"),
                unique.alias("uniqueness_match"),
                (F.lit(named) | unique).alias("is_identifier"),
            )
        )
    return stats.select(rows_of(cells))


def detect_feature_types(df: DataFrame, max_categories: int = 20) -> DataFrame:
    """numeric, categorical or text per column, from its type and distinct values."""
    stats = _one_pass(df, lambda c: {"u": F.count_distinct(present(df, c))})
    cells = []
    for i, f in enumerate(df.schema.fields):
        u, few = F.col(f"u_{i}"), F.col(f"u_{i}") <= max_categories
        if isinstance(f.dataType, T.NumericType):
            share = F.try_divide(u.cast("double"), F.col("rows"))
            kind = F.when(few & (share < 0.05), "categorical").otherwise("numeric")
        elif isinstance(f.dataType, T.StringType):
            kind = F.when(few, "categorical").otherwise("text")
        else:
            kind = F.lit("categorical")
        cells.append(F.struct(F.lit(f.name).alias("column"), u.alias("distinct_count"), kind.alias("kind")))
    return stats.select(rows_of(cells))


def detect_encoded_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """binary_encoded, categorical_encoded or numeric per numeric column.

    One pass brings bounds and sketches; only columns that may have ten values or fewer are
    counted exactly, where equal values are merged at once.
    """
    columns = list(columns or numeric_columns(df))
    values = {c: number(df, c) for c in columns}
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(values.values()):
        cells += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row, counts = distinct_counts(df, values, lambda rows: (0, 10), cells)
    out = []
    for i, c in enumerate(columns):
        u, few = counts[c], counts[c] <= 10 and row["rows"] and counts[c] / row["rows"] < 0.1
        binary = u == 2 and row[f"lo{i}"] == 0 and row[f"hi{i}"] == 1
        out.append((c, "binary_encoded" if binary else "categorical_encoded" if few else "numeric"))
    return df.sparkSession.createDataFrame(out, "feature string, kind string")


def target_type(df: DataFrame, target: str, threshold: int = 3) -> DataFrame:
    """categorical when the target has at most `threshold` values, else continuous.

    A sketch answers for a target with many values; only few values are counted exactly.
    """
    some = few_values(df, present(df, target), threshold)
    kind = "continuous" if some is None else "categorical"
    return df.sparkSession.createDataFrame([(target, kind)], "target string, kind string")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every ordered pair of columns, over the rows where both are present.

    Few columns are one aggregate; many go through Arrow batches that add up masked
    products per task, still in one pass over the rows.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) > NARROW:
        return _wide_correlations(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(
        *[F.corr(number(df, a), number(df, b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)]
    )
    cells = [
        F.struct(
            F.lit(x).alias("a"),
            F.lit(y).alias("b"),
            F.nanvl(F.col(f"r{k}"), F.lit(None)).alias("r"),
        )
        for k, (a, b) in enumerate(pairs)
        for x, y in sorted({(a, b), (b, a)})
    ]
    return row.select(rows_of(cells))


def _wide_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    data = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    first = data.agg(*[F.avg(c) for c in data.columns]).first()
    centre = np.array([float(v or 0.0) for v in first])
    p = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64") - centre
            there = ~np.isnan(x)
            m, x = there.astype("float64"), np.where(there, x, 0.0)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.indices((p, p)).reshape(2, -1)
        n, s, ss, xy = sums.reshape(4, -1)
        yield pd.DataFrame({"i": i, "j": j, "n": n, "s": s, "ss": ss, "xy": xy})

    cells = (
        data.mapInPandas(run, "i int, j int, n double, s double, ss double, xy double")
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "xy")])
    )
    # the sums of the second column of a pair are those of the mirrored pair
    mirror = cells.select(
        F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("t"), F.col("ss").alias("tt")
    )
    n = F.col("n")
    spread = (n * F.col("ss") - F.col("s") * F.col("s")) * (n * F.col("tt") - F.col("t") * F.col("t"))
    r = F.try_divide(
        n * F.col("xy") - F.col("s") * F.col("t"), F.when(spread > 0, F.sqrt(spread))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return cells.join(mirror, ["i", "j"]).select(
        F.element_at(names, F.col("i") + 1).alias("a"),
        F.element_at(names, F.col("j") + 1).alias("b"),
        r.alias("r"),
    )


def target_correlations(
    df: DataFrame, target: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Pearson r of each numeric column with the target."""
    columns = list(columns or numeric_columns(df, exclude=[target]))
    y = number(df, target)
    row = df.agg(*[F.corr(number(df, c), y).alias(f"r{i}") for i, c in enumerate(columns)])
    return row.select(
        rows_of(
            [
                F.struct(
                    F.lit(c).alias("feature"),
                    F.nanvl(F.col(f"r{i}"), F.lit(None)).alias("r"),
                )
                for i, c in enumerate(columns)
            ]
        )
    )


def data_characteristics(df: DataFrame) -> DataFrame:
    """Per column: type, class, nulls; with sample and feature counts."""
    stats = _one_pass(df, lambda c: {"nulls": _nulls(df, c)})
    cells = []
    for i, f in enumerate(df.schema.fields):
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
        cells.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(kind).alias("kind"),
                F.col(f"nulls_{i}").alias("null_count"),
                F.col("rows").alias("n_samples"),
                F.lit(len(df.columns)).alias("n_features"),
            )
        )
    return stats.select(rows_of(cells))
