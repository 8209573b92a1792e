"""Missing values, types, outliers and the target column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.core.columns import (
    distinct_counts,
    number,
    numeric_columns,
    present,
    quoted,
    text_columns,
)
from tabulant.core.lookup import attach, sorted_codes
from tabulant.core.ordered import exact_quantiles


def _missing_shares(df: DataFrame) -> dict[str, float]:
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    ).first()
    rows = row["rows"] or 1
    return {c: 1 - row[f"n{i}"] / rows for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop the columns whose share of missing values is above the threshold."""
    shares = _missing_shares(df)
    return df.select(*[F.col(quoted(c)) for c in df.columns if shares[c] <= threshold])


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest on ties.

    Columns of one type share a value count, so no task ever holds all values.
    """
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out: dict[str, object] = {}
    for names in kinds.values():
        cells = [
            F.struct(F.lit(c).alias("column"), present(df, c).alias("value")) for c in names
        ]
        counts = (
            df.select(F.inline(F.array(*cells)))
            .where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        best = counts.groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
        )
        out.update({r["column"]: r["value"] for r in best.collect()})
    return out


def _filled(df: DataFrame, values: dict[str, object]) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = present(df, f.name)
        fill = values.get(f.name)
        if fill is None:
            cols.append(F.col(quoted(f.name)))
        elif isinstance(fill, float) and isinstance(f.dataType, T.IntegralType):
            # a fractional fill turns an integer column into double
            cols.append(F.coalesce(c.cast("double"), F.lit(fill)).alias(f.name))
        else:
            cols.append(F.coalesce(c, F.lit(fill).cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def _incomplete(df: DataFrame) -> list[str]:
    return [c for c, share in _missing_shares(df).items() if share > 0]


def impute_mean(df: DataFrame) -> DataFrame:
    """Fill numeric columns with the mean and others with the mode."""
    holes = _incomplete(df)
    nums = [c for c in numeric_columns(df) if c in holes]
    fills = column_modes(df, [c for c in holes if c not in nums])
    if nums:
        row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(nums)]).first()
        fills.update({c: row[f"m{i}"] for i, c in enumerate(nums)})
    return _filled(df, fills)


def impute_median(df: DataFrame) -> DataFrame:
    """Fill numeric columns with the interpolated median and others with the mode."""
    holes = _incomplete(df)
    nums = [c for c in numeric_columns(df) if c in holes]
    fills = column_modes(df, [c for c in holes if c not in nums])
    if nums:
        fills.update({c: q[0] for c, q in exact_quantiles(df, nums, [0.5]).items()})
    return _filled(df, fills)


def impute_mode(df: DataFrame) -> DataFrame:
    """Fill every column with its mode."""
    return _filled(df, column_modes(df, _incomplete(df)))


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the rows that are complete in the given columns."""
    keep = F.lit(True)
    for c in columns or df.columns:
        keep = keep & present(df, c).isNotNull()
    return df.where(keep)


def handle_missing(df: DataFrame, strategy: str = "mean", threshold: float = 0.5) -> DataFrame:
    """Drop sparse columns, then apply one strategy: mean, median, mode or drop."""
    steps = {
        "mean": impute_mean,
        "median": impute_median,
        "mode": impute_mode,
        "drop": drop_missing_rows,
    }
    if strategy not in steps:
        raise ValueError(f"unknown strategy: {strategy}")
    return steps[strategy](drop_sparse_columns(df, threshold))


def normalize_types(df: DataFrame, category_share: float = 0.05) -> DataFrame:
    """Mark low-cardinality text as category and turn all-numeric text into numbers."""
    names = text_columns(df)
    if not names:
        return df
    cells = [F.count(F.lit(1)).alias("rows")]
    values = {c: F.col(quoted(c)) for c in names}
    for i, v in enumerate(values.values()):
        cells += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("double")).alias(f"ok{i}")]
    # sketches decide but for columns near the limit
    near = lambda rows: (0.8 * category_share * rows - 8, 1.2 * category_share * rows + 8)
    row, counts = distinct_counts(df, values, near, cells)
    cols = []
    for f in df.schema.fields:
        if f.name not in names or not row["rows"]:
            cols.append(F.col(quoted(f.name)))
            continue
        i = names.index(f.name)
        if counts[f.name] / row["rows"] < category_share:
            cols.append(F.col(quoted(f.name)).alias(f.name, metadata={"kind": "category"}))
        elif row[f"n{i}"] and row[f"ok{i}"] == row[f"n{i}"]:
            cols.append(F.col(quoted(f.name)).try_cast("double").alias(f.name))
        else:
            cols.append(F.col(quoted(f.name)))
    return df.select(*cols)


def _flags(df: DataFrame, tests: dict[str, object], suffix: str) -> DataFrame:
    return df.select(
        "*", *[F.coalesce(t, F.lit(False)).alias(f"{c}{suffix}") for c, t in tests.items()]
    )


def outliers_iqr(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5
) -> DataFrame:
    """Add `{col}_outlier`: outside the quartiles by more than threshold x IQR."""
    columns = list(columns or numeric_columns(df))
    tests = {}
    for c, (q1, q3) in exact_quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is None:
            tests[c] = F.lit(False)
            continue
        reach = threshold * (q3 - q1)
        v = number(df, c)
        tests[c] = (v < q1 - reach) | (v > q3 + reach)
    return _flags(df, tests, "_outlier")


def outliers_zscore(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    """Add `{col}_outlier`: more than threshold population deviations from the mean."""
    columns = list(columns or numeric_columns(df))
    cells = []
    for i, c in enumerate(columns):
        v = number(df, c)
        cells += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*cells).first()
    tests = {}
    for i, c in enumerate(columns):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        tests[c] = F.abs((number(df, c) - mean) / std) > threshold if std else F.lit(False)
    return _flags(df, tests, "_outlier")


def remove_outliers(df: DataFrame, suffix: str = "_outlier") -> DataFrame:
    """Drop the rows flagged in any column, and the flag columns."""
    flags = [c for c in df.columns if c.endswith(suffix)]
    bad = F.lit(False)
    for c in flags:
        bad = bad | F.col(quoted(c))
    return df.where(~bad).drop(*flags)


def encode_target(df: DataFrame, target: str, output: str | None = None) -> DataFrame:
    """Text classes become 0, 1, ... in sorted order; a numeric target is kept."""
    output = output or target
    if not isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        return df if output == target else df.withColumn(output, F.col(quoted(target)))
    codes = sorted_codes(df, target, "__code")
    joined = attach(df, codes, [target], weight="__n", written=True)
    code = F.col("__code").cast("double")
    if output == target:
        return joined.select(
            *[code.alias(c) if c == target else F.col(quoted(c)) for c in df.columns]
        )
    return joined.select(*[F.col(quoted(c)) for c in df.columns], code.alias(output))
