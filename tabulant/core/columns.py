"""Column helpers: type classes, missing values, wide-to-long."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so both count as missing."""
    c = F.col(quoted(name))
    return F.when(~F.isnan(c), c) if is_floating(df, name) else c


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, NaN turned into null."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.col(quoted(name)).cast("int").cast("double")
    return present(df, name).cast("double")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def rows_of(structs: list[Column]) -> Column:
    """One output row per struct (wide to long without a shuffle)."""
    return F.inline(F.array(*structs))


def melt_numbers(df: DataFrame, columns: list[str], keep: Iterable[str | Column] = ()) -> DataFrame:
    """Long form (kept columns, feature, value) of numeric columns as doubles."""
    kept = [F.col(quoted(k)) if isinstance(k, str) else k for k in keep]
    cells = [
        F.struct(F.lit(c).alias("feature"), number(df, c).alias("value")) for c in columns
    ]
    return df.select(*kept, rows_of(cells))


def melt_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (column, value) with every value as text."""
    cells = [
        F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value"))
        for c in columns
    ]
    return df.select(rows_of(cells))


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")


def few_values(df: DataFrame, value: Column, limit: int) -> list | None:
    """The distinct non-null values when there are at most `limit` of them, else None.

    A sketch of one number per task decides first, so values are only brought together
    where there are few.
    """
    rows = df.select(value.alias("v")).where(F.col("v").isNotNull())
    if rows.agg(F.approx_count_distinct("v", 0.05)).first()[0] > 2 * limit + 8:
        return None
    some = [r["v"] for r in rows.distinct().limit(limit + 1).collect()]
    return some if len(some) <= limit else None


def distinct_counts(df: DataFrame, values: dict[str, Column], undecided, more: list[Column]) -> tuple:
    """The row of the aggregates `more` (with `rows`), and distinct values per named column.

    All columns are sketched in the pass of the other aggregates. Counts that the sketch
    (within 2 %) puts in the range that `undecided(rows)` gives, with a margin, are replaced
    by exact ones; no other column is multiplied out for a distinct count.
    """
    sketches = [F.approx_count_distinct(v, 0.02).alias(f"__u{i}") for i, v in enumerate(values.values())]
    row = df.agg(*more, *sketches).first()
    low, high = undecided(row["rows"])
    counts = {c: row[f"__u{i}"] for i, c in enumerate(values)}
    close = [c for c, n in counts.items() if 0.85 * low <= n <= 1.15 * high + 3]
    if close:
        exact = df.agg(*[F.count_distinct(values[c]).alias(f"u{i}") for i, c in enumerate(close)]).first()
        counts.update({c: exact[f"u{i}"] for i, c in enumerate(close)})
    return row, counts
