"""Text columns to numbers."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import few_values, number, quoted, require, text_columns
from tabulant.core.lineage import cut_lineage
from tabulant.core.lookup import attach, sorted_codes


def _distinct_values(df: DataFrame, column: str, limit: int | None) -> list:
    c = F.col(quoted(column))
    if limit is None:
        return sorted(r["v"] for r in df.where(c.isNotNull()).select(c.alias("v")).distinct().collect())
    values = few_values(df, c, limit)
    if values is None:
        raise ValueError(f"column {column} has more than {limit} distinct values")
    return sorted(values)


def encode_one_hot(
    df: DataFrame, columns: Sequence[str], max_values: int | None = None
) -> DataFrame:
    """One 0/1 column `{col}_{value}` per value; the source column is dropped.

    Every value becomes a column of the plan; `max_values` makes more than so many an error.
    """
    require(df, columns)
    kept = [F.col(quoted(c)) for c in df.columns if c not in columns]
    cells = []
    for c in columns:
        for v in _distinct_values(df, c, max_values):
            hit = F.coalesce(F.col(quoted(c)) == F.lit(v), F.lit(False))
            cells.append(hit.cast("int").alias(f"{c}_{v}"))
    return df.select(*kept, *cells)


def encode_label(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`{col}_encoded`: rank of the value among the sorted distinct values, from 0."""
    require(df, columns)
    out = df
    for c in columns:
        out = attach(out, sorted_codes(df, c, f"{c}_encoded"), [c], weight="__n", written=True)
    return out.select(*[quoted(c) for c in df.columns], *[quoted(f"{c}_encoded") for c in columns])


def encode_ordinal(
    df: DataFrame, columns: Sequence[str], orderings: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """`{col}_encoded` as double: position in the given order, else in sorted order.

    A value that is not in its given order is an error.
    """
    require(df, columns)
    orderings = dict(orderings or {})
    listed = [c for c in columns if c in orderings]
    if listed:
        unknown = df.agg(
            *[
                F.count_if(~F.col(quoted(c)).isin(list(orderings[c]))).alias(f"u{i}")
                for i, c in enumerate(listed)
            ]
        ).first()
        bad = [c for i, c in enumerate(listed) if unknown[f"u{i}"]]
        if bad:
            raise ValueError(f"values outside the given order in: {bad}")
    out = df.select(
        "*",
        *[
            (F.array_position(F.array(*map(F.lit, orderings[c])), F.col(quoted(c))) - 1)
            .cast("double")
            .alias(f"{c}_encoded")
            for c in listed
        ],
    )
    for c in columns:
        if c not in orderings:
            codes = sorted_codes(df, c, "__code").withColumn(
                f"{c}_encoded", F.col("__code").cast("double")
            )
            out = attach(out, codes.drop("__code"), [c], weight="__n", written=True)
    return out.select(*[quoted(c) for c in df.columns], *[quoted(f"{c}_encoded") for c in columns])


def encode_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`{col}_freq_encoded`: rows with the value over rows with any value."""
    require(df, columns)
    pairs = [
        F.struct(F.lit(i).alias("__i"), F.col(quoted(c)).cast("string").alias("__v"))
        for i, c in enumerate(columns)
    ]
    counts = cut_lineage(
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("__v").isNotNull())
        .groupBy("__i", "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    totals = {r["__i"]: r["t"] for r in counts.groupBy("__i").agg(F.sum("__n").alias("t")).collect()}
    out = df
    for i, c in enumerate(columns):
        share = F.col("__n") / F.lit(float(totals.get(i, 1)))
        table = counts.where(F.col("__i") == i).select("__v", "__n", share.alias(f"{c}_freq_encoded"))
        keyed = out.withColumn("__v", F.col(quoted(c)).cast("string"))
        out = attach(keyed, table, ["__v"], weight="__n", written=True).drop("__v")
    return out.select(
        *[quoted(c) for c in df.columns], *[quoted(f"{c}_freq_encoded") for c in columns]
    )


def encode_target_mean(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    row_key: str | None = None,
    folds: int = 5,
) -> DataFrame:
    """`{col}_target_encoded`: mean target of the value over the other folds.

    The fold is the row key modulo `folds` (a hash of the row without one), so the
    same row always falls into the same fold. Values not seen outside the fold get
    the overall mean.
    """
    require(df, [*columns, target, *([row_key] if row_key else [])])
    key = (
        F.col(quoted(row_key))
        if row_key
        else F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    )
    out = df.withColumn("__fold", F.pmod(key, F.lit(folds)))
    overall = df.agg(F.avg(number(df, target))).first()[0]
    # the sums of all columns come from one pass over the rows
    pairs = [
        F.struct(F.lit(i).alias("__i"), F.col(quoted(c)).cast("string").alias("__v"))
        for i, c in enumerate(columns)
    ]
    cells = (
        out.select(number(df, target).alias("__y"), "__fold", F.inline(F.array(*pairs)))
        .where(F.col("__v").isNotNull())
        .groupBy("__i", "__v", "__fold")
        .agg(F.sum("__y").alias("__s"), F.count("__y").alias("__m"), F.count(F.lit(1)).alias("__n"))
    )
    cells = cut_lineage(cells)
    totals = cells.groupBy("__i", "__v").agg(F.sum("__s").alias("__ts"), F.sum("__m").alias("__tm"))
    mean = F.try_divide(
        F.col("__ts") - F.coalesce("__s", F.lit(0.0)), F.col("__tm") - F.col("__m")
    )
    means = cut_lineage(
        cells.join(totals, ["__i", "__v"]).select(
            "__i", "__v", "__fold", "__n", mean.alias("__mean")
        )
    )
    for i, c in enumerate(columns):
        table = means.where(F.col("__i") == i).select(
            "__v", "__fold", "__n", F.col("__mean").alias(f"{c}_target_encoded")
        )
        keyed = out.withColumn("__v", F.col(quoted(c)).cast("string"))
        out = attach(keyed, table, ["__v", "__fold"], weight="__n", written=True).drop("__v")
    return out.select(
        *[quoted(c) for c in df.columns],
        *[
            F.coalesce(F.col(quoted(f"{c}_target_encoded")), F.lit(overall)).alias(
                f"{c}_target_encoded"
            )
            for c in columns
        ],
    )


def low_cardinality_text(df: DataFrame, max_cardinality: int = 20) -> list[str]:
    """Text columns with at most `max_cardinality` distinct values."""
    names = text_columns(df)
    if not names:
        return []
    near = df.agg(
        *[F.approx_count_distinct(quoted(c), 0.05).alias(f"u{i}") for i, c in enumerate(names)]
    ).first()
    # counted exactly only where the sketch does not rule the column out
    names = [c for i, c in enumerate(names) if near[f"u{i}"] <= 2 * max_cardinality + 8]
    if not names:
        return []
    row = df.agg(*[F.count_distinct(quoted(c)).alias(f"u{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"u{i}"] <= max_cardinality]


def encode_categoricals(
    df: DataFrame,
    target: str | None = None,
    method: str = "auto",
    max_cardinality: int = 20,
    orderings: Mapping[str, Sequence] | None = None,
    row_key: str | None = None,
) -> DataFrame:
    """Encode the low-cardinality text columns with one method.

    auto means target_mean when a target is given and one_hot otherwise; an unknown
    method warns and falls back to one_hot.
    """
    names = [c for c in low_cardinality_text(df, max_cardinality) if c not in (target, row_key)]
    if not names:
        return df
    if method == "auto":
        method = "target_mean" if target else "one_hot"
    if method == "target_mean" and target:
        return encode_target_mean(df, names, target, row_key)
    if method == "label":
        return encode_label(df, names)
    if method == "ordinal":
        return encode_ordinal(df, names, orderings)
    if method == "frequency":
        return encode_frequency(df, names)
    if method != "one_hot":
        warnings.warn(f"encoding method {method!r} is not usable here, one_hot is used")
    return encode_one_hot(df, names)
