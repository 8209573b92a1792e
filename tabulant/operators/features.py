"""Numeric feature generation and scaling; every operator is one wide projection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import number, numeric_columns, quoted, require
from tabulant.core.lookup import attach
from tabulant.core.ordered import exact_quantiles, with_slices
from tabulant.operators.encode import encode_categoricals
from tabulant.operators.profile import target_correlations

TRANSFORMS = ["polynomial", "trigonometric", "logarithmic", "binning"]
ENCODINGS = ["auto", "one_hot", "label", "ordinal", "frequency", "target_mean"]


def _extended(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in new.items()])


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Minimum, maximum, present and total rows of each column in one pass."""
    cells = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = number(df, c)
        cells += [
            F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    row = df.agg(*cells).first()
    return {
        c: {"lo": row[f"lo{i}"], "hi": row[f"hi{i}"], "n": row[f"n{i}"], "rows": row["rows"]}
        for i, c in enumerate(columns)
    }


def _powers(df, columns, degree):
    return {
        f"{c}_pow_{d}": F.pow(number(df, c), F.lit(float(d)))
        for c in columns
        for d in range(2, degree + 1)
    }


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """`{col}_pow_d` for d = 2..degree."""
    require(df, columns)
    return _extended(df, _powers(df, columns, degree))


def _waves(df, columns):
    new = {}
    for c in columns:
        new[f"{c}_sin"] = F.sin(number(df, c))
        new[f"{c}_cos"] = F.cos(number(df, c))
    return new


def trig_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`{col}_sin` and `{col}_cos`."""
    require(df, columns)
    return _extended(df, _waves(df, columns))


def _logs(df, columns, base, ranges):
    new = {}
    for c in columns:
        lo = ranges[c]["lo"]
        shift = abs(lo) + 1e-10 if lo is not None and lo <= 0 else 0.0
        x = number(df, c) + F.lit(shift)
        if base == math.e:
            new[f"{c}_log"] = F.ln(x)
        elif base == 10:
            new[f"{c}_log10"] = F.log10(x)
        else:
            new[f"{c}_log_{base}"] = F.ln(x) / F.lit(math.log(base))
    return new


def log_features(df: DataFrame, columns: Sequence[str], base: float = math.e) -> DataFrame:
    """Logarithm of x, moved up by |min| + 1e-10 where the minimum is not positive."""
    require(df, columns)
    return _extended(df, _logs(df, columns, base, _ranges(df, columns)))


def _uniform_bins(df, columns, bins, ranges):
    new = {}
    for c in columns:
        lo, hi = ranges[c]["lo"], ranges[c]["hi"]
        x = number(df, c)
        if lo is None or hi == lo:
            new[f"{c}_binned"] = F.when(x.isNotNull(), F.lit(0))
            continue
        width = (hi - lo) / bins
        code = F.floor((x - F.lit(lo)) / F.lit(width)).cast("int")
        new[f"{c}_binned"] = F.least(code, F.lit(bins - 1)) + F.when(x.isNull(), F.lit(None)).otherwise(0)
    return new


def bin_uniform(df: DataFrame, columns: Sequence[str], bins: int = 5) -> DataFrame:
    """`{col}_binned`: equal-width bin 0..bins-1, the maximum in the last bin."""
    require(df, columns)
    return _extended(df, _uniform_bins(df, columns, bins, _ranges(df, columns)))


def quantile_code(x: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below x; equal edges count once."""
    inner = sorted(set(edges))[1:-1]
    code = F.lit(0)
    for e in inner:
        code = code + (x >= F.lit(float(e))).cast("int")
    return F.when(x.isNotNull(), code)


def with_quantile_codes(df: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """Double columns replaced by their `quantile_code`, found by binary search.

    Many codes of many edges, written out as comparisons, make a method too long for the JVM
    to compile. Edges that are not finite are compared.
    """
    inner = {c: sorted({float(e) + 0.0 for e in es})[1:-1] for c, es in edges.items()}
    found = [c for c, es in inner.items() if all(map(math.isfinite, es))]
    # the search tells -0.0 from 0.0, a comparison does not
    known = df.select(
        *[(F.col(quoted(c)) + F.lit(0.0)).alias(c) if c in found else quoted(c) for c in df.columns]
    )
    cut = with_slices(known, found, inner, [f"__code_{c}" for c in found])
    codes = {
        c: F.when(F.col(quoted(c)).isNotNull(), F.col(quoted(f"__code_{c}")).cast("int"))
        if c in found
        else quantile_code(F.col(quoted(c)), es)
        for c, es in edges.items()
    }
    return cut.select(*[codes[c].alias(c) if c in codes else quoted(c) for c in df.columns])


def quantile_edges_of(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    points = [i / bins for i in range(bins + 1)]
    found = exact_quantiles(df, columns, points)
    return {c: [q for q in qs if q is not None] for c, qs in found.items()}


def bin_quantile(df: DataFrame, columns: Sequence[str], bins: int = 5) -> DataFrame:
    """`{col}_binned`: quantile bin with interpolated edges; equal edges are merged."""
    require(df, columns)
    edges = quantile_edges_of(df, columns, bins)
    return _extended(
        df, {f"{c}_binned": quantile_code(number(df, c), edges[c]) for c in columns}
    )


def _products(df, columns, limit):
    pairs = list(combinations(columns, 2))[:limit]
    return {f"{a}_{b}_interaction": number(df, a) * number(df, b) for a, b in pairs}


def interaction_features(
    df: DataFrame, columns: Sequence[str], max_features: int = 10
) -> DataFrame:
    """`{a}_{b}_interaction` products of column pairs, in column order."""
    require(df, columns)
    return _extended(df, _products(df, columns, max_features))


def group_statistics(
    df: DataFrame,
    group_columns: Sequence[str],
    value_columns: Sequence[str],
    functions: Sequence[str] = ("mean", "std", "min", "max"),
) -> DataFrame:
    """`{value}_{function}_by_{group}` joined back to every row of the group."""
    require(df, [*group_columns, *value_columns])
    known = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    unknown = [f for f in functions if f not in known]
    if unknown:
        raise ValueError(f"unknown functions: {unknown}")
    out = df
    for g in group_columns:
        stats = (
            df.where(F.col(quoted(g)).isNotNull())
            .groupBy(quoted(g))
            .agg(
                F.count(F.lit(1)).alias("__n"),
                *[
                    known[f](number(df, v)).alias(f"{v}_{f}_by_{g}")
                    for v in value_columns
                    for f in functions
                ],
            )
        )
        out = attach(out, stats, [g], weight="__n")
    added = [f"{v}_{f}_by_{g}" for g in group_columns for v in value_columns for f in functions]
    return out.select(*[quoted(c) for c in [*df.columns, *added]])


def auto_numeric_features(
    df: DataFrame, columns: Sequence[str] | None = None, max_features: int = 50
) -> DataFrame:
    """Log, root, square and five quantile bins where the values allow, up to a cap."""
    columns = list(columns or numeric_columns(df))
    ranges = _ranges(df, columns)
    usable = [c for c in columns if ranges[c]["rows"] and ranges[c]["n"] >= ranges[c]["rows"] / 2]
    plan: list[tuple[str, str]] = []
    for c in usable:
        lo = ranges[c]["lo"]
        if lo is not None and lo > 0:
            plan.append((c, "log"))
        if lo is not None and lo >= 0:
            plan.append((c, "sqrt"))
        plan += [(c, "pow_2"), (c, "binned")]
    plan = plan[:max_features]
    binned = [c for c, kind in plan if kind == "binned"]
    edges = quantile_edges_of(df, binned, 5) if binned else {}
    new = {}
    for c, kind in plan:
        x = number(df, c)
        new[f"{c}_{kind}"] = {
            "log": lambda: F.ln(x + F.lit(1e-10)),
            "sqrt": lambda: F.sqrt(x),
            "pow_2": lambda: x * x,
            "binned": lambda: quantile_code(x, edges[c]),
        }[kind]()
    return _extended(df, new)


def strongest_columns(df: DataFrame, target: str, columns: Sequence[str], k: int) -> list[str]:
    """The k columns with the largest absolute correlation with the target."""
    rows = target_correlations(df, target, columns).collect()
    strength = {r["feature"]: abs(r["r"] or 0.0) for r in rows}
    return sorted(columns, key=lambda c: -strength[c])[:k]


def auto_interactions(
    df: DataFrame,
    target: str | None = None,
    columns: Sequence[str] | None = None,
    max_features: int = 50,
) -> DataFrame:
    """Products among the five columns most correlated with the target."""
    columns = list(columns or numeric_columns(df, exclude=[target] if target else []))
    top = strongest_columns(df, target, columns, 5) if target else columns[:5]
    return _extended(df, _products(df, top, max_features))


def _ratios(df, columns, limit, ranges):
    new = {}
    for a, b in permutations(columns, 2):
        lo, hi = ranges[b]["lo"], ranges[b]["hi"]
        if len(new) >= limit:
            break
        if lo is None or (lo == 0 and hi == 0):
            continue
        y = number(df, b)
        new[f"{a}_div_{b}"] = F.try_divide(number(df, a), y + F.signum(y) * F.lit(1e-10))
    return new


def ratio_features(
    df: DataFrame, columns: Sequence[str] | None = None, max_features: int = 50
) -> DataFrame:
    """`{a}_div_{b}` for ordered pairs; null where b is 0."""
    columns = list(columns or numeric_columns(df))
    return _extended(df, _ratios(df, columns, max_features, _ranges(df, columns)))


def _replaced(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(
        *[new[c].alias(c) if c in new else F.col(quoted(c)) for c in df.columns]
    )


def scale_standard(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    columns = list(columns or numeric_columns(df))
    cells = []
    for i, c in enumerate(columns):
        v = number(df, c)
        cells += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*cells).first()
    return _replaced(
        df,
        {
            c: (number(df, c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
        },
    )


def scale_minmax(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each column moved to [0, 1]; a constant column becomes 0."""
    columns = list(columns or numeric_columns(df))
    ranges = _ranges(df, columns)
    new = {}
    for c in columns:
        lo, hi = ranges[c]["lo"], ranges[c]["hi"]
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        new[c] = (number(df, c) - F.lit(lo)) / F.lit(float(width))
    return _replaced(df, new)


def basic_features(
    df: DataFrame,
    numeric_transforms: Sequence[str] | None = None,
    max_interactions: int = 5,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Powers, waves, logs, bins and products of the first numeric columns."""
    columns = list(columns or numeric_columns(df))
    transforms = ["polynomial"] if numeric_transforms is None else list(numeric_transforms)
    unknown = [t for t in transforms if t not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    if not columns:
        return df
    ranges = _ranges(df, columns) if {"logarithmic", "binning"} & set(transforms) else {}
    new: dict[str, Column] = {}
    if "polynomial" in transforms:
        new.update(_powers(df, columns[:5], 2))
    if "trigonometric" in transforms:
        new.update(_waves(df, columns[:3]))
    if "logarithmic" in transforms:
        positive = [c for c in columns if ranges[c]["lo"] is not None and ranges[c]["lo"] > 0]
        new.update(_logs(df, positive[:3], math.e, ranges))
    if "binning" in transforms:
        new.update(_uniform_bins(df, columns[:3], 5, ranges))
    if max_interactions > 0 and len(columns) >= 2:
        new.update(_products(df, columns[:5], max_interactions))
    return _extended(df, new)


def prepare_features(
    df: DataFrame,
    target: str | None = None,
    encoding_method: str = "auto",
    numeric_transforms: Sequence[str] | None = None,
    max_interactions: int = 5,
    max_cardinality: int = 20,
    orderings: Mapping[str, Sequence] | None = None,
    row_key: str | None = None,
) -> DataFrame:
    """Check the arguments, encode text columns, then add numeric features."""
    if encoding_method not in ENCODINGS:
        raise ValueError(f"unknown encoding method: {encoding_method}")
    unknown = [t for t in numeric_transforms or [] if t not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    if target is not None:
        require(df, [target])
    if df.isEmpty():
        raise ValueError("the table is empty")
    encoded = encode_categoricals(
        df, target, encoding_method, max_cardinality, orderings, row_key
    )
    skip = [c for c in (target, row_key) if c]
    return basic_features(
        encoded, numeric_transforms, max_interactions, numeric_columns(encoded, exclude=skip)
    )


def auto_features(
    df: DataFrame,
    target: str | None = None,
    max_features: int = 50,
    feature_types: Sequence[str] = ("numeric", "interaction", "ratio"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Numeric, interaction and ratio features of the original numeric columns."""
    columns = list(columns or numeric_columns(df, exclude=[target] if target else []))
    out = df
    if "numeric" in feature_types:
        out = auto_numeric_features(out, columns, max_features)
    if "interaction" in feature_types and len(columns) >= 2:
        top = strongest_columns(df, target, columns, 5) if target else columns[:5]
        out = _extended(out, _products(out, top, max_features))
    if "ratio" in feature_types and len(columns) >= 2:
        out = _extended(out, _ratios(out, columns, max_features, _ranges(df, columns)))
    return out
