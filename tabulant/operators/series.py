"""Time series: trend, season, forecasts and anomalies of many series at once.

Rows get their position in the series from sliced ordering, and windows run over
blocks of rows with their neighbours, so one very long series is spread over tasks
like many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.core.columns import number, quoted
from tabulant.core.lookup import attach
from tabulant.core.ordered import (
    ROWS_PER_BLOCK,
    block_window,
    own_rows,
    positions,
    quantile_edges,
    series_blocks,
    slice_count,
    with_slices,
)
from tabulant.functions.special import t_p

# fixed values: least rows of a series and the period assumed for it
DEFAULT_PERIODS = [(365, 365), (52, 52), (12, 12), (0, 2)]

BLOCKS_PER_RUN = 1_000


def series_rows(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """(series, order, value, position) of the present values, numbered from 0."""
    rows = df.select(
        quoted(series), quoted(order), number(df, value).alias(value)
    ).dropna()
    return positions(rows, order, by=[series])


def detect_trend(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """Slope, intercept, r squared, p and |r| of the value on its position."""
    rows = series_rows(df, series, order, value)
    fit = rows.groupBy(quoted(series)).agg(
        F.regr_slope(value, "position").alias("slope"),
        F.regr_intercept(value, "position").alias("intercept"),
        F.regr_r2(value, "position").alias("r_squared"),
        F.count(F.lit(1)).alias("n"),
    )
    spread = 1 - F.col("r_squared")
    t = F.when(spread <= 0, F.lit(float("inf"))).otherwise(
        F.sqrt(F.try_divide(F.col("r_squared") * (F.col("n") - 2), spread))
    )
    return fit.withColumn("t", t).select(
        series,
        "slope",
        "intercept",
        "r_squared",
        t_p("t", F.col("n") - 2).alias("p_value"),
        F.sqrt("r_squared").alias("strength"),
        "n",
    )


def _decomposed(rows: DataFrame, series: str, value: str, period: int, block_rows: int):
    half = period // 2
    w = block_window([series], "position")
    blocks = series_blocks(rows, "position", half, half, block_rows)
    around = w.rowsBetween(-half, half)
    total = F.sum(value).over(around)
    if period % 2 == 0:
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        total = total - ends / 2
    # only windows that are whole have a trend
    whole = F.count(value).over(around) == 2 * half + 1
    trended = own_rows(blocks.withColumn("trend", F.when(whole, total / period)))
    phased = trended.withColumn("phase", F.pmod("position", F.lit(period)))
    phases = phased.groupBy(quoted(series), "phase").agg(
        F.avg(F.col(value) - F.col("trend")).alias("raw"), F.count(F.lit(1)).alias("__n")
    )
    per_series = Window.partitionBy(series)
    season = phases.select(
        quoted(series),
        "phase",
        "__n",
        (F.col("raw") - F.avg("raw").over(per_series)).alias("seasonal"),
    )
    return attach(phased, season, [series, "phase"], weight="__n").withColumn(
        "residual", F.col(value) - F.col("trend") - F.col("seasonal")
    )


def seasonal_decompose(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    period: int,
    block_rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Additive trend, seasonal and residual part of every row.

    The trend is the centred moving average (half weights at both ends of an even
    period) and null where the window is not whole.
    """
    rows = series_rows(df, series, order, value)
    out = _decomposed(rows, series, value, period, block_rows)
    return out.select(series, order, value, "position", "trend", "seasonal", "residual")


def seasonal_strength(
    df: DataFrame, series: str, order: str, value: str, period: int | None = None
) -> DataFrame:
    """Variance of the seasonal part over the variance of the values, per series.

    Without a period one is assumed from the length; under two cycles gives 0.
    """
    rows = series_rows(df, series, order, value)
    sizes = rows.groupBy(quoted(series)).agg(F.count(F.lit(1)).alias("n"))
    if period is None:
        assumed = F.lit(DEFAULT_PERIODS[-1][1])
        for least, p in reversed(DEFAULT_PERIODS[:-1]):
            assumed = F.when(F.col("n") >= least, p).otherwise(assumed)
    else:
        assumed = F.lit(period)
    sizes = sizes.withColumn("period", assumed)
    periods = sorted(r["period"] for r in sizes.select("period").distinct().collect())
    marked = attach(rows, sizes.withColumn("__w", F.col("n")), [series], weight="__w")
    parts = []
    for p in periods:
        mine = marked.where((F.col("period") == p) & (F.col("n") >= 2 * p))
        parts.append(_decomposed(mine, series, value, p, ROWS_PER_BLOCK).select(series, value, "seasonal"))
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    if found is None:
        return sizes.select(series, "period", "n", F.lit(0.0).alias("seasonal_strength"))
    shares = found.groupBy(quoted(series)).agg(
        F.try_divide(F.var_pop("seasonal"), F.var_pop(value)).alias("share")
    )
    return sizes.join(shares, series, "left").select(
        series, "period", "n", F.coalesce("share", F.lit(0.0)).alias("seasonal_strength")
    )


def _rate_grid(points: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.linspace(0.05, 0.95, points)
    a, b = np.meshgrid(steps, steps, indexing="ij")
    return a.ravel(), b.ravel()


def forecast(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    steps: int = 5,
    grid_points: int = 7,
    block_rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Additive-trend exponential smoothing, `steps` ahead.

    One smoothing step is linear in (level, trend), and the squared error quadratic.
    A block of rows is therefore summarised, for every pair of rates on the grid, by
    one small matrix pair; blocks are chained and the best rates picked per series.
    Series with under three values forecast their mean.
    """
    alpha, beta = _rate_grid(grid_points)
    g = len(alpha)
    rows = series_rows(df, series, order, value)
    blocks = rows.withColumn("__block", F.floor(F.col("position") / block_rows))
    kind = df.schema[series].dataType.simpleString()

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        y = pdf[value].to_numpy(dtype="float64")
        pos = pdf["position"].to_numpy()
        chain = np.tile(np.eye(3), (g, 1, 1))
        error = np.zeros((g, 3, 3))
        step = np.zeros((g, 3, 3))
        step[:, 0, 0] = step[:, 0, 1] = 1 - alpha
        step[:, 1, 0] = -alpha * beta
        step[:, 1, 1] = 1 - alpha * beta
        step[:, 2, 2] = 1.0
        for t, v in zip(pos, y):
            if t == 0:
                continue
            miss = -chain[:, 0, :] - chain[:, 1, :]
            miss[:, 2] += v
            error += miss[:, :, None] * miss[:, None, :]
            step[:, 0, 2], step[:, 1, 2] = alpha * v, alpha * beta * v
            chain = step @ chain
        return pd.DataFrame(
            {
                series: [pdf[series].iloc[0]],
                "block": [int(pdf["__block"].iloc[0])],
                "chain": [chain.ravel()],
                "error": [error.ravel()],
                "first": [y[0]],
                "second": [y[1] if len(y) > 1 else np.nan],
                "n": [len(y)],
                "total": [y.sum()],
            }
        )

    def chained(pdf):
        chain = np.tile(np.eye(3), (g, 1, 1))
        error = np.zeros((g, 3, 3))
        for c, e in zip(pdf["chain"], pdf["error"]):
            c, e = np.asarray(c).reshape(g, 3, 3), np.asarray(e).reshape(g, 3, 3)
            error += chain.transpose(0, 2, 1) @ e @ chain
            chain = c @ chain
        return chain, error

    def run_of_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        chain, error = chained(pdf)
        second = pdf["second"].iloc[0]
        if np.isnan(second) and len(pdf) > 1:
            second = pdf["first"].iloc[1]
        return pd.DataFrame(
            {
                series: [pdf[series].iloc[0]],
                "block": [int(pdf["block"].iloc[0])],
                "chain": [chain.ravel()],
                "error": [error.ravel()],
                "first": [pdf["first"].iloc[0]],
                "second": [second],
                "n": [int(pdf["n"].sum())],
                "total": [pdf["total"].sum()],
            }
        )

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        n = int(pdf["n"].sum())
        ahead = np.arange(1, steps + 1)
        if n < 3:
            values = np.full(steps, pdf["total"].sum() / n)
            rates = (np.nan, np.nan)
        else:
            y0, y1 = pdf["first"].iloc[0], pdf["second"].iloc[0]
            if np.isnan(y1):
                y1 = pdf["first"].iloc[1]
            chain, error = chained(pdf)
            start = np.array([y0, y1 - y0, 1.0])
            sse = np.einsum("i,gij,j->g", start, error, start)
            best = int(np.argmin(np.round(sse, 12)))
            level, trend, _ = chain[best] @ start
            values = level + trend * ahead
            rates = (alpha[best], beta[best])
        return pd.DataFrame(
            {
                series: pdf[series].iloc[0],
                "step": ahead,
                "forecast": values,
                "level_rate": rates[0],
                "trend_rate": rates[1],
            }
        )

    key = quoted(series)
    shape = (
        f"{key} {kind}, block long, chain array<double>, error array<double>, "
        "first double, second double, n long, total double"
    )
    summaries = blocks.groupBy(key, "__block").applyInPandas(summarise, shape)
    # runs of blocks are joined up first, so that no task holds all blocks of a series
    summaries = summaries.groupBy(
        key, F.floor(F.col("block") / BLOCKS_PER_RUN).alias("__run")
    ).applyInPandas(run_of_blocks, shape)
    return summaries.groupBy(key).applyInPandas(
        combine,
        f"{key} {kind}, step int, forecast double, level_rate double, trend_rate double",
    )


def moving_average_forecast(
    df: DataFrame, series: str, order: str, value: str, steps: int = 5
) -> DataFrame:
    """The last 3-point moving average, or the mean of a shorter series, repeated."""
    rows = series_rows(df, series, order, value)
    sizes = rows.groupBy(quoted(series)).agg(F.max("position").alias("last"), F.count(F.lit(1)).alias("__n"))
    tail = attach(rows, sizes, [series], weight="__n").where(F.col("position") > F.col("last") - 3)
    return (
        tail.groupBy(quoted(series))
        .agg(F.avg(value).alias("forecast"))
        .select(series, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "forecast")
    )


def make_sequences(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    length: int = 10,
    block_rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The `length` values before each row, with the row's value as the label."""
    rows = series_rows(df, series, order, value)
    blocks = series_blocks(rows, "position", before=length, rows=block_rows)
    w = block_window([series], "position").rowsBetween(-length, -1)
    out = own_rows(blocks.withColumn("window", F.collect_list(value).over(w)))
    return out.where(F.size("window") == length).select(
        series, "position", "window", F.col(value).alias("label")
    )


def lagged(
    rows: DataFrame, series: str, value: str, lags: Sequence[int], block_rows: int = ROWS_PER_BLOCK
) -> DataFrame:
    """`{value}_lag_k` columns of positioned rows."""
    blocks = series_blocks(rows, "position", before=max(lags), rows=block_rows)
    w = block_window([series], "position")
    return own_rows(
        blocks.select(
            "*", *[F.lag(value, k).over(w).alias(f"{value}_lag_{k}") for k in lags]
        )
    )


def ar_forecast(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    steps: int = 5,
    season: int = 1,
    block_rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """AR(1) on (seasonal) differences, rolled forward `steps` ahead.

    Differences are taken at lag `season` (1 = plain); each is regressed on the one
    before it. Too short a series repeats its last value or season.
    """
    rows = series_rows(df, series, order, value)
    wide = lagged(rows, series, value, sorted({1, season, season + 1}), block_rows)
    now = F.col(value) - F.col(f"{value}_lag_{season}")
    before = F.col(f"{value}_lag_1") - F.col(f"{value}_lag_{season + 1}")
    fit = wide.groupBy(quoted(series)).agg(
        F.coalesce(F.regr_slope(now, before), F.lit(0.0)).alias("b"),
        F.coalesce(F.regr_intercept(now, before), F.lit(0.0)).alias("a"),
        F.max("position").alias("last"),
        F.coalesce(F.max_by(now, "position"), F.lit(0.0)).alias("d"),
        F.count(F.lit(1)).alias("__n"),
    )
    tail = (
        attach(rows, fit.select(series, "last", "__n"), [series], weight="__n")
        .where(F.col("position") > F.col("last") - season)
        .groupBy(quoted(series))
        .agg(F.sort_array(F.collect_list(F.struct("position", value))).alias("tail"))
    )
    h = F.col("step")
    state = fit.join(tail, series).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(steps)))
    )
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    level = F.try_divide(a, 1 - b)

    def difference(k):
        # k-th difference ahead in closed form
        return F.when(F.abs(1 - b) < 1e-12, d + a * k).otherwise(
            level + F.pow(b, k.cast("double")) * (d - level)
        )

    size = F.size("tail")
    start = F.col("tail")[F.pmod(h - 1, size)][value]
    cycles = F.floor((h - 1) / season)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), cycles),
        F.lit(0.0),
        lambda acc, j: acc + difference(h - j * season),
    )
    return state.select(series, "step", (start + total).alias("forecast"))


def _fourier(position, period: float, harmonics: int):
    terms = []
    for k in range(1, harmonics + 1):
        angle = F.pmod(position * k, F.lit(period)) * (2 * np.pi / period)
        terms += [F.sin(angle), F.cos(angle)]
    return terms


def _seasonal_fit(rows: DataFrame, series: str, value: str, period: float, harmonics: int):
    """Least-squares weights (intercept, trend, waves) per series from one aggregate."""
    p = F.col("position").cast("double")
    cols = ["x0"] + [f"x{i + 1}" for i in range(2 * harmonics)]
    wide = rows.select(
        quoted(series),
        F.col(value).alias("y"),
        p.alias("x0"),
        *[t.alias(f"x{i + 1}") for i, t in enumerate(_fourier(p, period, harmonics))],
    )
    names = [*cols, "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    stats = wide.groupBy(quoted(series)).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("means"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("cov"),
        F.max("x0").cast("long").alias("last"),
    )
    kind = rows.schema[series].dataType.simpleString()
    m = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights = []
            for means, cov in zip(pdf["means"], pdf["cov"]):
                c = np.zeros((m, m))
                for (i, j), v in zip(pairs, cov):
                    c[i, j] = c[j, i] = v
                scale = np.sqrt(np.diag(c)[:-1])
                scale[scale == 0] = 1.0
                inner = c[:-1, :-1] / np.outer(scale, scale)
                w = np.linalg.pinv(inner, rcond=1e-10) @ (c[:-1, -1] / scale) / scale
                weights.append([float(means[-1] - w @ np.array(means[:-1])), *w.tolist()])
            yield pd.DataFrame(
                {series: pdf[series], "weights": weights, "last": pdf["last"], "__n": pdf["n"]}
            )

    return stats.mapInPandas(
        solve, f"{quoted(series)} {kind}, weights array<double>, last long, __n long"
    )


def _seasonal_value(position, period: float, harmonics: int):
    w = F.col("weights")
    out = w[0] + w[1] * position
    for i, t in enumerate(_fourier(position, period, harmonics)):
        out = out + w[i + 2] * t
    return out


def seasonal_regression_forecast(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    period: float,
    steps: int = 5,
    harmonics: int = 2,
) -> DataFrame:
    """Linear trend plus Fourier terms of the period, fitted per series, `steps` ahead."""
    rows = series_rows(df, series, order, value)
    fit = _seasonal_fit(rows, series, value, period, harmonics)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at = (F.col("last") + F.col("step")).cast("double")
    return ahead.select(
        series, "step", _seasonal_value(at, period, harmonics).alias("forecast")
    )


def model_residuals(
    df: DataFrame,
    series: str,
    order: str,
    value: str,
    model: str = "trend",
    period: float = 7,
    harmonics: int = 2,
) -> DataFrame:
    """Value minus the fitted value of a trend, ar or seasonal model, per row."""
    rows = series_rows(df, series, order, value)
    if model == "ar":
        wide = lagged(rows, series, value, [1, 2])
        now = F.col(value) - F.col(f"{value}_lag_1")
        before = F.col(f"{value}_lag_1") - F.col(f"{value}_lag_2")
        fit = wide.groupBy(quoted(series)).agg(
            F.regr_slope(now, before).alias("b"),
            F.regr_intercept(now, before).alias("a"),
            F.count(F.lit(1)).alias("__n"),
        )
        out = attach(wide, fit, [series], weight="__n")
        residual = now - F.col("a") - F.col("b") * before
    elif model == "seasonal":
        fit = _seasonal_fit(rows, series, value, period, harmonics).drop("last")
        out = attach(rows, fit, [series], weight="__n")
        residual = F.col(value) - _seasonal_value(
            F.col("position").cast("double"), period, harmonics
        )
    elif model == "trend":
        fit = rows.groupBy(quoted(series)).agg(
            F.regr_slope(value, "position").alias("b"),
            F.regr_intercept(value, "position").alias("a"),
            F.count(F.lit(1)).alias("__n"),
        )
        out = attach(rows, fit, [series], weight="__n")
        residual = F.col(value) - F.col("a") - F.col("b") * F.col("position")
    else:
        raise ValueError(f"unknown model: {model}")
    return out.select(series, order, value, "position", residual.alias("residual"))


def residual_anomalies(
    residuals: DataFrame,
    series: str,
    method: str = "zscore",
    threshold: float = 2.0,
    quantile: float = 0.95,
) -> DataFrame:
    """Flag rows whose residual is unusual within its series.

    zscore: |z| above the threshold (sample deviation); error: |residual| above its
    mean plus threshold deviations; quantile: |residual| above its exact quantile.
    """
    r = F.col("residual")
    if method == "zscore":
        stats = residuals.groupBy(quoted(series)).agg(
            F.avg(r).alias("__m"), F.stddev_samp(r).alias("__s"), F.count(F.lit(1)).alias("__n")
        )
        flag = F.abs(F.try_divide(r - F.col("__m"), F.col("__s"))) > threshold
    elif method == "error":
        stats = residuals.groupBy(quoted(series)).agg(
            F.avg(F.abs(r)).alias("__m"),
            F.stddev_pop(F.abs(r)).alias("__s"),
            F.count(F.lit(1)).alias("__n"),
        )
        flag = F.abs(r) > F.col("__m") + threshold * F.col("__s")
    elif method == "quantile":
        stats = _series_quantile(residuals, series, quantile)
        flag = F.abs(r) > F.col("__m")
    else:
        raise ValueError(f"unknown method: {method}")
    joined = attach(residuals, stats, [series], weight="__n")
    return joined.select(
        *[quoted(c) for c in residuals.columns], F.coalesce(flag, F.lit(False)).alias("anomaly")
    )


def _series_quantile(residuals: DataFrame, series: str, q: float) -> DataFrame:
    """Interpolated quantile of |residual| per series.

    Equal values are counted first, and the counts are added up slice by slice.
    """
    errors = residuals.where(F.col("residual").isNotNull()).select(
        quoted(series), F.abs("residual").alias("__e")
    )
    edges = quantile_edges(errors, ["__e"], slice_count(errors))
    sliced = with_slices(errors, ["__e"], edges, ["__slice"])
    key = [series, "__slice"]
    values = sliced.groupBy(*key, "__e").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*key).orderBy("__e")
    local = values.withColumn("__end", F.sum("__c").over(upto))
    sizes = values.groupBy(*key).agg(F.sum("__c").alias("__m"))
    per_series = Window.partitionBy(series)
    earlier = per_series.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *key,
        F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__off"),
        F.sum("__m").over(per_series).alias("__n"),
    )
    end = F.col("__end") + F.col("__off")
    spans = local.join(offsets, key).select(
        quoted(series), "__e", "__n", (end - F.col("__c")).alias("__from"), end.alias("__to")
    )
    h = (F.col("__n") - 1) * F.lit(q)
    low = F.floor(h)
    high = F.least(low + 1, F.col("__n") - 1)

    def holds(rank):
        return (F.col("__from") <= rank) & (rank < F.col("__to"))

    found = spans.where(holds(low) | holds(high)).groupBy(quoted(series)).agg(
        F.min(F.when(holds(low), F.col("__e"))).alias("__a"),
        F.min(F.when(holds(high), F.col("__e"))).alias("__b"),
        F.first(h - low).alias("__f"),
        F.first("__n").alias("__n"),
    )
    return found.select(
        series,
        (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).alias("__m"),
        "__n",
    )
