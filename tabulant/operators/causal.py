"""Effect of one column on another, adjusted for given confounders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import number, require, rows_of
from tabulant.core.shuffle import shuffle_column
from tabulant.functions.special import t_quantile, t_two_sided
from tabulant.operators.stats import linear_fit


def causal_effect(
    df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str] = ()
) -> DataFrame:
    """Back-door linear adjustment: treatment coefficient with a 95 % interval.

    The adjustment set is the list of confounders; a star-shaped graph has no
    instruments and no front-door variables.
    """
    require(df, [treatment, outcome, *confounders])
    fit = linear_fit(df, [treatment, *confounders], outcome)
    effect, err = float(fit.coef[0]), float(fit.std_err[0])
    low = high = p = None
    if fit.df2 > 0 and err == err:
        reach = t_quantile(0.975, fit.df2) * err
        low, high = effect - reach, effect + reach
        p = t_two_sided(effect / err, fit.df2) if err > 0 else None
    return df.sparkSession.createDataFrame(
        [(treatment, outcome, list(confounders), "linear adjustment", effect, err, low, high, p, fit.n)],
        "treatment string, outcome string, confounders array<string>, method string, "
        "effect double, std_error double, ci_low double, ci_high double, p_value double, n long",
    )


def causal_priorities(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """|slope| of the target on each feature alone; 0 where it is undefined."""
    y = number(df, target)
    cells = []
    for i, c in enumerate(features):
        x = F.when(y.isNotNull(), number(df, c))
        cells += [F.covar_samp(x, y).alias(f"c{i}"), F.var_samp(x).alias(f"v{i}")]
    return df.agg(*cells).select(
        rows_of(
            [
                F.struct(
                    F.lit(c).alias("feature"),
                    F.coalesce(
                        F.abs(F.try_divide(F.col(f"c{i}"), F.col(f"v{i}"))), F.lit(0.0)
                    ).alias("causal_score"),
                )
                for i, c in enumerate(features)
            ]
        )
    )


def placebo_check(
    df: DataFrame,
    treatment: str,
    outcome: str,
    confounders: Sequence[str] = (),
    row_key: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """The effect again after the treatment has been shuffled; it should be near 0."""
    real = causal_effect(df, treatment, outcome, confounders).first()
    keep = [c for c in {treatment, outcome, *confounders, row_key} if c]
    fake = causal_effect(
        shuffle_column(df.select(*keep), treatment, row_key, seed), treatment, outcome, confounders
    ).first()
    passed = fake["ci_low"] is not None and abs(fake["effect"]) <= max(
        4 * fake["std_error"], 0.1 * abs(real["effect"])
    )
    return df.sparkSession.createDataFrame(
        [(treatment, outcome, real["effect"], fake["effect"], fake["std_error"], passed)],
        "treatment string, outcome string, effect double, placebo_effect double, "
        "placebo_error double, passed boolean",
    )
