"""Significance tests, effect sizes and coverage.

Every test gives rows (test, feature, statistic, df1, df2, p_value, n). The rows of
the table are reduced to counts and moments by Spark; only those reach the formulas.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulant.core.columns import few_values, melt_numbers, number, present, quoted
from tabulant.core.gram import LeastSquares, least_squares, moments
from tabulant.core.lineage import cut_lineage
from tabulant.core.logistic import SUBSETS_PER_PASS, logistic_accuracies
from tabulant.core.ordered import value_ranks
from tabulant.functions.special import chi2_p, f_p, f_tail, t_p, t_two_sided
from tabulant.operators.profile import target_type

TEST_SCHEMA = (
    "test string, feature string, statistic double, df1 double, df2 double, "
    "p_value double, n long"
)
UNDEFINED_SIGNIFICANCE = 0.5


def _result(df: DataFrame, test: str, statistic, df1, df2, p, n) -> DataFrame:
    def d(c):
        return (F.lit(c) if not isinstance(c, Column) else c).cast("double")

    return df.select(
        F.lit(test).alias("test"),
        "feature",
        d(statistic).alias("statistic"),
        d(df1).alias("df1"),
        d(df2).alias("df2"),
        d(p).alias("p_value"),
        n.cast("long").alias("n"),
    )


def class_moments(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """n, mean and sample variance per feature and class."""
    return (
        melt_numbers(df, list(features), [present(df, group).cast("string").alias("class")])
        .where(F.col("value").isNotNull() & F.col("class").isNotNull())
        .groupBy("feature", "class")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg("value").alias("mean"),
            F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
        )
    )


def _two_classes(cells: DataFrame, *columns: str) -> DataFrame:
    """One row per feature with both classes side by side; other counts are an error."""
    both = cells.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("class", *columns))).alias("c")
    )
    return both.withColumn(
        "c",
        F.when(F.size("c") == 2, F.col("c")).otherwise(
            F.raise_error(F.lit("the test needs two non-empty groups"))
        ),
    ).select(
        "feature",
        *[F.col("c")[i][name].alias(f"{name}{i + 1}") for i in range(2) for name in columns],
    )


def t_test(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Pooled-variance two-sample t, first class (in sort order) minus second."""
    two = _two_classes(class_moments(df, features, group), "n", "mean", "var")
    n1, n2 = F.col("n1"), F.col("n2")
    dof = n1 + n2 - 2
    pooled = F.try_divide((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2"), dof)
    gap = F.col("mean1") - F.col("mean2")
    stat = F.when(gap == 0, F.lit(0.0)).otherwise(
        F.coalesce(
            F.try_divide(gap, F.sqrt(pooled * (1 / n1 + 1 / n2))),
            F.signum(gap) * F.lit(float("inf")),
        )
    )
    out = two.withColumn("stat", stat).withColumn("dof", dof)
    return _result(out, "t_test", F.col("stat"), F.col("dof"), F.lit(None), t_p("stat", "dof"), n1 + n2)


def _between_within(cells: DataFrame) -> DataFrame:
    per = Window.partitionBy("feature")
    grand = F.sum(F.col("n") * F.col("mean")).over(per) / F.sum("n").over(per)
    gap = F.col("mean") - F.col("grand")
    return (
        cells.withColumn("grand", grand)
        .groupBy("feature")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).cast("double").alias("k"),
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
        )
    )


def anova(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """One-way F over the classes; an undefined F is 0 with p 1."""
    cells = _between_within(class_moments(df, features, group))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    ratio = F.when(
        (d1 > 0) & (d2 > 0),
        F.try_divide(F.try_divide(F.col("between"), d1), F.try_divide(F.col("within"), d2)),
    )
    perfect = (F.col("within") == 0) & (F.col("between") > 0) & (d1 > 0) & (d2 > 0)
    stat = F.when(perfect, F.lit(float("inf"))).otherwise(F.coalesce(ratio, F.lit(0.0)))
    out = cells.withColumn("stat", stat).withColumn("d1", d1).withColumn("d2", d2)
    p = F.coalesce(f_p("stat", "d1", "d2"), F.lit(1.0))
    return _result(out, "anova", F.col("stat"), F.col("d1"), F.col("d2"), p, F.col("n"))


def mann_whitney(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """U of the first class from mid-ranks; normal p with tie and continuity correction."""
    two = _two_classes(value_ranks(df, features, group), "n", "rank_sum", "total", "ties")
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("total1")
    u1 = F.col("rank_sum1") - n1 * (n1 + 1) / 2
    mean = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("ties1"), n * (n - 1)), F.lit(0.0))))
    z = F.try_divide(F.greatest(F.abs(u1 - mean) - 0.5, F.lit(0.0)), sd)
    out = two.withColumn("u", u1).withColumn("z2", F.coalesce(z * z, F.lit(0.0)))
    # P(|Z| > z) is the upper tail of chi-square with one degree of freedom at z^2
    p = chi2_p("z2", 1)
    return _result(out, "mann_whitney", F.col("u"), F.lit(None), F.lit(None), p, n)


def kruskal_wallis(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Tie-corrected H over the classes; an undefined H is 0 with p 1."""
    cells = (
        value_ranks(df, features, group)
        .groupBy("feature")
        .agg(
            F.first("total").alias("n"),
            F.first("ties").alias("ties"),
            F.count(F.lit(1)).cast("double").alias("k"),
            F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"),
        )
    )
    n = F.col("n")
    raw = F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - (n + 1) * 3
    fix = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    out = cells.withColumn(
        "h", F.when(F.col("k") > 1, F.coalesce(F.try_divide(raw, fix), F.lit(0.0))).otherwise(0.0)
    ).withColumn("d", F.col("k") - 1)
    p = F.coalesce(chi2_p("h", "d"), F.lit(1.0))
    return _result(out, "kruskal_wallis", F.col("h"), F.col("d"), F.lit(None), p, n)


def hypergeometric(rng, good: np.ndarray, bad: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many of `wanted` drawn items are good; all three are arrays.

    Beyond the generator's range the draw is normal, which is then exact to many digits.
    """
    good, bad, wanted = np.broadcast_arrays(good, bad, wanted)
    left = good + bad
    share = good / np.maximum(left, 1)
    sd = np.sqrt(wanted * share * (1 - share) * np.maximum(left - wanted, 0) / np.maximum(left - 1, 1))
    normal = np.round(rng.normal(wanted * share, sd))
    far = left >= 1_000_000_000
    near = rng.hypergeometric(np.where(far, 0, good), np.where(far, 0, bad), np.where(far, 0, wanted))
    low, high = np.maximum(0, wanted - bad), np.minimum(good, wanted)
    return np.where(far, np.clip(normal, low, high), near).astype(np.int64)


def hypergeometric_counts(rng, sizes: np.ndarray, wanted: int) -> np.ndarray:
    """How a random choice of `wanted` items spreads over groups of the given sizes."""
    if sizes.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(sizes, int(wanted), method="marginals")
    out = np.zeros(len(sizes), dtype=np.int64)
    left, need = int(sizes.sum()), int(wanted)
    for i, size in enumerate(sizes):
        left -= int(size)
        out[i] = hypergeometric(rng, np.int64(size), np.int64(left), np.int64(need))
        need -= int(out[i])
    return out


def _slice_quota(path: pd.DataFrame, wanted: int, permutations: int, seed: int) -> np.ndarray:
    """Labels of the first class that fall into a slice, for each permutation.

    From the root of the tree of slices down, each node deals its labels to its halves with
    a generator of its own, so every slice below a node draws the same numbers there.
    """
    need = np.full(permutations, wanted, np.int64)
    for level, node, own, other in path.sort_values("level")[["level", "node", "own", "other"]].itertuples(index=False):
        rng = np.random.default_rng([seed, int(level), int(node) >> 1])
        left, right = (own, other) if node % 2 == 0 else (other, own)
        taken = hypergeometric(rng, np.int64(left), np.int64(right), need)
        need = taken if node % 2 == 0 else need - taken
    return need


def _slice_sums(wanted: int, permutations: int, seed: int):
    """Rank sums of the first class within a slice, for each permutation."""

    def run(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        # the order of rows in a group is not fixed, the draw must not depend on it
        rows = rows.sort_values("mid")
        mids, ties = rows["mid"].to_numpy(), rows["t"].to_numpy()
        need = _slice_quota(path, wanted, permutations, seed)
        rng = np.random.default_rng([seed, 1 << 20, int(path["slice"].iloc[0])])
        out, total = np.zeros(permutations), float(ties @ mids)
        few = ties.sum() > 20 * len(ties)
        each = None if few else np.repeat(mids, ties)
        for b, m in enumerate(need):
            if few:
                out[b] = float(hypergeometric_counts(rng, ties, int(m)) @ mids)
            elif m <= len(each) - m:
                out[b] = rng.choice(each, int(m), replace=False, shuffle=False).sum()
            else:
                out[b] = total - rng.choice(each, len(each) - int(m), replace=False, shuffle=False).sum()
        return pd.DataFrame({"b": np.arange(permutations), "s": out})

    return run


def permutation_test(
    df: DataFrame,
    feature: str,
    group: str,
    n_permutations: int = 1000,
    seed: int = 42,
    parts: int | None = None,
) -> DataFrame:
    """Shares of random relabelings whose U is at or above the observed U.

    Rows are first reduced to distinct values with mid-ranks, cut into slices. A binary tree
    over the slices knows how many rows lie below each node; every task draws its way from
    the root to its slice and so learns how many labels of the first class fall there, for
    all relabelings. Rows are never copied per permutation, and the driver sees a result
    per relabeling at most. p_value is the one-sided share, p_two_sided counts U at least as
    far from its mean; u_mean and u_sd are those of the relabelings, expected_mean and
    expected_sd what they tend to.
    """
    from tabulant.core.ordered import quantile_edges, slice_count, with_slices

    base = df.select(
        present(df, group).cast("string").alias("class"), number(df, feature).alias("v")
    ).dropna()
    observed = mann_whitney(df, [feature], group).first()
    first = base.agg(F.min("class")).first()[0]
    parts = parts or slice_count(df)
    sliced = with_slices(base, ["v"], quantile_edges(base, ["v"], parts), ["slice"])
    values = cut_lineage(
        sliced.groupBy(F.col("slice").cast("long").alias("slice"), "v").agg(
            F.count(F.lit(1)).alias("t"), F.count_if(F.col("class") == first).alias("a")
        )
    )
    upto = Window.partitionBy("slice").orderBy("v")
    sizes = cut_lineage(values.groupBy("slice").agg(F.sum("t").alias("rows")))
    before = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select("slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("off"))
    ranked = (
        values.withColumn("upto", F.sum("t").over(upto))
        .join(offsets, "slice")
        .select("slice", "t", (F.col("off") + F.col("upto") - (F.col("t") - 1) / 2).alias("mid"))
    )
    totals = values.agg(
        F.sum("a").alias("n1"), F.sum("t").alias("n"), F.sum(F.expr("double(t) * t * t - t")).alias("ties")
    ).first()
    n1, n, ties = totals["n1"] or 0, totals["n"] or 0, totals["ties"] or 0.0
    n2 = n - n1
    # the way from the root to each slice, with the rows on both sides of each step
    depth = max(1, (max(parts, 1) - 1).bit_length())
    steps = sizes.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn(
        "node", F.floor(F.col("slice") / F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))).cast("long")
    )
    nodes = cut_lineage(steps.groupBy("level", "node").agg(F.sum("rows").alias("own")))
    sides = nodes.join(
        nodes.select("level", F.col("node").bitwiseXOR(F.lit(1)).alias("node"), F.col("own").alias("other")),
        ["level", "node"],
        "left",
    ).fillna(0, ["other"])
    path = steps.select("slice", "level", "node").join(sides, ["level", "node"])
    sums = (
        ranked.groupBy("slice")
        .cogroup(path.groupBy("slice"))
        .applyInPandas(_slice_sums(n1, n_permutations, seed), "b int, s double")
        .groupBy("b")
        .agg(F.sum("s").alias("s"))
    )
    mean = n1 * n2 / 2
    spread = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))) if n > 1 else 0.0
    u = F.col("s") - F.lit(n1 * (n1 + 1) / 2)
    seen = float(observed["statistic"])
    return sums.agg(
        F.avg((u >= seen).cast("double")).alias("p_greater"),
        F.avg((F.abs(u - mean) >= abs(seen - mean)).cast("double")).alias("p_two_sided"),
        F.count(F.lit(1)).alias("n_permutations"),
        F.avg(u).alias("u_mean"),
        F.stddev_pop(u).alias("u_sd"),
    ).select(
        F.lit("permutation").alias("test"),
        F.lit(feature).alias("feature"),
        F.lit(seen).alias("statistic"),
        F.lit(None).cast("double").alias("df1"),
        F.lit(None).cast("double").alias("df2"),
        F.col("p_greater").alias("p_value"),
        F.lit(n).cast("long").alias("n"),
        "p_greater",
        "p_two_sided",
        "n_permutations",
        "u_mean",
        "u_sd",
        F.lit(float(mean)).alias("expected_mean"),
        F.lit(float(spread) ** 0.5).alias("expected_sd"),
    )


def pearson_test(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson r of each feature with the target; p from t with n - 2 degrees of freedom."""
    y = number(df, target)
    cells = []
    for i, c in enumerate(features):
        x = number(df, c)
        cells += [F.corr(x, y).alias(f"r{i}"), F.count(F.when(y.isNotNull(), x)).alias(f"n{i}")]
    row = df.agg(*cells)
    long = row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.nanvl(F.col(f"r{i}"), F.lit(None)).alias("r"),
                        F.col(f"n{i}").cast("double").alias("n"),
                    )
                    for i, c in enumerate(features)
                ]
            )
        )
    )
    r = F.col("r")
    spread = 1 - r * r
    t = F.when(spread <= 0, F.lit(float("inf"))).otherwise(
        r * F.sqrt(F.try_divide(F.col("n") - 2, spread))
    )
    out = long.withColumn("t", t).withColumn("dof", F.col("n") - 2)
    return _result(out, "pearson", r, F.col("dof"), F.lit(None), t_p("t", "dof"), F.col("n"))


# --- scores of one hypothesis: a feature list against a target -------------------


def labelled_rows(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, int]:
    """Complete feature rows with the class as `__label` 0..k-1, and k."""
    from tabulant.core.lookup import attach, sorted_codes

    data = df.select(
        *[number(df, c).alias(c) for c in features], present(df, target).alias("__class")
    ).dropna()
    codes = sorted_codes(data, "__class", "__code")
    classes = codes.count()
    out = attach(data, codes, ["__class"], weight="__n", written=True).select(
        *[quoted(c) for c in features], F.col("__code").cast("int").alias("__label")
    )
    return out, classes


def logistic_accuracy(df: DataFrame, features: Sequence[str], target: str) -> tuple[float, int]:
    """Training accuracy of a logistic model, and the rows it saw."""
    data, classes = labelled_rows(df, features, target)
    data = data.persist()
    m = moments(data, list(features))
    scale = np.sqrt(np.diag(m.cross) / max(m.n, 1))
    out = logistic_accuracies(data, features, "__label", classes, [list(features)], m.means, scale)
    data.unpersist()
    return out[0], m.n


def _kind(df: DataFrame, target: str) -> str:
    return target_type(df, target).first()["kind"]


def _class_count(df: DataFrame, target: str) -> int:
    c = present(df, target)
    values = few_values(df, c, 3)
    return 4 if values is None else len(values)


def linear_fit(df: DataFrame, features: Sequence[str], target: str) -> LeastSquares:
    return least_squares(moments(df, [*features, target]), list(features), target)


def auto_test(
    df: DataFrame, features: Sequence[str], target: str, test_type: str = "auto"
) -> DataFrame:
    """The test that fits the target: t, ANOVA or regression, or a named one.

    Several features with a class target are tested by logistic accuracy; the
    statistic is then the accuracy. A regression row carries the adjusted R-squared.
    """
    features = list(features)
    if test_type == "auto":
        if _kind(df, target) == "categorical":
            test_type = "t_test" if _class_count(df, target) == 2 else "anova"
        else:
            test_type = "regression"
    single = {
        "t_test": t_test,
        "anova": anova,
        "mann_whitney": mann_whitney,
        "kruskal_wallis": kruskal_wallis,
    }
    label = ", ".join(features)
    if test_type == "regression":
        fit = linear_fit(df, features, target)
        f = fit.f
        p = f_tail(f, fit.rank, fit.df2) if f == f else None
        row = ("regression", label, fit.adjusted, float(fit.rank), float(fit.df2), p, fit.n)
        return df.sparkSession.createDataFrame([row], TEST_SCHEMA)
    if test_type not in (*single, "permutation"):
        raise ValueError(f"unknown test: {test_type}")
    if len(features) > 1:
        accuracy, n = logistic_accuracy(df, features, target)
        row = ("logistic", label, accuracy, None, None, None, n)
        return df.sparkSession.createDataFrame([row], TEST_SCHEMA)
    if test_type == "permutation":
        return permutation_test(df, features[0], target).select(
            "test", "feature", "statistic", "df1", "df2", "p_value", "n"
        )
    return single[test_type](df, features, target)


def auto_tests(df: DataFrame, subsets: Sequence[Sequence[str]], target: str) -> DataFrame:
    """The fitting test of every feature list, with its `place` in the list.

    All lists share their passes over the rows: one moment table for a numeric target,
    one test job and batched logistic fits for classes.
    """
    subsets = [list(s) for s in subsets]
    names = sorted({f for s in subsets for f in s})
    rows = []
    if _kind(df, target) != "categorical":
        m = moments(df, [*names, target])
        for i, s in enumerate(subsets):
            fit = least_squares(m, s, target)
            f = fit.f
            p = f_tail(f, fit.rank, fit.df2) if f == f else None
            rows.append(
                (i, "regression", ", ".join(s), fit.adjusted, float(fit.rank), float(fit.df2), p, fit.n)
            )
    else:
        data, classes = labelled_rows(df, names, target)
        data = data.persist()
        single = sorted({s[0] for s in subsets if len(s) == 1})
        found = {}
        if single:
            test = t_test if classes == 2 else anova
            found = {r["feature"]: r for r in test(data, single, "__label").collect()}
        many = [s for s in subsets if len(s) > 1]
        m = moments(data, names)
        scale = np.sqrt(np.diag(m.cross) / max(m.n, 1))
        scores = []
        for start in range(0, len(many), SUBSETS_PER_PASS):
            part = many[start : start + SUBSETS_PER_PASS]
            scores += logistic_accuracies(data, names, "__label", classes, part, m.means, scale)
        data.unpersist()
        accuracy = {tuple(s): a for s, a in zip(many, scores)}
        for i, s in enumerate(subsets):
            if len(s) == 1:
                rows.append((i, *found[s[0]]))
            else:
                rows.append((i, "logistic", ", ".join(s), accuracy[tuple(s)], None, None, None, m.n))
    return df.sparkSession.createDataFrame(rows, f"place int, {TEST_SCHEMA}")


def _score_row(df: DataFrame, name: str, features: Sequence[str], value: float) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(", ".join(features), float(value))], f"features string, {name} double"
    )


def significance(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """1 - p of the fitting test; logistic accuracy for several features with classes."""
    features = list(features)
    if _kind(df, target) == "categorical":
        if len(features) > 1:
            value = logistic_accuracy(df, features, target)[0]
        else:
            p = auto_test(df, features, target).first()["p_value"]
            value = UNDEFINED_SIGNIFICANCE if p is None else 1 - p
    else:
        value = linear_significance(linear_fit(df, features, target))
    return _score_row(df, "significance", features, value)


def linear_significance(fit: LeastSquares) -> float:
    if fit.rank == 0 or fit.df2 <= 0 or not np.isfinite(fit.f):
        return UNDEFINED_SIGNIFICANCE
    if fit.rank == 1:
        return 1 - t_two_sided(float(np.sqrt(fit.f)), fit.df2)
    return 1 - f_tail(fit.f, fit.rank, fit.df2)


def effect_size(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Cohen's d, eta squared, |r| or sqrt(R2); accuracy for several features with classes."""
    features = list(features)
    if _kind(df, target) != "categorical":
        value = np.sqrt(max(linear_fit(df, features, target).r2, 0.0))
    elif len(features) > 1:
        value = logistic_accuracy(df, features, target)[0]
    else:
        value = class_effect(class_moments(df, features, target)).first()["effect_size"]
    return _score_row(df, "effect_size", features, value)


def class_effect(cells: DataFrame) -> DataFrame:
    """Effect size per feature from class moments: d for two classes, eta squared for more."""
    sides = cells.groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct("class", "mean", "var"))).alias("c")
    )
    parts = _between_within(cells)
    c = F.col("c")
    pooled = F.sqrt((c[0]["var"] + c[1]["var"]) / 2)
    d = F.try_divide(F.abs(c[0]["mean"] - c[1]["mean"]), pooled)
    eta = F.try_divide(F.col("between"), F.col("between") + F.col("within"))
    return parts.join(sides, "feature").select(
        "feature",
        F.coalesce(F.when(F.col("k") == 2, d).otherwise(eta), F.lit(0.0)).alias("effect_size"),
    )


def coverage(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """R squared for a continuous target, logistic accuracy for classes."""
    features = list(features)
    if _kind(df, target) == "categorical":
        value = logistic_accuracy(df, features, target)[0]
    else:
        value = linear_fit(df, features, target).r2
    return _score_row(df, "coverage", features, value)


__all__ = [
    "anova",
    "auto_test",
    "auto_tests",
    "class_effect",
    "class_moments",
    "coverage",
    "effect_size",
    "kruskal_wallis",
    "linear_fit",
    "mann_whitney",
    "pearson_test",
    "permutation_test",
    "significance",
    "t_test",
]
