"""Findings in words and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: (lower limit, word), first match wins; the last word is the rest
CONFIDENCE = [(0.95, "very high"), (0.90, "high"), (0.80, "moderate"), (None, "low")]
EFFECT = [(0.5, "strong"), (0.3, "moderate"), (None, "weak")]
COVERAGE = [
    (0.7, "explains most of what's happening"),
    (0.5, "explains a good deal of what's happening"),
    (0.3, "explains some of what's happening"),
    (None, "explains only a little of what's happening"),
]
COVERAGE_SUMMARY = [(0.5, "substantial portions"), (0.3, "some"), (None, "limited portions")]
CAUSAL_EFFECT = [
    (0.3, "a strong causal effect"),
    (0.1, "a moderate causal effect"),
    (0.01, "a small causal effect"),
    (None, "no significant causal effect"),
]
PRACTICAL = [(0.5, "of practical importance"), (0.2, "noticeable"), (None, "of little practical use")]


def band(value: Column, bands, inclusive: bool = False) -> Column:
    """The word of the first band whose limit the value passes."""
    out = None
    for limit, word in bands:
        if limit is None:
            return F.lit(word) if out is None else out.otherwise(word)
        test = value >= limit if inclusive else value > limit
        out = F.when(test, word) if out is None else out.when(test, word)
    return out


def listed(names: Column) -> Column:
    """a, b and c"""
    n = F.size(names)
    head = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, names[0]).otherwise(
        F.concat(head, F.lit(" and "), F.element_at(names, -1))
    )


def label_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Add confidence, effect and coverage words and one sentence per hypothesis."""
    names = F.col("features")
    labelled = hypotheses.select(
        "*",
        band(F.col("significance"), CONFIDENCE, inclusive=True).alias("confidence"),
        band(F.col("effect_size"), EFFECT).alias("effect"),
        band(F.col("coverage"), COVERAGE).alias("coverage_text"),
    )
    n = F.size(names)
    subject = (
        F.when(n == 0, F.lit("No feature was singled out."))
        .when(n == 1, F.format_string("%s has a %s relationship with the target.", names[0], F.col("effect")))
        .otherwise(
            F.format_string(
                "%s together have a %s relationship with the target.", listed(names), F.col("effect")
            )
        )
    )
    rest = F.format_string(" Confidence is %s and it %s.", F.col("confidence"), F.col("coverage_text"))
    return labelled.withColumn("sentence", F.concat(subject, rest))


def label_regressions(terms: DataFrame) -> DataFrame:
    """One sentence per linear fit: its significant predictors and explained share."""
    strong = F.array_sort(
        F.collect_list(F.when((F.col("term") != "intercept") & (F.col("p_value") < 0.05), F.col("term")))
    )
    fit = terms.groupBy("r_squared", "adj_r_squared", "f_p_value", "n").agg(strong.alias("significant"))
    share = F.format_string("%.1f%%", F.col("adj_r_squared") * 100)
    text = F.when(F.size("significant") == 0, F.lit("No predictor is significant.")).otherwise(
        F.concat(F.lit("The significant predictors are "), listed(F.col("significant")), F.lit("."))
    )
    return fit.withColumn(
        "sentence", F.concat(text, F.lit(" The fit explains "), share, F.lit(" of the variance."))
    )


def label_trends(trends: DataFrame, series: str) -> DataFrame:
    """Direction and strength of each series' trend, with a sentence."""
    direction = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    strength = band(F.col("strength"), EFFECT)
    return trends.select(
        "*", direction.alias("direction"), strength.alias("trend_word")
    ).withColumn(
        "sentence",
        F.format_string(
            "%s shows a %s %s trend over time.",
            F.col(series).cast("string"),
            F.col("trend_word"),
            F.col("direction"),
        ),
    )


def label_effects(effects: DataFrame) -> DataFrame:
    """Size, direction and certainty of causal effects, with a sentence."""
    effect = F.abs("effect")
    size = (
        F.when(effect < 0.01, CAUSAL_EFFECT[3][1])
        .when(effect < 0.1, CAUSAL_EFFECT[2][1])
        .when(effect < 0.3, CAUSAL_EFFECT[1][1])
        .otherwise(CAUSAL_EFFECT[0][1])
    )
    labelled = effects.select(
        "*",
        size.alias("size"),
        F.when(F.col("effect") > 0, "increases").otherwise("decreases").alias("direction"),
        F.when(F.col("ci_low").isNull() | F.col("ci_high").isNull(), "unknown")
        .when(F.col("ci_low") * F.col("ci_high") > 0, "confident")
        .otherwise("not sure")
        .alias("certainty"),
        F.when(effect > 0.1, "meaningful").otherwise("limited").alias("practical"),
    )
    adjusted = F.when(
        F.size("confounders") > 0,
        F.concat(F.lit(", accounting for "), F.array_join("confounders", ", ")),
    ).otherwise("")
    return labelled.withColumn(
        "sentence",
        F.format_string(
            "%s has %s on %s%s: each unit %s it by about %.3f.",
            F.col("treatment"),
            F.col("size"),
            F.col("outcome"),
            adjusted,
            F.col("direction"),
            effect,
        ),
    )


def label_tests(tests: DataFrame) -> DataFrame:
    """Words for p-values, R squared and effect sizes of tested hypotheses."""
    p = F.col("p_value")
    verdict = (
        F.when(p < 0.05, "statistically significant")
        .when(p < 0.10, "marginally significant")
        .otherwise("not statistically significant")
    )
    percent = F.floor(F.coalesce(F.col("r_squared"), F.lit(0.0)) * 100).cast("int")
    note = F.when(
        F.col("effect_size") > 0.3,
        " Its effect is also large enough to matter, whatever the number of rows.",
    ).otherwise("")
    labelled = tests.select(
        "*",
        verdict.alias("verdict"),
        band(F.coalesce(F.col("r_squared"), F.lit(0.0)), PRACTICAL).alias("practical"),
    )
    return labelled.withColumn(
        "sentence",
        F.concat(
            F.format_string(
                "The result is %s, explains %d%% and is %s.",
                F.col("verdict"),
                percent,
                F.col("practical"),
            ),
            note,
        ),
    )


def summarize_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """Count, mean scores, their words and the overall verdict, in one row."""
    row = hypotheses.agg(
        F.count(F.lit(1)).alias("hypotheses"),
        F.avg("significance").alias("mean_significance"),
        F.avg("effect_size").alias("mean_effect"),
        F.avg("coverage").alias("mean_coverage"),
    )
    s, e, c = F.col("mean_significance"), F.col("mean_effect"), F.col("mean_coverage")
    verdict = (
        F.when(F.col("hypotheses") == 0, "no significant hypotheses")
        .when((s > 0.9) & (e > 0.4), "solid findings")
        .when(s > 0.8, "promising, check with more data")
        .otherwise("early ideas that need more work")
    )
    return row.select(
        "*",
        band(s, CONFIDENCE).alias("confidence"),
        band(e, EFFECT).alias("effect"),
        band(c, COVERAGE_SUMMARY).alias("coverage_text"),
        verdict.alias("verdict"),
    )


def _ranked(hypotheses: DataFrame) -> DataFrame:
    order = [F.desc("fitness"), F.array_join("features", ",")]
    top = hypotheses.orderBy(*order).limit(10)
    place = Window.partitionBy(F.lit(0)).orderBy(*order)
    return top.withColumn("rank", F.row_number().over(place))


def report_tables(hypotheses: DataFrame, tests: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report.

    top: best 10 hypotheses; detail: best 3 in words; tests: first 5 test rows by p;
    weights: summed significance of features over the best 5 hypotheses, first 8.
    """
    top = _ranked(hypotheses)
    weights = (
        top.where(F.col("rank") <= 5)
        .select(F.explode("features").alias("feature"), "significance")
        .groupBy("feature")
        .agg(F.sum("significance").alias("weight"), F.count(F.lit(1)).alias("hypotheses"))
        .orderBy(F.desc("weight"), "feature")
        .limit(8)
    )
    out = {
        "top": top,
        "detail": label_hypotheses(top.where(F.col("rank") <= 3)).select("rank", "sentence"),
        "weights": weights,
    }
    if tests is not None:
        out["tests"] = tests.orderBy(F.asc_nulls_last("p_value"), "feature").limit(5)
    return out
