"""The whole analysis of one table, every stage a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.core.columns import number, numeric_columns, require
from tabulant.core.lineage import cut_lineage
from tabulant.operators import clean, features, interpret, profile, search, select, stats
from tabulant.operators.causal import causal_effect
from tabulant.operators.models import automl


def analyze(
    df: DataFrame,
    target: str | None = None,
    missing: str = "mean",
    missing_threshold: float = 0.5,
    outliers: str | None = "iqr",
    outlier_threshold: float = 1.5,
    encoding: str = "auto",
    numeric_transforms: Sequence[str] | None = None,
    max_interactions: int = 5,
    selection: str | None = None,
    selection_k: int | None = None,
    drop_identifiers: bool = True,
    models: bool = False,
    search_options: Mapping | None = None,
    automl_options: Mapping | None = None,
    row_key: str | None = None,
) -> dict[str, DataFrame]:
    """Validate, clean, engineer, select, search, test, estimate and report.

    The target defaults to the last column. Rows stay on the executors; the engineered
    table is written once, and the search and the tests read it back.
    """
    target = target or df.columns[-1]
    require(df, [target])
    # written first: each of many passes would do the caller's joins and broadcasts again
    df = cut_lineage(df)
    out = {"validation": profile.validate_data(df)}
    labels = isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType))
    work = clean.encode_target(df, target)
    work = work.where(number(work, target).isNotNull())
    out["profile"] = profile.profile_numeric(work, numeric_columns(work))
    identifiers = profile.identify_identifiers(work)
    out["identifiers"] = identifiers

    held = [target, *([row_key] if row_key else [])]
    filled = clean.handle_missing(work, missing, missing_threshold)
    missing_held = [c for c in held if c not in filled.columns]
    if missing_held:
        raise ValueError(f"columns lost to missing values: {missing_held}")
    measured = [c for c in numeric_columns(filled) if c not in held]
    if outliers and measured:
        mark = {"iqr": clean.outliers_iqr, "zscore": clean.outliers_zscore}[outliers]
        filled = clean.remove_outliers(mark(filled, measured, outlier_threshold))
    typed = clean.normalize_types(filled)

    if drop_identifiers:
        keys = [
            r["column"]
            for r in identifiers.where("name_match").collect()
            if r["column"] in typed.columns and r["column"] not in held
        ]
        typed = typed.drop(*keys)
    engineered = features.prepare_features(
        typed,
        target=target,
        encoding_method=encoding,
        numeric_transforms=numeric_transforms,
        max_interactions=max_interactions,
        row_key=row_key,
    )
    names = [c for c in numeric_columns(engineered) if c not in held]
    engineered = cut_lineage(engineered.select(*[F.col(f"`{c}`") for c in [*held, *names]]))
    if selection:
        chosen = select.select_features(engineered, target, selection, names, k=selection_k)
        out["selection"] = chosen
        names = [r["feature"] for r in chosen.where("selected").collect()]

    found = search.search_hypotheses(engineered, target, names, **dict(search_options or {}))
    found = df.sparkSession.createDataFrame(found.collect(), search.SCORE_SCHEMA)
    out["hypotheses"] = interpret.label_hypotheses(found)
    ranked = found.orderBy(F.desc("fitness"), "subset_id").collect()
    places = df.sparkSession.createDataFrame(
        [(i, r["subset_id"]) for i, r in enumerate(ranked)], "place int, subset_id long"
    )
    tests = stats.auto_tests(engineered, [r["features"] for r in ranked], target)
    out["tests"] = tests.join(F.broadcast(places), "place").drop("place")
    tested = out["tests"].collect()
    best_id = min(
        tested, key=lambda r: (2.0 if r["p_value"] is None else r["p_value"], r["subset_id"])
    )["subset_id"]
    best = next(r["features"] for r in ranked if r["subset_id"] == best_id)
    effects = causal_effect(engineered, best[0], target, best[1:])
    out["effects"] = interpret.label_effects(effects)
    if models:
        result = automl(
            engineered, target, features=list(best), row_key=row_key, **dict(automl_options or {})
        )
        out["leaderboard"] = result.leaderboard
    out["summary"] = interpret.summarize_hypotheses(found)
    for name, table in interpret.report_tables(found, out["tests"]).items():
        out[f"report_{name}"] = table
    # the result tables are small: computed once, they no longer depend on the rows
    small = {}
    for name, table in out.items():
        small[name] = df.sparkSession.createDataFrame(table.collect(), table.schema)
    small["target"] = df.sparkSession.createDataFrame(
        [(target, labels)], "target string, was_text boolean"
    )
    return small
