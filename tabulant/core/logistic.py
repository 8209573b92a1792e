"""Logistic models of many feature subsets fitted together.

One pass over the rows gives the gradient and curvature of every subset at once, so
a round of a subset search costs a handful of passes, not one model job per subset,
and needs no row sample.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Subsets that callers with many of them fit together.
SUBSETS_PER_PASS = 200


def _design(pdf: pd.DataFrame, features, centre, scale) -> np.ndarray:
    x = (pdf[features].to_numpy(dtype="float64") - centre) / scale
    return np.column_stack([np.ones(len(x)), x])


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Class probabilities; class 0 is the reference class."""
    score = np.column_stack([np.zeros(len(x)), x @ w.T])
    score -= score.max(axis=1, keepdims=True)
    e = np.exp(score)
    return e / e.sum(axis=1, keepdims=True)


def _newton_sums(features, label, centre, scale, subsets, weights, classes, last):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [0.0] * len(subsets)
        seen = False
        for pdf in batches:
            if not len(pdf):
                continue
            seen = True
            full = _design(pdf, features, centre, scale)
            y = pdf[label].to_numpy(dtype="int64")
            hot = np.eye(classes)[y]
            for s, columns in enumerate(subsets):
                x = full[:, [0, *[c + 1 for c in columns]]]
                p = _probabilities(x, weights[s])
                if last:
                    sums[s] = sums[s] + np.array([float((p.argmax(axis=1) == y).sum()), len(y)])
                    continue
                grad = ((hot - p)[:, 1:].T @ x).ravel()
                d = x.shape[1]
                hess = np.zeros(((classes - 1) * d, (classes - 1) * d))
                for a in range(1, classes):
                    for b in range(a, classes):
                        v = p[:, a] * ((1.0 if a == b else 0.0) - p[:, b])
                        block = (x * v[:, None]).T @ x
                        hess[(a - 1) * d : a * d, (b - 1) * d : b * d] = block
                        hess[(b - 1) * d : b * d, (a - 1) * d : a * d] = block
                sums[s] = sums[s] + np.concatenate([grad, hess.ravel()])
        if seen:
            for s, v in enumerate(sums):
                yield pd.DataFrame({"s": s, "k": np.arange(len(v)), "v": v})

    return run


def logistic_accuracies(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: int,
    subsets: Sequence[Sequence[str]],
    centre: np.ndarray,
    scale: np.ndarray,
    ridge: float = 1.0,
    passes: int = 50,
) -> list[float]:
    """Share of rows the fitted model of each subset classifies rightly.

    `label` holds 0..classes-1 and the features are complete doubles. Newton steps go on
    until no weight moves by 1e-4; a fit that is not there after `passes` is warned about.
    """
    features = list(features)
    columns = [[features.index(c) for c in s] for s in subsets]
    weights = [np.zeros((classes - 1, len(c) + 1)) for c in columns]
    centre = np.asarray(centre, dtype=float)
    scale = np.where(np.asarray(scale) > 0, scale, 1.0).astype(float)
    data = df.select(*features, label)
    step = 1.0
    for turn in range(passes + 1):
        last = turn == passes or step < 1e-4
        run = _newton_sums(features, label, centre, scale, columns, weights, classes, last)
        rows = (
            data.mapInPandas(run, "s int, k int, v double")
            .groupBy("s", "k")
            .agg(F.sum("v").alias("v"))
            .collect()
        )
        sums: dict[int, dict[int, float]] = {}
        for r in rows:
            sums.setdefault(r["s"], {})[r["k"]] = r["v"]
        if last:
            if step >= 1e-4:
                warnings.warn(f"logistic fits moved by {step:.2g} in pass {passes}: not converged")
            return [sums[s][0] / sums[s][1] if s in sums else 0.0 for s in range(len(columns))]
        step = 0.0
        for s, w in enumerate(weights):
            v = np.array([sums[s][k] for k in range(len(sums[s]))])
            d = w.size
            penalty = np.tile([0.0] + [ridge] * (w.shape[1] - 1), classes - 1)
            grad = v[:d] - penalty * w.ravel()
            hess = v[d:].reshape(d, d) + np.diag(penalty) + 1e-9 * np.eye(d)
            move = np.linalg.solve(hess, grad).reshape(w.shape)
            move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
            weights[s] = w + move
            step = max(step, float(np.abs(move).max()))
    return []
