"""Sums of products of many columns in one pass over the rows.

Everything linear (least squares, correlations, subset scores, ridge, principal
components) is computed from the p x p table this gives, never from the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import number, quoted, rows_of

# above this many columns one generated aggregate gets too big to compile well
NARROW = 8


@dataclass
class Moments:
    """Row count, means and centred cross products of the named columns."""

    names: list[str]
    n: int
    means: np.ndarray
    cross: np.ndarray

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]


def complete_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns as doubles, rows with a missing value left out."""
    out = df.select(*[F.col(quoted(k)) for k in keep], *[number(df, c).alias(c) for c in columns])
    return out.dropna(subset=list(columns))


def _partial_products(columns: list[str], centre: list[float], by: str | None):
    """Per-task partial sums of centred products, as (group, i, j, s) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by) if by else [(0, pdf)]
            for g, part in groups:
                x = part[columns].to_numpy(dtype="float64") - np.array(centre)
                x = np.column_stack([np.ones(len(x)), x])
                prod = x.T @ x
                sums[g] = sums[g] + prod if g in sums else prod
        for g, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"g": int(g), "i": i, "j": j, "s": s[i, j]})

    return run


def moments_by(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict[int, Moments]:
    """Moments of complete rows, for the whole table (key 0) or per integer group.

    Few columns are one codegen aggregate. Many go through Arrow batches that add up
    X'X per task; centring on a first mean keeps the sums well conditioned.
    """
    columns = list(columns)
    data = complete_rows(df, columns, [by] if by else [])
    p = len(columns)
    if p <= NARROW:
        cells = [F.count(F.lit(1)).alias("n")]
        cells += [F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)]
        cells += [
            F.covar_pop(quoted(columns[i]), quoted(columns[j])).alias(f"c{i}_{j}")
            for i in range(p)
            for j in range(i, p)
        ]
        rows = (data.groupBy(quoted(by)) if by else data.groupBy()).agg(*cells).collect()
        out = {}
        for r in rows:
            cross = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    cross[i, j] = cross[j, i] = (r[f"c{i}_{j}"] or 0.0) * r["n"]
            means = np.array([r[f"m{i}"] if r["n"] else np.nan for i in range(p)], dtype=float)
            out[int(r[by]) if by else 0] = Moments(columns, r["n"], means, cross)
        return out
    first = data.agg(*[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = [float(v or 0.0) for v in first]
    sums = (
        data.mapInPandas(_partial_products(columns, centre, by), "g long, i int, j int, s double")
        .groupBy("g", "i", "j")
        .agg(F.sum("s").alias("s"))
        .collect()
    )
    raw: dict[int, np.ndarray] = {}
    for r in sums:
        m = raw.setdefault(r["g"], np.zeros((p + 1, p + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    out = {}
    for g, m in raw.items():
        n, shift = int(m[0, 0]), m[0, 1:] / m[0, 0]
        out[g] = Moments(
            columns, n, np.array(centre) + shift, m[1:, 1:] - n * np.outer(shift, shift)
        )
    return out


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    found = moments_by(df, columns)
    if 0 in found:
        return found[0]
    p = len(columns)
    return Moments(list(columns), 0, np.full(p, np.nan), np.zeros((p, p)))


def merged(parts: Sequence[Moments]) -> Moments:
    """Moments of the union of disjoint row sets."""
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.means for m in parts) / n
    cross = sum(m.cross + m.n * np.outer(m.means - mean, m.means - mean) for m in parts)
    return Moments(parts[0].names, n, mean, cross)


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raw sums of products in long form (i, j, s); the name '1' stands for the constant."""
    columns = list(columns)
    data = complete_rows(df, columns)
    if len(columns) > NARROW:
        names = F.array(*[F.lit(c) for c in ["1", *columns]])
        return (
            data.mapInPandas(
                _partial_products(columns, [0.0] * len(columns), None),
                "g long, i int, j int, s double",
            )
            .groupBy("i", "j")
            .agg(F.sum("s").alias("s"))
            .select(
                F.element_at(names, F.col("i") + 1).alias("i"),
                F.element_at(names, F.col("j") + 1).alias("j"),
                "s",
            )
        )
    terms = [("1", F.lit(1.0)), *[(c, F.col(quoted(c))) for c in columns]]
    pairs = [(a, b) for k, a in enumerate(terms) for b in terms[k:]]
    row = data.agg(
        *[F.coalesce(F.sum(a[1] * b[1]), F.lit(0.0)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]
    )
    return row.select(
        rows_of(
            [
                F.struct(
                    F.lit(a[0]).alias("i"), F.lit(b[0]).alias("j"), F.col(f"s{k}").alias("s")
                )
                for k, (a, b) in enumerate(pairs)
            ]
        )
    )


@dataclass
class LeastSquares:
    """A linear fit read off the moments."""

    names: list[str]
    coef: np.ndarray
    intercept: float
    std_err: np.ndarray
    intercept_err: float
    r2: float
    rank: int
    n: int
    sse: float

    @property
    def df2(self) -> int:
        return self.n - self.rank - 1

    @property
    def f(self) -> float:
        if self.rank == 0 or self.df2 <= 0:
            return float("nan")
        if self.r2 >= 1:
            return float("inf")
        return float(self.r2 / self.rank / ((1 - self.r2) / self.df2))

    @property
    def adjusted(self) -> float:
        if self.df2 <= 0:
            return float("nan")
        return float(1 - (1 - self.r2) * (self.n - 1) / self.df2)


def least_squares(m: Moments, features: Sequence[str], target: str) -> LeastSquares:
    """Ordinary least squares; a singular system is solved by pseudo-inverse of its rank."""
    at, t = m.at(features), m.names.index(target)
    sxx, sxy, syy = m.cross[np.ix_(at, at)], m.cross[at, t], m.cross[t, t]
    scale = np.sqrt(np.diag(sxx))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(sxx / np.outer(scale, scale)) if at else (np.zeros(0), None)
    good = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    rank = int(good.sum())
    if at:
        inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T / np.outer(scale, scale)
    else:
        inverse = np.zeros((0, 0))
    coef = inverse @ sxy
    sse = max(float(syy - coef @ sxy), 0.0)
    r2 = float(1 - sse / syy) if syy > 0 else float("nan")
    df2 = m.n - rank - 1
    s2 = sse / df2 if df2 > 0 else float("nan")
    means = m.means[at]
    return LeastSquares(
        list(features),
        coef,
        float(m.means[t] - coef @ means),
        np.sqrt(s2 * np.diag(inverse)) if at else np.zeros(0),
        float(np.sqrt(s2 * (1 / m.n + means @ inverse @ means))) if m.n else float("nan"),
        r2,
        rank,
        m.n,
        sse,
    )
