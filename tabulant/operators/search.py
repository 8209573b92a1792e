"""Search for the feature subsets that best explain a target.

The rows are read once into a p x p moment table (numeric target) or a few times per
round into curvature sums of all candidates (class target). Candidates are scored by
Spark tasks that carry only those small tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.core.columns import number, numeric_columns
from tabulant.core.gram import Moments, least_squares, moments, moments_by
from tabulant.core.logistic import SUBSETS_PER_PASS, logistic_accuracies
from tabulant.core.shuffle import row_hash
from tabulant.operators.causal import causal_priorities
from tabulant.operators.front import pareto_front
from tabulant.operators.profile import target_type
from tabulant.operators.select import mutual_information, recursive_elimination, top_scores
from tabulant.operators.stats import (
    anova,
    class_effect,
    class_moments,
    labelled_rows,
    linear_significance,
    t_test,
)

SCORES = ["significance", "effect_size", "coverage", "parsimony"]
SCORE_SCHEMA = (
    "subset_id long, features array<string>, significance double, effect_size double, "
    "coverage double, parsimony double, fitness double"
)
EMPTY = (0.0, 0.0, 0.0, 1.0)


def fitness_of(s: Sequence[float]) -> float:
    return s[0] + s[1] + s[2] - s[3]


def linear_scores(m: Moments, subset: Sequence[str], target: str, total: int) -> tuple:
    """The four scores of one subset, read off the moment table."""
    if not subset:
        return EMPTY
    fit = least_squares(m, list(subset), target)
    r2 = fit.r2 if fit.r2 == fit.r2 else 0.0
    return (
        float(linear_significance(fit)),
        float(np.sqrt(max(r2, 0.0))),
        float(r2),
        len(subset) / total,
    )


class SubsetScorer:
    """Scores candidate subsets against one target; each distinct subset once."""

    def __init__(self, df: DataFrame, target: str, features: Sequence[str] | None = None):
        self.features = list(features or numeric_columns(df, exclude=[target]))
        self.target = target
        self.spark = df.sparkSession
        self.memo: dict[tuple, tuple] = {(): EMPTY}
        self.classes = target_type(df, target).first()["kind"] == "categorical"
        self.data = None
        if self.classes:
            rows, self.class_count = labelled_rows(df, self.features, target)
            self.data = rows.persist()
            m = moments(self.data, self.features)
            self.centre, self.scale = m.means, np.sqrt(np.diag(m.cross) / max(m.n, 1))
            self.single = self._single_scores()
        else:
            self.moments = moments(df, [*self.features, target])

    def _single_scores(self) -> dict[str, tuple[float, float]]:
        test = t_test if self.class_count == 2 else anova
        p = {r["feature"]: r["p_value"] for r in test(self.data, self.features, "__label").collect()}
        effects = class_effect(class_moments(self.data, self.features, "__label")).collect()
        return {
            r["feature"]: (0.5 if p[r["feature"]] is None else 1 - p[r["feature"]], r["effect_size"])
            for r in effects
        }

    def table(self, candidates: DataFrame) -> DataFrame:
        """(subset_id, features) candidates with their scores, for a numeric target."""
        m, target, total = self.moments, self.target, len(self.features)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i, names in zip(pdf["subset_id"], pdf["features"]):
                    names = sorted(names)
                    s = linear_scores(m, names, target, total)
                    rows.append((i, names, *s, fitness_of(s)))
                yield pd.DataFrame(
                    rows, columns=["subset_id", "features", *SCORES, "fitness"]
                )

        return candidates.select("subset_id", "features").mapInPandas(run, SCORE_SCHEMA)

    def __call__(self, subsets: Sequence[tuple]) -> list[tuple]:
        fresh = sorted({s for s in subsets if s not in self.memo})
        if fresh and self.classes:
            for start in range(0, len(fresh), SUBSETS_PER_PASS):
                self._score_classes(fresh[start : start + SUBSETS_PER_PASS])
        elif fresh:
            rows = [(i, list(s)) for i, s in enumerate(fresh)]
            frame = self.spark.createDataFrame(rows, "subset_id long, features array<string>")
            for r in self.table(frame).collect():
                self.memo[tuple(r["features"])] = tuple(r[c] for c in SCORES)
        return [self.memo[s] for s in subsets]

    def _score_classes(self, subsets: list[tuple]) -> None:
        accuracy = logistic_accuracies(
            self.data,
            self.features,
            "__label",
            self.class_count,
            subsets,
            self.centre,
            self.scale,
        )
        for s, a in zip(subsets, accuracy):
            sig, eff = self.single[s[0]] if len(s) == 1 else (a, a)
            self.memo[s] = (float(sig), float(eff), float(a), len(s) / len(self.features))

    def close(self) -> None:
        if self.data is not None:
            self.data.unpersist()


def score_subsets(
    df: DataFrame, candidates: DataFrame, target: str, features: Sequence[str] | None = None
) -> DataFrame:
    """Candidates (subset_id, features) with significance, effect size, coverage,
    parsimony and fitness = s + e + c - p; an empty subset scores (0, 0, 0, 1)."""
    scorer = SubsetScorer(df, target, features)
    if not scorer.classes:
        return scorer.table(candidates)
    sets = candidates.select(F.array_sort("features").alias("features")).distinct()
    walk = sets.toLocalIterator()
    out = None
    while batch := [tuple(r["features"]) for r in islice(walk, SUBSETS_PER_PASS)]:
        rows = [(list(s), *v, fitness_of(v)) for s, v in zip(batch, scorer(batch))]
        part = df.sparkSession.createDataFrame(
            rows,
            "features array<string>, significance double, effect_size double, "
            "coverage double, parsimony double, fitness double",
        )
        out = part if out is None else out.unionByName(part)
    scorer.close()
    keyed = candidates.select("subset_id", F.array_sort("features").alias("features"))
    return keyed.join(out, "features").select("subset_id", "features", *SCORES, "fitness")


def _fronts(points: np.ndarray) -> np.ndarray:
    """Front number of each of a few hundred score vectors, 0 = not dominated."""
    front = np.full(len(points), -1)
    left, level = np.arange(len(points)), 0
    while len(left):
        p = points[left]
        ge = (p[:, None, :] >= p[None, :, :]).all(axis=2)
        gt = (p[:, None, :] > p[None, :, :]).any(axis=2)
        beaten = (ge & gt).any(axis=0)
        front[left[~beaten]] = level
        left, level = left[beaten], level + 1
    return front


def evolve(
    features: Sequence[str],
    score: Callable[[Sequence[tuple]], list[tuple]],
    population: int = 100,
    rounds: int = 50,
    crossover: float = 0.7,
    mutation: float = 0.2,
    flip: float = 0.05,
    patience: int = 5,
    min_gain: float = 1e-6,
    adaptive: bool = False,
    seed: int = 42,
) -> tuple[dict[tuple, tuple], int]:
    """Random subsets improved by recombination, bit flips and non-dominated selection.

    Returns the scores of the last population and the rounds run. `score` rates a list
    of subsets at once.
    """
    rng = np.random.default_rng(seed)
    names = sorted(features)
    p = len(names)

    def subset(bits):
        return tuple(n for n, b in zip(names, bits) if b)

    people = rng.integers(0, 2, size=(population, p))
    rated = np.array(score([subset(b) for b in people]))
    best, flat, gains, turn = -np.inf, 0, [], 0
    for turn in range(1, rounds + 1):
        children = people[rng.permutation(len(people))].copy()
        for i in range(0, len(children) - 1, 2):
            if p > 1 and rng.random() < crossover:
                a, b = sorted(rng.choice(p + 1, size=2, replace=False))
                children[[i, i + 1], a:b] = children[[i + 1, i], a:b]
        touched = rng.random(len(children)) < mutation
        flips = (rng.random(children.shape) < flip) & touched[:, None]
        children = np.where(flips, 1 - children, children)
        child_rated = np.array(score([subset(b) for b in children]))
        pool = np.concatenate([people, children])
        pool_rated = np.concatenate([rated, child_rated])
        _, first = np.unique(pool, axis=0, return_index=True)
        pool, pool_rated = pool[first], pool_rated[first]
        signed = pool_rated * np.array([1, 1, 1, -1])
        total = signed.sum(axis=1)
        order = np.lexsort((-total, _fronts(signed)))[:population]
        people, rated = pool[order], pool_rated[order]
        top = float(total.max())
        gain = top - best
        gains.append(gain)
        best = max(best, top)
        flat = flat + 1 if gain <= min_gain else 0
        if flat >= patience:
            break
        if adaptive:
            if np.var((rated * np.array([1, 1, 1, -1])).sum(axis=1)) < 0.1:
                mutation = min(0.5, mutation + 0.05)
            if max(gains[-3:]) < 0.01:
                crossover = min(0.9, crossover + 0.05)
                mutation = min(0.5, mutation + 0.02)
    return {subset(b): tuple(r) for b, r in zip(people, rated)}, turn


def _score_rows(spark, scored: dict[tuple, tuple]) -> DataFrame:
    rows = [
        (i, list(s), *[float(x) for x in v], float(fitness_of(v)))
        for i, (s, v) in enumerate(sorted(scored.items()))
    ]
    return spark.createDataFrame(rows, SCORE_SCHEMA)


def search_hypotheses(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    prefilter_fraction: float | None = None,
    prefilter_by: str = "mutual_info",
    local: bool = True,
    **options,
) -> DataFrame:
    """The non-dominated feature subsets, with scores and fitness.

    `options` go to `evolve`. With `prefilter_fraction` only the best part of the
    features enters; with `local` the best tenth is refined by single flips.
    """
    features = list(features or numeric_columns(df, exclude=[target]))
    if prefilter_fraction is not None:
        kept = prefilter(df, target, features, prefilter_fraction, prefilter_by)
        features = [r["feature"] for r in kept.where("selected").collect()]
    scorer = SubsetScorer(df, target, features)
    found, _ = evolve(features, scorer, **options)
    found.pop((), None)
    if local and found:
        ranked = sorted(found, key=lambda s: -fitness_of(found[s]))
        elites = ranked[: max(1, len(ranked) // 10)]
        near = {n for s in elites for n in _neighbours(s, features)} - {()}
        for s, v in zip(sorted(near), scorer(sorted(near))):
            found[s] = v
    scorer.close()
    return pareto_front(_score_rows(df.sparkSession, found))


def _neighbours(subset: tuple, features: Sequence[str]) -> list[tuple]:
    chosen = set(subset)
    return [tuple(sorted(chosen ^ {f})) for f in features]


def local_search(
    df: DataFrame,
    scored: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    elite_fraction: float = 0.1,
) -> DataFrame:
    """One-flip neighbours of the best part of scored subsets; improvements are kept."""
    features = list(features or numeric_columns(df, exclude=[target]))
    ranked = top_scores(
        scored.select(F.col("subset_id").alias("feature"), F.col("fitness").alias("score")),
        fraction=elite_fraction,
    )
    elites = scored.join(
        F.broadcast(ranked.where("selected").select(F.col("feature").alias("subset_id"))),
        "subset_id",
        "left_semi",
    )
    all_names = F.array(*[F.lit(f) for f in features])
    moves = elites.select(
        F.col("subset_id").alias("elite"),
        F.col("features").alias("start"),
        F.explode(all_names).alias("item"),
    ).withColumn(
        "features",
        F.array_sort(
            F.when(F.array_contains("start", F.col("item")), F.array_remove("start", F.col("item")))
            .otherwise(F.array_append("start", F.col("item")))
        ),
    )
    flips = moves.withColumn(
        "subset_id", F.col("elite") * len(features) + F.array_position(all_names, F.col("item")) - 1
    )
    rated = score_subsets(df, flips.select("subset_id", "features"), target, features)
    best = (
        rated.withColumn("elite", F.floor(F.col("subset_id") / len(features)))
        .groupBy("elite")
        .agg(F.max_by(F.struct("features", *SCORES, "fitness"), F.struct("fitness", -F.size("features"), F.col("features"))).alias("b"))
    )
    both = elites.join(best, F.col("subset_id") == F.col("elite"))
    better = F.col("b.fitness") > F.col("fitness")
    return both.select(
        "subset_id",
        *[
            F.when(better, F.col(f"b.{c}")).otherwise(F.col(c)).alias(c)
            for c in ["features", *SCORES, "fitness"]
        ],
        better.alias("improved"),
    )


def prefilter(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    fraction: float = 0.5,
    by: str = "mutual_info",
) -> DataFrame:
    """The top fraction of the features by mutual information or causal score."""
    features = list(features or numeric_columns(df, exclude=[target]))
    if by == "mutual_info":
        scores = mutual_information(df, target, features)
    elif by == "causal":
        scores = causal_priorities(df, features, target).withColumnRenamed("causal_score", "score")
    else:
        raise ValueError(f"unknown score: {by}")
    return top_scores(scores, fraction=fraction)


def stability_selection(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    samples: int = 10,
    share: int = 80,
    row_key: str | None = None,
    population: int = 30,
    rounds: int = 15,
    seed: int = 42,
) -> DataFrame:
    """Share of search runs on row samples in which a feature is part of the front.

    Sample b holds the rows whose hash with b falls under `share` percent. All sample
    moment tables come from one pass; each search then runs as its own task.
    """
    features = list(features or numeric_columns(df, exclude=[target]))
    cols = [*features, target]
    hashed = df.withColumn("__h", row_hash(df, row_key, seed))
    picks = F.filter(
        F.sequence(F.lit(0), F.lit(samples - 1)),
        lambda b: F.pmod(F.xxhash64(F.col("__h"), b), F.lit(100)) < share,
    )
    data = hashed.select(*[number(df, c).alias(c) for c in cols], F.explode(picks).alias("__b"))
    tables = moments_by(data, cols, "__b")
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [(b, m.n, m.means.tolist(), m.cross.ravel().tolist()) for b, m in tables.items()],
        "b int, n long, means array<double>, cross array<double>",
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        p = len(cols)
        m = Moments(cols, int(r["n"]), np.array(r["means"]), np.array(r["cross"]).reshape(p, p))
        memo: dict[tuple, tuple] = {}

        def score(subsets):
            for s in subsets:
                if s not in memo:
                    memo[s] = linear_scores(m, s, target, len(features))
            return [memo[s] for s in subsets]

        found, _ = evolve(
            features, score, population=population, rounds=rounds, seed=seed + int(key[0])
        )
        found.pop((), None)
        subsets = sorted(found)
        signed = np.array([found[s] for s in subsets]) * np.array([1, 1, 1, -1])
        front = [s for s, k in zip(subsets, _fronts(signed)) if k == 0]
        return pd.DataFrame(
            [(int(key[0]), f) for s in front for f in s], columns=["b", "feature"]
        )

    hits = frame.groupBy("b").applyInPandas(run, "b int, feature string").distinct()
    counts = hits.groupBy("feature").agg(F.count(F.lit(1)).alias("runs"))
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    return names.join(counts, "feature", "left").select(
        "feature",
        F.coalesce("runs", F.lit(0)).alias("runs"),
        (F.coalesce("runs", F.lit(0)) / F.lit(len(tables))).alias("stability"),
    )


def ensemble_vote(lists: DataFrame, votes: int = 2) -> DataFrame:
    """Combine selectors (selector, fitness, features): keep features with enough votes.

    When no feature has enough, each is weighted by the fitness of its selectors and
    the better half stays.
    """
    named = (
        lists.select("selector", "fitness", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count_distinct("selector").alias("votes"), F.sum("fitness").alias("weight"))
    )
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.desc("weight"), "feature")
    half = F.greatest(F.floor(F.count(F.lit(1)).over(whole) / 2), F.lit(1))
    return named.select(
        "feature",
        "votes",
        "weight",
        F.when(F.max("votes").over(whole) >= votes, F.col("votes") >= votes)
        .otherwise(F.row_number().over(order) <= half)
        .alias("selected"),
    )


def ensemble_selection(
    df: DataFrame, target: str, features: Sequence[str] | None = None, **options
) -> DataFrame:
    """Vote of the subset search, recursive elimination and mutual information."""
    features = list(features or numeric_columns(df, exclude=[target]))
    best = search_hypotheses(df, target, features, **options).orderBy(
        F.desc("fitness"), "subset_id"
    ).first()
    rfe = recursive_elimination(df, target, features)
    mi = top_scores(mutual_information(df, target, features), k=max(1, len(features) // 2))
    lists = {
        "search": list(best["features"]),
        "elimination": [r["feature"] for r in rfe.where("selected").collect()],
        "mutual_info": [r["feature"] for r in mi.where("selected").collect()],
    }
    scorer = SubsetScorer(df, target, features)
    scores = scorer([tuple(sorted(v)) for v in lists.values()])
    scorer.close()
    table = df.sparkSession.createDataFrame(
        [(k, fitness_of(s), v) for (k, v), s in zip(lists.items(), scores)],
        "selector string, fitness double, features array<string>",
    )
    return ensemble_vote(table)
