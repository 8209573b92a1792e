"""Rows that no other row dominates, by a tree of cells in objective space.

Objective vectors are cut at quantiles, two objectives at a time, until a cell holds few of
them. Boxes around the vectors of a cell say whether one cell dominates another as a whole
(it is dropped), cannot (the pair is), or may; such pairs go down the tree. At its end a cell
sends another only those vectors of its own front that may dominate something there. No
vectors come to the driver, none are broadcast, and no table of pairs of rows is formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import quoted
from tabulant.core.lineage import cut_lineage
from tabulant.core.lookup import attach

#: Vectors of a cell that is not split any more.
CELL_POINTS = 2_048
ROOT = "r"


def settled(points: np.ndarray) -> np.ndarray:
    """The front of distinct points, largest first in lexicographic order."""
    points = points[np.lexsort(points.T[::-1])][::-1]
    kept = np.empty_like(points)
    n = 0
    for p in points:
        if not (kept[:n] >= p).all(axis=1).any():
            kept[n] = p
            n += 1
    return kept[:n]


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points another of `by` dominates."""
    out = np.zeros(len(points), bool)
    step = max(1, (1 << 22) // max(1, len(by)))
    for i in range(0, len(points), step):
        part = points[i : i + step]
        ge = np.ones((len(part), len(by)), bool)
        gt = np.zeros_like(ge)
        for j in range(points.shape[1]):
            ge &= by[None, :, j] >= part[:, None, j]
            gt |= by[None, :, j] > part[:, None, j]
        out[i : i + step] = (ge & gt).any(axis=1)
    return out


def _boxes(state: DataFrame, width: int) -> DataFrame:
    lo = F.array(*[F.min(F.col("x")[i]) for i in range(width)])
    hi = F.array(*[F.max(F.col("x")[i]) for i in range(width)])
    cuts = F.array(*[F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000) for i in range(width)])
    return state.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), lo.alias("lo"), hi.alias("hi"), cuts.alias("cuts"))


def _slice(axis: int):
    """Slices end at the quartiles and before the largest value, so different values are cut."""
    edges = F.array_append(F.col("cuts")[axis], F.col("hi")[axis])
    return F.size(F.filter(edges, lambda e: F.col("x")[axis] >= e))


def _tree(points: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Points with their last cell, and all cells (cell, parent, n, lo, hi)."""
    state = points.withColumn("cell", F.lit(ROOT))
    state, cells, turn = cut_lineage(state), None, 0
    while True:
        now = cut_lineage(_boxes(state, width))
        made = now.select("cell", F.regexp_replace("cell", "/[^/]*$", "").alias("parent"), "n", "lo", "hi")
        # a cell that is not split comes again; one place is enough
        cells = made if cells is None else cells.unionByName(made)
        big = now.where((F.col("n") > CELL_POINTS) & (F.col("lo") != F.col("hi")))
        if big.isEmpty():
            return state, cut_lineage(cells.dropDuplicates(["cell"]))
        axes = sorted({(2 * turn + i) % width for i in range(min(2, width))})
        slices = [_slice(i) for i in axes]
        turn += 1
        known = attach(state, big.select("cell", "cuts", "hi", F.col("n").alias("weight")), ["cell"], weight="weight")
        deeper = F.concat("cell", F.lit("/"), F.concat_ws("_", *[s.cast("string") for s in slices]))
        state = cut_lineage(known.withColumn("cell", F.when(F.col("cuts").isNull(), F.col("cell")).otherwise(deeper)).drop("cuts", "hi"))


def _open_pairs(cells: DataFrame) -> DataFrame:
    """(a, b): last cells where a may dominate part of b, with (a, a) unless a falls as a whole."""
    kids = cut_lineage(cells.where("cell != parent").groupBy("parent").agg(F.collect_list("cell").alias("kids")))

    def side(s: str) -> DataFrame:
        return cells.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "lo", "hi")])

    def below(s: str) -> DataFrame:
        return kids.select(F.col("parent").alias(f"cell_{s}"), F.col("kids").alias(f"kids_{s}"))

    def settle(pairs: DataFrame) -> DataFrame:
        reaches = F.forall(F.zip_with("hi_a", "lo_b", lambda p, q: p >= q), lambda v: v)
        above = F.forall(F.zip_with("lo_a", "hi_b", lambda p, q: p >= q), lambda v: v)
        strictly = F.exists(F.zip_with("lo_a", "hi_b", lambda p, q: p > q), lambda v: v)
        return (
            pairs.join(side("a"), "cell_a")
            .join(side("b"), "cell_b")
            .where(reaches)
            .select("cell_a", "cell_b", (above & strictly).alias("all"))
        )

    pairs = cells.where(F.col("cell") == ROOT).select(F.col("cell").alias("cell_a"), F.col("cell").alias("cell_b"))
    found = fallen = None
    while True:
        pairs = cut_lineage(settle(pairs))
        gone = cut_lineage(pairs.where("all").select(F.col("cell_b").alias("cell")).distinct())
        fallen = gone if fallen is None else fallen.unionByName(gone)
        rest = pairs.where("not all").select("cell_a", "cell_b")
        # what a fallen cell dominates is also dominated by what made it fall
        for s in "ab":
            rest = rest.join(gone.withColumnRenamed("cell", f"cell_{s}"), f"cell_{s}", "left_anti")
        rest = cut_lineage(rest.join(below("a"), "cell_a", "left").join(below("b"), "cell_b", "left"))
        done = rest.where("kids_a is null and kids_b is null").select("cell_a", "cell_b")
        found = done if found is None else found.unionByName(done)
        lower = rest.where("kids_a is not null or kids_b is not null")
        if lower.isEmpty():
            # pairs of last cells may have been set aside before one of the two fell
            for s in "ab":
                found = found.join(fallen.withColumnRenamed("cell", f"cell_{s}"), f"cell_{s}", "left_anti")
            return cut_lineage(found.select("cell_a", "cell_b"))
        pairs = lower.select(
            F.explode(F.coalesce("kids_a", F.array("cell_a"))).alias("cell_a"), "cell_b", "kids_b"
        ).select("cell_a", F.explode(F.coalesce("kids_b", F.array("cell_b"))).alias("cell_b"))


def _own_front(width: int):
    def run(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        blob = settled(x).tobytes() if table.num_rows else b""
        cell = table.column("cell")[:1]
        return pa.table({"cell": cell, "blob": pa.array([blob] * len(cell), pa.binary())})

    return run


def _lend(width: int):
    """Of each cell's front, what may dominate something in another cell's box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, points = None, np.zeros((0, width))
        for batch in batches:
            to, blobs = [], []
            for cell, other, blob, low in zip(*(batch.column(c).to_pylist() for c in ("cell", "other", "blob", "lo"))):
                if other is None:
                    own, points = cell, np.frombuffer(blob).reshape(-1, width)
                elif own == cell:
                    some = points[(points >= np.array(low)).all(axis=1)]
                    if len(some):
                        to.append(other)
                        blobs.append(some.tobytes())
            yield pa.record_batch({"cell": pa.array(to, pa.string()), "blob": pa.array(blobs, pa.binary())})

    return run


def _survive(width: int):
    """Points of each cell that none of the points sent to it dominates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, alive = None, np.zeros((0, width))
        for batch in batches:
            out = []
            for cell, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("cell", "kind", "blob"))):
                points = np.frombuffer(blob).reshape(-1, width)
                if kind == 0:
                    out.append(alive)
                    own, alive = cell, points
                elif own == cell and len(alive):
                    alive = alive[~_beaten(alive, points)]
            yield rows(out)
        yield rows([alive])

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate([np.zeros((0, width)), *parts])
        ends = pa.array(np.arange(0, x.size + 1, width), pa.int32())
        return pa.record_batch({"x": pa.ListArray.from_arrays(ends, pa.array(x.ravel()))})

    return run


def front_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """The front of distinct vectors `x` (all maximised)."""
    points, cells = _tree(vectors, width)
    blobs = points.groupBy("cell").applyInArrow(_own_front(width), "cell string, blob binary")
    pairs = _open_pairs(cells)
    alive = pairs.where("cell_a = cell_b").select(F.col("cell_a").alias("cell"))
    blobs = cut_lineage(blobs.join(alive, "cell", "left_semi"))
    # the box of b goes to a, the vectors of a to b; blobs come first, so a task keeps one cell at a time
    low = cells.select(F.col("cell").alias("cell_b"), "lo")
    asks = (
        pairs.where("cell_a != cell_b")
        .join(low, "cell_b")
        .select(F.col("cell_a").alias("cell"), F.col("cell_b").alias("other"), "lo")
    )
    asked = blobs.withColumn("other", F.lit(None).cast("string")).unionByName(asks, allowMissingColumns=True)
    asked = asked.repartition("cell").sortWithinPartitions("cell", F.asc_nulls_first("other"))
    lent = asked.mapInArrow(_lend(width), "cell string, blob binary").withColumn("kind", F.lit(1))
    met = blobs.withColumn("kind", F.lit(0)).unionByName(lent)
    met = met.repartition("cell").sortWithinPartitions("cell", "kind")
    return met.mapInArrow(_survive(width), "x array<double>")


def pareto_front(
    df: DataFrame,
    maximise: Sequence[str] = ("significance", "effect_size", "coverage"),
    minimise: Sequence[str] = ("parsimony",),
) -> DataFrame:
    """Rows that no other row dominates. Null and NaN objectives are the worst; equal rows stay together."""
    signs = [*[(c, 1.0) for c in maximise], *[(c, -1.0) for c in minimise]]
    number = lambda c: F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double"))
    objectives = [F.coalesce(number(c) * s + F.lit(0.0), F.lit(float("-inf"))) for c, s in signs]
    marked = df.withColumn("__x", F.array(*objectives))
    vectors = cut_lineage(marked.groupBy(F.col("__x").alias("x")).agg(F.count(F.lit(1)).alias("__w")))
    front = front_vectors(vectors.select("x"), len(signs)).join(vectors, "x")
    front = front.select(F.col("x").alias("__x"), F.lit(True).alias("__front"), "__w")
    return attach(marked, front, ["__x"], weight="__w").where("__front").drop("__x", "__front")
