"""Total order without a single-task sort.

A global or per-series order is cut into value slices whose edges come from one
mergeable quantile sketch. Rows are ordered inside a slice, and the slice sizes
(a small table) turn the local numbers into global ones. A key that holds a third
of all rows is therefore still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.core.columns import quoted

ROWS_PER_BLOCK = 100_000
ROWS_PER_SLICE = 1_000_000


def slice_count(df: DataFrame) -> int:
    """Slices to cut an order into: one per shuffle task, more where those would be long."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(2, int(conf), df.count() // ROWS_PER_SLICE)


def order_number(df: DataFrame, name: str) -> Column:
    """A numeric, timestamp or date column as a double with the same order."""
    kind = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def quantile_points(df: DataFrame, columns: Sequence[str], parts: int) -> dict[str, list[float]]:
    """Approximate quantiles per column from one pass; a heavy value comes up repeatedly."""
    points = [i / parts for i in range(1, parts)]
    row = df.agg(
        *[
            F.percentile_approx(F.col(quoted(c)), points, max(1000, 10 * parts)).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    return {c: sorted(row[f"q{i}"] or []) for i, c in enumerate(columns)}


def quantile_edges(df: DataFrame, columns: Sequence[str], parts: int) -> dict[str, list[float]]:
    """Inner slice edges per column."""
    return {c: sorted(set(q)) for c, q in quantile_points(df, columns, parts).items()}


def with_slices(
    df: DataFrame, columns: Sequence[str], edges: dict[str, list[float]], outputs: Sequence[str]
) -> DataFrame:
    """Slice number of each double column by binary search in its edges."""
    splits = [[float("-inf"), *edges[c], float("inf")] for c in columns]
    # with fewer than three split points there is nothing to search
    flat = [(c, o) for c, o, s in zip(columns, outputs, splits) if len(s) < 3]
    cut = [(c, o, s) for c, o, s in zip(columns, outputs, splits) if len(s) >= 3]
    out = df
    if cut:
        out = Bucketizer(
            inputCols=[c for c, _, _ in cut],
            outputCols=[o for _, o, _ in cut],
            splitsArray=[s for _, _, s in cut],
            handleInvalid="keep",
        ).transform(out)
    for _, o in flat:
        out = out.withColumn(o, F.lit(0.0))
    return out


def positions(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    name: str = "position",
    parts: int | None = None,
) -> DataFrame:
    """Row number from 0 in the order of one column, overall or within `by`.

    A value that fills a whole slice or more is cut further by a hash of the row, unless
    `ties` asks for an order among equal values. Slices are cut by the value as a double,
    which keeps the order but may merge neighbours above 2^53; inside a slice rows are
    ordered by the value itself.
    """
    keyed = df.withColumn("__key", order_number(df, order))
    parts = parts or slice_count(df)
    points = quantile_points(keyed, ["__key"], parts)["__key"]
    own = F.col(quoted(order))
    heavy = sorted({a for a, b in zip(points, points[1:]) if a == b})
    # a double that may stand for several values is no heavy value
    if isinstance(df.schema[order].dataType, (T.LongType, T.DecimalType)):
        heavy = [h for h in heavy if abs(h) < 2**53]
    sliced = with_slices(keyed, ["__key"], {"__key": sorted(set(points))}, ["__slice"])
    if heavy and not ties:
        # a heavy value is the lower edge of its slice, so it comes first there
        same = F.col("__key").isin(heavy)
        share = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]), F.lit(parts))
        sliced = sliced.withColumn(
            "__slice",
            F.col("__slice") + F.when(same, share / F.lit(2.0 * parts)).otherwise(F.lit(0.5)),
        )
    group = [*by, "__slice"]
    sizes = sliced.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("__slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *group, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")
    )
    local = Window.partitionBy(*group).orderBy(own, *ties)
    return (
        sliced.join(offsets, group)
        .withColumn(name, F.row_number().over(local) - 1 + F.col("__before"))
        .drop("__key", "__slice", "__before")
    )


def series_blocks(
    df: DataFrame,
    position: str,
    before: int = 0,
    after: int = 0,
    rows: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Cut ordered series into blocks that also hold the rows their windows reach.

    Adds `__block`; a row near a block edge is repeated in the neighbour that looks
    at it. `own_rows` drops the repeats after the window functions have run.
    """
    size = max(rows, before + after + 1)
    p = F.col(position)
    first = F.floor(F.greatest(p - after, F.lit(0)) / size)
    last = F.floor((p + before) / size)
    return df.withColumn("__block", F.explode(F.sequence(first, last))).withColumn(
        "__own", F.floor(p / size) == F.col("__block")
    )


def block_window(by: Iterable[str], position: str):
    return Window.partitionBy(*by, "__block").orderBy(position)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__block", "__own")


def value_ranks(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Rank sums with mid-ranks for ties, per feature and class.

    Equal values are counted before anything is ordered, so a value that fills a
    third of the table is one row. Output: feature, class, n, rank_sum, total, ties
    where ties = sum of t^3 - t over the tied groups of the feature.
    """
    from tabulant.core.columns import number

    raw = df.select(
        F.col(quoted(group)).cast("string").alias("class"),
        *[number(df, f).alias(f"v{i}") for i, f in enumerate(features)],
    ).where(F.col("class").isNotNull())
    names = [f"v{i}" for i in range(len(features))]
    slots = [f"s{i}" for i in range(len(features))]
    parts = slice_count(df)
    sliced = with_slices(raw, names, quantile_edges(raw, names, parts), slots)
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"s{i}").alias("slice"),
            # -0.0 and 0.0 are one value
            (F.col(f"v{i}") + F.lit(0.0)).alias("value"),
        )
        for i, f in enumerate(features)
    ]
    counts = (
        sliced.select("class", F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "slice", "value", "class")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    upto = (
        Window.partitionBy("feature", "slice")
        .orderBy("value")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # peers of a value are a frame of the same window, so one sort serves both sums
    same = (
        Window.partitionBy("feature", "slice")
        .orderBy("value")
        .rangeBetween(Window.currentRow, Window.currentRow)
    )
    local = counts.withColumn("t", F.sum("n").over(same)).withColumn(
        "mid", F.sum("n").over(upto) - (F.col("t") - 1) / 2
    )
    parts_table = local.groupBy("feature", "slice", "class").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("mid")).alias("ranks"),
        F.sum(F.col("n") * (F.col("t") * F.col("t") - 1)).alias("ties"),
    )
    by_slice = Window.partitionBy("feature").orderBy("slice")
    before = by_slice.rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    return (
        parts_table.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("n").over(whole))
        .withColumn("all_ties", F.sum("ties").over(whole))
        .groupBy("feature", "class")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("ranks") + F.col("offset") * F.col("n")).alias("rank_sum"),
            F.first("total").alias("total"),
            F.first("all_ties").alias("ties"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    points: Sequence[float],
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of numeric columns, exact at any size.

    Found by selection: count the rows per slice, keep only the slices that hold a wanted
    rank, and order the distinct values there.
    """
    from tabulant.core.columns import number

    raw = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"v{i}" for i in range(len(columns))]
    sizes = raw.agg(*[F.count(v).alias(v) for v in names]).first().asDict() if names else {}
    if not names:
        return {}
    edges = quantile_edges(raw, names, slice_count(df))
    slots = [f"s_{v}" for v in names]
    sliced = with_slices(raw, names, edges, slots)
    cells = [
        F.struct(F.lit(v).alias("name"), F.col(s).alias("slice"), F.col(v).alias("value"))
        for v, s in zip(names, slots)
    ]
    long = sliced.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    per_slice: dict[str, list[tuple[float, int]]] = {v: [] for v in names}
    for r in long.groupBy("name", "slice").count().collect():  # columns x slices rows
        per_slice[r["name"]].append((r["slice"], r["count"]))

    wanted_slices, before, ranks = set(), {}, {}
    for v in names:
        run = 0
        spans = []
        for s, n in sorted(per_slice[v]):
            before[(v, s)] = run
            spans.append((run, run + n, s))
            run += n
        ranks[v] = []
        for p in points:
            h = (run - 1) * p
            lo = int(h)
            hi = min(lo + 1, run - 1)
            ranks[v].append((lo, hi, h - lo))
            wanted_slices.update((v, s) for a, b, s in spans if a <= lo < b or a <= hi < b)
    keep = df.sparkSession.createDataFrame(
        [(v, s, before[(v, s)]) for v, s in wanted_slices], "name string, slice double, off long"
    )
    targets = df.sparkSession.createDataFrame(
        [(v, r) for v in names for lo, hi, _ in ranks[v] for r in {lo, hi}],
        "name string, rank long",
    ).distinct()
    upto = Window.partitionBy("name", "slice").orderBy("value")
    spans_df = (
        long.join(F.broadcast(keep), ["name", "slice"])
        .groupBy("name", "slice", "off", "value")
        .count()
        .withColumn("end", F.col("off") + F.sum("count").over(upto))
        .withColumn("start", F.col("end") - F.col("count"))
    )
    hit = spans_df.join(F.broadcast(targets), "name").where(
        (F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("end"))
    )
    found = {(r["name"], r["rank"]): r["value"] for r in hit.select("name", "rank", "value").collect()}
    out = {}
    for c, v in zip(columns, names):
        if sizes[v] == 0:
            out[c] = [None] * len(points)
            continue
        out[c] = [
            found[(v, lo)] + (found[(v, hi)] - found[(v, lo)]) * frac for lo, hi, frac in ranks[v]
        ]
    return out
