"""Equi-join with a table of per-value statistics, safe for hot keys and big tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import quoted
from tabulant.core.lineage import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 2_000
SALTS = 64


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    written: bool = False,
) -> DataFrame:
    """Left join `table` (one row per key) to every row of `df`.

    The table is written once, counted and measured; it is broadcast only when rows and
    bytes are few. Otherwise one shuffle join takes all rows: hashes of the heaviest keys
    (by `weight`, the rows they match; at most HOT_KEYS numbers) are broadcast, rows that
    carry them are dealt over SALTS parts, and the table has those keys once per part. So
    `df` is read once. `weight` is not part of the result. `written` says that the table is
    cheap to read twice already.
    """
    keys = list(keys)
    table = table if written else cut_lineage(table)
    out = table.drop(weight) if weight else table
    rows, size = out.agg(
        F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(quoted(c)) for c in out.columns]))))
    ).first()
    if rows <= broadcast_rows and (size or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(out), keys, "left")
    if weight is None:
        return df.join(out, keys, "left")
    name = F.xxhash64(*[F.col(quoted(k)) for k in keys])
    heavy = (
        table.orderBy(F.desc(weight)).limit(HOT_KEYS).select(name.alias("__hash"), F.lit(True).alias("__hot"))
    ).distinct()
    hot = F.coalesce("__hot", F.lit(False))
    dealt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    left = (
        df.withColumn("__hash", name)
        .join(F.broadcast(heavy), "__hash", "left")
        .withColumn("__salt", F.when(hot, dealt).otherwise(F.lit(0)))
        .drop("__hash", "__hot")
    )
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = (
        out.withColumn("__hash", name)
        .join(F.broadcast(heavy), "__hash", "left")
        .withColumn("__salt", F.explode(salts))
        .drop("__hash", "__hot")
    )
    return left.join(right, [*keys, "__salt"], "left").drop("__salt")


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per non-null value; partial counts are merged before the shuffle."""
    c = F.col(quoted(column))
    return df.where(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(name))


def sorted_codes(
    df: DataFrame, column: str, name: str = "code", small_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Distinct non-null values numbered from 0 in ascending order.

    Few values are numbered by one small window. Many are cut by sampled edge values
    and numbered slice by slice.
    """
    from pyspark.sql import Window

    values = cut_lineage(value_counts(df, column, "__n"))
    c = F.col(quoted(column))
    if values.count() <= small_rows:
        order = Window.partitionBy(F.lit(0)).orderBy(c)
        return values.select(c, "__n", (F.row_number().over(order) - 1).alias(name))
    sample = [r[0] for r in values.orderBy(F.xxhash64(c), c).limit(512).select(c).collect()]
    edges = F.array(*[F.lit(v) for v in sorted(sample)])
    sliced = values.withColumn("__slice", F.size(F.filter(edges, lambda e: e <= c)))
    sizes = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "__slice", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off")
    )
    local = Window.partitionBy("__slice").orderBy(c)
    numbered = sliced.join(F.broadcast(offsets), "__slice").select(
        c, "__n", (F.row_number().over(local) - 1 + F.col("__off")).alias(name)
    )
    return cut_lineage(numbered)
