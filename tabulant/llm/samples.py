"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bottom_sample(rows: DataFrame, order, size: int) -> DataFrame:
    """At most `size` rows: those with the smallest `order` (a hash of the row).

    The threshold is found from the hashes alone, so no task sends texts that are not in
    the sample; the last limit only matters if very many rows have one hash.
    """
    hashed = rows.withColumn("__order", order)
    edge = hashed.select("__order").orderBy("__order").limit(size)
    top = edge.agg(F.max("__order")).first()[0]
    return hashed.where(F.col("__order") <= F.lit(top)).limit(size).drop("__order")
