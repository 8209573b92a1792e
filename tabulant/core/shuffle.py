"""Seeded shuffles of column values that scale with the table.

Rows are dealt into blocks of bounded size by a hash of their key, and values are
permuted inside a block, so a shuffle is one exchange and no task sees all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.core.columns import quoted
from tabulant.core.lineage import cut_lineage

BLOCK_ROWS = 5_000
TASK_ROWS = 20_000


def row_hash(df: DataFrame, row_key: str | None, seed: int = 0) -> Column:
    cols = [row_key] if row_key else df.columns
    return F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in cols])


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """The rows dealt evenly over tasks, for fits that read them again and again.

    A small file is one task however many cores there are. The number of tasks follows the
    rows, up to 64 or twice the cores.
    """
    most = max(64, 2 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(min(max(1, -(-df.count() // rows)), most))


def with_block(df: DataFrame, row_key: str | None, seed: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal the rows into blocks of about `rows` rows.

    Without a unique key the table is written first and rows are told apart by their
    place in it, so that equal rows do not pile up in one block; only with a key is the
    same shuffle repeated from run to run.
    """
    if row_key is None:
        df = cut_lineage(df)
        h = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    else:
        h = row_hash(df, row_key, seed)
    blocks = max(1, -(-df.count() // rows))
    return df.withColumn("__hash", h).withColumn("__block", F.pmod("__hash", F.lit(blocks)))


def shuffle_column(
    df: DataFrame, column: str, row_key: str | None = None, seed: int = 0
) -> DataFrame:
    """The table with the values of one column moved to other rows."""
    columns = df.columns

    def move(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__hash", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(key[0])])
        pdf[column] = pdf[column].to_numpy()[rng.permutation(len(pdf))]
        return pdf[columns]

    return with_block(df, row_key, seed).groupBy("__block").applyInPandas(move, df.schema)
