"""Load a folder in bounded chunks, and profile it while it arrives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.core.columns import melt_numbers, numeric_columns
from tabulant.core.lineage import shared_folder


def open_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_chunk: int = 1, **options
) -> DataFrame:
    """The files of a folder as a stream of chunks of at most `files_per_chunk` files."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_chunk)
        .options(**options)
        .load(path)
    )


def stream_chunks(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    timeout: int | None = None,
) -> int:
    """Pass every chunk to `handle(chunk, number)` until the folder is read; gives the count.

    The checkpoint remembers finished chunks, so a restarted run goes on where it was. A
    run that is not done after `timeout` seconds is stopped and raises TimeoutError.
    """
    spark = stream.sparkSession
    handled: set[int] = set()

    def counted(chunk: DataFrame, number: int) -> None:
        handle(chunk, number)
        handled.add(number)

    query = (
        stream.writeStream.foreachBatch(counted)
        .option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/chunks")
        .trigger(availableNow=True)
        .start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"{len(handled)} chunks were handled in {timeout} s, not all")
    return len(handled)


def running_profile(stream: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, minimum, maximum, sum, sum of squares and variance per numeric column.

    Every measure merges across chunks, so the same expression serves batch and stream.
    """
    columns = list(columns or numeric_columns(stream))
    v = F.col("value")
    return (
        melt_numbers(stream, columns)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(v.isNull()).alias("nulls"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.sum(v).alias("sum"),
            F.sum(v * v).alias("sum_squares"),
            F.var_samp(v).alias("variance"),
        )
    )


def streaming_profile(
    stream: DataFrame, columns: Sequence[str] | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Run the profile over all available chunks and give its final state.

    The state is one row per column; the variance is kept as merged centred moments.
    """
    spark = stream.sparkSession
    name = f"profile_{uuid.uuid4().hex}"
    query = (
        running_profile(stream, columns)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint or f"{shared_folder(spark)}/profile")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    n = F.col("rows") - F.col("nulls")
    mean = F.try_divide("sum", n)
    out = spark.table(name)
    return out.select(
        *[c for c in out.columns if c != "variance"],
        mean.alias("mean"),
        F.sqrt("variance").alias("std"),
    )
