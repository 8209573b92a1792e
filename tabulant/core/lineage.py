"""Cut the lineage of an iterated or reused table by writing it to a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """A fresh folder every executor can reach: under `spark.checkpoint.dir` when it is set.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="tabulant-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a written table.

    The table is computed once, survives the loss of executors, and gives later joins
    its true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
