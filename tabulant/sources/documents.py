"""Nested documents and raw JSON answers as flat tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulant.sources.sql import body_schema


def _leaves(kind: T.DataType, path: tuple[str, ...]):
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, (*path, f.name))
    else:
        yield path


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted columns; arrays and maps are kept."""
    cols = []
    for f in df.schema.fields:
        for path in _leaves(f.dataType, (f.name,)):
            name = ".".join(path)
            cols.append(F.col(".".join(f"`{p}`" for p in path)).alias(name))
    return df.select(*cols)


def filter_documents(df: DataFrame, equals: Mapping[str, object]) -> DataFrame:
    """Documents whose (dotted) fields equal the given values; no match gives no rows."""
    keep = F.lit(True)
    for field, value in equals.items():
        c = F.col(".".join(f"`{p}`" for p in field.split(".")))
        keep = keep & (c.isNull() if value is None else c == F.lit(value))
    return df.where(keep)


def read_documents(
    spark: SparkSession,
    path: str,
    equals: Mapping[str, object] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """JSON documents that match, flattened."""
    reader = spark.read.schema(schema) if schema else spark.read
    return flatten(filter_documents(reader.json(path), equals or {}))


def parse_documents(df: DataFrame, body: str, schema: str | None = None) -> DataFrame:
    """A column of JSON documents as a struct column of the merged type."""
    return df.withColumn(body, F.from_json(F.col(body), schema or body_schema(df, body)))


def normalize_responses(
    df: DataFrame, body: str = "body", schema: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw JSON answers as one row per item.

    A list gives its items; an object gives the items of `data` when that is a list,
    `data` itself when that is an object, else the items of `results`, else itself.
    Anything else is an error. Without a schema the item type is found first, which
    reads the answers once more.
    """
    # the parsed parts are columns of their own, so each is parsed once per answer
    df = df.where(F.col(body).isNotNull()).select(*keep, F.ltrim(F.col(body)).alias("__text"))
    df = df.select(
        "*",
        F.ltrim(F.get_json_object("__text", "$.data")).alias("__data"),
        F.ltrim(F.get_json_object("__text", "$.results")).alias("__results"),
    )
    text, data, results = F.col("__text"), F.col("__data"), F.col("__results")
    items = "array<string>"

    def starts(c, sign):
        return F.coalesce(F.startswith(c, F.lit(sign)), F.lit(False))

    shape = (
        F.when(starts(text, "["), F.from_json(text, items))
        .when(~starts(text, "{"), F.raise_error(F.lit("the answer is no list or object")))
        .when(starts(data, "["), F.from_json(data, items))
        .when(starts(data, "{"), F.array(data))
        .when(data.isNotNull(), F.raise_error(F.lit("'data' is no list or object")))
        .when(starts(results, "["), F.from_json(results, items))
        .otherwise(F.array(text))
    )
    rows = df.select(*keep, F.explode(shape).alias("item"))
    kind = schema or body_schema(rows, "item")
    return rows.select(*keep, F.from_json("item", kind).alias("item")).select(*keep, "item.*")
