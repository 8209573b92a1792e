"""SQL databases over JDBC, and descriptions of tables and document collections."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int = 16,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Reader options for a query; with a partition column it is read by ranges."""
    if not query or not query.strip():
        raise ValueError("a query is required")
    options = {"url": url, **dict(properties or {})}
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None:
        raise ValueError("a partitioned read needs lower and upper bounds")
    return {
        **options,
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_sql(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Run a SQL query on a database; see `jdbc_options` for partitioned reads."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


def describe_tables(
    spark: SparkSession, database: str | None = None, pattern: str | None = None
) -> DataFrame:
    """(table, ordinal, column, type, nullable) of the catalog's tables and views."""
    rows = []
    for t in spark.catalog.listTables(database, pattern):
        full = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        for i, c in enumerate(spark.catalog.listColumns(full)):
            rows.append((t.name, i, c.name, c.dataType, c.nullable))
    return spark.createDataFrame(
        rows, "table string, ordinal int, column string, type string, nullable boolean"
    )


def variant_type_to_ddl(text: str) -> str:
    """A variant schema as a type Spark can parse JSON with."""

    def typed(m: re.Match) -> str:
        if m["decimal"]:
            # what a double holds is read as one
            return m["type"] if int(m["digits"]) > 15 else "DOUBLE"
        return {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}[m["type"]]

    # a type stands at the start, after "name: " or in ARRAY<...>; names stay as they are
    return re.sub(
        r"`(?:[^`]|``)*`|(?:^|(?<=: )|(?<=ARRAY<))"
        r"(?P<type>OBJECT(?=<)|VOID|VARIANT|(?P<decimal>DECIMAL\((?P<digits>\d+),\s*\d+\)))"
        r"(?=[,<>]|$)",
        lambda m: typed(m) if m["type"] else m[0],
        text,
    )


def body_schema(df: DataFrame, body: str) -> str:
    """The merged type of a JSON text column, found in one aggregate."""
    row = df.agg(F.schema_of_variant_agg(F.parse_json(F.col(body))).alias("s")).first()
    return variant_type_to_ddl(row["s"])


def describe_documents(df: DataFrame, body: str) -> DataFrame:
    """Document count and merged field types of a column of JSON documents."""
    return df.agg(
        F.count(F.col(body)).alias("documents"),
        F.schema_of_variant_agg(F.parse_json(F.col(body))).alias("fields"),
    )
