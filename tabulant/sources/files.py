"""Files: CSV with checks, objects by format, listings, result tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: file suffixes and content types of the readable formats
SUFFIXES = {
    ".csv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
    ".parquet": "parquet",
}
CONTENT_TYPES = {"csv": "csv", "json": "json", "parquet": "parquet"}
PACKED = (".gz", ".bz2", ".zst")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    mode: str = "FAILFAST",
    **options,
) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given.

    A missing path, a row that does not fit and an empty file are errors. Without an
    encoding the file is read as UTF-8, or as Latin-1 when a line has bytes that are not
    UTF-8; naming the encoding saves that look at the lines.
    """

    def load(enc):
        reader = spark.read.options(header=True, mode=mode, encoding=enc, **options)
        return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)

    try:
        if encoding is None:
            lines = spark.read.text(path)
            broken = not lines.where(~F.is_valid_utf8("value")).isEmpty()
            encoding = "ISO-8859-1" if broken else "UTF-8"
        df = load(encoding)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise ValueError(f"cannot read {path}: {e}") from e
    if not df.columns:
        raise ValueError(f"the file is empty: {path}")
    if df.isEmpty():
        raise ValueError(f"the file has no rows: {path}")
    return df


def detect_format(path: str, content_type: str | None = None) -> str:
    """Format by suffix, then by content type, else csv."""
    name = path.rstrip("/").lower()
    for suffix in PACKED:
        name = name.removesuffix(suffix)
    for suffix, fmt in SUFFIXES.items():
        if name.endswith(suffix):
            return fmt
    for word, fmt in CONTENT_TYPES.items():
        if content_type and word in content_type.lower():
            return fmt
    return "csv"


def read_object(
    spark: SparkSession,
    path: str,
    content_type: str | None = None,
    schema: T.StructType | str | None = None,
    **options,
) -> DataFrame:
    """Any path Hadoop can open, in the format its name or content type tells."""
    fmt = detect_format(path, content_type)
    if fmt == "csv":
        options = {"header": True, **({} if schema else {"inferSchema": True}), **options}
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def list_objects(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size, modified) of every file under a folder; no file content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def write_results(tables: Mapping[str, DataFrame], path: str, fmt: str = "json") -> dict[str, str]:
    """Every result table into its own folder; gives the folders by name."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown format: {fmt}")
    out = {}
    for name, df in tables.items():
        folder = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(folder)
        out[name] = folder
    return out
