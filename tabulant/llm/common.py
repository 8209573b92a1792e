"""Helpers shared by the operators: input columns, batches of documents, packed arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def work_path(spark: SparkSession) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which all executors share.

    Where the setting is missing, one machine takes a temporary folder of its own and a
    cluster a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = tempfile.mkdtemp(prefix="tabulant-llm-")
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm-work"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, lineage cut."""
    path = work_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` (long) and `text` (string, null as empty) and nothing else of the input."""
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )


def batched(rows: DataFrame, batch_bytes: int = 4 << 20) -> tuple[DataFrame, int]:
    """Rows of `texts` dealt by a hash into batches of about `batch_bytes` of text.

    Gives the rows with their batch number `b`, partitioned by it, and the number of
    batches: at least one per shuffle partition. The exchange is the same wherever the
    frame is used in one plan, so Spark moves the texts once however often a plan comes
    back to them.
    """
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, -(-size // batch_bytes), least)
    b = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")
    return rows.withColumn("b", b).repartition(parts, "b"), parts


BLOBS = "b int, k int, blob binary"


def asked(dealt: DataFrame, emit: Callable) -> DataFrame:
    """The questions of each batch as rows (b, k, blob).

    `emit(table)` gives {k: bytes} for the rows of one batch: its questions, dealt into
    buckets k by their content, with equal ones already merged.
    """

    def run(table: pa.Table) -> pa.Table:
        out = emit(table) if table.num_rows else {}
        b = table.column("b")[0].as_py() if table.num_rows else 0
        return blobs([b] * len(out), list(out), list(out.values()))

    return dealt.groupBy("b").applyInArrow(run, BLOBS)


def answered(questions: DataFrame, answer: Callable) -> DataFrame:
    """Answers to questions as rows (b, k, blob).

    `answer(k, {b: bytes})` sees the questions of all batches that fell into bucket k and
    gives {b: bytes}, the answers in the order of the questions. A bucket gets one entry
    per batch and question, however many documents ask it.
    """

    def run(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        got = dict(zip(table.column("b").to_pylist(), table.column("blob").to_pylist()))
        out = answer(k, got)
        return blobs(list(out), [k] * len(out), list(out.values()))

    return questions.groupBy("k").applyInArrow(run, BLOBS)


def ask(dealt: DataFrame, emit: Callable, answer: Callable) -> DataFrame:
    """What all batches together know about the questions of each batch."""
    return answered(asked(dealt, emit), answer)


def blobs(b: list, k: list, blob: list) -> pa.Table:
    return pa.table(
        {
            "b": pa.array(b, pa.int32()),
            "k": pa.array(k, pa.int32()),
            "blob": pa.array(blob, pa.binary()),
        }
    )


def finish(dealt: DataFrame, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`fn(table of the batch, {k: answer})` for each batch, with the answers to its questions."""

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        found = dict(zip(got.column("k").to_pylist(), got.column("blob").to_pylist()))
        return fn(rows, found)

    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(run, schema)


def split_by(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts bucket numbers, and the edges of the buckets in it."""
    order = np.argsort(keys.astype(np.uint16 if parts < 65536 else np.int64), kind="stable")
    return order, np.searchsorted(keys[order], np.arange(parts + 1))


def document_chunks(
    batches: Iterator[pa.RecordBatch], most: int = 2 << 20
) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts, cut so that a chunk holds about `most` bytes or one document."""
    for batch in batches:
        ids = batch.column("id").to_pylist()
        col = batch.column("text").cast(pa.binary())
        start = size = 0
        lengths = pa.compute.binary_length(col).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield ids[start:i], col.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < len(ids):
            yield ids[start:], col.slice(start).to_pylist()


def pack(values: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane, so that equal high bytes compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpack(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h
