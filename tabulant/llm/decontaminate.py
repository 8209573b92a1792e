"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and items become words (A-Z lower-cased; letters, digits and everything outside
ASCII), joined by single spaces. Each run of `window` consecutive item words is a pattern.
A table over hashed blocks says how far the search may jump; where it says zero, the
bucket of the block lists the patterns to compare byte by byte.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import document_chunks, texts

KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in KEPT else 32
    for b in range(256)
)
BLOCK = 8
CURSORS = 4096


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Patterns of similar length. `search` gives (position, pattern) of all occurrences."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.least = m = min(map(len, patterns))
        self.block = b = min(BLOCK, m)
        blocks = len(patterns) * (m - b + 1)
        self.bits = max(12, min(24, (8 * blocks).bit_length()))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int64)
        self.bucket: dict[int, list[int]] = defaultdict(list)
        flat = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        for j in range(m - b + 1):
            codes = self.codes(flat[:, j : j + b])
            np.minimum.at(self.shift, codes, m - b - j)
        for i, c in enumerate(codes.tolist()):
            self.bucket[c].append(i)

    def codes(self, block: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(block), 8), np.uint8)
        wide[:, : self.block] = block
        h = wide.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """All occurrences. Many cursors run side by side, each over its share of the text."""
        data = np.frombuffer(text, np.uint8)
        last = len(data) - self.block
        if len(data) < self.least:
            return []
        grams = np.lib.stride_tricks.sliding_window_view(data, self.block)
        first = self.least - self.block  # where the first block of a pattern can end up
        share = max(64, -(-(last + 1 - first) // CURSORS))
        at = np.arange(first, last + 1, share)
        end = np.minimum(at + share, last + 1)
        zeros = []
        while len(at):
            codes = self.codes(grams[at])
            jump = self.shift[codes]
            hit = jump == 0
            if hit.any():
                zeros.append(np.stack([at[hit], codes[hit]]))
            at = at + np.maximum(jump, 1)
            alive = at < end
            if not alive.all():
                at, end = at[alive], end[alive]
        found = []
        if zeros:
            for p, c in np.concatenate(zeros, axis=1).T.tolist():
                begin = p - first
                for i in self.bucket.get(c, ()):
                    if text.startswith(self.patterns[i], begin):
                        found.append((begin, i))
        return found


def window_patterns(items: list[tuple[str, bytes]], window: int) -> dict[bytes, set[str]]:
    """Space-delimited windows and the items they come from."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        if w:
            for i in range(max(1, len(w) - window + 1)):
                owners[b" " + b" ".join(w[i : i + window]) + b" "].add(item)
    return owners


def _scanner(items: list[tuple[str, bytes]], window: int, id_type: pa.DataType = pa.int64()):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = window_patterns(items, window)
        by_size = defaultdict(list)
        for p in owners:
            by_size[len(p).bit_length()].append(p)
        searches = [WuManber(ps) for ps in by_size.values()]
        for ids, bodies in document_chunks(batches):
            parts, starts, counts = [], [], []
            at = 0
            for body in bodies:
                w = words_of(body)
                line = b" " + b" ".join(w) + b" \n"
                starts.append(at)
                counts.append(len(w))
                at += len(line)
                parts.append(line)
            text = b"".join(parts)
            hits: dict[int, list] = defaultdict(list)
            edge = np.array(starts)
            for s in searches:
                found = s.search(text)
                owner = np.searchsorted(edge, [f[0] for f in found], "right") - 1
                for d, (p, i) in zip(owner.tolist(), found):
                    hits[d].append((p, s.patterns[i]))
            spans, names = [], []
            for d in range(len(ids)):
                marked = np.zeros(counts[d] + 1, np.int8) if d in hits else None
                got: set[str] = set()
                edges = []
                if marked is not None:
                    for p, pattern in hits[d]:
                        w = text.count(b" ", starts[d], p)
                        marked[w : w + pattern.count(b" ") - 1] = 1
                        got |= owners[pattern]
                    edges = np.flatnonzero(np.diff(marked, prepend=0)).reshape(-1, 2).tolist()
                spans.append([{"start": a, "end": b} for a, b in edges])
                names.append(sorted(got))
            yield pa.record_batch(
                [
                    pa.array(ids, id_type),
                    pa.array(counts, pa.int64()),
                    pa.array(
                        spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    ),
                    pa.array(names, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return scan


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
MARKED = SCHEMA.replace("doc_id long", "doc_id struct<id:long,mark:string>")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Word spans of each document that lie in a window of a benchmark item.

    One row per document row: doc_id, n_words, spans (word positions, end exclusive, merged),
    items (sorted ids with an occurring window). An item with fewer than `window` words is
    one window. The items are the stated query set; they are taken in blocks of about
    `block_bytes` of text, so what is sent to executors at once has that bound, and each
    block is a scan of the documents. With one block there is no shuffle; with more, the
    blocks' findings meet by id and digest of the text, and come back once per repeat.

    A null text has no words; an empty table gives no rows; repeated rows give a row each;
    rows of `benchmark` with a null id or text are no item, and repeated item ids pool
    their windows. Other columns are ignored.
    """
    queries = benchmark.select(
        F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")
    ).where("i is not null and t is not null")
    size = queries.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = texts(docs, key, text)
    if blocks == 1:
        got = [(r.i, r.t.encode()) for r in queries.collect()]
        return rows.mapInArrow(_scanner(got, window), SCHEMA)
    dealt = queries.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    rows = rows.select(F.struct("id", F.sha2("text", 256).alias("mark")).alias("id"), "text")
    id_type = pa.struct([("id", pa.int64()), ("mark", pa.string())])
    found = None
    for k in range(blocks):
        got = [(r.i, r.t.encode()) for r in dealt.where(F.col("k") == k).collect()]
        part = rows.mapInArrow(_scanner(got, window, id_type), MARKED)
        found = part if found is None else found.unionByName(part)
    # equal rows find the same, each once per block
    repeats = F.sequence(F.lit(1), (F.count("*") / blocks).cast("int"))
    return (
        found.groupBy("doc_id", "n_words")
        .agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            repeats.alias("repeats"),
        )
        .withColumn("repeat", F.explode("repeats"))
        .select("doc_id.id", "n_words", _merged("spans").alias("spans"), "items")
        .withColumnRenamed("id", "doc_id")
    )


def _merged(spans: str):
    """Sorted spans with those that touch or overlap made one."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(done, s):
        top = F.element_at(done, -1)
        joined = F.struct(
            top["start"].alias("start"), F.greatest(top["end"], s["end"]).alias("end")
        )
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"])
        return F.when(touches, grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.col(spans), empty, step)
