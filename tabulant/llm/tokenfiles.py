"""Token ids in raw binary shards, with a minimal perfect hash index over document keys.

A dataset is a folder with three parts:

* `shards/`: a file per shard. Header (SHARD), ids of all documents one after the other as
  little-endian unsigned integers of 2 or 4 bytes, then the table of its documents: end of
  each (in ids, 8 bytes) and its key (8 bytes; the first `nulls` have none), then the CRC-32
  of all that. Documents are in ascending key order, also from shard to shard.
* `table/`: Parquet with a row per shard: rows and ids of it and of all shards before.
* `index/`: a file per bucket of keys. Header (BUCKET), the levels of a minimal perfect hash
  (bits, and counts of bits before each word), then by slot: fingerprint, shard, row, offset
  in ids, and number of rows with that key, which follow each other.

Each file ends with one line feed, as Spark's text writer puts it; so files go to any store
that Spark can write to, and are committed as a whole even if tasks run twice.

The hash: a level has a bit per place; a key alone at its place sets the bit and is done,
the others go on to the next, smaller level. A key's slot is the number of bits before its
own. Keys that are not in the set have other fingerprints (but for one in 2^32).
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulant.llm.bpe import PRE, byte_characters
from tabulant.llm.common import mix, texts, written

SHARD = "<8sIIIIIQ"  # magic, part, piece, bytes an id, documents, nulls, ids
SHARD_MAGIC = b"TOKENS01"
BUCKET = "<8sIIIII"  # magic, bucket, buckets, keys, has null, levels
BUCKET_MAGIC = b"MPHIDX01"
#: Ids of a shard; a longer document has a shard of its own.
SHARD_IDS = 4 << 20
#: Text that a task sorts and encodes.
PART_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 200_000
#: Words and pre-tokens in a table before it is the old one.
WORDS = 80_000
PIECES = 450_000
MARKS = frozenset(".,;:!?")
#: A space after other white space may share a pre-token with it.
LATE_SPACE = regex.compile(r"\s ")
SPARE = 2.0
CHUNK = 4096


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys."""

    def __init__(self, sizes: list[int], words: np.ndarray, before: np.ndarray):
        self.sizes, self.words, self.before = sizes, words, before

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mix(keys ^ mix(np.array([step]))) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(keys):
            size = -(-max(64, int(SPARE * len(keys))) // 64) * 64
            at = PerfectHash.places(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        words = np.concatenate([np.zeros(0, np.uint64), *bits])
        count = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
        return PerfectHash(sizes, words, np.concatenate([np.zeros(1, np.uint32), count[:-1]])[: len(words)])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that no level takes."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        start = 0
        for level, size in enumerate(self.sizes):
            at = self.places(keys[left], level, size)
            word, bit = start + at // 64, (at % 64).astype(np.uint64)
            own = self.words[word]
            hit = (own >> bit) & np.uint64(1) == 1
            below = own & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            start += size // 64
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


ENTRY = [("fp", "<u4"), ("shard", "<i8"), ("row", "<u4"), ("offset", "<u8"), ("rows", "<u8")]


class KeyIndex:
    """A bucket of the index over the bytes of its file (or a memory map of it)."""

    def __init__(self, data: bytes):
        magic, self.bucket, self.buckets, n, has_null, levels = struct.unpack_from(BUCKET, data)
        if magic != BUCKET_MAGIC:
            raise ValueError("not an index file")
        at = struct.calcsize(BUCKET)
        sizes = np.frombuffer(data, "<u8", levels, at).tolist()
        at += 8 * levels
        words = np.frombuffer(data, "<u8", sum(sizes) // 64, at)
        at += words.nbytes
        before = np.frombuffer(data, "<u4", len(words), at)
        at += before.nbytes
        self.hash, self.null = PerfectHash(sizes, words, before), n - 1 if has_null else -1
        self.entries = np.frombuffer(data, np.dtype(ENTRY), n, at)

    @staticmethod
    def dump(bucket: int, buckets: int, keys: np.ndarray, null: np.ndarray, entries: np.ndarray) -> bytes:
        """`entries` has the fields of ENTRY in the order of `keys`; `null` marks the null key."""
        keys, own = keys.astype(np.int64).view(np.uint64), ~null
        made = PerfectHash.build(keys[own])
        out = np.zeros(len(keys), np.dtype(ENTRY))
        entries["fp"] = fingerprint(keys)
        out[made.slots(keys[own])] = entries[own]
        if null.any():
            out[-1] = entries[null][0]
        head = struct.pack(BUCKET, BUCKET_MAGIC, bucket, buckets, len(keys), int(null.any()), len(made.sizes))
        sizes = np.array(made.sizes, "<u8").tobytes()
        return head + sizes + made.words.astype("<u8").tobytes() + made.before.astype("<u4").tobytes() + out.tobytes()

    def find(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Number of the entry of each key, -1 for strangers."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.entries["fp"][slot[known]] == fingerprint(keys[known])
        return np.where(null, self.null, np.where(known, slot, -1))


class TokenShard:
    """A shard over the bytes of its file (or a memory map of it)."""

    def __init__(self, data: bytes, check: bool = False):
        magic, self.part, self.piece, width, docs, self.nulls, ids = struct.unpack_from(SHARD, data)
        end = struct.calcsize(SHARD) + width * ids + 16 * docs
        if magic != SHARD_MAGIC or len(data) < end + 4:
            raise ValueError("not a whole shard")
        if check and zlib.crc32(memoryview(data)[:end]) != struct.unpack_from("<I", data, end)[0]:
            raise ValueError("the shard's checksum differs")
        self.ids = np.frombuffer(data, f"<u{width}", ids, struct.calcsize(SHARD))
        self.ends = np.frombuffer(data, "<u8", docs, struct.calcsize(SHARD) + width * ids)
        self.keys = np.frombuffer(data, "<i8", docs, struct.calcsize(SHARD) + width * ids + 8 * docs)

    @property
    def number(self) -> int:
        return self.part << 32 | self.piece

    def document(self, row: int) -> np.ndarray:
        return self.ids[int(self.ends[row - 1]) if row else 0 : int(self.ends[row])]

    @staticmethod
    def dump(part: int, piece: int, width: int, keys: list, rows: list[np.ndarray]) -> bytes:
        ends = np.cumsum([len(r) for r in rows], dtype="<u8")
        head = struct.pack(SHARD, SHARD_MAGIC, part, piece, width, len(rows), keys.count(None), int(ends[-1]))
        ids = np.concatenate(rows).astype(f"<u{width}").tobytes()
        named = np.array([0 if k is None else k for k in keys], "<i8").tobytes()
        out = b"".join([head, ids, ends.tobytes(), named])
        return out + struct.pack("<I", zlib.crc32(out))


class Encoder:
    """The library's tokenizer; what it made of words and pre-tokens is kept for the next ones.

    A text is cut before its spaces, which is also where pre-tokens begin, unless a space
    follows other white space. Words not met before are cut into pre-tokens, and those not
    met before go through the merge list of the library.
    """

    def __init__(self, shared: dict):
        from tokenizers import Tokenizer

        if "tokenizer" not in shared:
            shared["tokenizer"] = Tokenizer.from_str(shared["source"])
            shared["known"] = {}, {}, {}, {}
        self.tokenizer, self.shared = shared["tokenizer"], shared
        self.words, self.old_words, self.pieces, self.old_pieces = shared["known"]
        self.tokenize = self.tokenizer.model.tokenize
        shown = {b: c for c, b in byte_characters().items()}
        self.shown = [shown[b] for b in range(256)]
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {name: array("I", [i]).tobytes() for name, i in added.items()}
        names = sorted(map(regex.escape, added), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(names) + ")") if names else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        known = self.pieces.get(piece)
        if known is None:
            known = self.old_pieces.get(piece)
        if known is None:
            if piece.isascii() and piece.isprintable():
                spelled = piece.replace(" ", self.shown[32])
            else:
                spelled = "".join(map(self.shown.__getitem__, piece.encode()))
            known = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = known
        return known

    def age(self) -> None:
        """Full tables become the old ones, from which what comes again is taken over."""
        if len(self.words) > WORDS:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > PIECES:
            self.pieces, self.old_pieces = {}, self.pieces
        self.shared["known"] = self.words, self.old_words, self.pieces, self.old_pieces

    def cut_up(self, text: str) -> bytes:
        return b"".join(map(self.piece, PRE.findall(text)))

    def word(self, word: str) -> bytes:
        """Ids of a word with the space before it. Letters alone, or with one mark, need no search."""
        if word.isalpha():
            return self.piece(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.piece(" " + word[:-1]) + self.piece(word[-1])
        return self.cut_up(" " + word)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        parts = self.cut.split(text) if self.cut else [text]
        out = [self.cut_up(t) if i % 2 == 0 else self.added[t] for i, t in enumerate(parts)]
        return np.frombuffer(b"".join(out), np.uint32)

    def encode_all(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array, each of its different words looked at once."""
        texts_ = column.to_pylist()
        odd = [
            i for i, t in enumerate(texts_)
            if LATE_SPACE.search(t) or any(name in t for name in self.added)
        ]
        plain = np.ones(len(texts_), bool)
        plain[odd] = False
        split = pc.split_pattern(column.filter(pa.array(plain)).cast(pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        of = coded.indices.to_numpy().astype(np.int64)
        begins = np.diff(split.offsets.to_numpy()).cumsum()
        begins = np.concatenate([[0], begins]).astype(np.int64)
        known, old, table = self.words, self.old_words, []
        for word in coded.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                ids = old.get(word) or self.word(word)
                if len(word) <= 64:
                    known[word] = ids
            table.append(ids)
        # the first word of a text has no space before it
        firsts = of[begins[:-1]]
        of[begins[:-1]] = len(table) + np.arange(len(firsts))
        words = coded.dictionary
        table += [self.cut_up(w) for w in words.take(pa.array(firsts)).to_pylist()]
        flat = np.frombuffer(b"".join(table), np.uint32)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        start = np.cumsum(size) - size
        each = size[of]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[of] - ends[:-1], each) + np.arange(ends[-1])]
        out = np.split(ids, ends[begins[1:-1]]) if len(begins) > 1 else []
        self.age()
        for i in odd:
            out.insert(i, self.encode(texts_[i]))
        return out


def encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple]:
    """(key, ids) of each row, some MB of text at once."""
    for batch in batches:
        column = batch.column("text")
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
            keys = batch.column("id").slice(at, to - at).to_pylist()
            yield from zip(keys, encoder.encode_all(column.slice(at, to - at)))
            at = to


def shard_writer(shared, end_id: int):
    """Shards of a partition, as rows with the bytes of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        width = 2 if max(encoder.size - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], np.uint32)
        part, piece = TaskContext.get().partitionId(), 0
        keys, rows, size = [], [], 0

        def row() -> pa.RecordBatch:
            blob = TokenShard.dump(part, piece, width, keys, rows)
            return pa.record_batch({"blob": pa.array([blob], pa.binary())})

        for key, found in encoded(batches, encoder):
            ids = np.concatenate([found, end]).astype(f"<u{width}")
            if rows and size + len(ids) > SHARD_IDS:
                yield row()
                keys, rows, size, piece = [], [], 0, piece + 1
            keys.append(key)
            rows.append(ids)
            size += len(ids)
        if rows:
            yield row()

    return run


def save_files(blobs: DataFrame, path: str) -> None:
    """Each row's bytes as a file of its own."""
    spelled = blobs.select(F.col("blob").cast("string"))
    spelled.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


PLACES = "shard long, row long, doc_id long, offset long, n_tokens long"


def unfold(batches: Iterator[pa.RecordBatch], with_ids: bool = True) -> Iterator[pa.RecordBatch]:
    """A row per document of each shard; ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        for content in batch.column("content"):
            shard = TokenShard(content.as_buffer(), check=True)
            starts = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
            ends = shard.ends.astype(np.int64)
            total = len(ends)
            for a in range(0, total, CHUNK):
                b = min(a + CHUNK, total)
                at = np.arange(a, b)
                columns = {
                    "shard": pa.array(np.full(b - a, shard.number)),
                    "row": pa.array(at),
                    "doc_id": pa.array(shard.keys[a:b], mask=at < shard.nulls),
                    "offset": pa.array(starts[a:b]),
                    "n_tokens": pa.array(ends[a:b] - starts[a:b]),
                }
                if with_ids:
                    ids = [shard.ids[i:j].astype("<u4").tobytes() for i, j in zip(starts[a:b], ends[a:b])]
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.record_batch(columns)


def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each shard without their ids."""
    return unfold(batches, with_ids=False)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """shard, row, doc_id, offset, n_tokens and ids of all documents, straight from the shards.

    `ids` are the bytes of little-endian unsigned 32-bit integers. Checksums are verified.
    """
    return file_bytes(spark, f"{path}/shards").mapInArrow(unfold, f"{PLACES}, ids binary")


def shard_table(documents: DataFrame) -> DataFrame:
    """Per shard: rows and ids, and how many of both come before it, by groups of shards."""
    sizes = documents.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("ids")
    )
    part = F.shiftright("shard", 42)  # some thousand parts
    grouped = written(sizes.withColumn("part", part))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tops = grouped.groupBy("part").agg(F.sum("rows").alias("r"), F.sum("ids").alias("i"))
    tops = tops.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "ri"])
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    return grouped.join(tops, "part").select(
        "shard", "rows", "ids", (F.col("r") + own("rows")).alias("first_row"), (F.col("i") + own("ids")).alias("first_id")
    )


def index_bucket(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        entries = np.zeros(n, np.dtype(ENTRY))
        for name, _ in ENTRY[1:]:
            entries[name] = table.column(name).to_numpy()
        column = table.column("doc_id")
        null = column.is_null().to_numpy()
        keys = column.fill_null(0).to_numpy()
        blob = KeyIndex.dump(table.column("bucket")[0].as_py() if n else 0, buckets, keys, null, entries)
        return pa.table({"blob": pa.array([blob] if n else [], pa.binary())})

    return run


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long")


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode whole texts with the library's tokenizer file and write the dataset to `path`.

    Each document's ids end with `end_id`. Documents are in ascending key order, null keys
    first, equal keys by a hash of their text; texts are moved once, dealt by ranges of
    (key, hash, place), so a key of very many rows lies in many shards. Null text: empty, a
    document of the end id alone; repeated rows are documents of their own; an empty table
    gives a dataset without shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast({"source": f.read()})
    rows = texts(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    order = [F.asc_nulls_first("id"), "tie", "place"]
    dealt = (
        rows.withColumn("tie", F.xxhash64("text"))
        .withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(max(1, -(-size // PART_BYTES)), *order)
        .sortWithinPartitions(*order)
        .select("id", "text")
    )
    save_files(dealt.mapInArrow(shard_writer(shared, end_id), "blob binary"), f"{path}/shards")
    found = written(file_bytes(spark, f"{path}/shards").mapInArrow(table_of, PLACES))
    shard_table(found).write.parquet(f"{path}/table")

    # rows of one key follow each other: its entry is the first of them
    entries = found.groupBy("doc_id").agg(
        F.min(F.struct("shard", "row", "offset")).alias("first"), F.count(F.lit(1)).alias("rows")
    )
    entries = written(entries.select("doc_id", "first.*", "rows"))
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))
    blobs = (
        entries.withColumn("bucket", bucket_of("doc_id", buckets))
        .groupBy("bucket")
        .applyInArrow(index_bucket(buckets), "blob binary")
    )
    save_files(blobs, f"{path}/index")


def find(keys: pa.Table, index: pa.Table) -> pa.Table:
    column = keys.column("doc_id")
    blobs = index.column("content").to_pylist()
    if blobs and keys.num_rows:
        bucket = KeyIndex(blobs[0])
        slot = bucket.find(column.fill_null(0).to_numpy(), column.is_null().to_numpy())
        entries = bucket.entries[slot[slot >= 0]]
        column = column.filter(pa.array(slot >= 0))
    else:
        entries = np.zeros(0, np.dtype(ENTRY))
        column = column.slice(0, 0)
    cols = {n: pa.array(entries[n].astype(np.int64)) for n, _ in ENTRY[1:]}
    return pa.table({"doc_id": column.cast(pa.int64()), **cols})


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of the index with the number of their bucket."""
    for batch in batches:
        for data in batch.column("content").to_pylist():
            yield pa.record_batch({"bucket": [struct.unpack_from(BUCKET, data)[1]], "content": [data]})


def look_up(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, shard, row, offset, rows for each distinct key (null is one) that the dataset has.

    Keys go to the bucket of the index that their hash names; there, a hash, a look at the
    bits of some levels and one comparison of fingerprints find the entry.
    """
    files = file_bytes(spark, f"{path}/index")

    index = files.mapInArrow(numbered, "bucket long, content binary")
    head = files.select(F.substring("content", 1, struct.calcsize(BUCKET)).alias("head")).head()
    buckets = struct.unpack(BUCKET, bytes(head.head))[2] if head else 1
    asked = written(keys.select(F.col(f"`{key}`").cast("long").alias("doc_id")).distinct())
    salts = max(1, -(-asked.count() // (buckets * BUCKET_KEYS)))  # keys of one call stay few
    asked = asked.select(
        "doc_id",
        bucket_of("doc_id", buckets).alias("bucket"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(salts)).cast("long").alias("salt"),
    )
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    by = ["bucket", "salt"]
    return asked.groupBy(*by).cogroup(index.groupBy(*by)).applyInArrow(
        find, "doc_id long, shard long, row long, offset long, rows long"
    )


def documents_of(
    spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id", value: Column | None = None
) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents with the given keys, found through the index.

    `start` counts the ids of all documents before. `value`, made of `ids`, takes the place
    of the ids where these are not needed as such. A key's rows are counted off in steps,
    so one with very many is dealt over tasks. Repeated and unknown keys add no rows.
    """
    value = F.col("ids") if value is None else value
    table = spark.read.parquet(f"{path}/table").select("shard", "first_row", "first_id")
    spots = look_up(spark, path, keys, key).join(table, "shard")
    first = F.col("first_row") + F.col("row")
    step = F.lit(CHUNK).cast("long")
    begins = F.explode(F.sequence(first, first + F.col("rows") - 1, step))
    places = (
        spots.select("doc_id", (first + F.col("rows")).alias("end"), begins.alias("a"))
        .repartition("a")
        .select("doc_id", F.explode(F.sequence("a", F.least(F.col("a") + step, F.col("end")) - 1)).alias("at"))
    )
    stored = read_documents(spark, path).withColumn("value", value).drop("ids", "doc_id")
    stored = stored.join(table, "shard").select(
        first.alias("at"), (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", "value"
    )
    return places.join(stored, "at").select("doc_id", "start", "n_tokens", F.col("value").alias("ids"))
