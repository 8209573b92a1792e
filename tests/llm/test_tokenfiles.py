"""Token shards and their index against the library and plain slices."""

import mmap
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tabulant.llm import tokenfiles
from tabulant.llm.common import work_path
from tabulant.llm.tokenfiles import (
    Encoder,
    KeyIndex,
    PerfectHash,
    TokenShard,
    documents_of,
    fingerprint,
    look_up,
    read_documents,
    write_tokens,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text, end):
    from tokenizers import Tokenizer

    lib = library.tokenizer = getattr(library, "tokenizer", None) or Tokenizer.from_file(PATH)
    return lib.encode(text or "", add_special_tokens=False).ids + [end]


def ids_of(raw):
    return np.frombuffer(bytes(raw), "<u4").tolist()


def test_files_hold_what_the_library_says(spark, docs_of, messy_rows):
    odd = ["x<|endoftext|>y<|endoftext|>", "日本語 é\r\n\t z", "''re 'sun 's  's  q", "\x1c\x1d a\x85b​ "]
    rows = messy_rows + [(-5 - i, t) for i, t in enumerate(odd)] + [(7, "hot")] * 200 + [(2**62, "big")]
    path = work_path(spark)
    docs = docs_of(rows).repartition(3)
    write_tokens(docs, path, PATH, end_id=3)
    got = documents_of(spark, path, docs).orderBy("start").collect()
    ids = [library(t, 3) for _, t in rows]
    assert sorted(str((r.doc_id, ids_of(r.ids))) for r in got) == sorted(
        str((k, i)) for (k, _), i in zip(rows, ids)
    )
    order = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    crc = {r.start: r.ids for r in documents_of(spark, path, docs, value=F.crc32("ids")).collect()}
    assert crc == {r.start: zlib.crc32(bytes(r.ids)) for r in got}
    keys = spark.createDataFrame([(7,), (7,), (123456,), (None,), (3,)], "doc_id long")
    some = look_up(spark, path, keys).collect()
    assert {r.doc_id: r.rows for r in some} == {7: 201, None: 2, 3: 2}
    assert documents_of(spark, path, keys.where("doc_id = 7")).count() == 201


def test_random_access_without_spark(spark, docs_of):
    path = work_path(spark)
    rows = [(i * 7, f"text number {i} " * (i % 5)) for i in range(300)]
    write_tokens(docs_of(rows).repartition(4), path, PATH)
    plain = path.removeprefix("file:")
    opened = {}
    for kind in ("shards", "index"):
        for name in os.listdir(f"{plain}/{kind}"):
            if name.startswith("part-"):
                with open(f"{plain}/{kind}/{name}", "rb") as f:
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                opened.setdefault(kind, []).append(data)
    shards = {s.number: s for s in map(TokenShard, opened["shards"])}
    assert all(d[-1:] == b"\n" for d in opened["shards"])
    (bucket,) = map(KeyIndex, opened["index"])
    slot = bucket.find(np.array([7 * 17, 5]), np.array([False, False]))
    entry = bucket.entries[slot[0]]
    assert slot[1] == -1 and entry["rows"] == 1
    assert shards[entry["shard"]].document(int(entry["row"])).tolist() == library(rows[17][1], 0)
    assert all(s.ids.itemsize == 2 for s in shards.values())


def test_empty_dataset(spark, docs_of):
    path = work_path(spark)
    write_tokens(docs_of([]), path, PATH)
    assert read_documents(spark, path).count() == 0
    assert documents_of(spark, path, docs_of([(1, "x")])).count() == 0


def test_documents_longer_than_a_shard(monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_IDS", 10)
    blob = TokenShard.dump(3, 1, 4, [None, 5], [np.arange(70_000, dtype=np.uint32), np.arange(2, dtype=np.uint32)])
    shard = TokenShard(blob + b"\n", check=True)
    assert (shard.part, shard.piece, shard.nulls) == (3, 1, 1)
    assert shard.document(0).tolist() == list(range(70_000)) and shard.document(1).tolist() == [0, 1]
    broken = bytearray(blob)
    broken[50] ^= 1
    try:
        TokenShard(bytes(broken), check=True)
    except ValueError:
        return
    raise AssertionError("a damaged shard was read")


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n + 10, dtype=np.uint64))[:n]
        made = PerfectHash.build(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(n))
        assert len(made.words) * 64 <= 5 * n + 64 * (len(made.sizes) + 1)
        strangers = rng.integers(2**63, 2**64, 1000, dtype=np.uint64)
        slot = made.slots(strangers)
        by_slot = np.zeros(n, np.uint32)
        by_slot[made.slots(keys)] = fingerprint(keys)
        assert not (by_slot[slot[slot >= 0]] == fingerprint(strangers[slot >= 0])).any()


def test_encoder_equals_library_on_odd_texts():
    rng = random.Random(4)
    encoder = Encoder({"source": open(PATH, encoding="utf-8").read()})
    marks = "ab é'sre  \u3000\x1c\x85\u180e\u200b \t\n\r12-²ⅷ日́_"
    texts = ["x" * 5000, " " * 700, "ab " * 900, "é" * 999, "日本" * 400, "", " "]
    for n in range(6000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))
        texts.append(text + "<|endoftext|>" * (n % 7 == 0) + " the." * (n % 3))
    want = [library(t, 0)[:-1] for t in texts]
    assert [encoder.encode(t).tolist() for t in texts] == want
    for step in (1, 3, 1000):
        got = [x for i in range(0, len(texts), step) for x in encoder.encode_all(pa.array(texts[i : i + step]))]
        assert [x.tolist() for x in got] == want
