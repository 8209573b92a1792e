"""The prefix tree of conversations against plain prefixes in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tabulant.llm.trie import digest_turns, id_digests, prefix_trie, rebuilt, trie_of

SCHEMA = "conv_id long, turn long, role string, text string, conv string, d string, t long, w string, depth long"


def plain(convs):
    """{conv: [(role, text), ...]} to sorted node rows."""
    at = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            at[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in at:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(at, key=len, reverse=True):
        saved = (len(at[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = 0 if kids[p] else 1
        total[p] = (leaves + sum(total[k][0] for k in kids[p]), saved + sum(total[k][1] for k in kids[p]))
    out = []
    for p, m in at.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        up = min(at[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), up, len(m), len(kids[p]), *total[p], sha))
    return sorted(out, key=str)


def turns_of(seed, convs=90):
    rng = random.Random(seed)
    texts = ["a b", "a  b", "", None, "x\ty\nz", "é ü", "q" * 3000, "same"]
    starts = [[(rng.choice("us"), rng.choice(texts)) for _ in range(rng.randint(1, 5))] for _ in range(6)]
    out = {}
    for c in range(-30, convs):
        s = list(rng.choice(starts)) if rng.random() < 0.7 else []
        s += [(rng.choice(["u", None]), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
        out[c] = s or [("u", "only")]
    for c in range(200, 240):
        out[c] = [("s", "hot"), ("u", "copy"), ("u", "copy")]
    out[300] = [("s", f"w{i}") for i in range(500)]
    return out


def frame(spark, convs):
    rows = [
        (c, None if i == 0 else i, r, t, "x", "x", 1, "x", 1) for c, s in convs.items() for i, (r, t) in enumerate(s)
    ]
    rows += [(None, 1, "u", "no conversation", "x", "x", 1, "x", 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def cleaned(convs):
    return {c: [(r or "", t or "") for r, t in s] for c, s in convs.items()}


def test_trie_equals_plain_prefixes(spark):
    convs = turns_of(1)
    df = frame(spark, convs)
    got = sorted((tuple(r) for r in prefix_trie(df).collect()), key=str)
    assert got == plain(cleaned(convs))
    assert prefix_trie(df.limit(0)).count() == 0


def test_conversations_without_turns(spark):
    convs = {5: [("u", "a")], 7: [], 9: [], 12: [("u", "a"), ("u", "b")]}
    df = frame(spark, convs)
    members = spark.createDataFrame([(c,) for c in [*convs, None]], "conv long")
    got = sorted((tuple(r) for r in prefix_trie(df, members=members).collect()), key=str)
    assert got == plain(convs)
    steps = digest_turns(df.limit(0), ["turn"])
    alone = [tuple(r) for r in trie_of(steps, ["o0"], members).collect()]
    assert alone == plain({c: [] for c in convs})


def test_rebuilt_conversations(spark):
    convs = turns_of(2, 70)
    steps, members = rebuilt(frame(spark, convs), group=20, heads=4)
    got = sorted((tuple(r) for r in trie_of(steps, ["part", "pos"], members).collect()), key=str)
    known, want = cleaned(convs), {}
    for c, s in known.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = known.get(base, [])[:h] + s[h:]
    assert got == plain(want)


def test_ids_of_a_hot_node(spark):
    df = spark.range(-10, 30_000).select(
        F.when(F.col("id") % 7 == 0, F.lit(b"rare")).otherwise(F.lit(b"hot")).alias("d"), F.col("id").alias("conv")
    )
    got = {bytes(r.d): r.sha for r in id_digests(df.repartition(5)).collect()}
    for name, keep in ((b"rare", lambda i: i % 7 == 0), (b"hot", lambda i: i % 7 != 0)):
        text = ",".join(str(i) for i in range(-10, 30_000) if keep(i))
        assert got[name] == hashlib.sha256(text.encode()).hexdigest()
