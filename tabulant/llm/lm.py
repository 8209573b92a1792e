"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions. A node of the tree is a context (the last 0 to
`DEPTH` bytes) with the bits of the byte decided so far; it counts zeros and ones and has a
Krichevsky-Trofimov estimate. The weighted probability of a node is half its own estimate
and half the product of its children (one byte more of context); so each node has the
share of its own estimate in the mixture, and a prediction mixes the estimates of all
depths along the context.

Nothing of the corpus is collected: contexts are dealt into buckets by their last two
bytes, which keeps all deeper nodes of a context together. Only the nodes with at most one
byte of context (65,536 at most) meet on the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import ask, batched, document_chunks, finish, mix, pack, split_by, unpack, written

DEPTH = 5
END = b"\xff"  # ends a text; no byte of UTF-8
SHALLOW = "ctx int, prefix int, n0 double, n1 double, below double"


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives the counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every position of the texts as one number (oldest byte highest),
    and the number of positions of each text (its bytes and the end)."""
    pad = b"\0" * DEPTH
    data = np.frombuffer(b"".join(pad + b + END for b in bodies), np.uint8)
    size = np.array([len(b) + 1 for b in bodies])
    code = np.zeros(len(data) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        code <<= np.uint64(8)
        code |= data[k : len(data) - DEPTH + k]
    # the positions of the padding itself fall out
    if len(bodies) > 1:
        keep = np.ones(len(code), bool)
        gaps = np.cumsum(size + DEPTH)[:-1] - DEPTH
        keep[(gaps[:, None] + np.arange(DEPTH)).ravel()] = False
        code = code[keep]
    return code, size


def bit_nodes(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Per gram and bit: number of the node with `depth` bytes of context, and the bit."""
    byte = code & np.uint64(255)
    context = (code >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
    node = np.empty((len(code), 8), np.uint64)
    for k in range(8):
        node[:, k] = context << np.uint64(8) | np.uint64(1 << k) | byte >> np.uint64(8 - k)
    bit = (byte[:, None] >> np.arange(7, -1, -1).astype(np.uint64)) & np.uint64(1)
    return node, bit.astype(bool)


class Tree:
    """Nodes with `least` to DEPTH bytes of context of the counted grams."""

    def __init__(self, code: np.ndarray, count: np.ndarray, least: int):
        self.least = least
        self.keys, self.kt, self.share = {}, {}, {}
        below = None
        for depth in range(DEPTH, least - 1, -1):
            node, bit = bit_nodes(code, depth)
            keys, at = np.unique(node.ravel(), return_inverse=True)
            each = np.repeat(count.astype(np.float64), 8)
            n1 = np.bincount(at, each * bit.ravel(), len(keys))
            n0 = np.bincount(at, each, len(keys)) - n1
            own = log_kt(n0, n1)
            if below is None:
                weighted, share = own, np.ones(len(keys))
            else:
                child, value = below
                up = (child >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)
                up = up << np.uint64(8) | child & np.uint64(255)
                product = np.bincount(np.searchsorted(keys, up), value, len(keys))
                both = np.logaddexp(own, product)
                weighted, share = both - math.log(2), np.exp(own - both)
            self.keys[depth], self.share[depth] = keys, share
            self.kt[depth] = (n1 + 0.5) / (n0 + n1 + 1)
            below = keys, weighted
            self.n0, self.n1, self.weighted = n0, n1, weighted

    def path(self, code: np.ndarray, shallow: "Shallow") -> np.ndarray:
        """Log10 probability of each gram's byte after its context.

        The mixture ends at the deepest node met in training: a context never met says
        what its parent's own estimate says.
        """
        p = np.full((len(code), 8), np.nan)
        for depth in range(DEPTH, -1, -1):
            source = self if depth >= self.least else shallow
            node, bit = bit_nodes(code, depth)
            keys = source.keys[depth]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
            met = keys[at] == node
            kt, share = source.kt[depth][at], source.share[depth][at]
            mixed = np.where(np.isnan(p), kt, share * kt + (1 - share) * p)
            p = np.where(met, mixed, p)
        p = np.where(np.isnan(p), 0.5, p)
        _, bit = bit_nodes(code, 0)
        return np.log10(np.where(bit, p, 1 - p)).sum(1)


class Shallow:
    """Nodes with no or one byte of context, from the sums that the buckets hand over."""

    def __init__(self, ctx, prefix, n0, n1, below):
        key = ctx.astype(np.uint64) << np.uint64(8) | prefix.astype(np.uint64)
        keys, at = np.unique(key, return_inverse=True)
        n0, n1, below = (np.bincount(at, x, len(keys)) for x in (n0, n1, below))
        self.keys, self.kt, self.share = {1: keys}, {1: (n1 + 0.5) / (n0 + n1 + 1)}, {}
        own = log_kt(n0, n1)
        both = np.logaddexp(own, below)
        self.share[1] = np.exp(own - both)
        root, at = np.unique(keys & np.uint64(255), return_inverse=True)
        r0, r1 = (np.bincount(at, x, len(root)) for x in (n0, n1))
        own, product = log_kt(r0, r1), np.bincount(at, both - math.log(2), len(root))
        self.keys[0], self.kt[0] = root, (r1 + 0.5) / (r0 + r1 + 1)
        self.share[0] = np.exp(own - np.logaddexp(own, product))


def bucket_of(code: np.ndarray, parts: int) -> np.ndarray:
    last = (code >> np.uint64(8)) & np.uint64(0xFFFF)
    return (mix(last + np.uint64(1)) % np.uint64(parts)).astype(np.int64)


def counted(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of texts and how often they occur; texts are taken some MB at a time."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    start = size = 0
    for i, b in enumerate(bodies):
        size += len(b) + DEPTH + 1
        if size > 4 << 20 or i + 1 == len(bodies):
            c, n = np.unique(grams(bodies[start : i + 1])[0], return_counts=True)
            codes.append(c)
            counts.append(n)
            start, size = i + 1, 0
    if len(codes) == 2:
        return codes[1], counts[1]
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of several packed tables with their summed counts."""
    pairs = [unpack_pairs(b) for b in blobs]
    code, at = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in pairs]), len(code))


def pack_pairs(code: np.ndarray, count: np.ndarray) -> bytes:
    return pack(code) + pack(count.astype(np.uint32))


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return unpack(blob[: 8 * n], np.uint64), unpack(blob[8 * n :], np.uint32)


def lowered(table: pa.Table) -> list[bytes]:
    return [t.lower() for t in table.column("text").cast(pa.binary()).to_pylist()]


def word_buckets(bodies: list[bytes], train, parts: int) -> tuple[Counter, list[list[bytes]]]:
    """Training counts of the distinct words of a batch, and its words dealt into buckets.

    Words of a bucket are in an order that depends on the set of rows alone: a batch is read
    twice, and Spark may give its rows in another order the second time.
    """
    words: Counter = Counter()
    for b, t in zip(bodies, train):
        if t:
            words.update(b.split())
        else:
            for w in set(b.split()):
                words.setdefault(w, 0)
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in words:
        out[zlib.crc32(w) % parts].append(w)
    for own in out:
        own.sort()
    return words, out


def fit_shallow(rows: DataFrame, parts: int) -> Shallow:
    """Train the tree once to learn what its nodes near the root need to know of the rest."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, bodies in document_chunks(batches, 8 << 20):
            c, n = counted([b.lower() for b in bodies])
            code, at = np.unique(np.concatenate([code, c]), return_inverse=True)
            count = np.bincount(at, np.concatenate([count, n]), len(code)).astype(np.int64)
        order, edge = split_by(bucket_of(code, parts), parts)
        ks = [k for k in range(parts) if edge[k] < edge[k + 1]]
        cut = [order[edge[k] : edge[k + 1]] for k in ks]
        yield pa.record_batch(
            [
                pa.array(ks, pa.int32()),
                pa.array([pack_pairs(code[c], count[c]) for c in cut], pa.binary()),
            ],
            names=["k", "blob"],
        )

    def tops(table: pa.Table) -> pa.Table:
        code, count = _merged(table.column("blob").to_pylist())
        tree = Tree(code, count, 2)
        keys = tree.keys[2]
        up = ((keys >> np.uint64(8)) & np.uint64(255)) << np.uint64(8) | keys & np.uint64(255)
        node, at = np.unique(up, return_inverse=True)
        sums = [np.bincount(at, x, len(node)) for x in (tree.n0, tree.n1, tree.weighted)]
        ids = [(node >> np.uint64(8)).astype(np.int32), (node & np.uint64(255)).astype(np.int32)]
        return pa.table(dict(zip(("ctx", "prefix", "n0", "n1", "below"), [*ids, *sums])))

    # a context byte and a bit prefix: 65,536 rows at most
    tops_of_all = (
        rows.where("train")
        .select("id", "text")
        .mapInArrow(emit, "k int, blob binary")
        .groupBy("k")
        .applyInArrow(tops, SHALLOW)
        .groupBy("ctx", "prefix")
        .agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
        .toPandas()
    )
    top = tops_of_all.sort_values(["ctx", "prefix"])
    return Shallow(*[top[c].to_numpy() for c in ("ctx", "prefix", "n0", "n1", "below")])


SCORES = (
    "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, word_sum double, "
    "score double, bits_per_byte double, sums array<struct<k:int,n:long,v:long>>"
)


SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("train", pa.bool_()),
        ("n_bytes", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("word_sum", pa.float64()),
        ("score", pa.float64()),
        ("bits_per_byte", pa.float64()),
        ("sums", pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))),
    ]
)


def score_texts(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Score every text by a tree learned from the rows where `training` is true.

    One row per document row: doc_id, train, n_bytes and n_tokens (white-space words and
    one end), n_known (tokens met in training), base_score (log10 probability under the
    smoothed word counts), train_tokens, score (log10 probability of the lower-cased bytes
    and the end under the tree) and bits_per_byte, its code length.

    Texts move once, into batches. A batch sends its distinct words and grams (packed, with
    their training counts) to buckets; each bucket sums what all batches know, mixes its
    part of the tree, and answers with counts and log probabilities. A null text is empty,
    a null condition false; without training rows every bit has probability 1/2. Repeated
    rows give a row each; other columns are ignored.
    """
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.coalesce(training, F.lit(False)).alias("train"),
    )
    dealt, parts = batched(rows, 8 << 20)
    shallow = fit_shallow(rows, parts)

    def questions(table: pa.Table) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
        train = np.array(table.column("train").to_pylist(), bool)
        bodies = lowered(table)
        known = [b for b, t in zip(bodies, train) if t]
        code, count = counted(known)
        other = counted([b for b, t in zip(bodies, train) if not t])[0]
        other = np.setdiff1d(other, code, assume_unique=True)
        code = np.concatenate([code, other])
        count = np.concatenate([count, np.zeros(len(other), np.int64)])
        order = np.argsort(code)
        return bodies, train, code[order], count[order]

    def emit(table: pa.Table) -> dict[int, bytes]:
        bodies, train, code, count = questions(table)
        words, buckets = word_buckets(bodies, train, parts)
        out = {}
        for k, own in enumerate(buckets):
            if own:
                n = np.fromiter(map(words.__getitem__, own), np.uint32, len(own))
                out[k] = len(own).to_bytes(4, "little") + pack(n) + b" ".join(own)
        order, edge = split_by(bucket_of(code, parts), parts)
        for k in range(parts):
            if edge[k] < edge[k + 1]:
                c = order[edge[k] : edge[k + 1]]
                out[parts + k] = pack_pairs(code[c], count[c])
        return out

    def answer_words(got: dict[int, bytes]) -> dict[int, bytes]:
        total: dict[bytes, int] = {}
        asked = {}
        for b, blob in got.items():
            n = int.from_bytes(blob[:4], "little")
            asked[b] = words = blob[4 + 4 * n :].split(b" ")
            for w, c in zip(words, unpack(blob[4 : 4 + 4 * n], np.uint32).tolist()):
                total[w] = total.get(w, 0) + c
        sums = np.array([sum(total.values()), sum(map(bool, total.values()))], np.int64).tobytes()
        return {
            b: sums + pack(np.fromiter(map(total.__getitem__, w), np.int64, len(w)))
            for b, w in asked.items()
        }

    def answer(k: int, got: dict[int, bytes]) -> dict[int, bytes]:
        if k < parts:
            return answer_words(got)
        code, count = _merged(list(got.values()))
        seen = count > 0
        tree = Tree(code[seen], count[seen], 2)
        value = np.concatenate(
            [tree.path(code[i : i + 50_000], shallow) for i in range(0, len(code), 50_000)]
        )
        # the grams go back with their values, so a batch need not collect them again
        out = {}
        for b, blob in got.items():
            own = unpack_pairs(blob)[0]
            out[b] = pack(own) + pack(value[np.searchsorted(code, own)].astype(np.float32))
        return out

    def result(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        bodies, train = lowered(table), np.array(table.column("train").to_pylist(), bool)
        blobs = [blob for k, blob in got.items() if k >= parts]
        code = np.concatenate([np.zeros(0, np.uint64), *(unpack(b[: len(b) // 12 * 8], np.uint64) for b in blobs)])
        value = np.concatenate([np.zeros(0, np.float32), *(unpack(b[len(b) // 12 * 8 :], np.float32) for b in blobs)])
        order = np.argsort(code)
        lookup = Lookup(code[order], value[order])
        counts: dict[bytes, int] = {}
        sums: list[dict] = []
        for k, own in enumerate(word_buckets(bodies, train, parts)[1]):
            if own:
                n, v = np.frombuffer(got[k][:16], np.int64).tolist()
                sums.append({"k": k, "n": n, "v": v})
                counts.update(zip(own, unpack(got[k][16:], np.int64).tolist()))
        logs = {w: math.log10(c + 0.5) for w, c in counts.items()}
        score, tokens, known, logged = [], [], [], []
        for body in bodies:
            words = body.split()
            tokens.append(len(words) + 1)
            known.append(sum(1 for w in words if counts[w]))
            logged.append(math.fsum(map(logs.__getitem__, words)))
            total = 0.0
            for i in range(0, len(body) + 1, 4 << 20):
                # a very long text is looked up in parts that carry their context along
                part = grams_of_part(body, i, i + (4 << 20))
                total += float(lookup(part).sum(dtype=np.float64))
            score.append(total)
        size = [len(b) for b in bodies]
        kind = pa.list_(pa.struct([("k", pa.int32()), ("n", pa.int64()), ("v", pa.int64())]))
        if not size:
            return SCORED.empty_table()
        return pa.table(
            {
                "doc_id": table.column("id"),
                "train": table.column("train"),
                "n_bytes": pa.array(size, pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "word_sum": pa.array(logged, pa.float64()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(
                    [-s / math.log10(2) / (n + 1) for s, n in zip(score, size)], pa.float64()
                ),
                # what the buckets said of all words, once per batch
                "sums": pa.array([sums] + [None] * (len(size) - 1), kind),
            }
        )

    scored = written(finish(dealt, ask(dealt, emit, answer), result, SCORES))
    ends = scored.where("train").count()
    totals = scored.select(F.inline("sums")).distinct().agg(F.sum("n"), F.sum("v")).first()
    tokens = (totals[0] or 0) + ends
    kinds = (totals[1] or 0) + (ends > 0)
    base = (
        F.col("word_sum")
        + F.lit(math.log10(ends + 0.5))
        - F.col("n_tokens") * F.lit(math.log10(tokens + 0.5 * (kinds + 1)))
    )
    return scored.select(
        "doc_id",
        "train",
        "n_bytes",
        "n_tokens",
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        "bits_per_byte",
    )


def grams_of_part(body: bytes, start: int, end: int) -> np.ndarray:
    data = b"\0" * max(0, DEPTH - start) + body[max(0, start - DEPTH) : end]
    if end > len(body):
        data += END
    data = np.frombuffer(data, np.uint8)
    code = np.zeros(len(data) - DEPTH, np.uint64)
    for k in range(DEPTH + 1):
        code <<= np.uint64(8)
        code |= data[k : len(data) - DEPTH + k]
    return code


class Lookup:
    """Values of sorted keys by hashed place; keys that share a place are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(8, int(2 * len(keys) + 1).bit_length())
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self.place(keys)] = np.arange(len(keys), dtype=np.int32)

    def place(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self.slot[self.place(asked)]
        wrong = np.flatnonzero(self.keys[at] != asked)
        at[wrong] = np.searchsorted(self.keys, asked[wrong])
        return self.values[at]
