"""N-gram Jaccard join by blocked sparse products of the document by n-gram incidence.

A document is a sparse row over word n-grams. Two rows whose similarity reaches the bound
share one of the rarest n-grams of each, so all batches first learn how many documents
have their n-grams; documents whose rare n-grams nobody else has are done. The others are
grouped by shared rare n-grams, and blocks of rows are multiplied: overlaps are added up
only for pairs that share a rare n-gram, have sizes that allow the bound, and are not
known to be connected already.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import ask, batched, finish, mix, pack, texts, unpack, written
from tabulant.llm.components import component_labels
from tabulant.llm.lm import Lookup

BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 2000


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words (none of them empty), some at a time to keep memory small."""
    if len(words) > 100_000:
        parts = [word_codes(words[i : i + 100_000]) for i in range(0, len(words), 100_000)]
        return np.concatenate(parts)
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), BASE))
    inside = np.arange(len(data)) - np.repeat(start, size)
    return mix(np.add.reduceat(data * power[inside], start) + size.astype(np.uint64))


def shingle_sets(bodies: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram."""
    out = []
    for body in bodies:
        c = word_codes(body.lower().split())
        k = min(n, len(c))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.full(len(c) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h * BASE + c[i : len(c) - k + 1 + i])
        out.append(np.unique(h))
    return out


def prefix_size(size: int, percent: int) -> int:
    """How many of the rarest n-grams a row must be found by: overlap is at least percent % of it."""
    return size - -(-percent * size // 100) + 1


class Rows:
    """The incidence rows of a block in compressed form, n-grams numbered from 0."""

    def __init__(self, sets: list[np.ndarray], prefixes: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.width = flat, len(names)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.rare = [np.searchsorted(names, p) for p in prefixes]
        self.rare_flat = np.concatenate(self.rare)
        self.rare_owner = np.repeat(np.arange(len(sets)), [len(r) for r in self.rare])

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of `others` (ascending) whose similarity to row x reaches the bound."""
        s, t = self.size[x], self.size[others]
        others = others[(100 * np.minimum(s, t) >= percent * np.maximum(s, t))]
        if not len(others):
            return others
        hit = np.zeros(self.width, np.int32)
        hit[self.flat[self.edge[x] : self.edge[x + 1]]] = 1
        size = self.size[others]
        start = np.cumsum(size) - size
        spots = np.arange(size.sum()) + np.repeat(self.edge[others] - start, size)
        both = np.add.reduceat(hit[self.flat[spots]], start)
        return others[100 * both >= percent * (s + size - both)]

    def sharing(self, x: list[int]) -> np.ndarray:
        """Rows that share a rare n-gram with one of the rows x."""
        mark = np.zeros(self.width, bool)
        for i in x:
            mark[self.rare[i]] = True
        out = np.zeros(len(self.size), bool)
        out[self.rare_owner[mark[self.rare_flat]]] = True
        return out


def spanning_links(
    sets: list[np.ndarray], prefixes: list[np.ndarray], known: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Links (row, row) that connect what is connected; rows of one `known` number are already.

    A component grows from its first row: each of its rows is multiplied with the rows that
    are not in it yet, until none is left. So mutually similar rows cost one product, and
    all pairs of rows that stay apart and share a rare n-gram are decided.
    """
    rows = Rows(sets, prefixes)
    free = np.ones(len(sets), bool)
    links = []
    by_label: dict[int, list[int]] = {}
    for i, label in enumerate(known.tolist()):
        by_label.setdefault(label, []).append(i)
    for first in range(len(sets)):
        if not free[first]:
            continue
        front = by_label[int(known[first])][:]
        free[front] = False
        while front:
            block, front = front[:64], front[64:]
            near = rows.sharing(block)
            for x in block:
                others = np.flatnonzero(near & free)
                if not len(others):
                    break
                for y in rows.linked(x, others, percent).tolist():
                    if free[y]:
                        links.append((x, y))
                        group = by_label[int(known[y])]
                        free[group] = False
                        front += group
    return links


def _block_links(percent: int, labelled: bool):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rid").to_pylist()
        rank = sorted(range(len(ids)), key=ids.__getitem__)
        blobs, rare = table.column("tokens").to_pylist(), table.column("prefix").to_pylist()
        label = table.column("label").to_pylist() if labelled else ids
        sets = [np.frombuffer(blobs[i], np.uint64) for i in rank]
        prefixes = [np.array(rare[i], np.int64).view(np.uint64) for i in rank]
        known = np.array([label[i] for i in rank], np.int64)
        got = spanning_links(sets, prefixes, known, percent)
        return pa.table(
            {
                "a": pa.array([ids[rank[x]] for x, _ in got], pa.int64()),
                "b": pa.array([ids[rank[y]] for _, y in got], pa.int64()),
            }
        )

    return run


LINKS = "a long, b long"


def _links_of_groups(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that connect all similar rows within each group g; rows: g, rid, tokens, prefix.

    A group of up to `block` rows is one task. A larger one is dealt into blocks: first each
    block is connected by itself, then the first rows of the blocks' components, and last
    all rows outside the group's largest component meet every block, part by part.
    """
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    rows = rows.join(sizes, "g").withColumn("k", F.pmod(F.xxhash64("rid", F.lit(1)), blocks))
    rows = written(rows)
    links = written(rows.groupBy("g", "k").applyInArrow(_block_links(percent, False), LINKS))
    large = rows.where(F.col("n") > block)
    if large.isEmpty():
        return links
    labels = component_labels(links)
    name = F.coalesce("label", "rid").alias("label")
    told = large.join(labels, large.rid == labels.node, "left").select(*large.columns, name)
    heads = told.where("label = rid")
    width = F.ceil(F.count(F.lit(1)).over(_by("g")) / F.lit(block)).cast("long")
    heads = heads.withColumn("k", F.pmod(F.xxhash64("rid", F.lit(2)), width))
    more = heads.groupBy("g", "k").applyInArrow(_block_links(percent, False), LINKS)
    links = written(links.union(more))
    labels = component_labels(links)
    told = written(large.join(labels, large.rid == labels.node, "left").select(*large.columns, name))
    counts = told.groupBy("g", "label").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("g").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"))
    parts = told.join(main, "g")
    rest = parts.where("label != main")
    left = rest.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("u"))
    part = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("u"))
    cols = ["g", "k", "j", "rid", "tokens", "prefix", "label"]
    # the rows outside the main component meet each block of the group ...
    guests = rest.join(left, "g").withColumn("j", part)
    total = F.ceil(F.col("n") / F.lit(block)).cast("long")
    guests = guests.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)))
    # ... and a block is there once for each part of them
    hosts = parts.join(left, "g").withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("u") - 1))
    )
    meet = guests.select(cols).union(hosts.select(cols)).dropDuplicates(["g", "k", "j", "rid"])
    last = meet.groupBy("g", "k", "j").applyInArrow(_block_links(percent, True), LINKS)
    return links.union(last)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


SETS = (
    "doc_id long, n_shingles long, sig binary, prefix array<long>, tokens binary"
)


def similar_components(
    docs: DataFrame,
    n: int = 4,
    percent: int = 85,
    key: str = "doc_id",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of percent % or more.

    One row per document row: doc_id, n_shingles (size of its set of distinct n-grams of
    lower-cased white-space words; fewer words are one n-gram) and component_id, the
    smallest id reachable by links, itself included. Texts without words (null too) have an
    empty set and no links. Rows with a null id have no links and a null component; rows
    with one id are one node with the links of all. Other columns are ignored; an empty
    table gives no rows. Equal sets are one row of the products, whatever their number.
    `block` bounds the rows that one task multiplies, not what is found.
    """
    dealt, parts = batched(texts(docs, key, text))
    low = np.uint64(0xFFFFFFFF)

    def load(table: pa.Table):
        ids = table.column("id").to_pylist()
        sets = shingle_sets(table.column("text").cast(pa.binary()).to_pylist(), n)
        first: dict[bytes, int] = {}
        sigs = []
        for i, s in enumerate(sets):
            sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            sigs.append(sig)
            if ids[i] is not None and len(s):
                first.setdefault(sig, i)
        picked = sorted(first.values())
        flat = np.concatenate([sets[i] for i in picked]) if picked else np.zeros(0, np.uint64)
        code, count = np.unique(flat, return_counts=True)
        bucket = (code & low) % np.uint64(parts)
        order = np.lexsort((code >> np.uint64(32), bucket))
        edge = np.searchsorted(bucket[order], np.arange(parts + 1))
        return ids, sets, sigs, set(picked), code, count, order, edge

    def emit(table: pa.Table) -> dict[int, bytes]:
        *_, code, count, order, edge = load(table)
        high = (code >> np.uint64(32)).astype(np.uint32)
        out = {}
        for k in range(parts):
            own = order[edge[k] : edge[k + 1]]
            if len(own):
                out[k] = pack(high[own]) + pack(count[own].astype(np.uint32))
        return out

    def answer(k: int, got: dict[int, bytes]) -> dict[int, bytes]:
        own = {b: np.split(unpack_two(x), 2) for b, x in got.items()}
        value, at = np.unique(np.concatenate([x[0] for x in own.values()]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[1] for x in own.values()]), len(value))
        total = total.astype(np.uint32)
        return {b: pack(total[np.searchsorted(value, x[0])]) for b, x in own.items()}

    def result(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        ids, sets, sigs, picked, code, _, order, edge = load(table)
        spread = np.zeros(len(code), np.uint32)
        for k in range(parts):
            own = order[edge[k] : edge[k + 1]]
            if len(own):
                spread[own] = unpack(got[k], np.uint32)
        lookup = Lookup(code, spread)
        prefix, tokens = [], []
        for i, s in enumerate(sets):
            rare = None
            if i in picked:
                p = prefix_size(len(s), percent)
                df = lookup(s)
                if (df == 1).sum() < p:
                    front = np.lexsort((s, df))[:p]
                    rare = s[front[df[front] > 1]]
            prefix.append(None if rare is None else rare.view(np.int64))
            tokens.append(None if rare is None else s.tobytes())
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "sig": pa.array(sigs, pa.binary()),
                "prefix": pa.array(prefix, pa.list_(pa.int64())),
                "tokens": pa.array(tokens, pa.binary()),
            }
        )

    sets = written(finish(dealt, ask(dealt, emit, answer), result, SETS))
    filled = sets.where("doc_id is not null and n_shingles > 0")
    classes = filled.groupBy("sig").agg(F.min("doc_id").alias("rid"))
    copies = filled.join(classes, "sig").where("doc_id != rid").select(
        F.col("doc_id").alias("a"), F.col("rid").alias("b")
    )
    rows = (
        sets.where("tokens is not null")
        .groupBy("sig")
        .agg(F.min(F.struct("doc_id", "prefix", "tokens")).alias("r"))
        .join(classes, "sig")
        .select("rid", "r.prefix", "r.tokens")
    )
    rows = written(rows)
    met = rows.select("rid", F.explode("prefix").alias("t"))
    hub = met.groupBy("t").agg(F.min("rid").alias("h"))
    stars = met.join(hub, "t").where("rid != h").select(
        F.col("rid").alias("a"), F.col("h").alias("b")
    )
    coarse = written(component_labels(stars))
    grouped = rows.join(coarse, rows.rid == coarse.node).select(
        F.col("label").alias("g"), "rid", "tokens", "prefix"
    )
    links = _links_of_groups(grouped, percent, block)
    labels = component_labels(copies.union(links))
    plain = sets.select("doc_id", "n_shingles")
    return plain.join(labels, plain.doc_id == labels.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )


def unpack_two(blob: bytes) -> np.ndarray:
    half = len(blob) // 2
    return np.concatenate([unpack(blob[:half], np.uint32), unpack(blob[half:], np.uint32)])
