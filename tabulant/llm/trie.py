"""The prefix tree of conversations, with a count-min sketch that spares lone tails the shuffle.

A prefix is named by a chain of digests. All prefixes are counted in a count-min sketch of
fixed size; only whether a counter has passed one is kept. An estimate of one proves that
no other conversation starts with that prefix: such nodes, and all below them, are emitted
where they are. Only prefixes that may be shared are shuffled and grouped exactly.

What a node sums over its subtree is read off its members. The smallest member of a node
owns it; as members get fewer with depth, a conversation owns its prefixes from one depth
on. So a conversation adds the words of its turns above that depth to the savings of the
nodes it passes, and one leaf if it owns its last node and nobody goes on from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.core.lookup import attach
from tabulant.llm.common import mix, pack, unpack, written

#: Counters of a row of the sketch; three rows, one bit each when broadcast (24 MB in all).
CELL_BITS = 26
ROWS = 3
BLOCK_BITS = 20
FLUSH = 500_000
STEPS = "conv long, depth long, size long, w long, cw long, d binary, up binary"


def digest_turns(
    turns: DataFrame, order: Sequence[str], conv: str = "conv_id", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv, the order columns, t (digest of role and text) and w (words of the text) per turn.

    Null role or text is empty; turns without a conversation are left out. Texts are not
    needed after this.
    """
    r, x = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    return turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)],
        F.substring(F.sha2(F.concat(F.length(r), F.lit(":"), r, x).cast("binary"), 256), 1, 32).alias("t"),
        F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and words of each prefix, from turns sorted by conversation and place."""
    last, state, words = None, b"", 0
    for batch in batches:
        own, ups, cw = [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "t", "w")))
        for conv, t, w in rows:
            if conv != last:
                last, state, words = conv, b"", 0
            ups.append(state)
            state = hashlib.blake2b(state + t.encode(), digest_size=16).digest()
            words += w
            own.append(state)
            cw.append(words)
        kept = [batch.column(c) for c in ("conv", "depth", "size", "w")]
        yield pa.record_batch(
            [*kept, pa.array(cw, pa.int64()), pa.array(own, pa.binary()), pa.array(ups, pa.binary())],
            names=["conv", "depth", "size", "w", "cw", "d", "up"],
        )


def cells(digests: pa.Array) -> np.ndarray:
    """A counter per row of the sketch for each digest."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    mask = np.uint64((1 << CELL_BITS) - 1)
    return np.stack([mix(raw[:, 0] + raw[:, 1] * np.uint64(2 * i + 1)) & mask for i in range(ROWS)])


def partial_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touched counters of a task by block: (block, places, which of them were touched twice)."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            cell, n = np.unique(np.concatenate([p[row] for p in parts]), return_counts=True)
            block = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(first[1:], len(block))
            place = (cell & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
            yield pa.record_batch(
                {
                    "block": pa.array(block[first] + (row << (CELL_BITS - BLOCK_BITS)), pa.int64()),
                    "places": pa.array([pack(place[a:b]) for a, b in zip(first, ends)], pa.binary()),
                    "twice": pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in zip(first, ends)], pa.binary()),
                }
            )

    parts: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            parts.append(cells(batch.column("d")))
        if sum(p.shape[1] for p in parts) > FLUSH:
            yield from flush(parts)
            parts = []
    if parts:
        yield from flush(parts)


def merged_block(table: pa.Table) -> pa.Table:
    """Which counters of a block have passed one."""
    count = np.zeros(1 << BLOCK_BITS, np.uint8)
    for places, twice in zip(table.column("places").to_pylist(), table.column("twice").to_pylist()):
        at = unpack(places, np.uint32)
        more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
        count[at] = np.minimum(count[at] + 1 + more, 2)
    blob = np.packbits(count > 1, bitorder="little").tobytes()
    block = table.column("block")[:1]
    return pa.table({"block": block, "blob": pa.array([blob] * len(block), pa.binary())})


def sketch(prefixes: DataFrame):
    """The sketch of all prefixes, as broadcast bits: counter above one or not."""
    parts = prefixes.select("d").mapInArrow(partial_sketch, "block long, places binary, twice binary")
    blocks = parts.groupBy("block").applyInArrow(merged_block, "block long, blob binary")
    bits = np.zeros((ROWS << (CELL_BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for row in blocks.collect():
        bits[row.block] = np.frombuffer(bytes(row.blob), np.uint8)
    return prefixes.sparkSession.sparkContext.broadcast(bits.tobytes())


def screen(shared):
    """Adds `lone` and `up_lone`: the sketch estimates one for the prefix and for its parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8).reshape(ROWS, -1)

        def lone(digests: pa.Array) -> np.ndarray:
            at = cells(digests)
            shared_all = np.ones(at.shape[1], bool)
            for row in range(ROWS):
                byte = bits[row, (at[row] >> np.uint64(3)).astype(np.int64)]
                shared_all &= (byte >> (at[row] & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return ~shared_all

        for batch in batches:
            if not batch.num_rows:
                continue
            own, up = lone(batch.column("d")), np.zeros(batch.num_rows, bool)
            deep = batch.column("depth").to_numpy() > 1
            if deep.any():
                up[deep] = lone(batch.column("up").filter(pa.array(deep)))
            names = ["conv", "depth", "size", "w", "cw", "d"]
            yield pa.record_batch(
                [*(batch.column(c) for c in names), pa.array(own), pa.array(up)],
                names=[*names, "lone", "up_lone"],
            )

    return run


def id_digests(ends: DataFrame) -> DataFrame:
    """d and the SHA-256 of its conversations' ids, ascending and joined by commas.

    Sorted runs of ids become pieces of text first, so the task that hashes a node with very
    many ids gets few rows, and it keeps one piece at a time.
    """

    def pieces(batches):
        key = begun = None
        ids: list[str] = []
        for batch in batches:
            out = []
            for d, conv in zip(batch.column("d").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (d != key or len(ids) >= 4096):
                    out.append((key, begun, ",".join(ids)))
                    ids = []
                if not ids:
                    key, begun = d, conv
                ids.append(str(conv))
            yield rows_of(out)
        if ids:
            yield rows_of([(key, begun, ",".join(ids))])

    def rows_of(out):
        kinds = {"d": pa.binary(), "begun": pa.int64(), "piece": pa.string()}
        return pa.record_batch({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(kinds.items())})

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            names, shas = [], []
            for d, piece in zip(batch.column("d").to_pylist(), batch.column("piece").to_pylist()):
                if state is not None and d == key:
                    state.update(b",")
                else:
                    if state is not None:
                        names.append(key)
                        shas.append(state.hexdigest())
                    key, state = d, hashlib.sha256()
                state.update(piece.encode())
            yield pa.record_batch({"d": pa.array(names, pa.binary()), "sha": pa.array(shas, pa.string())})
        if state is not None:
            yield pa.record_batch({"d": pa.array([key], pa.binary()), "sha": pa.array([state.hexdigest()])})

    runs = ends.repartitionByRange("d", "conv").sortWithinPartitions("d", "conv")
    texts = runs.mapInArrow(pieces, "d binary, begun long, piece string")
    dealt = texts.repartition("d").sortWithinPartitions("d", "begun")
    return dealt.mapInArrow(hashed, "d binary, sha string")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(steps: DataFrame, order: Sequence[str], members: DataFrame | None = None) -> DataFrame:
    """Nodes of the tree from digested turns (conv, order columns, t, w): see `prefix_trie`."""
    no_ids = F.lit(hashlib.sha256(b"").hexdigest())
    by = Window.partitionBy("conv")
    placed = steps.select(
        "conv",
        F.row_number().over(by.orderBy(*[F.asc_nulls_first(c) for c in order], "t")).cast("long").alias("depth"),
        F.count(F.lit(1)).over(by).alias("size"),
        "t",
        "w",
    )
    prefixes = written(placed.mapInArrow(chain, STEPS))
    members = prefixes.select("conv").distinct() if members is None else members
    members = written(members.select(F.col("conv").cast("long")).where("conv is not null").distinct())
    top = members.agg(F.min("conv")).first()[0]
    top = F.lit(top).cast("long")

    screened = prefixes.mapInArrow(
        screen(sketch(prefixes)),
        "conv long, depth long, size long, w long, cw long, d binary, lone boolean, up_lone boolean",
    )
    tails = screened.where("lone and up_lone")
    rest = written(screened.where("not (lone and up_lone)"))
    heads = rest.where("lone")

    # exact grouping of what may be shared
    groups = rest.where("not lone").groupBy("d").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv").alias("least"),
        F.sum((F.col("depth") == F.col("size")).cast("long")).alias("ends"),
        F.count(F.lit(1)).alias("weight"),
    )
    shared = written(attach(rest.where("not lone"), groups, ["d"], weight="weight"))

    none = F.lit(None).cast("long")
    rows = shared.select("conv", "depth", "size", "w", "cw", "n", "least", "ends").unionByName(
        heads.select("conv", "depth", "size", "w", "cw", none.alias("n"), F.col("conv").alias("least"), none.alias("ends"))
    )
    owned = F.col("least") == F.col("conv")
    last = (F.col("depth") == F.col("size")) & F.col("n").isNotNull()
    convs = written(
        rows.groupBy("conv").agg(
            F.min(F.when(owned, F.col("depth"))).alias("first"),
            F.max("size").alias("len"),
            # words before the first own node; all if there is none
            F.coalesce(
                F.min_by(F.when(owned, F.col("cw") - F.col("w")), F.when(owned, F.col("depth"))), F.max("cw")
            ).alias("before"),
            F.max_by(F.when(~owned, F.col("least")), F.when(~owned, F.col("depth"))).alias("above"),
            F.coalesce(F.bool_or(F.when(last, owned & (F.col("n") == F.col("ends")))), F.lit(True)).alias("leaf"),
        )
    )
    convs = convs.withColumn("own", F.coalesce("first", F.col("len") + 1)).drop("first")

    root = F.lit(b"").cast("binary")
    turnless = members.join(convs.select("conv"), "conv", "left_anti")
    shas = written(
        id_digests(
            shared.where("depth = size").select("d", "conv").unionByName(turnless.select(root.alias("d"), "conv"))
        )
    )

    parent = F.when(F.col("depth") > F.col("own"), F.col("conv")).otherwise(F.coalesce("above", top))
    known = attach(shared, convs.withColumn("weight", F.col("len")), ["conv"], weight="weight")
    inner = known.groupBy("d").agg(
        F.max("least").alias("conv_id"),
        F.max("depth").alias("depth"),
        F.max(F.when(owned, parent)).alias("parent_conv_id"),
        F.max("n").alias("n_convs"),
        F.sum(((F.col("own") <= F.col("depth") + 1) & (F.col("depth") < F.col("size"))).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(
            F.when(F.col("depth") < F.col("own"), F.col("before") - F.col("cw") + F.col("w")).otherwise(0)
        ).alias("saved_tokens"),
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    base = (
        members.select("conv", one.alias("n"), zero.alias("child"), zero.alias("leaf"), zero.alias("saved"))
        .unionByName(
            convs.select(
                none.alias("conv"),
                zero.alias("n"),
                (F.col("own") == 1).cast("long").alias("child"),
                F.col("leaf").cast("long").alias("leaf"),
                F.col("before").alias("saved"),
            )
        )
        .agg(F.min("conv"), F.sum("n"), F.sum("child"), F.sum("leaf"), F.sum("saved"))
        .toDF("conv_id", "n_convs", "n_children", "leaves", "saved_tokens")
        .where("n_convs > 0")
        .select(
            root.alias("d"),
            "conv_id",
            zero.alias("depth"),
            none.alias("parent_conv_id"),
            "n_convs",
            "n_children",
            # without turns the root is a leaf
            F.greatest("leaves", one).alias("n_leaves"),
            "saved_tokens",
        )
    )
    nodes = inner.unionByName(base).join(shas, "d", "left").withColumn("ends_sha256", F.coalesce("sha", no_ids))

    def lone(df: DataFrame, above) -> DataFrame:
        ended = F.col("depth") == F.col("size")
        return df.select(
            F.col("conv").alias("conv_id"),
            "depth",
            above.alias("parent_conv_id"),
            one.alias("n_convs"),
            (~ended).cast("long").alias("n_children"),
            one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.when(ended, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(no_ids).alias("ends_sha256"),
        )

    led = heads.join(convs.select("conv", "own", "above"), "conv")
    return nodes.select(NODE).unionByName(lone(led, parent)).unionByName(lone(tails, F.col("conv")))


def prefix_trie(
    turns: DataFrame,
    order: Sequence[str] = ("turn",),
    conv: str = "conv_id",
    role: str = "role",
    text: str = "text",
    members: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct prefix of turns (role, text), from the empty one (the root, depth 0).

    conv_id (smallest member), depth, parent_conv_id (smallest member of the parent; null
    for the root), n_convs (conversations that start so), n_children, n_leaves (childless
    nodes below, itself included), saved_tokens (over the subtree, (n_convs - 1) x words of
    the last text) and ends_sha256 (ids of the conversations that end here, ascending).

    Turns are ordered by `order`, nulls first, ties by a digest of role and text. Null role
    or text is empty; rows without a conversation are left out; repeated rows are turns.
    `members` (conv) names all conversations if some have no turn. Other columns are
    ignored; without conversations there are no rows, not even a root.

    One task orders and chains the turns of a conversation, in constant memory.
    """
    steps = digest_turns(turns, order, conv, role, text)
    return trie_of(steps, [f"o{i}" for i in range(len(order))], members)


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Digested turns of conversations that share beginnings, and all their ids.

    Conversation c gets the first h turns of c - c % group, then its own after its first h;
    h is the crc32 of c in decimals modulo `heads`.
    """
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("o0"), "t")
    steps = digest_turns(turns, ["turn"]).withColumn("pos", F.row_number().over(order))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    ids = steps.select("conv").distinct()
    first = steps.where((F.col("conv") % group == 0) & (F.col("pos") < heads))
    lent = (
        ids.select(F.col("conv").alias("to"), (F.col("conv") - F.col("conv") % group).alias("conv"))
        .join(first, "conv")
        .withColumn("conv", F.col("to"))
        .where(F.col("pos") <= h)
    )
    own = steps.where(F.col("pos") > h)
    columns = lambda df, part: df.select("conv", F.lit(part).alias("part"), "pos", "t", "w")
    return columns(lent, 0).unionByName(columns(own, 1)), ids
