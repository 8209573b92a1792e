"""Approximate nearest neighbours: one navigable small-world hierarchy per shard.

Equal vectors are one point: a graph whose points have copies would link copies to copies
only. A shard's graph is kept as flat arrays: the vectors, the smallest ids of each, and per
layer one row of neighbour numbers per member. Many points are inserted, and many queries answered, side by side. The
largest inner products of all shards are merged. Inner products become distances by one
more coordinate that gives all vectors of a shard the same length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.llm.common import mix, written

WIDTH = 4  # candidates that a query expands at once


def distances(x: np.ndarray, norm: np.ndarray, q: np.ndarray, row: np.ndarray, node: np.ndarray):
    """Squared distance, less the query's own part, of query rows to nodes."""
    return norm[node] - 2 * np.einsum("ij,ij->i", x[node], q[row])


def beam_search(
    nbrs: np.ndarray, x: np.ndarray, norm: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int
) -> tuple[np.ndarray, np.ndarray]:
    """The `ef` nearest found of each query, ascending; numbers are -1 where fewer were found."""
    ids = np.full((len(q), ef), -1)
    dist = np.full((len(q), ef), np.inf, np.float32)
    every = np.arange(len(q))
    ids[:, 0], dist[:, 0] = entry, distances(x, norm, q, every, entry)
    seen = np.zeros((len(q), len(x)), bool)
    seen[every, entry] = True
    spent = np.zeros((len(q), ef), bool)
    active = every
    while len(active):
        open_ = ~spent[active] & (ids[active] >= 0)
        alive = open_.any(1)
        active, open_ = active[alive], open_[alive]
        if not len(active):
            break
        first = np.cumsum(open_, axis=1)
        take = open_ & (first <= WIDTH)
        spent[active] |= take
        row, col = np.nonzero(take)
        near = nbrs[ids[active[row], col]]
        owner = np.repeat(row, near.shape[1])
        near = near.ravel()
        ok = near >= 0
        owner, near = owner[ok], near[ok]
        ok = ~seen[active[owner], near]
        # a node that two expanded ones share counts once
        code = np.unique(owner[ok] * np.int64(len(x)) + near[ok])
        owner, near = code // len(x), code % len(x)
        seen[active[owner], near] = True
        if not len(near):
            continue
        d = distances(x, norm, q, active[owner], near)
        start = np.searchsorted(owner, np.arange(len(active)))
        place = np.arange(len(owner)) - start[owner]
        wide = ef + int(place.max()) + 1
        new_ids = np.full((len(active), wide), -1)
        new_dist = np.full((len(active), wide), np.inf, np.float32)
        new_spent = np.ones((len(active), wide), bool)
        new_ids[:, :ef], new_dist[:, :ef] = ids[active], dist[active]
        new_spent[:, :ef] = spent[active]
        new_ids[owner, ef + place], new_dist[owner, ef + place] = near, d
        new_spent[owner, ef + place] = False
        order = np.argsort(new_dist, axis=1, kind="stable")[:, :ef]
        ids[active] = np.take_along_axis(new_ids, order, 1)
        dist[active] = np.take_along_axis(new_dist, order, 1)
        spent[active] = np.take_along_axis(new_spent, order, 1)
    return ids, dist


def diverse(x: np.ndarray, points: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` neighbours per point from candidates (padded with -1): nearest first, each
    nearer to the point than to any neighbour taken before; left places go to the nearest."""
    gap = x[np.maximum(cand, 0)] - x[points][:, None, :]
    dist = np.where(cand >= 0, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    cand[:, 1:][(cand[:, 1:] == cand[:, :-1])] = -1  # repeated candidates
    dist[cand < 0] = np.inf
    n = len(points)
    out = np.full((n, most), -1)
    kept = np.zeros((n, most, x.shape[1]), x.dtype)
    count = np.zeros(n, int)
    late = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        live = np.flatnonzero((cand[:, j] >= 0) & (count < most))
        if not len(live):
            continue
        v = x[cand[live, j]]
        gap = kept[live] - v[:, None, :]
        inner = np.einsum("ijk,ijk->ij", gap, gap)
        inner[np.arange(most) >= count[live, None]] = np.inf
        good = inner.min(1) > dist[live, j]
        late[live[~good], j] = True
        live, v = live[good], v[good]
        out[live, count[live]] = cand[live, j]
        kept[live, count[live]] = v
        count[live] += 1
    for j in range(cand.shape[1]):
        live = np.flatnonzero(late[:, j] & (count < most))
        out[live, count[live]] = cand[live, j]
        count[live] += 1
    return out


def add_layer(
    x: np.ndarray, norm: np.ndarray, members: np.ndarray, entries: np.ndarray, most: int, ef: int
) -> np.ndarray:
    """Neighbours (numbers into x) of the members of a layer, inserted in growing batches.

    `entries`: per member where its search starts, a member of this layer found above.
    """
    nbrs = np.full((len(x), most), -1)
    done = members[:0]
    at = 0
    while at < len(members):
        size = min(max(64, len(done)), 1024, max(64, (1 << 26) // len(x)))
        new = members[at : at + size]
        parts = []
        if len(done):
            # what was found above may not be inserted here yet
            start = np.where(np.isin(entries[at : at + size], done), entries[at : at + size], done[0])
            parts.append(beam_search(nbrs, x, norm, x[new], start, ef)[0])
        among = x[new] @ x[new].T
        among = norm[new][None, :] - 2 * among
        np.fill_diagonal(among, np.inf)
        k = min(most, len(new) - 1)
        if k > 0:
            parts.append(new[np.argpartition(among, k - 1, axis=1)[:, :k]])
        at += size
        done = members[:at]
        if not parts:
            continue
        nbrs[new] = diverse(x, new, np.concatenate(parts, axis=1), most)
        # and back
        row, col = np.nonzero(nbrs[new] >= 0)
        to, back = nbrs[new][row, col], new[row]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        hit, first, count = np.unique(to, return_index=True, return_counts=True)
        for low in range(0, len(hit), 1024):
            h, f, c = hit[low : low + 1024], first[low : low + 1024], count[low : low + 1024]
            wide = np.full((len(h), most + int(c.max())), -1)
            wide[:, :most] = nbrs[h]
            r = np.repeat(np.arange(len(h)), c)
            offset = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
            wide[r, most + offset] = back[np.repeat(f, c) + offset]
            nbrs[h] = diverse(x, h, wide, most)
    return nbrs


def augmented(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.einsum("ij,ij->i", vectors, vectors)
    rest = np.sqrt(np.maximum(length.max() - length, 0))
    x = np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)
    return x, np.einsum("ij,ij->i", x, x)


def build(ids: np.ndarray, vectors: np.ndarray, most: int = 16, ef: int = 64) -> list[np.ndarray]:
    """Neighbour arrays of the layers, lowest first. A point's top layer follows from its id."""
    x, norm = augmented(vectors)
    draw = (mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) / 2**53
    level = np.floor(-np.log(np.maximum(draw, 1e-18)) / np.log(most)).astype(int)
    level = np.minimum(level, int(np.log(max(len(ids), 2)) / np.log(most)))
    level[np.argmax(level)] = top = max(int(level.max()), 0)
    layers: list[np.ndarray] = []
    entries = np.full(len(ids), int(np.argmax(level)))
    for layer in range(top, -1, -1):
        members = np.flatnonzero(level >= layer)
        members = members[np.argsort(-level[members], kind="stable")]
        wide = 2 * most if layer == 0 else most
        nbrs = add_layer(x, norm, members, entries[members], wide, ef)
        layers.append(nbrs)
        if layer:
            step = max(64, (1 << 26) // len(x))
            for i in range(0, len(x), step):
                part = slice(i, i + step)
                entries[part] = beam_search(nbrs, x, norm, x[part], entries[part], 4)[0][:, 0]
    return layers[::-1]


def search(
    layers: list[np.ndarray], vectors: np.ndarray, queries: np.ndarray, entry: int, ef: int
) -> np.ndarray:
    x, norm = augmented(vectors)
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    out = []
    step = max(64, (1 << 26) // len(x))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        at = np.full(len(part), entry)
        for nbrs in layers[:0:-1]:
            at = beam_search(nbrs, x, norm, part, at, 4)[0][:, 0]
        out.append(beam_search(layers[0], x, norm, part, at, ef)[0])
    return np.concatenate(out)


INDEX = (
    "shard int, ids binary, members binary, sizes binary, vectors binary, "
    "layers array<binary>, entry int"
)
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    got = (
        rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))
        .where("id is not null and v is not null and size(v) > 0")
        .where(fine)
        .where(F.exists("v", lambda e: e != 0))
    )
    sizes = got.groupBy(F.size("v").alias("n")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return got.where(F.size("v") == (top["n"] if top else 0))


def distinct_vectors(good: DataFrame, keep: int, salts: int = 16) -> DataFrame:
    """v and members: its `keep` smallest ids, ascending. One row per vector.

    The ids of a vector are cut to `keep` in each partition first and in `salts` parts then,
    so that a vector of very many rows is no single task's work.
    """
    one = good.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    order = Window.partitionBy("v", "salt").orderBy("id")
    few = one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    members = F.slice(F.sort_array(F.collect_list("id")), 1, keep)
    return few.groupBy("v").agg(members.alias("members"))


def _build(most: int, ef: int):
    def run(table: pa.Table) -> pa.Table:
        column = table.column("members").combine_chunks()
        sizes = pa.compute.list_value_length(column).to_numpy().astype(np.int64)
        members = np.array(column.flatten())
        ids = members[np.cumsum(sizes) - sizes]
        v = np.array(table.column("v").combine_chunks().flatten()).reshape(len(ids), -1)
        order = np.lexsort((*v.T[::-1], ids))
        members = members[spread((np.cumsum(sizes) - sizes)[order], sizes[order])]
        ids, sizes, v = ids[order], sizes[order], v[order]
        layers = build(ids, v, most, ef)
        entry = int(np.flatnonzero((layers[-1] >= 0).any(1))[0]) if (layers[-1] >= 0).any() else -1
        if entry < 0:  # a top layer of one point
            entry = _lone(layers, ids, most)
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "members": pa.array([members.tobytes()], pa.binary()),
                "sizes": pa.array([sizes.tobytes()], pa.binary()),
                "vectors": pa.array([v.tobytes()], pa.binary()),
                "layers": pa.array(
                    [[a.astype(np.int32).tobytes() for a in layers]], pa.list_(pa.binary())
                ),
                "entry": pa.array([entry], pa.int32()),
            }
        )

    return run


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def _lone(layers: list[np.ndarray], ids: np.ndarray, most: int) -> int:
    draw = (mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64)
    return int(np.argmin(draw)) if len(layers) > 1 else 0


def ranked(r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by query, falling score and id, and the ranks from 0 within the queries."""
    order = np.lexsort((ids, -score, r))
    return order, np.arange(len(r)) - np.searchsorted(r[order], r[order])


def _search(k: int, ef: int):
    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if index.num_rows and asked.num_rows:
            row = index.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            v = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
            layers = [np.frombuffer(a, np.int32).reshape(len(ids), -1) for a in row["layers"]]
            qid = asked.column("id").to_numpy()
            q = np.array(asked.column("v").combine_chunks().flatten()).reshape(len(qid), -1)
            members = np.frombuffer(row["members"], np.int64)
            sizes = np.frombuffer(row["sizes"], np.int64)
            begin = np.cumsum(sizes) - sizes
            got = search(layers, v, q, row["entry"], max(ef, k + 1))
            for low in range(0, len(qid), 2000):
                part = slice(low, low + 2000)
                r, c = np.nonzero(got[part] >= 0)
                node = got[part][r, c]
                score = (v[node] * q[part][r]).sum(1)
                # k of the first k + 1 points' members other than the query are the first k of all
                top = ranked(r, score, ids[node])
                top = top[0][top[1] <= k]
                r, node, score = r[top], node[top], score[top]
                vec = members[spread(begin[node], sizes[node])]
                r, score = np.repeat(r, sizes[node]), np.repeat(score, sizes[node])
                ok = vec != qid[part][r]
                r, vec, score = r[ok], vec[ok], score[ok]
                top = ranked(r, score, vec)
                top = top[0][top[1] < k]
                out["query_id"].append(qid[part][r[top]])
                out["vec_id"].append(vec[top])
                out["score"].append(score[top])
        out = {n: np.concatenate(x) if x else [] for n, x in out.items()}
        return pa.table(
            {
                "query_id": pa.array(out["query_id"], pa.int64()),
                "vec_id": pa.array(out["vec_id"], pa.int64()),
                "score": pa.array(out["score"], pa.float64()),
            }
        )

    return run


def build_index(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    shards: int = 8,
    shard_rows: int = 250_000,
    most: int = 16,
    ef: int = 80,
    keep: int = 21,
) -> DataFrame:
    """One row per shard: ids, vectors and the layers' neighbour arrays, in the shared folder.

    At least `shards` graphs, more if one would hold over `shard_rows` vectors; every vector
    that takes part is in one, dealt by its hash, with its `keep` smallest ids (all that a
    search for `keep` - 1 neighbours can need).
    """
    good = written(distinct_vectors(usable(rows, key, vector), keep))
    parts = max(shards, -(-good.count() // shard_rows))
    shard = F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")
    return written(
        good.withColumn("shard", shard).groupBy("shard").applyInArrow(_build(most, ef), INDEX)
    )


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    ef: int = 120,
    query_rows: int = 20_000,
    **index,
) -> DataFrame:
    """The k rows with the largest inner product found for each query, nearest first.

    query_id, rank (from 1), vec_id, score (double, on the vectors as given); ties go to the
    smaller vec_id; rows with the query's own id are no candidates. Vectors that are null,
    zero, or hold null or non-finite components, rows with a null id and vectors of another
    length than most take no part; repeated query ids count once. Empty tables give no rows.
    Queries meet every shard in blocks of about `query_rows`.
    """
    graphs = build_index(rows, key, vector, keep=k + 1, **index)
    asked = usable(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)))
    numbers = [r.shard for r in graphs.select("shard").collect()]  # one per graph
    if not numbers:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = asked.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in numbers])))
    met = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumn("block", F.col("block").cast("long"))
    asked = asked.withColumn("block", F.col("block").cast("long"))
    found = (
        met.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(_search(k, ef), FOUND)
    )
    # repeated ids among the candidates count once
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
