"""Suffix-array deduplication: bytes covered by a string that starts in an earlier document.

Equal strings of `length` bytes have equal smallest hashed grams, so windows are dealt by
that gram: a run of windows with one smallest gram is a segment, and equal windows of any
two documents meet in one bucket. Segments whose gram no other segment has are left out
before any text moves. In a bucket, the segments with a repeated window are sorted: a
suffix array by linear grouping gives the groups of equal windows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabulant.llm.common import (
    BLOBS,
    answered,
    asked,
    batched,
    blobs,
    finish,
    mix,
    pack,
    texts,
    unpack,
)

BASE = 0x9E3779B97F4A7C15
NOBODY = np.iinfo(np.int64).max


def suffix_order(text: list[int]) -> list[int]:
    """Suffixes in ascending order; the last character must be smaller than all others.

    First, suffixes are grouped by their longest Lyndon prefix. Groups are taken from the
    highest down: the previous smaller suffix of each member gets the group's prefix
    appended to its own (as often as members point to it) and moves, with those that get
    the same, to a new group right above its old one. Then groups are emitted in ascending
    order: each suffix that is placed lets the one before it, and that one's previous
    smaller suffixes, take the next free places of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # where the group of a suffix starts
    size = [0] * n  # by start
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    smaller = [-1] * n
    end = n
    while end:
        first = group[order[end - 1]]
        members = sorted(order[first:end])
        points: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, c in points.items():
            by_count.setdefault(c, {}).setdefault(group[p], []).append(p)
        for c in sorted(by_count, reverse=True):
            for old, moved in by_count[c].items():
                if len(moved) == size[old]:
                    continue
                top = old + size[old]
                new = top - len(moved)
                size[old] -= len(moved)
                size[new] = len(moved)
                for p in moved:
                    top -= 1
                    other, at = order[top], place[p]
                    order[at], order[top] = other, p
                    place[other], place[p] = at, top
                for p in moved:
                    group[p] = new
        end = first
    placed = [False] * n
    free = list(range(n))  # next place of the group that starts here
    out = [0] * n
    last = n - 1
    out[0], placed[last] = last, True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return out


def equal_windows(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Groups of equal windows (piece, offset) of the given length, from the suffix array."""
    text: list[int] = []
    owner_start = []
    for p in pieces:
        owner_start.append(len(text))
        text += [b + 2 for b in p]
        text.append(1)
    text.append(0)
    edges = np.array(owner_start)
    sizes = np.array([len(p) for p in pieces])
    order = np.array(suffix_order(text))
    piece = np.searchsorted(edges, order, "right") - 1
    offset = order - edges[piece]
    groups: list[list[tuple[int, int]]] = []
    before = None
    for p, o in zip(piece.tolist(), offset.tolist()):
        if o + length > sizes[p]:
            continue
        window = pieces[p][o : o + length]
        if window != before:
            groups.append([])
            before = window
        groups[-1].append((p, o))
    return groups


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of `width` bytes, by doubling."""
    power = lambda e: np.uint64(pow(BASE, e, 1 << 64))
    have = data.astype(np.uint64) + np.uint64(1)
    out, covered, step = None, 0, 1
    while True:
        if width & step:
            if out is None:
                out, covered = have, step
            else:
                # `have` covers the bytes after those that `out` covers
                n = len(data) - covered - step + 1
                out = out[:n] * power(step) + have[covered : covered + n]
                covered += step
        if covered == width:
            return out
        have = have[:-step] * power(step) + have[step:]
        step *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Batch:
    """The documents of a batch in a fixed order and the segments of their windows.

    `code` is a segment's bucket and key; `begin`, `stop` its windows in `data`.
    """

    def __init__(self, table: pa.Table, parts: int, length: int, gram: int):
        ids = table.column("id").to_pylist()
        bodies = table.column("text").cast(pa.binary()).to_pylist()
        rank = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, bodies[i]))
        self.ids = [ids[i] for i in rank]
        self.bodies = [bodies[i] for i in rank]
        size = np.array([len(b) for b in self.bodies], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.text = b"".join(self.bodies)
        self.length = length
        data = np.frombuffer(self.text, np.uint8)
        named = np.array([i is not None for i in self.ids], bool)
        long = np.flatnonzero((size >= length) & named)
        if not len(long):
            self.code = self.begin = self.stop = self.doc = np.zeros(0, np.int64)
            return
        low = np.empty(len(data) - length + 1, np.uint64)
        step = 2 << 20
        for i in range(0, len(low), step):
            h = mix(gram_hashes(data[i : i + step + length - 1], gram))
            low[i : i + step] = sliding_min(h, length - gram + 1)
        first, past = self.edge[long], self.edge[long + 1] - length + 1
        begin = np.union1d(np.flatnonzero(low[1:] != low[:-1]) + 1, first)
        at = np.searchsorted(first, begin, "right") - 1
        ok = (at >= 0) & (begin < past[np.maximum(at, 0)])
        begin, at = begin[ok], at[ok]
        stop = np.minimum(np.append(begin[1:], len(low)), past[at])
        key = mix(low[begin])
        bucket = (key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        self.code = bucket << np.uint64(32) | key >> np.uint64(32)
        self.begin, self.stop, self.doc = begin, stop, long[at]

    def questions(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, how many segments have them, and the edges of the buckets."""
        code, n = np.unique(self.code.astype(np.uint64), return_counts=True)
        starts = np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)
        return code, n, np.searchsorted(code, starts)

    def entries(self, parts: int, got: dict[int, bytes]):
        """Distinct texts of the segments whose code is met again, bucket by bucket.

        Gives {bucket: (texts, smallest id of each)} and, for all occurrences, the bucket,
        the text's number in it, and the segment.
        """
        code, n, edge = self.questions(parts)
        again = n > 1
        for k, blob in got.items():
            if k < parts:
                span = slice(edge[k], edge[k + 1])
                bits = np.unpackbits(np.frombuffer(blob, np.uint8), count=edge[k + 1] - edge[k])
                again[span] |= bits.astype(bool)
        picked = np.flatnonzero(again[np.searchsorted(code, self.code.astype(np.uint64))])
        bucket = (self.code[picked].astype(np.uint64) >> np.uint64(32)).tolist()
        number: dict[int, dict[bytes, int]] = defaultdict(dict)
        least: dict[int, list[int]] = defaultdict(list)
        seen = []
        rest = self.length - 1
        text, ids = self.text, self.ids
        for k, a, z, d in zip(
            bucket,
            self.begin[picked].tolist(),
            self.stop[picked].tolist(),
            self.doc[picked].tolist(),
        ):
            own = number[k]
            i = own.setdefault(text[a : z + rest], len(own))
            if i == len(least[k]):
                least[k].append(ids[d])  # documents come in ascending order
            seen.append(i)
        return number, least, (bucket, seen, picked)


def repeated_codes(k: int, got: dict[int, bytes]) -> dict[int, bytes]:
    """Which codes of each batch another batch has too, as bits."""
    own = {b: unpack(blob, np.uint32) for b, blob in got.items()}
    value, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
    return {b: np.packbits(n[np.searchsorted(value, x)] > 1).tobytes() for b, x in own.items()}


def pack_entries(texts: list[bytes], least: list[int]) -> bytes:
    head = len(texts).to_bytes(4, "little")
    size = np.array([len(t) for t in texts], np.uint32)
    return head + pack(size) + pack(np.array(least, np.int64)) + b"".join(texts)


def unpack_entries(blob: bytes) -> tuple[list[bytes], list[int]]:
    n = int.from_bytes(blob[:4], "little")
    size = unpack(blob[4 : 4 + 4 * n], np.uint32).astype(np.int64)
    least = unpack(blob[4 + 4 * n : 4 + 12 * n], np.int64).tolist()
    body, at = blob[4 + 12 * n :], np.concatenate([[0], np.cumsum(size)]).tolist()
    return [body[at[i] : at[i + 1]] for i in range(n)], least


def window_owners(contents: list[bytes], least: list[int], length: int) -> list[np.ndarray]:
    """For each window of each distinct text the smallest id of a document that has it."""
    sizes = np.array([len(c) for c in contents])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    owner = [np.full(len(c) - length + 1, i, np.int64) for c, i in zip(contents, least)]
    data = np.frombuffer(b"".join(contents), np.uint8)
    if len(contents) < 2:
        return owner
    h = mix(gram_hashes(data, length))
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, edge[:-1], 1)
    np.add.at(depth, edge[1:] - length + 1, -1)
    windows = np.cumsum(depth)[: len(h)] > 0
    at = np.flatnonzero(windows)
    value, inverse, n = np.unique(h[at], return_inverse=True, return_counts=True)
    at, inverse = at[n[inverse] > 1], inverse[n[inverse] > 1]
    if not len(at):
        return owner
    # maximal runs of repeated windows of one text become pieces, equal ones once
    piece_of = np.searchsorted(edge, at, "right") - 1
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(piece_of) > 0)) + 1
    number: dict[bytes, int] = {}
    uses: list[list[tuple[int, int]]] = []
    low: list[int] = []
    some: list[set[int]] = []
    bounds = [0, *cut.tolist(), len(at)]
    for a, z in zip(bounds, bounds[1:]):
        c = int(piece_of[a])
        begin = int(at[a] - edge[c])
        piece = contents[c][begin : int(at[z - 1] - edge[c]) + length]
        i = number.setdefault(piece, len(number))
        if i == len(uses):
            uses.append([])
            low.append(least[c])
            some.append(set(inverse[a:z].tolist()))
        uses[i].append((c, begin))
        low[i] = min(low[i], least[c])
    pieces = list(number)
    best = [np.full(len(p) - length + 1, low[i], np.int64) for i, p in enumerate(pieces)]
    # pieces that may share a window are sorted together, the others need no order
    leader = list(range(len(pieces)))

    def root(i: int) -> int:
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    holder: dict[int, int] = {}
    for i, hashes in enumerate(some):
        for v in hashes:
            j = root(holder.setdefault(v, i))
            leader[root(i)] = j
    families = defaultdict(list)
    for i in range(len(pieces)):
        families[root(i)].append(i)
    for family in families.values():
        if len(family) > 1:
            for group in equal_windows([pieces[i] for i in family], length):
                smallest = min(low[family[p]] for p, _ in group)
                for p, o in group:
                    best[family[p]][o] = smallest
    for i, spots in enumerate(uses):
        for c, begin in spots:
            span = slice(begin, begin + len(best[i]))
            owner[c][span] = np.minimum(owner[c][span], best[i])
    return owner


SCHEMA = (
    "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
)


def repeated_spans(
    docs: DataFrame, length: int = 50, gram: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Byte spans of each text covered by a `length`-byte string of a smaller id's text.

    One row per document row: doc_id, n_bytes, spans (maximal, end exclusive, byte
    positions in UTF-8) and `kept`, the bytes outside them. Strings are judged on the
    input. Matches do not cross documents; rows with one id never remove each other's
    bytes; rows with a null id neither remove nor lose any. Null text is empty. Other
    columns are ignored; an empty table gives no rows.

    The texts move once. What buckets see of a batch is each distinct segment once with its
    smallest id, so a passage of very many documents is no hot key. `gram` (below `length`)
    only sets how selective the dealing is.
    """
    dealt, parts = batched(texts(docs, key, text), 8 << 20)

    def ask_codes(table: pa.Table) -> dict[int, bytes]:
        code, _, edge = Batch(table, parts, length, gram).questions(parts)
        low = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return {
            k: pack(low[edge[k] : edge[k + 1]]) for k in range(parts) if edge[k] < edge[k + 1]
        }

    def ask_owners(table: pa.Table, got: dict[int, bytes]) -> dict[int, bytes]:
        number, least, _ = Batch(table, parts, length, gram).entries(parts, got)
        return {k: pack_entries(list(number[k]), least[k]) for k in number}

    def owners(k: int, got: dict[int, bytes]) -> dict[int, bytes]:
        number: dict[bytes, int] = {}
        least: list[int] = []
        asked = {}
        for b, blob in got.items():
            contents, ids = unpack_entries(blob)
            at = [number.setdefault(c, len(number)) for c in contents]
            least += [NOBODY] * (len(number) - len(least))
            for i, d in zip(at, ids):
                least[i] = min(least[i], d)
            asked[b] = at, ids
        owner = window_owners(list(number), least, length)
        return {b: _masks([owner[i] for i in at], ids) for b, (at, ids) in asked.items()}

    def _masks(owner: list[np.ndarray], ids: list[int]) -> bytes:
        """Per text: none, all or some windows belong to a smaller id; bits for `some`."""
        kinds, bits = [], []
        for o, d in zip(owner, ids):
            m = o < d
            kinds.append(1 if m.all() else 2 if m.any() else 0)
            if kinds[-1] == 2:
                bits.append(np.packbits(m).tobytes())
        return len(kinds).to_bytes(4, "little") + bytes(kinds) + b"".join(bits)

    def result(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        batch = Batch(table, parts, length, gram)
        number, least, (bucket, seen, picked) = batch.entries(parts, got)
        gone = np.zeros(len(batch.text) + 1, np.int32)
        masks: dict[int, list] = {}
        for k in number:
            blob, sizes = got[parts + k], [len(t) - length + 1 for t in number[k]]
            n = int.from_bytes(blob[:4], "little")
            at, out = 4 + n, []
            for kind, w in zip(blob[4 : 4 + n], sizes):
                mask = None
                if kind == 2:
                    wide = -(-w // 8)
                    raw = np.frombuffer(blob[at : at + wide], np.uint8)
                    mask = np.unpackbits(raw, count=w).astype(bool)
                    at += wide
                out.append((kind, mask))
            masks[k] = out
        for k, i, s in zip(bucket, seen, picked.tolist()):
            a, z = int(batch.begin[s]), int(batch.stop[s])
            kind, mask = masks[k][i]
            if kind == 1 or batch.ids[batch.doc[s]] > least[k][i]:
                gone[a] += 1
                gone[z + length - 1] -= 1
            elif kind == 2:
                starts = a + np.flatnonzero(mask)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + length, -1)
        out = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for d, body in enumerate(batch.bodies):
            m = out[batch.edge[d] : batch.edge[d + 1]]
            if not m.any():
                spans.append([])
                kept.append(body)
                continue
            edges = np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": a, "end": z} for a, z in edges.reshape(-1, 2).tolist()])
            kept.append(np.frombuffer(body, np.uint8)[~m].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": pa.array(batch.ids, pa.int64()),
                "n_bytes": pa.array([len(b) for b in batch.bodies], pa.int64()),
                "spans": pa.array(spans, kind),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    met = answered(asked(dealt, ask_codes), repeated_codes)
    owned = answered(finish(dealt, met, _as_blobs(ask_owners), BLOBS), owners)
    shifted = owned.selectExpr("b", f"k + {parts} AS k", "blob")
    return finish(dealt, met.unionByName(shifted), result, SCHEMA)


def _as_blobs(emit):
    def run(table: pa.Table, got: dict[int, bytes]) -> pa.Table:
        out = emit(table, got) if table.num_rows else {}
        b = table.column("b")[0].as_py() if table.num_rows else 0
        return blobs([b] * len(out), list(out), list(out.values()))

    return run
